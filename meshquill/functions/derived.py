"""Derived variables: name -> column expression over the variables of a cell."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants in cgs units, and the mean molecular weight of the grid tools.
M_P, K_B, G, MU = 1.67262158e-24, 1.380649e-16, 6.67408e-8, 2.3


def _c(name: str) -> Column:
    return F.col(name)


def square_sum(*names: str) -> Column:
    out = _c(names[0]) * _c(names[0])
    for n in names[1:]:
        out = out + _c(n) * _c(n)
    return out


def dot(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    out = _c(a[0]) * _c(b[0])
    for x, y in zip(a[1:], b[1:]):
        out = out + _c(x) * _c(y)
    return out


V, B, A = ("velx", "vely", "velz"), ("magx", "magy", "magz"), ("vecpotx", "vecpoty", "vecpotz")


def variable(name: str, gamma: float = 5 / 3, mu: float = MU, have: list[str] | None = None) -> Column:
    """The column of a variable: itself if the table has it, else its definition."""
    if have and name in have:
        return _c(name)
    vel2, mag2 = square_sum(*V), square_sum(*B)
    valf = F.sqrt(mag2 / (4 * math.pi * _c("dens")))
    simple = {
        "outflow_dens": lambda: _c("oadv") * _c("dens"),
        "temperature": lambda: _c("pres") / _c("dens") * mu * M_P / K_B,
        "valf": lambda: valf,
        "cs": lambda: F.sqrt(gamma * _c("pres") / _c("dens")),
        "jnum": lambda: math.sqrt(math.pi / G) / F.greatest("dx", "dy", "dz") * F.sqrt(gamma * _c("pres") / _c("dens") / _c("dens")),
        "machalf": lambda: F.sqrt(vel2) / valf,
        "momx": lambda: _c("dens") * _c("velx"),
        "momy": lambda: _c("dens") * _c("vely"),
        "momz": lambda: _c("dens") * _c("velz"),
        "vel2": lambda: vel2,
        "mag2": lambda: mag2,
        "ekin": lambda: 0.5 * _c("dens") * vel2,
        "emag": lambda: mag2 / (8 * math.pi),
        "eint": lambda: _c("pres") / _c("dens") / (gamma - 1),
        "vorticity": lambda: F.sqrt(square_sum("vorticity_x", "vorticity_y", "vorticity_z")),
        "magnetic_helicity": lambda: dot(A, B),
        "mfx": lambda: _c("vely") * _c("magz") - _c("velz") * _c("magy"),
        "mfy": lambda: _c("velz") * _c("magx") - _c("velx") * _c("magz"),
        "mfz": lambda: _c("velx") * _c("magy") - _c("vely") * _c("magx"),
        "adotv": lambda: dot(A, V),
        "mach": lambda: F.sqrt(vel2 / (gamma * _c("pres") / _c("dens"))),
        "sqrtrho": lambda: F.sqrt("dens"),
    }
    if name in simple:
        return simple[name]()
    for axis, v, b in zip("xyz", V, B):
        along = dot(V, B) / mag2 * _c(b)
        if name == f"v{axis}_para_b":
            return along
        if name == f"v{axis}_perp_b":
            return _c(v) - along
        if name in (f"sqrtrho_{v}", f"rho3_{v}", f"rhov_{v}"):
            factor = {"sqrtrho": F.sqrt("dens"), "rho3": F.cbrt("dens"), "rhov": _c("dens")}[name.split("_")[0]]
            return factor * _c(v)
        if name == f"mach_{v}":
            return _c(v) / F.sqrt(_c("temp") * K_B / mu / M_P)
        if name == f"amach_{v}":
            return _c(v) / valf
        if name == f"valf_{b}":
            return _c(b) / F.sqrt(4 * math.pi * _c("dens"))
        if name == f"msmach_{v}":
            return _c(v) / F.sqrt(1 + 0.5 * mag2 / (4 * math.pi * _c("dens")))
    if name.startswith("dens_thresh_"):
        return F.when(_c("dens") > float(name.removeprefix("dens_thresh_")), 1.0).otherwise(0.0)
    raise KeyError(f"no variable {name}")


def radius(centre: tuple[float, float, float], lengths: tuple[float, float, float] | None = None, names=("x", "y", "z")) -> Column:
    """Distance to a centre; with lengths, to its nearest periodic image."""
    out = F.lit(0.0)
    for k, n in enumerate(names):
        d = _c(n) - centre[k]
        if lengths:
            d = F.when(d > lengths[k] / 2, d - lengths[k]).when(d < -lengths[k] / 2, d + lengths[k]).otherwise(d)
        out = out + d * d
    return F.sqrt(out)


def prepared(x: Column, scale: float = 1.0, log: str | None = None) -> Column:
    """A quantity over a scale, then its log10 (lg) or natural logarithm (ln)."""
    out = x / float(scale)
    return F.log10(out) if log == "lg" else F.ln(out) if log == "ln" else out


def transformed(cells, name: str, expression: str, out: str):
    """cells with a column that an SQL expression over q, the named quantity, gives; it is parsed by Spark, never run as code."""
    return cells.withColumn("q", F.col(name)).withColumn(out, F.expr(expression)).drop("q")
