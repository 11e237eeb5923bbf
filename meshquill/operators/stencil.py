"""Central-difference operators on a periodic uniform grid: one explode to the six neighbours and one grouped sum.

A cell sends its values to the cells it is a neighbour of; a grouped sum adds what arrives along each axis with its sign, so all
first derivatives of all variables take one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derivatives(cells: DataFrame, names: list[str], n: int, d: float) -> DataFrame:
    """i, j, k, each variable, and d_<name>_<axis>."""
    ways = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign")) for a in range(3) for s in (-1, 1)), F.struct(F.lit(-1).alias("axis"), F.lit(0).alias("sign")))
    sent = cells.withColumn("way", F.explode(ways))
    index = [F.pmod(F.col(c) - F.when(F.col("way.axis") == a, F.col("way.sign")).otherwise(0), F.lit(n)).cast("long").alias(c) for a, c in enumerate("ijk")]
    sent = sent.select(*index, F.col("way.axis").alias("axis"), F.col("way.sign").alias("sign"), *names)
    sums = [F.sum(F.when(F.col("axis") == -1, F.col(v))).alias(v) for v in names]
    sums += [(F.sum(F.when(F.col("axis") == a, F.col("sign") * F.col(v))) * (0.5 / d)).alias(f"d_{v}_{x}") for v in names for a, x in enumerate("xyz")]
    return sent.groupBy("i", "j", "k").agg(*sums)


def divergence(v: tuple[str, str, str]) -> Column:
    return F.col(f"d_{v[0]}_x") + F.col(f"d_{v[1]}_y") + F.col(f"d_{v[2]}_z")


def curl(v: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    d = lambda c, a: F.col(f"d_{v[c]}_{a}")
    return d(2, "y") - d(1, "z"), d(0, "z") - d(2, "x"), d(1, "x") - d(0, "y")


def dissipation(v: tuple[str, str, str], nu: Column) -> Column:
    """2 nu S_ij S_ij with the traceless strain."""
    d = [[F.col(f"d_{v[i]}_{a}") for a in "xyz"] for i in range(3)]
    div = d[0][0] + d[1][1] + d[2][2]
    total = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            s = 0.5 * (d[i][j] + d[j][i]) - (div / 3 if i == j else F.lit(0.0))
            total = total + s * s
    return 2 * nu * total


def tension(b: tuple[str, str, str]) -> tuple[Column, ...]:
    """(B . grad) B."""
    return tuple(sum((F.col(b[j]) * F.col(f"d_{b[i]}_{a}") for j, a in enumerate("xyz")), F.lit(0.0)) for i in range(3))


def cross_current(b: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    """B x J with J = curl B."""
    j, f = curl(b), [F.col(x) for x in b]
    return f[1] * j[2] - f[2] * j[1], f[2] * j[0] - f[0] * j[2], f[0] * j[1] - f[1] * j[0]


def dissipation_rate(v: tuple[str, str, str], dens: str, dx: float, nu: float | None = None) -> Column:
    """The viscous heating of a volume; without nu the viscosity is |v| dx, that of a Reynolds number of 1 on a cell."""
    speed = F.sqrt(F.col(v[0]) * F.col(v[0]) + F.col(v[1]) * F.col(v[1]) + F.col(v[2]) * F.col(v[2]))
    return F.col(dens) * dissipation(v, F.lit(float(nu)) if nu else speed * dx)


def dot_current(b: tuple[str, str, str]) -> Column:
    """B . J with J = curl B."""
    j = curl(b)
    return F.col(b[0]) * j[0] + F.col(b[1]) * j[1] + F.col(b[2]) * j[2]


def electromotive(v: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    """v x B, whose curl (of the columns it is given) is the induction."""
    p, q = [F.col(x) for x in v], [F.col(x) for x in b]
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def gradient(name: str, sign: float = 1.0) -> tuple[Column, Column, Column]:
    """The gradient of a variable; sign -1 gives the acceleration of a potential."""
    return tuple(sign * F.col(f"d_{name}_{a}") for a in "xyz")


def enstrophy_terms(v: tuple[str, str, str], w: tuple[str, str, str], flux: tuple[str, str, str] | None = None, dens: str | None = None, pres: str | None = None) -> dict[str, Column]:
    """Sources of enstrophy w**2 / 2 (w: the vorticity's columns): stretching, compression; with flux (columns of v w**2 / 2 and their
    derivatives) advection, with density and pressure (and their derivatives) the baroclinic term."""
    stretch = sum((F.col(w[i]) * F.col(w[j]) * F.col(f"d_{v[i]}_{a}") for i in range(3) for j, a in enumerate("xyz")), F.lit(0.0))
    square = sum((F.col(x) * F.col(x) for x in w), F.lit(0.0))
    out = {"stretching": stretch, "compression": -0.5 * square * divergence(v)}
    if flux:
        out["advection"] = -divergence(flux)
    if dens and pres:
        r, p = gradient(dens), gradient(pres)
        turn = (r[1] * p[2] - r[2] * p[1], r[2] * p[0] - r[0] * p[2], r[0] * p[1] - r[1] * p[0])
        out["baroclinic"] = sum((F.col(x) * c for x, c in zip(w, turn)), F.lit(0.0)) / (F.col(dens) * F.col(dens))
    return out
