"""Model functions, units, cosmology, initial conditions and the equation of state, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .derived import G


def kinetic_spectrum(k: Column, pkin: float, kbn: float, pbn: float, knu: float, pnu: float) -> Column:
    return (F.pow(k / kbn, F.lit(pkin)) + F.pow(k / kbn, F.lit(pbn))) * F.exp(-F.pow(k / knu, F.lit(pnu)))


def normal_pdf(s: Column, sigma: float, s0: float | None = None) -> Column:
    """s0 is -sigma**2 / 2 unless given."""
    s0 = -(sigma**2) / 2 if s0 is None else s0
    return F.exp(-(s - s0) * (s - s0) / (2 * sigma**2)) / math.sqrt(2 * math.pi * sigma**2)


def cauchy_pdf(s: Column, s0: float = 0.0, sigma: float = 1.0, gamma: float = 1.0) -> Column:
    """The product of a Cauchy and a normal density about s0, scaled to area 1."""
    norm = math.exp(-(gamma**2) / (2 * sigma**2)) * math.sqrt(2 * math.pi) * sigma / math.erfc(gamma / math.sqrt(2) / sigma)
    return norm / (math.pi * gamma * (1 + (s - s0) * (s - s0) / gamma**2)) * normal_pdf(s, sigma, s0)


def quartic_log_pdf(s: Column, c: tuple[float, ...]) -> Column:
    """The sum of c[n] * s**n, n up to 4."""
    out = F.lit(float(c[0]))
    for n, x in enumerate(c[1:], 1):
        out = out + float(x) * F.pow(s, F.lit(float(n)))
    return out


def bessel_i1_scaled(x: np.ndarray) -> np.ndarray:
    """exp(-x) * I1(x) by the integral over the angle."""
    angle = (np.arange(400) + 0.5) * np.pi / 400
    return (np.exp(x[:, None] * (np.cos(angle)[None, :] - 1)) * np.cos(angle)[None, :]).mean(axis=1)


def _jumps_pdf(lam: float, theta: float):
    """The density of s where ln(density) falls by exponential steps of mean theta, lam of them in the mean."""
    @F.pandas_udf("double")
    def pdf(s: pd.Series) -> pd.Series:
        u = np.maximum(lam / (1 + theta) - s.to_numpy(float) / theta, 0.0)
        root = 2 * np.sqrt(lam * u)
        out = np.where(u > 0, bessel_i1_scaled(root) * np.exp(root - lam - u) * np.sqrt(lam / np.maximum(theta**2 * u, 1e-300)), 0.0)
        return pd.Series(out)

    return pdf


def hopkins_pdf(sigma: float, theta: float):
    """A pandas UDF of s: the intermittent density PDF (volume weighted) of variance sigma**2."""
    return _jumps_pdf(sigma**2 / (2 * theta**2), theta)


def squire_pdf(kappa: float, xi: float, scales: float):
    """A pandas UDF of s: the PDF of jumps of mean kappa over a range of so many scales (outer over inner length)."""
    return _jumps_pdf(xi * (1 + 1 / kappa) * math.log(scales), kappa)


#: The Julian year, the solar radius, the astronomical unit and the parsec in cgs units.
YEAR, R_SOL, AU, PC = 3.15576e7, 6.957e10, 1.495978707e13, 3.085677581e18
#: Unit, its size, and from where on it is used; times are taken above their limit, lengths from it on.
LENGTHS = [("cm", 1.0, 0.0), ("m", 1e2, 1e2), ("km", 1e5, 1e5), ("rsol", R_SOL, R_SOL), ("AU", AU, AU), ("pc", PC, 1e4 * AU), ("kpc", 1e3 * PC, 1e3 * PC), ("Mpc", 1e6 * PC, 1e6 * PC)]
TIMES = [("ns", 1e-9, 1e-10), ("s", 1.0, 1e-6), ("yr", YEAR, 1e7), ("Myr", 1e6 * YEAR, 1e11)]


def length_in_units(x: Column) -> tuple[Column, Column]:
    """(value, unit) of a length in cm."""
    value, unit = x / LENGTHS[0][1], F.lit(LENGTHS[0][0])
    for name, size, low in LENGTHS[1:]:
        value, unit = F.when(x >= low, x / size).otherwise(value), F.when(x >= low, name).otherwise(unit)
    return value, unit


def time_in_units(t: Column) -> tuple[Column, Column]:
    """(value, unit) of a time in seconds, with its sign; next to nothing is 0 without a unit."""
    value, unit = F.lit(0.0), F.lit("")
    for name, size, low in TIMES:
        value, unit = F.when(F.abs(t) > low, t / size).otherwise(value), F.when(F.abs(t) > low, name).otherwise(unit)
    return value, unit


def proper(name: str, x: Column, z: Column) -> Column:
    """A comoving quantity in proper units."""
    a = 1 / (1 + z)
    power = {"dens": 3, "pres": 1, "eint": -2, "temp": -2}  # ener follows from eint and the velocity: proper_energy()
    return x * a if name == "length" else x * F.pow(1 + z, F.lit(float(power[name])))


def proper_velocity(x: Column, v: Column, z: Column, hubble0: float, omega_m: float) -> Column:
    a = 1 / (1 + z)
    hubble = hubble0 * F.sqrt(omega_m * F.pow(1 + z, F.lit(3.0)) + (1 - omega_m))
    return hubble * a * x + a * v


def proper_energy(eint: Column, v: tuple[Column, Column, Column], z: Column) -> Column:
    """Energy per mass in proper units: that of heat and half the square of the proper velocity."""
    return proper("eint", eint, z) + 0.5 * (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def polytropic_pressure(dens: Column, edges: list[float], exponents: list[float], k0: float) -> Column:
    """Piecewise K * dens**gamma, continuous at the edges (ascending; the first exponent holds below the first edge)."""
    k, out = k0, None
    pieces = [(None, k0 * F.pow(dens, F.lit(exponents[0])))]
    for edge, low, high in zip(edges, exponents, exponents[1:]):
        k = k * edge ** (low - high)
        pieces.append((edge, k * F.pow(dens, F.lit(high))))
    out = pieces[0][1]
    for edge, value in pieces[1:]:
        out = F.when(dens >= edge, value).otherwise(out)
    return out


def free_fall_time(dens: Column) -> Column:
    return F.sqrt(3 * math.pi / (32 * G * dens))


def cloud_conditions(dens: Column, size: Column, sigma: Column, omega: Column, field: Column, cs: float = 2e4, box: bool = False) -> dict[str, Column]:
    """Mass, times, energies and ratios of a cloud: a box of the size, or a sphere of this diameter (a box counts as a sphere of its volume)."""
    volume = F.pow(size, F.lit(3.0)) if box else math.pi / 6 * F.pow(size, F.lit(3.0))
    radius = F.pow(volume / (4 * math.pi / 3), F.lit(1 / 3)) if box else size / 2
    mass, valf = dens * volume, field / F.sqrt(4 * math.pi * dens)
    grav, turb = 0.6 * G * mass * mass / radius, 0.5 * mass * sigma * sigma
    has_field = lambda c: F.when(field > 0, c).otherwise(float("inf"))
    flux = mass / F.nullif(field * math.pi * radius * radius, F.lit(0.0)) / (0.53 / (3 * math.pi) * math.sqrt(5 / G))
    return {"mass": mass, "virial": 5 * sigma * sigma * size / (6 * G * mass), "t_ff": free_fall_time(dens), "mach": sigma / cs, "e_grav": grav, "e_turb": turb,
            "e_rot": 0.2 * mass * omega * omega * radius * radius, "e_mag": field * field * volume / (8 * math.pi), "v_alf": valf,
            "mach_alf": has_field(sigma / F.nullif(valf, F.lit(0.0))), "beta": has_field(2 * cs * cs / F.nullif(valf * valf, F.lit(0.0))), "mass_to_flux": has_field(flux)}


def ease(t: Column, kind: str) -> Column:
    """Easing curves on 0 to 1: in_out_quad, in_quad, out_quad, in_out_back."""
    if kind == "in_quad":
        return t * t
    if kind == "out_quad":
        return t * (2 - t)
    if kind == "in_out_quad":
        return F.when(t < 0.5, 2 * t * t).otherwise((4 - 2 * t) * t - 1)
    s = 1.70158 * 1.525
    u, v = 2 * t, 2 * t - 2
    return F.when(t < 0.5, u * u * ((s + 1) * u - s) / 2).otherwise((v * v * ((s + 1) * v + s) + 2) / 2)


def eased_frames(spark, frames: int, kind: str, begin: dict[str, float], end: dict[str, float], every: int = 1):
    """frame and each value on its way from begin to end; the first frame has begin, the last one end."""
    share = ease(F.col("frame") / float(max(frames - 1, 1)), kind)
    return spark.range(0, frames, every).withColumnRenamed("id", "frame").select("frame", *((begin[c] + (end[c] - begin[c]) * share).alias(c) for c in begin))


def outflow_mass_shape(r: Column, theta: Column, radius: float, opening: float, model: int = 1) -> Column:
    """The share of an outflow's mass by distance and angle from its axis."""
    if model == 0:
        return F.lit(0.0)
    if model == 1:
        return F.sin(r / radius * math.pi) * F.cos(theta / opening * (math.pi / 2))
    return F.cos(r / radius * (math.pi / 2)) if model == 2 else F.lit(1.0)


def outflow_velocity_shape(theta: Column, opening: float) -> Column:
    """A wide and a narrow jet, a quarter and three quarters."""
    cone = lambda width: F.when(F.abs(theta) <= width, F.cos(theta / width * (math.pi / 2))).otherwise(0.0)
    return 0.25 * cone(opening) + 0.75 * cone(opening / 6)


def ramp(age: Column, time: float) -> Column:
    """Outflow and heating set in linearly over a time."""
    return F.when(age < time, age / time).otherwise(1.0)


def cluster_luminosity(mass: Column, sun: float = 1.989e33, light: float = 3.828e33) -> tuple[Column, Column]:
    """Far ultraviolet light (erg/s) and ionising photons (1/s) of a star cluster by its mass in g."""
    chi6 = F.pow(F.log10(mass / sun), F.lit(6.0))
    return F.pow(F.lit(10.0), 2.98 * chi6 / (29.0 + chi6)) * (mass / sun) * light, F.pow(F.lit(10.0), 46.7 * chi6 / (7.28 + chi6)) * (mass / sun)


def factors(n: int) -> list[int]:
    """Prime factors, smallest first."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def sink_scales(length: Column, level: Column, cells: Column, cs: Column) -> dict[str, Column]:
    """Effective resolution, cell size, sink and outflow radius, and the Jeans density at the sink radius."""
    n = cells * F.pow(F.lit(2.0), level - 1)
    dx = length / n
    r = 2.5 * dx
    dens = math.pi * cs * cs / (4 * G * r * r)
    return {"n_eff": n, "dx": dx, "r_sink": r, "r_outflow": 16 * dx, "sink_dens": dens, "sink_mass": dens * 4 / 3 * math.pi * F.pow(r, F.lit(3.0))}
