"""Pair statistics and particle searches; pairs meet on bucket keys or lags, never in a cross join."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def structure_function(cells: DataFrame, v: tuple[str, str, str], n: int, lags: list[tuple[int, int, int]], orders: int = 4) -> DataFrame:
    """lag length squared, pairs, and for each order the mean longitudinal and transverse |increment| on a periodic grid.

    For each lag vector (a given, finite list) cells meet the cells a lag away in one equi-join on the shifted index.
    """
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in lags)))
    left = cells.withColumn("lag", step).select(*(F.pmod(F.col(x) + F.col(f"lag.{s}"), F.lit(n)).cast("long").alias(x) for x, s in zip("ijk", "abc")), "lag", *(F.col(c).alias(f"l_{c}") for c in v))
    both = left.join(cells.select("i", "j", "k", *v), ["i", "j", "k"])
    d = [F.col(c) - F.col(f"l_{c}") for c in v]
    r2 = F.col("lag.a") * F.col("lag.a") + F.col("lag.b") * F.col("lag.b") + F.col("lag.c") * F.col("lag.c")
    along = (d[0] * F.col("lag.a") + d[1] * F.col("lag.b") + d[2] * F.col("lag.c")) / F.sqrt(r2)
    square = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    across = F.sqrt(F.greatest(F.lit(0.0), square - along * along))
    rows = both.select(r2.cast("long").alias("r2"), F.abs(along).alias("long"), across.alias("trans"))
    means = [F.avg(F.pow(c, F.lit(float(p)))).alias(f"sf{p}_{c}") for p in range(1, orders + 1) for c in ("long", "trans")]
    return rows.groupBy("r2").agg(F.count("*").alias("n"), *means)


def lags_within(n: int, most: float, share: float = 1.0, seed: int = 5) -> list[tuple[int, int, int]]:
    """The lag vectors of a periodic grid of n cells a side up to a length in cells, nearest images only. With a share below 1 a lag is
    taken with a chance that falls with the square of its length, by a hash, so a rerun takes the same."""
    half, reach, out = n // 2, int(most), []
    side = range(max(-reach, -half + 1 - n % 2), min(reach, half) + 1)
    for a in side:
        for b in side:
            for c in side:
                r2 = a * a + b * b + c * c
                if 0 < r2 <= most * most and (share >= 1 or zlib.crc32(f"{seed}:{a}:{b}:{c}".encode()) / 2**32 < min(1.0, share * most * most / r2)):
                    out.append((a, b, c))
    return out


def told_increments(named: dict[str, list[str]], unit: list[Column], kind: str = "sf", absolute: bool = False, special: dict | None = None) -> Column:
    """An array of type, long, trans for pairs of points: columns l_<name> are the first one's, <name> the second one's, unit points from one to the other."""
    first, second = (lambda v: F.col(f"l_{v}")), (lambda v: F.col(v))

    def split(vector: list[Column]) -> tuple[Column, Column]:
        full = [*vector, *[F.lit(0.0)] * (3 - len(vector))]
        along = full[0] * unit[0] + full[1] * unit[1] + full[2] * unit[2]
        across = F.sqrt(F.greatest(F.lit(0.0), full[0] * full[0] + full[1] * full[1] + full[2] * full[2] - along * along))
        flat = (full[1] == 0) & (full[2] == 0)
        return F.when(flat, full[0]).otherwise(along), F.when(flat, 0.0).otherwise(across)

    parts: dict[str, tuple[Column, Column]] = {}
    for name, names in named.items():
        if kind == "sf":
            parts[name] = split([second(c) - first(c) for c in names])
        else:
            one, two = ([f(c) for c in names] + [F.lit(0.0)] * (3 - len(names)) for f in (first, second))
            dot = one[0] * two[0] + one[1] * two[1] + one[2] * two[2]
            along = (one[0] * unit[0] + one[1] * unit[1] + one[2] * unit[2]) * (two[0] * unit[0] + two[1] * unit[1] + two[2] * unit[2])
            flat = (one[1] == 0) & (one[2] == 0) & (two[1] == 0) & (two[2] == 0)
            parts[name] = (F.when(flat, one[0] * two[0]).otherwise(along), F.when(flat, 0.0).otherwise(dot - along))
    for name, f in (special or {}).items():
        parts[name] = split(list(f(first, second)))
    return F.array(*(F.struct(F.lit(name).alias("type"), (F.abs(a) if absolute else a).alias("long"), (F.abs(b) if absolute else b).alias("trans")) for name, (a, b) in parts.items()))


def pair_statistics(cells: DataFrame, fields: dict[str, tuple[Column, ...]], n: int, lags: list[tuple[int, int, int]], orders: int = 4, kind: str = "sf",
                    absolute: bool = False, special: dict | None = None) -> DataFrame:
    """type, bin, n, and for each order the means of the longitudinal and the transverse part of each field's increment (kind sf) or, at
    order 1, of its product (kind cf), over all pairs at given lags on a periodic uniform grid.

    A bin holds lengths from bin to bin + 1 cells. Increments keep their sign (the transverse part has none) unless absolute. Fields of one
    component, and increments along x alone, have no transverse part. special: name -> function of two getters (first and second point)
    that gives the increment itself. Cells meet the cells a lag away in one equi-join on the shifted index; lags are a finite list.
    """
    columns = sorted({c for c in cells.columns if c not in "ijk"})
    named = {name: [f"{name}_{x}" for x in range(len(parts))] for name, parts in fields.items()}
    base = cells.select("i", "j", "k", *columns, *(c.alias(f"{name}_{x}") for name, parts in fields.items() for x, c in enumerate(parts)))
    values = [c for c in base.columns if c not in ("i", "j", "k")]
    table = base.sparkSession.createDataFrame([(*lag, math.sqrt(sum(x * x for x in lag))) for lag in lags], "a int, b int, c int, r double")
    left = base.crossJoin(F.broadcast(table)).select(*(F.pmod(F.col(x) + F.col(s), F.lit(n)).cast("long").alias(x) for x, s in zip("ijk", "abc")), "a", "b", "c", "r", *(F.col(v).alias(f"l_{v}") for v in values))
    both = left.join(base.select(*(F.col(x).cast("long").alias(x) for x in "ijk"), *values), ["i", "j", "k"])
    told = told_increments(named, [F.col(x) / F.col("r") for x in "abc"], kind, absolute, special)
    rows = both.select(F.floor(F.col("r") + 1e-9).cast("long").alias("bin"), F.explode(told).alias("x")).select("bin", "x.*")
    means = [F.avg(F.pow(c, F.lit(float(p)))).alias(f"{kind}{p}_{c}") for p in range(1, (orders if kind == "sf" else 1) + 1) for c in ("long", "trans")]
    return rows.groupBy("type", "bin").agg(F.count("*").alias("n"), *means)


def energy_flux(v: tuple[str, str, str], dens: str = "dens"):
    """The increment whose divergence balances dissipation in isothermal compressible turbulence (sound speed 1), for pair_statistics."""
    def of(first, second):
        r, s = first(dens), second(dens)
        du = [second(c) - first(c) for c in v]
        dm = [s * second(c) - r * first(c) for c in v]
        bracket = 0.5 * (dm[0] * du[0] + dm[1] * du[1] + dm[2] * du[2]) + (s - r) * (F.ln(s) - F.ln(r)) - 0.5 * (r + s)
        mean = 0.5 * (F.ln(r) + F.ln(s))
        return [bracket * a + mean * b for a, b in zip(du, dm)]

    return of


def energy_source(v: tuple[str, str, str], div: str = "divv", dens: str = "dens"):
    """The source term that goes with energy_flux, a scalar."""
    def of(first, second):
        def energy(at, other):  # of a point, and with the velocity and the heat of the other one
            u, w = [at(c) for c in v], [other(c) for c in v]
            square, product = u[0] * u[0] + u[1] * u[1] + u[2] * u[2], u[0] * w[0] + u[1] * w[1] + u[2] * w[2]
            return at(dens) * (0.5 * square + F.ln(at(dens))), at(dens) * (0.5 * product + F.ln(other(dens)))

        (e, r), (e2, r2) = energy(first, second), energy(second, first)
        return [second(div) * (r - e) + first(div) * (r2 - e2)]

    return of


def squared_times(v: tuple[str, str, str], names: tuple[str, ...]):
    """Velocity increments times the squared increment of other variables."""
    def of(first, second):
        square = sum(((second(c) - first(c)) * (second(c) - first(c)) for c in names), F.lit(0.0))
        return [square * (second(c) - first(c)) for c in v]

    return of


def within(a: DataFrame, b: DataFrame, radius: float, names=("x", "y", "z")) -> DataFrame:
    """Pairs of a and b (tag and coordinates each, as a_ and b_ columns) within a radius, by buckets of that size."""
    def bucketed(df, p):
        return df.select(F.col("tag").alias(f"{p}tag"), *(F.col(c).alias(f"{p}{c}") for c in df.columns if c != "tag"))

    left, right = bucketed(a, "a_"), bucketed(b, "b_")
    for c in names:
        left = left.withColumn(f"q{c}", F.floor(F.col(f"a_{c}") / radius).cast("long"))
        near = F.floor(F.col(f"b_{c}") / radius).cast("long")
        right = right.withColumn(f"q{c}", F.explode(F.sequence(near - 1, near + 1)))
    met = left.join(right, [f"q{c}" for c in names])
    r2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names), F.lit(0.0))
    return met.withColumn("r", F.sqrt(r2)).where(F.col("r") <= radius).drop(*(f"q{c}" for c in names))


def most_bound(pairs: DataFrame, energy) -> DataFrame:
    """For each a the b of the lowest energy."""
    return pairs.groupBy("a_tag").agg(F.min(F.struct(energy.alias("e"), F.col("b_tag"))).alias("m")).select("a_tag", F.col("m.b_tag").alias("b_tag"), F.col("m.e").alias("energy"))
