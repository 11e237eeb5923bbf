"""Weighted statistics, PDFs, profiles and binned statistics: one grouped pass, then small windows over bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(value: Column, weight: Column) -> tuple[Column, Column]:
    """Weighted mean and population deviation."""
    norm = F.sum(weight)
    mean = F.sum(value * weight) / norm
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.sum(value * value * weight) / norm - mean * mean))


def extremes(cells: DataFrame, value: str, at: list[str]) -> DataFrame:
    """Minimum and maximum with their place; on ties the first in the order of the place."""
    place = F.struct(*at)
    low, high = F.min(F.struct(F.col(value), place)), F.min(F.struct(-F.col(value), place))
    out = cells.agg(low.alias("lo"), high.alias("hi"))
    names = [F.col(f"{e}.col2.{c}").alias(f"{n}_{c}") for e, n in (("lo", "min"), ("hi", "max")) for c in at]
    return out.select(F.col(f"lo.{value}").alias("min_value"), (-F.col("hi.col1")).alias("max_value"), *names)


def linear_bin(x: Column, low: float, width: float) -> Column:
    """1 + the truncated distance from low in widths: values up to a width below low are in bin 1 too."""
    return ((x - low) / width).cast("long") + 1


def pdf(cells: DataFrame, x: Column, weight: Column, low: float, high: float, width: float, log: bool = False, key: tuple[str, ...] = ()) -> DataFrame:
    """key, bin, x (centre), n, pdf, cdf over bins that have cells, for each key in one pass; bins are in x, or in log10 x."""
    v = F.log10(x) if log else x
    kept = cells.where((v > low - width) & (v < high)).select(*key, linear_bin(v, low, width).alias("bin"), weight.alias("w"))
    binned = kept.groupBy(*key, "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    total, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    centre = low + (F.col("bin") - 0.5) * width
    size = F.pow(F.lit(10.0), low + F.col("bin") * width) - F.pow(F.lit(10.0), low + (F.col("bin") - 1) * width) if log else F.lit(width)
    share = F.col("w") / F.sum("w").over(total)
    return binned.select(*key, "bin", (F.pow(F.lit(10.0), centre) if log else centre).alias("x"), "n", (share / size).alias("pdf"), (F.sum("w").over(upto) / F.sum("w").over(total)).alias("cdf"))


def pdf_moments(table: DataFrame, low: float, width: float, log: bool = False) -> DataFrame:
    """Mean, root mean square, deviation, skewness and excess kurtosis of a PDF table, each bin weighted by its own width."""
    size = F.pow(F.lit(10.0), low + F.col("bin") * width) - F.pow(F.lit(10.0), low + (F.col("bin") - 1) * width) if log else F.lit(width)
    raw = table.agg(*(F.sum(F.pow("x", F.lit(float(n))) * F.col("pdf") * size).alias(f"m{n}") for n in range(1, 5)))
    m, var = F.col("m1"), F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * m * m * m
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * m * m * m * m
    return raw.select(m.alias("mean"), F.sqrt("m2").alias("rms"), F.sqrt(var).alias("sigma"), (third / F.pow(var, F.lit(1.5))).alias("skew"), (fourth / (var * var) - 3).alias("kurt"))


def edges_of(kind: str, low: float, high: float, n: int, linear: float = 1.0) -> list[float]:
    """n edges, so n - 1 bins: evenly spaced (lin), evenly in the logarithm (log), or evenly in asinh(x / linear) (symlog)."""
    steps = [k / (n - 1) for k in range(n)]
    if kind == "lin":
        return [low + (high - low) * t for t in steps]
    if kind == "log" and low > 0:
        return [low * (high / low) ** t for t in steps]
    a, b = math.asinh(low / linear), math.asinh(high / linear)
    return [linear * math.sinh(a + (b - a) * t) for t in steps]


def edge_bin(x: Column, edges: list[float]) -> Column:
    """0-based bin among ascending edges, the last one closed; null outside. A lookup in one array, however many edges."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.size(F.filter(inner, lambda e: e <= x)).cast("long"))


def binned_statistic(cells: DataFrame, x: Column, y: Column, weight: Column, edges: list[float]) -> DataFrame:
    """bin, n, total, mean, std of y in the bins of x; rows out of range are dropped."""
    rows = cells.select(edge_bin(x, edges).alias("bin"), y.alias("y"), weight.alias("w")).where("bin is not null")
    mean, std = weighted(F.col("y"), F.col("w"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("w")).alias("total"), mean.alias("mean"), std.alias("std"))


def histogram2d(cells: DataFrame, x: Column, y: Column, weight: Column, width_x: float, width_y: float) -> DataFrame:
    return cells.groupBy(F.floor(x / width_x).cast("long").alias("bx"), F.floor(y / width_y).cast("long").alias("by")).agg(F.sum(weight).alias("w"))


def histogram_statistic(histogram: DataFrame, width_y: float) -> DataFrame:
    """Mean and deviation of y by x bin from the centres of a 2-D histogram."""
    mean, std = weighted((F.col("by") + 0.5) * width_y, F.col("w"))
    return histogram.groupBy("bx").agg(mean.alias("mean"), std.alias("std"))


def histogram_percentile(histogram: DataFrame, width_y: float, percent: float) -> DataFrame:
    """By x bin the centre of the largest y bin whose CDF is at most percent; x bins without one are dropped."""
    upto = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, 0)
    cdf = F.sum("w").over(upto) / F.sum("w").over(Window.partitionBy("bx"))
    return histogram.withColumn("cdf", cdf).where(F.col("cdf") <= percent / 100 + 1e-12).groupBy("bx").agg(((F.max("by") + 0.5) * width_y).alias("value"))


def radial_profile(cells: DataFrame, value: Column, weight: Column, r: Column, low: float, high: float, width: float, log: bool = False) -> DataFrame:
    """bin, n, mean, std, radius (centre) in bins of the radius or of its log10 (low and high are then log10 too)."""
    at = F.when(r > 0, F.log10(r)) if log else r
    rows = cells.select(at.alias("r"), value.alias("v"), weight.alias("w")).where((F.col("r") > low - width) & (F.col("r") < high))
    rows = rows.select(linear_bin(F.col("r"), low, width).alias("bin"), "v", "w")
    mean, std = weighted(F.col("v"), F.col("w"))
    centre = low + (F.col("bin") - 0.5) * width
    return rows.groupBy("bin").agg(F.count("*").alias("n"), mean.alias("mean"), std.alias("std")).withColumn("radius", F.pow(F.lit(10.0), centre) if log else centre)


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], slack: float = 2e-3) -> DataFrame:
    """key and a column for each share: exact percentiles with linear interpolation, without sorting a group in one task.

    A sketch gives bounds a little below and above each percentile; ranks are counted exactly for what is between them only. In groups so
    small that the bounds might be less than two ranks away they are the least and the largest value.
    """
    data = rows.select(*key, F.col(value).cast("double").alias("mq_v")).where("mq_v is not null")
    ask = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in shares.items()))
    ends = [x for q in shares.values() for x in (max(q - slack, 0.0), min(q + slack, 1.0))]
    sketch = data.groupBy(*key).agg(F.count("*").alias("mq_n"), F.min("mq_v").alias("mq_least"), F.max("mq_v").alias("mq_most"), F.percentile_approx("mq_v", ends, 10_000).alias("mq_ends"))
    sketch = sketch.select(*key, "mq_n", "mq_least", "mq_most", "mq_ends", F.posexplode(ask).alias("mq_k", "mq_ask"))
    few = F.col("mq_n") * slack < 4
    low, high = F.get("mq_ends", 2 * F.col("mq_k")), F.get("mq_ends", 2 * F.col("mq_k") + 1)
    sketch = sketch.select(*key, "mq_n", "mq_ask.name", "mq_ask.q", F.when((F.col("mq_ask.q") <= slack) | few, F.col("mq_least")).otherwise(low).alias("mq_low"), F.when((F.col("mq_ask.q") >= 1 - slack) | few, F.col("mq_most")).otherwise(high).alias("mq_high"))
    met = data.join(sketch, key) if key else data.crossJoin(F.broadcast(sketch))  # a row for each share
    name = [*key, "name"]
    below = met.where("mq_v < mq_low").groupBy(*name).agg(F.count("*").alias("mq_below"))
    near = met.where("mq_v between mq_low and mq_high").groupBy(*name, "mq_n", "q", "mq_v").agg(F.count("*").alias("mq_c"))
    upto = Window.partitionBy(*name).orderBy("mq_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("mq_end", F.sum("mq_c").over(upto)).join(below, name, "left")
    near = near.withColumn("mq_end", F.col("mq_end") + F.coalesce("mq_below", F.lit(0)))
    at = F.col("q") * (F.col("mq_n") - 1)
    holds = lambda rank: F.min(F.when(F.col("mq_end") > rank, F.col("mq_v")))
    found = near.groupBy(*name, "q", "mq_n").agg(holds(F.floor(at)).alias("a"), holds(F.ceil(at)).alias("b"))
    found = found.select(*key, "name", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("mq_p"))
    return found.groupBy(*key).agg(*(F.max(F.when(F.col("name") == n, F.col("mq_p"))).alias(n) for n in shares))


def regular_reductions(cells: DataFrame, value: str, volume: str) -> DataFrame:
    """Least, largest, sum and volume-weighted sum over the set cells (those that are not null) of a grid."""
    v = F.col(value)
    return cells.where(v.isNotNull()).agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.sum(v * F.col(volume)).alias("sum_vw"))


def mass_summary(particles: DataFrame, mass: str) -> DataFrame:
    m = F.col(mass)
    out = particles.agg(F.count("*").alias("n"), F.sum(m).alias("total"), F.min(m).alias("min"), F.max(m).alias("max"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"))
    return out.crossJoin(percentiles(particles, [], mass, {"median": 0.5})).select("n", "total", "min", "max", "median", "mean", "std")  # one row each


def refinement(blocks: DataFrame) -> DataFrame:
    """level, nblocks, fraction."""
    return blocks.groupBy("level").agg(F.count("*").alias("nblocks")).withColumn("fraction", F.col("nblocks") / F.sum("nblocks").over(Window.partitionBy()))
