"""Time series, restarts, logs, dumps and ensembles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def cleaned(series: DataFrame, order: str, time: str, key: list[str] | None = None) -> DataFrame:
    """Rows that no later row (by order) overwrites: time below the least of all later times, by key. A long series is shared by tasks."""
    return scans.before_later(series, key or [], order, time)


def runs(lines: DataFrame, order: str, is_header: Column, key: list[str]) -> DataFrame:
    """lines with run: the running count of header lines."""
    return scans.running_count(lines, key, order, {"run": is_header})


def step_durations(steps: DataFrame, key: list[str], n: str, ts: str) -> DataFrame:
    """Seconds to the next step of a run; the last step has none."""
    nxt = F.lead(ts).over(Window.partitionBy(*key).orderBy(n))
    return steps.withColumn("seconds", (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)


def time_moments(series: DataFrame, key: list[str], t: str, x: str) -> DataFrame:
    """Trapezoid-weighted mean and deviation over time."""
    w = Window.partitionBy(*key).orderBy(t)
    span = F.coalesce(F.lead(t).over(w) - F.col(t), F.lit(0.0)) + F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    rows = series.withColumn("w", span / 2)
    mean = F.sum(F.col(x) * F.col("w")) / F.sum("w")
    return rows.groupBy(*key).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(x) * F.col(x) * F.col("w")) / F.sum("w") - mean * mean)).alias("std"))


def nearest_dump(dumps: DataFrame, value: str, wanted: float, number: str) -> DataFrame:
    """The dump nearest to a value; of two as near the later one."""
    return dumps.orderBy(F.abs(F.col(value) - wanted), F.desc(number)).limit(1)


def interpolate(series: DataFrame, key: list[str], t: str, x: str, step: float) -> DataFrame:
    """Linear interpolation on multiples of step between neighbouring rows."""
    w = Window.partitionBy(*key).orderBy(t)
    rows = series.withColumns({"t1": F.lead(t).over(w), "x1": F.lead(x).over(w)}).where("t1 is not null")
    first, last = F.ceil(F.col(t) / step).cast("long"), F.ceil(F.col("t1") / step).cast("long") - 1
    rows = rows.where(first <= last).withColumn("s", F.explode(F.sequence(first, last)))
    share = (F.col("s") * step - F.col(t)) / (F.col("t1") - F.col(t))
    return rows.select(*key, (F.col("s") * step).alias("t"), (F.col(x) + share * (F.col("x1") - F.col(x))).alias("x"))


def in_window(series: DataFrame, t: str, start: float, end: float) -> DataFrame:
    """Rows from a time to another, both included."""
    return series.where(F.col(t).between(start, end))


def ranked(rows: DataFrame, by: list[str], ties: list[str], most: int) -> DataFrame:
    """The first rows by descending columns, ties by ascending ones, with their place (from 1); only these rows are numbered."""
    order = [*(F.desc(c) for c in by), *ties]
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def every_nth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first row, the n-th after it and so on, by ranks that are counts of range partitions and ranks within."""
    parts = rows.repartitionByRange(order).withColumn("mq_part", F.spark_partition_id())
    before = Window.orderBy("mq_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("mq_part").agg(F.count("*").alias("mq_n")).select("mq_part", F.coalesce(F.sum("mq_n").over(before), F.lit(0)).alias("mq_before"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("mq_part").orderBy(order)) + F.col("mq_before")
    return parts.join(F.broadcast(starts), "mq_part").withColumn("mq_rank", rank).where(F.col("mq_rank") % n == 1 % n).drop("mq_part", "mq_before", "mq_rank")


def first_and_last(steps: DataFrame, key: list[str], order: str, n: int = 3) -> DataFrame:
    """The first and the last n rows of each run."""
    up, down = (F.row_number().over(Window.partitionBy(*key).orderBy(o)) for o in (F.asc(order), F.desc(order)))
    return steps.withColumns({"mq_up": up, "mq_down": down}).where((F.col("mq_up") <= n) | (F.col("mq_down") <= n)).drop("mq_up", "mq_down")


def out_of_order(steps: DataFrame, key: list[str], n: str) -> DataFrame:
    """Steps whose number is not one more than that of the step before: durations of such runs mean nothing."""
    before = F.lag(n).over(Window.partitionBy(*key).orderBy(n))
    return steps.withColumn("mq_gap", F.col(n) - before).where("mq_gap <> 1").drop("mq_gap")


def misaligned(tables: DataFrame, bin_: str, file: str) -> DataFrame:
    """Bins that some of the files lack: averages need the same bins in all."""
    files = tables.agg(F.countDistinct(file).alias("mq_files"))
    return tables.groupBy(bin_).agg(F.countDistinct(file).alias("files")).crossJoin(F.broadcast(files)).where("files <> mq_files").drop("mq_files")  # one row


def ensemble_spectra(tables: DataFrame, bin_: str, value: str, total: str | None = None) -> DataFrame:
    """Mean and deviation over files of the log10 of spectra, each divided by its file's total where one is named."""
    v = F.log10(F.col(value) / F.col(total)) if total else F.log10(value)
    return tables.groupBy(bin_).agg(F.count("*").alias("files"), F.avg(v).alias("log_mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))).alias("log_sigma"))


def ensemble_log(tables: DataFrame, bin_: str, value: str) -> DataFrame:
    """The mean of logarithms, taken back to a value, and the deviation of the logarithms."""
    return ensemble_spectra(tables, bin_, value).select(bin_, "files", F.pow(F.lit(10.0), F.col("log_mean")).alias("mean"), "log_sigma")


def ensemble(tables: DataFrame, bin_: str, value: str, log: bool = False) -> DataFrame:
    """Mean and deviation over files by bin, of values or of their log10."""
    v = F.log10(value) if log else F.col(value)
    return tables.groupBy(bin_).agg(F.count("*").alias("files"), F.avg(v).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))).alias("sigma"))


def ensembles(tables: DataFrame, bin_: str, values: list[str]) -> DataFrame:
    """files, and mean and sigma over files of several values by bin, in one pass."""
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c)))
    return tables.groupBy(bin_).agg(F.count("*").alias("files"), *(F.avg(c).alias(c) for c in values), *(spread(c).alias(f"sigma_{c}") for c in values))


def carried(rows: DataFrame, key: list[str], order: str, names: list[str], default: int = 1) -> DataFrame:
    """Columns with the value last seen in a run; the default before any."""
    return scans.last_seen(rows, key, order, names, default)


def curvatures(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Second derivatives of the cubic spline whose first two and last two pieces are each one cubic (ascending t)."""
    h, n = np.diff(t), len(t)
    if n < 3:
        return np.zeros(n)
    rise = np.diff(np.diff(x) / h)
    if n == 3:
        return np.full(3, 2 * rise[0] / (h[0] + h[1]))
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    first, last = h[0] / h[1], h[-1] / h[-2]
    mid[0], up[0] = mid[0] + h[0] * (1 + first), up[0] - h[0] * first
    mid[-1], low[-1] = mid[-1] + h[-1] * (1 + last), low[-1] - h[-1] * last
    right = 6 * rise
    for i in range(1, n - 2):
        share = low[i] / mid[i - 1]
        mid[i] -= share * up[i - 1]
        right[i] -= share * right[i - 1]
    inner = np.zeros(n - 2)
    inner[-1] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        inner[i] = (right[i] - up[i] * inner[i + 1]) / mid[i]
    return np.concatenate([[inner[0] * (1 + first) - inner[1] * first], inner, [inner[-1] * (1 + last) - inner[-2] * last]])


def _piece(key: list[str], names: list[str]):
    """Solves one range's part of the tridiagonal system, all its keys in one sweep: y without neighbours, v and w per unit of the unknown before and
    after a key's rows in the range."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, "mq_pos"])
        low, mid, up = (pdf[c].to_numpy(copy=True) for c in ("mq_low", "mq_mid", "mq_up"))
        n = len(pdf)
        of = pdf.groupby(key, dropna=False, sort=False).ngroup().to_numpy() if key else np.zeros(n)
        first, last = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)
        right = np.column_stack([pdf["mq_rhs"], np.where(first, low, 0.0), np.where(last, up, 0.0)])
        low[first], up[last] = 0.0, 0.0
        for i in range(1, n):
            if low[i]:
                share = low[i] / mid[i - 1]
                mid[i] -= share * up[i - 1]
                right[i] -= share * right[i - 1]
        right[-1] /= mid[-1]
        for i in range(n - 2, -1, -1):
            right[i] = (right[i] - up[i] * right[i + 1]) / mid[i]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in names}, "mq_y": right[:, 0], "mq_v": right[:, 1], "mq_w": right[:, 2]})

    return work


def chained(v: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two unknowns of each range, where y is them plus v times the last one before and w times the first one behind: two sweeps over the ranges."""
    n, left, right = len(y), np.eye(2), []
    for p in range(n):
        block, rest = np.eye(2), y[p].copy()
        if p:
            got = np.linalg.solve(left, np.column_stack([[w[p - 1, 0], w[p - 1, 1]], right[-1][1]]))
            block[:, 0] -= v[p] * got[1, 0]
            rest -= v[p] * got[1, 1]
        left = block
        right.append((block, rest))
    out = np.zeros(2 * n)
    for p in range(n - 1, -1, -1):
        block, rest = right[p]
        out[2 * p : 2 * p + 2] = np.linalg.solve(block, rest - (w[p] * out[2 * p + 2] if p < n - 1 else 0.0))
    return out


def _joints(key: list[str]):
    """The unknowns before and after each range of a key, from the first and last row of its ranges: two equations a range."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mq_range", "mq_pos"])
        ranges = pdf["mq_range"].drop_duplicates().to_numpy()
        ends = pdf.groupby("mq_range", sort=True)[["mq_y", "mq_v", "mq_w"]].agg(["first", "last"])
        n, m = len(ranges), chained(*(np.column_stack([ends[c, "first"], ends[c, "last"]]) for c in ("mq_v", "mq_w", "mq_y")))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * n for c in key}, "mq_range": ranges, "mq_before": [m[2 * p - 1] if p else 0.0 for p in range(n)], "mq_behind": [m[2 * p + 2] if p < n - 1 else 0.0 for p in range(n)]})

    return work


def spline(series: DataFrame, key: list[str], t: str, x: str, points: int | None = None, ranges: int | None = None) -> DataFrame:
    """Each series by its cubic spline at so many evenly spaced times (as many as it has, if not given).

    The first two pieces are one cubic, and so are the last two. Times must differ within a series; null rows are ignored. A long series
    is shared by ranges of times: each range solves its part of the tridiagonal system for any values beyond its ends, a small system of two
    equations a range joins them, and values are worked out piece by piece.
    """
    clean = series.where(F.col(t).isNotNull() & F.col(x).isNotNull()).select(*key, F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"))
    parts = scans.ranged(clean, key, "t", ranges)
    row, whole = F.struct("t", "x"), Window.partitionBy(*key)
    sums = {"mq_first": F.min(row), "mq_last": F.max(row), "mq_n": F.count("*")}
    carry = {"mq_prev": F.last("mq_last").over(scans.earlier(key)), "mq_next": F.first("mq_first").over(scans.later(key)), "mq_start": F.coalesce(F.sum("mq_n").over(scans.earlier(key)), F.lit(0)),
             "mq_size": F.sum("mq_n").over(whole), "mq_from": F.min("mq_first").over(whole)["t"], "mq_to": F.max("mq_last").over(whole)["t"]}
    inside = Window.partitionBy(*key, "mq_range").orderBy("t")
    rows = scans.handed_over(parts, key, sums, carry)
    rows = rows.withColumns({"mq_prev": F.coalesce(F.lag(row).over(inside), "mq_prev"), "mq_next": F.coalesce(F.lead(row).over(inside), "mq_next"), "mq_pos": F.col("mq_start") + F.row_number().over(inside) - 1})
    h0, h1, pos, size = F.col("t") - F.col("mq_prev.t"), F.col("mq_next.t") - F.col("t"), F.col("mq_pos"), F.col("mq_size")
    rise = (F.col("mq_next.x") - F.col("x")) / h1 - (F.col("x") - F.col("mq_prev.x")) / h0
    first, last = (pos == 1).cast("int"), (pos == size - 2).cast("int")
    three = size == 3
    system = {"mq_low": F.when(first == 1, 0.0).otherwise(h0 - last * h1 * h1 / h0), "mq_up": F.when(last == 1, 0.0).otherwise(h1 - first * h0 * h0 / h1),
              "mq_mid": F.when(three, h0 + h1).otherwise(2 * (h0 + h1) + first * h0 * (1 + h0 / h1) + last * h1 * (1 + h1 / h0)), "mq_rhs": F.when(three, 2 * rise).otherwise(6 * rise)}
    inner = rows.where((pos > 0) & (pos < size - 1)).select(*key, "mq_range", "mq_pos", "t", "x", "mq_prev", "mq_next", "mq_size", "mq_from", "mq_to", *(c.alias(n) for n, c in system.items()))
    named = [*key, "mq_range", "mq_pos"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*named).schema)
    solved = scans.cut_lineage(inner.select(*named, *system).groupBy("mq_range").applyInPandas(_piece(key, named), f"{kind}, mq_y double, mq_v double, mq_w double"))
    at_ends = Window.partitionBy(*key, "mq_range")
    ends = solved.withColumns({"mq_lo": F.min("mq_pos").over(at_ends), "mq_hi": F.max("mq_pos").over(at_ends)}).where("mq_pos = mq_lo or mq_pos = mq_hi")
    several = F.min("mq_range").over(whole) < F.max("mq_range").over(whole)
    ends = ends.withColumn("mq_several", several).where("mq_several").drop("mq_several")  # a key of one range has nothing to join
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*key, "mq_range").schema)
    joints = ends.groupBy(*key).applyInPandas(_joints(key), f"{kind}, mq_before double, mq_behind double")

    def met(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({c: f"mq_r_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"mq_r_{c}"))
        return left.join(right, same, how).drop(*(f"mq_r_{c}" for c in by))

    before, behind = (F.coalesce(c, F.lit(0.0)) for c in ("mq_before", "mq_behind"))
    bent = met(solved, joints, [*key, "mq_range"], "left").select(*named, (F.col("mq_y") - F.col("mq_v") * before - F.col("mq_w") * behind).alias("m"))
    bent = met(inner.drop(*system), bent, named)
    state = F.struct("mq_pos", "m")
    bent = scans.handed_over(bent, key, {"mq_low_m": F.min(state)}, {"mq_after": F.first("mq_low_m").over(scans.later(key))["m"]})
    bent = bent.withColumn("mq_after", F.coalesce(F.lead("m").over(Window.partitionBy(*key, "mq_range").orderBy("mq_pos")), "mq_after"))
    # a piece goes from an inner row to the next one; the first begins at the series' start, the last ends at its end
    piece = lambda a, b, ma, mb, low, high: F.struct(F.col(f"{a[0]}").alias("t0"), F.col(f"{a[1]}").alias("x0"), F.col(f"{b[0]}").alias("t1"), F.col(f"{b[1]}").alias("x1"), ma.alias("m0"), mb.alias("m1"), low.alias("low"), high.alias("high"))
    here, there, back = ("t", "x"), ("mq_next.t", "mq_next.x"), ("mq_prev.t", "mq_prev.x")
    m, start, end = F.col("m"), F.col("mq_from"), F.col("mq_to")
    usual = piece(here, there, m, F.col("mq_after"), F.when(pos == 1, start).otherwise(F.col("t")), F.when(pos == size - 3, end).otherwise(F.col("mq_next.t")))
    pieces = F.when(three, F.array(piece(back, here, m, m, start, F.col("t")), piece(here, there, m, m, F.col("t"), end))).when(pos < size - 2, F.array(usual))
    short = rows.where((size < 3) & (pos == 0))  # one or two rows: no curvature
    flat = F.array(F.struct(F.col("t").alias("t0"), F.col("x").alias("x0"), F.coalesce("mq_next.t", F.col("t") + 1).alias("t1"), F.coalesce("mq_next.x", "x").alias("x1"), F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1"), start.alias("low"), end.alias("high")))
    cut = bent.select(*key, "mq_size", "mq_from", "mq_to", F.explode(pieces).alias("p")).unionAll(short.select(*key, "mq_size", "mq_from", "mq_to", F.explode(flat).alias("p")))
    many = F.lit(points).cast("long") if points else F.col("mq_size")
    step = F.when(many > 1, (F.col("mq_to") - F.col("mq_from")) / (many - 1)).otherwise(0.0)
    number = lambda c: F.when(step > 0, F.ceil((c - F.col("mq_from")) / step)).otherwise(0).cast("long")
    to = F.when(F.col("p.high") == F.col("mq_to"), many - 1).otherwise(number(F.col("p.high")) - 1)
    begin = F.when(F.col("p.low") == F.col("mq_from"), F.lit(0)).otherwise(number(F.col("p.low"))).cast("long")
    at = cut.withColumns({"mq_a": begin, "mq_b": to.cast("long")}).where("mq_a <= mq_b").withColumn("mq_j", F.explode(F.sequence("mq_a", "mq_b"))).withColumn("mq_t", F.col("mq_from") + F.col("mq_j") * step)
    h, u, v = F.col("p.t1") - F.col("p.t0"), F.col("p.t1") - F.col("mq_t"), F.col("mq_t") - F.col("p.t0")
    value = (F.col("p.m0") * u * u * u + F.col("p.m1") * v * v * v) / (6 * h) + (F.col("p.x0") / h - F.col("p.m0") * h / 6) * u + (F.col("p.x1") / h - F.col("p.m1") * h / 6) * v
    return at.select(*key, F.col("mq_t").alias("t"), value.alias("x"))


def find_dump(dumps: DataFrame, number: str, numbers: list[int], value: Column, wanted: float) -> tuple[int, float]:
    """The dump (number, value) whose value is nearest to the wanted one, where values grow with the number; of two as near the later one.

    dumps is laid out in folders by number; each step reads one dump's folder alone, so a search reads about log2 of their number. numbers:
    those there are (spark.read knows them by the folders' names). A dump without rows or with a null value counts as value 0.
    """
    numbers, seen = sorted(set(numbers)), {}
    if not numbers:
        raise ValueError("there are no dumps")

    def at(k: int) -> float:
        if k not in seen:
            got = dumps.where(F.col(number) == numbers[k]).agg(value.cast("double")).first()[0]
            seen[k] = 0.0 if got is None else got
        return seen[k]

    low, high = 0, len(numbers) - 1
    while high - low > 1:
        middle = low + (high - low + 1) // 2
        low, high = (low, middle) if wanted <= at(middle) else (middle, high)
    best = low if abs(at(low) - wanted) < abs(at(high) - wanted) else high
    return numbers[best], at(best)


def folders(spark, path: str, number: str) -> list[int]:
    """The numbers of a table's folders ``number=...``, by their names: no file is opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(int(n.split("=", 1)[1]) for n in (f.getPath().getName() for f in found) if n.startswith(f"{number}="))
