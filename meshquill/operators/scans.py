"""Ordered scans over long groups in two levels: by ranges of rows, then over one row a range.

A window over a whole group puts the group into one task. Here rows are dealt out by ranges of key and order, so a long group is shared by
many tasks. Each range is summed up by key (a minimum, a count, a value last seen); what other ranges hand over to it is
worked out on these sums, of which there are about as many as ranges and keys; and rows are scanned within their range. Ranges must be
the same for the sums and the scan, so they are fixed by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import cut_lineage

#: Rows that a range has at most (about), and at least where that leaves tasks without one.
MOST, LEAST = 100_000, 10_000


def ranged(rows: DataFrame, key: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """rows with mq_range, which grows with key and order; rows of one key and order are in one range.

    If their number is not given, there are so many ranges that each has about MOST rows at most, however many rows there are.
    """
    if not ranges:
        n = rows.select(*key, order).count()
        ranges = max(1, -(-n // MOST), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    dealt = rows.repartitionByRange(ranges, *key, order)
    return cut_lineage(dealt.withColumn("mq_range", F.spark_partition_id()))


def handed_over(parts: DataFrame, key: list[str], sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """parts with what carry makes, over the sums of a key's ranges, of the sums of other ranges."""
    told = parts.groupBy(*key, "mq_range").agg(*(c.alias(name) for name, c in sums.items()))
    told = told.withColumns(carry).drop(*sums)
    same = F.col("mq_range") == F.col("mq_told_range")
    for c in key:  # a null key is a key
        same = same & F.col(c).eqNullSafe(F.col(f"mq_told_{c}"))
    told = told.withColumnsRenamed({c: f"mq_told_{c}" for c in key} | {"mq_range": "mq_told_range"})
    return parts.join(told, same, "left").drop("mq_told_range", *(f"mq_told_{c}" for c in key))


def earlier(key: list[str]):
    return Window.partitionBy(*key).orderBy("mq_range").rowsBetween(Window.unboundedPreceding, -1)


def later(key: list[str]):
    return Window.partitionBy(*key).orderBy("mq_range").rowsBetween(1, Window.unboundedFollowing)


def before_later(rows: DataFrame, key: list[str], order: str, value: str, ranges: int | None = None) -> DataFrame:
    """The rows whose value is below the least value of all later rows of the key."""
    parts = handed_over(ranged(rows, key, order, ranges), key, {"mq_min": F.min(value)}, {"mq_after": F.min("mq_min").over(later(key))})
    within = Window.partitionBy(*key, "mq_range").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    out = parts.withColumn("mq_next", F.least(F.min(value).over(within), F.col("mq_after")))
    return out.where(F.col("mq_next").isNull() | (F.col(value) < F.col("mq_next"))).drop("mq_next", "mq_after", "mq_range")


def scanned(rows: DataFrame, key: list[str], order: str, counts: dict[str, Column] | None = None, seen: list[str] | None = None, default: int | None = None, ranges: int | None = None) -> DataFrame:
    """rows with running counts (this row included) of what conditions hold for, and columns' values last seen in the key; one pass for all."""
    counts, seen = counts or {}, seen or []
    marks = {f"mq_mark_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in counts.items()}
    sums = {f"mq_sum_{n}": F.sum(f"mq_mark_{n}") for n in counts}
    sums |= {f"mq_last_{c}": F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))) for c in seen}
    carry = {f"mq_before_{n}": F.coalesce(F.sum(f"mq_sum_{n}").over(earlier(key)), F.lit(0)) for n in counts}
    carry |= {f"mq_in_{c}": F.last(f"mq_last_{c}", ignorenulls=True).over(earlier(key))["v"] for c in seen}
    parts = handed_over(ranged(rows.withColumns(marks), key, order, ranges), key, sums, carry)
    within = Window.partitionBy(*key, "mq_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    new = {n: F.sum(f"mq_mark_{n}").over(within) + F.col(f"mq_before_{n}") for n in counts}
    new |= {c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"mq_in_{c}"), *([] if default is None else [F.lit(default)])) for c in seen}
    return parts.withColumns(new).drop("mq_range", *marks, *carry)


def running_count(rows: DataFrame, key: list[str], order: str, names: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """rows with a running count (this row included) of what each condition holds for."""
    return scanned(rows, key, order, counts=names, ranges=ranges)


def last_seen(rows: DataFrame, key: list[str], order: str, names: list[str], default: int | None = None, ranges: int | None = None) -> DataFrame:
    """rows with each column's value last seen in the key, this row included; the default before any."""
    return scanned(rows, key, order, seen=names, default=default, ranges=ranges)
