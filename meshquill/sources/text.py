"""Text sources and sinks: evolution tables, logs, file kinds; and merging of split files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans


MARKER = "# simulation restarted"


def numbered(lines: DataFrame) -> DataFrame:
    """file, line_no (from 0 in each file) and value of spark.read.text()'s lines: counts of each piece of a file are summed up, no file is one task."""
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("mq_start"), F.monotonically_increasing_id().alias("mq_id"))
    pieces = rows.groupBy("file", "mq_start").agg(F.min("mq_id").alias("mq_low"), F.count("*").alias("mq_n"))
    before = Window.partitionBy("file").orderBy("mq_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "mq_start", "mq_low", F.coalesce(F.sum("mq_n").over(before), F.lit(0)).alias("mq_before"))  # a row for each piece
    out = rows.join(pieces, ["file", "mq_start"])
    return out.select("file", (F.col("mq_before") + F.col("mq_id") - F.col("mq_low")).alias("line_no"), "value")


def parse_series(lines: DataFrame, names: list[str], order: str = "line_no", text: str = "value", key: tuple[str, ...] = ()) -> DataFrame:
    """key, order and a double column for each name; fields beyond these are left out. Lines that are not numbers are dropped, and the line
    after a restart marker if its time is 0 (it meets the marker by its number less one)."""
    trimmed = F.trim(F.col(text))
    marked = lines.where(trimmed == MARKER).select(*key, (F.col(order) + 1).alias(order), F.lit(True).alias("mq_after"))
    parts = F.split(trimmed, r"\s+")
    rows = lines.select(*key, order, *(F.get(parts, k).try_cast("double").alias(c) for k, c in enumerate(names)))
    rows = rows.join(marked, [*key, order], "left")
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull()
    return rows.where(good & ~(F.coalesce("mq_after", F.lit(False)) & (F.col(names[0]) == 0))).select(*key, order, *names)


def column_of(header: list[str], wanted: str | int) -> int:
    """The place of a column by number, by a number as text, or by the one name that holds the text."""
    if isinstance(wanted, int) or wanted.isnumeric():
        return int(wanted)
    found = [i for i, name in enumerate(header) if wanted in name]
    if len(found) != 1:
        raise ValueError(f"no or no single column for {wanted!r}: {[header[i] for i in found]}")
    return found[0]


def read_series(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Files of evolution tables as rows of file, line_no and their columns; names default to the first file's first line."""
    lines = numbered(spark.read.text(path))
    if names is None:
        names = lines.where("line_no = 0").orderBy("file").first()["value"].split()
    return parse_series(lines, names, key=("file",))


def format_series(df: DataFrame, names: list[str]) -> DataFrame:
    """One text column of 24-character fields."""
    return df.select(F.concat(*(F.format_string(" %23.16E", F.col(c)) for c in names)).alias("value"))


def format_header(names: list[str]) -> str:
    """A header line of 24-character fields."""
    return "".join(f" {n[:23]:>23}" for n in names)[1:]


def parse_log(lines: DataFrame, order: str = "line_no", text: str = "value", key: tuple[str, ...] = ()) -> DataFrame:
    """key, run, n, t, dt, ts, n_procs, cells (in a block) and the least and largest number of leaf blocks of each step line.

    A header line begins a run. Tasks and zones hold for their run, the leaf blocks last seen in the file for what follows (1 before
    any), those that follow a step still for it, up to the next step. Counts and values last seen are carried from range to range of a
    file's lines, and what holds for a run or a step is summed by it first, so a long file is shared by tasks.
    """
    t = F.col(text)
    step = r"\[\s*(\S+\s+\S+)\s*\]\s+step:\s+n=(\d+)\s+t=(\S+)\s+dt=(\S+)"
    zone = r"Number ([xyz]) zones:\s*(\d+)\s*$"
    leaf = r"min leaf blks\s+(\d+)\s+max leaf blks\s+(\d+)"
    get = lambda pattern, k: F.regexp_extract(t, pattern, k)
    number = lambda pattern, k: F.when(t.rlike(pattern), get(pattern, k).cast("long"))
    is_step, keys = t.rlike(step), list(key)
    rows = lines.select(*keys, order, F.when(is_step, t).alias("mq_text"), is_step.alias("mq_is_step"), t.contains("log file:").alias("mq_header"), number(r"Number of MPI tasks:\s*(\d+)\s*$", 1).alias("mq_tasks"),
                        number(zone, 2).alias("mq_zone"), number(leaf, 1).alias("mq_low"), number(leaf, 2).alias("mq_high"))
    rows = rows.where(F.coalesce("mq_is_step", F.lit(False)) | F.coalesce("mq_header", F.lit(False)) | F.coalesce("mq_tasks", "mq_zone", "mq_low", "mq_high").isNotNull())
    rows = scans.scanned(rows, keys, order, {"run": F.col("mq_header"), "mq_step": F.col("mq_is_step")}, ["mq_low", "mq_high"], 1)

    def met(steps: DataFrame, told: DataFrame, by: str) -> DataFrame:
        told = told.withColumnsRenamed({c: f"mq_told_{c}" for c in [*keys, by]})
        same = F.col(by) == F.col(f"mq_told_{by}")
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"mq_told_{c}"))
        return steps.join(told, same).drop(*(f"mq_told_{c}" for c in [*keys, by]))

    of_run = rows.groupBy(*keys, "run").agg(F.max("mq_tasks").alias("n_procs"), F.round(F.exp(F.sum(F.log(F.col("mq_zone"))))).cast("long").alias("cells"))
    of_step = rows.groupBy(*keys, "mq_step").agg(F.max(F.struct(order, "mq_low", "mq_high")).alias("mq_last"))
    rows = met(met(rows.where("mq_is_step").select(*keys, order, "run", "mq_step", F.col("mq_text").alias(text)), of_run, "run"), of_step, "mq_step")
    stamp = F.to_timestamp(F.regexp_replace(get(step, 1), r"\s+", " "), "MM-dd-yyyy HH:mm:ss.SSS")
    return rows.select(*keys, "run", get(step, 2).cast("long").alias("n"), get(step, 3).cast("double").alias("t"), get(step, 4).cast("double").alias("dt"), stamp.alias("ts"), "n_procs", "cells", F.col("mq_last.mq_low").alias("min_leaf"), F.col("mq_last.mq_high").alias("max_leaf"))


def file_kind(path: Column) -> Column:
    return (F.when(path.rlike("_(slice|proj)_[^/]*$"), "map").when(path.rlike("_hdf5_plt_cnt_[0-9]{4}$"), "plt").when(path.rlike("_hdf5_chk_[0-9]{4}$"), "chk").when(path.rlike("_hdf5_part_[0-9]{4}$"), "part").when(path.rlike("_extracted"), "extracted").otherwise("other"))


def merge_split(parts: DataFrame, key: list[str], leaf: str, order: str) -> DataFrame:
    """One row a block: from the part in which it is a leaf, else the first part."""
    w = Window.partitionBy(*key).orderBy(F.desc(leaf), order)
    return parts.withColumn("mq_pick", F.row_number().over(w)).where("mq_pick = 1").drop("mq_pick")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, with repeats."""
    b = b.select(*a.columns)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def joined(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, columns by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
