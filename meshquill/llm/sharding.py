"""Sharding by a hypergeometric communication matrix (law ``rows``: shard sizes differ by one row at most).

1. Rows are dealt into logical partitions by a hash of the id and of the row's place in what was written, so copies of a row go to
   many partitions, and counted (at most MAX_PARTITIONS counts reach the driver).
2. The matrix of partition-to-shard counts is drawn: row by row, and within a row shard by shard, from the hypergeometric law
   of what is still free in the shards. Its row sums are the partition counts and its column sums the shard sizes, exactly.
3. Each partition is permuted locally and cut along its row of the matrix: that is a uniform choice of shard for every row.
4. After the exchange each shard is permuted again: slots are ranks by another hash, as a sum of bucket counts and a rank
   within a small bucket, so no task holds a shard.

All random numbers come from the seed, and all orders are hashes of the row and of its number, which is written with it before
anything depends on it, so a lost task is redone alike. Partitions and buckets grow in number with the rows.
Nulls: a null text has size 1 and crc 0; null ids hash like any value. Repeated rows are equal and take different slots. Extra columns
are kept (names with ``mq_`` are taken); an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table, text_or_empty

MAX_PARTITIONS = 16_384
ROWS_PER_PARTITION = 65_536
BUCKETS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One draw; sizes may be beyond what numpy's generator takes. Inverts the law over 12 deviations around its mode."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = 12 * int(np.sqrt(drawn * (good / total) * (bad / total) * max(total - drawn, 1) / max(total - 1, 1)) + 1) + 12
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sum to counts, columns to shard sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for p, left in enumerate(counts):
        rest = sum(free)
        for s in range(shards):
            rest -= free[s]
            got = hypergeometric(rng, free[s], rest, left)
            matrix[p, s] = got
            free[s] -= got
            left -= got
    return matrix


def shard(rows: DataFrame, key: list[str], shards: int = 8, seed: int = 29, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """rows with mq_shard (int) and mq_slot (long, gapless from 0 within a shard). key: the columns that tell rows apart; rows are written
    first, with a number each (mq_row)."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("mq_row", F.monotonically_increasing_id()), "rows")
    key = [*key, "mq_row"]
    total = rows.count()
    n = min(MAX_PARTITIONS, max(8, total // rows_per_partition + 1))
    buckets = max(BUCKETS, total // (shards * rows_per_partition))
    rows = rows.withColumn("mq_part", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n)).cast("int"))
    counts = {r["mq_part"]: r["count"] for r in rows.groupBy("mq_part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(n)], shards, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(n)], "mq_part int, mq_ends array<long>")
    local = Window.partitionBy("mq_part").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    rows = rows.withColumn("mq_rank", F.row_number().over(local).cast("long")).join(F.broadcast(ends), "mq_part")  # MAX_PARTITIONS rows
    rows = rows.withColumn("mq_shard", F.size(F.filter("mq_ends", lambda e: e < F.col("mq_rank"))))
    again = F.xxhash64(F.lit(seed + 2), *key)
    rows = rows.withColumn("mq_again", again).withColumn("mq_bucket", F.pmod(F.shiftrightunsigned("mq_again", 32), F.lit(buckets)))
    rows = rows.drop("mq_part", "mq_rank", "mq_ends")
    bucket = ["mq_shard", "mq_bucket"]
    before = Window.partitionBy("mq_shard").orderBy("mq_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*bucket).count().select(*bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("mq_before"))
    starts = F.broadcast(starts) if shards * buckets <= BROADCAST_ROWS else starts
    inside = Window.partitionBy(*bucket).orderBy("mq_again", *key)
    rows = rows.join(starts, bucket)
    return rows.withColumn("mq_slot", (F.col("mq_before") + F.row_number().over(inside) - 1).cast("long")).drop("mq_bucket", "mq_again", "mq_before", "mq_row")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("mq_text"))
    placed = shard(docs, ["doc_id", "mq_text"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("mq_shard").cast("int").alias("shard"), F.col("mq_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
