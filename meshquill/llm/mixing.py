"""Mixing sources to target weights by systematic sampling.

Each document expects ``target / source size`` copies. Within a source the expected copies are summed up along an order of
the documents, one random offset is added, and a document is emitted once for each integer boundary that its own share crosses.
Expected copies are whole multiples of 2**-24, so sums are exact and a rerun, or a task that is run again, gives the same copies.

The prefix sum has three levels, so a source with a third of all rows is spread over many tasks: within a bucket of a source and size
class, over the buckets of a source (a row for each ROWS_PER_BUCKET documents and for each class), and the offset. The order goes by size class (number of digits, first two digits), then by a hash
of the id: the copies of each size class come near its share, and so do the words of each source.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null id is ordered as ''. Repeated rows each
count. A source whose documents are all empty has target 0 and its documents get no copy. Extra columns are kept; the names
that start with ``mq_`` are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hex_number, materialize, small, table, text_or_empty

UNIT = 1 << 24
ROWS_PER_BUCKET = 65_536


def word_count(text="text"):
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def size_class(size):
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def source_targets(classes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """mq_source, source_size, target: weights repeat over the sources by code point; targets stop at most * size.

    The level is the largest over the sources by ratio of what is left to share by the weight left (water filling). The
    windows have a row for each source, not for each document. classes: mq_source, mq_words, any number of rows for a source.
    """
    per = classes.groupBy("mq_source").agg(F.sum("mq_words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("mq_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("mq_weight", weight).withColumn("mq_cap", F.col("source_size") * most)
    ratio = F.col("mq_cap").cast("double") / F.col("mq_weight")
    by_ratio = Window.orderBy(ratio, "mq_weight", "mq_cap").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("mq_cap").over(by_ratio), F.lit(0))
    weight_left = F.sum("mq_weight").over(everything) - F.coalesce(F.sum("mq_weight").over(by_ratio), F.lit(0))
    per = per.withColumn("mq_level", left.cast("double") / weight_left)
    level = F.max("mq_level").over(everything)
    return per.select("mq_source", "source_size", F.least(F.col("mq_cap").cast("double"), level * F.col("mq_weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None,
        seed: int = 17, weights=(1, 2, 3), most: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """docs with size, source_size, target and copies as mq_size, source_size, target, mq_copies (a column of those names in docs is replaced).

    size_col names a column that has the sizes already; else words of text_col are counted.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    size = F.col(size_col) if size_col else word_count(text_col)
    sized = docs.drop("source_size", "target").withColumns({"mq_source": F.col(source_col), "mq_size": size, "mq_hash": F.md5(id_text)})
    sized = sized.withColumn("mq_class", size_class(F.col("mq_size")))
    classes = materialize(sized.groupBy("mq_source", "mq_class").agg(F.count("*").alias("mq_rows"), F.sum("mq_size").alias("mq_words")), "classes")
    targets = source_targets(classes, weights, most).withColumnRenamed("mq_source", "mq_named")
    sources = classes.join(targets, F.col("mq_source").eqNullSafe(F.col("mq_named"))).drop("mq_named", "mq_words")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("mq_share", F.least(F.lit(most * UNIT), F.floor(share * UNIT + 0.5).cast("long")).cast("long"))
    sources = sources.withColumn("mq_buckets", F.ceil(F.col("mq_rows") / rows_per_bucket).cast("long"))
    offset = hex_number(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("mq_source"), F.lit("")))), 6)
    sources = materialize(sources.withColumn("mq_offset", offset).withColumnsRenamed({"mq_source": "mq_named", "mq_class": "mq_named_class"}), "sources")
    met = F.col("mq_source").eqNullSafe(F.col("mq_named")) & (F.col("mq_class") == F.col("mq_named_class"))
    rows = sized.join(small(sources), met).drop("mq_named", "mq_named_class")
    rows = rows.withColumn("mq_bucket", F.floor(hex_number(F.col("mq_hash"), 6) * F.col("mq_buckets") / UNIT).cast("long"))
    rows = rows.withColumn("mq_key", F.coalesce(F.concat(F.lit("="), "mq_source"), F.lit("")))
    bucket = ["mq_key", "mq_class", "mq_bucket"]
    per_bucket = rows.groupBy(*bucket).agg((F.count("*") * F.first("mq_share")).alias("mq_sum"))
    before = Window.partitionBy("mq_key").orderBy("mq_class", "mq_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*bucket, F.coalesce(F.sum("mq_sum").over(before), F.lit(0)).alias("mq_before"))
    rows = rows.join(per_bucket, bucket)
    inside = Window.partitionBy(*bucket).orderBy("mq_hash", id_text).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("mq_before") + F.sum("mq_share").over(inside) + F.col("mq_offset")
    rows = rows.withColumn("mq_upto", upto)
    copies = F.floor(F.col("mq_upto") / UNIT) - F.floor((F.col("mq_upto") - F.col("mq_share")) / UNIT)
    rows = rows.withColumn("mq_copies", copies.cast("long"))
    return rows.drop("mq_source", "mq_hash", "mq_class", "mq_rows", "mq_share", "mq_buckets", "mq_offset", "mq_bucket", "mq_key", "mq_before", "mq_upto")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    names = docs.columns
    taken = mix(docs, **options).where("mq_copies > 0")
    return taken.withColumn("mq_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mq_copies")))).select(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    taken = mix(sized, size_col="size")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("mq_copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE) AS lv
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(lv) OVER () * weight::DOUBLE) AS target FROM l),
e AS (SELECT *, least(50331648, floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END * 16777216 + 0.5)::BIGINT) AS share,
             ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 6))::BIGINT AS off FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.share,
             off + sum(share) OVER (PARTITION BY d.source
               ORDER BY length(d.size::VARCHAR) * 100 + substr(d.size::VARCHAR, 1, 2)::INT, h, d.doc_id
               ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (upto::BIGINT // 16777216 - (upto - share)::BIGINT // 16777216))::BIGINT AS taken FROM p
"""
