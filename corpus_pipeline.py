"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and what it returns is written and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm.common import materialize, release, table
from meshquill.llm.line_dedup import SPACE, without_lines
from meshquill.llm.mixing import mixed
from meshquill.llm.ngram_join import near_duplicates_removed
from meshquill.llm.packing import packed
from meshquill.llm.toxicity import less_toxic


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold."""
    return less_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents of which nothing is left go, n_chars follows the text."""
    left = without_lines(docs).where((F.col("mq_dropped") == 0) | F.col("text").rlike(rf"[^{SPACE}]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("mq_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return near_duplicates_removed(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences."""
    return packed(docs)


STAGES = [("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: Learnt scores and packing can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage returned is deleted once the next one's result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
