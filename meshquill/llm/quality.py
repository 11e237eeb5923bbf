"""Quality classifier: an interpolated modified Kneser-Ney model of 4-grams of characters, trained on trusted text.

1. Trusted texts are the documents labelled quality 1. Three quarters of them (by a hash of the id) are counted, all of each
   text, and summed by n-gram; the last quarter sets the thresholds, on text that the model has not seen. A character is a UTF-16
   unit, so every script, case and digit counts as itself and an n-gram is one 64-bit number, without a hash. The counts stay a
   table that grows with the trusted text. Only its counts of counts (four an order) and its single characters (65,536 at most)
   come to the driver: they give the discounts (three an order, those of modified Kneser-Ney) and the lowest order.
2. Documents are dealt by a hash into blocks of about ``block`` bytes. A block asks for each of its distinct n-grams once.
3. The *sharded count join*: counts and questions go to shards by the character before the last one, which all orders of an
   n-gram and their contexts have in common, so a shard works out every order by itself, lower ones from continuation counts.
   Shards with many counts are salted: their counts are repeated, their questions dealt out. Questions stream past the counts.
4. Answers meet their block's texts, and each text's perplexity is that of all its n-grams.

A document is kept if the logarithm of its perplexity is at most its language's median (of held-out trusted documents) plus MARGIN times the distance
of the quartiles, which is taken over all languages, each about its own median: a language's level needs few documents, and the
margin rests on all of them, so there is no number of documents at which the rule changes, and no threshold is the largest value of a sample.
A language without held-out trusted documents takes the median of all. Null and empty texts have the perplexity of a uniform model (65,536) and are not
kept. Without trusted text the model is uniform and all other texts are kept. Repeated rows score alike; null languages are a
language of their own; a null id is never trusted. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, small, table

UNITS, ORDER = 1 << 16, 4
BLOCK = 4_000_000
BLOCK_BYTES = 16 << 20
PIECE = 1024
MARGIN = 5.0
QUESTIONS = "block long, unit int, grams binary"


def grams(text: str) -> np.ndarray:
    """The 4-grams of a text as 64-bit numbers; three zeros stand before it and one behind."""
    c = np.concatenate([np.zeros(3, np.uint64), np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.uint64), np.zeros(1, np.uint64)])
    return c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]


def _counts(batches):
    held, size = [], 0

    def block():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if text:
                held.append(grams(text))
                size += len(held[-1])
            if size > BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def discounts(counted: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of one order from how many n-grams have count 1, 2, 3 and 4."""
    c = np.array(counted, np.float64) + 0.5
    y = c[0] / (c[0] + 2 * c[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])


def order_of(keys: np.ndarray, n: np.ndarray, d: np.ndarray) -> dict:
    """One order's sorted n-grams with their discounted shares, and its contexts with the weight of the order below."""
    contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
    total = np.bincount(at, n, len(contexts))
    cut = d[np.minimum(n, 3).astype(np.int64)]
    return {"keys": keys, "share": (n - cut) / total[at], "contexts": contexts, "back": np.bincount(at, cut, len(contexts)) / total}


def found(sorted_: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    """values of what is asked in sorted_; missing where it is not there."""
    if not len(sorted_):
        return np.full(len(asked), missing)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return np.where(sorted_[at] == asked, values[at], missing)


def shard_model(keys: np.ndarray, n: np.ndarray, d: list[np.ndarray]) -> list[dict]:
    """Orders 4, 3 and 2 of the 4-grams of one shard; counts of lower orders say how many characters come before."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.float64)
    out = []
    for k in (4, 3, 2):
        out.append(order_of(keys, n, d[k - 1]))
        keys, n = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
        n = n.astype(np.float64)
    return out


def log_probabilities(model: list[dict], lowest: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """log P of the last character of each 4-gram after the three before it."""
    p = lowest[(asked & np.uint64(UNITS - 1)).astype(np.int64)]
    for k, m in zip((2, 3, 4), reversed(model)):
        g = asked & np.uint64((1 << 16 * k) - 1)
        p = found(m["keys"], m["share"], g, 0.0) + found(m["contexts"], m["back"], g >> np.uint64(16), 1.0) * p
    return np.log(p)


def lowest_order(rows: list[tuple[int, int]], d: np.ndarray) -> np.ndarray:
    """P of each single character; rows: character, how many characters come before it."""
    n = np.zeros(UNITS)
    for unit, count in rows:
        n[unit] = count
    if not n.any():
        return np.full(UNITS, 1 / UNITS)
    cut = d[np.minimum(n, 3).astype(np.int64)]
    return (n - cut) / n.sum() + cut.sum() / n.sum() / UNITS


def _questions(batches):
    """Each block's distinct 4-grams, in pieces by the character before the last one."""
    told: dict[int, np.ndarray] = {}
    held: dict[int, list[np.ndarray]] = {}

    def merge(block):
        told[block] = np.unique(np.concatenate([told.get(block, np.empty(0, np.uint64)), *held.pop(block)]))

    for batch in slices(batches):
        for block, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if text:
                held.setdefault(block, []).append(np.unique(grams(text)))
                if sum(map(len, held[block])) > BLOCK // 4:
                    merge(block)
    for block in list(held):
        merge(block)
    for block, keys in told.items():
        unit = (keys >> np.uint64(16) & np.uint64(UNITS - 1)).astype(np.int64)
        order = np.argsort(unit, kind="stable")
        keys, unit = keys[order], unit[order]
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        ends = [*starts[1:], len(unit)]
        rows = [(int(unit[a]), keys[i : min(i + PIECE, b)].tobytes()) for a, b in zip(starts, ends) for i in range(a, b, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([u for u, _ in rows], pa.int32()), pa.array([g for _, g in rows], pa.binary())], ["block", "unit", "grams"])


def _answers(told, batches):
    """Rows come sorted by shard, counts before questions; a shard may go over several batches."""
    d, lowest = told.value
    shard, keys, counts, model = None, [], [], None
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        unit, salt, block = (column[c].to_numpy(zero_copy_only=False) for c in ("unit", "salt", "block"))
        blocks, pieces, logs = [], [], []
        starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (salt[1:] != salt[:-1])])) if len(unit) else []
        for a, b in zip(starts, [*starts[1:], len(unit)]):
            if shard != (unit[a], salt[a]):
                shard, keys, counts, model = (unit[a], salt[a]), [], [], None
            asks = b - a - column["grams"].slice(a, b - a).null_count
            split = b - asks
            if split > a:
                keys.append(column["gram"].slice(a, split - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                counts.append(column["n"].slice(a, split - a).to_numpy(zero_copy_only=False).astype(np.int64))
            if asks:
                if model is None:
                    model = shard_model(np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *counts]), d)
                raw = column["grams"].slice(split, asks).to_pylist()
                got = log_probabilities(model, lowest, np.frombuffer(b"".join(raw), np.uint64)).astype(np.float32)
                ends = np.cumsum([len(x) // 8 for x in raw])
                blocks += block[split:b].astype(np.int64).tolist()
                pieces += raw
                logs += [x.tobytes() for x in np.split(got, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(pieces, pa.binary()), pa.array(logs, pa.binary())], ["block", "grams", "logs"])


SCORES = "doc_id long, lang string, perplexity double, filled boolean"


def _scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The perplexities of a block's documents."""
    keys = np.frombuffer(b"".join(answers.column("grams").to_pylist()), np.uint64)
    order = np.argsort(keys)
    keys, logs = keys[order], np.frombuffer(b"".join(answers.column("logs").to_pylist()), np.float32)[order].astype(np.float64)
    out = []
    for text in texts.column("text").to_pylist():
        if not text:
            out.append(float(UNITS))
            continue
        asked, n = np.unique(grams(text), return_counts=True)
        at = np.searchsorted(keys, asked)
        if at[-1] >= len(keys) or not np.array_equal(keys[at], asked):
            raise ValueError("a block lacks answers")
        out.append(float(np.exp(-(logs[at] * n).sum() / n.sum())))
    return pa.table([texts.column("doc_id"), texts.column("lang"), pa.array(out, pa.float64()), pa.array([bool(t) for t in texts.column("text").to_pylist()])], ["doc_id", "lang", "perplexity", "filled"])


def counted(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """The table of 4-gram counts of texts, the discounts of each order, and P of single characters."""
    full = scratch(texts.mapInArrow(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    orders = [full]
    for k in (3, 2, 1):
        below = orders[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        orders.append(scratch(below, f"grams{k}"))
    told = [dict.fromkeys(range(1, 5), 0) for _ in orders]
    few = [o.where("n <= 4").groupBy("n").count().withColumn("order", F.lit(i)) for i, o in enumerate(orders)]
    for r in few[0].unionByName(few[1]).unionByName(few[2]).unionByName(few[3]).collect():  # 16 rows
        told[r["order"]][r["n"]] = r["count"]
    d = [discounts([c[n] for n in range(1, 5)]) for c in told][::-1]
    return full, d, lowest_order([(r["gram"], r["n"]) for r in orders[3].collect()], d[0])  # a row a character


def perplexities(docs: DataFrame, full: DataFrame, d: list[np.ndarray], lowest: np.ndarray, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, perplexity, filled of every row of docs (doc_id, lang, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "lang", "text").repartition(parts, "block")
    unit = lambda g: F.shiftright(g, 16).bitwiseAND(F.lit(UNITS - 1)).cast("int")
    heavy = full.groupBy(unit("gram").alias("unit")).count()
    mean = full.count() / parts
    salts = {r["unit"]: min(blocks, int(r["count"] / mean)) for r in heavy.where(F.col("count") >= 2 * mean + 1).collect()}  # at most parts / 2 rows
    salt_of = F.coalesce(F.create_map(*(F.lit(x) for kv in salts.items() for x in kv))[F.col("unit")], F.lit(1)) if salts else F.lit(1)
    counts = full.select(unit("gram").alias("unit"), "gram", "n").withColumn("salt", F.explode(F.sequence(F.lit(0), salt_of - 1)))
    asked = dealt.mapInArrow(_questions, QUESTIONS).withColumn("salt", F.pmod(F.col("block"), salt_of).cast("int"))
    both = counts.unionByName(asked, allowMissingColumns=True).select("unit", "salt", "gram", "n", "block", "grams")
    met = both.repartition(parts, "unit", "salt").sortWithinPartitions("unit", "salt", F.col("grams").isNotNull())
    told = spark.sparkContext.broadcast((d, lowest))
    answers = met.mapInArrow(partial(_answers, told), "block long, grams binary, logs binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, SCORES)


def quality(docs: DataFrame, labels: DataFrame, margin: float = MARGIN, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every row of docs (doc_id, text, lang)."""
    scratch = Scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held")).distinct()
    trusted = scratch(trusted, "trusted")
    texts = docs.join(small(trusted.where("not held")), "doc_id", "left_semi").select("text")
    scored = materialize(perplexities(docs, *counted(texts, scratch), block), "scores")
    known = scratch(scored.where("filled").join(small(trusted.where("held")), "doc_id", "left_semi").select("lang", F.ln("perplexity").alias("mq_log")), "known")
    middle = F.percentile_approx("mq_log", 0.5, 10000)
    by_lang = materialize(known.groupBy("lang").agg(middle.alias("mq_middle")), "quantiles")
    same = lambda left: left.join(small(by_lang), left["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"])
    ends = same(known).agg(F.percentile_approx(F.col("mq_log") - F.col("mq_middle"), [0.25, 0.75], 10000).alias("q")).first()["q"]
    overall = known.agg(middle).first()[0]
    scratch.release()
    if overall is None:
        high = F.lit(float("inf"))
    else:
        high = F.exp(F.coalesce("mq_middle", F.lit(overall)) + margin * (ends[1] - ends[0]))
    return same(scored).select("doc_id", "lang", "perplexity", high.alias("threshold"), (F.col("filled") & (F.col("perplexity") <= high)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
