"""Periodic runs of words: every lag is scanned with array comparisons, and stretches of equality are cut out as runs.

A run of period p is a stretch of at least max(MIN_LENGTH, MIN_EXP * p) words in which words p apart are the same and which can't be
made longer. The ids of a text's words are compared with their shift by each lag up to n / MIN_EXP. A run means at least
s = max((MIN_EXP - 1) * p, MIN_LENGTH - p) equal neighbours in a row, so lags between powers of two are compared together
at every (s / 8)-th word first: where eight such places in a row agree, and nowhere else, all words around them are compared and the
stretches of equality measured. That loses no run and takes n log n comparisons for all lags together.

A stretch at lag p of three periods or more whose smallest period q divides p is the run of q. What multiples of its period see of a
run found before is left out, so texts of one word cost no more than others.

Spark hands out ranges of lags. A text of up to SPLIT bytes is one range. A longer one is dealt out as several ranges to several tasks;
their runs meet again (a run found by two ranges is one run), and join the text to finish its row. A text is read as its UTF-8 bytes and
turned into ids whole: that takes some ten times its size in a worker.

Null text: no words. A null id has no planted repeats. Rows that are the same count each for itself. Extra columns do no harm: only id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

MIN_LENGTH, MIN_EXP = 24, 3
#: Bytes of a text whose lags are one range, and ranges of a longer one for each so many bytes.
SPLIT = 16 << 20
#: Comparisons of one array operation at most.
CELLS = 1 << 22
FOUND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))


def smallest_period(x: np.ndarray, start: int, end: int, p: int) -> int:
    """The smallest period of x[start:end], which has period p and at least two of them: a divisor of p."""
    for q in range(1, p // 2 + 1):
        if p % q == 0 and np.array_equal(x[start : start + p], x[start + q : start + p + q]) and np.array_equal(x[start : end - q], x[start + q : end]):
            return q
    return p


def stretches(x: np.ndarray, n: int, p: int, a: int, b: int, least: int) -> list[tuple[int, int]]:
    """First and last-plus-one place of stretches of at least so many places i in [a, b) with x[i] = x[i + p]."""
    same = np.zeros(b - a + 2, np.int8)
    same[1:-1] = x[a:b] == x[a + p : b + p]
    turn = np.flatnonzero(np.diff(same))
    begin, end = turn[::2] + a, turn[1::2] + a
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def runs(ids: np.ndarray, lo: int = 1, hi: int | None = None, min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP) -> set[tuple[int, int, int]]:
    """start, length and period of every run seen at lags from lo up to (not with) hi; min_exp is 2 at least."""
    n, found = len(ids), set()
    hi = min(n // min_exp + 1, hi or n)
    if n < min_length or lo >= hi:
        return found
    known: list[tuple[int, int, int]] = []
    x = np.concatenate([ids, np.full(hi, -1, np.int32)])
    p = lo
    while p < hi:
        top = min(hi, max(8, 1 << p.bit_length()))
        shortest = min(max((min_exp - 1) * q, min_length - q) for q in {p, top - 1, max(p, min(top - 1, min_length // min_exp)), max(p, min(top - 1, min_length // min_exp + 1))})
        depth = min(8, 1 << (shortest.bit_length() - 1))
        step = shortest // depth
        grid = np.arange(0, n - p, step)
        wide = max(1, CELLS // len(grid))
        for first in range(p, top, wide):
            last = min(top, first + wide)
            rows = as_strided(x[first:], (len(grid), last - first), (4 * step, 4), writeable=False)
            seen = rows == ids[grid, None]
            for k in (1, 2, 4):
                if k < depth:
                    seen = seen[:-k] & seen[k:] if len(seen) > k else seen[:0]
            if not seen.any():
                continue
            lag, at = np.nonzero(seen.T)
            lag, at = lag + first, at * step
            for s, m, q in known:
                if m >= min_exp * first:
                    keep = (lag % q != 0) | (lag * min_exp > m) | (at < s) | (at + (depth - 1) * step >= s + m - lag)
                    lag, at = lag[keep], at[keep]
            while len(lag):
                q = int(lag[0])
                mine = at[: np.searchsorted(lag, q, "right")]
                lag, at = lag[len(mine) :], at[len(mine) :]
                least = max(min_length, min_exp * q) - q
                cuts = np.flatnonzero(np.diff(mine) > step) + 1
                for group in np.split(mine, cuts):
                    a, b = max(0, int(group[0]) - step), min(n - q, int(group[-1]) + depth * step + 1)
                    for s, e in stretches(x, n, q, a, b, least):
                        small = smallest_period(ids, s, e + q, q)
                        run = (s, e + q - s, small)
                        if run in found:
                            continue
                        found.add(run)
                        known.append(run)
                        if small < q:  # its other multiples may stand in this block
                            keep = (lag % small != 0) | (lag * min_exp > run[1]) | (at < s) | (at + (depth - 1) * step >= s + run[1] - lag)
                            lag, at = lag[keep], at[keep]
        p = top
    return found


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query's contract has them: one document of ten gets a tail that repeats."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // max(len(part), 1) + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run or among the first period of each that holds them."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, m, q in found:
        edge[s + q] += 1
        edge[s + m] -= 1
    return [w for w, k in zip(words, np.cumsum(edge[:-1]).tolist()) if not k]


def summary(words: list[bytes], found: list[tuple[int, int, int]]) -> list:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = sorted(found, key=lambda r: (r[0], r[2]))
    best = None
    for r in found:  # exact: by cross products
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    told = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(words, found) if found else words)).hexdigest()
    return [len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, told, kept]


SUMMARY = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
SUMMARY_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def _words(text: bytes | None, doc_id, plant: bool) -> list[bytes]:
    words = (text or b"").split()  # bytes are split at ASCII white space alone
    return planted(words, doc_id) if plant else words


def _whole(plant: bool, options: dict, batches):
    """mq_id, text -> the summary of each row."""
    for batch in slices(batches):
        ids, rows = batch.column(0).to_pylist(), []
        for i, doc_id in enumerate(ids):
            words = _words(batch.column(1)[i].as_py(), doc_id, plant)
            rows.append(summary(words, list(runs(word_ids(words), **options))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, SUMMARY_TYPES)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["mq_id", *(x.split()[0] for x in SUMMARY.split(", "))])


def _ranges(plant: bool, options: dict, batches):
    """mq_id, text, mq_key, part, parts -> mq_key and the runs that a part of the lags sees. Parts have as many powers of two each."""
    for batch in slices(batches, 1):
        doc_id, text, key, part, parts = (c[0].as_py() for c in batch.columns)
        ids = word_ids(_words(text, doc_id, plant))
        top = len(ids) // options.get("min_exp", MIN_EXP) + 1
        bounds = [round(top ** (k / parts)) for k in range(parts)] + [top + 1]
        found = sorted(runs(ids, bounds[part], bounds[part + 1], **options))
        got = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in found]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), got], ["mq_key", "found"])


def _finish(plant: bool, batches):
    """mq_id, text, found -> the summary of each row."""
    for batch in slices(batches, 1):
        doc_id, text, found = (c[0].as_py() for c in batch.columns)
        row = summary(_words(text, doc_id, plant), list({(r["start"], r["length"], r["period"]) for r in found or []}))
        columns = [pa.array([v], t) for v, t in zip(row, SUMMARY_TYPES)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["mq_id", *(x.split()[0] for x in SUMMARY.split(", "))])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, split: int = SPLIT, **options) -> DataFrame:
    """mq_id and the summary of the runs of every row. ``plant`` puts in the contract's repeats; options: min_length, min_exp.

    Texts of more than ``split`` bytes are dealt out by ranges of lags; there are none in most corpora, and then nothing is shuffled.
    """
    slim = docs.select(F.col(id_col).alias("mq_id"), F.col(text_col).cast("binary").alias("text"))
    kind = f"mq_id {slim.schema['mq_id'].dataType.simpleString()}"
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = slim.where(size <= split).mapInArrow(partial(_whole, plant, options), f"{kind}, {SUMMARY}")
    long = slim.where(size > split)
    if long.limit(1).count() == 0:
        return out
    keyed = long.withColumn("mq_key", F.sha2(F.concat(F.coalesce(F.col("mq_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), "text"), 256))
    parts = F.ceil(size / split).cast("int")
    dealt = keyed.dropDuplicates(["mq_key"]).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("mq_id", "text", "mq_key", "part", "parts").repartition(F.xxhash64("mq_key", "part"))
    seen = materialize(dealt.mapInArrow(partial(_ranges, plant, options), f"mq_key string, found {FOUND}"), "runs")
    seen = seen.groupBy("mq_key").agg(F.flatten(F.collect_list("found")).alias("found"))
    return out.unionAll(keyed.join(seen, "mq_key", "left").select("mq_id", "text", "found").mapInArrow(partial(_finish, plant), f"{kind}, {SUMMARY}"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).withColumnRenamed("mq_id", "doc_id")
