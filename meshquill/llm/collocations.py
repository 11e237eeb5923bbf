"""Phrase collocations by language: frequent words become numbers, runs of them fixed-width keys, and sorted keys are counted by run length.

1. Texts are cut into blocks of some BLOCK words of one language. A block is written as a stream of word numbers of its own (4 bytes a
   word, a mark where a piece ends) beside its own list of words with counts. Lists are added up: a word of at least ``least``
   occurrences in its language is frequent and gets a dense id.
2. Frequent words are sent to the tasks below a checked size; beyond, each block's words meet them in a join, and what a block gets back is
   bounded by its own words. They turn its stream into ids; pieces break at other words, for no phrase with such a word is frequent. Pairs of neighbours are packed as keys of 4 bytes an id, sorted and
   counted in the block, dealt out by key ranges, sorted there (Spark's radix sort) and counted by run length. The ranges follow from the
   counts of words: a pair's place is the share of all words before its first one, and within that one's share the same of its second.
3. Phrases of three to five words all of whose pairs are frequent are counted likewise. Frequent pairs are sent to the tasks up to PAIRS_SENT;
   beyond, each block meets its own in a join. A phrase's occurrences start at different places of its part's, so no frequent phrase is lost.
4. A candidate is cut in two at each place; both parts are frequent, so a join of the counts with themselves gives the scores (whole
   numbers of 38 digits). A phrase goes if a phrase of one word more holds it and is as frequent; counts fall with length, so longer ones
   need no look. The first ``top`` of each language are ranked in buckets first.

Nothing is broadcast beyond a checked size; the driver sees row counts of partitions only. A block holds at least one whole piece: a
piece of more words than BLOCK makes a larger block. Null lang is ``und``; null and empty texts have no words; repeated rows count each.
Extra columns do no harm. Words are bytes, so ill-formed text does no harm either.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, sendable, slices, small, table

LEAST, LONGEST, TOP, ABSORB = 100, 5, 2000, 100
#: Words of a block, words read at a time of a long text, distinct rows sent at a time.
BLOCK, CHUNK = 1 << 20, 4 << 20
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")
WIDTH = 4 * LONGEST
BUCKETS = 64
#: Frequent pairs that are sent to every task, 8 bytes each.
PAIRS_SENT = 2_000_000


def chunks(text: bytes, size: int):
    """A text in parts that end at a blank or a break; the rest of a word moves on."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at, at + size) for c in (b" ", b"\t", b"\n", b"."))
        if end < at:  # a word longer than that
            end = min((e for c in (b" ", b"\t", b"\n", b".") if (e := text.find(c, at)) >= 0), default=-1)
            if end < 0:
                break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


class Block:
    """The words of some texts of one language, by numbers of its own: -1 ends a piece."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {b"\n": -1, b"": -2}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        numbers = self.numbers
        for w in dict.fromkeys(tokens):
            if w not in numbers:
                numbers[w] = len(numbers) - 2
        part = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(part[part > -2])
        self.size += len(part)

    def row(self):
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream[stream >= 0], minlength=len(self.numbers) - 2)
        return list(self.numbers)[2:], counts.tolist(), stream.tobytes()


STREAMS = "block string, lang string, words array<binary>, counts array<bigint>, stream binary"


def _streams(size: int, batches):
    """lang, text -> blocks. A block's name is its partition's number and its own, so a task that runs again gives the same."""
    task, number, open_ = TaskContext.get().partitionId(), 0, {}

    def done(langs):
        nonlocal number
        for lang in langs:
            words, counts, stream = open_.pop(lang).row()
            name, number = f"{task}-{number}", number + 1
            columns = [pa.array([name]), pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([stream], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "counts", "stream"])

    for batch in slices(batches):
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = batch.column(1)[i].as_py()
            block = open_.setdefault(lang, Block())
            for chunk in chunks(text or b"", CHUNK):
                block.add(BREAK.sub(b" \n ", chunk.lower()).replace(b"\t", b" ").split(b" "))
            block.add([b"\n"])
            if block.size > size:
                yield from done([lang])
        if len(open_) > 1 and sum(b.size for b in open_.values()) > 2 * size:
            yield from done(list(open_))
    yield from done(list(open_))


def numbered(words: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """words (f: their counts) with id, from 1 without gaps, and before and share: the share of all counts before the word, and its own."""
    rows = scratch(words.withColumn("mq_at", F.monotonically_increasing_id()), name)
    sizes = rows.groupBy(F.shiftright("mq_at", 33).alias("part")).agg(F.count("*").alias("n"), F.sum("f").alias("f")).orderBy("part").collect()
    total = float(sum(r["f"] for r in sizes)) or 1.0
    ids, counts = np.cumsum([1, *(r["n"] for r in sizes)]).tolist(), np.cumsum([0, *(r["f"] for r in sizes)]).tolist()
    if ids[-1] > 1 << 32:
        raise ValueError("more frequent words than keys of four bytes tell apart: raise least")
    at = words.sparkSession.createDataFrame([(r["part"], i, c) for r, i, c in zip(sizes, ids, counts)], "part long, first long, counted long")
    dealt = rows.join(F.broadcast(at), F.shiftright("mq_at", 33) == F.col("part"))  # a row for each partition
    within = F.coalesce(F.sum("f").over(Window.partitionBy("part").orderBy("mq_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumns({"id": F.col("first") + F.col("mq_at").bitwiseAND(F.lit((1 << 33) - 1)), "before": (F.col("counted") + within) / total, "share": F.col("f") / total})
    return dealt.drop("mq_at", "part", "first", "counted")


def packed_keys(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (rows of WIDTH bytes, zeros behind) of phrases whose k-th words are ids[k], and how often each is there."""
    keys = np.zeros((len(ids[0]), LONGEST), ">u4")
    for k, x in enumerate(ids):
        keys[:, k] = x
    rows = np.sort(keys.view(f"V{WIDTH}").ravel().view(f"S{WIDTH}")) if len(keys) else keys.view(f"S{WIDTH}").ravel()
    flat = rows.view(np.uint8).reshape(-1, WIDTH)
    first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]).any(axis=1)])) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.diff(np.append(first, len(flat)))


def binary_array(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binaries."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def binary_rows(column: pa.Array) -> np.ndarray:
    """Binaries of WIDTH bytes each as rows of bytes."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, WIDTH) if len(column) else np.zeros((0, WIDTH), np.uint8)


def _ids(stream, local, values, kind) -> np.ndarray:
    """For each number of a block's stream a value of its word; 0 for other words and breaks."""
    local = np.asarray(local, np.int64)
    of = np.zeros(max(int(stream.max(initial=-1)), int(local.max(initial=-1))) + 2, kind)  # the last place is that of a break
    of[local] = np.asarray(values, kind)
    return of[stream]


def pairs_at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a frequent word is followed by one in its piece, and the pair as one number."""
    return (x[:-1] > 0) & (x[1:] > 0), x[:-1].astype(np.uint64) << np.uint64(32) | x[1:]


class Sent:
    """The frequent words, sent to every task: ids by language and word; before and share by id."""

    def __init__(self, words: pa.Table) -> None:
        self.ids: dict = {}
        for lang, word, i in zip(words["lang"].to_pylist(), words["word"].to_pylist(), words["id"].to_pylist()):
            self.ids.setdefault(lang, {})[word] = i
        self.before, self.share = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        self.before[words["id"].to_numpy()], self.share[words["id"].to_numpy()] = words["before"].to_numpy(), words["share"].to_numpy()

    def of_block(self, lang, words):
        """Local numbers of a block's frequent words, their ids, before and share."""
        known = self.ids.get(lang, {})
        ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        local = np.flatnonzero(ids)
        return local, ids[local], self.before[ids[local]], self.share[ids[local]]


def _known(row: dict, words):
    """What a block knows of its frequent words: by what was sent, or by what a join gave it."""
    if words is not None:
        return words.value.of_block(row["lang"], row["words"])
    return row["local"], row["ids"], row["before"], row["share"]


def _phrases(ranges: int, orders: list[int], pairs_sent, words_sent, batches):
    """Blocks (with pairs, keys of frequent ones, or pairs_sent; all count if there is neither) -> part, key, n.

    Keys of pairs are numbers, others bytes."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        stream = np.frombuffer(row["stream"], np.int32)
        local, ids, before, share = _known(row, words_sent)
        x = _ids(stream, local, ids, np.uint32)
        fit, number = pairs_at(x)
        pairs, sent = row.get("pairs"), pairs_sent
        wanted = sent.value if sent is not None else np.sort(np.array(pairs, np.int64).astype(np.uint64)) if pairs is not None else None
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, number), max(len(wanted) - 1, 0))
            fit &= wanted[at] == number if len(wanted) else False
        low, wide = (dict(zip(np.asarray(ids).tolist(), np.asarray(v).tolist())) for v in (before, share))

        def part(first, second):
            """The range of a key by its first two ids."""
            one, other = (np.unique(c, return_inverse=True) for c in (first, second))
            start, width, inner = (np.array([of[i] for i in u.tolist()])[back] for of, (u, back) in ((low, one), (wide, one), (low, other)))
            return np.minimum(((start + width * inner) * ranges).astype(np.int32), ranges - 1)

        for k in orders:
            if k == 2:
                keys, n = np.unique(number[fit], return_counts=True)
                first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
                keys = keys.astype(np.int64)
            else:
                whole = fit[: max(len(x) - k + 1, 0)].copy()
                for j in range(1, k - 1):
                    whole &= fit[j : len(whole) + j]
                at = np.flatnonzero(whole)
                keys, n = packed_keys([x[at + j] for j in range(k)])
                first, second = keys[:, :4].copy().view(">u4").ravel(), keys[:, 4:8].copy().view(">u4").ravel()
            if not len(keys):
                continue
            parts = part(first, second)
            for i in range(0, len(keys), 1 << 16):
                some = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(parts[some]), pa.array(keys[some]) if k == 2 else binary_array(keys[some]), pa.array(n[some], pa.int64())], ["part", "key", "n"])


def _pairs_of_blocks(words_sent, batches):
    """Blocks -> block, key of its distinct pairs."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        block, (local, ids, _, _) = row["block"], _known(row, words_sent)
        fit, number = pairs_at(_ids(np.frombuffer(row["stream"], np.int32), local, ids, np.uint32))
        keys = np.unique(number[fit]).astype(np.int64)
        for i in range(0, len(keys), 1 << 16):
            some = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.string()), pa.array(some)], ["block", "key"])


def _run_lengths(least: int, wide: bool, batches):
    """Sorted key, n -> key, f of keys that come up at least so often: rows of one key stand together. wide: keys are bytes."""
    kind, key, total = (pa.binary() if wide else pa.int64()), None, 0
    for batch in slices(batches, 1 << 16):
        if not batch.num_rows:
            continue
        rows, n = binary_rows(batch.column(0)) if wide else batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = (rows[1:] != rows[:-1]).any(axis=1) if wide else rows[1:] != rows[:-1]
        first = np.flatnonzero(np.concatenate([[True], new]))
        sums = np.add.reduceat(n, first)
        head, tail = batch.column(0)[0].as_py(), batch.column(0)[int(first[-1])].as_py()
        if key is not None:
            if head == key:
                sums[0] += total
            elif total >= least:
                yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([total], pa.int64())], ["key", "f"])
        key, total = tail, int(sums[-1])
        keep = np.flatnonzero(sums[:-1] >= least)
        if len(keep):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first[keep])), pa.array(sums[keep], pa.int64())], ["key", "f"])
    if key is not None and total >= least:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([total], pa.int64())], ["key", "f"])


def counted(partial_counts: DataFrame, ranges: int, least: int, kind: str) -> DataFrame:
    """key, f of the keys whose n add up to at least so much: by ranges of keys, sorted, by run length."""
    dealt = partial_counts.repartitionById(ranges, "part").select("key", "n").sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_run_lengths, least, kind == "binary"), f"key {kind}, f long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, block: int = BLOCK, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, id, f), phrases of one to LONGEST words (lang, key, f), and n by lang; written to the shared folder.

    Phrases come up at least ``least`` times within pieces; a key holds the ids of its words, 4 bytes each, and zeros."""
    scratch = scratch or Scratch()
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    streams = scratch(slim.mapInArrow(partial(_streams, block), STREAMS), "streams")
    lists = streams.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "of"))
    lists = lists.select("block", "lang", "local", F.col("of.words").alias("word"), F.col("of.counts").alias("n"))
    totals = streams.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = lists.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = scratch(numbered(words, "frequent", scratch), "words")
    spark, words_sent = docs.sparkSession, None
    if sendable(words, "word"):
        words_sent, ready = spark.sparkContext.broadcast(Sent(words.select("lang", "word", "id", "before", "share").toArrow())), streams.select("block", "lang", "words", "stream")
    else:
        met = lists.join(words.select("lang", "word", "id", "before", "share"), ["lang", "word"])
        known = met.groupBy("block").agg(F.collect_list(F.struct("local", "id", "before", "share")).alias("of"))
        known = scratch(known.select("block", *(F.col(f"of.{c}").alias(n) for c, n in (("local", "local"), ("id", "ids"), ("before", "before"), ("share", "share")))), "known")
        ready = streams.select("block", "stream").join(known, "block")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = scratch(counted(ready.mapInArrow(partial(_phrases, ranges, [2], None, words_sent), "part int, key long, n long"), ranges, least, "long"), "often")
    given, pairs_sent = ready, None
    if often.limit(PAIRS_SENT + 1).count() <= PAIRS_SENT:
        pairs_sent = spark.sparkContext.broadcast(np.sort(often.select("key").toArrow()["key"].to_numpy().astype(np.uint64)))
    else:
        of_block = ready.mapInArrow(partial(_pairs_of_blocks, words_sent), "block string, key long").join(often.select("key"), "key")
        given = ready.join(of_block.groupBy("block").agg(F.collect_list("key").alias("pairs")), "block")
    more = given.mapInArrow(partial(_phrases, ranges, list(range(3, LONGEST + 1)), pairs_sent, words_sent), "part int, key binary, n long")
    longer = counted(more, ranges, least, "binary")
    key_of = lambda c, bytes_: F.concat(F.unhex(F.lpad(F.hex(c), 2 * bytes_, "0")), F.lit(bytes(WIDTH - bytes_)))
    every = words.select(key_of("id", 4).alias("key"), "f").unionAll(often.select(key_of("key", 8).alias("key"), "f")).unionAll(longer)
    first = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    phrases = scratch(every.withColumn("id", first).join(small(words.select("id", "lang")), "id").select("lang", "key", "f"), "phrases")
    totals = scratch(totals, "totals")
    scratch.release(words, phrases, totals)
    return words, phrases, totals


def part(key: str, first, length) -> F.Column:
    """A key of some words of a key."""
    return F.rpad(F.substring(F.col(key), first * 4 + F.lit(1), length * 4), WIDTH, F.lit(b"\0"))


def scored(phrases: DataFrame, totals: DataFrame, absorb: int = ABSORB) -> DataFrame:
    """lang, key, m (words), a, l, r, n, score of phrases of two words or more that no longer one absorbs."""
    words = F.array(*(F.substring("key", 4 * k + 1, 4) for k in range(LONGEST)))
    every = phrases.withColumn("m", F.size(F.filter(words, lambda w: w != F.lit(bytes(4)))))
    many = every.where("m > 1").select("lang", "key", "m", F.col("f").alias("a"))
    inner = many.where("m > 2").select(F.explode(F.array(part("key", F.lit(0), F.col("m") - 1), part("key", F.lit(1), F.col("m") - 1))).alias("key"), "a")
    held = inner.groupBy("key").agg(F.max("a").alias("longer"))
    many = many.join(held, "key", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * absorb, F.lit(True))).drop("longer")
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("left", part("key", F.lit(0), F.col("cut"))).withColumn("right", part("key", F.col("cut"), F.col("m") - F.col("cut")))
    one, other = (phrases.select(F.col("key").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    cuts = cuts.join(small(one), "left").join(small(other), "right").join(small(totals), "lang")
    value = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.select("lang", "key", "m", "a", "n", F.struct(value.alias("score"), "cut", "l", "r").alias("of")).groupBy("lang", "key", "m", "a", "n").agg(F.min("of").alias("of"))
    return best.select("lang", "key", "m", "a", "of.l", "of.r", "n", "of.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, absorb: int = ABSORB, top: int | None = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations (None: of all)."""
    scratch = Scratch()
    words, phrases, totals = frequent_phrases(docs, text_col, lang_col, least, block, scratch)
    found = scratch(scored(phrases, totals, absorb), "scored")
    place = found.select("key", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("place"))
    place = place.withColumn("id", F.conv(F.hex(F.substring("key", F.col("place") * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    told = place.join(small(words.select("id", "word")), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("words"))
    named = found.join(told, "key").withColumn("phrase", F.array_join("words.word", " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).where(F.col("rank") <= top)
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.release()
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (
  SELECT lang, doc, unnest(piece) AS piece, generate_subscripts(piece, 1) AS p FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS piece FROM documents)
), split AS (
  SELECT lang, doc, p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
    FROM split, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100
), many AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, a AS f, unnest([array_to_string(list_slice(w, 1, m - 1), ' '), array_to_string(list_slice(w, 2, m), ' ')]) AS phrase FROM many WHERE m > 2) GROUP BY ALL
), kept AS (SELECT many.* FROM many LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 100 * a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS one, array_to_string(list_slice(w, cut + 1, m), ' ') AS other
  FROM (SELECT *, unnest(range(1, m)) AS cut FROM kept)
), valued AS (
  SELECT c.lang, c.phrase, c.a, cut, g.f AS l, h.f AS r, n, ((1000::HUGEINT * c.a * n) // (g.f::HUGEINT * h.f))::BIGINT AS score
  FROM cuts c JOIN grams g ON g.lang = c.lang AND g.phrase = c.one JOIN grams h ON h.lang = c.lang AND h.phrase = c.other JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
