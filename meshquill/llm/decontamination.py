"""Benchmark decontamination by a positional inverted index that is spread over the cluster.

1. Test items are cut into windows of WINDOW words; equal windows of several items are one.
2. How often each term of a window comes up in the training texts is counted (in blocks first). A window's ANCHORS rarest places are its anchors;
   a window with a term that no text has can't occur.
3. The index holds the postings of the anchors' terms: a text (by its digest, so copies are indexed once), and the places of a term in it.
   Lists are shifted by the place a term has in its window, so they hold where the window would start; they are intersected from the rarest on.
4. What is left is compared word for word with the texts, which gives the exact phrases. ``near`` asks for an item's rarest terms, in any
   order, within some words of each other: proximity matches.

No list of one term is ever gathered: postings are rows, joined by term or by term, text and place (Spark may split the first, where a term is
hot). What tells tasks which terms to index is sent to them only below a checked size; above, all terms are, and joins leave the rest out.
Texts are shuffled only where what is to be compared is too large for a broadcast, by digest and a salt.

A word is a run of letters of a-z (A-Z are lower-cased), digits and whatever is no ASCII. Null, empty or wordless texts and items have no
words and match nothing. Rows that repeat count each; items that repeat count by their distinct ids. Extra columns do no harm: only ids and
texts are read. Ids of items are compared as strings; an item with a null id hits but has no id to name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, materialize, sendable, slices, small, table

WINDOW, ANCHORS, NEAR, SALTS = 10, 2, 4, 16
#: Distinct terms a task counts before it sends what it has.
HELD = 300_000
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def _windows(width: int, batches):
    """item, text -> item, window (digest), terms of each of its windows."""
    for batch in slices(batches, 64):
        items, windows, terms = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for i in range(max(len(words) - width, 0) + 1 if words else 0):
                items.append(item), windows.append(digest(words[i : i + width])), terms.append(words[i : i + width])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary()), pa.array(terms, pa.list_(pa.binary()))], ["item", "window", "terms"])


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    slim = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(partial(_windows, width), "item string, window binary, terms array<binary>")


def sent(terms: DataFrame):
    """The terms as a broadcast set if they are few and short; None if not."""
    if not sendable(terms, "term", BROADCAST_ROWS):
        return None
    return terms.sparkSession.sparkContext.broadcast(frozenset(bytes(r["term"]) for r in terms.select("term").collect()))


def _counts(told, batches):
    held: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        held.clear()
        return out

    for batch in slices(batches, 64):
        for i in range(batch.num_rows):
            words = words_of(batch.column(0)[i].as_py())
            held.update(words if told is None else filter(told.value.__contains__, words))
            if len(held) > HELD:
                yield rows()
    yield rows()


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """term, n: how often the texts hold each of the terms that they do hold."""
    counts = docs.select(F.col(text_col).cast("binary")).mapInArrow(partial(_counts, sent(terms)), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(small(terms), "term", "left_semi")


def _postings(told, batches):
    for batch in slices(batches, 64):
        terms, keys, places = [], [], []
        for i in range(batch.num_rows):
            words = words_of(batch.column(1)[i].as_py())
            at = range(len(words)) if told is None else [p for p, w in enumerate(words) if w in told.value]
            terms += [words[p] for p in at]
            keys += [batch.column(0)[i].as_py()] * len(at)
            places += at
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(keys, pa.binary()), pa.array(places, pa.int32())], ["term", "key", "place"])


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with mq_key, the digest of the text, and mq_text, its bytes."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select("*", F.unhex(F.md5(body)).alias("mq_key"), body.alias("mq_text"))


def postings(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """The index: term, key, place of every occurrence of the terms; copies of a text are one."""
    rows = keyed(docs, text_col).select("mq_key", "mq_text").mapInArrow(partial(_postings, sent(terms)), "term binary, key binary, place int")
    return rows.join(small(terms), "term", "left_semi").distinct()


def rarest(of: DataFrame, terms: str, counts: DataFrame, group: str, most: int) -> DataFrame:
    """group and its anchors (n, term, at; the rarest first) for the groups all of whose terms come up in the texts."""
    places = of.select(group, F.size(terms).alias("size"), F.posexplode(terms).alias("at", "term"))
    met = places.join(small(counts), "term").groupBy(group, "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("anchors"))
    return met.where(F.size("anchors") == F.col("size")).select(group, "size", F.slice("anchors", 1, most).alias("anchors"))


def starts(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """window, size, key, start where all anchors of the window are at their places."""
    first = anchored.withColumn("term", F.col("anchors")[0]["term"])
    out = index.join(small(first), "term").withColumn("start", F.col("place") - F.col("anchors")[0]["at"]).where("start >= 0").select("window", "size", "anchors", "key", "start")
    for k in range(1, ANCHORS):  # a window of fewer anchors asks for its first once more
        of = F.coalesce(F.get("anchors", F.lit(k)), F.col("anchors")[0])
        asked = out.withColumn("term", of["term"]).withColumn("place", F.col("start") + of["at"])
        out = asked.join(index, ["term", "key", "place"], "left_semi").select("window", "size", "anchors", "key", "start")
    return out.select("window", "size", "key", "start")


def _compared(batches):
    """The columns kept, text, starts of windows -> the columns kept, n_words, n_hit, the windows that do occur."""
    for batch in slices(batches, 64):
        words, hits, found = [], [], []
        for i in range(batch.num_rows):
            text, asked = batch.column(batch.num_columns - 2)[i].as_py(), batch.column(batch.num_columns - 1)[i].as_py()
            of = words_of(text)
            edge, seen = np.zeros(len(of) + 1, np.int64), set()
            for r in asked or []:
                s, e = r["start"], r["start"] + r["size"]
                if e <= len(of) and digest(of[s:e]) == r["window"]:
                    edge[s] += 1
                    edge[e] -= 1
                    seen.add(r["window"])
            words.append(len(of)), hits.append(int((np.cumsum(edge[:-1]) > 0).sum()) if seen else 0), found.append(sorted(seen))
        kept = range(batch.num_columns - 2)
        columns = [*(batch.column(k) for k in kept), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[k] for k in kept), "n_words", "n_hit", "windows"])


def exact_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """mq_id, n_words, n_hit, items (sorted strings) of every row of docs; written to the shared folder."""
    scratch = Scratch()
    cut = scratch(windows(items, item_col, item_text_col, width), "windows")
    distinct = cut.select("window", "terms").dropDuplicates(["window"])
    terms = scratch(distinct.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = scratch(term_counts(docs, text_col, terms), "counts")
    anchored = scratch(rarest(distinct, "terms", counts, "window", ANCHORS), "anchored")
    wanted = scratch(anchored.select(F.explode("anchors.term").alias("term")).distinct(), "wanted")
    index = scratch(postings(docs, text_col, wanted), "index")
    asked = starts(index, anchored).groupBy("key").agg(F.collect_list(F.struct("start", "size", "window")).alias("asked"))
    asked = scratch(asked, "asked")
    rows = keyed(docs.select(F.col(id_col).alias("mq_id"), F.col(text_col).alias("mq_body")), "mq_body").select("mq_id", "mq_key", "mq_text")
    met = small(asked)
    if met is asked:  # too large for a broadcast: copies of one text may be a third of all rows
        met = asked.withColumn("mq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("mq_salt", F.pmod(F.xxhash64("mq_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(met.withColumnRenamed("key", "mq_key"), ["mq_key", "mq_salt"], "left")
    else:
        joined = rows.join(met.withColumnRenamed("key", "mq_key"), "mq_key", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    hits = scratch(joined.select("mq_id", "mq_key", "mq_text", "asked").mapInArrow(_compared, f"mq_id {kind}, mq_key binary, n_words long, n_hit long, windows array<binary>"), "hits")
    of = hits.where("n_hit > 0").select("mq_key", F.explode("windows").alias("window")).distinct()
    of = of.join(small(cut.select("window", "item").where("item is not null").distinct()), "window")
    of = scratch(of.groupBy("mq_key").agg(F.sort_array(F.collect_set("item")).alias("items")), "items")
    out = hits.drop("windows").join(small(of), "mq_key", "left").select("mq_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = materialize(out, "contaminated")
    scratch.release()
    return out


def near_matches(docs: DataFrame, items: DataFrame, within: int = 30, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = NEAR) -> DataFrame:
    """mq_id, item: documents that hold the item's rarest distinct terms (up to ``most``) within some words of each other, in any order.

    An item with a term that no text has is looked for by its other terms only if it has as many; written to the shared folder."""
    scratch = Scratch()
    whole = windows(items.where(F.col(item_col).isNotNull()), item_col, item_text_col, 1).select("item", F.explode("terms").alias("term")).distinct()
    whole = scratch(whole, "terms")
    counts = scratch(term_counts(docs, text_col, whole.select("term").distinct()), "counts")
    sizes = whole.groupBy("item").agg(F.count("*").alias("size"))
    met = whole.join(small(counts), "term").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, most).alias("anchors"))
    met = met.join(sizes, "item").where(F.size("anchors") == F.least("size", F.lit(most)))
    asked = scratch(met.select("item", F.size("anchors").alias("size"), F.posexplode("anchors.term").alias("no", "term")), "asked")
    index = scratch(postings(docs, text_col, asked.select("term").distinct()), "index")
    at = index.join(small(asked), "term").withColumn("bucket", F.explode(F.array(F.floor(F.col("place") / within), F.floor(F.col("place") / within) - 1)))
    groups = at.groupBy("item", "key", "bucket", "size").agg(F.sort_array(F.collect_set(F.struct("place", "no"))).alias("at"), F.countDistinct("no").alias("have")).where("have = size")
    inside = lambda e: F.size(F.array_distinct(F.transform(F.filter("at", lambda x: (x["place"] >= e["place"]) & (x["place"] < e["place"] + within)), lambda x: x["no"])))
    close = groups.where(F.exists("at", lambda e: inside(e) == F.col("size"))).select("item", F.col("key").alias("mq_key")).distinct()
    rows = keyed(docs.select(F.col(id_col).alias("mq_id"), F.col(text_col).alias("mq_body")), "mq_body").select("mq_id", "mq_key")
    out = materialize(rows.join(small(scratch(close, "close")), "mq_key").select("mq_id", "item"), "near")
    scratch.release()
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = exact_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    told = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("mq_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), told.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), cut AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS phrase FROM items WHERE len(w) > 0
), spots AS (
  SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM texts, (SELECT DISTINCT m FROM cut) WHERE len(w) >= m)
), hits AS (SELECT s.r, s.i, s.m, item_id FROM spots s JOIN cut ON cut.phrase = s.phrase AND cut.m = s.m
), hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r
), named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(d.n, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words h USING (r) LEFT JOIN named d USING (r)
"""
