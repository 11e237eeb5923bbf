"""N-gram Jaccard self-join: a size-aware heavy-light join that yields components.

A document is the set of its distinct word shingles (64-bit hashes; the chance that two of a pair's shingles collide is about
1e-13). Two documents link when 100 * intersection >= percent * union. Documents with equal sets are one node.

*Small sets* (up to a boundary) enumerate subsets of fixed sizes: a set of s shingles can lose at most s * (100 - percent) / 100
of them in a link, so all its subsets with that many or fewer left out are keys, and two small sets link only if a key (their
intersection) agrees. *Large sets* scan inverted lists: of a set's shingles, rarest first, those before the last
ceil(percent * s / 100) - 1 are keys, and two sets that link share a key. Small sets within a large set's reach are in the lists too.
The boundary is the size at which the sum of both costs is least: keys to ship for subsets against keys and list rows for scans, from
the histogram of small sizes.

"Rarest first" is an order by estimated count, then hash. The counts are of shingles that come up often within a block of rows,
over all rows; the HEAVY largest are broadcast. The estimate sets the cost only: any order that all tasks share finds every link.

A link has at least need - behind keys in common (behind: the shingles that are no keys), and its k-th common key leaves room for
need - (k - 1) more; so pairs that meet in fewer than WITNESSES keys with such room (or than they must) are no links.

Finding links: per list, every member is checked against the member for which the key is rarest (a star, no pairs of the whole
list); checked pairs become components. What is left, pairs of a list whose members are still in different components and whose
places in the lists leave room for a link, is joined and checked exactly. So a group of n near copies costs about n checks, and
no link between different components is missed. Checks read full shingle sets.

Rows that share an id are one document (in one component). Null and blank texts have an empty set and link with nothing; a null
id links with nothing and its component is null. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, release, slices, small, table, tidy
from .components import components

HEAVY = 200_000
BLOCK = 2_000_000
OFTEN = 8
LARGEST_SMALL = 29
WITNESSES = 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            out = mixed(out) * MIX + hashes[k : len(hashes) - width + 1 + k]
        out = mixed(out + np.uint64(width))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name the set."""
    with np.errstate(over="ignore"):
        return int(shingles.sum().astype(np.int64)), int(mixed(shingles + MIX).sum().astype(np.int64))


def losses(size: int, percent: int) -> int:
    """How many of its shingles a set can lack in the other set of a link."""
    return size * (100 - percent) // 100


def subset_count(size: int, percent: int) -> int:
    total, ways = 0, 1
    for k in range(losses(size, percent) + 1):
        total += ways
        ways = ways * (size - k) // (k + 1)
    return total


def prefix(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def subset_keys(shingles: np.ndarray, percent: int) -> list[int]:
    """Keys of all subsets with at most losses() left out: the set's sum less the sum of what is left out."""
    with np.errstate(over="ignore"):
        parts = mixed(shingles ^ MIX)
        total = parts.sum()
        out = [total]
        for k in range(1, losses(len(shingles), percent) + 1):
            out += [total - parts[list(c)].sum() for c in combinations(range(len(parts)), k)]
        return [int(x) for x in mixed(np.array(out, np.uint64)).astype(np.int64)]


def _statistics(width: int, batches):
    """(0, shingle, count) of shingles that come up often in a block; (1, size, documents) of small sets."""
    held: list[np.ndarray] = []

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= OFTEN
        return 0, values[often].astype(np.int64), counts[often]

    def rows(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["kind", "key", "n"])

    sizes = np.zeros(LARGEST_SMALL + 1, np.int64)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            s = shingle_set(text, width)
            if len(s):
                held.append(s)
                if len(s) <= LARGEST_SMALL:
                    sizes[len(s)] += 1
                if sum(map(len, held[-1:])) and len(held) % 512 == 0 and sum(map(len, held)) > BLOCK:
                    yield rows(*flush())
                    held.clear()
    if held:
        yield rows(*flush())
    yield rows(1, np.arange(1, LARGEST_SMALL + 1), sizes[1:])


def boundary(sizes: dict[int, int], percent: int, list_rows: float = 4.0) -> int:
    """The largest small size. sizes: documents of each size up to LARGEST_SMALL; list_rows: rows that a key of a scan meets."""
    def cost(edge: int) -> float:
        reach = edge * percent // 100
        enumerated = sum(n * subset_count(s, percent) for s, n in sizes.items() if s <= edge)
        scanned = sum(n * prefix(s, percent) * (1 + list_rows) for s, n in sizes.items() if s > reach)
        return enumerated + scanned
    return min(range(LARGEST_SMALL + 1), key=lambda e: (cost(e), e))


def _keys(width: int, percent: int, edge: int, heavy, batches):
    """doc_id, n, h1, h2, the list keys in order and the subset keys."""
    often, counts = heavy.value
    for batch in slices(batches):
        ids = batch.column(0)
        n, h1, h2, lists, subsets = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width)
            size = len(s)
            a, b = set_hash(s) if size else (0, 0)
            n.append(size), h1.append(a), h2.append(b)
            if 0 < size <= edge:
                subsets.append(subset_keys(s, percent))
            else:
                subsets.append([])
            if size and size * 100 >= percent * (edge + 1):
                order = s
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    order = s[np.argsort(np.where(often[at] == s, counts[at], 0), kind="stable")]
                lists.append(order[: prefix(size, percent)].astype(np.int64))
            else:
                lists.append(np.empty(0, np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(lists, longs), pa.array(subsets, longs)], ["doc_id", "n", "h1", "h2", "lists", "subsets"])


def _sets(width: int, batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "shingles"])


def _linked(percent: int, batches):
    for batch in slices(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("mq_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("mq_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "mq_a", "mq_b")
    return full.mapInArrow(partial(_linked, percent), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = docs.select("text").mapInArrow(partial(_statistics, width), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = scratch(counted, "counts")
    sizes = {r["key"]: r["n"] for r in counted.where("kind = 1").collect()}  # LARGEST_SMALL rows
    heavy = counted.where("kind = 0").orderBy(F.desc("n"), "key").limit(HEAVY).select(F.col("key").cast("long"), "n").toPandas()
    often = heavy["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    told = spark.sparkContext.broadcast((often[order], heavy["n"].to_numpy(np.int64)[order]))
    edge = boundary(sizes, percent)

    keyed = docs.mapInArrow(partial(_keys, width, percent, edge, told), "doc_id long, n long, h1 long, h2 long, lists array<long>, subsets array<long>")
    keyed = scratch(keyed, "keys")
    slim = keyed.select("doc_id", "n", "h1", "h2")
    nodes = slim.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    of_nodes = keyed.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "h1", "h2", "n"], "left_semi")
    exploded = of_nodes.select("doc_id", "n", F.posexplode("lists").alias("pos", "key"))
    exploded = exploded.unionByName(of_nodes.select("doc_id", "n", F.explode("subsets").alias("key"), F.lit(-1).alias("pos")))
    shared = exploded.groupBy("key").agg(F.count("*").alias("mq_rows")).where("mq_rows > 1").select("key")
    members = exploded.join(shared, "key").select("key", F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), "pos")
    members = scratch(members, "members")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the full sets of the documents in them."""
        pairs = scratch(pairs, "pairs")
        asked = scratch(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "asked")
        sets = docs.join(small(asked), "doc_id", "left_semi").mapInArrow(partial(_sets, width), "node long, shingles binary")
        sets = materialize(sets, "sets")
        out = scratch(check(pairs, sets, percent), "checked")
        release(sets)
        tidy(spark)
        return out

    tidy(spark)
    def room(n, pos, other_n, other_pos, before=0):
        """Whether a link is possible if so many keys before this one, and all shingles after it, are in common."""
        need = F.ceil((n + other_n) * percent / (100 + percent) - 1e-9)
        return (F.least(n - F.greatest(pos, F.lit(0)), other_n - F.greatest(other_pos, F.lit(0))) >= need - before) & (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent)

    lead = members.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("lead"))
    stars = members.join(lead, "key").where((F.col("node") != F.col("lead.node")) & room(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    stars = scratch(stars.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "stars")
    repeated = slim.where("n > 0").join(nodes, ["h1", "h2", "n"]).select("doc_id", "node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    links = scratch(linked(stars).unionAll(repeated), "links")
    of = scratch(components(links), "components")

    labelled = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = scratch(labelled.join(split, "key"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node"))
    apart &= room(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), WITNESSES - 1)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), (F.col("x.pos") < 0).cast("int").alias("kind"))
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("kind").alias("kind"))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    behind = F.greatest(*(F.ceil(F.col(c) * percent / 100) - 1 for c in ("na", "nb")))  # shingles behind the list keys
    pairs = met.where((F.col("kind") == 1) | (F.col("common") >= F.least(F.lit(WITNESSES), need - behind))).select("a", "b")
    of = materialize(components(links.unionAll(linked(pairs.join(stars, ["a", "b"], "left_anti")))), "components")
    named = nodes.join(small(of), "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("mq_component"))
    scratch.release(keyed)  # the result reads the keys, the nodes and their components
    out = slim.join(named, ["h1", "h2", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("mq_component")).alias("component_id"))


def near_duplicates_removed(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id; documents without words stay."""
    found = materialize(jaccard_components(docs, width, percent).where("component_id < doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(small(found), "doc_id", "left_anti").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 3-word shingles, 90 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
s AS (SELECT doc_id, unnest(sh) AS t FROM g),
n AS (SELECT doc_id, len(sh) AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM g UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
