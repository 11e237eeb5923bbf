"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

1. Each vector is rotated by three rounds of random signs and a Hadamard transform, HASHES * TABLES times; a hash is the axis
   (and its sign) nearest to the rotated vector. A table's bucket joins HASHES hashes; the second bucket of a vector exchanges the
   hash of the smallest margin for its runner-up (multiprobe).
2. Vectors that are equal once scaled to length 1, component by component, are one form with a weight, so exact copies cost
   nothing more. Forms get a number when their table is written.
3. Bucket entries are numbers only. Buckets of one entry, or without a main entry, fall away; vectors travel only for the rest. A
   bucket of more than ``block`` entries is split by a hash into blocks, and each pair of blocks is one group: n different
   vectors of one bucket are copied n / block times, and the n**2 products, which exact counts of links take, are shared by the groups.
4. A group compares its rows by matrix products of TILE rows in double precision. Of the pairs at or above the threshold it adds up
   links per vector, without a row for each pair, and sends on a spanning forest. A pair that meets in several buckets counts in the
   first only: rows carry their bucket codes of all tables.
5. Links are summed by vector; forests go to connected components, which take the smallest id of their vectors.

Links have a cosine at or above the threshold by an exact product; hashing may miss some. Measured recall is in the README and held
by a test. Null, zero, or non-finite vectors link with nothing; so do vectors of different lengths. Each row is a vector of its own and
gets its own row out, also where ids repeat, with equal vectors or others; a null id counts for others' links and never names a component
that has an id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, table
from .components import components

TABLES, HASHES, SEED = 12, 3, 41
BLOCK, TILE = 4096, 1024
THRESHOLD = 0.95


def signs(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(3, tables * hashes, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis (a power of two)."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Main and second bucket codes (rows x tables) of unit vectors."""
    dim = 1 << max(0, (x.shape[1] - 1).bit_length())
    flips = signs(dim, tables, hashes, seed)
    y = np.zeros((len(x), 1, dim))
    y[:, 0, : x.shape[1]] = x
    for k in range(3):
        y = hadamard(y * flips[k]) / np.sqrt(dim)
    size = np.abs(y)
    axis = size.argmax(axis=2)
    top = np.take_along_axis(y, axis[..., None], 2)[..., 0]
    np.put_along_axis(size, axis[..., None], -1.0, 2)
    second = size.argmax(axis=2)
    runner = np.take_along_axis(y, second[..., None], 2)[..., 0]
    shape = (len(x), tables, hashes)
    main = (2 * axis + (top < 0)).reshape(shape)
    other = (2 * second + (runner < 0)).reshape(shape)
    weakest = (np.abs(top) - np.abs(runner)).reshape(shape).argmin(axis=2)[..., None]
    probe = main.copy()
    np.put_along_axis(probe, weakest, np.take_along_axis(other, weakest, 2), 2)
    base = (2 * dim) ** np.arange(hashes)
    return main @ base, probe @ base


def _codes(tables: int, hashes: int, batches):
    """vec_id, raw bytes, length and codes of each row; nulls for vectors that link with nothing."""
    for batch in slices(batches, 1024):
        n = batch.num_rows
        raw, dims, mains, probes = [None] * n, [None] * n, [None] * n, [None] * n
        by_dim: dict[int, list] = {}
        for i, v in enumerate(batch.column(1).to_pylist()):
            if v and None not in v:
                by_dim.setdefault(len(v), []).append((i, v))
        for dim, rows in by_dim.items():
            x = np.array([v for _, v in rows], np.float64)
            with np.errstate(all="ignore"):
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # an exact scale keeps squares in range
                norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
            if not good.any():
                continue
            x = x[good] / norm[good, None] + 0.0
            main, probe = buckets(x, tables, hashes)
            for k, i in enumerate(np.array([i for i, _ in rows])[good]):
                raw[i], dims[i], mains[i], probes[i] = x[k].tobytes(), dim, main[k], probe[k]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(mains, longs), pa.array(probes, longs)], ["vec_id", "unit", "dim", "main", "probe"])


def _group(threshold, t, cross, rep, weight, side, main_here, x, main, probe):
    """(vector, links) and forest edges of one group of rows, tile by tile."""
    n, links = len(rep), np.zeros(len(rep), np.int64)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edges = []
    for p in range(0, n, TILE):
        for q in range(p, n, TILE):
            left, right = slice(p, p + TILE), slice(q, q + TILE)
            near = (x[left] @ x[right].T >= threshold) & (main_here[left, None] | main_here[None, right])
            if cross:
                near &= side[left, None] != side[None, right]
            if p == q:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = a + p, b + q
            c, d = a, b
            while len(c):  # each round joins every row to a first partner; pairs within a tree then fall away
                for i in {*np.unique(c, return_index=True)[1].tolist(), *np.unique(d, return_index=True)[1].tolist()}:
                    r, o = root(c[i]), root(d[i])
                    if r != o:
                        parent[max(r, o)] = min(r, o)
                        edges.append((int(rep[c[i]]), int(rep[d[i]])))
                while (parent != parent[parent]).any():
                    parent = parent[parent]
                apart = parent[c] != parent[d]
                c, d = c[apart], d[apart]
            fresh = np.ones(len(a), bool)
            for e in range(t):
                fresh &= ~((main[a, e] == main[b, e]) | (main[a, e] == probe[b, e]) | (probe[a, e] == main[b, e]))
            one, two = main[a, t] == probe[b, t], main[b, t] == probe[a, t]  # a pair with two buckets in this table counts in the lower
            here = np.where(main_here[a], main[a, t], main[b, t])
            fresh &= ~(one & two & (main[a, t] != main[b, t]) & (here != np.minimum(main[a, t], main[b, t])))
            a, b = a[fresh], b[fresh]
            links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
    at = np.flatnonzero(links)
    return list(zip(rep[at].tolist(), links[at].tolist())), edges


def _compare(threshold: float, batches):
    """Rows come sorted by group; a group may go over several batches."""
    names = ["t", "code", "dim", "lo", "hi"]
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table):
        get = {n: rows.column(n).to_numpy() for n in ["rep", "weight", "side", "here", *names]}
        keys = np.stack([get[n].astype(np.int64) for n in names], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        unit, main, probe = (rows.column(n).to_pylist() for n in ("unit", "main", "probe"))
        counts, edges = [], []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1 and get["here"][s:e].any():
                x = np.frombuffer(b"".join(unit[s:e]), np.float64).reshape(e - s, -1)
                got = _group(threshold, int(get["t"][s]), get["lo"][s] != get["hi"][s], get["rep"][s:e], get["weight"][s:e], get["side"][s:e], get["here"][s:e].astype(bool), x, np.array(main[s:e]), np.array(probe[s:e]))
                counts += got[0]
                edges += got[1]
        a = [x for x, _ in counts] + [x for x, _ in edges]
        b = [None] * len(counts) + [x for _, x in edges]
        n = [x for _, x in counts] + [0] * len(edges)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        last = int(changes[-1]) + 1 if len(changes) else 0  # the last group may go on
        if held and not all(int(held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py()) == int(k) for n, k in zip(names, keys[0])):
            yield work(pa.Table.from_batches(held))
            held = []
        if last:
            yield work(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield work(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    coded = rows.mapInArrow(partial(_codes, tables, hashes), "vec_id long, unit binary, dim int, main array<long>, probe array<long>")
    coded = scratch(coded.withColumn("form", F.sha2("unit", 256)), "codes")
    some = F.struct("unit", "dim", "main", "probe")
    forms = coded.where("form is not null").groupBy("form").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first(some).alias("some"))
    forms = scratch(forms.select(F.monotonically_increasing_id().alias("rep"), "form", "low", "weight", "some.*"), "forms")
    mains = F.transform("main", lambda x, i: F.struct(i.alias("t"), x.alias("code"), F.lit(1).alias("here")))
    probes = F.transform("probe", lambda x, i: F.struct(i.alias("t"), x.alias("code"), F.lit(0).alias("here")))
    entries = forms.select("rep", "dim", F.explode(F.concat(mains, probes)).alias("e")).select("rep", "dim", "e.*")
    key = ["t", "code", "dim"]
    full = entries.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("here").alias("mains")).where("rows > 1 and mains > 0").select(*key, "rows")
    busy = entries.join(full, key).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    busy = busy.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    busy = busy.select("rep", *key, "here", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    moved = busy.join(forms.drop("dim", "form", "low"), "rep").select(*key, "lo", "hi", "side", "here", "rep", "weight", "unit", "main", "probe")
    group = [*key, "lo", "hi"]
    compared = moved.repartition(*group).sortWithinPartitions(*group).mapInArrow(partial(_compare, threshold), "a long, b long, n long")
    compared = scratch(compared, "compared")
    counts = compared.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    of = components(compared.where("b is not null").select("a", "b"))
    met = forms.select("rep", "form", "low", "weight").join(counts, "rep", "left").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    met = scratch(met.select("form", "low", "weight", "more", F.coalesce("component", "rep").alias("component")), "forms")
    lowest = met.groupBy("component").agg(F.min("low").alias("component_id"))
    per_form = met.join(lowest, "component").select("form", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    per_form = materialize(per_form, "links")
    ids = materialize(coded.select("vec_id", "form"), "ids")
    scratch.release()
    out = ids.join(per_form, "form", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
