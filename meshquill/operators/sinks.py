"""Sink particles: creation checks, accretion, merging and gravity.

Sinks are few beside cells (codes hold a thousand or so), but nothing here rests on that: pairs meet on bucket keys, and gravity
takes points and sinks in packs of about a fixed size, however many packs there are.
"""

from __future__ import annotations

import math
import tempfile
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairs import within

POSITION, VELOCITY = ("x", "y", "z"), ("vx", "vy", "vz")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; only a local session, which has one machine, may go without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshquill-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def difference(c: str) -> Column:
    return F.col(f"a_{c}") - F.col(f"b_{c}")


def dot(p, q) -> Column:
    return sum((a * b for a, b in zip(p, q)), F.lit(0.0))


def cross(p, q) -> tuple[Column, Column, Column]:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def creation_candidates(cells: DataFrame, sinks: DataFrame, dens_max: float, radius: float) -> DataFrame:
    """Cells (tag, position, dens, gpot, and div, the divergence of the flow) that may become sinks: denser than the limit, with a
    converging flow, no sink within 2 radii, and the least potential of the dense cells within a radius (of equal ones the
    smallest tag)."""
    dense = cells.where((F.col("dens") > dens_max) & (F.col("div") < 0))
    near = within(dense.select("tag", *POSITION), sinks.select("tag", *POSITION), 2 * radius).select(F.col("a_tag").alias("tag"))
    free = dense.join(near, "tag", "left_anti")
    lowest = cells.where(F.col("dens") > dens_max).select("tag", *POSITION, "gpot")
    met = within(free.select("tag", *POSITION, "gpot"), lowest, radius)
    beaten = met.where((F.col("a_tag") != F.col("b_tag")) & (F.struct("b_gpot", "b_tag") < F.struct("a_gpot", "a_tag"))).select(F.col("a_tag").alias("tag"))
    return free.join(beaten, "tag", "left_anti")


#: Of the speed of sound: flows that diverge by less count as converging.
STILL = 1e-5


def converging(candidates: DataFrame, cells: DataFrame, speed: Column, lengths: tuple[int, int, int] | None = None, velocity: tuple[str, str, str] = ("velx", "vely", "velz")) -> DataFrame:
    """Candidates (tag, i, j, k and the cell's velocity) towards which the flow in all of the 26 cells around does not diverge.

    A cell around counts by its velocity relative to the candidate's, along the line between both, which must not exceed STILL times the
    speed of sound (a column of the candidate). cells: i, j, k, velocity; with lengths the mesh repeats; cells that are not there do not count.
    """
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a or b or c)))
    around = candidates.select("tag", *(F.col(x).alias(f"at_{x}") for x in "ijk"), *(F.col(v).alias(f"own_{v}") for v in velocity), speed.alias("speed")).withColumn("step", step)
    for k, (x, s) in enumerate(zip("ijk", "abc")):
        to = F.col(f"at_{x}") + F.col(f"step.{s}")
        around = around.withColumn(x, (F.pmod(to, F.lit(lengths[k])) if lengths else to).cast("long"))
    met = around.join(cells.select(*(F.col(x).cast("long").alias(x) for x in "ijk"), *velocity), ["i", "j", "k"])
    steps = [F.col(f"step.{s}") for s in "abc"]
    outward = dot(steps, [F.col(v) - F.col(f"own_{v}") for v in velocity]) / F.sqrt(dot(steps, steps))
    leaving = met.where(outward > STILL * F.col("speed")).select("tag").distinct()
    return candidates.join(leaving, "tag", "left_anti")


def accreted(gas: DataFrame, sinks: DataFrame, spin: tuple[str, str, str] = ("lx", "ly", "lz")) -> DataFrame:
    """Sinks (tag, mass, position, velocity, spin) after they took gas (sink, mass, position, velocity).

    Mass, momentum, centre of mass and total angular momentum are conserved; gas is summed by sink before it meets the sinks.
    """
    around = cross([F.col(c) for c in POSITION], [F.col(c) for c in VELOCITY])
    sums = [F.sum(F.col("mass") * F.col(c)).alias(f"g_{c}") for c in (*POSITION, *VELOCITY)] + [F.sum(F.col("mass") * a).alias(f"g_{c}") for a, c in zip(around, spin)]
    got = gas.groupBy("sink").agg(F.sum("mass").alias("g_mass"), *sums)
    both = sinks.join(got, F.col("tag") == F.col("sink"), "left").fillna(0.0, ["g_mass", *(f"g_{c}" for c in (*POSITION, *VELOCITY, *spin))])
    mass = F.col("mass") + F.col("g_mass")
    new = {c: (F.col("mass") * F.col(c) + F.col(f"g_{c}")) / mass for c in (*POSITION, *VELOCITY)}
    after = cross([new[c] for c in POSITION], [new[c] for c in VELOCITY])
    spins = [(F.col(c) + F.col(f"g_{c}") + F.col("mass") * b - mass * a).alias(c) for c, b, a in zip(spin, around, after)]
    return both.select("tag", mass.alias("mass"), *(v.alias(c) for c, v in new.items()), *spins, F.col("g_mass").alias("taken"))


def bound_pairs(sinks: DataFrame, radius: float, g: float = 1.0) -> DataFrame:
    """a_tag (lighter; of equal ones the larger tag), b_tag: pairs that are close, approach each other and are bound."""
    s = sinks.select("tag", "mass", *POSITION, *VELOCITY)
    met = within(s, s, radius).where((F.col("a_mass") < F.col("b_mass")) | ((F.col("a_mass") == F.col("b_mass")) & (F.col("a_tag") > F.col("b_tag"))))
    d, v = [difference(c) for c in POSITION], [difference(c) for c in VELOCITY]
    return met.where((dot(d, v) < 0) & (0.5 * dot(v, v) * F.col("r") < g * (F.col("a_mass") + F.col("b_mass"))))


CELL = ("mq_i", "mq_j", "mq_k")
#: Sinks of a list at most (about) that meets another.
CHUNK = 1024


def _heaviest(radius: float, g: float, batches):
    """For each sink of a list the heaviest (of equal ones the smallest tag) it is bound to, of the lists that list meets one after the other."""
    now = at = tags = mass = best = None

    def told():
        got = best[0] > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(tags[got]), pa.array(best[0][got]), pa.array(best[1][got])], ["a_tag", "b_mass", "b_tag"])

    def parts(column):
        flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())[:-1]
        fields = [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]
        return zip(np.split(fields[1], ends), np.split(-fields[0], ends), np.split(np.column_stack(fields[2:]), ends))

    for batch in batches:
        for (a_tags, a_mass, a), (b_tags, b_mass, b) in zip(parts(batch.column(0)), parts(batch.column(1))):
            if now != a_tags[0]:
                if now is not None:
                    yield told()
                now, tags, mass, at = a_tags[0], a_tags.copy(), a_mass.copy(), a.copy()
                best = [np.full(len(tags), -np.inf), np.zeros(len(tags), np.int64)]
            for t in range(0, len(b), 64):  # heaviest first, so what follows is no better than the tile's first one
                m, tag = b_mass[t : t + 64], b_tags[t : t + 64]
                live = np.flatnonzero((mass <= m[0]) & ((best[0] < m[0]) | ((best[0] == m[0]) & (best[1] > tag[0]))))
                if not len(live):
                    break
                d, v = ([at[live, k, None] - b[None, t : t + 64, k] for k in r] for r in (range(3), range(3, 6)))
                r = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
                own, vv = mass[live, None], v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
                good = (r <= radius) & ((own < m) | ((own == m) & (tags[live, None] > tag)))
                good &= (d[0] * v[0] + d[1] * v[1] + d[2] * v[2] < 0) & (0.5 * vv * r < g * (own + m))
                hit = np.flatnonzero(good.any(axis=1))
                first, who = good[hit].argmax(axis=1), live[hit]
                more = (m[first] > best[0][who]) | ((m[first] == best[0][who]) & (tag[first] < best[1][who]))
                best[0][who[more]], best[1][who[more]] = m[first][more], tag[first][more]
    if now is not None:
        yield told()


def heaviest_bound(sinks: DataFrame, radius: float, g: float = 1.0) -> DataFrame:
    """tag, into: for each sink of bound_pairs' lighter ones the heaviest it is bound to (of equal ones the smallest tag).

    Sinks of a cell are dealt to lists of about CHUNK by a hash; lists of neighbouring cells meet, and a worker looks at a tile of pairs at
    a time, heaviest first, until all are settled: no row for a pair. Tags are whole numbers and unique.
    """
    known = " and ".join(f"abs({c}) < double('infinity')" for c in ("mass", *POSITION, *VELOCITY))
    s = sinks.select(F.col("tag").cast("long").alias("tag"), *(F.col(c).cast("double").alias(c) for c in ("mass", *POSITION, *VELOCITY))).where(known)
    s = s.withColumns({n: F.floor(F.col(c) / radius).cast("long") for n, c in zip(CELL, POSITION)})
    dealt = s.join(s.groupBy(*CELL).agg(F.ceil(F.count("*") / CHUNK).alias("mq_n")), list(CELL)).withColumn("mq_chunk", F.pmod(F.xxhash64("tag"), "mq_n"))
    row = F.struct((-F.col("mass")).alias("o"), "tag", *POSITION, *VELOCITY)
    lists_ = cut_lineage(dealt.groupBy(*CELL, "mq_chunk").agg(F.sort_array(F.collect_list(row)).alias("rows")))
    steps = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((i, j, k), "ijk"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    right = lists_.select(*CELL, F.col("rows").alias("b_rows")).withColumn("step", steps).withColumns({n: F.col(n) + F.col(f"step.{x}") for n, x in zip(CELL, "ijk")})
    met = lists_.select(*CELL, F.col("rows").alias("a_rows")).join(right, list(CELL)).select("a_rows", "b_rows")
    found = met.mapInArrow(partial(_heaviest, radius, g), "a_tag long, b_mass double, b_tag long")
    best = found.groupBy("a_tag").agg(F.max(F.struct("b_mass", (-F.col("b_tag")).alias("o"), "b_tag")).alias("to"))
    kind = sinks.schema["tag"].dataType
    return cut_lineage(best.select(F.col("a_tag").cast(kind).alias("tag"), F.col("to.b_tag").cast(kind).alias("into")))


def merged(sinks: DataFrame, radius: float, g: float = 1.0) -> DataFrame:
    """One pass of merging: a sink goes into the heaviest sink it is bound to, if that one does not go into another in this pass.

    Mass, momentum and centre of mass are conserved. Chains take several passes, as they take several steps of a run.
    """
    best = heaviest_bound(sinks, radius, g)
    goes = best.join(best.select(F.col("tag").alias("into")), "into", "left_anti")
    to = sinks.join(goes, "tag", "left").withColumn("into", F.coalesce("into", "tag"))
    mean = [(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in (*POSITION, *VELOCITY)]
    parts = F.sum("parts") if "parts" in sinks.columns else F.count("*")
    return to.groupBy(F.col("into").alias("tag")).agg(parts.alias("parts"), *mean, F.sum("mass").alias("mass"))


def merged_all(sinks: DataFrame, radius: float, g: float = 1.0, passes: int = 64) -> DataFrame:
    """Passes of merging until no two sinks are bound: tag, parts (sinks that went into it), position, velocity and mass."""
    now = cut_lineage(sinks.select("tag", F.lit(1).cast("long").alias("parts"), *POSITION, *VELOCITY, "mass"))
    for _ in range(passes):
        if bound_pairs(now, radius, g).limit(1).count() == 0:
            return now
        now = cut_lineage(merged(now, radius, g))
    raise RuntimeError("merging did not end")


def connected(nodes: DataFrame, links: DataFrame, rounds: int = 1000) -> DataFrame:
    """tag, cluster (smallest tag reachable by links): nodes (tag), links (a_tag, b_tag, both ways).

    Each round a node takes the least label of its neighbours, and the label of its label; lineage is cut each round.
    """
    labels = nodes.select("tag", F.col("tag").alias("cluster"))
    for _ in range(rounds):
        least = links.join(labels, F.col("b_tag") == F.col("tag")).groupBy("a_tag").agg(F.min("cluster").alias("low"))
        step = labels.join(least, F.col("tag") == F.col("a_tag"), "left").select("tag", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"))
        hop = step.select(F.col("tag").alias("cluster"), F.col("cluster").alias("next"))
        step = cut_lineage(step.join(hop, "cluster").select("tag", "was", F.least("cluster", "next").alias("cluster")))
        labels = step.select("tag", "cluster")
        if step.where("was <> cluster").limit(1).count() == 0:
            return labels
    raise RuntimeError("clusters did not settle")


def clusters(points: DataFrame, radius: float, rounds: int = 1000) -> DataFrame:
    """tag, cluster (smallest tag reachable by steps within the radius): sinks made in one step that become one sink.

    Points of one cell, whose diagonal is just below the radius, are all linked, so cells stand for them: no list of all near pairs is made.
    Cells whose central points are within the radius are linked first. Of cells that this leaves apart, points meet only where they are within
    the radius of the other cell's bounds; that finds the links that are left, so the result is exact. A point without a finite place is alone.
    """
    side = radius / math.sqrt(3) * (1 - 1e-9)
    finite = " and ".join(f"abs({c}) < double('infinity')" for c in POSITION)
    given = points.select("tag", *(F.col(c).cast("double").alias(c) for c in POSITION))
    p = given.where(finite).withColumns({n: F.floor(F.col(c) / side).cast("long") for n, c in zip(CELL, POSITION)})
    off = [F.col(c) - (F.col(n) + 0.5) * side for n, c in zip(CELL, POSITION)]
    bounds = [f(c).alias(f"{e}_{c}") for e, f in (("lo", F.min), ("hi", F.max)) for c in POSITION]
    cells = cut_lineage(p.groupBy(*CELL).agg(F.min("tag").alias("tag"), F.min(F.struct(dot(off, off).alias("o"), *POSITION)).alias("mid"), *bounds))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    step = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(d, "ijk"))) for d in steps)))
    named = lambda df, q: df.select(*(F.col(c).alias(f"{q}_{c}") for c in ("tag", "mid", *(f"{e}_{c}" for e in ("lo", "hi") for c in POSITION))), *CELL)
    one = named(cells, "a").withColumn("step", step).withColumns({n: F.col(n) + F.col(f"step.{x}") for n, x in zip(CELL, "ijk")}).drop("step")
    gap = [F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")) for c in POSITION]
    reach = radius * radius * (1 + 1e-9)
    near = cut_lineage(one.join(named(cells, "b"), list(CELL)).where(dot(gap, gap) <= reach).drop(*CELL))
    apart = [F.col(f"a_mid.{c}") - F.col(f"b_mid.{c}") for c in POSITION]
    both = lambda df: df.select("a_tag", "b_tag").unionAll(df.select(F.col("b_tag").alias("a_tag"), F.col("a_tag").alias("b_tag")))
    first = connected(cells, both(near.where(F.sqrt(dot(apart, apart)) <= radius)), rounds)
    of = lambda q, labels: labels.select(F.col("tag").alias(f"{q}_tag"), F.col("cluster").alias(f"{q}_in"))
    open_ = cut_lineage(near.join(of("a", first), "a_tag").join(of("b", first), "b_tag").where("a_in <> b_in").drop("a_mid", "b_mid"))
    told = p.join(cells.select(*CELL, F.col("tag").alias("cell")), list(CELL)).select("cell", *POSITION).distinct()

    def reaching(q: str, other: str) -> DataFrame:
        beyond = [F.greatest(F.lit(0.0), F.col(f"{other}_lo_{c}") - F.col(c), F.col(c) - F.col(f"{other}_hi_{c}")) for c in POSITION]
        met = open_.join(told.withColumnRenamed("cell", f"{q}_tag"), f"{q}_tag").where(dot(beyond, beyond) <= reach)
        return met.select("a_tag", "b_tag", "a_in", "b_in", *(F.col(c).alias(f"{q}_{c}") for c in POSITION))

    d = [difference(c) for c in POSITION]
    met = reaching("a", "b").join(reaching("b", "a").drop("a_in", "b_in"), ["a_tag", "b_tag"]).where(F.sqrt(dot(d, d)) <= radius)
    more = cut_lineage(met.select(F.col("a_in").alias("a_tag"), F.col("b_in").alias("b_tag")).distinct())
    last = connected(first.select(F.col("cluster").alias("tag")).distinct(), both(more), rounds)
    whole = first.join(last.select(F.col("tag").alias("cluster"), F.col("cluster").alias("whole")), "cluster").select(F.col("tag").alias("cell"), "whole")
    found = p.join(cells.select(*CELL, F.col("tag").alias("cell")), list(CELL)).join(whole, "cell").select("tag", F.col("whole").alias("cluster"))
    return found.unionAll(given.where(f"not coalesce({finite}, false)").select("tag", F.col("tag").alias("cluster")))


def softened(r: Column, soft: float, kernel: str = "linear") -> Column:
    """Acceleration over mass and distance vector, for r > 0: that of a point beyond the softening length, within it linear or a spline."""
    free = 1 / (r * r * r)
    if kernel == "linear":
        return F.when(r < soft, F.lit(1 / soft**3)).otherwise(free)
    h = 2 / soft
    q = r * h
    inner = h * h * (4 / 3 * q - 1.2 * q * q * q + 0.5 * q * q * q * q) / r
    outer = h * h * (8 / 3 * q - 3 * q * q + 1.2 * q * q * q - q * q * q * q / 6 - 1 / (15 * q * q)) / r
    return F.when(r >= soft, free).when(q >= 1, outer).when(q > 1e-5, inner).otherwise(0.0)


def well(r: Column, soft: float) -> Column:
    """Potential over mass of the linear kernel; constant terms make it continuous."""
    return F.when(r < soft, r * r / (2 * soft**3) - 3 / (2 * soft)).otherwise(-1 / F.greatest(r, F.lit(float(soft))))


#: Points and sinks of a pack at most and, where shares are few, points at least (about); places of a tile and sinks at a time in a worker;
#: how many shares the work of one sum has at least, and tasks at most.
PACK, LEAST, TILE, ROW, SHARES, TASKS = 8192, 1024, 32, 256, 96, 2000
PULLS = ("ax", "ay", "az", "phi")


# Parts of kernels: for squared distances the acceleration over mass and distance vector and, if that is asked for, the depth (potential over
# mass without its sign). They work in place where they can, for an array is passed over many times.
def _lack(r: np.ndarray, end: float) -> np.ndarray:
    """What a distance lacks to an end, 0 beyond it."""
    left = end - r
    left += np.abs(left)
    left *= 0.5
    return left


def _depth(r: np.ndarray, left: np.ndarray, soft: float) -> np.ndarray:
    more = 2 * soft - left
    more *= left
    more *= 1 / (2 * soft**3)
    more += 1 / (r + left)
    return more


def _inside(r2: np.ndarray, soft: float) -> np.ndarray:
    depth = r2 * (-1 / (2 * soft**3))
    depth += 3 / (2 * soft)
    return depth


def _far(r2: np.ndarray, soft: float, deep: bool):
    """Beyond the softening length."""
    if not deep:
        cube = np.sqrt(r2)
        cube *= r2
        return np.divide(1, cube, out=cube), None
    depth = np.sqrt(r2)
    np.divide(1, depth, out=depth)
    weight = depth * depth
    weight *= depth
    return weight, depth


def _plummer(r2: np.ndarray, soft: float, deep: bool):
    return _far(r2 + soft * soft, soft, deep)


def _point(r2: np.ndarray, soft: float, deep: bool):
    """Without softening, 0 at the very place."""
    weight, depth = _far(r2, soft, True)
    weight[r2 == 0], depth[r2 == 0] = 0.0, 0.0
    return weight, depth


def _linear(r2: np.ndarray, soft: float, deep: bool):
    """The linear kernel at any distance."""
    r = np.sqrt(r2)
    left = _lack(r, soft)
    far = r + left
    return 1 / (far * far * far), _depth(r, left, soft) if deep else None


def _hard(r2: np.ndarray, soft: float, deep: bool):
    """The linear kernel where distances may be infinite."""
    r = np.sqrt(r2)
    depth = 1 / np.maximum(r, soft)
    return depth * depth * depth, np.where(r < soft, _inside(r2, soft), depth)


def _outer(r2: np.ndarray, soft: float, deep: bool):
    """The spline from a half to the whole of the softening length."""
    h = 2 / soft
    r = np.sqrt(r2)
    weight = r * (-(h**6) / 6)
    weight += 1.2 * h**5
    weight *= r
    weight -= 3 * h**4
    weight *= r
    weight += 8 / 3 * h**3
    r *= r2
    weight -= np.divide(1 / 15, r, out=r)
    return weight, _inside(r2, soft) if deep else None


def _core(r2: np.ndarray, soft: float, deep: bool):
    """The spline within a half of the softening length, but for its very middle."""
    h = 2 / soft
    weight = np.sqrt(r2)
    weight *= 0.5 * h**6
    weight -= 1.2 * h**5
    weight *= r2
    weight += 4 / 3 * h**3
    return weight, _inside(r2, soft) if deep else None


def _heart(r2: np.ndarray, soft: float, deep: bool):
    weight, depth = _core(r2, soft, deep)
    weight *= r2 > (5e-6 * soft) ** 2
    return weight, depth


def _rim(r: np.ndarray, left: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """left**4 * (a + b r + c r**2)"""
    out = left * left
    out *= out
    factor = r * c
    factor += b
    factor *= r
    factor += a
    out *= factor
    return out


def _edge(r2: np.ndarray, soft: float, deep: bool, core: bool = False):
    """The spline from a half of the softening length on: the share of the mass within r, over r**3, without a choice by pair."""
    h = 2 / soft
    r = np.sqrt(r2)
    left = _lack(r, soft)
    depth = _depth(r, left, soft) if deep else None
    share = _rim(r, left, h**4 / 15, h**5 * 2 / 15, h**6 / 6)
    if core:
        share -= _rim(r, _lack(r, soft / 2), h**4 / 15, h**5 * 4 / 15, h**6 * 2 / 3)
    np.subtract(1, share, out=share)
    r *= r2
    share /= r
    return share, depth


def _spline(r2: np.ndarray, soft: float, deep: bool):
    """The spline at any distance that is not far below the softening length."""
    return _edge(r2, soft, deep, True)


def _close(r2: np.ndarray, soft: float, deep: bool):
    """The spline at any distance, 0 included."""
    r = np.sqrt(r2)
    depth = 1 / np.maximum(r, soft)
    weight = depth * depth * depth
    inside = np.nonzero(r < soft)
    near = r[inside]
    h = 2 / soft
    q = near * h
    inner = h * h * (4 / 3 * q - 1.2 * q * q * q + 0.5 * q * q * q * q) / near
    outer = h * h * (8 / 3 * q - 3 * q * q + 1.2 * q * q * q - q * q * q * q / 6 - 1 / (15 * q * q)) / near
    weight[inside] = np.where(q >= 1, outer, np.where(q > 1e-5, inner, 0.0))
    depth[inside] = 3 / (2 * soft) - r2[inside] / (2 * soft**3)
    return weight, depth


def tiles(at: np.ndarray) -> list[np.ndarray]:
    """Row numbers of TILE places that are near each other; one tile has the rest."""
    open_, done = [np.arange(len(at))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= TILE:
            done.append(rows)
            continue
        half = -(-len(rows) // TILE) // 2 * TILE
        order = np.argpartition(at[rows, np.argmax(np.ptp(at[rows], axis=0))], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return done


def _direct(at: np.ndarray, x: np.ndarray, mass: np.ndarray, soft: float, lengths, kind, deep: bool) -> np.ndarray:
    """The sums of a tile from the differences of all pairs."""
    out = np.zeros((len(at), 4))
    for i in range(0, len(mass), ROW):
        d, m = [x[k, i : i + ROW] - at[:, k, None] for k in range(3)], mass[i : i + ROW]
        for c, length in zip(d, lengths or ()):
            c -= length * np.rint(c / length)
        weight, depth = kind(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], soft, deep)
        weight *= m
        for k in range(3):
            out[:, k] += np.einsum("ij,ij->i", weight, d[k])
        if deep:
            out[:, 3] -= depth @ m
    return out


def pulls(at: np.ndarray, held: np.ndarray, soft: float, g: float, kernel: str, lengths, deep: bool = True, cut: list[np.ndarray] | None = None) -> np.ndarray:
    """ax, ay, az, phi (0 unless deep) at places (rows of x, y, z) due to masses (rows of x, y, z, mass), a tile of places at a time.

    By their distance from the middle of a tile, masses are sorted into those of which all pairs lie in one part of the kernel and those
    on an edge of it. Squared distances and the sums are products of matrices about that middle, exact to rounding. Differences of pairs are
    taken where a mass is about as near as the tile is large, or has not the same periodic image for the whole tile.
    """
    out = np.empty((len(at), 4))
    x, mass = np.ascontiguousarray(held[:, :3].T), g * held[:, 3]
    box = None if lengths is None else np.array(lengths, float)[:, None]
    finite = np.isfinite(mass)
    tame = bool(np.isfinite(held).all() and np.isfinite(at).all())
    if soft == 0:
        kinds, close = [_far], _point
    else:
        kinds, close = {"plummer": ([_plummer], _plummer), "linear": ([_linear, _far], _linear), "spline": ([_spline, _far, _outer, _core, _edge], _close)}[kernel]
    if not tame and close is _linear:
        close = _hard
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for rows in tiles(at) if cut is None else cut:
            middle = (at[rows].min(axis=0) + at[rows].max(axis=0)) / 2
            a, b = at[rows] - middle, x - middle[:, None]
            reach = math.sqrt((a * a).sum(axis=1).max()) * (1 + 1e-9)
            if not reach < math.inf:
                out[rows] = _direct(at[rows], x, mass, soft, lengths, close, deep)
                continue
            way = np.zeros(len(mass), np.int8)
            if box is not None:
                b -= box * np.rint(b / box)
                way[(np.abs(b) >= box / 2 - np.abs(a).max(axis=0)[:, None] - 1e-9 * box).any(axis=0)] = len(kinds)  # several images
            b2 = b[0] * b[0] + b[1] * b[1] + b[2] * b[2]
            dist = np.sqrt(b2)
            same, apart = way == 0, dist > 1.5 * reach
            if len(kinds) > 1:
                way[dist >= soft + reach] += 1
            if len(kinds) > 2:
                way[same & (dist >= soft / 2 + reach) & (dist < soft + reach)] = 4
                way[same & (dist >= soft / 2 + reach) & (dist <= soft - reach)] = 2
                core = same & (dist <= soft / 2 - reach)
                way[core] = 3
                apart |= core & (dist > reach + 1e-5 * soft)
            way[~(apart & finite & (dist < np.inf))] = len(kinds) + 2
            ways = [*kinds, kinds[0], kinds[1] if len(kinds) > 1 else None, _heart if tame and close is _close and 5 * reach <= soft else close]
            order = np.argsort(way, kind="stable")
            ends = np.cumsum(np.bincount(way, minlength=len(ways)))
            m = mass[order]
            b = np.take(b, order, axis=1)
            left = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a))])
            right = np.vstack([b, np.ones(len(m)), b2[order]])
            moments = np.vstack([b * m, m]).T
            sums, total = np.zeros((len(a), 4)), np.zeros((len(a), 4))
            for n, (kind, lo, hi) in enumerate(zip(ways, [0, *ends], ends)):
                if n >= len(kinds) and hi > lo:
                    total += _direct(at[rows], x[:, order[lo:hi]], m[lo:hi], soft, lengths, kind, deep)
                    continue
                for i in range(lo, hi, ROW):
                    part = slice(i, min(i + ROW, hi))
                    weight, depth = kind(left @ right[:, part], soft, deep)
                    sums += weight @ moments[part]
                    if deep:
                        total[:, 3] -= depth @ m[part]
            total[:, :3] += sums[:, :3] - a * sums[:, 3:]
            out[rows] = total
    return out


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of structs of numbers, each as rows of a matrix."""
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(np.column_stack([f.to_numpy(zero_copy_only=False) for f in flat.flatten()]), ends[:-1])


def _summed(soft, g, kernel, lengths, names, batches):
    """The sums of each pack of points over the packs of sinks it meets one after the other."""
    now, at, cut, total, deep = None, None, None, None, "phi" in names

    def told():
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*at.T, *total.T[: len(names)])], [*(f"mq_{c}" for c in POSITION), *names])

    for batch in batches:
        for pack, places, held in zip(batch.column(0).to_pylist(), lists(batch.column(1)), lists(batch.column(2))):
            if pack != now:
                if now is not None:
                    yield told()
                now, at, total = pack, places.copy(), np.zeros((len(places), 4))
                cut = tiles(at)
            total += pulls(at, held, soft, g, kernel, lengths, deep, cut)
    if now is not None:
        yield told()


def packs_of_near(places: DataFrame, n: int) -> DataFrame:
    """mq_p (from 0), mq_p_rows: places dealt to about n lists by ranges along a Morton curve."""
    from .tree import morton_number  # noqa: PLC0415  (the tree imports this module)

    known = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in POSITION}
    ends = places.agg(*(f(v).alias(f"{e}_{c}") for c, v in known.items() for e, f in (("lo", F.min), ("hi", F.max)))).first()
    cells = [F.coalesce(F.floor((v - F.lit(ends[f"lo_{c}"])) / max((ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0), 1e-300) * 1023), F.lit(0)) for c, v in known.items()]
    ranged = places.repartitionByRange(n, morton_number(cells, 10), *POSITION).withColumn("mq_p", F.spark_partition_id().cast("long"))
    return cut_lineage(ranged.groupBy("mq_p").agg(F.collect_list(F.struct(*POSITION)).alias("mq_p_rows")))


def gravity(points: DataFrame, sinks: DataFrame, soft: float, g: float = 1.0, kernel: str = "linear", lengths: tuple[float, float, float] | None = None, potential: bool = True) -> DataFrame:
    """points with ax, ay, az and, with potential, phi due to sinks (mass, position); within the softening length the kernel is linear or a spline, or
    it is Plummer's.

    Every pair counts, so the work grows with the product of both; points at one place are summed once, sinks at one place are one mass. Sinks
    are packed by a hash into lists of about PACK, points by ranges along a Morton curve, so that near points share a list; a pack of points meets the
    packs of sinks in an equi-join that deals pairs of packs to about SHARES keys at least, and a worker sums over a tile of pairs at a time: no
    broadcast, and no row for a pair. With lengths the nearest periodic image pulls. A sink exerts nothing on a point at its own place; phi is that
    of the linear kernel (constant terms make it continuous), or Plummer's. Sinks with a null are left out; a point with a null place has null sums.
    """
    names = PULLS if potential else PULLS[:3]
    where = [F.col(c).cast("double").alias(c) for c in POSITION]
    places = cut_lineage(points.select(*where).where(" and ".join(f"{c} is not null" for c in POSITION)).distinct())
    held = sinks.select(*where, F.col("mass").cast("double").alias("mass")).where(" and ".join(f"{c} is not null" for c in (*POSITION, "mass")))
    held = cut_lineage(held.groupBy(*POSITION).agg(F.sum("mass").alias("mass")))
    along = -(-held.count() // PACK)
    if not along:
        return points.withColumns({n: F.lit(0.0) for n in names})
    n = places.count()
    across = max(1, -(-n // PACK), min(-(-n // min(PACK, LEAST)), -(-SHARES // along)))
    left = packs_of_near(places, across)
    across = (left.agg(F.max("mq_p")).first()[0] or 0) + 1
    slots = min(along, -(-SHARES // across))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    right = held.groupBy(F.pmod(F.xxhash64(*POSITION), F.lit(along)).alias("mq_s")).agg(F.collect_list(F.struct(*POSITION, "mass")).alias("mq_s_rows"))
    right = right.select("mq_s_rows", F.pmod("mq_s", F.lit(slots)).cast("long").alias("mq_slot"), numbers(across).alias("mq_p"))
    tasks = min(across * slots, TASKS)
    dealt = (df.repartition(tasks, "mq_p", "mq_slot") for df in (left.withColumn("mq_slot", numbers(slots)), right))
    met = next(dealt).join(next(dealt), ["mq_p", "mq_slot"]).select("mq_p", "mq_p_rows", "mq_s_rows")
    kind = ", ".join(f"{n} double" for n in (*(f"mq_{c}" for c in POSITION), *names))
    sums = met.mapInArrow(partial(_summed, soft, g, kernel, lengths, names), kind).groupBy(*(f"mq_{c}" for c in POSITION)).agg(*(F.sum(n).alias(n) for n in names))
    same = [points[c].cast("double") == F.col(f"mq_{c}") for c in POSITION]
    return points.join(sums, same, "left").select(*(points[c] for c in points.columns), *names)


def control_volume_checks(cells: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Candidates (of creation_candidates) whose control volume, the cells within a radius, is Jeans unstable and bound.

    cells: tag, position, vol, dens, pres, gpot, velx, vely, velz, magx, magy, magz. Heat is the sum of pressure over volume, kinetic
    energy is that about the centre of mass, and potential energy is counted from the highest potential in the volume.
    """
    v, b = ("velx", "vely", "velz"), ("magx", "magy", "magz")
    met = within(candidates.select("tag", *POSITION), cells.select("tag", *POSITION, "vol", "dens", "pres", "gpot", *v, *b), radius)
    mass = F.col("b_dens") * F.col("b_vol")
    sums = [F.sum(mass * F.col(f"b_{c}")).alias(f"p_{c}") for c in v] + [F.sum(mass * F.col(f"b_{c}") * F.col(f"b_{c}")).alias(f"k_{c}") for c in v]
    field = sum((F.col(f"b_{c}") * F.col(f"b_{c}") for c in b), F.lit(0.0))
    got = met.groupBy("a_tag").agg(F.sum(mass).alias("mass"), F.sum(F.col("b_pres") * F.col("b_vol")).alias("heat"), F.max("b_gpot").alias("top"), F.sum(mass * F.col("b_gpot")).alias("pot"), (F.sum(field * F.col("b_vol")) / (8 * math.pi)).alias("mag"), *sums)
    moving = 0.5 * sum((F.col(f"k_{c}") - F.col(f"p_{c}") * F.col(f"p_{c}") / F.col("mass") for c in v), F.lit(0.0))
    well = F.col("top") * F.col("mass") - F.col("pot")
    good = got.where((2 * F.col("heat") + F.col("mag") <= well) & (F.col("heat") + moving + F.col("mag") <= well)).select(F.col("a_tag").alias("tag"))
    return candidates.join(good, "tag", "left_semi")


def heating(cells: DataFrame, sinks: DataFrame, radius: float, soft: float, age: float) -> DataFrame:
    """tag and flux: the light of sinks (luminosity, created) within a radius over 4 pi r**2, which sets in linearly over a time (now is 0)."""
    met = within(cells.select("tag", *POSITION), sinks.select("tag", *POSITION, "luminosity", "created"), radius)
    r = F.greatest(F.col("r"), F.lit(float(soft)))
    ramp = F.least(F.lit(1.0), -F.col("b_created") / age)
    return met.groupBy(F.col("a_tag").alias("tag")).agg(F.sum(F.col("b_luminosity") * ramp / (4 * math.pi * r * r)).alias("flux"))


def trilinear(points: DataFrame, grid: DataFrame, step: tuple[float, float, float], names: tuple[str, ...]) -> DataFrame:
    """points with values read from a table on a regular grid (i, j, k from 0; coordinates are those from the origin), as a table of
    periodic force corrections is: each point meets its eight corners in an equi-join and sums them by weight."""
    corners = points
    for c, i, d in zip(POSITION, "ijk", step):
        low = F.floor(F.col(c) / d).cast("long")
        ends = F.array(F.struct(low.alias("at"), (1 - (F.col(c) / d - low)).alias("w")), F.struct((low + 1).alias("at"), (F.col(c) / d - low).alias("w")))
        corners = corners.withColumn(f"mq_{i}", F.explode(ends))
    corners = corners.select("tag", (F.col("mq_i.w") * F.col("mq_j.w") * F.col("mq_k.w")).alias("mq_w"), *(F.col(f"mq_{i}.at").alias(i) for i in "ijk"))
    met = corners.where("mq_w > 0").join(grid, ["i", "j", "k"]).groupBy("tag").agg(*(F.sum(F.col(n) * F.col("mq_w")).alias(n) for n in names))
    return points.join(met, "tag", "left")


def refine_marks(blocks: DataFrame, sinks: DataFrame, radius: float) -> DataFrame:
    """Blocks (bounds lo_, hi_) that a sink's sphere reaches, by buckets of the radius."""
    reached, at = blocks, sinks.select(F.col("tag").alias("sink"), *(F.col(c).alias(f"s_{c}") for c in POSITION))
    for c in POSITION:
        reached = reached.withColumn(f"q{c}", F.explode(F.sequence(F.floor((F.col(f"lo_{c}") - radius) / radius).cast("long"), F.floor((F.col(f"hi_{c}") + radius) / radius).cast("long"))))
        at = at.withColumn(f"q{c}", F.floor(F.col(f"s_{c}") / radius).cast("long"))
    gap = [F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"s_{c}"), F.col(f"s_{c}") - F.col(f"hi_{c}")) for c in POSITION]
    met = reached.join(at, [f"q{c}" for c in POSITION]).where(dot(gap, gap) <= radius * radius)
    return met.groupBy("block").agg(F.countDistinct("sink").alias("sinks"))


def time_step(sinks: DataFrame, dx: float, factor: float = 0.5) -> DataFrame:
    """The longest step in which no sink crosses more than a share of a cell; null if all rest."""
    speed = F.greatest(*(F.abs(c) for c in VELOCITY))
    return sinks.agg((factor * dx / F.max(F.when(speed > 0, speed))).alias("dt"))
