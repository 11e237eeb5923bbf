"""Queries of views, blocks, halos and sinks on the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry, series, sinks, stats
from .queries import BLOCKS, CELLS, PHASE, blocks, cells, phase, query, rounded

# ---------------------------------------------------------------- views
SEEN = """SELECT 5e-1 + i AS x, 5e-1 + j AS y, 5e-1 + k AS z, dvol AS d, pres, dens, velx, vely, velz FROM c"""
BOUNDS = [(2.0, 14.0), (2.0, 14.0), (1.0, 7.0)]
_over = lambda c, d, lo, hi: f"greatest(0e0, least({c} + {d} / 2, {hi}) - greatest({c} - {d} / 2, {lo}))"


def _maps_sql(rows, depth="(6e0)", zlo="1e0", zhi="7e0", weight="seen"):
    w = f"({weight} * {_over('x', 'e', '(2e0 + ix * 2e0)', '(4e0 + ix * 2e0)')} * {_over('y', 'e', '(2e0 + iy * 2e0)', '(4e0 + iy * 2e0)')} * (least(z + d / 2, {zhi}) - greatest(z - d / 2, {zlo})))"
    return f"""{rows}, q AS (SELECT *, ix::BIGINT AS px, iy::BIGINT AS py, {w} AS w FROM s, range(6) a(ix), range(6) b(iy) WHERE x + e / 2 >= 2e0 AND x - e / 2 <= 14e0 AND y + e / 2 >= 2e0 AND y - e / 2 <= 14e0 AND z + d / 2 >= {zlo} AND z - d / 2 <= {zhi}),
r AS (SELECT * FROM q WHERE {_over('x', 'e', '(2e0 + ix * 2e0)', '(4e0 + ix * 2e0)')} > 1e-9 AND {_over('y', 'e', '(2e0 + iy * 2e0)', '(4e0 + iy * 2e0)')} > 1e-9)
SELECT px AS ix, py AS iy, round(sum(w) / (4e0 * {depth}), 3) AS weight, round(sum(w) / 4e0, 3) AS moment_0, round(sum(v * w) / sum(w), 4) AS moment_1, round(sqrt(greatest(0e0, sum(v * v * w) / sum(w) - pow(sum(v * w) / sum(w), 2))), 3) AS moment_2 FROM r GROUP BY 1, 2 HAVING sum(w) > 0"""


def _seen_cells(spark, sf):
    return cells(spark, sf).withColumns({a: F.col(c) + 0.5 for a, c in zip("xyz", "ijk")} | {f"d{a}": F.col("dvol") for a in "xyz"})


def _tidy(df):
    return rounded(df.where("weight > 0"), weight=3, moment_0=3, moment_1=4, moment_2=3)


@query(_maps_sql(f"WITH c AS ({CELLS}), s AS (SELECT x, y, z, d, d AS e, pres AS v, dens AS seen FROM ({SEEN}))"))
def moment_maps(spark, sf):
    return _tidy(geometry.moment_maps(_seen_cells(spark, sf), F.col("pres"), BOUNDS, 2.0, (6, 6), F.col("dens")))


@query(_maps_sql(f"WITH c AS ({CELLS}), s AS (SELECT x, y, z, d, d AS e, velz AS v, 1e0 AS seen FROM ({SEEN}))", depth="(1e0)", zlo="35e-1", zhi="45e-1"))
def slice_map(spark, sf):
    bounds = geometry.view_range(BOUNDS, 1.0, slice_=True)
    return _tidy(geometry.moment_maps(_seen_cells(spark, sf), F.col("velz"), bounds, 2.0, (6, 6)))


@query(_maps_sql(f"WITH c AS ({CELLS}), s AS (SELECT x, y, z, d, d AS e, dens AS v, pres AS seen FROM ({SEEN}))"))
def zoomed_map(spark, sf):
    """The middle three quarters of a domain by a zoom of 4/3."""
    bounds = geometry.view_range([(0.0, 16.0), (0.0, 16.0), (0.0, 8.0)], 1.0, zoom=4 / 3)
    return _tidy(geometry.moment_maps(_seen_cells(spark, sf), F.col("dens"), bounds, 2.0, (6, 6), F.col("pres")))


_c, _s = repr(math.cos(math.radians(20))), repr(math.sin(math.radians(20)))
_r = "sqrt(pow(x - 8e0, 2) + pow(y - 8e0, 2) + pow(z - 4e0, 2))"


@query(_maps_sql(f"""WITH c AS ({CELLS}), t AS (SELECT *, CASE WHEN {_r} > 6e0 THEN exp(-({_r} - 6e0) / 2e0) ELSE 1e0 END AS taper FROM ({SEEN})),
t2 AS (SELECT (x - 8e0) * {_c} - (y - 8e0) * {_s} + 8e0 AS x, (x - 8e0) * {_s} + (y - 8e0) * {_c} + 8e0 AS y, z, d, velx * {_s} + vely * {_c} AS v, dens, taper FROM t),
s AS (SELECT (x - 8e0) * 2e1 / (2e1 + z - 4e0) + 8e0 AS x, (y - 8e0) * 2e1 / (2e1 + z - 4e0) + 8e0 AS y, z, d, d * 2e1 / (2e1 + z - 4e0) AS e, v, dens * pow(2e1 / (2e1 + z - 4e0), 2) * taper * 2 / 25e-1 * (1 + 5e-1 * (7e0 - z) / 6e0) AS seen FROM t2)"""))
def turned_view(spark, sf):
    out = geometry.moment_maps(_seen_cells(spark, sf), F.col("vely"), BOUNDS, 2.0, (6, 6), F.col("dens"), turn=((0.0, 0.0, 1.0), 20.0), focal=20.0, sphere=(6.0, 8.0), opaque=0.5, vector=("velx", "vely", "velz"))
    return _tidy(out)


@query(f"""WITH p AS ({PHASE}), s AS (SELECT * FROM (VALUES (-1), (0), (1)) t(s)), r AS (SELECT tag, type, x + a.s AS x, y + b.s AS y, z + c.s AS z FROM p, s a, s b, s c),
t AS (SELECT tag, CASE WHEN type = 2 THEN 0 ELSE 1 END AS type, x * {_c} - y * {_s} AS x, x * {_s} + y * {_c} AS y, z FROM r WHERE sqrt(x * x + y * y + z * z) <= 5e-1)
SELECT tag, CAST(type AS INT) AS type, round(x * 3e0 / (3e0 + z), 8) + 0e0 AS x, round(y * 3e0 / (3e0 + z), 8) + 0e0 AS y FROM t WHERE x * 3e0 / (3e0 + z) BETWEEN -3e-1 AND 3e-1 AND y * 3e0 / (3e0 + z) BETWEEN -3e-1 AND 3e-1 AND z BETWEEN -3e-1 AND 3e-1""")
def particles_on_map(spark, sf):
    p = phase(spark, sf).select("tag", "type", "x", "y", "z")
    out = geometry.particles_on_map(p, [(-0.3, 0.3)] * 3, (1.0, 1.0, 1.0), turn=((0.0, 0.0, 1.0), 20.0), focal=3.0, sphere=(0.5, 0.8))
    return out.select("tag", F.col("type").cast("int").alias("type"), *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("x", "y")))


@query(f"""WITH p AS ({PHASE}), s AS (SELECT tag, x, y, mass FROM p WHERE type = 2), g AS (SELECT *, CAST(floor((x - 1e-1 + 1e0) / 5e-2) AS BIGINT) AS x0, CAST(floor((x + 1e-1 + 1e0) / 5e-2) AS BIGINT) AS x1, CAST(floor((y - 1e-1 + 1e0) / 5e-2) AS BIGINT) AS y0, CAST(floor((y + 1e-1 + 1e0) / 5e-2) AS BIGINT) AS y1 FROM s),
q AS (SELECT tag, mass, a.v AS ix, b.v AS iy, sqrt(greatest(0e0, 1e-2 - pow((a.v + 5e-1) * 5e-2 - 1e0 - x, 2) - pow((b.v + 5e-1) * 5e-2 - 1e0 - y, 2))) AS h FROM g, range(-20, 80) a(v), range(-20, 80) b(v) WHERE a.v BETWEEN x0 AND x1 AND b.v BETWEEN y0 AND y1),
w AS (SELECT *, h / sum(h) OVER (PARTITION BY tag) AS share FROM q) SELECT ix, iy, round(sum(mass * share), 6) AS value FROM w WHERE h > 0 AND ix BETWEEN 0 AND 39 AND iy BETWEEN 0 AND 39 GROUP BY 1, 2""")
def starfield_map(spark, sf):
    p = phase(spark, sf).where("type = 2").select("tag", "x", "y", F.col("mass").alias("light"))
    return rounded(geometry.starfield(p, 0.1, (-1.0, -1.0), 0.05, (40, 40)), value=6)


# ---------------------------------------------------------------- blocks
_geo = f"WITH b AS ({BLOCKS}), c AS (SELECT CAST(l_orderkey % 25 AS INT) AS block, CAST(l_partkey % 4 AS INT) AS i, CAST(l_suppkey % 4 AS INT) AS j, l_linenumber % 4 AS k, l_quantity AS dens FROM lineitem)"


def _blocked(spark, sf):
    return spark.sql("SELECT CAST(l_orderkey % 25 AS INT) AS block, CAST(l_partkey % 4 AS INT) AS i, CAST(l_suppkey % 4 AS INT) AS j, l_linenumber % 4 AS k, l_quantity AS dens FROM {t}", t=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query(_geo + " SELECT block, count(*) AS n, round(sum(dens * (hi_x - lo_x) / 4 * (hi_y - lo_y) / 4 * (hi_z - lo_z) / 4), 6) AS mass, round(avg(lo_x + (i + 5e-1) * (hi_x - lo_x) / 4), 7) AS x, round(avg(lo_z + (k + 5e-1) * (hi_z - lo_z) / 4), 7) AS z FROM c JOIN b USING (block) WHERE node_type = 1 GROUP BY 1")
def leaf_cells_with_geometry(spark, sf):
    g = geometry.with_geometry(_blocked(spark, sf), blocks(spark, sf), 4)
    return g.groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum(F.col("dens") * F.col("vol")), 6).alias("mass"), F.round(F.avg("x"), 7).alias("x"), F.round(F.avg("z"), 7).alias("z"))


@query(f"WITH p AS ({PHASE}) SELECT tag, CAST(trunc((x + 1e0) / 5e-1) AS BIGINT) AS block, CAST(trunc((x + 1e0 - 5e-1 * trunc((x + 1e0) / 5e-1)) / 625e-4) AS BIGINT) AS cell FROM p")
def cells_of_points(spark, sf):
    p = phase(spark, sf).withColumn("block", geometry.cell_of(F.col("x"), F.lit(-1.0), F.lit(0.5)))
    return p.select("tag", "block", geometry.cell_of(F.col("x"), F.col("block") * 0.5 - 1.0, F.lit(0.0625)).alias("cell"))


@query(f"""WITH b AS ({BLOCKS}) SELECT count(*) AS blocks, sum(CASE WHEN node_type = 1 THEN 1 ELSE 0 END)::BIGINT AS leaves, min(level) AS min_level, max(level) AS max_level, min(CASE WHEN node_type = 1 THEN (hi_x - lo_x) / 8 END) AS min_dx, max(CASE WHEN node_type = 1 THEN (hi_x - lo_x) / 8 END) AS max_dx,
 min(lo_x) AS lo_x, min(lo_y) AS lo_y, min(lo_z) AS lo_z, max(hi_x) AS hi_x, max(hi_y) AS hi_y, max(hi_z) AS hi_z, (max(hi_x) - min(lo_x)) * (max(hi_y) - min(lo_y)) * (max(hi_z) - min(lo_z)) AS volume, CAST(round((max(hi_x) - min(lo_x)) / min(CASE WHEN node_type = 1 THEN (hi_x - lo_x) / 8 END)) AS BIGINT) AS finest FROM b""")
def grid_report(spark, sf):
    return geometry.block_summary(blocks(spark, sf), 8)


_fine = "SELECT i * 1e0 + 5e-1 AS x, j * 1e0 + 5e-1 AS y, k * 1e0 + 5e-1 AS z, 1e0 AS dx, v FROM (SELECT l_partkey % 8 AS i, l_suppkey % 8 AS j, l_orderkey % 8 AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""WITH c AS ({_fine}), b AS (SELECT range AS block, (range % 2) * 4e0 AS lo_x, (range // 2 % 2) * 4e0 AS lo_y, (range // 4) * 4e0 AS lo_z FROM range(8)), g AS (SELECT * FROM b, range(-1, 3) a(i), range(-1, 3) d(j), range(-1, 3) e(k) WHERE NOT (i BETWEEN 0 AND 1 AND j BETWEEN 0 AND 1 AND k BETWEEN 0 AND 1))
SELECT CAST(block AS INT) AS block, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, round(avg(v), 8) AS v FROM g JOIN c ON floor(c.x / 2) = (lo_x / 2 + i + 4) % 4 AND floor(c.y / 2) = (lo_y / 2 + j + 4) % 4 AND floor(c.z / 2) = (lo_z / 2 + k + 4) % 4 GROUP BY 1, 2, 3, 4""")
def guard_cells(spark, sf):
    fine = spark.sql(_fine.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    b = spark.range(8).select(F.col("id").cast("int").alias("block"), *(((F.floor(F.col("id") / 2**k) % 2) * 4.0).alias(f"lo_{a}") for k, a in enumerate("xyz")))
    b = b.withColumns({f"hi_{a}": F.col(f"lo_{a}") + 4.0 for a in "xyz"})
    out = geometry.halo(fine, b, ["v"], 2, 1, (0.0, 0.0, 0.0), (8.0, 8.0, 8.0), 2.0)
    return rounded(out.select("block", *(F.col(c).cast("int").alias(c) for c in "ijk"), "v"), v=8)


@query(f"""WITH c AS ({CELLS}), x AS (SELECT l_orderkey, k, i + 5e-1 AS x, dvol AS d FROM c), s AS (SELECT l_orderkey, k, x - d / 2 + (s + 5e-1) * d / 4 AS x FROM x, range(4) r(s))
SELECT l_orderkey, k, count(*) * 16 AS n, round(sum(x) * 16, 6) AS sum_x FROM s GROUP BY 1, 2""")
def split_cells(spark, sf):
    c = cells(spark, sf).select("l_orderkey", "k", F.lit(1).alias("level"), *((F.col(i) + 0.5).alias(a) for a, i in zip("xyz", "ijk")), *(F.col("dvol").alias(f"d{a}") for a in "xyz"))
    return geometry.split_cells(c, 3).groupBy("l_orderkey", "k").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sum_x"))


@query(f"WITH p AS ({PHASE}) SELECT tag, image::INT AS image, round(x * cos(image * pi() / 2) - y * sin(image * pi() / 2), 8) + 0e0 AS x, round(x * sin(image * pi() / 2) + y * cos(image * pi() / 2), 8) + 0e0 AS y FROM p, range(4) r(image)")
def full_rotation(spark, sf):
    out = geometry.rotation_sequence(phase(spark, sf).select("tag", "x", "y", "z"), 4)
    return out.select("tag", F.col("image").cast("int").alias("image"), *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in "xy"))


# ---------------------------------------------------------------- sinks
_d2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
_cand = f"""WITH p AS ({PHASE}), g AS (SELECT *, 10 * mass AS dens, vx + vy AS div, vz AS gpot FROM p WHERE type = 1), d AS (SELECT * FROM g WHERE dens > 2e1), f AS (SELECT * FROM d a WHERE div < 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.type = 2 AND {_d2} <= 36e-4)),
n AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.tag <> a.tag AND {_d2} <= 9e-4 AND (b.gpot < a.gpot OR (b.gpot = a.gpot AND b.tag < a.tag))))"""


def _gas(spark, sf):
    p = phase(spark, sf)
    return p, p.where("type = 1").select("tag", "x", "y", "z", (10 * F.col("mass")).alias("dens"), (F.col("vx") + F.col("vy")).alias("div"), F.col("vz").alias("gpot"), "vx", "vy", "vz", "mass")


@query(_cand + " SELECT tag FROM n")
def sink_candidates(spark, sf):
    p, gas = _gas(spark, sf)
    return sinks.creation_candidates(gas, p.where("type = 2"), 20.0, 0.03).select("tag")


@query(f"""{_cand}, v AS (SELECT a.tag, sum(b.dens * 1e-3) AS m, sum(1e-2 * b.mass * 1e-3) AS heat, max(b.gpot) AS top, sum(b.dens * 1e-3 * b.gpot) AS pot, sum(1e-3 * b.vx * b.vx) / (8 * pi()) AS mag, sum(b.dens * 1e-3 * b.vx) AS px, sum(b.dens * 1e-3 * b.vy) AS py, sum(b.dens * 1e-3 * b.vx * b.vx) AS kx, sum(b.dens * 1e-3 * b.vy * b.vy) AS ky
 FROM n a JOIN g b ON {_d2} <= 4e-2 GROUP BY 1) SELECT tag FROM v WHERE 2 * heat + mag <= top * m - pot AND heat + 5e-1 * (kx - px * px / m + ky - py * py / m) + mag <= top * m - pot""")
def bound_sink_candidates(spark, sf):
    p, gas = _gas(spark, sf)
    found = sinks.creation_candidates(gas, p.where("type = 2"), 20.0, 0.03)
    zero = F.lit(0.0)
    volume = gas.select("tag", "x", "y", "z", F.lit(1e-3).alias("vol"), "dens", (F.col("mass") * 1e-2).alias("pres"), "gpot", F.col("vx").alias("velx"), F.col("vy").alias("vely"), zero.alias("velz"), F.col("vx").alias("magx"), zero.alias("magy"), zero.alias("magz"))
    return sinks.control_volume_checks(volume, found, 0.2).select("tag")


@query(f"WITH p AS ({PHASE}) SELECT a.tag, round(sum(b.mass * least(1e0, (b.vx + 1e0) / 15e-1) / (4 * pi() * pow(greatest(sqrt({_d2}), 2e-2), 2))), 4) AS flux FROM p a JOIN p b ON a.type = 1 AND b.type = 2 AND {_d2} <= 1e-2 GROUP BY 1")
def sink_heating(spark, sf):
    p = phase(spark, sf)
    stars = p.where("type = 2").select("tag", "x", "y", "z", F.col("mass").alias("luminosity"), (-F.col("vx") - 1.0).alias("created"))
    return rounded(sinks.heating(p.where("type = 1").select("tag", "x", "y", "z"), stars, 0.1, 0.02, 1.5), flux=4)


@query(f"WITH p AS ({PHASE}), b AS ({BLOCKS}) SELECT block, count(*) AS sinks FROM b JOIN p ON type = 2 AND pow(greatest(0e0, lo_x / 1e1 - x, x - hi_x / 1e1), 2) + pow(greatest(0e0, lo_y / 1e1 - y, y - hi_y / 1e1), 2) + pow(greatest(0e0, lo_z / 1e1 - z, z - hi_z / 1e1), 2) <= 1e-2 GROUP BY 1")
def refine_marks(spark, sf):
    b = blocks(spark, sf).select("block", *((F.col(f"{e}_{a}") / 10.0).alias(f"{e}_{a}") for e in ("lo", "hi") for a in "xyz"))
    return sinks.refine_marks(b, phase(spark, sf).where("type = 2"), 0.1)


@query(f"WITH p AS ({PHASE}) SELECT round(5e-1 * 1e-2 / max(greatest(abs(vx), abs(vy), abs(vz))), 9) AS dt FROM p WHERE type = 2")
def sink_time_step(spark, sf):
    return rounded(sinks.time_step(phase(spark, sf).where("type = 2"), 0.01), dt=9)


_near = lambda c: f"CASE WHEN b.{c} - a.{c} > 5e-1 THEN b.{c} - a.{c} - 1 WHEN b.{c} - a.{c} < -5e-1 THEN b.{c} - a.{c} + 1 ELSE b.{c} - a.{c} END"
_h, _q = "(2 / 3e-1)", "(r * 2 / 3e-1)"


@query(f"""WITH p AS ({PHASE}), d AS (SELECT a.tag, b.mass, {_near('x')} AS dx, {_near('y')} AS dy, {_near('z')} AS dz FROM p a, p b WHERE a.type = 1 AND b.type = 2), e AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM d),
f AS (SELECT *, CASE WHEN r >= 3e-1 THEN 1 / (r * r * r) WHEN {_q} >= 1 THEN {_h} * {_h} * (8e0 / 3 * {_q} - 3 * {_q} * {_q} + 12e-1 * pow({_q}, 3) - pow({_q}, 4) / 6 - 1 / (15 * {_q} * {_q})) / r WHEN {_q} > 1e-5 THEN {_h} * {_h} * (4e0 / 3 * {_q} - 12e-1 * pow({_q}, 3) + 5e-1 * pow({_q}, 4)) / r ELSE 0e0 END AS w FROM e)
SELECT tag, round(sum(mass * w * dx), 3) AS ax, round(sum(mass * w * dz), 3) AS az FROM f GROUP BY 1""")
def periodic_spline_gravity(spark, sf):
    p = phase(spark, sf)
    out = sinks.gravity(p.where("type = 1").select("tag", "x", "y", "z"), p.where("type = 2"), 0.3, kernel="spline", lengths=(1.0, 1.0, 1.0), potential=False)
    return rounded(out.select("tag", "ax", "az"), ax=3, az=3)


@query(f"""WITH p AS ({PHASE}), q AS (SELECT tag, abs(x) * 8 AS x, abs(y) * 8 AS y, abs(z) * 8 AS z FROM p), g AS (SELECT a.i, b.j, c.k, sin(a.i + 2 * b.j) * 1e0 + c.k AS fx FROM range(9) a(i), range(9) b(j), range(9) c(k))
SELECT tag, round(sum(fx * greatest(0e0, 1 - abs(x - i)) * greatest(0e0, 1 - abs(y - j)) * greatest(0e0, 1 - abs(z - k))), 7) AS fx FROM q JOIN g ON abs(x - i) < 1 AND abs(y - j) < 1 AND abs(z - k) < 1 GROUP BY 1""")
def table_correction(spark, sf):
    points = phase(spark, sf).select("tag", *(F.abs(c).alias(c) for c in "xyz"))
    grid = spark.range(729).select((F.col("id") % 9).alias("i"), (F.floor(F.col("id") / 9) % 9).alias("j"), F.floor(F.col("id") / 81).alias("k"))
    grid = grid.withColumn("fx", F.sin(F.col("i") + 2 * F.col("j")) + F.col("k"))
    return rounded(sinks.trilinear(points, grid, (0.125, 0.125, 0.125), ("fx",)).where("fx is not null").select("tag", "fx"), fx=7)


# ---------------------------------------------------------------- lists of particles
@query(f"WITH p AS ({PHASE}) SELECT tag, mass, row_number() OVER (ORDER BY mass DESC, tag)::INT AS place FROM p WHERE type = 2 ORDER BY mass DESC, tag LIMIT 10")
def heaviest_sinks(spark, sf):
    return series.ranked(phase(spark, sf).where("type = 2").select("tag", "mass"), ["mass"], ["tag"], 10)


@query(f"WITH p AS ({PHASE}), r AS (SELECT tag, row_number() OVER (ORDER BY tag) AS n FROM p WHERE type = 1) SELECT tag FROM r WHERE n % 7 = 1")
def thinned_tracers(spark, sf):
    return series.every_nth(phase(spark, sf).where("type = 1").select("tag"), "tag", 7)


@query("WITH c AS (SELECT l_quantity AS rho, sqrt(1 + l_quantity / 1e1) AS cs FROM lineitem) SELECT min(rho) AS rho FROM c WHERE rho >= pi() * cs * cs / (4 * 4e-1)")
def sink_threshold(spark, sf):
    c = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").alias("rho"), F.sqrt(1 + F.col("l_quantity") / 10.0).alias("cs"))
    return c.agg(F.min(F.when(F.col("rho") >= math.pi * F.col("cs") * F.col("cs") / 1.6, F.col("rho"))).alias("rho"))


@query(f"WITH b AS ({BLOCKS}) SELECT DISTINCT level FROM b")
def levels(spark, sf):
    return stats.refinement(blocks(spark, sf)).select("level")


@query(f"""WITH c AS ({CELLS}), x AS (SELECT *, 5e-1 + i AS cx, 5e-1 + j AS cy FROM c), q AS (SELECT *, ix::BIGINT AS px, iy::BIGINT AS py FROM x, range(4) a(ix), range(4) b(iy)),
w AS (SELECT *, {_over('cx', 'dvol', '(px * 4e0)', '(px * 4e0 + 4e0)')} * {_over('cy', 'dvol', '(py * 4e0)', '(py * 4e0 + 4e0)')} * dvol AS w FROM q)
SELECT px AS ix, py AS iy, round(sum(dens * w) / sum(w) * (sum(pres * w) / sum(w)), 2) AS value FROM w WHERE w > 1e-9 GROUP BY 1, 2""")
def product_of_maps(spark, sf):
    c = cells(spark, sf).withColumns({"x": F.col("i") + 0.5, "y": F.col("j") + 0.5} | {f"d{a}": F.col("dvol") for a in "xyz"})
    a, b = (geometry.project(c, F.col(v), (0.0, 0.0), 4.0, (4, 4)) for v in ("dens", "pres"))
    return rounded(geometry.map_product(a, b), value=2)


@query(f"""WITH c AS ({CELLS}), x AS (SELECT *, 5e-1 + i AS cx, 5e-1 + j AS cy, 5e-1 + k AS cz FROM c), q AS (SELECT *, ix::BIGINT AS px, iy::BIGINT AS py, iz::BIGINT AS pz FROM x, range(4) a(ix), range(4) b(iy), range(2) d(iz)),
w AS (SELECT *, {_over('cx', 'dvol', '(px * 4e0)', '(px * 4e0 + 4e0)')} * {_over('cy', 'dvol', '(py * 4e0)', '(py * 4e0 + 4e0)')} * {_over('cz', 'dvol', '(pz * 4e0)', '(pz * 4e0 + 4e0)')} * dens AS w FROM q)
SELECT px AS ix, py AS iy, pz AS iz, round(sum(pres * w) / sum(w), 3) AS value FROM w WHERE w > 1e-9 GROUP BY 1, 2, 3""")
def mass_weighted_cube(spark, sf):
    out = geometry.extract(_seen_cells(spark, sf), F.col("pres"), (0.0, 0.0, 0.0), 4.0, (4, 4, 2), F.col("dens"))
    return rounded(out.where("weight > 0").select("ix", "iy", "iz", "value"), value=3)


@query(f"""WITH b AS ({BLOCKS}), p AS ({PHASE}) SELECT 'blocks' AS name, count(*)::DOUBLE AS value FROM b UNION ALL SELECT 'leaves', sum(CASE WHEN node_type = 1 THEN 1 ELSE 0 END)::DOUBLE FROM b UNION ALL SELECT 'max_level', max(level)::DOUBLE FROM b UNION ALL SELECT 'min_dx', min(CASE WHEN node_type = 1 THEN (hi_x - lo_x) / 8 END) FROM b
 UNION ALL SELECT 'sinks', count(*)::DOUBLE FROM p WHERE type = 2 UNION ALL SELECT 'tracers', count(*)::DOUBLE FROM p WHERE type = 1 UNION ALL SELECT 'sink_mass', sum(mass) FROM p WHERE type = 2 UNION ALL SELECT 'median_mass', median(mass) FROM p WHERE type = 2""")
def simulation_report(spark, sf):
    g = geometry.block_summary(blocks(spark, sf), 8)
    p = phase(spark, sf)
    t = p.agg(F.sum((F.col("type") == 2).cast("long")).alias("sinks"), F.sum((F.col("type") == 1).cast("long")).alias("tracers"))
    m = stats.mass_summary(p.where("type = 2"), "mass").select(F.col("total").alias("sink_mass"), F.col("median").alias("median_mass"))
    one = g.select("blocks", "leaves", "max_level", "min_dx").crossJoin(t).crossJoin(m)  # one row each
    names = ["blocks", "leaves", "max_level", "min_dx", "sinks", "tracers", "sink_mass", "median_mass"]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
