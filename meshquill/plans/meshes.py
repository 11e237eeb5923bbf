"""Queries of meshes laid out by block and of refined meshes, on lineitem's cells and nation's blocks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ewald, geometry, refined_pairs, sinks, spectral, tree
from ..operators.sinks import checkpoint_folder
from ..sources import mesh, tables
from .queries import BLOCKS, MEASURED, blocks, dft_sql, measured, query, rounded

IN_BLOCKS = """SELECT CAST(l_orderkey % 25 AS INT) AS block, CAST(l_partkey % 4 AS INT) AS i, CAST(l_suppkey % 4 AS INT) AS j, CAST(l_linenumber % 4 AS INT) AS k, sum(l_quantity) AS dens, sum(l_extendedprice) AS pres, min(l_discount) AS velx
 FROM lineitem GROUP BY 1, 2, 3, 4"""
_geo = f"""WITH b AS ({BLOCKS}), c AS ({IN_BLOCKS}), g AS (SELECT c.*, lo_x + (i + 5e-1) * (hi_x - lo_x) / 4 AS x, lo_y + (j + 5e-1) * (hi_y - lo_y) / 4 AS y, lo_z + (k + 5e-1) * (hi_z - lo_z) / 4 AS z,
 (hi_x - lo_x) / 4 * (hi_y - lo_y) / 4 * (hi_z - lo_z) / 4 AS vol, node_type, level FROM c JOIN b USING (block))"""


def stored(spark, sf) -> mesh.Mesh:
    """lineitem's cells as a mesh in a new folder of the shared one."""
    path = f"{checkpoint_folder(spark)}/mesh-{uuid.uuid4().hex}"
    c = spark.sql(IN_BLOCKS.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    mesh.write_mesh(path, c, blocks(spark, sf), {"nxb": 4, "lrefine_max": 5, "dimensionality": 3, "xl_boundary_type": "periodic", "time": 2.5, "dt": 0.125, "nstep": 20})
    return mesh.open_mesh(spark, path)


@query(_geo + " SELECT block, count(*) AS n, round(sum(dens * vol), 6) AS mass, round(min(x), 6) AS x, round(max(y), 6) AS y FROM g WHERE node_type = 1 AND x > 225e-2 AND x < 1475e-2 AND y > 5e-1 AND y < 41e-1 AND z > 2e-1 AND z < 9e-1 GROUP BY block")
def mesh_in_box(spark, sf):
    """Of 25 blocks, read from the folders of those in the box alone."""
    g = stored(spark, sf).in_box([2.25, 0.5, 0.2], [14.75, 4.1, 0.9], ["dens"])
    return g.groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum(F.col("dens") * F.col("vol")), 6).alias("mass"), F.round(F.min("x"), 6).alias("x"), F.round(F.max("y"), 6).alias("y"))


@query(_geo + " SELECT block, count(*) AS n, round(sum(pres * vol), 4) AS total FROM g WHERE node_type = 1 AND pow(x - 7e0, 2) + pow(y - 25e-1, 2) + pow(z - 5e-1, 2) <= 4e0 GROUP BY block")
def mesh_in_sphere(spark, sf):
    g = stored(spark, sf).in_sphere([7.0, 2.5, 0.5], 2.0, ["pres"])
    return g.groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum(F.col("pres") * F.col("vol")), 4).alias("total"))


@query(f"WITH c AS ({IN_BLOCKS}) SELECT i, j, k, round(dens, 4) AS dens, round(velx, 6) AS velx FROM c WHERE block = 7")
def mesh_block(spark, sf):
    return rounded(stored(spark, sf).block(7, ["dens", "velx"]), dens=4, velx=6)


@query(_geo + " SELECT level, node_type = 1 AS leaf, count(*) AS n, round(sum(pres), 2) AS pres FROM g GROUP BY 1, 2")
def mesh_variable(spark, sf):
    m = stored(spark, sf)
    told = m.blocks.select("block", "level", (F.col("node_type") == 1).alias("leaf"))
    every = m.variable(["pres"], leaf=False).join(mesh.few(told), "block")
    return every.groupBy("level", "leaf").agg(F.count("*").alias("n"), F.round(F.sum("pres"), 2).alias("pres"))


@query("SELECT 'A' AS grid_type, 'periodic' AS boundary, 3 AS ndim, 25 AS blocks, 4 AS per_block, 'dens,pres,velx' AS variables")
def opened_mesh(spark, sf):
    """What a mesh says of itself."""
    m = stored(spark, sf)
    n = m.blocks.agg(F.count("*").cast("int").alias("blocks"))
    return m.kind.crossJoin(n).withColumns({"per_block": F.lit(m.per_block), "variables": F.lit(",".join(m.variables()))})  # a row each


@query(f"""WITH b AS ({BLOCKS}) SELECT count(*) AS blocks, sum(CASE WHEN node_type = 1 THEN 1 ELSE 0 END)::BIGINT AS leaves, max(level) AS max_level, min(CASE WHEN node_type = 1 THEN (hi_x - lo_x) / 4 END) AS min_dx, 25e-1 AS time, 125e-3 AS dt, NULL::DOUBLE AS redshift, 20e0 AS nstep FROM b""")
def mesh_report(spark, sf):
    return stored(spark, sf).report().select("blocks", "leaves", "max_level", "min_dx", "time", "dt", "redshift", "nstep")


# ---------------------------------------------------------------- parameters
_lines = """SELECT CASE n_nationkey % 5 WHEN 0 THEN 'p_' || n_nationkey || ' = ' || n_nationkey || '  # an integer' WHEN 1 THEN 'P_' || n_nationkey || '=' || n_nationkey || '.5e1' WHEN 2 THEN '  p_' || n_nationkey || ' = .TRUE.'
 WHEN 3 THEN 'p_' || n_nationkey || ' = "' || n_name || ' # not a comment" # one' ELSE '# p_' || n_nationkey || ' = 1' END AS value, n_nationkey AS line_no FROM nation"""


@query("""SELECT 'p_' || n_nationkey AS name, CASE n_nationkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'real' WHEN 2 THEN 'bool' ELSE 'str' END AS kind, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey::BIGINT ELSE -1 END AS i, CASE WHEN n_nationkey % 5 = 1 THEN (n_nationkey + 5e-1) * 1e1 ELSE -1e0 END AS d,
 n_nationkey % 5 = 2 AS b, CASE WHEN n_nationkey % 5 = 3 THEN n_name || ' # not a comment' ELSE '' END AS s FROM nation WHERE n_nationkey % 5 < 4""")
def parameter_lines(spark, sf):
    lines = spark.sql(_lines.replace("FROM nation", "FROM {t}"), t=spark.read.parquet(f"{sf}/nation.parquet"))
    nothing = {"i": F.lit(-1), "d": F.lit(-1.0), "b": F.lit(False), "s": F.lit("")}
    return tables.parse_parameters(lines).select("name", "kind", *(F.coalesce(c, v).alias(c) for c, v in nothing.items()))


# ---------------------------------------------------------------- pairs on a refined mesh
TWO_LEVELS = """SELECT CASE WHEN (i // 4 + j // 4 + k // 4) % 2 = 1 THEN 8 + (i // 2) + 4 * (j // 2) + 16 * (k // 2) ELSE (i // 4) + 2 * (j // 4) + 4 * (k // 4) END AS block, CASE WHEN (i // 4 + j // 4 + k // 4) % 2 = 1 THEN 1e0 ELSE 2e0 END AS d, i, j, k, q, u, v, w
 FROM (SELECT CAST(l_partkey % 8 AS INT) AS i, CAST(l_suppkey % 8 AS INT) AS j, CAST(l_orderkey % 8 AS INT) AS k, avg(l_quantity) AS q, avg(l_discount) * 1e2 AS u, avg(l_tax) * 1e2 AS v, avg(l_linenumber) * 1e0 AS w FROM lineitem GROUP BY 1, 2, 3)"""
_two = TWO_LEVELS.replace("//", "{div}")
_cells = f"""SELECT block, CAST((fi % 2) + 2 * (fj % 2) + 4 * (fk % 2) AS INT) AS number, (fi + 5e-1) * d AS x, (fj + 5e-1) * d AS y, (fk + 5e-1) * d AS z, d * d * d AS vol, avg(q) AS dens, avg(u) AS velx, avg(v) AS vely, avg(w) AS velz
 FROM (SELECT *, floor(i / d) AS fi, floor(j / d) AS fj, floor(k / d) AS fk FROM ({_two})) GROUP BY block, fi, fj, fk, d"""
MOST = 3.6


def two_levels(spark, sf):
    """Leaf cells of a mesh of two levels on a periodic cube of side 8, and its leaf blocks (of 2**3 cells)."""
    c = spark.sql(_cells.replace("{div}", "div").replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    d = F.pow("vol", F.lit(1 / 3))
    b = c.groupBy("block").agg(*(F.round(F.min(F.col(a) - d / 2), 6).alias(f"lo_{a}") for a in "xyz"), *(F.round(F.max(F.col(a) + d / 2), 6).alias(f"hi_{a}") for a in "xyz"))
    return c, b


_near = lambda c: f"(n.{c} - m.{c} - 8e0 * CASE WHEN n.{c} - m.{c} > 4e0 THEN 1 WHEN n.{c} - m.{c} < -4e0 THEN -1 ELSE 0 END)"
_all_pairs = f"""WITH c AS ({_cells.replace('{div}', '//')}), d AS (SELECT m.vol + n.vol AS wt, m.dens AS d1, n.dens AS d2, n.velx - m.velx AS du, n.vely - m.vely AS dv, n.velz - m.velz AS dw, m.velx AS u1, m.vely AS v1, m.velz AS w1, n.velx AS u2, n.vely AS v2, n.velz AS w2, {_near('x')} AS a, {_near('y')} AS b, {_near('z')} AS e FROM c m, c n),
r AS (SELECT *, sqrt(a * a + b * b + e * e) AS r FROM d), p AS (SELECT *, CAST(floor(r + 1e-9) AS BIGINT) AS bin, (du * a + dv * b + dw * e) / r AS lo FROM r WHERE r > 0 AND r <= {MOST!r}),
"""


@query(_all_pairs + """s AS (SELECT bin, wt, 'vels' AS type, lo, sqrt(greatest(0e0, du * du + dv * dv + dw * dw - lo * lo)) AS tr FROM p UNION ALL SELECT bin, wt, 'rho', d2 - d1, 0e0 FROM p)
SELECT type, bin, count(*) AS n, round(sum(wt), 3) AS weight, round(sum(wt * lo) / sum(wt), 5) + 0e0 AS sf1_long, round(sum(wt * tr) / sum(wt), 5) AS sf1_trans, round(sum(wt * lo * lo) / sum(wt), 5) AS sf2_long, round(sum(wt * tr * tr) / sum(wt), 5) AS sf2_trans FROM s GROUP BY 1, 2""")
def refined_structure_functions(spark, sf):
    c, b = two_levels(spark, sf)
    fields = {"vels": tuple(F.col(v) for v in ("velx", "vely", "velz")), "rho": (F.col("dens"),)}
    out = refined_pairs.pair_statistics(c, b, fields, MOST, 1.0, (0.0, 0.0, 0.0), (8.0, 8.0, 8.0), orders=2)
    return rounded(out, weight=3, sf1_long=5, sf1_trans=5, sf2_long=5, sf2_trans=5).withColumn("sf1_long", F.col("sf1_long") + F.lit(0.0))


@query(_all_pairs + """s AS (SELECT bin, wt, (u1 * a + v1 * b + w1 * e) / r * (u2 * a + v2 * b + w2 * e) / r AS lo, u1 * u2 + v1 * v2 + w1 * w2 AS dot FROM p)
SELECT 'vels' AS type, bin, count(*) AS n, round(sum(wt), 3) AS weight, round(sum(wt * lo) / sum(wt), 4) + 0e0 AS cf1_long, round(sum(wt * (dot - lo)) / sum(wt), 4) + 0e0 AS cf1_trans FROM s GROUP BY bin""")
def refined_correlation_functions(spark, sf):
    c, b = two_levels(spark, sf)
    fields = {"vels": tuple(F.col(v) for v in ("velx", "vely", "velz"))}
    out = refined_pairs.pair_statistics(c, b, fields, MOST, 1.0, (0.0, 0.0, 0.0), (8.0, 8.0, 8.0), kind="cf")
    out = rounded(out, weight=3, cf1_long=4, cf1_trans=4)
    return out.withColumns({x: F.col(x) + F.lit(0.0) for x in ("cf1_long", "cf1_trans")})


# ---------------------------------------------------------------- neighbours and guard cells
_leaves = f"""WITH c AS ({_cells.replace('{div}', '//')}), b AS (SELECT block, min(x - cbrt(vol) / 2) AS lo_x, max(x + cbrt(vol) / 2) AS hi_x, min(y - cbrt(vol) / 2) AS lo_y, max(y + cbrt(vol) / 2) AS hi_y, min(z - cbrt(vol) / 2) AS lo_z, max(z + cbrt(vol) / 2) AS hi_z FROM c GROUP BY 1)"""


def _faces(a: str, wraps: bool) -> str:
    p, q = (x for x in "xyz" if x != a)
    across = " AND ".join(f"least(m.hi_{x}, n.hi_{x}) - greatest(m.lo_{x}, n.lo_{x}) > 1e-6" for x in (p, q))
    low, high = (f"(abs(m.{e}_{a} - n.{f}_{a}) < 1e-6" + (f" OR (abs(m.{e}_{a} - {at}) < 1e-6 AND abs(n.{f}_{a} - {to}) < 1e-6)" if wraps else "") + ")" for e, f, at, to in (("lo", "hi", "0e0", "8e0"), ("hi", "lo", "8e0", "0e0")))
    return " UNION ALL ".join(f"SELECT m.block, '{a}{sign}' AS face, coalesce(n.block, -21)::BIGINT AS neighbour FROM b m LEFT JOIN b n ON {plane} AND {across}" for sign, plane in (("-", low), ("+", high)))


@query(f"{_leaves} {_faces('x', True)} UNION ALL {_faces('y', False)} UNION ALL {_faces('z', True)}")
def neighbour_graph(spark, sf):
    """Faces of blocks of two levels; the domain ends in y."""
    _, b = two_levels(spark, sf)
    return geometry.neighbours(b, (0.0, 0.0, 0.0), (8.0, 8.0, 8.0), 2.0, 4.0, (True, False, True))


_fine = """f AS (SELECT i::DOUBLE AS fi, j::DOUBLE AS fj, k::DOUBLE AS fk, c.dens, c.velx FROM range(8) r(i), range(8) s(j), range(8) t(k), c WHERE abs(i + 5e-1 - c.x) < cbrt(c.vol) / 2 AND abs(j + 5e-1 - c.y) < cbrt(c.vol) / 2 AND abs(k + 5e-1 - c.z) < cbrt(c.vol) / 2)"""


@query(f"""{_leaves}, {_fine}, g AS (SELECT block, i, j, k, (hi_x - lo_x) / 2 AS d, lo_x + (i + 5e-1) * (hi_x - lo_x) / 2 AS x, lo_y + (j + 5e-1) * (hi_y - lo_y) / 2 AS y, lo_z + (k + 5e-1) * (hi_z - lo_z) / 2 AS z FROM b, range(-1, 3) r(i), range(-1, 3) s(j), range(-1, 3) t(k)
 WHERE NOT (i BETWEEN 0 AND 1 AND j BETWEEN 0 AND 1 AND k BETWEEN 0 AND 1)),
h AS (SELECT block, i, j, k, d, CASE WHEN x < 0 THEN -x WHEN x > 8 THEN 16 - x ELSE x END AS x, CASE WHEN x < 0 OR x > 8 THEN -1 ELSE 1 END AS flip, least(greatest(y, d / 2), 8 - d / 2) AS y, z FROM g WHERE z > 0 AND z < 8)
SELECT CAST(block AS BIGINT) AS block, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, round(avg(dens), 6) AS dens, round(avg(flip * velx), 6) + 0e0 AS velx FROM h, f WHERE abs(fi + 5e-1 - x) < d / 2 AND abs(fj + 5e-1 - y) < d / 2 AND abs(fk + 5e-1 - z) < d / 2 GROUP BY 1, 2, 3, 4""")
def guard_cells_at_edges(spark, sf):
    """Guard cells of a domain that is mirrored in x, goes on in y and ends in z."""
    c, b = two_levels(spark, sf)
    c = c.withColumn("dx", F.pow("vol", F.lit(1 / 3)))
    out = geometry.halo(c, b, ["dens", "velx"], 2, 1, (0.0, 0.0, 0.0), (8.0, 8.0, 8.0), 2.0, ("reflecting", "outflow", "none"), ("velx", None, None))
    out = rounded(out.select(F.col("block").cast("long").alias("block"), *(F.col(x).cast("int").alias(x) for x in "ijk"), "dens", "velx"), dens=6, velx=6)
    return out.withColumn("velx", F.col("velx") + F.lit(0.0))


# ---------------------------------------------------------------- gravity
_lattice = "(SELECT * FROM range(-3, 4) a(nx), range(-3, 4) b(ny), range(-3, 4) c(nz) WHERE nx * nx + ny * ny + nz * nz <= 9)"
_erfc = "(list_aggregate(list_transform(range(pts), lambda t: exp(-ar * ar / pow(sin((t + 5e-1) * pi() / (2 * pts)), 2))), 'avg'))"


@query(f"""WITH p AS (SELECT vec_id AS tag, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings), s AS (SELECT tag, px - round(px) AS x, py - round(py) AS y, pz - round(pz) AS z FROM p),
n AS (SELECT tag, nx, ny, nz, x, y, z, x + nx AS dx, y + ny AS dy, z + nz AS dz, 2 * sqrt(pow(x + nx, 2) + pow(y + ny, 2) + pow(z + nz, 2)) AS ar, 2 * pi() * (nx * x + ny * y + nz * z) AS kx, nx * nx + ny * ny + nz * nz AS n2, CASE WHEN nx * nx + ny * ny + nz * nz = 0 THEN 4096 ELSE 128 END AS pts FROM s, {_lattice}),
f AS (SELECT *, CASE WHEN ar > 1e-2 OR n2 > 0 THEN ({_erfc} - CASE WHEN n2 = 0 THEN 1 ELSE 0 END + 2 / sqrt(pi()) * ar * exp(-ar * ar)) / pow(ar / 2, 3) ELSE -32 / (3 * sqrt(pi())) * (1 - 6e-1 * ar * ar) END AS f,
 CASE WHEN n2 > 0 THEN 2 / n2 * exp(-pi() * pi() * n2 / 4) * sin(kx) ELSE 0e0 END AS w FROM n)
SELECT tag, round(-sum(f * dx + w * nx), 6) + 0e0 AS ewald_x, round(-sum(f * dy + w * ny), 6) + 0e0 AS ewald_y, round(-sum(f * dz + w * nz), 6) + 0e0 AS ewald_z FROM f GROUP BY tag""")
def ewald_correction(spark, sf):
    p = spark.sql("SELECT vec_id AS tag, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z FROM {t}", t=spark.read.parquet(f"{sf}/embeddings.parquet"))
    out = ewald.at_points(p, (1.0, 1.0, 1.0), series=3)
    return out.select("tag", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ewald.FIELD))


_gas = "SELECT CAST(l_partkey % 16 AS INT) + (l_suppkey % 7) / 1e1 AS x, CAST(l_suppkey % 16 AS INT) + (l_partkey % 5) / 1e1 AS y, CAST(l_orderkey % 16 AS INT) + 5e-2 AS z, sum(l_quantity) AS mass FROM lineitem GROUP BY 1, 2, 3"


@query(f"""WITH g AS ({_gas}), s AS (SELECT s_suppkey AS tag, s_suppkey % 16 + 33e-2 AS x, s_nationkey % 16 + 33e-2 AS y, s_suppkey % 11 + 33e-2 AS z FROM supplier),
d AS (SELECT tag, mass, g.x - s.x AS dx, g.y - s.y AS dy, g.z - s.z AS dz FROM s, g), r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz + 25e-2) AS r FROM d)
SELECT tag, round(sum(mass * dx / pow(r, 3)), 4) AS ax, round(sum(mass * dy / pow(r, 3)), 4) AS ay, round(sum(mass * dz / pow(r, 3)), 4) AS az, round(-sum(mass / r), 3) AS phi FROM r GROUP BY tag""")
def gas_on_sinks(spark, sf):
    """Gas as the source, every mass by itself: an opening angle of 0 makes the tree exact."""
    gas = spark.sql(_gas.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    s = spark.sql("SELECT s_suppkey AS tag, s_suppkey % 16 + 33e-2 AS x, s_nationkey % 16 + 33e-2 AS y, s_suppkey % 11 + 33e-2 AS z FROM {t}", t=spark.read.parquet(f"{sf}/supplier.parquet"))
    out = tree.tree_gravity(s, gas, (0.0, 0.0, 0.0), 20.0, soft=0.5, angle=0.0, depth=6, leaf=64)
    return rounded(out.select("tag", "ax", "ay", "az", "phi"), ax=4, ay=4, az=4, phi=3)


_around = "(SELECT * FROM (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(b), (VALUES (-1), (0), (1)) c(c) WHERE a <> 0 OR b <> 0 OR c <> 0)"


@query(f"""WITH m AS ({MEASURED}), d AS (SELECT p.i, p.j, p.k, (a * (n.velx - p.velx) + b * (n.vely - p.vely) + c * (n.velz - p.velz)) / sqrt(a * a + b * b + c * c) AS out FROM m p, {_around} JOIN m n ON n.i = (p.i + a + 8) % 8 AND n.j = (p.j + b + 8) % 8 AND n.k = (p.k + c + 8) % 8)
SELECT i + 8 * j + 64 * k AS tag FROM d GROUP BY i, j, k HAVING count(*) FILTER (WHERE out > 1e-5 * 4e4) = 0""")
def converging_flows(spark, sf):
    """Cells of a periodic mesh whose 26 neighbours do not move away faster than 0.4."""
    m = measured(spark, sf)
    c = m.withColumn("tag", F.col("i") + 8 * F.col("j") + 64 * F.col("k"))
    return sinks.converging(c, m, F.lit(4e4), (8, 8, 8)).select("tag")


# ---------------------------------------------------------------- potentials and windows
_turn = {c: (f"(CASE WHEN k{p} > 4 THEN k{p} - 8 ELSE k{p} END)", f"{'xyz'.index(q)}", f"(CASE WHEN k{q} > 4 THEN k{q} - 8 ELSE k{q} END)", f"{'xyz'.index(p)}") for c, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}


def _potential_sql(c: str) -> str:
    kp, q, kq, p = _turn[c]
    part = lambda r: f"({kp} * {r}_v{q} - {kq} * {r}_v{p})"
    scale = "CASE WHEN k2 > 0 THEN 1 / (2 * pi() * k2) ELSE 0e0 END"
    return f"round(-{part('im')} * {scale}, 9) + 0e0 AS re_{c}, round({part('re')} * {scale}, 9) + 0e0 AS im_{c}"


_k2 = " + ".join(f"pow(CASE WHEN {c} > 4 THEN {c} - 8 ELSE {c} END, 2)" for c in ("kx", "ky", "kz"))


@query(f"WITH mesh AS ({MEASURED}), {dft_sql({'v0': 'velx', 'v1': 'vely', 'v2': 'velz'})}, g AS (SELECT *, {_k2} AS k2 FROM f) SELECT kx, ky, kz, {', '.join(_potential_sql(c) for c in 'xyz')} FROM g")
def vector_potential(spark, sf):
    """Modes of the field whose curl is a vector field's solenoidal part."""
    modes = spectral.transform_fields(measured(spark, sf), ["velx", "vely", "velz"], 8)
    parts = [modes.select("kx", "ky", "kz", F.col(f"re_{v}").alias("re"), F.col(f"im_{v}").alias("im")) for v in ("velx", "vely", "velz")]
    out = spectral.vector_potential(parts, 8)
    names = [f"{p}_{c}" for c in "xyz" for p in ("re", "im")]
    return out.select("kx", "ky", "kz", *((F.round(n, 9) + F.lit(0.0)).alias(n) for n in names))


@query(f"WITH mesh AS ({MEASURED}), r AS (SELECT i, j, k, velx, sqrt(pow(i - 35e-1, 2) + pow(j - 35e-1, 2) + pow(k - 35e-1, 2)) AS r FROM mesh) SELECT i, j, k, round(velx * CASE WHEN r < 4e0 THEN 5e-1 * (1 + cos(pi() * r / 4e0)) ELSE 0e0 END, 9) + 0e0 AS value FROM r")
def windowed_mesh(spark, sf):
    m = measured(spark, sf)
    r = F.sqrt(sum(((F.col(c) - 3.5) * (F.col(c) - 3.5) for c in "ijk"), F.lit(0.0)))
    return m.select("i", "j", "k", (F.round(F.col("velx") * spectral.hann(r, 4.0), 9) + F.lit(0.0)).alias("value"))
