"""Queries of the mesh and particle operators on the driver's tables, with their SQL.

Cells are rows of lineitem, blocks are nations, particles are embeddings, dumps are orders, series are events. Dense meshes are
closed forms over ranges. Floats are rounded on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derived, models
from ..operators import geometry, pairs, series, sinks, spectral, stats, stencil
from ..sources import text
from ..streaming import events as streaming

CELLS = """SELECT l_orderkey, CAST(l_orderkey % 8 AS INT) AS block, CAST(l_partkey % 16 AS INT) AS i, CAST(l_suppkey % 16 AS INT) AS j,
 l_linenumber AS k, l_quantity AS dens, l_extendedprice AS pres, l_discount - 5e-2 AS velx, l_tax - 4e-2 AS vely,
 (l_linenumber - 4) / 1e1 AS velz, 1e0 + l_linenumber % 2 AS dvol FROM lineitem"""
BLOCKS = """SELECT n_nationkey AS block, n_regionkey + 1 AS level, n_nationkey % 2 AS node_type, n_nationkey * 1e0 AS lo_x,
 n_nationkey + 1e0 AS hi_x, n_regionkey * 1e0 AS lo_y, n_regionkey + 1e0 AS hi_y, 0e0 AS lo_z, 1e0 AS hi_z FROM nation"""
PARTICLES = {"spark": "SELECT vec_id AS tag, label % 2 + 1 AS type, 1e0 + label AS mass, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z, CAST(embedding[3] AS DOUBLE) AS vx FROM embeddings",
             "duck": "SELECT vec_id AS tag, label % 2 + 1 AS type, 1e0 + label AS mass, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS vx FROM embeddings"}
MAG = ", sin(dens) + 2e0 AS magx, cos(dens) + 2e0 AS magy, dens / 1e1 AS magz"

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f
    return add


def view(spark: SparkSession, sf: str, name: str, sql: str) -> DataFrame:
    """A mapping's SQL over one table."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf}/{name}.parquet"))


def cells(spark, sf):
    return view(spark, sf, "lineitem", CELLS)


def blocks(spark, sf):
    return view(spark, sf, "nation", BLOCKS)


def particles(spark, sf):
    return view(spark, sf, "embeddings", PARTICLES["spark"])


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def dense(spark, n):
    """velx, vely, velz on an n**3 mesh, i fastest."""
    rows = spark.range(n**3).select((F.col("id") % n).alias("i"), (F.floor(F.col("id") / n) % n).alias("j"), F.floor(F.col("id") / (n * n)).alias("k"))
    w = 2 * math.pi / n
    return rows.select("i", "j", "k", (F.sin(F.col("i") * w) + 0.5 * F.cos(F.col("j") * w)).alias("velx"), (F.sin((F.col("i") + 2 * F.col("k")) * w)).alias("vely"), (F.cos((F.col("j") + F.col("k")) * w)).alias("velz"))


def dense_sql(n):
    w = f"{2 * math.pi / n!r}"
    return f"""m AS (SELECT range % {n} AS i, (range // {n}) % {n} AS j, range // {n * n} AS k FROM range({n**3})),
mesh AS (SELECT i, j, k, sin(i * {w}) + 0.5e0 * cos(j * {w}) AS velx, sin((i + 2 * k) * {w}) AS vely, cos((j + k) * {w}) AS velz FROM m)"""


#: Velocities on an 8**3 periodic mesh: means over all rows.
MEASURED = """SELECT CAST(l_suppkey % 8 AS BIGINT) AS i, CAST(l_partkey % 8 AS BIGINT) AS j, CAST(l_orderkey % 8 AS BIGINT) AS k, avg(l_discount) * 1e2 - 5e0 AS velx, avg(l_tax) * 1e2 - 4e0 AS vely, avg(l_linenumber) * 1e0 - 4e0 AS velz FROM lineitem GROUP BY 1, 2, 3"""
MEASURED_SQL = f"mesh AS ({MEASURED}), m AS (SELECT i, j, k FROM mesh)"


def measured(spark, sf):
    return view(spark, sf, "lineitem", MEASURED)


WEIGHTED = "sum({v} * {w}) / sum({w})"


def sql_mean(v, w):
    return f"(sum(({v}) * ({w})) / sum({w}))"


def sql_std(v, w):
    return f"sqrt(greatest(0e0, sum(({v}) * ({v}) * ({w})) / sum({w}) - {sql_mean(v, w)} * {sql_mean(v, w)}))"


# ---------------------------------------------------------------- statistics
@query(f"""WITH c AS ({CELLS}), b AS (SELECT CAST(trunc(pres / 5e3) AS BIGINT) + 1 AS bin, dens FROM c WHERE pres > -5e3 AND pres < 105e3),
g AS (SELECT bin, sum(dens) AS w, count(*) AS n FROM b GROUP BY bin)
SELECT bin, (bin - 5e-1) * 5e3 AS x, n, round(w / sum(w) OVER () / 5e3, 12) AS pdf, round(sum(w) OVER (ORDER BY bin) / sum(w) OVER (), 9) AS cdf FROM g""")
def pdf_linear(spark, sf):
    return rounded(stats.pdf(cells(spark, sf), F.col("pres"), F.col("dens"), 0.0, 105e3, 5e3), pdf=12, cdf=9)


@query(f"""WITH c AS ({CELLS}), b AS (SELECT CAST(trunc((log10(dens) - 0e0) / 1.25e-1) AS BIGINT) + 1 AS bin, dvol FROM c WHERE log10(dens) > -1.25e-1 AND log10(dens) < 2e0),
g AS (SELECT bin, sum(dvol) AS w, count(*) AS n FROM b GROUP BY bin)
SELECT bin, round(pow(1e1, (bin - 5e-1) * 1.25e-1), 6) AS x, n, round(w / sum(w) OVER () / (pow(1e1, bin * 1.25e-1) - pow(1e1, (bin - 1) * 1.25e-1)), 10) AS pdf,
 round(sum(w) OVER (ORDER BY bin) / sum(w) OVER (), 9) AS cdf FROM g""")
def pdf_log(spark, sf):
    return rounded(stats.pdf(cells(spark, sf), F.col("dens"), F.col("dvol"), 0.0, 2.0, 0.125, log=True), x=6, pdf=10, cdf=9)


@query(f"""WITH c AS ({CELLS}), g AS (SELECT CAST(trunc(dens / 5e0) AS BIGINT) + 1 AS bin, sum(dvol) AS w FROM c WHERE dens > -5e0 AND dens < 55e0 GROUP BY 1),
p AS (SELECT (bin - 5e-1) * 5e0 AS x, w / sum(w) OVER () AS p FROM g),
m AS (SELECT sum(x * p) AS m1, sum(x * x * p) AS m2, sum(x * x * x * p) AS m3, sum(x * x * x * x * p) AS m4 FROM p)
SELECT round(m1, 6) AS mean, round(sqrt(m2), 6) AS rms, round(sqrt(m2 - m1 * m1), 6) AS sigma, round((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5e0), 6) AS skew,
 round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / ((m2 - m1 * m1) * (m2 - m1 * m1)) - 3, 6) AS kurt FROM m""")
def pdf_moments(spark, sf):
    table = stats.pdf(cells(spark, sf), F.col("dens"), F.col("dvol"), 0.0, 55.0, 5.0)
    return rounded(stats.pdf_moments(table, 0.0, 5.0), mean=6, rms=6, sigma=6, skew=6, kurt=6)


@query(f"""WITH c AS ({CELLS}), g AS (SELECT CAST(trunc(log10(dens) / 1.25e-1) AS BIGINT) + 1 AS bin, sum(dvol) AS w FROM c WHERE log10(dens) > -1.25e-1 AND log10(dens) < 2e0 GROUP BY 1),
p AS (SELECT pow(1e1, (bin - 5e-1) * 1.25e-1) AS x, w / sum(w) OVER () AS p FROM g), m AS (SELECT sum(x * p) AS a, sqrt(sum(x * x * p)) AS rms, sqrt(sum(x * x * p) - sum(x * p) * sum(x * p)) AS sigma FROM p)
SELECT round(any_value(a), 6) AS mean, round(any_value(rms), 6) AS rms, round(any_value(sigma), 6) AS sigma, round(sum(p * pow(x - a, 3)) / pow(any_value(sigma), 3), 6) AS skew, round(sum(p * pow(x - a, 4)) / pow(any_value(sigma), 4) - 3, 6) AS kurt FROM p, m""")
def pdf_moments_log(spark, sf):
    table = stats.pdf(cells(spark, sf), F.col("dens"), F.col("dvol"), 0.0, 2.0, 0.125, log=True)
    return rounded(stats.pdf_moments(table, 0.0, 0.125, log=True), mean=6, rms=6, sigma=6, skew=6, kurt=6)


@query(f"""WITH c AS ({CELLS}) SELECT round({sql_mean('pres', 'dvol')}, 4) AS mean_vol, round({sql_std('pres', 'dvol')}, 4) AS std_vol,
 round({sql_mean('pres', 'dens * dvol')}, 4) AS mean_mass, round({sql_std('pres', 'dens * dvol')}, 4) AS std_mass FROM c""")
def weighted_statistics(spark, sf):
    vol, mass = stats.weighted(F.col("pres"), F.col("dvol")), stats.weighted(F.col("pres"), F.col("dens") * F.col("dvol"))
    out = cells(spark, sf).agg(vol[0].alias("mean_vol"), vol[1].alias("std_vol"), mass[0].alias("mean_mass"), mass[1].alias("std_mass"))
    return rounded(out, mean_vol=4, std_vol=4, mean_mass=4, std_mass=4)


@query(f"""WITH c AS ({CELLS}), lo AS (SELECT pres, l_orderkey, k FROM c ORDER BY pres, l_orderkey, k LIMIT 1), hi AS (SELECT pres, l_orderkey, k FROM c ORDER BY pres DESC, l_orderkey, k LIMIT 1)
SELECT lo.pres AS min_value, hi.pres AS max_value, lo.l_orderkey AS min_l_orderkey, lo.k AS min_k, hi.l_orderkey AS max_l_orderkey, hi.k AS max_k FROM lo, hi""")
def extremes_with_place(spark, sf):
    return stats.extremes(cells(spark, sf), "pres", ["l_orderkey", "k"])


EDGES = [1.0, 5.0, 10.0, 20.0, 35.0, 50.0]
_edge_sql = "CASE " + " ".join(f"WHEN dens >= {a!r}e0 AND dens {'<=' if i == 4 else '<'} {b!r}e0 THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + " END"


@query(f"""WITH c AS ({CELLS}), b AS (SELECT CAST({_edge_sql} AS BIGINT) AS bin, * FROM c)
SELECT bin, count(*) AS n, round(sum(pres * dvol), 2) AS total, round({sql_mean('pres', 'dvol')}, 4) AS mean, round({sql_std('pres', 'dvol')}, 4) AS std FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def binned_statistic(spark, sf):
    return rounded(stats.binned_statistic(cells(spark, sf), F.col("dens"), F.col("pres"), F.col("dvol"), EDGES), total=2, mean=4, std=4)


HIST = f"WITH c AS ({CELLS}), h AS (SELECT CAST(floor(dens / 1e1) AS BIGINT) AS bx, CAST(floor(pres / 5e3) AS BIGINT) AS by_, sum(dvol) AS w FROM c GROUP BY 1, 2)"


@query(HIST + f" SELECT bx, round({sql_mean('(by_ + 5e-1) * 5e3', 'w')}, 4) AS mean, round({sql_std('(by_ + 5e-1) * 5e3', 'w')}, 4) AS std FROM h GROUP BY bx")
def histogram_statistic(spark, sf):
    h = stats.histogram2d(cells(spark, sf), F.col("dens"), F.col("pres"), F.col("dvol"), 10.0, 5e3)
    return rounded(stats.histogram_statistic(h, 5e3), mean=4, std=4)


@query(HIST + ", q AS (SELECT bx, by_, sum(w) OVER (PARTITION BY bx ORDER BY by_) / sum(w) OVER (PARTITION BY bx) AS cdf FROM h) SELECT bx, (max(by_) + 5e-1) * 5e3 AS value FROM q WHERE cdf <= 5e-1 + 1e-12 GROUP BY bx")
def histogram_percentile(spark, sf):
    h = stats.histogram2d(cells(spark, sf), F.col("dens"), F.col("pres"), F.col("dvol"), 10.0, 5e3)
    return stats.histogram_percentile(h, 5e3, 50.0)


@query(f"""WITH c AS ({CELLS}), r AS (SELECT *, sqrt((i - 8e0) * (i - 8e0) + (j - 8e0) * (j - 8e0) + (k - 4e0) * (k - 4e0)) AS r FROM c)
SELECT CAST(trunc((r - 0e0) / 2e0) AS BIGINT) + 1 AS bin, count(*) AS n, round({sql_mean('pres', 'dens * dvol')}, 4) AS mean, round({sql_std('pres', 'dens * dvol')}, 4) AS std,
 (CAST(trunc((r - 0e0) / 2e0) AS BIGINT) + 5e-1) * 2e0 AS radius FROM r WHERE r > -2e0 AND r < 12e0 GROUP BY 1, 5""")
def radial_profile(spark, sf):
    c = cells(spark, sf)
    r = derived.radius((8.0, 8.0, 4.0), names=("i", "j", "k"))
    return rounded(stats.radial_profile(c, F.col("pres"), F.col("dens") * F.col("dvol"), r, 0.0, 12.0, 2.0), mean=4, std=4)


@query(f"WITH b AS ({BLOCKS}) SELECT level, count(*) AS nblocks, count(*)::DOUBLE / sum(count(*)) OVER () AS fraction FROM b GROUP BY level")
def refinement_info(spark, sf):
    return stats.refinement(blocks(spark, sf))


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS min, max(c_acctbal) AS max, round(median(c_acctbal), 4) AS median, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std FROM customer")
def mass_summary(spark, sf):
    return rounded(stats.mass_summary(spark.read.parquet(f"{sf}/customer.parquet"), "c_acctbal"), total=2, median=4, mean=4, std=4)


@query(f"WITH p AS ({PARTICLES['duck']}) SELECT type, count(*) AS n FROM p GROUP BY type")
def particle_types(spark, sf):
    return particles(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- variables and models
NAMES = ["temperature", "valf", "cs", "machalf", "momx", "vel2", "mag2", "ekin", "emag", "eint", "vx_para_b", "vy_perp_b", "mfx", "mfy", "mfz", "dens_thresh_25", "mach", "rho3_velx", "rhov_vely", "sqrtrho_velz", "valf_magx", "amach_velx", "msmach_vely"]
_v2, _m2 = "(velx * velx + vely * vely + velz * velz)", "(magx * magx + magy * magy + magz * magz)"
_g, _pi4, _valf = f"{5 / 3!r}", f"{4 * math.pi!r}", f"sqrt({_m2} / ({4 * math.pi!r} * dens))"
_dot = "(velx * magx + vely * magy + velz * magz)"
SQL_OF = {"temperature": f"pres / dens * 2.3e0 * {derived.M_P!r} / {derived.K_B!r}", "valf": _valf, "cs": f"sqrt({_g} * pres / dens)", "machalf": f"sqrt({_v2}) / {_valf}", "momx": "dens * velx",
          "vel2": _v2, "mag2": _m2, "ekin": f"5e-1 * dens * {_v2}", "emag": f"{_m2} / {8 * math.pi!r}", "eint": f"pres / dens / ({_g} - 1)", "vx_para_b": f"{_dot} / {_m2} * magx", "vy_perp_b": f"vely - {_dot} / {_m2} * magy",
          "mfx": "vely * magz - velz * magy", "mfy": "velz * magx - velx * magz", "mfz": "velx * magy - vely * magx", "dens_thresh_25": "CASE WHEN dens > 25 THEN 1e0 ELSE 0e0 END", "mach": f"sqrt({_v2} / ({_g} * pres / dens))",
          "rho3_velx": "cbrt(dens) * velx", "rhov_vely": "dens * vely", "sqrtrho_velz": "sqrt(dens) * velz", "valf_magx": f"magx / sqrt({_pi4} * dens)", "amach_velx": f"velx / {_valf}", "msmach_vely": f"vely / sqrt(1 + 5e-1 * {_m2} / ({_pi4} * dens))"}
SCALE = {"temperature": 1e5, "mach": 1e3}


@query(f"WITH c AS ({CELLS}), m AS (SELECT *{MAG} FROM c) SELECT block, " + ", ".join(f"round(avg({SQL_OF[n]}) * {SCALE.get(n, 1.0)!r}e0, 7) AS {n}" for n in NAMES) + " FROM m GROUP BY block")
def derived_variables(spark, sf):
    c = view(spark, sf, "lineitem", f"SELECT *{MAG} FROM ({CELLS})")
    return c.groupBy("block").agg(*(F.round(F.avg(derived.variable(n)) * SCALE.get(n, 1.0), 7).alias(n) for n in NAMES))


@query(f"WITH c AS ({CELLS}) SELECT block, count(*) AS n, round(avg(log10(dens / 1e1)), 9) AS lg, round(avg(ln(dens / 1e1)), 9) AS ln_, round(avg(2 * pres + 1), 4) AS q2 FROM c WHERE pres BETWEEN 2e4 AND 6e4 GROUP BY block")
def transformed_in_range(spark, sf):
    c = derived.transformed(cells(spark, sf).where(F.col("pres").between(2e4, 6e4)), "pres", "2 * q + 1", "q2")
    logs = [F.round(F.avg(derived.prepared(F.col("dens"), 10.0, log)), 9).alias(n) for log, n in (("lg", "lg"), ("ln", "ln_"))]
    return c.groupBy("block").agg(F.count("*").alias("n"), *logs, F.round(F.avg("q2"), 4).alias("q2"))


@query("""WITH p AS (SELECT p_partkey, pow(1e1, p_size / 2e0) AS len FROM part),
u AS (SELECT *, CASE WHEN len < 1e2 THEN 'cm' WHEN len < 1e5 THEN 'm' WHEN len < 6.957e10 THEN 'km' WHEN len < 1.495978707e13 THEN 'rsol' WHEN len < 1.495978707e17 THEN 'AU'
 WHEN len < 3.085677581e21 THEN 'pc' WHEN len < 3.085677581e24 THEN 'kpc' ELSE 'Mpc' END AS unit FROM p)
SELECT p_partkey, round(len / CASE unit WHEN 'cm' THEN 1e0 WHEN 'm' THEN 1e2 WHEN 'km' THEN 1e5 WHEN 'rsol' THEN 6.957e10 WHEN 'AU' THEN 1.495978707e13 WHEN 'pc' THEN 3.085677581e18 WHEN 'kpc' THEN 3.085677581e21 ELSE 3.085677581e24 END, 6) AS value, unit FROM u""")
def length_units(spark, sf):
    value, unit = models.length_in_units(F.pow(F.lit(10.0), F.col("p_size") / 2.0))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round(value, 6).alias("value"), unit.alias("unit"))


@query("""WITH p AS (SELECT p_partkey, pow(1e1, p_size / 2e0 - 1.2e1) * CASE WHEN p_partkey % 2 = 0 THEN 1e0 ELSE -1e0 END AS t FROM part)
SELECT p_partkey, round(CASE WHEN abs(t) <= 1e-10 THEN 0e0 WHEN abs(t) <= 1e-6 THEN t / 1e-9 WHEN abs(t) <= 1e7 THEN t WHEN abs(t) <= 1e11 THEN t / 3.15576e7 ELSE t / 3.15576e13 END, 6) AS value,
 CASE WHEN abs(t) <= 1e-10 THEN '' WHEN abs(t) <= 1e-6 THEN 'ns' WHEN abs(t) <= 1e7 THEN 's' WHEN abs(t) <= 1e11 THEN 'yr' ELSE 'Myr' END AS unit FROM p""")
def time_units(spark, sf):
    value, unit = models.time_in_units(F.pow(F.lit(10.0), F.col("p_size") / 2.0 - 12.0) * F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(-1.0))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round(value, 6).alias("value"), unit.alias("unit"))


@query("""WITH p AS (SELECT p_partkey, p_size * 1e0 AS s, p_retailprice AS q FROM part)
SELECT p_partkey, round((pow(s / 4e0, 2e0) + pow(s / 4e0, -2e0)) * exp(-pow(s / 2e1, 1e0)), 9) AS pkin,
 round(exp(-((s / 1e1) + 1.25e-1) * ((s / 1e1) + 1.25e-1) / 5e-1) / sqrt(2 * pi() * 2.5e-1), 9) AS normal,
 round(CASE WHEN q >= 1.5e3 THEN pow(1.5e3, 1e0 - 1.4e0) * pow(q, 1.4e0) ELSE pow(q, 1e0) END, 4) AS eos,
 round(q * pow(1 + 3e0, 3e0), 4) AS proper_dens, round(s * (1 / (1 + 3e0)), 9) AS proper_length,
 round(CASE WHEN s / 5e1 < 5e-1 THEN 2 * (s / 5e1) * (s / 5e1) ELSE (4 - 2 * (s / 5e1)) * (s / 5e1) - 1 END, 9) AS eased FROM p""")
def model_functions(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 1.0).cast("double").alias("s"), F.col("p_retailprice").alias("q"))
    s, q, z = F.col("s"), F.col("q"), F.lit(3.0)
    out = {"pkin": (models.kinetic_spectrum(s, 2.0, 4.0, -2.0, 20.0, 1.0), 9), "normal": (models.normal_pdf(s / 10.0, 0.5), 9), "eos": (models.polytropic_pressure(q, [1.5e3], [1.0, 1.4], 1.0), 4),
           "proper_dens": (models.proper("dens", q, z), 4), "proper_length": (models.proper("length", s, z), 9), "eased": (models.ease(s / 50.0, "in_out_quad"), 9)}
    return p.select("p_partkey", *(F.round(c, d).alias(n) for n, (c, d) in out.items()))


# ---------------------------------------------------------------- geometry
@query(f"WITH b AS ({BLOCKS}) SELECT block, level FROM b WHERE hi_x > 3.5e0 AND lo_x < 1.2e1 AND hi_y > 1e0 AND lo_y < 3e0 AND hi_z > 0e0 AND lo_z < 1e0 AND node_type = 1")
def leaf_blocks_in_box(spark, sf):
    b = blocks(spark, sf).where("node_type = 1")
    return geometry.blocks_in_box(b, [3.5, 1.0, 0.0], [12.0, 3.0, 1.0]).select("block", "level")


@query(f"""WITH b AS ({BLOCKS}) SELECT block FROM b WHERE pow(greatest(lo_x - 9.5e0, 0e0, 9.5e0 - hi_x), 2) + pow(greatest(lo_y - 2e0, 0e0, 2e0 - hi_y), 2) + pow(greatest(lo_z - 5e-1, 0e0, 5e-1 - hi_z), 2) <= 9e0""")
def blocks_in_sphere(spark, sf):
    return geometry.blocks_in_sphere(blocks(spark, sf), [9.5, 2.0, 0.5], 3.0).select("block")


@query(f"WITH c AS ({CELLS}) SELECT count(*) AS n, sum(CASE WHEN pow(i - 8, 2) + pow(j - 8, 2) + pow(k - 4, 2) <= 16 THEN 1 ELSE 0 END)::BIGINT AS in_sphere, round(sum(dens), 2) AS dens FROM c WHERE i > 3 AND i < 12 AND j > 3 AND j < 12 AND k > 1 AND k < 7")
def cells_in_box_and_sphere(spark, sf):
    c = cells(spark, sf).where(geometry.inside_box([3, 3, 1], [12, 12, 7], names=("i", "j", "k")))
    r = derived.radius((8.0, 8.0, 4.0), names=("i", "j", "k"))
    return c.agg(F.count("*").alias("n"), F.sum((r * r <= 16 + 1e-9).cast("long")).alias("in_sphere"), F.round(F.sum("dens"), 2).alias("dens"))


@query(f"WITH p AS ({PARTICLES['duck']}) SELECT tag, x, vx FROM p WHERE type = 2 AND x BETWEEN -1e-1 AND 1e-1 AND y BETWEEN -2e-1 AND 2e-1 AND z BETWEEN -2e-1 AND 2e-1")
def particles_in_box(spark, sf):
    return particles(spark, sf).where((F.col("type") == 2) & geometry.inside_box([-0.1, -0.2, -0.2], [0.1, 0.2, 0.2], closed=True)).select("tag", "x", "vx")


_c30, _s30 = repr(math.cos(math.radians(30))), repr(math.sin(math.radians(30)))


@query(f"""WITH p AS ({PARTICLES['duck']}), r AS (SELECT tag, x * {_c30} - y * {_s30} AS x, x * {_s30} + y * {_c30} AS y, z FROM p)
SELECT tag, round((x - 1e-1) * 5e0 / (5e0 + z - 2e-1) + 1e-1, 9) AS px, round(y * 5e0 / (5e0 + z - 2e-1), 9) AS py, round(CASE WHEN abs(z) > 1e-1 THEN exp(-(abs(z) - 1e-1) / (2e-1 - 1e-1)) ELSE 1e0 END, 9) AS taper, round(2 / 2.5e0 * (1 + 5e-1 * (1e0 - z) / 2e0), 9) AS opacity FROM r""")
def rotated_perspective(spark, sf):
    p = particles(spark, sf)
    x, y, z = geometry.rotated(F.col("x"), F.col("y"), F.col("z"), (0, 0, 1), 30.0)
    p = p.select("tag", x.alias("x"), y.alias("y"), z.alias("z"))
    out = {"px": geometry.perspective(F.col("x"), F.col("z"), 5.0, 0.1, 0.2), "py": geometry.perspective(F.col("y"), F.col("z"), 5.0, 0.0, 0.2), "taper": geometry.taper(F.abs("z"), 0.1, 0.2), "opacity": geometry.opacity(F.col("z"), 1.0, 2.0, 0.5)}
    return p.select("tag", *(F.round(c, 9).alias(n) for n, c in out.items()))


@query(f"""WITH p AS ({PARTICLES['duck']}), s AS (SELECT * FROM (VALUES (-1), (0), (1)) t(s)) SELECT tag, a.s::BIGINT AS sx, b.s::BIGINT AS sy, c.s::BIGINT AS sz, round(x + a.s, 9) AS rx FROM p, s a, s b, s c
WHERE x + a.s BETWEEN -6e-1 AND 6e-1 AND y + b.s BETWEEN -6e-1 AND 6e-1 AND z + c.s BETWEEN -6e-1 AND 6e-1""")
def periodic_replicas(spark, sf):
    r = geometry.replicas(particles(spark, sf), (1.0, 1.0, 1.0)).where(geometry.inside_box([-0.6] * 3, [0.6] * 3, closed=True))
    return r.select("tag", "sx", "sy", "sz", F.round("x", 9).alias("rx"))


@query(f"WITH c AS ({CELLS}) SELECT block, CAST(floor(i / 4) AS BIGINT) AS ci, CAST(floor(j / 4) AS BIGINT) AS cj, CAST(floor(k / 4) AS BIGINT) AS ck, round({sql_mean('pres', 'dens')}, 4) AS value, count(*) AS n FROM c GROUP BY 1, 2, 3, 4")
def downsampled(spark, sf):
    return rounded(geometry.downsample(cells(spark, sf), 4, F.col("pres"), F.col("dens")), value=4)


PIX = f"""WITH c AS ({CELLS}), x AS (SELECT *, 5e-1 + i AS cx, 5e-1 + j AS cy, dvol AS d FROM c),
q AS (SELECT *, ix::BIGINT AS qx, iy::BIGINT AS qy FROM x, range(7) a(ix), range(7) b(iy))"""
_ov = lambda c, p: f"greatest(0e0, least({c} + d / 2, ({p} + 1) * 2.5e0) - greatest({c} - d / 2, {p} * 2.5e0))"
_w = f"({_ov('cx', 'qx')} * {_ov('cy', 'qy')} * d * dens)"


@query(PIX + f" SELECT qx AS ix, qy AS iy, round(sum(pres * {_w}) / sum({_w}), 4) AS value, round(sum({_w}), 4) AS weight FROM q WHERE {_w} > 1e-9 GROUP BY 1, 2")
def projection(spark, sf):
    c = cells(spark, sf).withColumns({"x": F.col("i") + 0.5, "y": F.col("j") + 0.5, "dx": F.col("dvol"), "dy": F.col("dvol"), "dz": F.col("dvol")})
    return rounded(geometry.project(c, F.col("pres"), (0.0, 0.0), 2.5, (7, 7), F.col("dens")), value=4, weight=4)


@query(f"""WITH c AS ({CELLS}), g AS (SELECT i::BIGINT AS ix, j::BIGINT AS iy, avg(pres) AS v FROM c GROUP BY 1, 2), s AS (SELECT a.ix + x.o AS ix, a.iy + y.o AS iy, v, exp(-(x.o * x.o + y.o * y.o) / (2 * {2 / 2.35482!r} * {2 / 2.35482!r})) AS k
FROM g a, (SELECT range - 3 AS o FROM range(7)) x, (SELECT range - 3 AS o FROM range(7)) y) SELECT ix, iy, round(sum(v * k) / sum(k), 4) AS value FROM s WHERE ix BETWEEN 0 AND 15 AND iy BETWEEN 0 AND 15 GROUP BY 1, 2""")
def smoothed_map(spark, sf):
    g = cells(spark, sf).groupBy(F.col("i").cast("long").alias("ix"), F.col("j").cast("long").alias("iy")).agg(F.avg("pres").alias("value"))
    return rounded(geometry.smooth(g, 2.0, (16, 16), reach=3), value=4)


def _blur_sql(widths: list[int], side: int) -> str:
    """CTEs g0 to g6: three box blurs along both axes, an edge's pixel repeated."""
    out, last = [], "g0"
    for n, (w, c, o) in enumerate((w, *axes) for w in widths for axes in (("ix", "iy"), ("iy", "ix"))):
        out.append(f"g{n + 1} AS (SELECT a.{c}, a.{o}, avg(b.v) AS v FROM {last} a, range({-(w // 2)}, {w // 2 + 1}) r(o) JOIN {last} b ON b.{o} = a.{o} AND b.{c} = least(greatest(a.{c} + r.o, 0), {side - 1}) GROUP BY 1, 2)")
        last = f"g{n + 1}"
    return ", ".join(out)


@query(f"WITH c AS ({CELLS}), g0 AS (SELECT (i % 8)::BIGINT AS ix, (j % 8)::BIGINT AS iy, avg(pres) AS v FROM c GROUP BY 1, 2), {_blur_sql(geometry.box_widths(5 / 2.35482), 8)} SELECT ix, iy, round(v, 4) AS value FROM g6")
def widely_smoothed_map(spark, sf):
    """A Gaussian wide enough to be three box blurs."""
    g = cells(spark, sf).groupBy((F.col("i") % 8).cast("long").alias("ix"), (F.col("j") % 8).cast("long").alias("iy")).agg(F.avg("pres").alias("value"))
    return rounded(geometry.smooth(g, 5.0, (8, 8)), value=4)


# ---------------------------------------------------------------- stencils and spectra
_n = 8
_nb = lambda a, s: {"x": f"(m.i + {s} + {_n}) % {_n} = n.i AND m.j = n.j AND m.k = n.k", "y": f"m.i = n.i AND (m.j + {s} + {_n}) % {_n} = n.j AND m.k = n.k", "z": f"m.i = n.i AND m.j = n.j AND (m.k + {s} + {_n}) % {_n} = n.k"}[a]
_grad = "WITH " + MEASURED_SQL + "".join(f", {a}{t} AS (SELECT m.i, m.j, m.k, n.velx AS u, n.vely AS v, n.velz AS w FROM mesh m JOIN mesh n ON {_nb(a, s)})" for a in "xyz" for t, s in (("p", 1), ("m", -1))) + \
    ", d AS (SELECT mesh.i, mesh.j, mesh.k, " + ", ".join(f"({a}p.{c} - {a}m.{c}) * 4e0 AS d{c}{a}" for a in "xyz" for c in "uvw") + " FROM mesh " + " ".join(f"JOIN {a}{t} USING (i, j, k)" for a in "xyz" for t in "pm") + ")"
_V = ("velx", "vely", "velz")


@query(_grad + """, o AS (SELECT i, j, k, dux + dvy + dwz AS divv, dwy - dvz AS wx, duz - dwx AS wy, dvx - duy AS wz,
 2 * 1e-1 * ((dux - (dux + dvy + dwz) / 3) * (dux - (dux + dvy + dwz) / 3) + (dvy - (dux + dvy + dwz) / 3) * (dvy - (dux + dvy + dwz) / 3) + (dwz - (dux + dvy + dwz) / 3) * (dwz - (dux + dvy + dwz) / 3)
 + 5e-1 * ((duy + dvx) * (duy + dvx) + (duz + dwx) * (duz + dwx) + (dvz + dwy) * (dvz + dwy))) AS diss FROM d)
SELECT i, j, k, round(divv + 0e0, 7) + 0e0 AS divv, round(sqrt(wx * wx + wy * wy + wz * wz), 7) AS vorticity, round(diss, 7) AS diss FROM o""")
def stencil_operators(spark, sf):
    d = stencil.derivatives(measured(spark, sf), list(_V), _n, 1 / _n)
    w = stencil.curl(_V)
    size = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    return d.select("i", "j", "k", (F.round(stencil.divergence(_V), 7) + 0.0).alias("divv"), F.round(size, 7).alias("vorticity"), F.round(stencil.dissipation(_V, F.lit(0.1)), 7).alias("diss"))


_dft = "WITH " + MEASURED_SQL + f""", f AS (SELECT a.i AS kx, a.j AS ky, a.k AS kz, sum(b.velx * cos({2 * math.pi / _n!r} * (a.i * b.i + a.j * b.j + a.k * b.k))) / {_n**3} AS re,
 sum(b.velx * sin({2 * math.pi / _n!r} * (a.i * b.i + a.j * b.j + a.k * b.k))) / {_n**3} AS im FROM m a, mesh b GROUP BY 1, 2, 3),
 p AS (SELECT re * re + im * im AS p, pow(CASE WHEN kx > 4 THEN kx - 8 ELSE kx END, 2) + pow(CASE WHEN ky > 4 THEN ky - 8 ELSE ky END, 2) + pow(CASE WHEN kz > 4 THEN kz - 8 ELSE kz END, 2) AS k2 FROM f)
SELECT CAST(greatest(1, floor(sqrt(k2) + 5e-1)) AS BIGINT) AS shell, count(*) AS n_modes, round(sum(p), 9) AS power, round(avg(p) * avg(k2) * 4 * pi(), 9) AS spectrum FROM p GROUP BY 1"""


@query(_dft)
def power_spectrum(spark, sf):
    out = spectral.shells(spectral.transform(measured(spark, sf), "velx", _n), _n)
    return rounded(out.select("shell", "n_modes", "power", "spectrum"), power=9, spectrum=9)


_wave = lambda c: f"(CASE WHEN {c} > 4 THEN {c} - 8 ELSE {c} END)"
_k2 = " + ".join(f"pow({_wave(c)}, 2)" for c in ("kx", "ky", "kz"))


def dft_sql(fields: dict[str, str], mesh: str = "mesh") -> str:
    """f: kx, ky, kz and re_, im_ of each field of an 8**3 mesh."""
    angle = f"{2 * math.pi / 8!r} * (a.i * b.i + a.j * b.j + a.k * b.k)"
    sums = ", ".join(f"sum(({e}) * cos({angle})) / 512 AS re_{n}, -sum(({e}) * sin({angle})) / 512 AS im_{n}" for n, e in fields.items())
    return f"f AS (SELECT a.i AS kx, a.j AS ky, a.k AS kz, {sums} FROM (SELECT i, j, k FROM {mesh}) a, {mesh} b GROUP BY 1, 2, 3)"


def split_sql(names=("u", "v", "w")) -> str:
    """s: k2, total, long and trans power of three fields' transforms."""
    along = lambda p: " + ".join(f"{_wave(c)} * {p}_{n}" for c, n in zip(("kx", "ky", "kz"), names))
    total = " + ".join(f"{p}_{n} * {p}_{n}" for p in ("re", "im") for n in names)
    return f"""s0 AS (SELECT *, {_k2} AS k2, {total} AS total FROM f), s1 AS (SELECT k2, total, CASE WHEN k2 > 0 THEN (pow({along('re')}, 2) + pow({along('im')}, 2)) / k2 ELSE 0e0 END AS long FROM s0),
s AS (SELECT k2, total, long, total - long AS trans, CAST(greatest(1, floor(sqrt(k2) + 5e-1)) AS BIGINT) AS bin FROM s1)"""


@query("WITH " + MEASURED_SQL + ", " + dft_sql({"u": "velx", "v": "vely", "w": "velz"}) + ", " + split_sql() + " SELECT bin AS shell, round(sum(long), 9) AS long, round(sum(trans), 9) AS trans FROM s GROUP BY 1")
def helmholtz_spectrum(spark, sf):
    d = measured(spark, sf)
    split = spectral.helmholtz([spectral.transform(d, v, _n) for v in _V], _n)
    k2 = spectral.shells(split, _n, F.col("long")).select("shell", F.round("power", 9).alias("long"))
    return k2.join(spectral.shells(split, _n, F.col("trans")).select("shell", F.round("power", 9).alias("trans")), "shell")


LAGS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)]
_lags = ", ".join(str(x) for x in LAGS)


@query("WITH " + MEASURED_SQL + f""", l AS (SELECT * FROM (VALUES {_lags}) t(a, b, c)), p AS (SELECT a * a + b * b + c * c AS r2, n.velx - m.velx AS du, n.vely - m.vely AS dv, n.velz - m.velz AS dw, a, b, c
 FROM mesh m, l JOIN mesh n ON n.i = (m.i + a) % {_n} AND n.j = (m.j + b) % {_n} AND n.k = (m.k + c) % {_n}),
 q AS (SELECT r2, abs((du * a + dv * b + dw * c) / sqrt(r2)) AS lo, sqrt(greatest(0e0, du * du + dv * dv + dw * dw - pow((du * a + dv * b + dw * c) / sqrt(r2), 2))) AS tr FROM p)
SELECT r2::BIGINT AS r2, count(*) AS n, round(avg(lo), 7) AS sf1_long, round(avg(tr), 6) AS sf1_trans, round(avg(lo * lo), 7) AS sf2_long, round(avg(tr * tr), 7) AS sf2_trans FROM q GROUP BY 1""")
def structure_function(spark, sf):
    out = pairs.structure_function(measured(spark, sf), _V, _n, LAGS, orders=2)
    return rounded(out, sf1_long=7, sf1_trans=6, sf2_long=7, sf2_trans=7)


# ---------------------------------------------------------------- particles
@query(f"""WITH p AS ({PARTICLES['duck']}) SELECT a.tag AS a_tag, count(*) AS near, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 9) AS nearest FROM p a JOIN p b ON a.tag <> b.tag
AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 4e-4 GROUP BY 1""")
def radius_search(spark, sf):
    p = particles(spark, sf).select("tag", "x", "y", "z")
    return pairs.within(p, p, 0.02).where("a_tag <> b_tag").groupBy("a_tag").agg(F.count("*").alias("near"), F.round(F.min("r"), 9).alias("nearest"))


@query(f"""WITH p AS ({PARTICLES['duck']}), s AS (SELECT * FROM p WHERE type = 2), e AS (SELECT g.tag AS a_tag, s.tag AS b_tag, 5e-1 * pow(g.vx - s.vx, 2) - s.mass / greatest(sqrt(pow(g.x - s.x, 2) + pow(g.y - s.y, 2) + pow(g.z - s.z, 2)), 1e-3) AS e
 FROM p g JOIN s ON g.type = 1 AND pow(g.x - s.x, 2) + pow(g.y - s.y, 2) + pow(g.z - s.z, 2) <= 2.5e-3), r AS (SELECT *, row_number() OVER (PARTITION BY a_tag ORDER BY e, b_tag) AS n FROM e)
SELECT a_tag, b_tag, round(e, 6) AS energy FROM r WHERE n = 1""")
def most_bound_sink(spark, sf):
    p = particles(spark, sf)
    met = pairs.within(p.where("type = 1").select("tag", "x", "y", "z", "vx"), p.where("type = 2").select("tag", "x", "y", "z", "vx", "mass"), 0.05)
    energy = 0.5 * F.pow(F.col("a_vx") - F.col("b_vx"), F.lit(2.0)) - F.col("b_mass") / F.greatest("r", F.lit(1e-3))
    return rounded(pairs.most_bound(met, energy), energy=6)


@query(f"WITH p AS ({PARTICLES['duck']}) SELECT tag FROM p a WHERE type = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.type = 2 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 2.5e-3)")
def far_from_sinks(spark, sf):
    p = particles(spark, sf)
    near = pairs.within(p.where("type = 1").select("tag", "x", "y", "z"), p.where("type = 2").select("tag", "x", "y", "z"), 0.05).select(F.col("a_tag").alias("tag"))
    return p.where("type = 1").join(near, "tag", "left_anti").select("tag")


@query(f"WITH p AS ({PARTICLES['duck']}) SELECT p.tag, p.mass FROM p WHERE tag IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def marked_tags(spark, sf):
    marked = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("tag"))
    return particles(spark, sf).join(marked, "tag", "left_semi").select("tag", "mass")


# ---------------------------------------------------------------- series, logs, dumps, ensembles
EV = "SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events"


def evs(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("""WITH e AS (SELECT event_id, user_id, value AS t FROM events), n AS (SELECT *, min(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM e)
SELECT event_id, user_id, t FROM n WHERE nx IS NULL OR t < nx""")
def cleaned_restarts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("value").alias("t"))
    return series.cleaned(e, "event_id", "t", ["user_id"])


@query("""WITH e AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT event_id, user_id, run::BIGINT AS run, round((epoch_us(lead(ts) OVER (PARTITION BY user_id, run ORDER BY event_id)) - epoch_us(ts)) / 1e6, 6) AS seconds FROM e""")
def log_step_durations(spark, sf):
    e = series.runs(spark.read.parquet(f"{sf}/events.parquet"), "event_id", F.col("event_id") % 97 == 0, ["user_id"])
    return rounded(series.step_durations(e, ["user_id", "run"], "event_id", "ts").select("event_id", "user_id", "run", "seconds"), seconds=6)


@query("""WITH e AS (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) / 1e6 AS s FROM events)
SELECT event_type, round(sum(s) * 64 / 36e2, 4) AS cpu_hours, round(quantile_cont(s, 1.6e-1), 4) AS p16, round(quantile_cont(s, 5e-1), 4) AS p50, round(quantile_cont(s, 8.4e-1), 4) AS p84 FROM e WHERE s IS NOT NULL GROUP BY 1""")
def log_performance(spark, sf):
    s = series.step_durations(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_id", "ts").where("seconds is not null")
    used = s.groupBy("event_type").agg((F.sum("seconds") * 64 / 3600.0).alias("cpu_hours"))
    return rounded(used.join(stats.percentiles(s, ["event_type"], "seconds", {"p16": 0.16, "p50": 0.5, "p84": 0.84}), "event_type"), cpu_hours=4, p16=4, p50=4, p84=4)


@query(f"""WITH e AS ({EV}), w AS (SELECT user_id, value AS x, (coalesce(lead(t) OVER u - t, 0e0) + coalesce(t - lag(t) OVER u, 0e0)) / 2 AS w FROM e WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(sum(x * w) / sum(w), 5) AS mean FROM w GROUP BY 1 HAVING sum(w) > 0""")
def series_moments(spark, sf):
    out = series.time_moments(evs(spark, sf).where("t is not null"), ["user_id"], "t", "value").where("mean is not null")
    return rounded(out.select("user_id", "mean"), mean=5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 1.5e5), o_orderkey DESC LIMIT 1")
def dump_find(spark, sf):
    return series.nearest_dump(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5e5, "o_orderkey")


ENS = f"WITH c AS ({CELLS}), f AS (SELECT block, CAST(floor(pres / 1e4) AS BIGINT) AS bin, sum(dens) AS v FROM c GROUP BY 1, 2)"


@query(ENS + " SELECT bin, count(*) AS files, round(avg(v), 4) AS mean, round(sqrt(greatest(0e0, avg(v * v) - avg(v) * avg(v))), 3) AS sigma, round(avg(log10(v)), 7) AS log_mean FROM f GROUP BY bin")
def ensemble_average(spark, sf):
    f = cells(spark, sf).groupBy("block", F.floor(F.col("pres") / 1e4).cast("long").alias("bin")).agg(F.sum("dens").alias("v"))
    lin = rounded(series.ensemble(f, "bin", "v"), mean=4, sigma=3)
    return lin.join(series.ensemble(f, "bin", "v", log=True).select("bin", F.round("mean", 7).alias("log_mean")), "bin")


@query("SELECT event_id AS line_no, CAST(event_id AS DOUBLE) AS t, round(value, 9) AS x FROM events WHERE event_id % 97 <> 0")
def series_text_round_trip(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("x"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 97 == 0, "# simulation restarted").otherwise(F.concat(F.format_string(" %23.16E", "t"), F.format_string(" %23.16E", "x"))).alias("value"))
    return rounded(text.parse_series(lines, ["t", "x"]), x=9)


@query("WITH p AS (SELECT s_nationkey AS block, s_suppkey, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS leaf FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY leaf DESC, s_suppkey) AS n FROM p) SELECT block, s_suppkey, s_acctbal, leaf FROM r WHERE n = 1")
def merged_blocks(spark, sf):
    p = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("block"), "s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0).alias("leaf"))
    return text.merge_split(p, ["block"], "leaf", "s_suppkey")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return rounded(streaming.windowed(spark.read.parquet(f"{sf}/events.parquet")), mean=6)


# ---------------------------------------------------------------- sinks
def _phase(base: int) -> str:
    parts = ", ".join(f"CAST(embedding[{base + i}] AS DOUBLE) AS {c}" for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz")))
    return f"SELECT vec_id AS tag, label % 2 + 1 AS type, 1e0 + label AS mass, {parts} FROM embeddings"


PHASE = _phase(1)
_d2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"


def phase(spark, sf):
    return view(spark, sf, "embeddings", _phase(0))


@query(f"""WITH p AS ({PHASE}), s AS (SELECT * FROM p WHERE type = 2), g AS (SELECT * FROM p WHERE type = 1),
n AS (SELECT a.tag AS gas, b.tag AS sink, row_number() OVER (PARTITION BY a.tag ORDER BY 5e-1 * (pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2) + pow(a.vz - b.vz, 2)) - b.mass / greatest(sqrt({_d2}), 1e-3), b.tag) AS o FROM g a JOIN s b ON {_d2} <= 2.5e-3),
t AS (SELECT sink, sum(mass) AS m, sum(mass * x) AS mx, sum(mass * vx) AS px, sum(mass * (x * vy - y * vx)) AS l, sum(mass * y) AS my, sum(mass * vy) AS py FROM n JOIN g ON gas = tag WHERE o = 1 GROUP BY 1),
q AS (SELECT s.*, coalesce(m, 0e0) AS m, coalesce(mx, 0e0) AS mx, coalesce(my, 0e0) AS my, coalesce(px, 0e0) AS px, coalesce(py, 0e0) AS py, coalesce(l, 0e0) AS l FROM s LEFT JOIN t ON sink = tag)
SELECT tag, round(mass + m, 6) AS mass, round((mass * x + mx) / (mass + m), 7) AS x, round((mass * vx + px) / (mass + m), 7) AS vx,
 round(mass * (x * vy - y * vx) + l - ((mass * x + mx) * (mass * vy + py) - (mass * y + my) * (mass * vx + px)) / (mass + m), 6) + 0e0 AS lz FROM q""")
def sink_accretion(spark, sf):
    p = phase(spark, sf)
    gas, held = p.where("type = 1"), p.where("type = 2").withColumns({c: F.lit(0.0) for c in ("lx", "ly", "lz")})
    v = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in sinks.VELOCITY]
    met = pairs.within(gas.select("tag", "x", "y", "z", "vx", "vy", "vz"), held.select("tag", "x", "y", "z", "vx", "vy", "vz", "mass"), 0.05)
    goes = pairs.most_bound(met, 0.5 * sinks.dot(v, v) - F.col("b_mass") / F.greatest("r", F.lit(1e-3))).select(F.col("a_tag").alias("tag"), F.col("b_tag").alias("sink"))
    out = sinks.accreted(gas.join(goes, "tag"), held).select("tag", "mass", "x", "vx", "lz")
    return rounded(out, mass=6, x=7, vx=7, lz=6).withColumn("lz", F.col("lz") + F.lit(0.0))


@query(f"""WITH p AS ({PHASE}), c AS (SELECT a.tag AS a_tag, b.tag AS b_tag, b.mass AS m FROM p a JOIN p b ON {_d2} <= 1e-2 AND (a.mass < b.mass OR (a.mass = b.mass AND a.tag > b.tag))
 AND (a.x - b.x) * (a.vx - b.vx) + (a.y - b.y) * (a.vy - b.vy) + (a.z - b.z) * (a.vz - b.vz) < 0
 AND 5e-1 * (pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2) + pow(a.vz - b.vz, 2)) * sqrt({_d2}) < 1e-3 * (a.mass + b.mass)),
f AS (SELECT a_tag, b_tag FROM (SELECT *, row_number() OVER (PARTITION BY a_tag ORDER BY m DESC, b_tag) AS o FROM c) WHERE o = 1),
g AS (SELECT * FROM f WHERE b_tag NOT IN (SELECT a_tag FROM f)), q AS (SELECT p.*, coalesce(b_tag, tag) AS root FROM p LEFT JOIN g ON a_tag = tag)
SELECT root AS tag, count(*) AS parts, round(sum(mass), 6) AS mass, round(sum(mass * x) / sum(mass), 7) AS x, round(sum(mass * vz) / sum(mass), 7) AS vz FROM q GROUP BY 1""")
def sink_merging(spark, sf):
    return rounded(sinks.merged(phase(spark, sf), 0.1, 1e-3).select("tag", "parts", "mass", "x", "vz"), mass=6, x=7, vz=7)


@query(f"""WITH RECURSIVE p AS ({PHASE}), l AS (SELECT a.tag AS a, b.tag AS b FROM p a JOIN p b ON {_d2} <= 1.6e-3), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS tag, min(b) AS cluster FROM r GROUP BY 1""")
def sink_clusters(spark, sf):
    return sinks.clusters(phase(spark, sf), 0.04)


_far = f"greatest(sqrt({_d2}), 5e-2)"


@query(f"""WITH p AS ({PHASE}) SELECT a.tag, round(sum(b.mass * (b.x - a.x) / pow({_far}, 3)), 3) AS ax, round(sum(b.mass * CASE WHEN sqrt({_d2}) < 5e-2 THEN ({_d2}) / (2 * pow(5e-2, 3)) - 3 / 1e-1 ELSE -1 / sqrt({_d2}) END), 4) AS phi FROM p a, p b WHERE a.type = 1 AND b.type = 2 GROUP BY 1""")
def sink_gravity(spark, sf):
    p = phase(spark, sf)
    return rounded(sinks.gravity(p.where("type = 1").select("tag", "x", "y", "z"), p.where("type = 2"), 0.05).select("tag", "ax", "phi"), ax=3, phi=4)


# ---------------------------------------------------------------- regridding, light, filters, series
@query(f"""WITH c AS ({CELLS}), m AS (SELECT j AS iy, i AS ix, avg(pres) AS v FROM c GROUP BY 1, 2), o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o),
e AS (SELECT iy, min(ix) AS lo, max(ix) AS hi FROM m GROUP BY 1)
SELECT a.ix, a.iy, round(sum(b.v) / 5e0, 4) AS value FROM m a JOIN e USING (iy), o JOIN m b ON b.iy = a.iy AND b.ix = least(greatest(a.ix + o, lo), hi) GROUP BY 1, 2""")
def blurred_map(spark, sf):
    m = cells(spark, sf).groupBy(F.col("i").alias("ix"), F.col("j").alias("iy")).agg(F.avg("pres").alias("value"))
    return rounded(geometry.box_blur(m, "ix", "iy", 2), value=4)


_halved = "SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, v FROM (SELECT (j + 3) % 16 AS iy, (i + 5) % 16 AS ix, avg(pres) AS v FROM c GROUP BY 1, 2)"


@query(f"WITH c AS ({CELLS}), m AS ({_halved}) SELECT ix // 2 AS ix, iy // 2 AS iy, round(avg(v), 4) AS value FROM m GROUP BY 1, 2")
def rolled_resampled_map(spark, sf):
    m = cells(spark, sf).groupBy(F.col("i").cast("long").alias("ix"), F.col("j").cast("long").alias("iy")).agg(F.avg("pres").alias("value"))
    return rounded(geometry.resampled(geometry.rolled(m, (5, 3), (16, 16)), (16, 16), (8, 8)), value=4)


@query("WITH " + MEASURED_SQL + f""", s AS (SELECT (i + 1) % {_n} AS i, (j + 2) % {_n} AS j, k, velx FROM mesh)
SELECT i // 2 AS ix, j // 2 AS iy, k // 2 AS iz, round(avg(velx), 8) + 0e0 AS value FROM s GROUP BY 1, 2, 3""")
def periodic_extraction(spark, sf):
    d = measured(spark, sf).select(*((F.col(c) + 0.5).alias(a) for c, a in zip("ijk", "xyz")), *(F.lit(1.0).alias(f"d{a}") for a in "xyz"), "velx")
    out = geometry.extract(d, F.col("velx"), (-1.0, -2.0, 0.0), 2.0, (_n // 2,) * 3, lengths=(float(_n),) * 3).select("ix", "iy", "iz", "value")
    return rounded(out, value=8).withColumn("value", F.col("value") + F.lit(0.0))


@query("WITH " + MEASURED_SQL + ", " + dft_sql({"f": "velx + vely"}) + f""", g AS (SELECT kx, ky, kz, re_f AS re, im_f AS im FROM f WHERE {_k2} < 4)
SELECT m.i, m.j, m.k, round(sum(re * cos({2 * math.pi / 8!r} * (m.i * kx + m.j * ky + m.k * kz)) - im * sin({2 * math.pi / 8!r} * (m.i * kx + m.j * ky + m.k * kz))), 8) + 0e0 AS value FROM m, g GROUP BY 1, 2, 3""")
def low_pass_filter(spark, sf):
    d = measured(spark, sf).select("i", "j", "k", (F.col("velx") + F.col("vely")).alias("f"))
    low = spectral.filtered(spectral.transform(d, "f", _n), spectral.top_hat(_n, 0.0, 2.0))
    return rounded(spectral.inverse(low, _n, "value"), value=8).withColumn("value", F.col("value") + F.lit(0.0))


@query(f"""WITH p AS ({PHASE}), g AS (SELECT * FROM p WHERE type = 1), s AS (SELECT * FROM p WHERE type = 2), t AS (SELECT s.tag, sum(mass_g * greatest(0e0, least(1e-1, gz + 5e-2 - s.z))) AS tau FROM s
 JOIN (SELECT x AS gx, y AS gy, z AS gz, mass AS mass_g FROM g) ON s.x >= gx - 1e-1 / 2 AND s.x < gx + 1e-1 / 2 AND s.y >= gy - 1e-1 / 2 AND s.y < gy + 1e-1 / 2 GROUP BY 1)
SELECT tag, round(coalesce(tau, 0e0), 6) AS tau, round(mass * exp(-coalesce(tau, 0e0)), 6) AS light FROM s LEFT JOIN t USING (tag)""")
def starlight(spark, sf):
    p = phase(spark, sf)
    gas = p.where("type = 1").select("x", "y", "z", *(F.lit(0.1).alias(f"d{a}") for a in "xyz"), F.col("mass").alias("dens"))
    stars = p.where("type = 2").select("tag", "x", "y", "z", F.col("mass").alias("luminosity"))
    return rounded(geometry.starlight(stars, gas, 1.0, 0.1).select("tag", "tau", "light"), tau=6, light=6)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, t, avg(value) AS x FROM ({EV}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, min(t) OVER (PARTITION BY user_id) AS t_from, max(t) OVER (PARTITION BY user_id) AS t_to,
 t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lag(t) OVER w AS tp, lag(x) OVER w AS xp FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT *, CASE WHEN pos = 1 THEN 0e0 WHEN pos = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS low, CASE WHEN pos = n - 2 THEN 0e0 WHEN pos = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS up, CASE WHEN n = 3 THEN h0 + h1 ELSE 2 * (h0 + h1) + CASE WHEN pos = 1 THEN h0 * (1 + h0 / h1) ELSE 0 END
 + CASE WHEN pos = n - 2 THEN h1 * (1 + h1 / h0) ELSE 0 END END AS mid, CASE WHEN n = 3 THEN 2 ELSE 6 END * ((x1 - x) / h1 - (x - xp) / h0) AS rhs FROM r WHERE pos BETWEEN 1 AND n - 2),
f AS (SELECT user_id, pos, n, mid, rhs, up FROM c WHERE pos = 1 UNION ALL SELECT c.user_id, c.pos, c.n, c.mid - c.low / f.mid * f.up, c.rhs - c.low / f.mid * f.rhs, c.up FROM f JOIN c ON c.user_id = f.user_id AND c.pos = f.pos + 1),
b AS (SELECT user_id, pos, rhs / mid AS m FROM f WHERE pos = n - 2 UNION ALL SELECT f.user_id, f.pos, (f.rhs - f.up * b.m) / f.mid FROM b JOIN f ON f.user_id = b.user_id AND f.pos = b.pos - 1),
p AS (SELECT c.user_id, n, t_from, t_to, t AS t0, x AS x0, t1, x1, b.m AS m0, a.m AS m1, CASE WHEN c.pos = 1 THEN t_from ELSE t END AS lo, CASE WHEN c.pos = n - 3 THEN t_to ELSE t1 END AS hi FROM c JOIN b ON b.user_id = c.user_id AND b.pos = c.pos JOIN b a ON a.user_id = c.user_id AND a.pos = c.pos + 1
 UNION ALL SELECT c.user_id, n, t_from, t_to, tp, xp, t, x, m, m, t_from, t FROM c JOIN b USING (user_id, pos) WHERE n = 3 UNION ALL SELECT c.user_id, n, t_from, t_to, t, x, t1, x1, m, m, t, t_to FROM c JOIN b USING (user_id, pos) WHERE n = 3
 UNION ALL SELECT user_id, n, t_from, t_to, t, x, coalesce(t1, t + 1), coalesce(x1, x), 0e0, 0e0, t_from, t_to FROM r WHERE n < 3 AND pos = 0),
j AS (SELECT user_id, n, t_from, CASE WHEN n > 1 THEN (t_to - t_from) / (n - 1) ELSE 0e0 END AS step, t_to, unnest(range(n)) AS j FROM (SELECT DISTINCT user_id, n, t_from, t_to FROM r)), s AS (SELECT user_id, t_from + j * step AS tj, j = n - 1 AS final FROM j),
q AS (SELECT s.user_id AS who, tj, p.*, p.t1 - p.t0 AS h, p.t1 - tj AS u, tj - p.t0 AS v FROM s JOIN p ON s.user_id = p.user_id AND ((NOT final AND tj >= lo AND tj < hi) OR (final AND hi = t_to)))
SELECT who AS user_id, round(tj, 3) AS t, round((m0 * u * u * u + m1 * v * v * v) / (6 * h) + (x0 / h - m0 * h / 6) * u + (x1 / h - m1 * h / 6) * v, 6) AS x FROM q""")
def series_spline(spark, sf):
    return rounded(series.spline(evs(spark, sf).groupBy("user_id", "t").agg(F.avg("value").alias("value")), ["user_id"], "t", "value"), t=3, x=6)


def queries() -> dict[str, Callable]:
    from . import fields, meshes, tables, views  # noqa: F401, PLC0415  (they add theirs)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
