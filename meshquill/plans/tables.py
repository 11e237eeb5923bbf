"""Queries of table files, logs, parameters and dumps on the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import series, sinks, stats
from ..sources import tables, text
from .queries import CELLS, cells, evs, query, rounded

# ---------------------------------------------------------------- table files
_pdf = f"""WITH c AS ({CELLS}), g AS (SELECT block, CAST(trunc(pres / 1e4) AS BIGINT) + 1 AS bin, sum(dens) AS w FROM c WHERE pres < 11e4 GROUP BY 1, 2), p AS (SELECT block, bin, w / sum(w) OVER (PARTITION BY block) / 1e4 AS pdf, sum(w) OVER (PARTITION BY block ORDER BY bin) / sum(w) OVER (PARTITION BY block) AS cdf FROM g)"""


def _pdfs(spark, sf):
    """A PDF table of each block."""
    return stats.pdf(cells(spark, sf), F.col("pres"), F.col("dens"), 0.0, 11e4, 1e4, key=("block",)).select("block", "bin", "pdf", "cdf")


@query(f"{_pdf} SELECT bin, count(*) AS files, round(avg(pdf), 10) AS pdf, round(sqrt(greatest(0e0, avg(pdf * pdf) - avg(pdf) * avg(pdf))), 9) AS sigma_pdf, round(avg(cdf), 8) AS cdf, round(sqrt(greatest(0e0, avg(cdf * cdf) - avg(cdf) * avg(cdf))), 6) AS sigma_cdf FROM p GROUP BY 1")
def averaged_pdfs(spark, sf):
    return rounded(series.ensembles(_pdfs(spark, sf), "bin", ["pdf", "cdf"]), pdf=10, sigma_pdf=9, cdf=8, sigma_cdf=6)


_spec = f"WITH c AS ({CELLS}), g AS (SELECT block, k AS bin, sum(pres) AS p FROM c GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER (PARTITION BY block) AS total FROM g)"


def _spectra(spark, sf):
    t = cells(spark, sf).groupBy("block", F.col("k").alias("bin")).agg(F.sum("pres").alias("p"))
    return t.join(t.groupBy("block").agg(F.sum("p").alias("total")), "block")


@query(f"{_spec} SELECT bin, count(*) AS files, round(avg(log10(p / total)), 8) AS log_mean, round(sqrt(greatest(0e0, avg(pow(log10(p / total), 2)) - pow(avg(log10(p / total)), 2))), 6) AS log_sigma FROM t GROUP BY 1")
def normalised_spectra(spark, sf):
    return rounded(series.ensemble_spectra(_spectra(spark, sf), "bin", "p", "total"), log_mean=8, log_sigma=6)


@query(f"{_spec} SELECT bin, count(*) AS files, round(pow(1e1, avg(log10(p))), 3) AS mean, round(sqrt(greatest(0e0, avg(pow(log10(p), 2)) - pow(avg(log10(p)), 2))), 6) AS log_sigma FROM t GROUP BY 1")
def log_averaged_functions(spark, sf):
    return rounded(series.ensemble_log(_spectra(spark, sf), "bin", "p"), mean=3, log_sigma=6)


@query(f"{_spec} SELECT bin, count(*) AS files FROM t WHERE NOT (block = 3 AND bin > 5) GROUP BY 1 HAVING count(*) <> 8")
def misaligned_bins(spark, sf):
    t = _spectra(spark, sf).where("not (block = 3 and bin > 5)")
    return series.misaligned(t, "bin", "block")


@query(f"{_spec} SELECT block, bin, p FROM t")
def table_text_round_trip(spark, sf):
    t = _spectra(spark, sf).select("block", "bin", "p")
    lines = tables.table_lines(t, "block", "bin", ["bin", "p"], ["a table", "of a block"])
    return tables.parse_table(lines, ["bin", "p"], 3, key=("block",)).select("block", F.col("bin").cast("int").alias("bin"), "p")


# ---------------------------------------------------------------- logs
_log = "SELECT user_id AS file, event_id, ts, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS head, CASE WHEN event_id % 11 = 0 THEN event_id % 13 + 1 END AS leaf FROM events"


def _log_lines(spark, sf):
    """A log of each user: headers with tasks and zones, leaf blocks, and a step for each event."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("file"), "event_id", "ts")
    leaf = F.col("event_id") % 13 + 1
    head = F.when(F.col("event_id") % 97 == 0, F.array(F.lit("CODE log file:  a"), F.lit(" Number of MPI tasks:          16"), *(F.lit(f" Number {c} zones:             8") for c in "xyz"))).otherwise(F.array().cast("array<string>"))
    grid = F.when(F.col("event_id") % 11 == 0, F.array(F.concat(F.lit(" [ 01-01-2024 ] [GRID amr_refine_derefine] min leaf blks "), leaf.cast("string"), F.lit("    max leaf blks "), leaf.cast("string"), F.lit("    tot leaf blks 9")))).otherwise(F.array().cast("array<string>"))
    step = F.array(F.concat(F.lit(" [ "), F.date_format("ts", "MM-dd-yyyy  HH:mm:ss.SSS"), F.lit(" ] step: n="), F.col("event_id").cast("string"), F.lit(" t=1.000000E+00 dt=5.000000E-01")))
    lines = F.posexplode(F.concat(head, grid, step)).alias("p", "value")
    return e.select("file", "event_id", lines).select("file", (F.col("event_id") * 10 + F.col("p")).alias("line_no"), "value")


@query(f"""WITH e AS ({_log}), r AS (SELECT *, sum(head) OVER (PARTITION BY file ORDER BY event_id)::BIGINT AS run, coalesce(last_value(leaf IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)::BIGINT AS seen, lead(leaf) OVER (PARTITION BY file ORDER BY event_id) AS nx, lead(head) OVER (PARTITION BY file ORDER BY event_id) AS nh FROM e),
s AS (SELECT file, run, event_id AS n, CASE WHEN nx IS NOT NULL THEN nx ELSE seen END::BIGINT AS max_leaf FROM r) SELECT file, run, count(*) AS steps, CASE WHEN run > 0 THEN 16::BIGINT ELSE 0::BIGINT END AS n_procs, CASE WHEN run > 0 THEN 512::BIGINT ELSE 0::BIGINT END AS cells, sum(max_leaf)::BIGINT AS leaves FROM s GROUP BY 1, 2""")
def parsed_log(spark, sf):
    log = text.parse_log(_log_lines(spark, sf), key=("file",))
    return log.groupBy("file", "run").agg(F.count("*").alias("steps"), F.coalesce(F.max("n_procs"), F.lit(0)).alias("n_procs"), F.coalesce(F.max("cells"), F.lit(0)).alias("cells"), F.sum("max_leaf").alias("leaves"))


_dur = f"WITH e AS ({_log}), s AS (SELECT event_type, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) / 1e6 / 512 / (1 + event_id % 7) AS c FROM events), d AS (SELECT * FROM s WHERE c > 0)"


def _costs(spark, sf):
    d = series.step_durations(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_id", "ts")
    return d.select("event_type", "event_id", (F.col("seconds") / 512 / (1 + F.col("event_id") % 7)).alias("c")).where("c > 0")


@query(f"{_dur} SELECT event_type, count(*) AS n, round(quantile_cont(c, 16e-2), 6) AS p16, round(quantile_cont(c, 5e-1), 6) AS p50, round(quantile_cont(c, 84e-2), 6) AS p84 FROM d GROUP BY 1")
def time_per_cell_and_step(spark, sf):
    d = _costs(spark, sf)
    return rounded(d.groupBy("event_type").agg(F.count("*").alias("n")).join(stats.percentiles(d, ["event_type"], "c", {"p16": 0.16, "p50": 0.5, "p84": 0.84}), "event_type"), p16=6, p50=6, p84=6)


@query(f"{_dur}, g AS (SELECT CAST(trunc((log10(c) + 4e0) / 5e-1) AS BIGINT) + 1 AS bin, count(*) AS n FROM d WHERE log10(c) > -45e-1 AND log10(c) < 4e0 GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cdf FROM g")
def performance_pdf(spark, sf):
    return rounded(stats.pdf(_costs(spark, sf), F.col("c"), F.lit(1.0), -4.0, 4.0, 0.5, log=True).select("bin", "n", "cdf"), cdf=9)


@query("WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) SELECT event_id, user_id FROM e WHERE a <= 3 OR b <= 3")
def first_and_last_steps(spark, sf):
    return series.first_and_last(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), ["user_id"], "event_id")


@query("WITH e AS (SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS d FROM events WHERE event_id % 50 <> 7) SELECT event_id FROM e WHERE d <> 1")
def steps_out_of_order(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 50 <> 7").withColumn("run", F.col("user_id") % 2)
    return series.out_of_order(e, ["run"], "event_id").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE value BETWEEN 1e1 AND 2e1")
def series_in_window(spark, sf):
    return series.in_window(evs(spark, sf), "value", 10.0, 20.0).select("event_id", "user_id")


@query("WITH e AS (SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN event_id % 9 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events) SELECT event_id, coalesce(seen, 1)::BIGINT AS leaf FROM e")
def last_seen_blocks(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 9).alias("leaf"))
    return series.carried(e, ["user_id"], "event_id", ["leaf"]).select("event_id", F.col("leaf").cast("long").alias("leaf"))


MARKED = """SELECT event_id AS line_no, CASE WHEN event_id % 50 = 7 THEN '# simulation restarted' WHEN event_id % 50 = 8 THEN '0.0 ' || user_id WHEN event_id % 50 = 9 THEN 'not a row' ELSE (event_id % 400) || '.5 ' || user_id END AS value FROM events"""


@query(f"""WITH l AS ({MARKED}), m AS (SELECT *, lag(value) OVER (ORDER BY line_no) AS before FROM l) SELECT line_no, split_part(value, ' ', 1)::DOUBLE AS t, split_part(value, ' ', 2)::DOUBLE AS x FROM m
 WHERE value NOT LIKE '#%' AND value <> 'not a row' AND NOT (coalesce(before, '') LIKE '#%' AND split_part(value, ' ', 1)::DOUBLE = 0)""")
def restarted_tables(spark, sf):
    """Evolution tables with restart markers, after each of which a row at time 0 is left out."""
    lines = spark.sql(MARKED.replace("FROM events", "FROM {t}"), t=spark.read.parquet(f"{sf}/events.parquet"))
    return text.parse_series(lines, ["t", "x"])


# ---------------------------------------------------------------- parameters and dumps
NAMED = """SELECT 'name_' || n_nationkey || CASE n_nationkey % 4 WHEN 0 THEN ' = ' || n_regionkey WHEN 1 THEN ' = ' || n_regionkey || '.25' WHEN 2 THEN ' = .true.' ELSE ' = "' || n_name || '"' END AS value, n_nationkey AS line_no FROM nation"""


@query("""SELECT 'name_' || n_nationkey AS name, CASE n_nationkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'real' WHEN 2 THEN 'bool' ELSE 'str' END AS kind,
 CASE n_nationkey % 4 WHEN 0 THEN CASE WHEN n_nationkey = 4 THEN '77' ELSE n_regionkey::VARCHAR END WHEN 1 THEN n_regionkey || '.25' WHEN 2 THEN 'true' ELSE n_name END AS value FROM nation""")
def typed_parameters(spark, sf):
    lines = spark.sql(NAMED.replace("FROM nation", "FROM {t}"), t=spark.read.parquet(f"{sf}/nation.parquet"))
    return tables.as_text(tables.overwritten(tables.parse_parameters(lines), {"name_4": 77}))


KIND = """SELECT CASE r_regionkey WHEN 0 THEN 'dimensionality = 3' WHEN 1 THEN 'lrefine_max = ' || length(r_name) WHEN 2 THEN 'xl_boundary_type = "' || lower(r_name) || '"' ELSE 'other_' || r_regionkey || ' = 1.5' END AS value, r_regionkey AS line_no FROM region"""


@query("SELECT 'A' AS grid_type, lower(r_name) AS boundary, 3 AS ndim FROM region WHERE r_regionkey = 2")
def grid_kind(spark, sf):
    lines = spark.sql(KIND.replace("FROM region", "FROM {t}"), t=spark.read.parquet(f"{sf}/region.parquet"))
    return tables.grid_kind(tables.parse_parameters(lines), extracted=False)


_dumps = "SELECT o_orderkey % 50 AS dump, o_custkey AS tag, o_totalprice AS mass, epoch_us(o_orderdate) / 1e6 AS time FROM orders"


def _dump_rows(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select((F.col("o_orderkey") % 50).alias("dump"), F.col("o_custkey").alias("tag"), F.col("o_totalprice").alias("mass"), (F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) * 86400.0).alias("time"))


@query(f"WITH d AS ({_dumps}) SELECT dump, max(time) AS time, count(*) AS sinks, round(sum(mass), 2) AS mass, max(mass) AS max_mass FROM d GROUP BY 1")
def dump_summary(spark, sf):
    return rounded(tables.dump_summary(_dump_rows(spark, sf)), mass=2)


@query(f"WITH d AS ({_dumps}), s AS (SELECT dump, sum(mass) AS mass FROM d GROUP BY 1) SELECT 'run_hdf5_plt_cnt_' || lpad(dump::VARCHAR, 4, '0') AS plt, 'run_hdf5_part_' || lpad(dump::VARCHAR, 4, '0') AS part FROM s WHERE dump % 3 = 0")
def plot_and_particle_files(spark, sf):
    d = tables.dump_summary(_dump_rows(spark, sf)).select(F.lpad(F.col("dump").cast("string"), 4, "0").alias("n"))
    names = d.select(F.concat(F.lit("run_hdf5_plt_cnt_"), "n").alias("path")).unionAll(d.where(F.col("n").cast("int") % 3 == 0).select(F.concat(F.lit("run_hdf5_part_"), "n").alias("path")))
    return tables.paired_files(names)


@query("SELECT s_suppkey AS part_tag, s_acctbal AS time, round(s_suppkey * 1e-3, 9) AS posx, s_nationkey * 1e0 AS mass FROM supplier")
def sink_dump_round_trip(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    given = {"part_tag": F.col("s_suppkey"), "time": F.col("s_acctbal"), "posx": F.col("s_suppkey") * 1e-3, "mass": F.col("s_nationkey").cast("double")}
    rows = s.select(*(given.get(c, F.lit(0.0)).alias(c) for c in tables.SINK_COLUMNS))
    lines = tables.sink_lines(rows).select("part_tag", F.col("part_tag").alias("line_no"), "value")
    back = tables.parse_sinks(lines)
    return back.select("part_tag", F.round("time", 2).alias("time"), F.round("posx", 9).alias("posx"), "mass")


@query("SELECT s_nationkey AS block, count(*) AS n FROM (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 1) GROUP BY 1")
def joined_split_files(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("block"), "s_suppkey")
    return text.joined([s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 2 = 1")]).groupBy("block").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'map' WHEN s_suppkey % 5 = 1 THEN 'plt' WHEN s_suppkey % 5 = 2 THEN 'chk' WHEN s_suppkey % 5 = 3 THEN 'part' ELSE 'other' END AS kind, count(*) AS n FROM supplier GROUP BY 1")
def file_kinds(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    names = ["a_hdf5_plt_cnt_0001_dens_proj_z.h5", "a_hdf5_plt_cnt_0001", "a_hdf5_chk_0001", "a_hdf5_part_0001", "a.log"]
    path = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return s.select(text.file_kind(path).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_months = "SELECT (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS dump, o_orderkey, o_totalprice, o_orderdate FROM orders"


@query(f"""WITH d AS ({_months}), v AS (SELECT dump, max(epoch_us(o_orderdate) / 864e8) AS value FROM d GROUP BY 1), w AS (SELECT unnest([9e3, 95e2, 0e0, 1e6]) AS wanted),
r AS (SELECT wanted, dump, value, row_number() OVER (PARTITION BY wanted ORDER BY abs(value - wanted), dump DESC) AS n FROM w, v) SELECT wanted, dump::BIGINT AS dump, round(value, 6) AS value FROM r WHERE n = 1""")
def dumps_by_bisection(spark, sf):
    """Dumps written in a folder each; of four searches each reads some seven of eighty."""
    path = f"{sinks.checkpoint_folder(spark)}/dumps-{uuid.uuid4().hex}"
    o = spark.read.parquet(f"{sf}/orders.parquet").select(((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("dump"), "o_orderkey", "o_totalprice", "o_orderdate")
    o.repartition("dump").write.partitionBy("dump").parquet(path)
    dumps, numbers = spark.read.parquet(path), series.folders(spark, path, "dump")
    value = F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 864e8)
    found = [(w, *series.find_dump(dumps, "dump", numbers, value, w)) for w in (9e3, 95e2, 0.0, 1e6)]
    return rounded(spark.createDataFrame(found, "wanted double, dump long, value double"), value=6)
