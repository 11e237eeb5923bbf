"""Mesh queries against their SQL in DuckDB, and invariants of the operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquill.functions import models
from meshquill.operators import geometry, series, sinks, spectral, stats, stencil
from meshquill.plans import queries as mesh
from meshquill.sources import text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(mesh.oracle_sql()))
def test_oracle(spark, con, name):
    got, want = mesh.queries()[name](spark, SF).toPandas(), con.sql(mesh.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_test(spark):
    assert set(mesh.queries()) == set(mesh.oracle_sql())


def test_parseval_and_mode_count(spark):
    n = 8
    d = mesh.dense(spark, n)
    s = spectral.shells(spectral.transform(d, "velx", n), n).agg(F.sum("power").alias("p"), F.sum("n_modes").alias("m")).first()
    real = d.agg(F.avg(F.col("velx") * F.col("velx"))).first()[0]
    assert s["m"] == n**3 and abs(s["p"] - real) < 1e-12


def test_helmholtz_adds_up(spark):
    n = 8
    d = mesh.dense(spark, n)
    h = spectral.helmholtz([spectral.transform(d, v, n) for v in ("velx", "vely", "velz")], n).agg(F.sum("total"), F.sum("long"), F.sum("trans")).first()
    real = d.agg(F.avg(F.col("velx") ** 2 + F.col("vely") ** 2 + F.col("velz") ** 2)).first()[0]
    assert abs(h[0] - real) < 1e-12 and abs(h[1] + h[2] - h[0]) < 1e-12 and h[1] >= 0 and h[2] >= 0


def test_pdf_ends_at_one_and_projection_conserves(spark):
    c = mesh.cells(spark, SF)
    assert abs(stats.pdf(c, F.col("pres"), F.col("dens"), 0.0, 105e3, 5e3).agg(F.max("cdf")).first()[0] - 1) < 1e-12
    one = spark.createDataFrame([(3.0, 3.0, 2.5, 2.5, 1.0, 7.0)], "x double, y double, dx double, dy double, dz double, v double")
    p = geometry.project(one, F.col("v"), (0.0, 0.0), 1.0, (8, 8))
    assert abs(p.agg(F.sum("weight")).first()[0] - 6.25) < 1e-12 and {r["value"] for r in p.collect()} == {7.0}


def test_divergence_of_curl_vanishes(spark):
    n = 8
    w = stencil.curl(("velx", "vely", "velz"))
    c = stencil.derivatives(mesh.dense(spark, n), ["velx", "vely", "velz"], n, 1 / n).select("i", "j", "k", *(x.alias(f"w{a}") for x, a in zip(w, "xyz")))
    d = stencil.derivatives(c, ["wx", "wy", "wz"], n, 1 / n).agg(F.max(F.abs(stencil.divergence(("wx", "wy", "wz"))))).first()[0]
    assert d < 1e-9


def test_split_cells_keeps_volume(spark):
    c = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0)], "level int, x double, y double, z double, dx double, dy double, dz double")
    s = geometry.split_cells(c, 3)
    assert s.count() == 64 and abs(s.agg(F.sum(F.col("dx") * F.col("dy") * F.col("dz"))).first()[0] - 1) < 1e-12


def test_log_and_series_text(spark):
    lines = ["X log file: a", " [ 05-09-2025  11:05:17.988 ] step: n=1 t=0.0E+00 dt=1.0E+08", "noise", " [ 05-09-2025  11:05:19.988 ] step: n=2 t=1.0E+08 dt=1.0E+08", "X log file: b", " [ 05-09-2025  12:00:00.000 ] step: n=1 t=0.0E+00 dt=2.0E+08"]
    log = text.parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    assert [(r["run"], r["n"], r["min_leaf"], r["n_procs"]) for r in log.orderBy("run", "n").collect()] == [(1, 1, 1, None), (1, 2, 1, None), (2, 1, 1, None)]
    assert [r["seconds"] for r in series.step_durations(log, ["run"], "n", "ts").orderBy("run", "n").collect()] == [2.0, None, None]
    rows = ["t x", " 0.0 1.0", " 1.0 2.0 7.0", "# simulation restarted", " 0.0 9.0", " 0.5 3.0", "bad"]
    got = text.parse_series(spark.createDataFrame(list(enumerate(rows)), "line_no long, value string"), ["t", "x"]).orderBy("line_no").collect()
    assert [(r["t"], r["x"]) for r in got] == [(0.0, 1.0), (1.0, 2.0), (0.5, 3.0)]
    clean = series.cleaned(spark.createDataFrame([(k, r["t"]) for k, r in enumerate(got)], "n long, t double"), "n", "t").orderBy("n").collect()
    assert [r["t"] for r in clean] == [0.0, 0.5]


def test_interpolation_merge_and_small_helpers(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0)], "k string, t double, x double")
    assert {(r["t"], r["x"]) for r in series.interpolate(s, ["k"], "t", "x", 0.5).collect()} == {(0.0, 0.0), (0.5, 1.0), (1.0, 2.0), (1.5, 3.0)}
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert text.same_rows(a, a) and not text.same_rows(a, a.distinct())
    assert models.factors(360) == [2, 2, 2, 3, 3, 5]
    for pdf, want in ((models.hopkins_pdf(1.0, 0.1), 1.0), (models.hopkins_pdf(1.0, 0.3), 1.0), (models.squire_pdf(0.1, 1.5, 2.0), 1.5 * 11 * math.log(2.0) * 2 * 0.01)):
        p = spark.range(-1600, 600).select((F.col("id") / 100.0).alias("s")).withColumn("p", pdf("s") / 100)
        area, mean, square, mass = p.agg(F.sum("p"), F.sum(F.col("p") * F.col("s")), F.sum(F.col("p") * F.col("s") * F.col("s")), F.sum(F.col("p") * F.exp("s"))).first()
        assert abs(area - 1) < 0.02 and abs(mass - 1) < 0.02 and abs(square - mean * mean - want) < 0.03 * want  # area, mean density, variance
    c = spark.range(-4000, 4000).select((F.col("id") / 100.0).alias("s")).agg(F.sum(models.cauchy_pdf(F.col("s"), 0.3, 1.2, 0.7)) / 100).first()[0]
    assert abs(c - 1) < 1e-6
    kinds = spark.createDataFrame([("a_hdf5_plt_cnt_0001",), ("a_hdf5_chk_0001",), ("x_dens_proj_z.h5",)], "p string").select(text.file_kind(F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["plt", "chk", "map"]


def test_stream_of_events(spark, tmp_path):
    from meshquill.streaming.events import windowed

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == src.count()


def test_vector_potential_and_filters(spark):
    n = 8
    modes = [spectral.transform(mesh.dense(spark, n), v, n) for v in ("velx", "vely", "velz")]
    a, h = spectral.vector_potential(modes, n), spectral.helmholtz(modes, n)
    size = sum((F.col(f"{p}_{c}") ** 2 for p in ("re", "im") for c in "xyz"), F.lit(0.0)) * spectral.wave_squared(n) * (2 * math.pi) ** 2
    worst = a.select("kx", "ky", "kz", size.alias("curl")).join(h, ["kx", "ky", "kz"]).where("kx + ky + kz > 0").agg(F.max(F.abs(F.col("curl") - F.col("trans")))).first()[0]
    assert worst < 1e-12
    g = spark.range(1).select(F.lit(2).alias("kx"), F.lit(0).alias("ky"), F.lit(0).alias("kz"))
    assert abs(g.select(spectral.log_gaussian(n, 2.0, 0.5)).first()[0] - 1) < 1e-12 and g.select(spectral.top_hat(n, 2.0, 3.0)).first()[0] == 0.0
    assert abs(spark.range(1).select(spectral.hann(F.lit(0.5), 1.0)).first()[0] - 0.5) < 1e-12


def test_spline_is_exact_for_cubics(spark):
    rows = [(k, float(t), float(t**3 - 2 * t) if k == "c" else float(t)) for k, ts in (("c", (0, 1, 3, 4, 7)), ("line", (0, 2)), ("one", (5,)), ("three", (0, 1, 2))) for t in ts]
    got = series.spline(spark.createDataFrame(rows, "k string, t double, x double"), ["k"], "t", "x", 5).collect()
    assert len(got) == 20
    assert all(abs(r["x"] - (r["t"] ** 3 - 2 * r["t"] if r["k"] == "c" else r["t"])) < 1e-9 for r in got)
    assert len(series.curvatures(np.arange(4.0), np.arange(4.0) ** 3)) == 4


def test_halo_across_levels(spark):
    def cube(block, lo, n, size):
        return [(block, lo[0] + (i + 0.5) * size, lo[1] + (j + 0.5) * size, lo[2] + (k + 0.5) * size, size) for i in range(n) for j in range(n) for k in range(n)]

    # a periodic box of 4 x 2 x 2 with a coarse block and eight fine ones
    boxes = [(0, (0.0, 0.0, 0.0), 1.0)] + [(1 + n, (2.0 + (n & 1), float(n >> 1 & 1), float(n >> 2)), 0.5) for n in range(8)]
    cells = spark.createDataFrame([c for b, lo, s in boxes for c in cube(b, lo, 2, s)], "block int, x double, y double, z double, dx double").withColumn("v", F.col("x"))
    blocks = spark.createDataFrame([(b, *lo, *(x + 2 * s for x in lo)) for b, lo, s in boxes], "block int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    got = geometry.halo(cells, blocks, ["v"], 2, 1, (0.0, 0.0, 0.0), (4.0, 2.0, 2.0), 1.0)
    assert got.groupBy("block").count().where("count <> 56").count() == 0 and got.count() == 9 * 56
    at = {(r["i"], r["j"], r["k"]): r["v"] for r in got.where("block = 0").collect()}
    assert at[2, 0, 0] == 2.5 and at[-1, 0, 1] == 3.5  # the mean of eight fine cells; across the boundary
    assert {(r["i"], r["v"]) for r in got.where("block = 1 and j = 0 and k = 0").collect()} >= {(-1, 1.5), (2, 3.25)}


def test_creation_accretion_and_steps(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0, -2.0, -1.0), (2, 0.5, 0.0, 0.0, 9.0, -3.0, -1.0), (3, 9.0, 0.0, 0.0, 9.0, -1.0, 1.0), (4, 5.0, 0.0, 0.0, 9.0, -9.0, -1.0), (5, 20.0, 0.0, 0.0, 1.0, -9.0, -1.0)],
                                  "tag long, x double, y double, z double, dens double, gpot double, div double")
    held = spark.createDataFrame([(7, 2.0, 5.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (8, 1.0, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "tag long, mass double, x double, y double, z double, vx double, vy double, vz double, lx double, ly double, lz double")
    assert [r["tag"] for r in sinks.creation_candidates(cells, held, 5.0, 1.0).collect()] == [2]
    gas = spark.createDataFrame([(7, 1.0, 7.0, 0.0, 0.0, 0.0, -3.0, 0.0)], "sink long, mass double, x double, y double, z double, vx double, vy double, vz double")
    a, b = sinks.accreted(gas, held).orderBy("tag").collect()
    assert (a["mass"], a["x"], a["taken"]) == (3.0, 6.0, 1.0) and abs(a["vy"] + 1 / 3) < 1e-12 and b["mass"] == 1.0 and b["taken"] == 0.0
    assert abs(a["lz"] + 3.0 * (6.0 * a["vy"]) - (2.0 * 5.5 * 1.0 - 7.0 * 3.0)) < 1e-9  # total angular momentum stays
    assert sinks.time_step(held, 1.0).first()["dt"] == 0.5 and sinks.time_step(held.where("tag = 8"), 1.0).first()["dt"] is None
    blocks = spark.createDataFrame([(n, float(n), n + 1.0, 0.0, 1.0, 0.0, 1.0) for n in range(10)], "block int, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    assert {(r["block"], r["sinks"]) for r in sinks.refine_marks(blocks, held, 1.0).collect()} == {(4, 1), (5, 1), (6, 1)}


def test_gravity_of_many_packs_is_that_of_one(spark, monkeypatch):
    p = mesh.phase(spark, SF)
    points, held = p.where("type = 1").select("tag", "x", "y", "z"), p.where("type = 2")
    one = {r["tag"]: r["phi"] for r in sinks.gravity(points, held, 0.05).collect()}
    monkeypatch.setattr(sinks, "PACK", 20)
    twice = points.unionAll(points.limit(1))
    rows = sinks.gravity(twice, held, 0.05).collect()
    many = {r["tag"]: r["phi"] for r in rows}
    assert len(rows) == len(one) + 1 and set(one) == set(many) and all(abs(one[t] - many[t]) < 1e-6 for t in one)  # repeated points stay


def test_text_files_of_many_pieces(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.dat").write_text("time mass\n" + "".join(f" {n}.0 {k}.5\n" + ("# simulation restarted\n 0.0 9.9\n" if n == 500 else "") for n in range(1, 1000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_series(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3 * 999 and not any(r["mass"] == 9.9 for r in got)
    assert all(r["line_no"] == r["time"] + (2 if r["time"] > 500 else 0) for r in got)
    assert text.column_of(["time", "mass", "mdot"], "mas") == 1 and text.column_of(["a"], "0") == 0 and text.column_of(["a"], 3) == 3
    with pytest.raises(ValueError):
        text.column_of(["mass", "mdot"], "m")


@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_percentiles(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(2)
    got = stats.percentiles(spark.createDataFrame([(float(v), "a") for v in values], "v double, k string"), ["k"], "v", {"p0": 0.0, "p16": 0.16, "p50": 0.5, "p100": 1.0}).first()
    assert all(abs(got[name] - np.percentile(values, q)) < 1e-12 for name, q in (("p0", 0), ("p16", 16), ("p50", 50), ("p100", 100)))


def test_catalogues_and_parameters(spark):
    from meshquill.sources import tables

    assert tables.with_name(["dens"], "pres") == ["dens", "pres"] == tables.with_name(["dens", "pres"], "pres")
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.0)], "block int, i int, j int, k int, dens double")
    assert tables.variables(tables.renamed(cells, {"dens": "rho"})) == ["rho"]
    with pytest.raises(ValueError):
        tables.overwritten(tables.parameters(spark, {"gamma": 1.4}), {"gamma": 2})
    lines = spark.createDataFrame([("f", "mean = 1.5"), ("f", "nothing")], "file string, value string")
    assert [(r["name"], r["value"]) for r in tables.header_values(lines).collect()] == [("mean", 1.5)]
    assert len(stats.edges_of("log", 1.0, 100.0, 3)) == 3 and abs(stats.edges_of("log", 1.0, 100.0, 3)[1] - 10) < 1e-9
    assert geometry.view_range([(0.0, 4.0)] * 3, 0.5, slice_=True, zoom=2.0)[2] == (1.875, 2.125)


def test_command_line(spark, tmp_path, capsys):
    from meshquill import cli

    (tmp_path / "a.dat").write_text("time mass\n 0.0 1.0\n 1.0 3.0\n 2.0 5.0\n")
    cli.main(["series", str(tmp_path / "a.dat"), "--moments", "mass"], spark)
    assert "mean=3.0" in capsys.readouterr().out
    cli.main(["cloud", "--dens", "1e-20", "--size", "1e18", "--sigma", "2e4"], spark)
    assert "mach=1.0" in capsys.readouterr().out


def test_starfield_keeps_light_and_small_maps(spark):
    stars = spark.createDataFrame([(1, 5.0, 5.0, 3.0), (2, 2.3, 7.1, 1.0)], "tag long, x double, y double, light double")
    assert abs(geometry.starfield(stars, 1.5, (0.0, 0.0), 0.25, (40, 40)).agg(F.sum("value")).first()[0] - 4.0) < 1e-9
    turned = geometry.rotation_sequence(spark.createDataFrame([(1.0, 0.0, 0.0)], "x double, y double, z double"), 4).orderBy("image").collect()
    assert [(round(r["x"]), round(r["y"])) for r in turned] == [(1, 0), (0, 1), (-1, 0), (0, -1)]
    seen = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "run int, n int, leaf int")
    assert [r["leaf"] for r in series.carried(seen, ["run"], "n", ["leaf"]).orderBy("n").collect()] == [1, 5, 5]
    scales = spark.range(1).select(*(c.alias(n) for n, c in models.sink_scales(F.lit(1.0), F.lit(3.0), F.lit(8.0), F.lit(1.0)).items())).first()
    assert scales["n_eff"] == 32.0 and scales["r_sink"] == 2.5 / 32


@pytest.mark.parametrize(("kernel", "lengths"), [("linear", None), ("spline", (1.0, 1.0, 1.0))])
def test_gravity_sums_tiles_of_pairs_without_a_row_of_all_sinks(spark, monkeypatch, kernel, lengths):
    monkeypatch.setattr(sinks, "PACK", 40)
    rng = np.random.default_rng(2)
    m, w = np.concatenate([rng.uniform(0, 1, (150, 3)), np.full((60, 3), 0.5)]), rng.uniform(1, 2, 210)  # many at one place
    held = spark.createDataFrame([(k, float(a), *map(float, x)) for k, (a, x) in enumerate(zip(w, m))] + [(999, None, 0.1, 0.1, 0.1)], "tag int, mass double, x double, y double, z double")
    at = [*m[:90], *m[:3], m[-1], m[-1]]
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(at)] + [(500, None, 0.0, 0.0)], "tag int, x double, y double, z double")
    out = sinks.gravity(points, held, 0.3, kernel=kernel, lengths=lengths)
    plan = out._jdf.queryExecution().toString()
    assert "lambda" not in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {r["tag"]: list(r)[-4:] for r in out.collect()}
    assert len(got) == len(at) + 1 and got.pop(500) == [None] * 4
    d = m[None] - np.array(at)[:, None]
    if lengths:
        d -= np.round(d)
    r = np.sqrt((d * d).sum(-1))
    q, h = np.where(r > 0, r, 1) * 2 / 0.3, 2 / 0.3
    f = np.where(r < 0.3, 1 / 0.3**3, 1 / np.where(r > 0, r, 1) ** 3)
    if kernel == "spline":
        inner, outer = 4 / 3 * q - 1.2 * q**3 + 0.5 * q**4, 8 / 3 * q - 3 * q**2 + 1.2 * q**3 - q**4 / 6 - 1 / (15 * q**2)
        f = np.where(r >= 0.3, f, h * h * np.where(q >= 1, outer, inner) / np.where(r > 0, r, 1))
    phi = np.where(r < 0.3, r * r / (2 * 0.3**3) - 3 / (2 * 0.3), -1 / np.where(r > 0, r, 1))
    want = np.concatenate([(w[None, :, None] * f[..., None] * d).sum(1), (phi * w).sum(1)[:, None]], axis=1)
    assert np.abs(np.array([got[k] for k in range(len(at))]) - want).max() < 1e-8 * np.abs(want).max()


@pytest.mark.parametrize(("kernel", "soft", "lengths"), [("spline", 0.3, (1.0, 1.0, 1.0)), ("spline", 0.02, None), ("spline", 0.9, (0.8, 1.0, 1.2)), ("linear", 0.1, (1.0, 1.0, 1.0)), ("plummer", 0.1, None), ("plummer", 0.0, None), ("linear", 0.0, (1.0, 1.0, 1.0))])
def test_gravity_takes_few_pairs_one_by_one(monkeypatch, kernel, soft, lengths):
    """Most masses lie in one part of the kernel for a whole tile of near places; what is left is what differences are for."""
    rng = np.random.default_rng(5)
    held = np.column_stack([rng.normal(0, 0.12, (3000, 3)), rng.uniform(1, 2, 3000)])
    at = np.concatenate([rng.normal(0, 0.06, (2000, 3)), held[:40, :3], held[:5, :3] + 1e-7, held[5:9, :3] + 1e-3])
    alone, count = sinks._direct, []
    monkeypatch.setattr(sinks, "_direct", lambda a, x, m, *more: count.append(len(a) * len(m)) or alone(a, x, m, *more))
    got = sinks.pulls(at, held, soft, 2.0, kernel, lengths)
    assert sum(count) < 0.25 * len(at) * len(held)
    want = np.zeros((len(at), 4))
    for k in range(0, len(at), 100):
        d = held[None, :, :3] - at[k : k + 100, None]
        d -= np.array(lengths) * np.round(d / np.array(lengths)) if lengths else 0
        r = np.sqrt((d * d).sum(-1))
        far = np.sqrt(r * r + soft * soft) if kernel == "plummer" else np.maximum(r, soft)
        one = np.where(far > 0, far, 1)
        w, phi = np.where(far > 0, 1 / one**3, 0), np.where(far > 0, -1 / one, 0)
        if soft and kernel != "plummer":
            phi = np.where(r < soft, r * r / (2 * soft**3) - 3 / (2 * soft), phi)
        if kernel == "spline":
            h, q = 2 / soft, np.maximum(r * 2 / soft, 1e-9)
            outer, inner = 8 / 3 * q - 3 * q**2 + 1.2 * q**3 - q**4 / 6 - 1 / (15 * q**2), 4 / 3 * q - 1.2 * q**3 + 0.5 * q**4
            w = np.where(r >= soft, w, np.where(q >= 1, outer, np.where(q > 1e-5, inner, 0)) * h**3 / q)
        want[k : k + 100] = np.concatenate([(2 * held[None, :, 3:] * w[..., None] * d).sum(1), (2 * held[None, :, 3] * phi).sum(1)[:, None]], axis=1)
    assert (np.abs(got - want) < 1e-11 * np.abs(want).max(axis=0)).all()
    flat = sinks.pulls(at, held, soft, 2.0, kernel, lengths, False)
    assert (np.abs(flat[:, :3] - want[:, :3]) < 1e-11 * np.abs(want[:, :3]).max(axis=0)).all()


def test_gravity_with_places_and_masses_that_are_not_finite():
    rng = np.random.default_rng(6)
    held = np.column_stack([rng.normal(0, 0.2, (300, 3)), rng.uniform(1, 2, 300)])
    at = rng.normal(0, 0.2, (200, 3))
    for kernel in ("linear", "spline", "plummer"):
        plain = sinks.pulls(at, held, 0.1, 1.0, kernel, None)
        lost = np.concatenate([at, [[np.nan, 0.0, 0.0], [np.inf, 0.0, 0.0]]])
        some = sinks.pulls(lost, held, 0.1, 1.0, kernel, None)
        assert np.allclose(some[:200], plain, rtol=1e-11, atol=1e-9) and np.isnan(some[200]).all() and np.isnan(some[201, 0]) and some[201, 1] == 0
        off = sinks.pulls(at, np.concatenate([held, [[np.inf, 0.0, 0.0, 1.0]]]), 0.1, 1.0, kernel, None)
        assert np.isnan(off[:, 0]).all() and np.allclose(off[:, 1:], plain[:, 1:], rtol=1e-11, atol=1e-9)


def test_gravity_packs_near_points_and_may_leave_the_potential_out(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PACK", 50)
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(rng.uniform(0, 1, (400, 3)))] + [(900, float("nan"), 0.0, 0.0)], "tag int, x double, y double, z double")
    held = spark.createDataFrame([(float(m), *map(float, x)) for m, x in zip(rng.uniform(1, 2, 120), rng.uniform(0, 1, (120, 3)))], "mass double, x double, y double, z double")
    whole = {r["tag"]: r for r in sinks.gravity(points, held, 0.2, kernel="spline", lengths=(1.0, 1.0, 1.0)).collect()}
    out = sinks.gravity(points, held, 0.2, kernel="spline", lengths=(1.0, 1.0, 1.0), potential=False)
    assert out.columns == ["tag", "x", "y", "z", "ax", "ay", "az"]
    rows = out.collect()
    assert len(rows) == 401 and all(abs(r[c] - whole[r["tag"]][c]) < 1e-9 for r in rows for c in ("ax", "ay", "az") if r["tag"] != 900)
    packed = sinks.packs_of_near(points.where("tag < 900").select("x", "y", "z"), 8).collect()
    assert sum(len(r["mq_p_rows"]) for r in packed) == 400 and len(packed) > 4
    spread = [np.prod(np.ptp(np.array([list(x) for x in r["mq_p_rows"]]), axis=0)) for r in packed]
    assert np.mean(spread) < 0.5  # a hash spreads each over the whole box
