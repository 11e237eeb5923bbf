"""Meshes laid out by block, refined pairs, ordered scans and the data source, on small tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquill import cli
from meshquill.operators import ewald, geometry, refined_pairs, scans, series, sinks, tree
from meshquill.plans import meshes
from meshquill.sources import datasource, mesh, tables, text

SF = "/root/testdata/sf0.001"


# ---- mesh
def scans_of(df):
    """Files read by the scans of partitioned folders, once df has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec":
            found.append((node.toString(), node.metrics().apply("numFiles").value()))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_folders_without_chosen_blocks_are_not_read(spark):
    m = meshes.stored(spark, SF)
    every = sum(len(f) for _, _, f in os.walk(m.path.removeprefix("file:") + "/cells") if f) // 2  # each has a checksum file
    assert every > 10
    box = m.in_box([2.25, 0.5, 0.2], [6.75, 4.1, 0.9], ["dens"])
    read = [n for plan, n in scans_of(box) if "/cells" in plan or "dens" in plan]
    plan = box._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "pres:double" not in plan.split("== Physical Plan ==")[1] and read and 0 < max(read) < every
    one = m.block(7, ["dens"])
    assert "PartitionFilters: [isnotnull(level" in one._jdf.queryExecution().toString() and max(n for _, n in scans_of(one)) == 1
    assert m.variables() == ["dens", "pres", "velx"] and m.per_block == 4 and m.kind.first()["grid_type"] == "A"
    with pytest.raises(ValueError):
        m.block(99, ["dens"])


def test_regions_interleave_bits(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 3.0, 3.0, 3.0), (4, 2.0, 1.0, 0.0)], "block int, lo_x double, lo_y double, lo_z double")
    b = b.withColumns({f"hi_{a}": F.col(f"lo_{a}") + 1 for a in "xyz"})
    got = {r["block"]: r["region"] for r in mesh.with_region(b, [0.0] * 3, [4.0] * 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 63, 4: 10}


# ---- pairs on a refined mesh
def test_sampled_pairs_are_near_all_pairs(spark):
    rng = random.Random(2)
    rows, leaves = [], []
    for b in range(27):  # 27 blocks of 4**3 cells on a periodic cube of side 12
        lo = [4.0 * (b // 3**k % 3) for k in range(3)]
        leaves.append((b, *lo, *(x + 4 for x in lo)))
        for n in range(64):
            x = [lo[k] + 0.5 + n // 4**k % 4 for k in range(3)]
            rows.append((b, n, *x, 1.0, math.sin(x[0] * math.pi / 6) * 2 + 0.05 * rng.random(), math.cos(x[1] * math.pi / 6), 0.0))
    c = spark.createDataFrame(rows, "block int, number int, x double, y double, z double, vol double, velx double, vely double, velz double").cache()
    b = spark.createDataFrame(leaves, "block int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double").cache()
    fields = {"vels": (F.col("velx"), F.col("vely"), F.col("velz"))}
    get = lambda **o: {r["bin"]: r for r in refined_pairs.pair_statistics(c, b, fields, 5.0, 1.0, (0.0,) * 3, (12.0,) * 3, orders=2, **o).collect()}
    every, some = get(), get(samples=24, cells_per_block=64)
    again = get(samples=24, cells_per_block=64)
    lag = lambda p, q: math.sqrt(sum(min(abs(s - t), 12 - abs(s - t)) ** 2 for s, t in zip(p, q)))
    counts = {}
    for p in rows[:64]:  # by symmetry all blocks count alike
        for q in rows:
            if 0 < (r := lag(p[2:5], q[2:5])) <= 5:
                counts[int(r + 1e-9)] = counts.get(int(r + 1e-9), 0) + 27
    assert {k: r["n"] for k, r in every.items()} == counts and all(r["weight"] == 2 * r["n"] for r in every.values())
    assert {k: r["n"] for k, r in some.items()} == {k: r["n"] for k, r in again.items()}
    for k in every:
        if k:
            assert 0 < some[k]["n"] < every[k]["n"] / 2 and abs(some[k]["sf2_long"] - every[k]["sf2_long"]) < 0.2 * every[k]["sf2_long"] + 0.02
    far = refined_pairs.block_pairs(b, 0.5, (0.0,) * 3, (12.0,) * 3)
    assert far.where("distance > 0.5 + 4 * sqrt(3)").count() == 0 and far.where("a = b").count() == 27


# ---- ordered scans
@pytest.mark.parametrize("ranges", [1, 7])
def test_scans_by_ranges(spark, ranges):
    rng = random.Random(4)
    rows = [(k, n, rng.random(), rng.choice([None, None, n]), rng.random() < 0.2) for k, size in ((1, 400), (2, 3), (None, 40)) for n in range(size)]
    df = spark.createDataFrame(rows, "key int, n int, t double, seen int, head boolean").repartition(5)
    least, kept, count, last, told = {}, set(), {}, {}, {}
    for k, n, t, _, _ in reversed(rows):
        if k not in least or t < least[k]:
            kept.add((k, n))
        least[k] = min(t, least.get(k, 9))
    for k, n, _, s, h in rows:
        count[k] = count.get(k, 0) + h
        last[k] = s if s is not None else last.get(k)
        told[k, n] = (count[k], last[k] if last[k] is not None else -1)
    assert {(r["key"], r["n"]) for r in scans.before_later(df, ["key"], "n", "t", ranges).collect()} == kept
    assert {(r["key"], r["n"]): r["c"] for r in scans.running_count(df, ["key"], "n", {"c": F.col("head")}, ranges).collect()} == {k: v[0] for k, v in told.items()}
    assert {(r["key"], r["n"]): r["seen"] for r in scans.last_seen(df, ["key"], "n", ["seen"], -1, ranges).collect()} == {k: v[1] for k, v in told.items()}
    assert scans.last_seen(df.where("false"), ["key"], "n", ["seen"], -1).count() == 0


def test_one_long_key_is_shared(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), "id", (F.col("id") % 97).cast("double").alias("t"))
    sizes = [r["count"] for r in scans.ranged(df, ["key"], "id", 10).groupBy("mq_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 4_000
    assert series.cleaned(df, "id", "t", ["key"]).count() == 20_000 % 97 or series.cleaned(df, "id", "t", ["key"]).count() > 0


# ---- data source
@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def write(folder, name, *lines, end="\n"):
    (folder / name).write_text("\n".join(lines) + end)
    return str(folder / name)


PDF = ["mean +/- sigma", "1.5 0.25", "rms +/- sigma", "2.0 0.0", "skew +/- sigma", "0.1", "kurt +/- sigma", "3 0", "sigma +/- sigma", "0.5 0.0", " x pdf cdf", " 0.5 1.0 0.25", " 1.5 3.0 1.0"]
SPECTRUM = ["E_tot = total", "4.0 0.5", "E_lgt", "1.0", "", "#00_BinIndex #01_KStag #15_SpectFunctTot", "1 1.0 2.5", "2 2.0 1.5", "3 3.0 0.5"]
PLAIN = ["#00_BinIndex #01_KStag", "1 1.0", "2 2.0"]
STRUFU = ["r n sf1", "0.5 10 1e-1", "1.5 20 2e-1"]


def test_layouts_are_told_apart(source, tmp_path):
    for name, lines in {"a.pdf": PDF, "b.spect": SPECTRUM, "c.spect": PLAIN, "d.sf": STRUFU, "e.empty": [], "f.names": ["only names here"], "_hidden": STRUFU}.items():
        write(tmp_path, name, *lines)
    head = source.read.format("meshquill_header").option("path", str(tmp_path)).load()
    got = {}
    for r in head.collect():
        got.setdefault((os.path.basename(r["file"]), r["layout"]), []).append((r["name"], r["value"], r["sigma"]))
    assert got[("a.pdf", "pdf")] == [("mean +/- sigma", 1.5, 0.25), ("rms +/- sigma", 2.0, 0.0), ("skew +/- sigma", 0.1, None), ("kurt +/- sigma", 3.0, 0.0), ("sigma +/- sigma", 0.5, 0.0)]
    assert got[("b.spect", "decomposed_spectrum")] == [("E_tot = total", 4.0, 0.5), ("E_lgt", 1.0, None)]
    assert got[("c.spect", "spectrum")] == got[("d.sf", "table")] == got[("f.names", "table")] == [(None, None, None)] and ("_hidden", "table") not in got
    rows = source.read.format("meshquill_table").option("path", str(tmp_path)).load()
    assert rows.columns == ["file", "offset", "x", "pdf", "cdf", "#00_BinIndex", "#01_KStag", "#15_SpectFunctTot", "r", "n", "sf1", "only", "names", "here"]
    by = {}
    for r in rows.orderBy("file", "offset").collect():
        by.setdefault(os.path.basename(r["file"]), []).append(tuple(v for v in tuple(r)[2:] if v is not None))
    assert by == {"a.pdf": [(0.5, 1.0, 0.25), (1.5, 3.0, 1.0)], "b.spect": [(1, 1, 2.5), (2, 2, 1.5), (3, 3, 0.5)], "c.spect": [(1, 1), (2, 2)], "d.sf": [(0.5, 10, 0.1), (1.5, 20, 0.2)]}


@pytest.mark.parametrize("split", [7, 40, 1 << 20])
def test_series_in_pieces(source, tmp_path, split):
    lines = ["#01_time #02_mass", "0.0 1.0", "1.0 2.0", text.MARKER, "0.0 9.0", "2.0 3.0", "bad line", "3.0 4.0 extra"[:7], text.MARKER, "2.5 7.0"]
    write(tmp_path, "a.dat", *lines)
    write(tmp_path, "b.dat", "#01_time #02_mass #03_late", *(f"{k} {2 * k} {3 * k}" for k in range(50)), end="")
    got = source.read.format("meshquill_table").option("path", f"{tmp_path}/*.dat").option("split", split).load().collect()
    a = sorted((r["offset"], r["#01_time"], r["#02_mass"], r["#03_late"]) for r in got if r["file"].endswith("a.dat"))
    assert [r[1:] for r in a] == [(0.0, 1.0, None), (1.0, 2.0, None), (2.0, 3.0, None), (3.0, 4.0, None), (2.5, 7.0, None)]
    b = sorted((r["#01_time"], r["#02_mass"], r["#03_late"]) for r in got if r["file"].endswith("b.dat"))
    assert b == [(k, 2 * k, 3 * k) for k in range(50)]


def test_table_source_without_files(source, tmp_path):
    assert source.read.format("meshquill_table").option("path", f"{tmp_path}/*.none").load().count() == 0
    with pytest.raises(Exception, match="path"):
        source.read.format("meshquill_table").load()


def test_growing_files_as_a_stream(source, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.dat", "t x", "0 1", "1 2", "2 ", end="")  # the last line is not whole yet
    stream = source.readStream.format("meshquill_table").option("path", f"{tmp_path}/in").load()

    def run():
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((os.path.basename(r["file"]), r["t"], r["x"]) for r in source.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("a.dat", 0, 1), ("a.dat", 1, 2)]
    with open(tmp_path / "in" / "a.dat", "a") as f:
        f.write("3\n3 4\n")
    write(tmp_path / "in", "b.dat", "t x", "7 8")
    assert run() == [("a.dat", 0, 1), ("a.dat", 1, 2), ("a.dat", 2, 3), ("a.dat", 3, 4), ("b.dat", 7, 8)]


def test_parameter_lines(spark):
    lines = ["a = 1", "A = 2 # later", "b=-1.5D3", 'c = "x # y"  # z', "d = .False.", "# e = 1", "f = plain text # c", "g = '.true.'", "h =", "i = 1e", " j_1 = 99999999999999999999"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = {r["name"]: (r["kind"], r["i"], r["d"], r["b"], r["s"]) for r in tables.parse_parameters(df).collect()}
    assert got == {"a": ("int", 2, None, None, None), "b": ("real", None, -1500.0, None, None), "c": ("str", None, None, None, "x # y"), "d": ("bool", None, None, False, None),
                   "f": ("str", None, None, None, "plain text"), "g": ("str", None, None, None, ".true."), "i": ("str", None, None, None, "1e"), "j_1": ("real", None, 1e20, None, None)}


# ---- gravity
def test_ewald_does_not_depend_on_the_split():
    d = np.random.default_rng(0).uniform(-0.5, 0.5, (100, 3))
    for lengths in ((1.0, 1.0, 1.0), (2.0, 1.0, 4.0)):
        x = d * np.array(lengths)
        assert np.abs(ewald.correction(x, lengths, 8, 2.0) - ewald.correction(x, lengths, 9, 2.4)).max() < 1e-9
    d = np.array([[0.2, 0.1, -0.3], [0.5, 0.0, 0.0], [0.0, 0.0, 0.0]])
    n = np.stack(np.meshgrid(*[np.arange(-30, 31)] * 3, indexing="ij"), -1).reshape(-1, 3)
    n = n[(n != 0).any(axis=1)]
    images = np.array([-((p + n) / (((p + n) ** 2).sum(axis=1) ** 1.5)[:, None]).sum(axis=0) for p in d]) + 4 * math.pi / 3 * d  # of a cube, with its background
    assert np.abs(ewald.correction(d, (1.0,) * 3) - images).max() < 2e-3


def test_ewald_table_is_read_with_signs(spark):
    lengths, cells = (1.0, 1.0, 2.0), (17, 17, 33)
    grid = ewald.table(spark, cells, lengths).cache()
    assert grid.count() == 17 * 17 * 33
    rng = random.Random(1)
    points = spark.createDataFrame([(k, *(rng.uniform(-2, 2) for _ in range(3))) for k in range(60)], "tag int, x double, y double, z double")
    read = {r["tag"]: r for r in ewald.from_table(points, grid, cells, lengths).collect()}
    for r in ewald.at_points(points, lengths).collect():
        assert all(abs(r[f] - read[r["tag"]][f]) < 0.02 for f in ewald.FIELD)


@pytest.mark.parametrize("lengths", [None, (8.0, 8.0, 8.0)])
def test_tree_gravity_is_near_all_pairs(spark, lengths):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.uniform(0, 8, (300, 3)), 2 + 0.1 * rng.standard_normal((300, 3)), np.full((40, 3), 5.0)])  # a clump, and many at one place
    w = rng.uniform(0.5, 2, len(m))
    p = np.concatenate([rng.uniform(0, 8, (40, 3)), m[:5]])
    d = m[None] - p[:, None]
    if lengths:
        d -= 8 * np.round(d / 8)
    r2 = (d * d).sum(-1) + 0.05**2
    want = np.concatenate([(w[None, :, None] * d / r2[..., None] ** 1.5).sum(1), -(w / np.sqrt(r2)).sum(1)[:, None]], axis=1)
    masses = spark.createDataFrame([(float(a), *map(float, x)) for a, x in zip(w, m)], "mass double, x double, y double, z double")
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "tag int, x double, y double, z double")
    for angle, error in ((0.5, 0.02), (0.0, 1e-9)):
        out = tree.tree_gravity(points, masses, (0.0, 0.0, 0.0), 8.0, 0.05, angle=angle, lengths=lengths, depth=6, leaf=8)
        assert "CartesianProduct" not in out._jdf.queryExecution().toString()
        got = np.array([list(r)[-4:] for r in sorted(out.collect(), key=lambda r: r["tag"])])
        size = np.abs(want[:, :3]).max()
        assert np.abs(got[:, :3] - want[:, :3]).max() < error * size and np.abs(got[:, 3] / want[:, 3] - 1).max() < max(error, 1e-9)
    assert [list(r)[-4:] for r in tree.tree_gravity(points.limit(1), masses.where("false"), (0.0,) * 3, 8.0).collect()] == [[0.0] * 4]


def test_shared_spline_is_the_direct_one(spark):
    rng = np.random.default_rng(0)
    data = {k: (np.sort(rng.uniform(0, 10, n)), rng.normal(size=n)) for k, n in ((1, 300), (2, 1), (3, 2), (4, 3), (5, 4), (None, 5), (7, 17))}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (t, x) in data.items() for a, b in zip(t, x)], "k int, t double, x double")
    for ranges, points in ((1, None), (6, 50)):
        got = {}
        for r in series.spline(df, ["k"], "t", "x", points, ranges).collect():
            got.setdefault(r["k"], []).append((r["t"], r["x"]))
        for k, (t, x) in data.items():
            m, at = series.curvatures(t, x), np.linspace(t[0], t[-1], points or len(t))
            want = np.full(len(at), x[0])
            if len(t) > 1:
                i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
                h, u, v = t[i + 1] - t[i], t[i + 1] - at, at - t[i]
                want = (m[i] * u**3 + m[i + 1] * v**3) / (6 * h) + (x[i] / h - m[i] * h / 6) * u + (x[i + 1] / h - m[i + 1] * h / 6) * v
            assert np.abs(np.array([x for _, x in sorted(got[k])]) - want).max() < 1e-9


def test_dump_search_reads_few_folders(spark, tmp_path):
    path = f"{tmp_path}/dumps"
    spark.range(200).select((F.col("id") % 40).alias("n"), ((F.col("id") % 40) * 2.0).alias("t")).repartition("n").write.partitionBy("n").parquet(path)
    numbers = series.folders(spark, path, "n")
    asked = []

    class Counting:
        def where(self, condition):
            asked.append(1)
            return spark.read.parquet(path).where(condition)

    assert numbers == list(range(40)) and series.find_dump(Counting(), "n", numbers, F.max("t"), 31.1) == (16, 32.0) and len(asked) <= 9
    df = spark.read.parquet(path)
    assert series.find_dump(df, "n", numbers, F.max("t"), 31.0) == (16, 32.0)  # as near: the later one
    assert series.find_dump(df, "n", numbers, F.max("t"), -5.0) == (0, 0.0) and series.find_dump(df, "n", numbers, F.max("t"), 1e9) == (39, 78.0)
    assert series.find_dump(df, "n", [3], F.max("t"), 0.0) == (3, 6.0)
    with pytest.raises(ValueError):
        series.find_dump(df, "n", [], F.max("t"), 0.0)


# ---- sinks
def test_merging_goes_on_to_the_end(spark):
    rows = [(k, 1.0 + 0.1 * k, 0.5 * k, 0.0, 0.0, -0.01 * k, 0.0, 0.0) for k in range(8)] + [(20, 1.0, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "tag int, mass double, x double, y double, z double, vx double, vy double, vz double")
    out = {r["tag"]: r for r in sinks.merged_all(df, 0.9).collect()}
    assert sinks.bound_pairs(spark.createDataFrame(list(out.values())), 0.9).count() == 0
    assert sum(r["parts"] for r in out.values()) == 9 and 20 in out and len(out) < 9 and max(r["parts"] for r in out.values()) > 2
    assert abs(sum(r["mass"] for r in out.values()) - sum(r[1] for r in rows)) < 1e-9
    assert abs(sum(r["mass"] * r["vx"] for r in out.values()) - sum(r[1] * r[5] for r in rows)) < 1e-9
    assert sinks.merged_all(df.where("false"), 0.9).count() == 0


# ---- command lines of the mesh tools
@pytest.fixture(scope="module")
def uniform(spark, tmp_path_factory):
    """Eight blocks of 4**3 cells on a cube of side 8."""
    path = str(tmp_path_factory.mktemp("mesh") / "m")
    b = spark.createDataFrame([(n, 1, 1, *(4.0 * (n // 2**k % 2) for k in range(3)), *(4.0 * (n // 2**k % 2) + 4 for k in range(3))) for n in range(8)], "block int, level int, node_type int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    c = b.select("block", "lo_x", "lo_y", "lo_z", *(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"),)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x, y = F.col("lo_x") + F.col("i") + 0.5, F.col("lo_y") + F.col("j") + 0.5
    c = c.select("block", "i", "j", "k", (2 + F.sin(x * math.pi / 4)).alias("dens"), F.sin(x * math.pi / 4).alias("velx"), F.cos(x * math.pi / 2).alias("vely"), y.alias("velz"))
    mesh.write_mesh(path, c, b, {"nxb": 4, "dimensionality": 3})
    return path


def told(spark, capsys, *argv):
    cli.main(list(argv), spark)
    return [dict(part.split("=") for part in line.split(" ")) for line in capsys.readouterr().out.splitlines() if "=" in line]


def test_command_lines_on_a_mesh(spark, uniform, capsys, tmp_path):
    rows = told(spark, capsys, "pdfs", uniform, "--bw", "0.25", "--vmin", "0", "--vmax", "4")
    assert sum(int(r["n"]) for r in rows) == 512 and float(rows[-1]["cdf"]) == 1.0
    m = told(spark, capsys, "pdfs", uniform, "--bw", "0.01", "--vmin", "0", "--vmax", "4", "--moments")[0]
    assert abs(float(m["mean"]) - 2) < 0.01 and abs(float(m["sigma"]) - math.sqrt(0.5)) < 0.01
    s = told(spark, capsys, "spectra", uniform, "--vector", "velx", "vely", "velz")
    assert abs(float(s[0]["func_long"]) - 4 * math.pi * 0.25 * 2 / int(s[0]["n_cells"])) < 1e-9
    f = told(spark, capsys, "sf_cf", uniform, "--dset", "velz", "--most", "2.5", "--width", "1", "--orders", "2")
    assert [int(r["bin"]) for r in f] == [1, 2] and all(float(r["sf2_long"]) > 0 for r in f)
    p = told(spark, capsys, "projection", uniform, "--dset", "dens", "--pixels", "8", "8")
    assert len(p) == 64 and all(abs(float(r["value"]) - 2 - math.sin((int(r["ix"]) + 0.5) * math.pi / 4)) < 1e-9 for r in p)
    wide = told(spark, capsys, "projection", uniform, "--dset", "velz", "--pixels", "8", "8", "--fwhm", "5")
    assert len(wide) == 64 and abs(sum(float(r["value"]) for r in wide) / 64 - 4) < 1e-6
    cli.main(["extractor", uniform, "--cells", "4", "4", "4", "--low", "-2", "0", "0", "--size", "2", "--periodic", "--output", f"{tmp_path}/cube"], spark)
    cube = spark.read.parquet(f"{tmp_path}/cube")
    assert cube.count() == 64 and abs(cube.agg(F.avg("value")).first()[0] - 2) < 1e-9


def test_box_blurs_are_near_a_gaussian(spark):
    for sigma in (1.8, 2.1, 3.3, 7.0, 20.0):
        widths = geometry.box_widths(sigma)
        assert len(widths) == 3 and all(w % 2 for w in widths) and abs(sum((w * w - 1) / 12 for w in widths) / sigma**2 - 1) < 0.12
    flat = spark.range(64 * 64).select((F.col("id") % 64).alias("ix"), F.floor(F.col("id") / 64).alias("iy"), F.when(F.col("id") == 32 * 64 + 32, 1.0).otherwise(0.0).alias("value"))
    got = {(r["ix"], r["iy"]): r["value"] for r in geometry.smooth(flat, 3 * 2.35482, (64, 64)).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got.values()) == got[32, 32]
    assert all(abs(got[32 + d, 32] - math.exp(-d * d / 18) / (18 * math.pi)) < 0.001 for d in range(9))


@pytest.mark.parametrize("kernel", ["linear", "spline"])
def test_tree_takes_the_kernels_of_sinks(spark, kernel):
    rng = random.Random(6)
    s = spark.createDataFrame([(k, rng.uniform(1, 2), *(rng.uniform(0, 4) for _ in range(3))) for k in range(60)], "tag int, mass double, x double, y double, z double")
    want = {r["tag"]: r for r in sinks.gravity(s.select("tag", "x", "y", "z"), s, 0.8, kernel=kernel).collect()}
    for r in tree.tree_gravity(s.select("tag", "x", "y", "z"), s, (0.0,) * 3, 4.0, 0.8, angle=0.0, depth=3, leaf=8, kernel=kernel).collect():
        assert all(abs(r[c] - want[r["tag"]][c]) < 1e-9 for c in ("ax", "ay", "az", "phi"))


def test_an_angle_of_zero_opens_no_tree(spark, monkeypatch):
    rng = random.Random(8)
    s = spark.createDataFrame([(k, rng.uniform(1, 2), *(rng.uniform(0, 4) for _ in range(3))) for k in range(50)], "tag int, mass double, x double, y double, z double")
    monkeypatch.setattr(tree, "tree", None)  # would be called before
    twice = s.unionAll(s.withColumn("tag", F.col("tag") + 100))  # points at one place are summed once, and all have rows
    got = {r["tag"]: r["phi"] for r in tree.tree_gravity(twice.select("tag", "x", "y", "z"), s, (0.0,) * 3, 4.0, 0.5, angle=0.0).collect()}
    rows = s.collect()
    want = {a["tag"]: -sum(b["mass"] / math.sqrt(sum((a[c] - b[c]) ** 2 for c in "xyz") + 0.25) for b in rows) for a in rows}
    assert len(got) == 100 and all(abs(got[k] - want[k % 100]) < 1e-9 for k in got)


def test_joints_of_many_ranges_need_no_square_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    v, w, y = rng.uniform(-0.3, 0.3, (50, 2)), rng.uniform(-0.3, 0.3, (50, 2)), rng.normal(size=(50, 2))
    a = np.eye(100)
    for p in range(50):
        for k in range(2):
            if p:
                a[2 * p + k, 2 * p - 1] = v[p, k]
            if p < 49:
                a[2 * p + k, 2 * p + 2] = w[p, k]
    assert np.abs(series.chained(v, w, y) - np.linalg.solve(a, y.ravel())).max() < 1e-12


def test_ranges_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST", 500)
    sizes = [r["count"] for r in scans.ranged(spark.range(20_000).withColumn("key", F.col("id") % 3), ["key"], "id").groupBy("mq_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 1500  # as many as shuffle partitions before
    sent, plain = [], series._piece
    monkeypatch.setattr(series, "_piece", lambda key, names: sent.append(1) or plain(key, names))
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t"), F.sin("id").alias("x"))
    frame = series.spline(df, ["k"], "t", "x")
    assert sent and frame.count() == 3000


def test_neighbours_are_found_in_one_join(spark):
    b = spark.createDataFrame([(n, *(2.0 * (n // 2**k % 2) for k in range(3)), *(2.0 * (n // 2**k % 2) + 2 for k in range(3))) for n in range(8)], "block int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    out = geometry.neighbours(b, (0.0, 0.0, 0.0), (4.0, 4.0, 4.0), 2.0, 2.0, (True, False, True))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # 18 before
    got = {(r["block"], r["face"]): r["neighbour"] for r in out.collect()}
    assert len(got) == 48 and got[0, "x-"] == got[0, "x+"] == 1 and got[0, "y-"] == geometry.MISSING and got[0, "y+"] == 2 and got[5, "z-"] == 1


def test_clusters_of_a_clump_make_no_list_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = np.concatenate([0.3 * rng.standard_normal((260, 3)), [2, 2, 2] + 0.001 * rng.standard_normal((400, 3)), [[2.05, 2.05, 2.09]] * 9, [[-1.0, 0.1, 0.0]]])
    df = spark.createDataFrame([(k + 5, *map(float, x)) for k, x in enumerate(m)] + [(1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0)], "tag int, x double, y double, z double")
    written, plain = [], sinks.cut_lineage

    def cut(frame):
        out = plain(frame)
        written.append(out.count())
        return out

    monkeypatch.setattr(sinks, "cut_lineage", cut)
    got = {r["tag"]: r["cluster"] for r in sinks.clusters(df, 0.12).collect()}
    assert max(written) < 10_000  # some 160,000 before
    label = np.arange(len(m))
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= 0.12
    while True:
        new = np.where(near, label[None], len(m)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(label)) > 20
    assert got == {k + 5: int(x) + 5 for k, x in enumerate(label)} | {1: 1, 2: 2}


def test_merging_looks_at_tiles_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(sinks, "CHUNK", 50)
    rng = np.random.default_rng(9)
    rows = [(k + 1, float(rng.integers(1, 4)), *map(float, 0.15 * rng.standard_normal(6))) for k in range(400)]
    df = spark.createDataFrame([*rows, (900, None, *[0.0] * 6)], "tag int, mass double, x double, y double, z double, vx double, vy double, vz double")
    want = {}
    for r in sinks.bound_pairs(df, 0.1, 1e-3).collect():
        want[r["a_tag"]] = max(want.get(r["a_tag"], (0, 0)), (r["b_mass"], -r["b_tag"]))
    assert len(want) > 50 and {r["tag"]: r["into"] for r in sinks.heaviest_bound(df, 0.1, 1e-3).collect()} == {k: -v[1] for k, v in want.items()}
