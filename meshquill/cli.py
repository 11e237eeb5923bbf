"""Command lines over the operators: python -m meshquill.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import derived, models
from .operators import refined_pairs, series, spectral, stats
from .operators.geometry import extract, project, smooth, with_geometry
from .sources import mesh, tables, text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="meshquill")
    commands = out.add_subparsers(dest="command", required=True)
    c = commands.add_parser("series", help="evolution tables: clean them of overwritten rows, moments of a column")
    c.add_argument("path")
    c.add_argument("--moments", help="a column by name, number or part of its name")
    c.add_argument("--range", nargs=2, type=float, help="first and last time")
    c.add_argument("--output", help="folder for the cleaned table as text")
    c = commands.add_parser("log", help="runs and steps of log files")
    c.add_argument("path")
    c = commands.add_parser("dump", help="the dump nearest to a time, a mass of sinks or a largest density; of two as near the later one")
    c.add_argument("path", help="Parquet with dump, time, mass, max_dens")
    for name in ("time", "mass", "max_dens"):
        c.add_argument(f"--{name}", type=float)
    c = commands.add_parser("average", help="means of table files over files")
    c.add_argument("path")
    c.add_argument("--bin", required=True)
    c.add_argument("--value", required=True)
    c.add_argument("--log", action="store_true")
    c.add_argument("--head", type=int, default=1, help="lines before the numbers")
    def of_mesh(name: str, what: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=what + " of a mesh as written by sources.mesh")
        c.add_argument("path")
        c.add_argument("--dset", default="dens", help="a variable, or one derived from others")
        c.add_argument("--output", help="a folder for the result as Parquet, instead of lines")
        return c

    c = of_mesh("pdfs", "the PDF")
    for name in ("bw", "vmin", "vmax"):
        c.add_argument(f"--{name}", type=float, required=True)
    c.add_argument("--scl", type=float, default=1.0, help="values are divided by this")
    c.add_argument("--lgdata", action="store_true", help="of log10 of the values")
    c.add_argument("--lndata", action="store_true", help="of the natural logarithm of the values")
    c.add_argument("--log", action="store_true", help="bins in log10")
    c.add_argument("--weight", help="a variable by which cells count, besides their volume")
    c.add_argument("--moments", action="store_true", help="moments of the PDF instead")
    c = of_mesh("spectra", "the power spectrum (uniform meshes)")
    c.add_argument("--vector", nargs="+", help="two or three components to split into longitudinal and transverse parts")
    c.add_argument("--ndim", type=int, default=3, choices=(2, 3))
    c = of_mesh("sf_cf", "structure functions (or correlation functions)")
    c.add_argument("--vector", nargs=3)
    c.add_argument("--cf", action="store_true")
    c.add_argument("--most", type=float, required=True, help="the longest distance")
    c.add_argument("--width", type=float, required=True, help="of a bin")
    c.add_argument("--samples", type=int, help="cells of a block that each pair of blocks takes; all by default")
    c.add_argument("--orders", type=int, default=4)
    c = of_mesh("projection", "the mean along z")
    c.add_argument("--pixels", nargs=2, type=int, required=True)
    c.add_argument("--weight")
    c.add_argument("--fwhm", type=float, help="smoothing in pixels")
    c.add_argument("--bounds", nargs=6, type=float, help="x, y and z from and to; the whole domain by default")
    c = of_mesh("extractor", "a uniform cube")
    c.add_argument("--cells", nargs=3, type=int, required=True)
    c.add_argument("--low", nargs=3, type=float, required=True)
    c.add_argument("--size", type=float, required=True, help="a cell's side")
    c.add_argument("--periodic", action="store_true")
    c.add_argument("--weight")
    c = commands.add_parser("cloud", help="initial conditions of a cloud in cgs units")
    for name in ("dens", "size", "sigma"):
        c.add_argument(f"--{name}", type=float, required=True)
    for name in ("omega", "field"):
        c.add_argument(f"--{name}", type=float, default=0.0)
    c.add_argument("--box", action="store_true")
    return out


def shown(row) -> str:
    return " ".join(f"{k}={v}" for k, v in row.asDict().items())


def on_mesh(a: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """What a command asks of a mesh."""
    m = mesh.open_mesh(spark, a.path)
    have = m.variables()
    lows, highs = ([f"{e}_{x}" for x in "xyz"] for e in ("lo", "hi"))
    ends = m.blocks.agg(*(F.min(c) for c in lows), *(F.max(c) for c in highs)).first()
    low, high = list(ends[:3]), list(ends[3:])
    lengths = tuple(h - lo for lo, h in zip(low, high))

    def value(name: str) -> Column:
        return F.col(name) if name in have else derived.variable(name)

    leaves = m.blocks.where("node_type = 1")
    if a.command == "sf_cf":
        n = m.per_block
        c = with_geometry(m.variable(have), mesh.few(leaves), n).withColumn("number", (F.col("i") + n * F.col("j") + n * n * F.col("k")).cast("int"))
        of = tuple(value(v) for v in a.vector) if a.vector else (value(a.dset),)
        keep = c.select("block", "number", "x", "y", "z", "vol", *have)
        return refined_pairs.pair_statistics(keep, leaves, {"_".join(a.vector or [a.dset]): of}, a.most, a.width, tuple(low), lengths, a.orders, "cf" if a.cf else "sf", samples=a.samples, cells_per_block=n**3).orderBy("type", "bin")
    cells = with_geometry(m.variable(have), mesh.few(leaves), m.per_block)
    if a.command == "pdfs":
        x = value(a.dset) / a.scl
        x = F.log10(x) if a.lgdata else F.ln(x) if a.lndata else x
        out = stats.pdf(cells, x, F.col("vol") * (value(a.weight) if a.weight else F.lit(1.0)), a.vmin, a.vmax, a.bw, a.log)
        return stats.pdf_moments(out, a.vmin, a.bw, a.log) if a.moments else out.orderBy("bin")
    if a.command == "spectra":
        names = a.vector or [a.dset]
        size = cells.agg(F.min("dx"), F.max("dx")).first()
        if size[0] is None or size[1] - size[0] > 1e-9 * size[1] or max(lengths[: a.ndim]) - min(lengths[: a.ndim]) > 1e-9 * lengths[0]:
            raise SystemExit("spectra need a cube of cells of one size: extract one first")
        n = round(lengths[0] / size[0])
        at = [F.floor((F.col(x) - lo) / size[0]).cast("long").alias(i) for i, x, lo in zip("ijk"[: a.ndim], "xyz", low)]
        modes = spectral.transform_fields(cells.select(*at, *(value(v).alias(f"f{k}") for k, v in enumerate(names))), [f"f{k}" for k in range(len(names))], n, a.ndim)
        fields = tuple(f"f{k}" for k in range(len(names)))
        found, told = (spectral.split_power(modes, fields, n), ["long", "trans", "total"]) if a.vector else (spectral.powers(modes, list(fields)), list(fields))
        return spectral.table(found, n, told, ndim=a.ndim).orderBy("bin")
    weight = value(a.weight) if a.weight else None
    if a.command == "extractor":
        return extract(cells, value(a.dset), tuple(a.low), a.size, tuple(a.cells), weight, lengths if a.periodic else None).orderBy("iz", "iy", "ix")
    bounds = a.bounds or [e for pair in zip(low, high) for e in pair]
    inside = cells.where((F.col("z") > bounds[4]) & (F.col("z") < bounds[5]))
    pixel = (bounds[1] - bounds[0]) / a.pixels[0]
    out = project(inside, value(a.dset), (bounds[0], bounds[2]), pixel, tuple(a.pixels), weight)
    return (smooth(out, a.fwhm, tuple(a.pixels)) if a.fwhm else out).orderBy("iy", "ix")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command in ("pdfs", "spectra", "sf_cf", "projection", "extractor"):
        out = on_mesh(a, spark)
        if a.output:
            out.write.mode("error").parquet(a.output)
        else:
            for r in out.toLocalIterator():  # a partition at a time
                print(shown(r))
    elif a.command == "series":
        rows = text.read_series(spark, a.path)
        names = [c for c in rows.columns if c not in ("file", "line_no")]
        rows = series.cleaned(rows, "line_no", names[0], ["file"])
        if a.range:
            rows = series.in_window(rows, names[0], *a.range)
        if a.moments:
            for r in series.time_moments(rows, ["file"], names[0], names[text.column_of(names, a.moments)]).collect():  # a row a file
                print(shown(r))
        if a.output:
            text.format_series(rows.orderBy("file", "line_no"), names).write.mode("error").text(a.output)
    elif a.command == "log":
        steps = series.step_durations(text.parse_log(text.numbered(spark.read.text(a.path)), key=("file",)), ["file", "run"], "n", "ts")
        cost = F.col("seconds") / F.col("cells") / F.col("max_leaf")
        used = steps.groupBy("file", "run").agg(F.count("*").alias("steps"), F.sum("seconds").alias("seconds"), (F.sum(F.col("seconds") * F.col("n_procs")) / 3600).alias("cpu_hours"))
        costs = stats.percentiles(steps.withColumn("cost", cost), ["file", "run"], "cost", {"p16": 0.16, "p50": 0.5, "p84": 0.84})
        for r in used.join(costs, ["file", "run"], "left").orderBy("file", "run").collect():  # a row a run
            print(shown(r))
    elif a.command == "dump":
        name, wanted = next((n, v) for n in ("time", "mass", "max_dens") if (v := getattr(a, n)) is not None)
        for r in series.nearest_dump(spark.read.parquet(a.path), name, wanted, "dump").collect():
            print(shown(r))
    elif a.command == "average":
        lines = text.numbered(spark.read.text(a.path))
        names = lines.where(F.col("line_no") == a.head - 1).orderBy("file").first()["value"].split()
        rows = tables.parse_table(lines, names, a.head)
        if series.misaligned(rows, a.bin, "file").limit(1).count():
            raise SystemExit("the files have different bins")
        found = series.ensemble_log(rows, a.bin, a.value) if a.log else series.ensemble(rows, a.bin, a.value)
        for r in found.orderBy(a.bin).collect():  # a row a bin
            print(shown(r))
    else:
        one = spark.range(1).select(*(F.lit(getattr(a, n)).alias(n) for n in ("dens", "size", "sigma", "omega", "field")))
        out = models.cloud_conditions(*(F.col(n) for n in ("dens", "size", "sigma", "omega", "field")), box=a.box)
        print(shown(one.select(*(c.alias(n) for n, c in out.items())).first()))


if __name__ == "__main__":
    main()
