"""The correction of a point mass's force for all its periodic images, by Ewald's two sums, at points or as a table.

In a periodic box a mass pulls with all its images (and the mean density does not pull). The sum over images converges slowly; split by a
Gaussian it becomes a fast sum over near images with the complementary error function and a fast one over waves. The correction is what
is to be added to the pull of the nearest image: it is smooth, so a table of an octant of half the box, read by sinks.trilinear, serves for
all separations. Lengths may differ by axis. Sums run over lattice vectors within an ellipsoid of ``series`` boxes along x.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import AXES

FIELD = ("ewald_x", "ewald_y", "ewald_z")
SERIES = 5
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lattice(counts: list[int], scale: list[float], radius: float) -> np.ndarray:
    """Whole vectors within an ellipsoid."""
    n = np.stack(np.meshgrid(*(np.arange(-c, c + 1) for c in counts), indexing="ij"), -1).reshape(-1, 3)
    return n[((n * np.array(scale)) ** 2).sum(axis=1) <= radius * radius]


def correction(d: np.ndarray, lengths: tuple[float, float, float], series: int = SERIES, split: float = 2.0) -> np.ndarray:
    """For rows of separations (of the nearest image), the acceleration towards all images less that towards the nearest: of a unit mass, G = 1.

    split times 1 / lengths[0] is the width of the Gaussian's inverse; the sum doesn't depend on it but for what the cut-off leaves out.
    """
    size = np.array(lengths, float)
    shape = size / size[0]
    alpha = split / size[0]
    out = np.zeros_like(d, dtype=float)
    for n in lattice([math.ceil(series / s) for s in shape], list(shape), series):
        x = d + n * size
        r = np.sqrt((x * x).sum(axis=1))
        ar = alpha * r
        with np.errstate(divide="ignore", invalid="ignore"):
            if n.any():
                f = (_erfc(ar).astype(float) + 2 / math.sqrt(math.pi) * ar * np.exp(-ar * ar)) / r**3
            else:  # the nearest image itself: what the waves take of it
                f = np.where(ar > 1e-2, (_erfc(ar).astype(float) - 1 + 2 / math.sqrt(math.pi) * ar * np.exp(-ar * ar)) / r**3, -4 * alpha**3 / (3 * math.sqrt(math.pi)) * (1 - 0.6 * ar * ar))
        out += f[:, None] * x
    for h in lattice([math.ceil(series * s) for s in shape], list(1 / shape), series):
        if h.any():
            k = 2 * math.pi * h / size
            k2 = (k * k).sum()
            out += (4 * math.pi / size.prod() * math.exp(-k2 / (4 * alpha * alpha)) / k2 * np.sin(d @ k))[:, None] * k
    return -out


def _fields(lengths, series, split, batches):
    for batch in batches:
        d = np.column_stack([batch.column(batch.num_columns - 3 + k).to_numpy() for k in range(3)]).reshape(-1, 3)
        parts = [correction(d[i : i + 4096], lengths, series, split) for i in range(0, len(d), 4096)] or [np.zeros((0, 3))]
        got = np.concatenate(parts)
        kept = [batch.column(k) for k in range(batch.num_columns - 3)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[:, k]) for k in range(3))], [*batch.schema.names[:-3], *FIELD])


def at_points(points: DataFrame, lengths: tuple[float, float, float], series: int = SERIES, split: float = 2.0) -> DataFrame:
    """points (x, y, z: separations) with the correction, summed up for each; separations are taken to the nearest image first."""
    near = [F.col(a) - length * F.round(F.col(a) / length) for a, length in zip(AXES, lengths)]
    given = points.select("*", *(c.cast("double").alias(f"mq_{a}") for c, a in zip(near, AXES)))
    schema = points.withColumns({f: F.lit(0.0) for f in FIELD}).schema
    return given.mapInArrow(partial(_fields, lengths, series, split), schema)


def table(spark: SparkSession, cells: tuple[int, int, int], lengths: tuple[float, float, float], series: int = SERIES, split: float = 2.0) -> DataFrame:
    """i, j, k, x, y, z and the correction at the points of an octant grid from 0 to half the box, ends included (two points a side at least)."""
    nx, ny, nz = cells
    step = [length / 2 / (n - 1) for n, length in zip(cells, lengths)]
    rows = spark.range(nx * ny * nz).select((F.col("id") % nx).alias("i"), (F.floor(F.col("id") / nx) % ny).alias("j"), F.floor(F.col("id") / (nx * ny)).alias("k"))
    rows = rows.select("i", "j", "k", *((F.col(c) * s).alias(a) for c, a, s in zip("ijk", AXES, step)))
    return at_points(rows.withColumns({a: F.col(a) * (1 - 1e-12) for a in AXES}), lengths, series, split)


def from_table(points: DataFrame, grid: DataFrame, cells: tuple[int, int, int], lengths: tuple[float, float, float]) -> DataFrame:
    """points (tag, x, y, z: separations) with the correction read from table(): by size of each separation, with its sign."""
    from .sinks import trilinear  # noqa: PLC0415  (sinks import this module's neighbours)

    step = tuple(length / 2 / (n - 1) for n, length in zip(cells, lengths))
    near = [F.col(a) - length * F.round(F.col(a) / length) for a, length in zip(AXES, lengths)]
    at = points.select("tag", *(F.abs(c).alias(a) for c, a in zip(near, AXES)), *(F.signum(c).alias(f"mq_s{a}") for c, a in zip(near, AXES)))
    got = trilinear(at, grid.select("i", "j", "k", *FIELD), step, FIELD)
    read = got.select("tag", *((F.col(f) * F.col(f"mq_s{a}")).alias(f) for f, a in zip(FIELD, AXES)))
    return points.join(read, "tag")
