"""Structure and correlation functions on refined meshes: blocks meet first, then the cells of blocks that are near enough.

Pairs of leaf blocks whose centres lie within the longest lag plus a block's diagonal are found on buckets, with periodic images; no
pair of far blocks is looked at. Cells meet by block and number in plain equi-joins. With ``samples`` each pair of blocks takes
about that many cells of the first and a number of the second that falls with the square of the distance of the blocks, by a seeded hash, so reruns
agree. A pair of cells counts with the sum of their volumes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import AXES
from .pairs import told_increments


def nearest_image(d: Column, length: float) -> Column:
    """A difference of coordinates, to the nearest periodic image."""
    return F.when(d > length / 2, d - length).when(d < -length / 2, d + length).otherwise(d)


def block_pairs(blocks: DataFrame, most: float, low: tuple[float, float, float], lengths: tuple[float, float, float]) -> DataFrame:
    """a, b, distance of ordered pairs of blocks (a block with itself, too) whose centres are within ``most`` plus the largest diagonal."""
    side = [F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in AXES]
    diagonal = blocks.agg(F.max(F.sqrt(side[0] * side[0] + side[1] * side[1] + side[2] * side[2]))).first()[0]
    if diagonal is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"), F.lit(0.0).alias("distance"))
    reach = most + diagonal
    centres = blocks.select("block", *((F.col(f"lo_{x}") / 2 + F.col(f"hi_{x}") / 2).alias(x) for x in AXES))
    one, other = (centres.select(F.col("block").alias(p), *(F.col(x).alias(f"{p}_{x}") for x in AXES)) for p in "ab")
    for x, lo, length in zip(AXES, low, lengths):
        n = max(1, int(length // reach))
        bucket = lambda c: F.pmod(F.floor((c - lo) / length * n), F.lit(n)).cast("int")  # noqa: E731, B023
        one = one.withColumn(f"q{x}", bucket(F.col(f"a_{x}")))
        around = F.array_distinct(F.array(*(F.pmod(bucket(F.col(f"b_{x}")) + s, F.lit(n)).cast("int") for s in (-1, 0, 1))))
        other = other.withColumn(f"q{x}", F.explode(around))
    met = one.join(other, [f"q{x}" for x in AXES])
    d = [nearest_image(F.col(f"b_{x}") - F.col(f"a_{x}"), length) for x, length in zip(AXES, lengths)]
    return met.withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("distance") <= reach).select("a", "b", "distance")


def sampled(pairs: DataFrame, cells_per_block: int, most: float, least: float, samples: int, seed: int) -> DataFrame:
    """pairs with number (of a cell of b): so many as the distance asks for, evenly spaced from a start by a hash; pairs that ask for none go.

    At the longest lag a pair asks for samples / (most / least - 0.9) cells, at a shorter one for more by the square of the distance.
    """
    norm = min(samples, cells_per_block) / (most / least - 0.9)
    asked = F.when(F.col("distance") == 0, F.lit(norm * min(samples, cells_per_block))).otherwise(norm * F.pow(F.col("distance") / most, F.lit(-2.0)))
    step = F.greatest(F.floor(cells_per_block / F.greatest(F.floor(asked), F.lit(1))), F.lit(1)).cast("int")
    out = pairs.where(F.floor(asked) >= 1).withColumn("step", step).where(F.col("step") < cells_per_block)
    start = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.col("step").cast("long")).cast("int")
    return out.withColumn("number", F.explode(F.sequence(start, F.lit(cells_per_block - 1), F.col("step")))).drop("step")


def pair_statistics(cells: DataFrame, blocks: DataFrame, fields: dict[str, tuple[Column, ...]], most: float, width: float, low: tuple[float, float, float],
                    lengths: tuple[float, float, float], orders: int = 4, kind: str = "sf", absolute: bool = False, special: dict | None = None,
                    samples: int | None = None, cells_per_block: int | None = None, seed: int = 140281) -> DataFrame:
    """type, bin, n, weight, and for each order the means of the longitudinal and transverse parts, as pairs.pair_statistics, on a refined mesh.

    cells: block, number (0 to cells_per_block - 1 in its block), x, y, z, vol and what fields name; blocks: the leaves. A bin holds distances
    from bin * width on, up to ``most``; both orders of a pair of cells count. Without samples all pairs of cells count.
    """
    columns = sorted({c for c in cells.columns if c not in ("block", "number", "vol", *AXES)})
    named = {name: [f"{name}_{x}" for x in range(len(parts))] for name, parts in fields.items()}
    base = cells.select("block", "number", *AXES, "vol", *columns, *(c.alias(f"{name}_{x}") for name, parts in fields.items() for x, c in enumerate(parts)))
    values = [c for c in base.columns if c not in ("block", "number")]
    met = block_pairs(blocks, most, low, lengths)
    first = base.select(F.col("block").alias("a"), F.col("number").alias("l_number"), *(F.col(v).alias(f"l_{v}") for v in values))
    second = base.withColumnRenamed("block", "b")
    if samples is None:
        both = met.join(second, "b").join(first, "a")
    else:
        if not cells_per_block:
            raise ValueError("sampling needs the number of cells of a block")
        least = blocks.agg(F.min(F.least(*(F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in AXES)))).first()[0] or most
        first = first.where(F.pmod(F.xxhash64(F.lit(seed), "a", "l_number"), F.lit(cells_per_block)) < samples)  # each cell with a chance of samples / cells_per_block
        both = sampled(met, cells_per_block, most, least, samples, seed).join(second, ["b", "number"]).join(first, "a")
    d = [nearest_image(F.col(x) - F.col(f"l_{x}"), length) for x, length in zip(AXES, lengths)]
    both = both.withColumns(dict(zip(("mq_a", "mq_b", "mq_c"), d))).withColumn("r", F.sqrt(sum((F.col(c) * F.col(c) for c in ("mq_a", "mq_b", "mq_c")), F.lit(0.0))))
    both = both.where((F.col("r") > 0) & (F.col("r") <= most))
    unit = [F.col(c) / F.col("r") for c in ("mq_a", "mq_b", "mq_c")]
    told = told_increments(named, unit, kind, absolute, special)
    rows = both.select(F.floor(F.col("r") / width + 1e-9).cast("long").alias("bin"), (F.col("l_vol") + F.col("vol")).alias("w"), F.explode(told).alias("x")).select("bin", "w", "x.*")
    weight = F.sum("w")
    means = [(F.sum(F.col("w") * F.pow(c, F.lit(float(p)))) / weight).alias(f"{kind}{p}_{c}") for p in range(1, (orders if kind == "sf" else 1) + 1) for c in ("long", "trans")]
    return rows.groupBy("type", "bin").agg(F.count("*").alias("n"), weight.alias("weight"), *means)


def shortest_lag(blocks: DataFrame, per_block: int) -> float:
    """The finest cell's side: the least width of a bin that makes sense."""
    return float(blocks.agg(F.min((F.col("hi_x") - F.col("lo_x")) / per_block)).first()[0] or math.nan)
