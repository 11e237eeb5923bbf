"""Gravity of very many masses on points by a tree of cubes: gas may be the source.

Masses are numbered along a Morton curve; a cube of a level is a prefix of that number. Cubes of more than ``leaf`` masses have children; each
has its mass and centre of mass, grouped from the masses with partial aggregation. Points go down from the root level by level: a
cube that looks smaller than the opening angle pulls as one mass; a leaf that doesn't is unfolded into its masses; any other is opened into its
children. A level is one equi-join of points and cubes with the tree and its result is written, so there is no cross join,
no list of all masses anywhere, and the plan does not grow with the tree. A point meets some hundreds of cubes.

The pull is that of Plummer's softening, or of sinks.gravity's linear or spline kernel, so gravity of very many sinks can go by the tree too; a
mass at the very place of a point pulls with nothing but its potential. In a periodic box
(lengths) the nearest images pull; cubes half a box away are opened, which takes points about as many more cubes as there are masses to the
power of two thirds. With an angle of 0 no cube is ever far, so all masses are summed up one by one by sinks.gravity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import AXES
from .sinks import cut_lineage, gravity, softened, well

DEPTH, LEAF, ANGLE = 12, 16, 0.5


def morton_number(parts: list[Column], depth: int) -> Column:
    """The bits of whole numbers below 2**depth (depth up to 20), interleaved."""
    out = F.lit(0).cast("long")
    for bit in range(depth):
        for k, c in enumerate(parts):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1)), 3 * bit + k))
    return out


def tree(masses: DataFrame, low: tuple[float, float, float], side: float, depth: int = DEPTH, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """The cubes (level, key, n, mass, c_x, c_y, c_z, leaf) and the masses with number. Cubes below a leaf are left out.

    Masses at one place make leaves of the last level, however many they are.
    """
    at = [F.least(F.greatest(F.floor((F.col(a) - lo) / side * 2**depth), F.lit(0)), F.lit(2**depth - 1)) for a, lo in zip(AXES, low)]
    numbered = cut_lineage(masses.select("mass", *AXES).withColumn("number", morton_number(at, depth)))
    levels = numbered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("key", F.expr(f"shiftright(number, 3 * ({depth} - level))"))
    sums = [F.sum(F.col("mass") * F.col(a)).alias(f"s_{a}") for a in AXES] + [F.avg(a).alias(f"m_{a}") for a in AXES]
    cubes = levels.groupBy("level", "key").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), *sums)
    centre = [F.when(F.col("mass") != 0, F.col(f"s_{a}") / F.col("mass")).otherwise(F.col(f"m_{a}")).alias(f"c_{a}") for a in AXES]
    cubes = cubes.select("level", "key", "n", "mass", *centre, ((F.col("n") <= leaf) | (F.col("level") == depth)).alias("leaf"))
    cubes = cut_lineage(cubes)
    above = cubes.where("not leaf").select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
    kept = cubes.withColumn("parent", F.shiftright("key", 3)).join(above, ["level", "parent"], "left_semi").drop("parent")
    return kept.unionByName(cubes.where("level = 0")), numbered


def nearest(d: Column, length: float | None) -> Column:
    return d if length is None else d - length * F.round(d / length)


def pull(points: DataFrame, soft: float, g: float, lengths, mass: str, prefix: str, kernel: str) -> DataFrame:
    """mq_point and the sums of acceleration and potential of masses at prefix_x, ... on points at x, y, z."""
    d = [nearest(F.col(f"{prefix}{a}") - F.col(a), None if lengths is None else lengths[k]) for k, a in enumerate(AXES)]
    rows = points.withColumns({f"mq_d{a}": c for a, c in zip(AXES, d)})
    r2 = sum((F.col(f"mq_d{a}") * F.col(f"mq_d{a}") for a in AXES), F.lit(0.0))
    if kernel == "plummer":
        rows = rows.withColumn("mq_r2", r2 + soft * soft)
        weight = F.when(F.col("mq_r2") > 0, g * F.col(mass) / F.pow("mq_r2", F.lit(1.5))).otherwise(0.0)
        deep = F.when(F.col("mq_r2") > 0, -g * F.col(mass) / F.sqrt("mq_r2")).otherwise(0.0)
    else:
        rows = rows.withColumn("mq_r", F.sqrt(r2))
        weight = F.when(F.col("mq_r") > 0, g * F.col(mass) * softened(F.col("mq_r"), soft, kernel)).otherwise(0.0)
        deep = g * F.col(mass) * well(F.col("mq_r"), soft)
    return rows.groupBy("mq_point").agg(*(F.sum(weight * F.col(f"mq_d{a}")).alias(f"a{a}") for a in AXES), F.sum(deep).alias("phi"))


def tree_gravity(points: DataFrame, masses: DataFrame, low: tuple[float, float, float], side: float, soft: float = 0.0, g: float = 1.0, angle: float = ANGLE,
                 lengths: tuple[float, float, float] | None = None, depth: int = DEPTH, leaf: int = LEAF, kernel: str = "plummer") -> DataFrame:
    """points (tag, x, y, z, unique tags) with ax, ay, az, phi due to masses (mass, x, y, z) in a cube from ``low`` of a side."""
    if angle == 0:
        return gravity(points, masses, soft, g, kernel, lengths)
    cubes, numbered = tree(masses, low, side, depth, leaf)
    cubes = cut_lineage(cubes)
    deepest = cubes.agg(F.max("level")).first()[0]
    at = points.select(F.col("tag").alias("mq_point"), *(F.col(a).cast("double").alias(a) for a in AXES))
    open_, sums = at.withColumn("key", F.lit(0).cast("long")), []
    for level in range((-1 if deepest is None else deepest) + 1):
        here = cubes.where(F.col("level") == level).drop("level")
        met = open_.join(here, "key")
        d = [nearest(F.col(f"c_{a}") - F.col(a), None if lengths is None else lengths[k]) for k, a in enumerate(AXES)]
        far = angle * F.sqrt(sum((c * c for c in d), F.lit(0.0))) > side / 2**level
        if lengths is not None:  # a cube half a box away may have masses whose nearest images are on either side
            for c, length in zip(d, lengths):
                far = far & (F.abs(c) + side / 2**level <= length / 2)
        met = cut_lineage(met.withColumn("far", far))
        sums.append(cut_lineage(pull(met.where("far"), soft, g, lengths, "mass", "c_", kernel)))
        inside = numbered.select(F.shiftright("number", 3 * (depth - level)).alias("key"), F.col("mass").alias("mq_mass"), *(F.col(a).alias(f"mq_m{a}") for a in AXES))
        near = met.where("leaf and not far").select("mq_point", *AXES, "key").join(inside, "key")
        sums.append(cut_lineage(pull(near, soft, g, lengths, "mq_mass", "mq_m", kernel)))
        below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.shiftleft(F.col("key"), 3) + c)).alias("key")
        open_ = met.where("not leaf and not far").select("mq_point", *AXES, below)
    names = [*(f"a{a}" for a in AXES), "phi"]
    if not sums:
        return points.withColumns({n: F.lit(0.0) for n in names})
    every = sums[0]
    for s in sums[1:]:
        every = every.unionAll(s)
    total = every.groupBy(F.col("mq_point").alias("tag")).agg(*(F.sum(n).alias(n) for n in names))
    return points.join(total, "tag", "left").fillna(0.0, names)
