"""A mesh laid out by block, so that what is asked for decides which files are read.

A mesh is a folder of three Parquet tables: ``blocks`` (block, level, node_type, bounds, region), ``cells`` (block, i, j, k and a column
for each variable, in folders by level and region, sorted by block within a file) and ``params`` (typed parameters). A region is the
Morton number of the cube, one of 8**depth of the domain, that holds a block's centre; so there are folders for levels times
regions at most, however many blocks there are, and what is near lies together.

Readers choose blocks by the catalogue. The chosen blocks' levels and regions, at most as many as there are folders, meet the
cells in a broadcast join on the folder columns, from which Spark prunes folders at run time; a variable that is not asked for is not read,
and one block is found by its folder and its row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import AXES, block_summary, blocks_in_box, blocks_in_sphere, inside_box, with_geometry
from .tables import grid_kind, parameters

DEPTH = 2
#: Rows up to which the chosen blocks are broadcast; more are joined by a shuffle.
FEW = 100_000


def morton(parts: list[Column], depth: int) -> Column:
    """The bits of whole numbers below 2**depth, interleaved."""
    out = F.lit(0).cast("int")
    for bit in range(depth):
        for k, c in enumerate(parts):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), bit).bitwiseAND(F.lit(1)), 3 * bit + k))
    return out


def with_region(blocks: DataFrame, low: list[float], high: list[float], depth: int = DEPTH) -> DataFrame:
    """blocks with the Morton number of the region that their centre is in."""
    side = 2**depth
    at = [F.floor(((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 - lo) / (hi - lo) * side) for a, lo, hi in zip(AXES, low, high)]
    return blocks.withColumn("region", morton([F.greatest(F.lit(0), F.least(F.lit(side - 1), c)) for c in at], depth))


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """Marked for broadcast, if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_mesh(path: str, cells: DataFrame, blocks: DataFrame, params: dict, depth: int = DEPTH) -> None:
    """Write cells (block, i, j, k, variables) and blocks (block, level, node_type, lo_ and hi_ bounds) as a mesh.

    Cells are dealt out by ranges of level, region and block: a region of many cells is shared by several tasks, and each writes few files.
    """
    spark = cells.sparkSession
    ends = blocks.agg(*(F.min(f"lo_{a}") for a in AXES), *(F.max(f"hi_{a}") for a in AXES)).first()
    if ends[0] is None:
        raise ValueError("a mesh needs blocks")
    with_region(blocks, list(ends[:3]), list(ends[3:]), depth).write.parquet(f"{path}/blocks")
    parameters(spark, params).write.parquet(f"{path}/params")
    catalogue = spark.read.parquet(f"{path}/blocks").select("block", "level", "region")
    dealt = cells.join(few(catalogue), "block").repartitionByRange("level", "region", "block").sortWithinPartitions("level", "region", "block", "k", "j", "i")
    dealt.write.partitionBy("level", "region").parquet(f"{path}/cells")


@dataclass(frozen=True)
class Mesh:
    """An opened mesh; nothing is read but what a method's result needs."""

    spark: SparkSession
    path: str
    per_block: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @property
    def params(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/params")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def kind(self) -> DataFrame:
        """grid_type, boundary and ndim, from the parameters."""
        return grid_kind(self.params, False)

    def report(self, scalars: tuple[str, ...] = ("time", "dt", "redshift", "nstep")) -> DataFrame:
        """One row: what block_summary() says of the blocks, and scalars from the parameters (null where there is none)."""
        of = [F.max(F.when(F.col("name") == n, F.coalesce("d", F.col("i").cast("double")))).alias(n) for n in scalars]
        return block_summary(self.blocks, self.per_block).crossJoin(self.params.agg(*of))  # a row each

    def variables(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("block", "i", "j", "k", "level", "region")]

    def chosen(self, blocks: DataFrame, names: list[str]) -> DataFrame:
        """block, i, j, k and variables of the cells of some rows of the catalogue; folders without such blocks are not read."""
        folders = blocks.select("level", "region").distinct()  # at most the number of folders
        cells = self.cells.select("block", "i", "j", "k", "level", "region", *names).join(F.broadcast(folders), ["level", "region"])
        return cells.join(few(blocks.select("block")), "block", "left_semi").select("block", "i", "j", "k", *names)

    def block(self, number: int, names: list[str]) -> DataFrame:
        """i, j, k and variables of one block: its folder by the catalogue, its rows by the files' statistics."""
        at = self.blocks.where(F.col("block") == number).select("level", "region").first()
        if at is None:
            raise ValueError(f"no block {number}")
        rows = self.cells.where((F.col("level") == at["level"]) & (F.col("region") == at["region"]) & (F.col("block") == number))
        return rows.select("i", "j", "k", *names)

    def variable(self, names: list[str], leaf: bool = True) -> DataFrame:
        """block, i, j, k and variables of all blocks, or of the leaf blocks."""
        return self.chosen(self.blocks.where("node_type = 1"), names) if leaf else self.cells.select("block", "i", "j", "k", *names)

    def in_box(self, low: list[float], high: list[float], names: list[str]) -> DataFrame:
        """Leaf cells with centre, size and volume whose centre is inside a box."""
        blocks = blocks_in_box(self.blocks.where("node_type = 1"), low, high)
        return with_geometry(self.chosen(blocks, names), few(blocks), self.per_block).where(inside_box(low, high))

    def in_sphere(self, centre: list[float], radius: float, names: list[str]) -> DataFrame:
        """Leaf cells with centre, size and volume whose centre is within a radius."""
        blocks = blocks_in_sphere(self.blocks.where("node_type = 1"), centre, radius)
        r2 = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip(AXES, centre)), F.lit(0.0))
        return with_geometry(self.chosen(blocks, names), few(blocks), self.per_block).where(r2 <= radius * radius)


def open_mesh(spark: SparkSession, path: str, per_block: int | None = None) -> Mesh:
    """A mesh written by write_mesh(); cells a side of a block default to the parameter nxb."""
    if per_block is None:
        found = spark.read.parquet(f"{path}/params").where("name = 'nxb'").select("i").first()
        if found is None or found["i"] is None:
            raise ValueError("the mesh has no parameter nxb: name the cells a side of a block")
        per_block = found["i"]
    return Mesh(spark, path, per_block)
