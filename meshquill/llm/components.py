"""Connected components of a table of links, by alternating large and small stars.

Each round is joins and grouped minima over the links (partial aggregation takes the heat off hubs, and the joins are plain
equi-joins that Spark may split), written to the shared folder. Nothing but two counts a round reaches the driver. The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of its component) of every node that has a link; null ends and loops are ignored."""
    stars = links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where("child > parent").distinct()
    stars = materialize(stars, "links")
    for _ in range(rounds):
        both = stars.unionAll(stars.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        least = both.groupBy("child").agg(F.least(F.first("child"), F.min("parent")).alias("low"))
        large = both.where("parent > child").join(least, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        large = large.unionAll(least.where("low < child").select("child", F.col("low").alias("parent"))).distinct()
        lowest = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(lowest, "child").where("parent > low").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        new = materialize(small.unionAll(lowest.select("child", F.col("low").alias("parent"))).distinct(), "links")
        release(stars)
        stars = new
        inner = stars.join(stars.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        torn = stars.groupBy("child").agg(F.count("*").alias("parents")).where("parents > 1")
        if inner.limit(1).count() == 0 and torn.limit(1).count() == 0:  # no parent has a parent, each child has one: stars
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = stars.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    return nodes.unionAll(stars.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())
