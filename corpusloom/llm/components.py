"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of every node that stands in ``links`` (a, b).

    Each half round takes the smallest neighbour of every node by an aggregate and joins it back to
    the links, so no neighbour list is ever gathered, and writes the new links to the shared
    folder, so that a lost executor costs one half round.  Null ends and loops are left out.
    """
    e = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the greater neighbours of every node go to its smallest neighbour
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the smaller neighbours of every node, and the node, go to the smallest one
        j = large.join(least, "u")
        e = cut(
            j.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(j.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
