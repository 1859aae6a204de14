"""Consolidating pairwise matches into groups by seed-tree pruning.

In each round every vertex tells its neighbours (and itself) the smallest id it sees. A vertex that nobody chose as
smallest drops out: it becomes a child of the smallest id it was told, in a forest. The others go on, linked to the
smallest ids they were told. The graph shrinks until only one seed of each component is left; then the seeds' ids flow
down the forest, one level of rounds at a time. Every round is a few aggregations and joins; nothing of the graph is
collected. A hub's neighbours reach it through map-side minima; the join that carries a hub's minimum back to its edges
has the one-row-per-vertex side on the other end, so the adaptive skew join may split the hub's edges.

Defined results: self pairs and pairs with a null end link nothing and give no row; both orders and repeats of a pair
are one link; every vertex of a link comes out once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Cut, cut


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) with the smallest id of each component, for every id in a pair of two different ids."""
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # Round 1 sees both directions of each distinct link.
    links = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    graph = cut(links)
    forest: list[Cut] = []  # of each round, what every vertex was told
    while graph.rows:
        both = graph.df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # (w, m): w was told m, by a neighbour or by itself.
        told = cut(both.join(least, "u").select(F.col("v").alias("w"), "m").union(least.select(F.col("u").alias("w"), "m")).distinct())
        chosen = cut(told.df.groupBy("w").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("w")).alias("stays")))
        forest.append(chosen)
        onward = cut(told.df.join(chosen.df.select("w", "low"), "w").where("m <> low").select(F.least("m", "low").alias("u"), F.greatest("m", "low").alias("v")).distinct())
        for c in (told, graph):
            c.drop()
        graph = onward
    if not forest:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("group_id")).limit(0)
    # A parent drops out in a later round than its child, or never: then it is a seed. Each level writes its own rows only.
    known: list[DataFrame] = []
    for chosen in reversed(forest):
        level = chosen.df.where("not stays").select(F.col("w").alias("id"), F.col("low").alias("parent"))
        if known:
            above = reduce(DataFrame.union, known).select(F.col("id").alias("parent"), "group_id")
            level = level.join(above, "parent", "left").select("id", "parent", "group_id")
        else:
            level = level.withColumn("group_id", F.lit(None).cast(level.schema["parent"].dataType))
        found = cut(level).df
        known.append(found.select("id", F.coalesce("group_id", "parent").alias("group_id")))
        known.append(found.where("group_id is null").select(F.col("parent").alias("id"), F.col("parent").alias("group_id")).distinct())
        chosen.drop()
    return reduce(DataFrame.union, known)
