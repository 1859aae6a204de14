"""Near-duplicate word sets: an exact Jaccard join over classes of equal sets, and what reports ask of it.

Equal sets are one class, so copies are never paired with each other while joining. Classes meet by their rarest words;
see regions.py. Reports (the closest pairs, how many there are) are worked out from the classes and their sizes; only
similar_sets() lists all pairs of rows.

Defined results: an empty set is in no class; a row delivered twice with one set is one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut
from . import regions

#: A word that so many sets have at most is a key by itself; others are keys with the words after them.
RARE = 128
#: Keys counted to be those of more sets than this are divided by further words.
LARGE = 1024
#: The finest fraction that a threshold is taken for.
FINEST = 10**6


@dataclass
class Near:
    """members (id, row): rows by class, named by its smallest row; pairs (ia, ib, similarity): similar classes, ia < ib."""

    members: DataFrame
    pairs: DataFrame


def near_classes(sets: DataFrame, row: str = "row", words: str = "words", threshold: float = 0.8) -> Near:
    """Classes of equal sets and the pairs of classes with a Jaccard similarity of at least `threshold` (<= 0 means 0.8)."""
    t = threshold if threshold > 0 else 0.8
    own = sets.select(F.col(row).alias("row"), F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("words")).where(F.size("words") > 0)
    keyed = cut(own.select("row", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.col("words")).alias("h2"), "words"))
    reps = cut(keyed.df.groupBy("h1", "h2").agg(F.min("row").alias("id"), F.first("words").alias("words")))
    members = keyed.df.select("row", "h1", "h2").distinct().join(reps.df.select("h1", "h2", "id"), ["h1", "h2"]).select("id", "row")
    met = regions.near_pairs(reps, _fraction(t), RARE, LARGE)
    sized = met.select(F.col("a").alias("ia"), F.col("b").alias("ib"), (F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("similarity"))
    return Near(members, cut(sized.where(F.col("similarity") >= t)).df)


def _fraction(t: float) -> tuple[int, int]:
    """`t` as a fraction of integers; beyond six decimals, the next one below."""
    whole = Fraction(str(t))
    if whole.denominator > FINEST:
        whole = Fraction(max(1, int(whole * FINEST)), FINEST)
    return whole.numerator, whole.denominator


def _row_pairs(near: Near, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of members of one class and of the classes of `pairs`."""
    ra, rb = near.members.select(F.col("id").alias("ia"), F.col("row").alias("ra")), near.members.select(F.col("id").alias("ib"), F.col("row").alias("rb"))
    across = pairs.join(ra, "ia").join(rb, "ib").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")
    same = ra.join(rb, F.col("ia") == F.col("ib")).where("ra < rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def similar_sets(sets: DataFrame, row: str = "row", words: str = "words", threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows whose word sets are similar enough, copies included."""
    near = near_classes(sets, row, words, threshold)
    return _row_pairs(near, near.pairs)


def closest(near: Near, k: int) -> DataFrame:
    """The k pairs of rows that are most similar; ties to the smaller rows.

    Only a class's k + 1 smallest rows can be in them, and only the k first pairs of classes, by their first rows. Both
    limits are taken before the shuffle, so a class that a third of all rows share is k + 1 rows of each partition.
    """
    order = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    few = near.members.withColumn("__n", order).where(F.col("__n") <= k + 1).drop("__n")
    first = near.pairs.orderBy(F.desc("similarity"), "ia", "ib").limit(k)  # a class is named by its smallest row
    return _row_pairs(Near(few, first), first).orderBy(F.desc("similarity"), "a", "b").limit(k)


def count_pairs(near: Near, labels: DataFrame) -> DataFrame:
    """One row (same, different): the pairs of rows with equal and with different labels (row, label), from the classes'
    sizes by label; rows without a label count in neither."""
    tally = near.members.join(labels.where("label is not null"), "row").groupBy("id", "label").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    held = cut(tally).df
    whole = held.groupBy("id").agg(F.sum("n").alias("n"))
    square = lambda: F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)"))
    a, b = (lambda df, x: df.withColumnRenamed("id", f"i{x}").withColumnRenamed("n", f"n{x}")), near.pairs.select("ia", "ib")
    product = F.sum((F.col("na") * F.col("nb")).cast("decimal(38,0)"))
    parts = [
        held.agg(square().alias("same"), F.lit(None).cast("decimal(38,0)").alias("all")),
        whole.agg(F.lit(None).cast("decimal(38,0)").alias("same"), square().alias("all")),
        b.join(a(held, "a"), "ia").join(a(held, "b"), ["ib", "label"]).agg(product.alias("same"), F.lit(None).cast("decimal(38,0)").alias("all")),
        b.join(a(whole, "a"), "ia").join(a(whole, "b"), "ib").agg(F.lit(None).cast("decimal(38,0)").alias("same"), product.alias("all")),
    ]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).agg(F.coalesce(F.sum("same"), F.lit(0)).alias("same"), F.coalesce(F.sum("all"), F.lit(0)).alias("all"))
    return total.select(F.col("same").cast("bigint").alias("same"), (F.col("all") - F.col("same")).cast("bigint").alias("different"))
