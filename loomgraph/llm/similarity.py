"""Near-duplicate texts: classes of equal word sets, joined through the regions of operators/regions.py.

Equal sets are made one class first, so copies are never joined with each other.

Defined results: an empty word set is similar to nothing and in no class; a key delivered twice with the same text is
one row; words are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Cut, cut
from ..operators import regions

#: The threshold as a fraction of integers, so that all bounds are exact.
THRESHOLD = (4, 5)
#: Regions expected to hold more sets than this are divided.
REGION = 128
#: Regions measured to hold more than this are divided whatever was expected.
LARGE = 1024
#: Classes of equal sets with more rows than this are linked through their representative instead of pair by pair.
EXPANDED = 5000


def words(text: Column, least: int = 3) -> Column:
    """Sorted 64-bit hashes of the distinct runs of letters and digits of at least `least` code points, lower-cased."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{%d,})" % least), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def classes(rows: DataFrame, key: str, text: Column) -> tuple[Cut, Cut]:
    """(members (key, h1, h2), representatives (id, h1, h2, many, rows, words)) of the rows with a non-empty word set."""
    sets = rows.select(F.col(key).alias("key"), words(text).alias("words")).where(F.size("words") > 0)
    held = cut(sets.select("key", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.col("words")).alias("h2"), "words"))
    reps = held.df.groupBy("h1", "h2").agg(F.min("key").alias("id"), F.max("key").alias("__last"), F.count("*").alias("rows"), F.first("words").alias("words"))
    return held, cut(reps.select("id", "h1", "h2", (F.col("id") < F.col("__last")).alias("many"), "rows", "words"))


def near_pairs(reps: Cut) -> DataFrame:
    """(a, b, overlap, n_a, n_b) of the representatives' pairs (a < b) that are similar enough, each once."""
    return regions.near_pairs(reps, THRESHOLD, REGION, LARGE)


def similar_pairs(rows: DataFrame, key: str, text: Column, expanded: int = EXPANDED) -> DataFrame:
    """(a, b), a < b: all pairs of keys whose word sets are similar enough, copies included.

    A class of more than `expanded` rows of equal sets, whose pairs among themselves would be the square of that, is
    given by its membership: each member paired with the representative (the smallest key), and pairs between the
    representative and what is near it. No link between different sets is lost.
    """
    held, reps = classes(rows, key, text)
    pairs = cut(near_pairs(reps).select("a", "b"))
    many = reps.df.where("many").select("h1", "h2", "id", (F.col("rows") > expanded).alias("huge"))
    own = cut(held.df.select("key", "h1", "h2").join(many, ["h1", "h2"]).select("id", "huge", "key").distinct())
    listed = own.df.where("not huge")
    left = listed.select(F.col("id").alias("a"), F.col("key").alias("ka"))
    right = listed.select(F.col("id").alias("b"), F.col("key").alias("kb"))
    across = pairs.df.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"))
    within = listed.alias("l").join(listed.alias("r"), F.expr("l.id = r.id and l.key < r.key")).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))
    members = own.df.where("huge and key > id").select(F.col("id").alias("a"), F.col("key").alias("b"))
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within).unionByName(members)


def class_links(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, class_id, n_links): each key with its class of equal word sets and the number of other classes near it."""
    held, reps = classes(rows, key, text)
    pairs = near_pairs(reps)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    linked = reps.df.select("id", "h1", "h2").join(ends, "id", "left")
    keys = held.df.select("key", "h1", "h2").distinct()
    return keys.join(linked, ["h1", "h2"]).select(F.col("key").alias(key), F.col("id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
