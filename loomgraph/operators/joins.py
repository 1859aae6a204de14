"""Joins over spans and names, each as an equi-join with a residual condition.

Spans are (key, start, end) with inclusive ends; nothing joins across keys, so every plan hashes on the key. Texts
never travel through these joins: join spans, attach content last.

Defined results: rows with a null key or bound match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut

#: Lots that rows are dealt into where all of them share one key.
LOTS = 64


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """`left` (with a unique column `row`) and, as `value`, the right row's last at or before `at`, else its first, else null.

    Rows of both sides are put in one order of key and place and each left row looks back to the last right row: linear,
    where a join on the key would pair all rows of a hot one. No key is sorted by one task: the order is cut into ranges,
    and what a range begins with comes from the ranges before it. Of equal starts the greater value is the later.
    """
    marks = right.select(F.col(key).alias("__k"), F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(left.schema["row"].dataType).alias("row")).where("__k is not null and __at is not null")
    asks = left.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), "row").where("__k is not null and __at is not null")
    line = ["__k", "__at", "__side", "__v", "row"]
    both = cut(marks.unionByName(asks).repartitionByRange(*line).withColumn("__p", F.spark_partition_id()))
    mark = F.when(F.col("__side") == 0, F.struct("__v"))
    back = Window.partitionBy("__k", "__p").orderBy(*line[1:]).rowsBetween(Window.unboundedPreceding, 0)
    own = both.df.withColumn("__seen", F.last(mark, ignorenulls=True).over(back)).where("__side = 1")
    ends = both.df.where("__side = 0").groupBy("__k", "__p").agg(F.max(F.struct("__at", "__v")).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__p")
    ranges = both.df.select("__k", "__p").distinct().join(ends, ["__k", "__p"], "left")
    carried = ranges.select("__k", "__p", F.last("__end", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    first = marks.groupBy("__k").agg(F.min_by("__v", F.struct("__at", "__v")).alias("__first"))
    found = own.join(carried, ["__k", "__p"]).select("__k", "row", F.coalesce("__seen", F.when(F.col("__carried").isNotNull(), F.struct(F.col("__carried.__v").alias("__v")))).alias("__x"))
    named = found.join(first, "__k", "left").select("row", F.when(F.col("__x").isNotNull(), F.col("__x.__v")).otherwise(F.col("__first")).alias(value))
    return left.join(named, "row", "left")


def containers(spans: DataFrame, key: str = "key", row: str = "row", start: str = "start", end: str = "end") -> DataFrame:
    """(row, container): for each span the smallest one that strictly contains it; ties to the earlier start, then row."""
    o = spans.select(F.col(key).alias("__k"), F.col(row).alias("__r"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__s") <= F.col(start)) & (F.col(end) <= F.col("__e")) & ~((F.col("__s") == F.col(start)) & (F.col("__e") == F.col(end)))
    pairs = spans.join(o, inside)
    return pairs.groupBy(row).agg(F.min_by("__r", F.struct(F.col("__e") - F.col("__s"), "__s", "__r")).alias("container"))


def top_level(spans: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """The spans that no other strictly contains."""
    o = spans.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__s") <= F.col(start)) & (F.col(end) <= F.col("__e")) & ~((F.col("__s") == F.col(start)) & (F.col("__e") == F.col(end)))
    return spans.join(o, inside, "left_anti")


def direct_children(spans: DataFrame, parents: DataFrame, key: str = "key", row: str = "row", start: str = "start", end: str = "end") -> DataFrame:
    """(parent, child): spans strictly within a parent and not within another such span of the same parent."""
    p = parents.select(F.col(key).alias("__k"), F.col(row).alias("parent"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__s") <= F.col(start)) & (F.col(end) <= F.col("__e")) & ~((F.col("__s") == F.col(start)) & (F.col("__e") == F.col(end)))
    held = spans.join(p, inside).select("parent", F.col(row).alias("child"), F.col(start).alias("s"), F.col(end).alias("e"))
    o = held.select(F.col("parent").alias("__p"), F.col("s").alias("__s2"), F.col("e").alias("__e2"))
    nested = (F.col("parent") == F.col("__p")) & (F.col("__s2") <= F.col("s")) & (F.col("e") <= F.col("__e2")) & ~((F.col("__s2") == F.col("s")) & (F.col("__e2") == F.col("e")))
    return held.join(o, nested, "left_anti").select("parent", "child")


def overlap(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, how: str = "inner") -> DataFrame:
    """Pairs (or, with how='left_semi' or 'left_anti', left rows) of the same key whose spans overlap."""
    r = right.withColumnRenamed(key, "__k")
    joined = left.join(r, (F.col(key) == F.col("__k")) & (F.col(l_start) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_start)), how)
    return joined.drop("__k")


def contains_link(targets: DataFrame, names: DataFrame, target: str, name: str) -> DataFrame:
    """Pairs in which the target text contains the name; an empty name is in every target.

    A target that contains a name contains each three characters in a row of it, so both are joined on that of the name's
    which the fewest targets have: an equi-join, then an exact look. A name of one or two characters is looked up among
    the targets' ones and twos in the same way. An empty name's pairs are all targets: an output, not a search.
    """
    n = F.length(name)
    grams = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k))))
    texts = targets.select(F.col(target).alias("__t")).distinct().where("__t is not null")
    spelled = texts.select("__t", F.explode(F.flatten(F.array(*(F.when(F.length("__t") >= k, grams(F.col("__t"), k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3))))).alias("__g"))
    held = cut(spelled)
    often = held.df.groupBy("__g").agg(F.count("*").alias("__n"))
    wanted = names.select(F.col(name).alias("__name")).distinct().where("__name <> ''")
    size = F.length("__name")
    own = F.when(size >= 3, grams(F.col("__name"), 3)).otherwise(F.array("__name"))
    rarest = wanted.select("__name", F.explode(own).alias("__g")).join(often, "__g", "left").groupBy("__name").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__g")).alias("x")).where("x.n > 0").select("__name", F.col("x.__g").alias("__g"))
    pairs = rarest.join(held.df, "__g").where(F.contains("__t", "__name")).select("__t", "__name")
    far = targets.join(pairs, F.col(target) == F.col("__t")).drop("__t").join(names, F.col("__name") == F.col(name)).drop("__name")
    # What is in every target meets the targets by lots, so no lot is one task's all.
    lots = F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))
    blank = targets.where(F.col(target).isNotNull()).withColumn("__lot", F.pmod(F.xxhash64(*targets.columns), F.lit(LOTS)).cast("int")).join(names.where(n == 0).withColumn("__lot", lots), "__lot").drop("__lot")
    return far.unionByName(blank.select(*far.columns))


def longest_prefix(left: DataFrame, table: DataFrame, row: str, parts: str, prefix: str, value: str, joined: str = "/") -> DataFrame:
    """(row, value) of the table's longest prefix of each row's segments: all prefixes exploded, one equi-join, argmax.

    Ties (one prefix with several values) go to the smaller value.
    """
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(parts, F.lit(1), k), joined).alias("p")))
    wide = left.where(n > 0).select(row, F.explode(prefixes).alias("x")).select(row, "x.n", "x.p")
    hits = wide.join(table.select(F.col(prefix).alias("p"), F.col(value)), "p")
    return hits.groupBy(row).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def unique_suffix(left: DataFrame, table: DataFrame, row: str, parts: str, suffix: str, value: str, joined: str = "/") -> DataFrame:
    """(row, value) for rows whose segments end in entries of the table that agree on one value."""
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), joined))
    wide = left.where(n > 0).select(row, F.explode(suffixes).alias("p"))
    hits = wide.join(table.select(F.col(suffix).alias("p"), F.col(value)), "p")
    return hits.groupBy(row).agg(F.min(value).alias(value), F.max(value).alias("__m")).where(F.col(value) == F.col("__m")).drop("__m")
