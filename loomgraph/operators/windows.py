"""Sequential computations in their relational form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut


def line_windows(n: Column, size: int = 250, overlap: int = 20) -> Column:
    """Array of (start, end) windows over n lines: `size` lines, consecutive ones sharing `overlap`, the last ending at n."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(size - overlap))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, n).alias("end")))
    return F.when(n > 0, spans).otherwise(F.slice(spans, 1, 0))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """`df` with its rows numbered from 1 within each group, in an order that must be total.

    No group is sorted by one task: rows are range-partitioned by group and order, counted by group and partition, and
    numbered within a partition on top of what the partitions before it hold of the group. Null groups are groups.
    """
    placed = cut(df.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    counts = placed.df.groupBy(*group, "__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__p").alias("__q"), F.coalesce(before, F.lit(0)).alias("__b"))
    own = placed.df.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__p").orderBy(*order)))
    on = own["__p"] == first["__q"]
    for k, g in enumerate(group):
        on = on & own[g].eqNullSafe(first[f"__g{k}"])
    return own.join(first, on).select(*(own[c] for c in df.columns), (F.col("__n") + F.col("__b")).cast("bigint").alias(out))


def batches(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int, out: str = "batch") -> DataFrame:
    """Consecutive slices of `size` rows of each group, numbered from 0."""
    return numbered(df, group, order, "__k").withColumn(out, F.floor((F.col("__k") - 1) / size).cast("bigint")).drop("__k")


def last_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each group; `order` must be descending and total. The rank limit is pushed below the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """The first `budget` rows of each group, in order."""
    return last_n(df, group, [F.col(c) for c in order], budget)


def top_with_rest(df: DataFrame, name: str, count: str, n: int = 7, more: str = "more") -> DataFrame:
    """The n largest rows and one that sums up how many others there are and what they count."""
    top = df.orderBy(F.desc(count), name).limit(n)
    totals = df.agg(F.count("*").alias("rows"), F.sum(count).alias("all"))
    shown = top.agg(F.count("*").alias("shown"), F.sum(count).alias("part"))
    rest = totals.crossJoin(shown).where("rows > shown").select(F.concat(F.lit(f"{more} "), (F.col("rows") - F.col("shown")).cast("string")).alias(name), (F.col("all") - F.col("part")).alias(count))
    return top.select(name, count).unionByName(rest)
