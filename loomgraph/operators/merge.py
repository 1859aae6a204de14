"""Precedence merges, first-wins de-duplication, unions of lists and greedy naming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def best_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in `order`, which must be total. An aggregate, combined before the shuffle: no
    window, so a key that a third of all rows share sorts nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, *(F.col(f"__x.`{c}`").alias(c) for c in rest))


def merge_facts(layers: Sequence[DataFrame]) -> DataFrame:
    """Facts of several layers, one for each id: certainty 'proved' before other origins before the parser's own; of
    equal rank the first of the first layer. Each layer has a column `pos`, its rows' order."""
    tagged = [f.withColumn("__layer", F.lit(k)) for k, f in enumerate(layers)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f)
    return best_per_key(union, "id", [-fact_rank(F.col("certainty"), F.col("origin")), F.col("__layer"), F.col("pos")]).drop("__layer", "pos")


def fact_rank(certainty: Column, origin: Column) -> Column:
    return F.when(certainty == "proved", 3).when(origin != "tree-sitter", 2).otherwise(1)


def merge_by_requirement(rules: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rules of a group with the same requirement made one: the first rule's fields, all rules' distinct citations.

    The citations are made distinct before they are collected, so repeats of one rule cost nothing.
    """
    keys = [*group, "requirement"]
    first = best_per_key(rules, keys, order).drop("citations")
    cited = rules.select(*keys, F.explode("citations").alias("c")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("citations"))
    joined = first
    on = [first[k].eqNullSafe(cited[k]) for k in keys]
    return joined.join(cited, on, "left").select(*(first[c] for c in first.columns), cited["citations"])


def name_uniquely(df: DataFrame, group: Sequence[str], name: str, order: Sequence[str], out: str = "unique_name") -> DataFrame:
    """`df` with names made unique within a group, in order: a taken name gets the first free number from 2 on.

    Greedy and order-dependent: a, a, a-2 gives a, a-2, a-2-2. Only names of one family (equal without trailing
    numbers) can collide, so families are worked apart: rows are hashed and sorted by family and streamed past a
    set of the names one family has taken. No group is collected.
    """
    family = F.regexp_replace(name, r"(-\d+)+$", "")
    keyed = df.withColumn("__family", family)
    keys = [*group, "__family"]
    placed = keyed.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = StructType([*df.schema.fields, StructField(out, StringType())])
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken, following = None, set(), {}
        for f in frames:
            got = []
            for key, n in zip(zip(*(f[k] for k in keys)), f[name]):
                if key != current:
                    current, taken, following = key, set(), {}
                free = n
                if n in taken:
                    k = following.get(n, 2)
                    while (free := f"{n}-{k}") in taken:
                        k += 1
                    following[n] = k + 1
                taken.add(free)
                got.append(free)
            f = f[columns].copy()
            f[out] = got
            yield f

    return placed.mapInPandas(run, fields)


def replace_kind(facts: DataFrame, kind: str, replacement: DataFrame) -> DataFrame:
    """All facts of a kind replaced by other ones, if there are any."""
    some = replacement.limit(1).count() > 0
    return facts.where(F.col("kind") != kind).unionByName(replacement) if some else facts
