"""Joins and aggregations over keys of which a few hold most rows.

heavy_keys() finds a superset of the keys above a share of the rows with a frequent-item sketch (bounded: fewer than
2 / share items, whatever the data) and counts only those exactly. skew_join() sends the rows of heavy keys through a
broadcast join with the few matching rows of the other side and all other rows through an ordinary shuffle, then unions
the two. per_key() gives per-key results: sums and maxima combine before the shuffle whatever the key; distinct values of heavy
keys are spread by key and value first, those of other keys are counted in an ordinary aggregation.

Defined results: a null key is a key of its own in heavy_keys() and per_key() and matches nothing in skew_join().
Empty input gives empty output with the same schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """(field, key_value, n_rows): values of each column on more than `share` of all rows of `df`.

    Two passes, both combined before their shuffles: the sketch, which misses no value above the share, then exact
    counts of the sketched candidates. The sketches of all columns come from one scan.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    candidates = candidate_keys(texts, columns, share)
    total = texts.count()
    wanted = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("key_value"))
    kept = texts.select(F.explode(F.array(*(F.when(_is_in(F.col(c), candidates[c]), wanted(c)) for c in columns))).alias("x")).where("x is not null")
    counts = kept.groupBy("x").agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") > F.lit(share) * F.lit(total)).select("x.field", "x.key_value", "n_rows")


def candidate_keys(df: DataFrame, columns: Sequence[str], share: float) -> dict[str, list[str | None]]:
    """For each column a list of at most 2 / share values that holds every value on more than `share` of the rows.

    The sketch is a count of frequent items with decrements, kept for each partition and merged; half the share is
    asked for, so merging leaves a margin.
    """
    null, marked = "\x00", [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("\x00")).alias(c) for c in columns]
    row = df.select(*marked).stat.freqItems(list(columns), share / 2).collect()[0]
    return {c: [None if v == null else v[1:] for v in row[f"{c}_freqItems"]] for c in columns}


def _is_in(key: Column, values: Sequence[str | None]) -> Column:
    known = [v for v in values if v is not None]
    test = F.coalesce(key.isin(known), F.lit(False)) if known else F.lit(False)
    return test | key.isNull() if None in values else test


def skew_join(big: DataFrame, small: DataFrame, key: str, share: float = 0.01, how: str = "left", rows_per_key: int = 1000) -> DataFrame:
    """`big` joined with `small` on `key`; heavy keys of `big` by broadcast join, the rest by shuffle, then union.

    The broadcast part of `small` holds only rows of heavy keys: at most (2 / share) x `rows_per_key` rows, which is
    checked; if a heavy key has more rows than that in `small`, its rows go through the shuffle join as well.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    heavy = [v for v in candidate_keys(big.select(F.col(key).cast("string").alias(key)), [key], share)[key] if v is not None]
    test = lambda df: _is_in(df[key].cast("string"), heavy)
    fits = {r[0] for r in small.where(test(small)).groupBy(F.col(key).cast("string")).count().where(F.col("count") <= rows_per_key).collect()}
    absent = set(heavy) - {r[0] for r in small.where(test(small)).select(F.col(key).cast("string")).distinct().collect()}
    heavy = sorted(fits | absent)
    if not heavy:
        return big.join(small, key, how)
    hot = big.where(test(big)).join(F.broadcast(small.where(test(small))), key, how)
    cold = big.where(~test(big)).join(small.where(~test(small)), key, how)
    return hot.unionByName(cold)


def per_key(df: DataFrame, key: str, sums: dict[str, Column], maxima: dict[str, Column], distinct: dict[str, str] | None = None, share: float = 0.01) -> DataFrame:
    """(key, n_rows, sums..., maxima..., distinct counts..., heavy) for each value of `key`.

    Sums and maxima combine before any shuffle whatever the key. Distinct counts don't: a heavy key's values would all
    meet in one task. So the rows of heavy keys are first made distinct by (key, value), spread by both, and counted
    then; other keys take the ordinary way. `distinct` names result columns by source columns, whose nulls don't count.
    """
    heavy = candidate_keys(df.select(F.col(key).cast("string").alias(key)), [key], share)[key]
    is_heavy = _is_in(F.col(key).cast("string"), heavy)
    plain = df.groupBy(key).agg(F.count("*").alias("n_rows"), *(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in maxima.items()))
    parts = [plain.withColumn("heavy", is_heavy)]
    for name, column in (distinct or {}).items():
        pairs = df.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
        hot = pairs.where(_is_in(F.col("__k").cast("string"), heavy)).distinct().groupBy("__k").agg(F.count("__v").alias(name))
        cold = pairs.where(~_is_in(F.col("__k").cast("string"), heavy)).groupBy("__k").agg(F.count_distinct("__v").alias(name))
        parts.append(hot.unionByName(cold))
    joined = reduce(lambda a, b: a.join(b, a[key].eqNullSafe(b["__k"]), "left").drop("__k"), parts)
    return joined
