"""Exact Jaccard join of word sets: pivots, regions, triangle-inequality windows, recursion.

Sets lie in the metric space of the symmetric difference, where a Jaccard similarity of t or more between sets of n and
m words is a distance of at most (n + m) (1 - t) / (1 + t).

* Pivots are single words, ordered by how rare they are over the whole collection; a set's home region is that of its
  first word, its nearest pivot. By the triangle inequality a set within the distance can miss only so many of
  another's first words, so a set is replicated to the regions of as many further words as that window holds (a few:
  the skip budget), and each near pair meets in the region of its first common word.
* A region whose expected size is above a bound is divided by the next pivots in the same way, its sets replicated to
  the windows that the misses so far leave, until regions are small. Whether a region is divided depends on its words'
  frequencies alone, so both sets of a pair decide alike and no pair is lost whatever the estimate is worth. Words that
  occur together make regions larger than expected; those that are counted to be above another bound are divided as well.
* Within a region sets are joined under their windows and under the distances to 128 more pivots (disjoint word
  groups, one bit each): by the triangle inequality the bits that differ can't outnumber the distance.
* What is left is checked exactly on the full word sets.

Document pivots in Jaccard space, the usual choice, can't prune here: nearly all distances between unrelated texts lie
within the window's width of each other, so nearly every text is replicated to every region (figures in the README).

Defined results: sets are distinct by id and compared by their words' 64-bit hashes; an empty set is similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Cut

#: Replicas that one task joins, some 40 bytes each.
REPLICAS = 150_000
#: Words on more than one of so many sets are listed with their frequency (at most so many times the mean set size).
LISTED = 2000


def regions(sizes: np.ndarray, flat: np.ndarray, listed: np.ndarray, frequency: np.ndarray, total: int, depth: int, threshold: tuple[int, int], region: float, large: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of the set, region, misses) for every region that a batch of sets goes to; see the module.

    `flat` holds the sets' words one after the other, `sizes` their numbers of words; `listed` is sorted. `large`, sorted,
    has the regions that are divided whatever their expected size and depth.
    """
    p, q = threshold
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    at = np.minimum(np.searchsorted(listed, flat), max(0, len(listed) - 1))
    known = listed[at] == flat if len(listed) else np.zeros(len(flat), dtype=bool)
    often = np.where(known, frequency[at] if len(listed) else 0, 0)
    order = np.lexsort((flat, often, owner))
    flat, often = flat[order].view(np.uint64), often[order]
    part = np.where(often > 0, often, max(1, total // LISTED)) / max(1, total)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    smallest = -(-sizes * p // q)  # of a similar set
    budget = sizes - -(-(sizes + smallest) * p // (p + q))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who, last, miss = np.arange(n), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    name, expected = np.zeros(n, dtype=np.uint64), np.full(n, float(total))
    level = 0
    with np.errstate(over="ignore"):
        while len(who):
            done = (expected <= region) | (level >= depth) if level else np.zeros(len(who), dtype=bool)
            if len(large) and level:
                done &= large[np.minimum(np.searchsorted(large, name), len(large) - 1)] != name
            out.append((who[done], name[done], miss[done]))
            go = ~done
            who, last, miss, name, expected = who[go], last[go], miss[go], name[go], expected[go]
            if level:  # a similar pair may share no further word
                end = smallest[who] <= level
                out.append((who[end], name[end] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), miss[end]))
            choices = np.minimum(budget[who] - miss + 1, sizes[who] - last - 1)
            choices = np.maximum(choices, 0)
            pick = np.repeat(np.arange(len(who)), choices)
            skip = np.arange(len(pick)) - np.repeat(np.cumsum(choices) - choices, choices)
            who, last, miss = who[pick], last[pick] + 1 + skip, miss[pick] + skip
            word = begin[who] + last
            name = (name[pick] ^ flat[word]) * np.uint64(0xBF58476D1CE4E5B9)
            name ^= name >> np.uint64(29)
            expected = expected[pick] * part[word]
            level += 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (who, name, miss)


def near_pairs(reps: Cut, threshold: tuple[int, int], region: float, large: int) -> DataFrame:
    """(a, b, overlap, n_a, n_b) of the pairs (a < b) of sets (id, words) with a Jaccard similarity of
    at least p / q = `threshold`, each once. `words` are distinct hashes; regions expected to hold more than `region` or
    counted to hold more than `large` are divided."""
    spark = reps.spark
    p, q = threshold
    total = reps.rows
    floor = max(1, total // LISTED)
    counts = reps.df.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") > floor)
    top = counts.toArrow()  # bounded: at most LISTED x mean set size rows
    listed, often = top.column("w").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(listed)
    table = spark.sparkContext.broadcast((listed[order], often[order]))
    depth = 1
    while total > region * 32**depth:
        depth += 1

    kind = reps.df.schema["id"].dataType.simpleString()

    def regions_of(batches: Iterator[pa.RecordBatch], divided: np.ndarray, rows: int) -> Iterator[tuple]:
        heavy, frequency = table.value
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                ids, lists = b.slice(lo, rows).columns
                flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield ids, flat, sizes, *regions(sizes, flat, heavy, frequency, total, depth, threshold, region, divided)

    def counted(divided: np.ndarray) -> DataFrame:
        names = spark.sparkContext.broadcast(divided)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *_, name, _ in regions_of(batches, names.value, 10_000):
                each, times = np.unique(name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *each.view(np.int64).tolist()], pa.int64()), pa.array([len(name), *times.tolist()])], ["region", "n"])

        return reps.df.select("id", "words").mapInArrow(run, "region bigint, n bigint").groupBy("region").agg(F.sum("n").alias("n"))

    def placed(divided: np.ndarray) -> DataFrame:
        names = spark.sparkContext.broadcast(divided)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, flat, sizes, who, name, miss in regions_of(batches, names.value, 2000):
                bit = (flat.view(np.uint64) >> np.uint64(57)).astype(np.int64)  # one of 128 pivots
                seen = np.zeros((len(sizes), 128), dtype=bool)
                seen[np.repeat(np.arange(len(sizes)), sizes), bit] = True
                bits = np.packbits(seen, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), ids.take(pa.array(who)), pa.array(sizes[who].astype(np.int32)), pa.array(miss.astype(np.int32)), pa.array(bits[who, 0]), pa.array(bits[who, 1])],
                    ["region", "id", "n", "miss", "bits0", "bits1"],
                )

        return reps.df.select("id", "words").mapInArrow(run, f"region bigint, id {kind}, n int, miss int, bits0 bigint, bits1 bigint")

    # Words that occur together make regions larger than expected: those measured to be are divided, until none is left
    # or none divides further. There are at most 1 / large as many as replicas.
    divided = np.zeros(0, dtype=np.uint64)
    while True:
        got = counted(divided).where(F.col("region").isNull() | (F.col("n") > large)).collect()
        replicas = sum(r.n for r in got if r.region is None)
        found = np.setdiff1d(np.array([r.region for r in got if r.region is not None], dtype=np.int64).view(np.uint64), divided)
        if not len(found):
            break
        divided = np.union1d(divided, found)
    # No region is large now, so partitions of equal numbers of replicas are even, however many there are.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-replicas // REPLICAS))
    met_in = placed(divided).repartition(partitions, "region")
    x, y = met_in.alias("x"), met_in.alias("y")  # the same exchange, read twice
    need = f"cast(ceil((x.n + y.n) * {p}L / {p + q}D - 1e-9) as int)"
    met = x.join(
        y,
        F.expr(
            f"x.region = y.region and (x.n > y.n or x.n = y.n and x.id > y.id) and x.n * {p}L <= y.n * {q}L"
            f" and x.n - x.miss >= {need} and y.n - y.miss >= {need}"
            f" and bit_count(x.bits0 ^ y.bits0) + bit_count(x.bits1 ^ y.bits1) <= x.n + y.n - 2 * {need}"
        ),
    )
    candidates = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    sets = reps.df.select("id", "words")
    full = candidates.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    sized = full.select("a", "b", F.size("wa").alias("n_a"), F.size("wb").alias("n_b"), F.size(F.array_intersect("wa", "wb")).alias("overlap"))
    return sized.where(F.col("overlap").cast("bigint") * (p + q) >= (F.col("n_a") + F.col("n_b")).cast("bigint") * p).select("a", "b", "overlap", "n_a", "n_b")
