"""Filling fixed-capacity containers by pattern packing.

A histogram of lengths (at most `capacity` rows, whatever the corpus) goes to the driver. Patterns of a few lengths
that fill a container are enumerated; how often each is repeated is fitted to the histogram by non-negative least
squares; the fit is rounded down to what the histogram holds, and the rest is packed largest first, whole templates at a
time. The plan that results has a bounded size, too. Rows are numbered within their length (in salted buckets, so a
length that a third of all rows share is no one task's work) and look their container up in the plan.

Defined results: null and empty texts (0 tokens) need no room and get container_id null, piece_no 0. A text above the
capacity is cut into full pieces and a rest; every full piece fills a container of its own. No other text is cut.
Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import cut
from . import bpe

CAPACITY = 2048
#: Rows numbered by one task at most, on average.
BUCKET_ROWS = 200_000
#: Most patterns that are enumerated; a constant of the fit, not of the data.
PATTERNS = 6000


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = PATTERNS) -> list[dict[int, int]]:
    """Patterns of two to four lengths that fill a container as far as any held length allows.

    For each first length, the second runs over a spread of the held lengths, weighted to frequent ones; the third and
    fourth are the largest that fit into what is left.
    """
    held = set(lengths.tolist())
    fit = np.zeros(capacity + 1, dtype=np.int64)  # the largest held length that is no longer than the index
    for x in lengths:
        fit[x] = x
    fit = np.maximum.accumulate(fit)
    spread = max(1, most // max(1, len(lengths)))
    seen: set[tuple[int, ...]] = set()
    order = lengths[np.argsort(-counts, kind="stable")]
    for first in lengths[::-1].tolist():
        room = capacity - first
        seconds = [int(fit[room]), *(x for x in order[: 4 * spread].tolist() if x <= room)][: spread + 1]
        for second in seconds:
            if second <= 0:
                continue
            pattern, left = [first, second], room - second
            while len(pattern) < 4 and left > 0 and (x := int(fit[left])) > 0:
                pattern.append(x)
                left -= x
            seen.add(tuple(sorted(pattern)))
    patterns = []
    for p in sorted(seen, key=lambda p: (-sum(p), p))[:most]:
        assert set(p) <= held
        patterns.append({x: p.count(x) for x in set(p)})
    return patterns


def fit_repeats(patterns: list[dict[int, int]], lengths: np.ndarray, counts: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeats r >= 0 with sum_j r_j pattern_j near the histogram."""
    row = {int(x): k for k, x in enumerate(lengths)}
    left = counts.astype(float).copy()
    columns = [([row[x] for x in p], np.array([float(n) for n in p.values()])) for p in patterns]
    repeats = np.zeros(len(patterns))
    scale = [float(v @ v) for _, v in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, v) in enumerate(columns):
            new = max(0.0, repeats[j] + float(v @ left[rows]) / scale[j])
            if (d := new - repeats[j]) != 0.0:
                left[rows] -= d * v
                repeats[j] = new
                moved += abs(d)
        if moved < 1e-3 * max(1.0, counts.sum()):
            break
    return repeats


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(template {length: how many}, repeats) that together hold exactly the histogram. Lengths are 1..capacity."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    left = {int(x): int(n) for x, n in zip(lengths, counts)}
    out: list[tuple[dict[int, int], int]] = []

    def use(template: dict[int, int], times: int) -> None:
        out.append((template, times))
        for x, n in template.items():
            left[x] -= n * times

    patterns = [p for p in enumerate_patterns(lengths, counts, capacity) if sum(x * n for x, n in p.items()) >= capacity - capacity // 256]
    if patterns:
        for p, r in zip(patterns, fit_repeats(patterns, lengths, counts)):
            times = min(int(r), *(left[x] // n for x, n in p.items()))
            if times > 0:
                use(p, times)
    # The rest: one template after the other, largest lengths first, repeated as often as all its lengths last.
    while any(left.values()):
        held = np.array(sorted(x for x, n in left.items() if n), dtype=np.int64)
        template: dict[int, int] = {}
        room = capacity
        while room > 0:
            k = int(np.searchsorted(held, room, side="right")) - 1
            while k >= 0 and template.get(int(held[k]), 0) >= left[int(held[k])]:
                k -= 1
            if k < 0:
                break
            x = int(held[k])
            n = min(room // x, left[x] - template.get(x, 0))
            template[x] = template.get(x, 0) + n
            room -= n * x
        use(template, min(left[x] // n for x, n in template.items()))
    return out


def slots(templates: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where each template's run of its rows begins, the template's first container, rows a container."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for template, times in templates:
        for x, n in template.items():
            by.setdefault(x, []).append((used.get(x, 0), container, n))
            used[x] = used.get(x, 0) + n * times
        container += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for x, rows in by.items()}


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no, n_tokens, container_id) for rows (key, size >= 0); see the module for defined results."""
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    pieces = sizes.select(F.col(key), F.col(size).cast("long").alias("n")).select(
        key,
        F.explode(
            F.when(F.col("n") <= capacity, F.array(F.struct(F.lit(0).alias("piece_no"), F.col("n").cast("int").alias("n_tokens")))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")),
                    lambda i: F.struct(i.alias("piece_no"), F.least(F.lit(capacity).cast("long"), F.col("n") - i * F.lit(capacity).cast("long")).cast("int").alias("n_tokens")),
                )
            )
        ).alias("p"),
    ).select(key, "p.*")
    held = cut(pieces)
    buckets = max(1, -(-held.rows // BUCKET_ROWS)) * 8
    salted = held.df.withColumn("__b", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)).cast("int"))
    counts = salted.where("n_tokens > 0").groupBy("n_tokens", "__b").agg(F.count("*").alias("c"))
    # Where a bucket's rows of a length begin among all rows of that length. Rows: at most capacity x buckets.
    before = cut(counts.withColumn("first", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["first"]))
    histogram = {r["n_tokens"]: r["c"] for r in before.df.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "__b").orderBy(key, "piece_no")) - 1
    numbered = salted.withColumn("rank", rank).join(before.df.select("n_tokens", "__b", "first"), ["n_tokens", "__b"], "left").select(key, "piece_no", "n_tokens", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value
        for b in batches:
            n, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            container = np.full(len(n), -1, dtype=np.int64)
            for x in np.unique(n):
                if x > 0:
                    starts, base, each = of[int(x)]
                    at = np.flatnonzero(n == x)
                    r = rank[at].astype(np.int64)
                    k = np.searchsorted(starts, r, side="right") - 1
                    container[at] = base[k] + (r - starts[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container, mask=container < 0)], [key, "piece_no", "n_tokens", "container_id"])

    return numbered.mapInArrow(place, f"`{key}` {kind}, piece_no int, n_tokens int, container_id bigint")


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """pack() of the texts' lengths in tokens."""
    return pack(bpe.count_column(docs, key, text, folder), key, "n_tokens", capacity)
