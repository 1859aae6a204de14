"""Cutting oversized items at natural boundaries.

A text's lines and words are laid out as offset prefix sums. Cuts are looked for by binary search in sorted boundary
arrays: the last strong boundary (a blank line, or a line that closes a block at the margin) under the limit if that
keeps the piece at least half full, else the last line end, else the last gap between words, else a hard cut at the
limit. The next piece steps back by the overlap in whole lines, as long as that leaves it room to go forward.

Defined results: null text gives no piece; a text within the limit is one piece; start_line null counts as 1; a piece
within one long line starts and ends on that line and overlaps nothing; CR LF counts as a line end of one LF.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 8000
OVERLAP = 10
_STRONG = re.compile(r"[ \t\r]*\n|[})\]][^\n]*\n")
_GAP = re.compile(r"(?<=[\s;,{})\]])(?=\S)")


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[begin, end) of each piece, in order. Together the pieces cover the text; none is longer than `limit`."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    lines = [0, *(m.end() for m in re.finditer("\n", text) if m.end() < n)]
    strong = [e for b, e in zip(lines, lines[1:]) if _STRONG.fullmatch(text, b, e)]
    gaps: list[int] | None = None
    pieces, begin, reached = [], 0, 0
    while True:
        most = begin + limit
        if most >= n:
            pieces.append((begin, n))
            return pieces
        floor = max(reached + 1, begin + limit // 2)
        k = bisect_right(strong, most) - 1
        end = strong[k] if k >= 0 and strong[k] >= floor else 0
        if not end:
            k = bisect_right(lines, most) - 1
            end = lines[k] if lines[k] > reached else 0
        if not end:
            if gaps is None:
                gaps = [m.start() for m in _GAP.finditer(text)]
            k = bisect_right(gaps, most) - 1
            end = gaps[k] if k >= 0 and gaps[k] >= floor else most
        pieces.append((begin, end))
        later = bisect_right(lines, begin)
        reached, begin = end, end
        k = bisect_left(lines, end)
        if k < len(lines) and lines[k] == end:  # on a line end: step back by whole lines that leave room for the next line
            after = lines[k + 1] if k + 1 < len(lines) else n
            back = bisect_left(lines, after - limit)
            begin = lines[min(k, max(back, k - overlap, later))]


def split(items: DataFrame, key: str = "id", text: str = "content", start: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_line, end_line, overlap_lines, content) of every row of `items`; one narrow stage."""
    kind = items.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t, s in zip(f["k"], f["t"], f["s"]):
                if t is None:
                    continue
                at, line, reached = 0, int(s), int(s) - 1
                for no, (b, e) in enumerate(cut_points(t, limit, overlap)):
                    line += t.count("\n", at, b) if b >= at else -t.count("\n", b, at)
                    at = b
                    last = line + t.count("\n", b, max(b, e - 1))
                    rows.append((k, no, line, last, max(0, reached - line + 1) if b == 0 or t[b - 1] == "\n" else 0, t[b:e]))
                    reached = last
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start_line", "end_line", "overlap_lines", "content"])

    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(start), F.lit(1)).alias("s"))
    return rows.mapInPandas(run, f"`{key}` {kind}, piece_no int, start_line int, end_line int, overlap_lines int, content string")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, content, start_line) of each distinct chunk above the limit, with its true first line.

    Lines are only wrong in files of one chunk, whose text begins on line 1. The test for one chunk moves no content.
    """
    big = chunks.where(F.length("content") > limit).select("id", "file_id", "content", "start_line").groupBy("id").agg(F.min_by(F.struct("file_id", "content", "start_line"), F.struct(F.col("start_line").isNull(), "start_line")).alias("x")).select("id", "x.*")
    files = big.select("file_id").distinct()
    alone = chunks.select("file_id", "id").join(files, "file_id", "left_semi").groupBy("file_id").agg((F.min("id") == F.max("id")).alias("alone"))
    return big.join(alone, "file_id", "left").select("id", "content", F.when(F.coalesce("alone", F.lit(True)), 1).otherwise(F.coalesce("start_line", F.lit(1))).alias("start_line"))
