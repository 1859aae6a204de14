"""Facts and chunks from parsed files: facts by joins of spans, chunks within each file's row."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import joins, windows

MAX_LINES, WINDOW, OVERLAP = 300, 250, 20


def explode_parts(parsed: DataFrame, part: str) -> DataFrame:
    """One row for each definition, import or module, with its order in the file."""
    return parsed.select("path", "language", F.posexplode(part).alias("pos", "x")).select("path", "language", "pos", "x.*")


def _lines(start: str = "start_line", end: str = "end_line") -> Column:
    return F.concat(F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def _fact(df: DataFrame, kind: str, key: Column, attrs: dict[str, Column]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in attrs.items()))
    some = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"] != "", F.lit(False))))
    return df.select(F.lit(kind).alias("kind"), key.alias("id"), some.alias("attrs"), F.struct("path", _lines().alias("lines")).alias("source"), F.lit("tree-sitter").alias("origin"), F.lit("static").alias("certainty"), F.struct("path", "start_line", "pos").alias("pos"))


def universal_facts(parsed: DataFrame) -> DataFrame:
    """A fact for each module, symbol and import of the parsed files, with namespaces and containers."""
    modules, definitions, imports = (explode_parts(parsed, p) for p in ("modules", "definitions", "imports"))
    spaces = modules.select("path", F.col("start_line").alias("m_start"), F.col("name").alias("namespace"))
    row = F.concat_ws("|", "path", "pos").alias("row")
    d = joins.as_of(definitions.select("*", row), spaces, "path", "start_line", "m_start", "namespace")
    spans = d.select(F.col("path").alias("key"), F.struct("start_line", "name", "pos").alias("row"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    inside = joins.containers(spans.withColumn("row", F.struct("key", "row")))
    holder = inside.select(F.col("row.key").alias("path"), F.col("row.row.pos").alias("pos"), F.col("container.row.name").alias("container"))
    d = d.join(holder, ["path", "pos"], "left")
    i = joins.as_of(imports.select("*", row), spaces, "path", "start_line", "m_start", "namespace")
    symbol = F.concat(F.lit("symbol."), F.col("path"), F.lit("#"), F.col("name"), F.lit(":"), F.col("start_line").cast("string"))
    return (
        _fact(modules, "module", F.concat(F.lit("module."), F.col("name")), {"name": F.col("name"), "language": F.col("language")})
        .unionByName(_fact(d, "symbol", symbol, {"name": F.col("name"), "kind": F.col("kind"), "language": F.col("language"), "namespace": F.col("namespace"), "container": F.col("container"), "visibility": F.col("visibility")}))
        .unionByName(_fact(i, "import", F.concat(F.lit("import."), F.col("path"), F.lit("#"), F.col("target")), {"target": F.col("target"), "namespace": F.col("namespace")}))
    )


def spans_of(definitions: Iterable[tuple[int, int]], max_lines: int = MAX_LINES) -> list[tuple[int, int, int | None, int | None]]:
    """(start, end, first and last line of the context) of a file's chunks by definition, from its definitions' lines.

    A span is top where no other strictly contains it. One of more than `max_lines` lines with spans in it gives its direct
    parts; the context are its lines before the first. A part of two such spans with the same context is one chunk.
    """
    out: dict[tuple, None] = {}
    ordered = sorted(set(definitions), key=lambda x: (x[0], -x[1]))  # what contains a span comes before it
    starts = [x[0] for x in ordered]
    last = None
    for at, (start, end) in enumerate(ordered):
        if last is not None and end <= last:
            continue
        last = end
        parts: list[tuple[int, int]] = []
        if end - start + 1 > max_lines:
            for x in ordered[at + 1 : bisect_right(starts, end)]:
                if x[1] <= end and not (parts and x[1] <= parts[-1][1]):
                    parts.append(x)
        head = (start, parts[0][0] - 1) if parts and parts[0][0] > start else (None, None)
        out.update(dict.fromkeys((*x, *head) for x in parts or [(start, end)]))
    return list(out)


def _namespace(modules: Column, at: Column) -> Column:
    """The name of the last module at or before a line, else of the first, else an empty one."""
    places = F.transform(modules, lambda m: F.struct(m["start_line"].alias("at"), m["name"].alias("name")))
    near = F.coalesce(F.array_max(F.filter(places, lambda m: m["at"] <= at)), F.array_min(places))
    return F.coalesce(near["name"], F.lit(""))


_SPANS = "array<struct<start:int,end:int,h_start:int,h_end:int>>"


def chunk_files(files: DataFrame, parsed: DataFrame, depth: int = 1, strategy: str = "namespace", max_lines: int = MAX_LINES, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """chunk_parsed() of files (path, language, text) with their parsed parts."""
    return chunk_parsed(files.select("path", "language", "text").join(parsed.select("path", "definitions", "modules"), "path", "left"), depth, strategy, max_lines, window, overlap)


def chunk_parsed(whole: DataFrame, depth: int = 1, strategy: str = "namespace", max_lines: int = MAX_LINES, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files (path, language, text, definitions, modules): one for each top-level definition, or, where that is
    longer than `max_lines` and has parts, one for each direct part with the lines before the first as context;
    overlapping windows for files without definitions; nothing for empty files.

    Nothing crosses files, so all is worked out within a file's row: no shuffle, and a plan of a few nodes.
    """

    def cuts(definitions: pd.Series) -> pd.Series:
        listed = ([] if d is None else [(x["start"], x["end"]) for x in d] for d in definitions)
        return pd.Series([[dict(zip(("start", "end", "h_start", "h_end"), x)) for x in spans_of(d, max_lines)] for d in listed], dtype=object)

    none = F.lit(None).cast("int")
    lined = whole.where("path is not null").withColumn("ls", X.text_lines(F.col("text"))).where(F.size("ls") > 0)
    cut_at = lined.select("path", "language", "ls", "modules", F.pandas_udf(cuts, _SPANS)(F.transform("definitions", lambda d: F.struct(d["start_line"].alias("start"), d["end_line"].alias("end")))).alias("spans"))
    bare = F.transform(windows.line_windows(F.size("ls"), window, overlap), lambda w: F.struct(w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"), none.alias("h_start"), none.alias("h_end")))
    spans = F.when(F.size("spans") > 0, F.col("spans")).otherwise(bare)
    filled = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["h_start"].alias("h_start"), _namespace(F.col("modules"), s["start"]).alias("namespace"),
        X.join_lines(F.col("ls"), s["start"], s["end"]).alias("content"), F.coalesce(X.join_lines(F.col("ls"), s["h_start"], s["h_end"]), F.lit("")).alias("context"),
    )
    c = cut_at.select("path", "language", F.explode(F.transform(spans, filled)).alias("c")).select("path", "language", "c.*")
    body = F.when(F.col("context") != "", F.concat("context", F.lit("\0"), "content")).otherwise(F.col("content"))
    return (
        c.select("path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.coalesce("language", F.lit("")).alias("language"), "namespace", "content", "context", F.when(F.col("context") != "", F.col("h_start")).otherwise(0).alias("context_start"))
        .withColumn("domain", X.domain(F.col("namespace"), F.col("path"), depth, strategy))
        .withColumn("id", X.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), body))
    )
