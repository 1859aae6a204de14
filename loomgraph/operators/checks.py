"""Integrity violations, citation resolution, digests and drift."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: What the violations say.
DETAILS = {
    "duplicate-id": "node id appears more than once",
    "dangling-edge": "edge {type} points to missing node {dst}",
    "rule-without-citation": "rule node has no source citation",
    "escapes": 'path "{path}" escapes the source root',
    "range": 'invalid line range "{lines}"',
    "missing": 'path "{path}" not found under source root',
    "beyond": "lines {lines} exceed file {path} ({n_lines} lines)",
}


def _detail(key: str) -> Column:
    """A detail with the row's columns in the places of their names."""
    parts = re.split(r"\{(\w+)\}", DETAILS[key])
    return F.concat(*(F.coalesce(F.col(x).cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def duplicate_ids(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One violation for each repeat of an id beyond the first; counted, not windowed."""
    repeated = nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.select(F.col(key).alias("node_id"), F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("k")).select("node_id", F.lit("duplicate-id").alias("check"), F.lit(DETAILS["duplicate-id"]).alias("detail"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    lost = edges.join(nodes.select(F.col("id").alias("__id")), F.col("dst") == F.col("__id"), "left_anti")
    return lost.select(F.col("src").alias("node_id"), F.lit("dangling-edge").alias("check"), _detail("dangling-edge").alias("detail"))


def uncited_rules(nodes: DataFrame) -> DataFrame:
    bare = nodes.where((F.col("type") == "rule") & (F.coalesce(F.size("sources"), F.lit(0)) == 0))
    return bare.select(F.col("id").alias("node_id"), F.lit("rule-without-citation").alias("check"), F.lit(DETAILS["rule-without-citation"]).alias("detail"))


def resolve_citations(citations: DataFrame, line_counts: DataFrame) -> DataFrame:
    """`citations` (.., path, lines) with `problem`: null, or why the citation doesn't resolve.

    line_counts: (path, n_lines). An absolute path, one that leaves the root or an empty one escapes.
    """
    clean = F.regexp_replace("path", r"(?:^|/)\.(?=/|$)", "")
    escapes = F.coalesce(F.col("path").startswith("/") | (F.col("path") == "") | F.regexp_like(clean, F.lit(r"^/?\.\.(?:/|$)")), F.lit(True))
    counts = line_counts.select(F.col("path").alias("__p"), "n_lines")
    j = citations.join(counts, F.col("path") == F.col("__p"), "left").drop("__p")
    end = X.range_end(F.col("lines"))
    problem = F.when(escapes, _detail("escapes")).when(end.isNull(), _detail("range")).when(F.col("n_lines").isNull(), _detail("missing")).when(end > F.col("n_lines"), _detail("beyond"))
    return j.withColumn("problem", problem)


def digests(citations: DataFrame, files: DataFrame, key: str = "rule_id") -> DataFrame:
    """(key, digest): 16 hex digits of SHA-256 over the cited text of each rule; null if a citation doesn't resolve.

    files: (path, content). Sources by path, then lines as text; each gives 'path|lines' and the cited lines. A final
    newline leaves an empty last line that may be cited. Files are split once; each citation slices its own lines.
    """
    lines = files.select(F.col("path").alias("__p"), F.split("content", "\n").alias("ls"))
    a, b = X.range_start(F.col("lines")), X.range_end(F.col("lines"))
    j = citations.select(key, "path", "lines").join(lines, F.col("path") == F.col("__p"), "left")
    text = F.when(b <= F.size("ls"), X.join_lines(F.col("ls"), a.cast("int"), b.cast("int")))
    part = F.concat(F.col("path"), F.lit("|"), F.col("lines"), F.lit("\n"), text, F.lit("\n"))
    rows = j.select(key, F.struct("path", "lines", part.alias("part")).alias("x"))
    agg = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count_if(F.col("x.part").isNull()).alias("broken"))
    return agg.select(key, F.when(F.col("broken") == 0, X.short_hash(F.array_join(F.transform("xs", lambda x: x["part"]), ""))).alias("digest"))


def drift(stored: DataFrame, current: DataFrame, key: str = "rule_id") -> DataFrame:
    """(key, status): unknown without a stored digest, broken where no digest can be made now, else ok or stale."""
    s = stored.select(key, F.col("digest").alias("before")).join(current.select(key, F.col("digest").alias("now")), key, "left")
    status = F.when(F.coalesce("before", F.lit("")) == "", "unknown").when(F.col("now").isNull(), "broken").when(F.col("before") == F.col("now"), "ok").otherwise("stale")
    return s.select(key, status.alias("status"))


def drift_report(statuses: DataFrame) -> DataFrame:
    """One row of counts; drifted if anything is stale or broken."""
    count = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(count("ok").alias("ok"), count("stale").alias("stale"), count("broken").alias("broken"), count("unknown").alias("unknown")).withColumn("drifted", (F.col("stale") + F.col("broken")) > 0)


def excerpt(citations: DataFrame, files: DataFrame, key: str = "rule_id", context: int = 10, budget: int = 400) -> DataFrame:
    """(key, src, line_no, line): the cited lines with context, marked, in order, up to a budget of lines for each key.

    `citations` has the source's order in `src`. The range join is an equi-join on the path and an explode.
    """
    a, b = X.range_start(F.col("lines")), X.range_end(F.col("lines"))
    held = files.select(F.col("path").alias("__p"), F.split("content", "\n").alias("ls"))
    j = citations.withColumns({"a": a, "b": b}).where("a is not null").join(held, F.col("path") == F.col("__p"))
    last = F.least(F.col("b") + context, F.size("ls").cast("bigint"))
    first = F.greatest(F.lit(1), F.col("a") - context)
    # No source can add more lines than the budget.
    shown = j.where(first <= last).select(key, "src", "a", "b", first.alias("first"), F.slice("ls", first.cast("int"), F.greatest(F.lit(0), F.least(last - first + 1, F.lit(budget))).cast("int")).alias("shown"))
    rows = shown.select(key, "src", "a", "b", "first", F.posexplode("shown").alias("k", "text")).withColumn("line_no", F.col("first") + F.col("k"))
    mark = F.when(F.col("line_no").between(F.col("a"), F.col("b")), ">").otherwise("·")
    text = F.concat(F.format_string("%5d", "line_no"), F.lit(" "), mark, F.lit(" "), F.col("text"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("src", "line_no"))
    return rows.select(key, "src", "line_no", text.alias("line")).withColumn("__n", n).where(F.col("__n") <= budget).drop("__n")


def excerpt_texts(lines: DataFrame, citations: DataFrame, key: str = "rule_id", budget: int = 400) -> DataFrame:
    """(key, excerpt): the lines of excerpt() as one text, each source under its heading, marked where the budget cut it."""
    parts = lines.groupBy(key, "src").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"), F.count("*").alias("n"))
    heads = parts.join(citations.select(key, "src", F.concat(F.lit("--- "), "path", F.lit(":"), "lines", F.lit(" ---")).alias("head")), [key, "src"])
    text = F.concat("head", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    whole = heads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("src", text.alias("t")))).alias("ts"), F.sum("n").alias("n"))
    end = F.when(F.col("n") >= budget, "\n... (excerpt truncated)").otherwise("")
    return whole.select(key, F.concat(F.array_join(F.transform("ts", lambda x: x["t"]), "\n"), end).alias("excerpt"))
