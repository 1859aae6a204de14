"""Queries of parsing, chunking, validating and rendering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from ..functions import exprs as X
from ..operators import chunks, graph, render
from ..sources import scanners
from ..tables import load
from .catalog import query
from .relations import RULES, first_delivery


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text): files put together from their distinct chunks, with ids as paths."""
    c = load(spark, sf_dir, "chunks").select("file_id", "id", "path", F.coalesce("start_line", F.lit(0)).alias("start"), F.coalesce("content", F.lit("")).alias("content"))
    c = c.repartition("file_id")  # the one exchange of the texts, for both groupings
    once = c.groupBy("file_id", "id").agg(F.max("path").alias("path"), F.max("start").alias("start"), F.min("content").alias("content"))
    whole = once.groupBy("file_id").agg(F.max(F.trim("path")).alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "id", "content"))), lambda x: x["content"]), "\n").alias("text"))
    return whole.select(F.concat("p", F.lit("#"), F.col("file_id").cast("string")).alias("path"), X.language_of(F.col("p")).alias("language"), "text")


def _parsed(f: DataFrame) -> DataFrame:
    return cut(scanners.parse_files(f.withColumnRenamed("text", "content"))).df  # parsed once, whatever reads it


@query()
def source_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all source files."""
    return chunks.explode_parts(_parsed(files(spark, sf_dir)), "definitions").drop("pos")


@query()
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all source files by kind and language."""
    facts = chunks.universal_facts(_parsed(files(spark, sf_dir)))
    return facts.groupBy("kind", F.coalesce(F.try_element_at("attrs", F.lit("language")), F.lit("")).alias("language")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query()
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all source files, by definition or by window."""
    whole = scanners.parse_files(files(spark, sf_dir).withColumnRenamed("text", "content"), "content").withColumnRenamed("content", "text")
    return chunks.chunk_parsed(whole).select("path", "id", "start_line", "end_line", "language", "namespace", "domain", F.length("content").alias("n_chars"), "context_start")


@query()
def frontmatter_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of all rules' pages, with the rule's id for its domain so that ids are unique; see _defined()."""
    full = _with_edges(spark, sf_dir)
    return full.select("id", render.frontmatter().alias("head"))


def _with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = first_delivery(spark, sf_dir, "domain", "slug", "title", "ears_kind", "requirement", "rationale", "citations", "entities", "endpoints", "acceptance_criteria", "nature", "origin")
    kept = _defined(r.withColumn("domain", F.col("rule_id").cast("string")))
    return render.with_edges(graph.rule_nodes(kept), graph.rule_edges(kept))


def _defined(r: DataFrame) -> DataFrame:
    """Rules as they can be written: a null slug, path or range is empty, a null entity or endpoint is none, and NaN is no
    confidence."""
    given = lambda c: F.filter(c, lambda x: x.isNotNull())
    some = F.transform("citations", lambda c: F.struct(F.coalesce(c["path"], F.lit("")).alias("path"), F.coalesce(c["lines"], F.lit("")).alias("lines")))
    return r.withColumns({"slug": F.coalesce("slug", F.lit("")), "citations": some, "entities": given("entities"), "endpoints": given("endpoints"), "confidence": F.when(~F.isnan("confidence"), F.col("confidence"))})
