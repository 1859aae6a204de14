"""Queries of what stands between a model's replies and the graph: validators, grounding, memo keys, pages and parsing.

Each query runs the operator itself; its SQL says the same in other words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import graph, merge, phases, render, windows
from ..operators import model as M
from ..sources import facts
from ..tables import load
from .catalog import query
from .relations import RULES, first_delivery
from .sources import _with_edges
from .texts import SLUG, texts

_RANGE = "regexp_full_match(coalesce(c.lines, ''), '[0-9]+-[0-9]+') AND try_cast(split_part(c.lines, '-', 1) AS HUGEINT) BETWEEN 1 AND try_cast(split_part(c.lines, '-', 2) AS HUGEINT)"
_LOW, _HIGH = "try_cast(split_part(c.lines, '-', 1) AS HUGEINT)", "try_cast(split_part(c.lines, '-', 2) AS HUGEINT)"
_REPLY = ("ears_kind", "citations", "entities", "endpoints", "nature", "origin", "slug", "title")
_EARS = "WHEN coalesce(ears_kind, '') NOT IN ('ubiquitous', 'event', 'state', 'optional', 'unwanted') THEN 'ears' WHEN len(coalesce(citations, [])) = 0 THEN 'citations'"
_LATER = "WHEN coalesce(nature, '') NOT IN ('business', 'presentation', 'technical') THEN 'nature' WHEN coalesce(origin, '') NOT IN ('explicit', 'implicit') THEN 'origin' WHEN isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'confidence'"


def _listed(value) -> list:
    return [] if value is None else list(value)


def _reply(u: dict) -> dict:
    """A row as a rule of a reply."""
    cited = [None if c is None else {"path": c["path"], "lines": c["lines"]} for c in _listed(u["citations"])]
    confidence = None if u["confidence"] is None else float(u["confidence"])
    return {k: u[k] for k in ("ears_kind", "nature", "origin", "slug", "title")} | {"confidence": confidence, "citations": cited, "entities": _listed(u["entities"]), "endpoints": _listed(u["endpoints"])}


def _judge(rows: DataFrame, judge: Callable[[dict], tuple], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([judge(u) for u in f.astype(object).where(f.notna(), None).to_dict("records")], columns=names)

    return rows.mapInPandas(run, schema)


@query(f"""WITH {RULES}, v AS (SELECT *, list_filter(list_transform(coalesce(citations, []), lambda c: CASE WHEN c IS NULL OR c.path IS NULL OR c.path <> coalesce(citations[1].path, '') THEN 'path' WHEN NOT coalesce({_RANGE}, false) THEN 'lines' WHEN {_HIGH} > 400 THEN 'span' END), lambda x: x IS NOT NULL) AS bad FROM r)
SELECT rule_id, CASE {_EARS} WHEN len(bad) > 0 THEN bad[1] WHEN len(list_filter(coalesce(entities, []), lambda e: e IS NULL OR length(e) % 2 = 1)) > 0 THEN 'entities' WHEN len(list_filter(coalesce(endpoints, []), lambda e: e IS NULL)) > 0 THEN 'endpoints' {_LATER} ELSE 'ok' END AS first_error FROM v""")
def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each rule as a reply to a chunk of 400 lines of its first cited file; entities of odd length aren't allowed."""

    def judge(u: dict) -> tuple:
        rule = _reply(u)
        path = ((rule["citations"] or [None])[0] or {}).get("path") or ""
        allowed = [e for e in rule["entities"] if e is not None and len(e) % 2 == 0]
        return u["rule_id"], M.first_error(lambda: M.validate_map({"rules": [rule]}, path, 1, 400, allowed, [e for e in rule["endpoints"] if e is not None]))

    return _judge(first_delivery(spark, sf_dir, *_REPLY).select("rule_id", *_REPLY, F.col("confidence").cast("string").alias("confidence")), judge, "rule_id bigint, first_error string")


_SHORT = f"array_to_string(list_slice(string_split({SLUG}, '-'), 1, 5), '-')"
_NAMED = f"coalesce(nullif({_SHORT.format('''coalesce(slug, '')''')}, ''), {_SHORT.format('''coalesce(title, '')''')})"


@query(f"""WITH {RULES}, v AS (SELECT *, {_NAMED} AS named FROM r)
SELECT rule_id, named || ' ' || named || '-2' AS slugs, CASE WHEN named = '' THEN 'slug' {_EARS} WHEN len(list_filter(citations, lambda c: c IS NULL OR c.path IS NULL OR c.lines IS NULL OR length(c.path) % 2 = 1)) > 0 THEN 'citation' WHEN len(list_filter(coalesce(endpoints, []), lambda e: e IS NULL OR length(e) % 2 = 1)) > 0 THEN 'endpoints' {_LATER} ELSE 'ok' END AS first_error FROM v WHERE named <> ''""")
def reduce_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each rule, given twice, as a reply to candidates that cite its files with paths of even length; and its repaired slugs."""

    def judge(u: dict) -> tuple:
        rule = _reply(u)
        known = {(c["path"], c["lines"]) for c in rule["citations"] if c and c["path"] and c["lines"] is not None and len(c["path"]) % 2 == 0} | {("", c["lines"]) for c in rule["citations"] if c and c["path"] == "" and c["lines"] is not None}
        reply = {"rules": [rule, dict(rule)]}
        entities, endpoints = rule["entities"], [e for e in rule["endpoints"] if e is not None and len(e) % 2 == 0]
        error = M.first_error(lambda: M.validate_reduce(reply, known, entities, endpoints))
        taken: set[str] = set()
        own = M.slug_of(u["slug"] or "") or M.slug_of(u["title"] or "")
        return u["rule_id"], " ".join(M.unique(own, taken) for _ in range(2)), error

    judged = _judge(first_delivery(spark, sf_dir, *_REPLY).select("rule_id", *_REPLY, F.col("confidence").cast("string").alias("confidence")), judge, "rule_id bigint, slugs string, first_error string")
    return judged.where("first_error <> 'slug'")


@query(f"""WITH {RULES} SELECT rule_id, CASE WHEN coalesce(crosscheck, '') NOT IN ('supported', 'partial', 'unsupported') THEN 'verdict' WHEN NOT regexp_matches(coalesce(rationale, ''), '\\S') THEN 'reason' ELSE 'ok' END AS first_error FROM r""")
def verdict_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each rule's verdict, its rationale being the reason."""
    judge = lambda u: (u["rule_id"], M.first_error(lambda: M.validate_verdict({"verdict": u["crosscheck"], "reason": u["rationale"]})))
    return _judge(first_delivery(spark, sf_dir, "crosscheck", "rationale").select("rule_id", "crosscheck", "rationale"), judge, "rule_id bigint, first_error string")


@query(f"""WITH {RULES}, c AS (SELECT rule_id, first_path, unnest(citations) AS c FROM (SELECT rule_id, citations, citations[1].path AS first_path FROM r))
SELECT r.rule_id, count(DISTINCT CASE WHEN c.path = first_path AND {_RANGE} AND {_LOW} <= 90 AND {_HIGH} >= 30 THEN c.lines END) AS n_grounded FROM r LEFT JOIN c ON c.rule_id = r.rule_id GROUP BY r.rule_id""")
def repair_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each rule's citations a repair would keep, of its first cited file, with a precise symbol on lines 30 to 90."""

    def judge(u: dict) -> tuple:
        cited = _reply(u | dict.fromkeys(("ears_kind", "nature", "origin", "slug", "title", "confidence", "entities", "endpoints")))["citations"]
        first = (cited[0] or {}).get("path") if cited else None
        return u["rule_id"], len(M.grounded(cited, {first} - {None}, {first: [(30, 90)]}))

    return _judge(first_delivery(spark, sf_dir, "citations").select("rule_id", "citations"), judge, "rule_id bigint, n_grounded bigint")


@query(f"WITH {RULES} SELECT o.output_id, o.domain, count(*) AS n_rules FROM reduce_out o JOIN r ON r.output_id = o.output_id WHERE NOT coalesce(o.failed, false) GROUP BY o.output_id, o.domain")
def usable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that did not fail and have rules."""
    r = first_delivery(spark, sf_dir, "output_id").groupBy("output_id").agg(F.collect_list("rule_id").alias("rules"))
    outputs = load(spark, sf_dir, "reduce_out").select("output_id", "domain", "failed").join(r, "output_id", "left")
    return phases.usable(outputs).select("output_id", "domain", F.size("rules").cast("bigint").alias("n_rules"))


@query("SELECT doc_type, sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN lang = 'en' THEN 0 ELSE n_chars END)::BIGINT AS completion FROM documents GROUP BY doc_type")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two usage sums for each phase (a document type stands for a phase, its language for the side)."""
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    rows = load(spark, sf_dir, "documents").select("doc_type", F.when(en, F.col("n_chars")).otherwise(0).alias("prompt"), F.when(en, 0).otherwise(F.col("n_chars")).alias("completion"))
    return phases.usage(rows, "doc_type")


@query(f"""WITH {RULES}, n AS (SELECT repo, domain, coalesce(requirement, '') AS requirement, coalesce(title, '') AS title, (row_number() OVER (PARTITION BY repo, domain ORDER BY rule_id) - 1) // 30 AS batch FROM r),
j AS (SELECT repo, domain, batch, requirement || chr(9) || title || chr(9) || to_json({{'requirement': requirement, 'title': title}}) AS line FROM n)
SELECT repo, domain, batch, left(sha256('2' || chr(10) || string_agg(line, chr(10) ORDER BY line)), 16) AS candidates_hash FROM j GROUP BY ALL""")
def candidates_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of each batch of a domain's candidates; the key of a reduction's memo."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    r = first_delivery(spark, sf_dir, "repo", "domain", "requirement", "title").select("repo", "domain", "rule_id", F.struct(text("requirement"), text("title")).alias("rule"))
    batched = windows.batches(r, ["repo", "domain"], ["rule_id"], 30)
    return batched.groupBy("repo", "domain", "batch").agg(phases.candidates_hash(F.collect_list("rule")).alias("candidates_hash"))


@query(f"WITH {RULES} SELECT 'supported' AS verdict, count(*) FILTER (WHERE crosscheck = 'supported') AS n FROM r UNION ALL SELECT 'partial', count(*) FILTER (WHERE crosscheck = 'partial') FROM r UNION ALL SELECT 'unsupported', count(*) FILTER (WHERE crosscheck = 'unsupported') FROM r UNION ALL SELECT 'repaired', count(*) FILTER (WHERE crosscheck = 'repaired') FROM r UNION ALL SELECT 'failed', count(*) FILTER (WHERE crosscheck IS NULL) FROM r")
def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in five counters; a missing one counts as failed."""
    v = first_delivery(spark, sf_dir, "crosscheck").select(F.col("crosscheck").alias("verdict"), F.col("crosscheck").isNull().alias("failed"))
    return phases.tally(v).select(F.explode(F.create_map(*(x for k in phases.TALLY for x in (F.lit(k), F.col(k))))).alias("verdict", "n"))


# ---------------------------------------------------------------- nodes and pages


@query(f"""WITH s AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'get' END AS m, 'post' AS v, '/' || s_name AS p, CASE WHEN s_suppkey % 2 = 0 THEN 'h' || s_nationkey WHEN s_suppkey % 5 = 0 THEN 'C' ELSE 'C@a' || s_nationkey END AS h, coalesce(nullif(m, ''), v) AS verb FROM supplier)
SELECT 'endpoint.' || {SLUG.format("verb || ' ' || p")} AS id, upper(verb) || ' ' || p AS title, '**Méthode** : ' || upper(verb) || chr(10) || chr(10) || '**Path** : `' || p || '`' || chr(10) || chr(10) || '**Handler** : `' || h || '`' AS body FROM s""")
def endpoint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint nodes of routes: one for each supplier, with its verb under one of two names and one of three sorts of handler."""
    k = F.col("s_suppkey")
    attrs = F.create_map(
        F.lit("method"), F.when(k % 3 == 0, "").otherwise("get"), F.lit("verb"), F.lit("post"), F.lit("path"), F.concat(F.lit("/"), "s_name"),
        F.lit("handler"), F.when(k % 2 == 0, F.concat(F.lit("h"), F.col("s_nationkey").cast("string"))).otherwise(""), F.lit("controller"), F.lit("C"), F.lit("action"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("a"), F.col("s_nationkey").cast("string"))),
    )
    source = F.struct(F.lit("p").alias("path"), F.lit("1-1").alias("lines"))
    routes = load(spark, sf_dir, "supplier").select(F.lit("route").alias("kind"), F.concat(F.lit("route."), "s_name").alias("id"), attrs.alias("attrs"), source.alias("source"))
    return graph.endpoint_nodes(routes).select("id", "title", "body")


@query(f"""SELECT 'entity.' || {SLUG.format('p_name')} AS id, p_name AS title, '**Table** : `' || p_name || '`' || chr(10) || chr(10) || '**Colonnes** :' || list_reduce(list_prepend('', list_transform(list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: chr(10) || '- `' || x || '`')), lambda a, b: a || b) AS body FROM part""")
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity nodes of tables: one for each part, with the words of its type as columns; without a name the id's is used."""
    named = F.col("p_partkey") % 2 == 0
    attrs = F.create_map(F.lit("name"), F.when(named, F.col("p_name")).otherwise(""), F.lit("columns"), F.replace("p_type", F.lit(" "), F.lit(" , ")))
    source = F.struct(F.lit("p").alias("path"), F.lit("1-1").alias("lines"))
    tables = load(spark, sf_dir, "part").select(F.lit("table").alias("kind"), F.concat(F.lit("table."), "p_name").alias("id"), attrs.alias("attrs"), source.alias("source"))
    return graph.entity_nodes(tables).select("id", "title", "body")


_CRITERIA = "list_transform(coalesce(acceptance_criteria, []), lambda c, i: chr(10) || i || '. ' || coalesce(c, ''))"


@query(f"""WITH {RULES} SELECT 'rule.' || rule_id || '.' || coalesce(slug, '') AS id, '**Exigence (EARS)** : ' || coalesce(requirement, '') || CASE WHEN coalesce(rationale, '') <> '' THEN chr(10) || chr(10) || '**Justification** : ' || rationale ELSE '' END
  || CASE WHEN len(coalesce(acceptance_criteria, [])) > 0 THEN chr(10) || chr(10) || '**Critères d''acceptation** :' || list_reduce(list_prepend('', {_CRITERIA}), lambda a, b: a || b) ELSE '' END AS body,
  regexp_replace(split_part(coalesce(requirement, ''), chr(10), 1), '^$', '**Exigence (EARS)** : ') AS restated, len(list_distinct(coalesce(entities, []))) + len(list_distinct(coalesce(endpoints, []))) + 1 AS n_edges FROM r""")
def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of rule nodes, the requirement read back from each, and how many edges its rule has."""
    r = first_delivery(spark, sf_dir, "slug", "title", "ears_kind", "requirement", "rationale", "citations", "entities", "endpoints", "acceptance_criteria", "nature", "origin").withColumn("domain", F.col("rule_id").cast("string")).withColumn("slug", F.coalesce("slug", F.lit("")))
    edges = graph.rule_edges(r).groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("n_edges"))
    return graph.rule_nodes(r).select("id", "body", X.requirement_of(F.col("body")).alias("restated")).join(edges, "id")


@query(f"""WITH {RULES} SELECT 'rule.' || rule_id || '.' || coalesce(slug, '') AS id, coalesce(title, '') AS title, len(coalesce(citations, [])) AS n_sources, len(list_distinct(list_filter(coalesce(entities, []), lambda e: e IS NOT NULL))) + len(list_distinct(list_filter(coalesce(endpoints, []), lambda e: e IS NOT NULL))) + 1 AS n_edges,
  len(coalesce(acceptance_criteria, []))::VARCHAR AS acceptance, CASE WHEN confidence IS NULL OR isnan(confidence) THEN '0.00' ELSE printf('%.2f', confidence) END AS confidence FROM r""")
def pages_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading all rule pages back gives; titles are lines, so one with a line break is cut there."""
    nodes = render.parse_pages(render.pages(_with_edges(spark, sf_dir)))
    extra = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return nodes.select("id", "title", F.size("sources").cast("bigint").alias("n_sources"), F.size("edges").cast("bigint").alias("n_edges"), extra("acceptance"), extra("confidence"))


@query("SELECT NULL::VARCHAR AS node_id, NULL::VARCHAR AS \"check\", NULL::VARCHAR AS detail WHERE false")
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the round trip of all rule pages; there are none."""
    return render.round_trip(_with_edges(spark, sf_dir))


@query(f"""WITH {RULES} SELECT 'rule.' || rule_id || '.x' AS id, CASE WHEN crosscheck IS NULL OR rule_id % 7 = 0 THEN 'before' WHEN rule_id % 5 = 0 THEN 'repaired' ELSE crosscheck END AS crosscheck, CASE WHEN crosscheck IS NOT NULL AND rule_id % 7 <> 0 AND (rule_id % 5 = 0 OR crosscheck = 'repaired') THEN 1 ELSE 0 END AS n_sources FROM r""")
def verdicts_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their verdicts: every seventh review failed, every fifth repaired its rule's citations."""
    r = first_delivery(spark, sf_dir, "crosscheck").select(F.concat(F.lit("rule."), F.col("rule_id").cast("string"), F.lit(".x")).alias("id"), "rule_id", "crosscheck")
    none = F.expr("cast(array() as array<struct<path:string,lines:string>>)")
    nodes = r.select("id", none.alias("sources"), F.create_map(F.lit("crosscheck"), F.lit("before")).alias("extra"))
    found = F.array(F.struct(F.lit("p").alias("path"), F.lit("1-2").alias("lines")))
    verdicts = r.where("crosscheck is not null").select(F.col("id").alias("rule_id"), F.when(F.col("rule_id") % 5 == 0, "repaired").otherwise(F.col("crosscheck")).alias("verdict"), found.alias("new_citations"), (F.col("rule_id") % 7 == 0).alias("failed"))
    return phases.annotate(nodes, verdicts).select("id", F.try_element_at("extra", F.lit("crosscheck")).alias("crosscheck"), F.size("sources").alias("n_sources"))


# ---------------------------------------------------------------- texts and sources


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(split_part(text, chr(10), 1), '\r$', ''), '^$', '') AS first_line, regexp_replace(regexp_extract(text, '(?m)^\*\*Exigence \(EARS\)\*\* : (.*)$', 1), '\r$', '') AS stated FROM documents WHERE text IS NOT NULL""")
def requirement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines and stated requirements of all documents; a CR before the newline belongs to the line's end."""
    plain = lambda c: F.regexp_replace(c, r"\r\z", "")
    d = texts(spark, sf_dir)
    said = X.requirement_of(F.col("text"))
    marked = F.regexp_like("text", F.lit(r"(?md)^\*\*Exigence \(EARS\)\*\* : ."))
    return d.select("doc_id", plain(F.substring_index("text", "\n", 1)).alias("first_line"), F.when(marked, plain(said)).otherwise("").alias("stated"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '') AS bare FROM documents WHERE text IS NOT NULL""")
def fences_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were put into a code fence, taken out of it again."""
    fenced = F.concat(F.lit(" \n```json\n"), F.col("text"), F.lit("\n```\n"))
    return texts(spark, sf_dir).select("doc_id", X.strip_fences(fenced).alias("bare"))


@query("""WITH f AS (SELECT 'sql/' || lpad(n_nationkey::VARCHAR, 3, '0') || '.sql' AS path, n_regionkey, n_nationkey FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY path) AS n FROM f)
SELECT 'table.region_' || n_regionkey AS id, 'id:bigint, share:numeric(' || n_nationkey + 3 || ', note' AS columns, path, '2-2' AS lines FROM k WHERE n = 1""")
def script_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of scripts, one script for each nation; the first script of a region's table wins."""
    n = F.col("n_nationkey")
    text = F.concat(F.lit("-- one\ncreate table if not exists region_"), F.col("n_regionkey").cast("string"), F.lit(" (\n id BIGINT,\n share NUMERIC("), (n + 3).cast("string"), F.lit(", 2) default (0.5), note,\n unique (id)\n);\n"))
    files = load(spark, sf_dir, "nation").select(F.concat(F.lit("sql/"), F.lpad(n.cast("string"), 3, "0"), F.lit(".sql")).alias("path"), F.lit("").alias("language"), text.alias("text"))
    return facts.script_facts(files).select("id", F.element_at("attrs", F.lit("columns")).alias("columns"), "source.path", "source.lines")


@query("""SELECT 'route.get./n' || n_nationkey AS id, 'C' || n_regionkey AS controller, 'show' AS action, '' AS handler, '3-3' AS lines FROM nation UNION ALL SELECT DISTINCT 'route.post./region/r' || n_regionkey, '', '', 'm.save', '3-3' FROM nation""")
def script_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of scripts in two languages, one script in each for every nation; the first of a route's verb and path wins."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    php = F.concat(F.lit("<?php\n// routes\nRoute::get('n"), n, F.lit("', [C"), r, F.lit("::class, 'show']);\n"))
    go = F.concat(F.lit("package m\nfunc f(x *R) { g := x.Group(\"/region/\")\n g.POST(\"/r"), r, F.lit("\", save)\n}\n"))
    both = F.explode(F.array(F.struct(F.lit("php").alias("language"), php.alias("text")), F.struct(F.lit("go").alias("language"), go.alias("text")))).alias("f")
    files = load(spark, sf_dir, "nation").select(n.alias("n"), both).select(F.concat("n", F.lit("."), "f.language").alias("path"), "f.language", "f.text")
    of = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("")).alias(k)
    return facts.script_facts(files).where("kind = 'route'").select("id", of("controller"), of("action"), of("handler"), "source.lines")


@query("SELECT 'kept' AS kind, n_name AS id FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'route', r_name FROM region")
def routes_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of a kind replaced by other ones."""
    old = load(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") == 1, "route").otherwise("kept").alias("kind"), F.col("n_name").alias("id"))
    return merge.replace_kind(old, "route", load(spark, sf_dir, "region").select(F.lit("route").alias("kind"), F.col("r_name").alias("id")))
