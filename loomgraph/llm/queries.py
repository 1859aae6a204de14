"""The pN_ queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import durable
from ..tables import load
from . import bpe, components, garbled, packing, provenance, similarity, splitting, survivors, syntax

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rule_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    rules = load(spark, sf_dir, "rules").where(F.regexp_like("requirement", F.lit(r"\S")))
    return rules, F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("requirement"))


@query(r"""
WITH t AS (
  SELECT DISTINCT rule_id, list_sort(list_distinct(list_filter(
    regexp_extract_all(lower(coalesce(title, '') || ' ' || requirement), '([\p{L}\p{N}]+)', 1), lambda w: length(w) >= 3))) AS ws
  FROM rules WHERE regexp_matches(requirement, '\S')),
s AS (SELECT rule_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0),
w AS (SELECT rule_id, n, unnest(ws) AS word FROM s),
i AS (
  SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM w a JOIN w b ON a.word = b.word AND a.rule_id < b.rule_id GROUP BY ALL)
SELECT rule_a, rule_b FROM i WHERE shared / (na + nb - shared) >= 0.8""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rules whose word sets have a Jaccard similarity of 0.8 or more."""
    rules, text = _rule_texts(spark, sf_dir)
    return similarity.similar_pairs(rules, "rule_id", text).select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"))


@query(r"""
WITH t AS (
  SELECT DISTINCT rule_id, list_sort(list_distinct(list_filter(
    regexp_extract_all(lower(coalesce(title, '') || ' ' || requirement), '([\p{L}\p{N}]+)', 1), lambda w: length(w) >= 3))) AS ws
  FROM rules WHERE regexp_matches(requirement, '\S')),
c AS (SELECT ws, min(rule_id) AS class_id, len(ws) AS n FROM t WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT class_id, n, unnest(ws) AS word FROM c),
i AS (SELECT a.class_id AS x, b.class_id AS y, a.n AS na, b.n AS nb, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT x, count(*) AS n_links FROM i WHERE shared / (na + nb - shared) >= 0.8 GROUP BY x)
SELECT t.rule_id, c.class_id, coalesce(l.n_links, 0) AS n_links FROM t JOIN c ON t.ws = c.ws LEFT JOIN l ON l.x = c.class_id""")
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule with its class of equal word sets and the number of other classes near it."""
    rules, text = _rule_texts(spark, sf_dir)
    return similarity.class_links(rules, "rule_id", text)


@query("SELECT DISTINCT id FROM chunks WHERE length(content) > 8000")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the chunks that the splitter cuts: those with a second piece."""
    return splitting.split(splitting.oversized(load(spark, sf_dir, "chunks"))).where("piece_no = 1").select("id")


@query()
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return splitting.split(splitting.oversized(load(spark, sf_dir, "chunks")))


@query("""
WITH RECURSIVE links AS (
  SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM dup_pairs
  WHERE a <> b AND similarity >= 0.8 AND similarity <= 1 AND NOT isnan(similarity)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT u AS id, u AS seen FROM both_ways
  UNION
  SELECT r.id, e.v FROM reach r JOIN both_ways e ON r.seen = e.u)
SELECT id AS rule_id, min(seen) AS group_id FROM reach GROUP BY id""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule in a valid link with the smallest rule id of its component."""
    pairs = load(spark, sf_dir, "dup_pairs").where("a <> b and similarity >= 0.8 and similarity <= 1 and not isnan(similarity)")
    return components.components(pairs).select(F.col("id").alias("rule_id"), "group_id")


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, third-party or data kept as code."""
    return provenance.kinds(load(spark, sf_dir, "chunks")).select("file_id")


@query()
def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each file that isn't hand-written."""
    return provenance.kinds(load(spark, sf_dir, "chunks"))


@query(r"""
WITH r AS (
  SELECT *, trim(regexp_replace(lower(requirement), '[ \t\r\n]+', ' ', 'g')) AS txt FROM rules),
d AS (
  SELECT DISTINCT rule_id, coalesce(repo, '') || '|' || (repo IS NULL) || '|' || coalesce(domain, '') || '|' || (domain IS NULL) || '|' || txt AS k,
    coalesce(generated_at, TIMESTAMPTZ '0001-01-01 00:00:00+00') AS made, crosscheck, confidence,
    len(list_distinct(list_filter(coalesce(citations, []), lambda c: coalesce(c.path, '') <> '' AND regexp_full_match(coalesce(c.lines, ''), '[0-9]+-[0-9]+')
      AND try_cast(split_part(c.lines, '-', 1) AS HUGEINT) >= 1
      AND try_cast(split_part(c.lines, '-', 1) AS HUGEINT) <= try_cast(split_part(c.lines, '-', 2) AS HUGEINT)))) AS n_cit,
    len(list_distinct(list_filter(list_transform(coalesce(acceptance_criteria, []), lambda x: trim(x)), lambda x: coalesce(x, '') <> ''))) AS n_crit
  FROM r WHERE txt <> ''),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY k ORDER BY n_cit DESC, made DESC, rule_id) AS by_cit,
    row_number() OVER (PARTITION BY k ORDER BY n_crit DESC, made DESC, rule_id) AS by_crit,
    CASE WHEN crosscheck = 'supported' AND confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence) THEN 1 ELSE 0 END AS sure
  FROM d),
conf AS (SELECT k, rule_id, row_number() OVER (PARTITION BY k ORDER BY made DESC, rule_id) AS n FROM ranked WHERE sure = 1)
SELECT min(a.rule_id) AS group_id, max(CASE WHEN by_cit = 1 THEN a.rule_id END) AS citations_from,
  max(c.rule_id) AS confidence_from, max(CASE WHEN by_crit = 1 THEN a.rule_id END) AS criteria_from
FROM ranked a LEFT JOIN conf c ON c.k = a.k AND c.n = 1
GROUP BY a.k HAVING count(DISTINCT a.rule_id) >= 2""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the rules that its fields come from, by truth discovery with the fields' orders as tiers."""
    return survivors.best_by_order(survivors.groups(load(spark, sf_dir, "rules")))


def _truth_sql(rounds: int = survivors.ROUNDS, tolerance: float = survivors.TOLERANCE) -> str:
    """Truth discovery with its rounds written out; once nothing moves, a round repeats the one before."""
    step = """
x{k} AS (SELECT g, f, v, sum(ln(w * rivals / (1 - w))) AS x FROM contested JOIN t{k} USING (s) GROUP BY ALL),
m{k} AS (SELECT g, f, v, exp(x - max(x) OVER (PARTITION BY g, f)) AS e FROM x{k}),
p{k} AS (SELECT g, f, v, e / sum(e) OVER (PARTITION BY g, f) AS support FROM m{k}),
n{k} AS (SELECT s, w, (sum(support) + 4.0) / (count(*) + 5.0) AS new FROM contested JOIN p{k} USING (g, f, v) JOIN t{k} USING (s) GROUP BY s, w),
t{l} AS (SELECT s, CASE WHEN (SELECT max(abs(new - w)) FROM n{k}) > {tolerance} THEN new ELSE w END AS w FROM n{k}),"""
    return (
        r"""
WITH r AS (SELECT *, trim(regexp_replace(lower(requirement), '[ \t\r\n]+', ' ', 'g')) AS txt FROM rules),
d AS (
  SELECT DISTINCT rule_id AS key, coalesce(CAST(output_id AS VARCHAR), '') AS s, coalesce(repo, '') || '|' || (repo IS NULL) || '|' || coalesce(domain, '') || '|' || (domain IS NULL) || '|' || txt AS g,
    list_sort(list_distinct(list_transform(list_filter(coalesce(citations, []), lambda c: coalesce(c.path, '') <> '' AND regexp_full_match(coalesce(c.lines, ''), '[0-9]+-[0-9]+')
      AND try_cast(split_part(c.lines, '-', 1) AS HUGEINT) >= 1
      AND try_cast(split_part(c.lines, '-', 1) AS HUGEINT) <= try_cast(split_part(c.lines, '-', 2) AS HUGEINT)), lambda c: c.path || ':' || c.lines))) AS cit,
    list_sort(list_distinct(list_filter(list_transform(coalesce(acceptance_criteria, []), lambda x: trim(x)), lambda x: coalesce(x, '') <> ''))) AS crit,
    CASE WHEN crosscheck = 'supported' AND confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence) THEN confidence END AS conf
  FROM r WHERE txt <> ''),
two AS (SELECT g, min(key) AS group_id FROM d GROUP BY g HAVING count(DISTINCT key) > 1),
c AS (
  SELECT g, key, s, 'citations' AS f, array_to_string(cit, chr(10)) AS v, len(cit) AS t FROM d JOIN two USING (g) WHERE len(cit) > 0
  UNION ALL SELECT g, key, s, 'criteria', array_to_string(crit, chr(10)), len(crit) FROM d JOIN two USING (g) WHERE len(crit) > 0
  UNION ALL SELECT g, key, s, 'confidence', CAST(conf AS VARCHAR), 1 FROM d JOIN two USING (g) WHERE conf IS NOT NULL),
top AS (SELECT g, f, max(t) AS t FROM c GROUP BY ALL),
votes AS (SELECT g, f, v, s, count(DISTINCT key) AS n FROM c JOIN top USING (g, f, t) GROUP BY ALL),
vals AS (SELECT g, f, v, sum(n) AS votes FROM votes GROUP BY ALL),
riv AS (SELECT g, f, count(*) - 1 AS rivals FROM vals GROUP BY ALL),
contested AS (SELECT g, f, v, s, rivals FROM votes JOIN riv USING (g, f) WHERE rivals > 0),
t0 AS (SELECT DISTINCT s, 0.8::DOUBLE AS w FROM contested),"""
        + "".join(step.format(k=k, l=k + 1, tolerance=tolerance) for k in range(rounds))
        + f"""
best AS (
  SELECT g, f, v, support FROM p{rounds - 1} QUALIFY row_number() OVER (PARTITION BY g, f ORDER BY round(support, 9) DESC, v) = 1
  UNION ALL SELECT g, f, v, 1.0 FROM vals JOIN riv USING (g, f) WHERE rivals = 0)
SELECT group_id, f AS field, v AS value, round(support, 4) AS support, CAST(votes AS BIGINT) AS votes FROM best JOIN vals USING (g, f, v) JOIN two USING (g)"""
    )


@query(_truth_sql())
def p6_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group and field the value with the highest support once the sources' reliabilities have settled."""
    claims = durable.cut(survivors.field_claims(load(spark, sf_dir, "rules"))).df
    choices, _ = survivors.discover(claims)
    named = claims.select(F.col("g").alias("group"), "group_id").distinct()
    return choices.join(named, "group").select("group_id", "field", "value", F.round("support", 4).alias("support"), "votes")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(load(spark, sf_dir, "chunks"), load(spark, sf_dir, "known_languages"))


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return _judged(spark, sf_dir).where("reason is not null").select("file_id")


@query()
def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each invalid file."""
    return _judged(spark, sf_dir).where("reason is not null")


@query()
def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files by repository and language."""
    return syntax.rates(_judged(spark, sf_dir))


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_column(load(spark, sf_dir, "documents"))


@query()
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of a document above the capacity."""
    return packing.pack_texts(load(spark, sf_dir, "documents"))


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text."""
    return garbled.find(load(spark, sf_dir, "documents")).select("doc_id")


@query()
def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original text of garbled documents, where it can be restored, and the chains that garbled it."""
    return garbled.find(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
