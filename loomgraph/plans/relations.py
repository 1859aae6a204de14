"""Queries of joins, merges, aggregations, graph building and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks, graph, joins, merge, similar, windows
from ..tables import load
from .catalog import query
from .texts import _LANG, SLUG, citations, texts


def first_delivery(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each rule once: its first delivery by arrival, then creation, then confidence. Only `columns` (and what orders
    them) are read; without any, all are."""
    r = load(spark, sf_dir, "rules")
    if columns:
        r = r.select(*dict.fromkeys(("rule_id", *columns, "received_at", "generated_at", "confidence")))
    return merge.best_per_key(r, "rule_id", ["received_at", "generated_at", "confidence"])


RULES = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY received_at NULLS FIRST, generated_at NULLS FIRST, confidence NULLS FIRST) AS nth FROM rules) WHERE nth = 1)"""
_SPANS = """
c AS (SELECT DISTINCT rule_id, repo, c.path AS path, c.lines AS lines FROM (SELECT rule_id, repo, unnest(citations) AS c FROM rules)),
sp AS (SELECT repo, path, a, b FROM (SELECT DISTINCT repo, path, try_cast(split_part(lines, '-', 1) AS BIGINT) AS a, try_cast(split_part(lines, '-', 2) AS BIGINT) AS b FROM c WHERE regexp_full_match(lines, '[0-9]+-[0-9]+')) WHERE a >= 1 AND a <= b),
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cited spans (key, row, repo, path, start, end)."""
    c = citations(spark, sf_dir, "repo")
    a, b = X.range_start(F.col("lines")), X.range_end(F.col("lines"))
    s = c.select("repo", "path", a.alias("start"), b.alias("end")).where("start is not null").distinct()
    return s.withColumns({"key": F.concat_ws("|", "repo", "path"), "row": F.concat_ws("|", "repo", "path", "start", "end")})


# ---------------------------------------------------------------- merges


@query(f"""
WITH l AS (
  SELECT file_id, 'file.' || file_id AS id, repo, path, {_LANG} AS language, 'tree-sitter' AS origin, 'inferred' AS certainty, 0 AS layer, event_id AS pos FROM files_extracted
  UNION ALL SELECT file_id, 'file.' || file_id, repo, path, language, 'extractor', CASE WHEN facts > 35 THEN 'proved' ELSE 'inferred' END, 1, event_id FROM files_extracted),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN certainty = 'proved' THEN 3 WHEN origin <> 'tree-sitter' THEN 2 ELSE 1 END DESC, layer, pos) AS n FROM l)
SELECT id, repo, path, language, origin, certainty FROM k WHERE n = 1""")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' facts of two layers, merged by certainty, origin and order."""
    f = load(spark, sf_dir, "files_extracted")
    key = F.concat(F.lit("file."), F.col("file_id").cast("string")).alias("id")
    parsed = f.select(key, "repo", "path", X.language_of(F.col("path")).alias("language"), F.lit("tree-sitter").alias("origin"), F.lit("inferred").alias("certainty"), F.col("event_id").alias("pos"))
    told = f.select(key, "repo", "path", "language", F.lit("extractor").alias("origin"), F.when(F.col("facts") > 35, "proved").otherwise("inferred").alias("certainty"), F.col("event_id").alias("pos"))
    return merge.merge_facts([parsed, told]).select("id", "repo", "path", "language", "origin", "certainty")


@query("""
SELECT kind, count(*) AS n FROM (
  SELECT 'file' AS kind FROM files_extracted UNION ALL SELECT 'chunk' FROM chunks UNION ALL SELECT 'rule' FROM rules UNION ALL SELECT 'output' FROM reduce_out) GROUP BY kind""")
def fact_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by kind."""
    kinds = {"file": "files_extracted", "chunk": "chunks", "rule": "rules", "output": "reduce_out"}
    parts = [load(spark, sf_dir, t).select(F.lit(k).alias("kind")) for k, t in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("""
SELECT file_id, event_id, path, facts FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY extracted_at NULLS FIRST, event_id) AS n FROM files_extracted) WHERE n = 1""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each file."""
    f = load(spark, sf_dir, "files_extracted")
    return merge.best_per_key(f, "file_id", ["extracted_at", "event_id"]).select("file_id", "event_id", "path", "facts")


@query(f"""
WITH {RULES},
u AS (SELECT repo, domain, requirement, rule_id, title, unnest(coalesce(citations, [])) AS c FROM r),
g AS (SELECT repo, domain, requirement, min(rule_id) AS rule_id, arg_min(title, rule_id) FILTER (WHERE true) AS t, count(*) AS n FROM r GROUP BY ALL),
d AS (SELECT DISTINCT repo, domain, requirement, c.path AS path, c.lines AS lines FROM u),
l AS (SELECT repo, domain, requirement, string_agg(coalesce(path, '?') || ':' || coalesce(lines, '?'), ' ' ORDER BY path NULLS FIRST, lines NULLS FIRST) AS cited FROM d GROUP BY ALL)
SELECT g.rule_id, coalesce(l.cited, '') AS cited FROM g LEFT JOIN l ON g.repo IS NOT DISTINCT FROM l.repo AND g.domain IS NOT DISTINCT FROM l.domain AND g.requirement IS NOT DISTINCT FROM l.requirement""")
def merge_citation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one requirement in a domain made one, with all their citations."""
    r = first_delivery(spark, sf_dir, "repo", "domain", "requirement", "title", "citations").select("repo", "domain", "requirement", "rule_id", "title", "citations")
    m = merge.merge_by_requirement(r, ["repo", "domain"], ["rule_id"])
    text = F.transform("citations", lambda c: F.concat(F.coalesce(c["path"], F.lit("?")), F.lit(":"), F.coalesce(c["lines"], F.lit("?"))))
    return m.select("rule_id", F.coalesce(F.array_join(text, " "), F.lit("")).alias("cited"))


@query()
def slug_suffixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made unique within a repository's domain, in rule order."""
    r = first_delivery(spark, sf_dir, "repo", "domain", "slug", "title").select("rule_id", "repo", "domain", X.slug_words(F.coalesce("slug", "title", F.lit("rule"))).alias("slug"))
    return merge.name_uniquely(r, ["repo", "domain"], "slug", ["rule_id"], "unique_slug")


@query("""
SELECT 'only_rules' AS part, x.domain FROM (SELECT DISTINCT domain FROM rules EXCEPT SELECT DISTINCT domain FROM chunks) x
UNION ALL SELECT 'only_chunks', x.domain FROM (SELECT DISTINCT domain FROM chunks EXCEPT SELECT DISTINCT domain FROM rules) x
UNION ALL SELECT 'any', x.domain FROM (SELECT domain FROM rules UNION SELECT domain FROM chunks) x""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of rules and chunks: differences and union."""
    a, b = load(spark, sf_dir, "rules").select("domain").distinct(), load(spark, sf_dir, "chunks").select("domain").distinct()
    part = lambda name, df: df.select(F.lit(name).alias("part"), "domain")
    return part("only_rules", a.subtract(b)).union(part("only_chunks", b.subtract(a))).union(part("any", a.union(b).distinct()))


# ---------------------------------------------------------------- joins


@query("""
WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'),
d AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'signup'),
f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id FROM m GROUP BY user_id),
j AS (SELECT d.event_id AS row, d.user_id, max((m.ts, m.event_id)) FILTER (WHERE m.ts <= d.ts) AS best FROM d LEFT JOIN m ON d.user_id = m.user_id GROUP BY d.event_id, d.user_id)
SELECT j.row AS event_id, coalesce(j.best[2], f.first_id) AS signup_id FROM j LEFT JOIN f ON j.user_id = f.user_id""")
def asof_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup at or before each other event, else the user's first."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    modules = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("signup_id"))
    others = e.where("event_type <> 'signup'").select(F.col("event_id").alias("row"), "user_id", "ts")
    return joins.as_of(others, modules, "user_id", "ts", "start", "signup_id").select(F.col("row").alias("event_id"), "signup_id")


_INSIDE = "i.repo IS NOT DISTINCT FROM o.repo AND i.path = o.path AND o.a <= i.a AND i.b <= o.b AND NOT (o.a = i.a AND o.b = i.b)"


@query(f"""
WITH {_SPANS} x AS (SELECT i.repo, i.path, i.a, i.b, arg_min((o.a, o.b), (o.b - o.a, o.a)) AS c FROM sp i JOIN sp o ON {_INSIDE} GROUP BY i.repo, i.path, i.a, i.b)
SELECT repo, path, a AS first_line, b AS last_line, c[1] AS container_first, c[2] AS container_last FROM x""")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest cited span around each cited span."""
    s = spans(spark, sf_dir)
    c = joins.containers(s)
    o = s.select(F.col("row").alias("container"), F.col("start").alias("container_first"), F.col("end").alias("container_last"))
    return s.join(c, "row").join(o, "container").select("repo", "path", F.col("start").alias("first_line"), F.col("end").alias("last_line"), "container_first", "container_last")


@query(f"WITH {_SPANS} z AS (SELECT 1) SELECT repo, path, a AS first_line, b AS last_line FROM sp i WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE {_INSIDE})")
def top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited spans that no other one contains."""
    return joins.top_level(spans(spark, sf_dir)).select("repo", "path", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


@query(f"""
WITH {_SPANS} t AS (SELECT * FROM sp i WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE {_INSIDE})),
h AS (SELECT o.repo, o.path, o.a AS pa, o.b AS pb, i.a, i.b FROM sp i JOIN t o ON {_INSIDE})
SELECT repo, path, pa AS parent_first, pb AS parent_last, a AS child_first, b AS child_last FROM h x WHERE NOT EXISTS (
  SELECT 1 FROM h y WHERE x.repo IS NOT DISTINCT FROM y.repo AND x.path = y.path AND x.pa = y.pa AND x.pb = y.pb AND y.a <= x.a AND x.b <= y.b AND NOT (y.a = x.a AND y.b = x.b))""")
def direct_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans directly below the top-level ones."""
    s = spans(spark, sf_dir)
    pairs = joins.direct_children(s, joins.top_level(s))
    p = s.select(F.col("row").alias("parent"), "repo", "path", F.col("start").alias("parent_first"), F.col("end").alias("parent_last"))
    c = s.select(F.col("row").alias("child"), F.col("start").alias("child_first"), F.col("end").alias("child_last"))
    return pairs.join(p, "parent").join(c, "child").select("repo", "path", "parent_first", "parent_last", "child_first", "child_last")


_CHUNKS = "ch AS (SELECT DISTINCT id, repo, path, start_line, end_line, language FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL)"


@query(f"""
WITH {_SPANS} {_CHUNKS}
SELECT sp.repo, sp.path, a AS first_line, b AS last_line, ch.id AS chunk_id FROM sp JOIN ch ON sp.repo = ch.repo AND sp.path = ch.path AND a <= end_line AND b >= start_line GROUP BY ALL""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that each cited span overlaps."""
    s = spans(spark, sf_dir).where("repo is not null")
    c = load(spark, sf_dir, "chunks").where("start_line is not null and end_line is not null and repo is not null").select(F.concat_ws("|", "repo", "path").alias("key"), "id", "start_line", "end_line").distinct()
    return joins.overlap(s, c, "key", "start", "end", "start_line", "end_line").select("repo", "path", F.col("start").alias("first_line"), F.col("end").alias("last_line"), F.col("id").alias("chunk_id")).distinct()


@query(f"""
WITH {_SPANS} {_CHUNKS}
SELECT repo, path, a AS first_line, b AS last_line FROM sp WHERE EXISTS (SELECT 1 FROM ch WHERE sp.repo = ch.repo AND sp.path = ch.path AND ch.language = 'php' AND a <= end_line AND b >= start_line)""")
def grounding_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited spans that overlap a PHP chunk."""
    s = spans(spark, sf_dir).where("repo is not null")
    c = load(spark, sf_dir, "chunks").where("language = 'php' and start_line is not null and end_line is not null and repo is not null").select(F.concat_ws("|", "repo", "path").alias("key"), "start_line", "end_line")
    return joins.overlap(s, c, "key", "start", "end", "start_line", "end_line", "left_semi").select("repo", "path", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


@query("""
WITH t AS (SELECT DISTINCT slug FROM rules WHERE slug IS NOT NULL), n AS (SELECT DISTINCT domain FROM rules WHERE domain IS NOT NULL)
SELECT slug, domain FROM t JOIN n ON contains(slug, domain)""")
def substring_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that contain a domain's name."""
    r = load(spark, sf_dir, "rules")
    return joins.contains_link(r.select("slug").where("slug is not null").distinct(), r.select("domain").where("domain is not null").distinct(), "slug", "domain")


_SEGS = r"list_filter(list_transform(regexp_split_to_array({0}, '\\+|::|/'), lambda x: trim(x)), lambda x: x <> '')"
_MODULES = f"""
ns AS (SELECT DISTINCT namespace, domain FROM chunks WHERE namespace <> '' AND domain IS NOT NULL),
mods AS (SELECT DISTINCT array_to_string({_SEGS.format('namespace')}, '/') AS key, domain FROM ns),
imp AS (SELECT DISTINCT split_part(path, '/', 1) AS from_domain, CASE WHEN language = 'php' THEN namespace || '\\Type' ELSE 'corp/pkg/' || namespace END AS target FROM chunks WHERE namespace <> '' AND language IN ('php', 'go') AND path NOT LIKE '.%'),
t AS (SELECT from_domain, target, {_SEGS.format('target')} AS parts FROM imp WHERE target <> ''),
pre AS (SELECT from_domain, target, n, array_to_string(parts[1:n], '/') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM t)),
best AS (SELECT from_domain, target, arg_min(m.domain, (-n, m.domain)) AS to_domain FROM pre JOIN mods m ON pre.key = m.key GROUP BY from_domain, target),
suf AS (SELECT from_domain, target, array_to_string(parts[n:], '/') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM t)),
agreed AS (SELECT from_domain, target, min(m.domain) AS to_domain FROM suf JOIN mods m ON suf.key = m.key GROUP BY from_domain, target HAVING min(m.domain) = max(m.domain))
"""


def _modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "chunks")
    mods = c.where("namespace <> '' and domain is not null").select(F.col("namespace").alias("name"), "domain").distinct()
    target = F.when(F.col("language") == "php", F.concat("namespace", F.lit("\\Type"))).otherwise(F.concat(F.lit("corp/pkg/"), F.col("namespace")))
    imports = c.where("namespace <> '' and language in ('php', 'go') and path not like '.%'").select(F.substring_index("path", "/", 1).alias("from_domain"), target.alias("target")).distinct()
    return mods, imports.withColumn("row", F.sha2(F.concat_ws("|", F.coalesce("from_domain", F.lit("?")), "target"), 256))


@query(f"WITH {_MODULES} SELECT from_domain, target, to_domain FROM best")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of the longest module name that begins each import's target."""
    mods, imports = _modules(spark, sf_dir)
    table = mods.select(F.array_join(X.segments(F.col("name")), "/").alias("key"), F.col("domain").alias("to_domain")).distinct()
    return imports.join(joins.longest_prefix(imports.withColumn("parts", X.segments(F.col("target"))), table, "row", "parts", "key", "to_domain"), "row").drop("row")


@query(f"WITH {_MODULES} SELECT from_domain, target, to_domain FROM agreed")
def unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one domain of the module names that end each import's target."""
    mods, imports = _modules(spark, sf_dir)
    table = mods.select(F.array_join(X.segments(F.col("name")), "/").alias("key"), F.col("domain").alias("to_domain")).distinct()
    return imports.join(joins.unique_suffix(imports.withColumn("parts", X.segments(F.col("target"))), table, "row", "parts", "key", "to_domain"), "row").drop("row")


@query(f"""WITH {_MODULES},
al AS (SELECT from_domain, to_domain FROM best UNION SELECT a.from_domain, a.to_domain FROM agreed a LEFT JOIN best b ON a.from_domain IS NOT DISTINCT FROM b.from_domain AND a.target = b.target WHERE b.target IS NULL)
SELECT DISTINCT 'domain.' || from_domain AS src, 'depends_on' AS type, 'domain.' || to_domain AS dst FROM al
WHERE from_domain <> to_domain AND to_domain IN (SELECT domain FROM rules)""")
def domain_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between domains that have rules."""
    mods, imports = _modules(spark, sf_dir)
    known = load(spark, sf_dir, "rules").select("domain").union(imports.select("from_domain"))
    return graph.domain_dependencies(imports, mods, known)


# ---------------------------------------------------------------- aggregations


@query(f"WITH {RULES} SELECT nature, origin, count(*) AS n FROM r WHERE nature <> '' OR origin <> '' GROUP BY nature, origin")
def rules_by_nature_and_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(spark, sf_dir, "nature", "origin").where("nature <> '' or origin <> ''").groupBy("nature", "origin").agg(F.count("*").alias("n"))


@query("""
SELECT type, count(*) AS n FROM (
  SELECT DISTINCT 'domain' AS type, domain AS id FROM rules UNION SELECT 'rule', rule_id::VARCHAR FROM rules
  UNION SELECT 'entity', unnest(entities) FROM rules UNION SELECT 'endpoint', unnest(endpoints) FROM rules) GROUP BY type""")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nodes by type."""
    r = load(spark, sf_dir, "rules")
    ids = r.select(F.lit("domain").alias("type"), F.col("domain").alias("id")).union(r.select(F.lit("rule"), F.col("rule_id").cast("string"))).union(r.select(F.lit("entity"), F.explode("entities"))).union(r.select(F.lit("endpoint"), F.explode("endpoints")))
    return ids.distinct().groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT repo, count(*) AS total, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE NOT failed) AS done FROM reduce_out GROUP BY repo")
def failure_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs done and failed by repository."""
    return load(spark, sf_dir, "reduce_out").groupBy("repo").agg(F.count("*").alias("total"), F.count_if("failed").alias("n_failed"), F.count_if(~F.col("failed")).alias("done"))


@query(f"""WITH {RULES}, n AS (SELECT repo, domain, rule_id, (row_number() OVER (PARTITION BY repo, domain ORDER BY rule_id) - 1) // 30 AS batch FROM r)
SELECT repo, domain, batch, count(*) AS n, min(rule_id) AS first_rule FROM n GROUP BY ALL""")
def candidates_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 30 candidates of each repository's domain."""
    r = first_delivery(spark, sf_dir, "repo", "domain").select("repo", "domain", "rule_id")
    return windows.batches(r, ["repo", "domain"], ["rule_id"], 30).groupBy("repo", "domain", "batch").agg(F.count("*").alias("n"), F.min("rule_id").alias("first_rule"))


@query(f"WITH {RULES}, e AS (SELECT repo, unnest(list_concat(coalesce(entities, []), coalesce(endpoints, []))) AS id FROM r) SELECT repo, count(DISTINCT id) AS n, string_agg(DISTINCT id, ' ' ORDER BY id) AS ids FROM e GROUP BY repo")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct entity and endpoint ids of each repository."""
    none = F.array().cast("array<string>")
    r = load(spark, sf_dir, "rules").select("repo", F.explode(F.concat(F.coalesce("entities", none), F.coalesce("endpoints", none))).alias("id")).where("id is not null").distinct()
    return r.groupBy("repo").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))


@query(f"""WITH {RULES}, g AS (SELECT domain AS name, count(*) AS n FROM r WHERE domain IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS i FROM g)
SELECT name, n FROM k WHERE i <= 7 UNION ALL SELECT 'more ' || count(*), sum(n)::BIGINT FROM k WHERE i > 7 HAVING count(*) > 0""")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven largest domains and the rest."""
    g = first_delivery(spark, sf_dir, "domain").where("domain is not null").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("n"))
    return windows.top_with_rest(g, "name", "n")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 6")
def last_n_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six events of each user."""
    return windows.last_n(load(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("event_id", "user_id")


# ---------------------------------------------------------------- graph


@query(f"""WITH {RULES}, k AS (SELECT *, 'rule.' || domain || '.' || slug AS src FROM r WHERE domain IS NOT NULL AND slug IS NOT NULL)
SELECT src, type, dst, count(*) AS n FROM (
  SELECT src, 'belongs_to' AS type, 'domain.' || domain AS dst, rule_id FROM k
  UNION ALL SELECT src, 'touches', unnest(list_distinct(coalesce(entities, []))), rule_id FROM k
  UNION ALL SELECT src, 'exposed_by', unnest(list_distinct(coalesce(endpoints, []))), rule_id FROM k) GROUP BY ALL""")
def edges_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of rules, with how many rules of one id have them."""
    r = first_delivery(spark, sf_dir, "domain", "slug", "entities", "endpoints").where("domain is not null and slug is not null")
    return graph.rule_edges(r).groupBy("src", "type", "dst").agg(F.count("*").alias("n"))


@query(f"""WITH {RULES}, k AS (SELECT *, 'rule.' || domain || '.' || slug AS src FROM r WHERE domain IS NOT NULL AND slug IS NOT NULL),
n AS (SELECT DISTINCT unnest(entities) AS id FROM r WHERE crosscheck = 'supported')
SELECT DISTINCT src AS node_id, 'edge touches points to missing node ' || e AS detail FROM (SELECT src, unnest(entities) AS e FROM k) WHERE e NOT IN (SELECT id FROM n)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to entities that no supported rule names."""
    r = first_delivery(spark, sf_dir, "domain", "slug", "entities", "endpoints", "crosscheck")
    known = r.where("crosscheck = 'supported'").select(F.explode("entities").alias("id")).distinct()
    edges = graph.rule_edges(r.where("domain is not null and slug is not null")).where("type = 'touches'")
    return checks.dangling_edges(edges, known).select("node_id", "detail").distinct()


@query("SELECT rule_id AS node_id, count(*) - 1 AS repeats FROM rules GROUP BY rule_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of rule ids beyond the first."""
    return checks.duplicate_ids(load(spark, sf_dir, "rules"), "rule_id").groupBy("node_id").agg(F.count("*").alias("repeats"))


@query("""
WITH c AS (SELECT DISTINCT rule_id, repo, c.path AS path, c.lines AS lines FROM (SELECT rule_id, repo, unnest(citations) AS c FROM rules)),
f AS (SELECT repo, path, max(n_lines) AS n FROM files_extracted WHERE n_lines IS NOT NULL GROUP BY repo, path),
v AS (SELECT c.*, CASE WHEN regexp_full_match(lines, '[0-9]+-[0-9]+') THEN try_cast(split_part(lines, '-', 1) AS BIGINT) END AS a, CASE WHEN regexp_full_match(lines, '[0-9]+-[0-9]+') THEN try_cast(split_part(lines, '-', 2) AS BIGINT) END AS b, f.n
  FROM c LEFT JOIN f ON c.repo = f.repo AND c.path = f.path)
SELECT rule_id, path, lines, CASE WHEN path IS NULL OR path = '' OR starts_with(path, '/') OR regexp_matches(path, '^(\\./)*\\.\\.(/|$)') THEN 'escapes'
  WHEN NOT coalesce(a >= 1 AND a <= b, false) THEN 'invalid' WHEN n IS NULL THEN 'missing' WHEN b > n THEN 'exceeds' ELSE 'ok' END AS state FROM v""")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each citation resolves to lines of an extracted file of its repository."""
    c = citations(spark, sf_dir, "repo")
    counts = load(spark, sf_dir, "files_extracted").where("n_lines is not null").groupBy("repo", "path").agg(F.max("n_lines").cast("bigint").alias("n_lines"))
    sep = "\x1f"
    keyed = c.withColumn("real", F.col("path")).withColumn("path", F.when((F.col("path") != "") & ~F.col("path").startswith("/") & ~F.regexp_like("path", F.lit(r"^(\./)*\.\.(/|$)")), F.concat_ws(sep, "path", "repo")).otherwise(F.col("path")))
    r = checks.resolve_citations(keyed, counts.select(F.concat_ws(sep, "path", "repo").alias("path"), "n_lines"))
    p = F.col("problem")
    state = F.when(p.isNull(), "ok").when(p.endswith("escapes the source root"), "escapes").when(p.startswith("invalid"), "invalid").when(p.endswith("not found under source root"), "missing").otherwise("exceeds")
    return r.select("rule_id", F.col("real").alias("path"), "lines", state.alias("state"))


@query(f"WITH {RULES} SELECT rule_id FROM r WHERE len(coalesce(citations, [])) = 0")
def missing_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without a citation."""
    nodes = first_delivery(spark, sf_dir, "citations").select(F.col("rule_id").alias("id"), F.lit("rule").alias("type"), F.col("citations").alias("sources"))
    return checks.uncited_rules(nodes).select(F.col("node_id").alias("rule_id"))


@query(f"""WITH {RULES}, k AS (SELECT * FROM r WHERE domain IS NOT NULL AND slug IS NOT NULL),
ids AS (SELECT DISTINCT 'entity' AS type, unnest(entities) AS id FROM k UNION SELECT 'endpoint', unnest(endpoints) FROM k),
used AS (SELECT DISTINCT unnest(list_concat(coalesce(entities, []), coalesce(endpoints, []))) AS id FROM k WHERE crosscheck = 'supported')
SELECT count(*) FILTER (WHERE type = 'endpoint') AS endpoints_total, count(*) FILTER (WHERE type = 'endpoint' AND u.id IS NOT NULL) AS endpoints_referenced,
  count(*) FILTER (WHERE type = 'entity') AS entities_total, count(*) FILTER (WHERE type = 'entity' AND u.id IS NOT NULL) AS entities_touched FROM ids LEFT JOIN used u ON ids.id = u.id""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and endpoints in all, and those that supported rules reach."""
    r = first_delivery(spark, sf_dir, "domain", "slug", "entities", "endpoints", "crosscheck").where("domain is not null and slug is not null")
    nodes = r.select(F.lit("entity").alias("type"), F.explode("entities").alias("id")).union(r.select(F.lit("endpoint"), F.explode("endpoints"))).distinct()
    return graph.coverage(nodes, graph.rule_edges(r.where("crosscheck = 'supported'")))


_DRIFT = """
WITH f AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(text) ELSE text END AS text FROM f WHERE doc_id % 10 <> 0),
d AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 3 THEN left(sha256('d' || doc_id || '|1-3' || chr(10) || array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10)), 16) END AS digest FROM f),
e AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 3 THEN left(sha256('d' || doc_id || '|1-3' || chr(10) || array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10)), 16) END AS digest FROM m)
SELECT d.doc_id, d.digest, CASE WHEN d.digest IS NULL THEN 'unknown' WHEN e.digest IS NULL THEN 'broken' WHEN d.digest = e.digest THEN 'ok' ELSE 'stale' END AS status FROM d LEFT JOIN e ON d.doc_id = e.doc_id"""


def _drifted(d: DataFrame) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    cited = d.select("doc_id", path, F.lit("1-3").alias("lines"))
    before = checks.digests(cited, d.select(path, F.col("text").alias("content")), "doc_id")
    changed = d.where("doc_id % 10 <> 0").select(path, F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text")).alias("content"))
    now = checks.digests(cited, changed, "doc_id")
    return checks.drift(before, now, "doc_id").join(before, "doc_id").select("doc_id", "digest", "status")


@query(_DRIFT)
def digest_and_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's first three lines, and their drift against a changed copy. Lines end at a newline;
    a CR before it is text, as in the cited file."""
    return _drifted(texts(spark, sf_dir))


@query(f"""WITH d AS ({_DRIFT}), c AS (SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'broken') AS broken, count(*) FILTER (WHERE status = 'unknown') AS unknown FROM d)
SELECT *, stale + broken > 0 AS drifted FROM c""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of drift counts."""
    return checks.drift_report(digest_and_drift(spark, sf_dir))


@query("""
WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ls, src, a, b FROM f, (VALUES (0, 3, 5), (1, 20, 22), (2, 60, 61)) AS v(src, a, b)),
l AS (SELECT doc_id, src, unnest(range(greatest(1, a - 10), least(b + 10, len(ls)) + 1)) AS line_no, a, b, ls FROM w WHERE greatest(1, a - 10) <= least(b + 10, len(ls))),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, line_no) AS k FROM l)
SELECT doc_id, src, line_no, lpad(line_no::VARCHAR, 5, ' ') || ' ' || CASE WHEN line_no BETWEEN a AND b THEN '>' ELSE '·' END || ' ' || ls[line_no] AS line FROM n WHERE k <= 40""")
def excerpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of three spans of each document, with context, within 40 lines; a CR before a newline stays."""
    return _excerpts(texts(spark, sf_dir))


def _excerpts(d: DataFrame) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    three = F.array(*(F.struct(F.lit(k).alias("src"), F.lit(v).alias("lines")) for k, v in enumerate(("3-5", "20-22", "60-61"))))
    cited = d.select("doc_id", path, F.explode(three).alias("x")).select("doc_id", "path", "x.*")
    out = checks.excerpt(cited, d.select(path, F.col("text").alias("content")), "doc_id", budget=40)
    return out.select("doc_id", "src", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("""
WITH t AS (SELECT DISTINCT rule_id, domain, list_distinct(list_filter(regexp_extract_all(lower(requirement), '([\\p{L}\\p{N}]+)', 1), lambda w: length(w) >= 3)) AS ws FROM rules WHERE requirement IS NOT NULL),
w AS (SELECT rule_id, domain, len(ws) AS n, unnest(ws) AS word FROM t),
i AS (SELECT a.rule_id AS a, b.rule_id AS b, a.domain AS da, b.domain AS db, a.n AS na, b.n AS nb, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.rule_id < b.rule_id GROUP BY ALL)
SELECT a, b, round(c / (na + nb - c), 6) AS similarity FROM i WHERE c / (na + nb - c) >= 0.8 ORDER BY c / (na + nb - c) DESC, a, b LIMIT 20""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty closest pairs of near-duplicate requirements (a top-k report)."""
    pairs = similar.closest(similar.near_classes(_requirement_sets(spark, sf_dir)), 20)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _requirement_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "rules").where("requirement is not null").groupBy("rule_id").agg(F.min("requirement").alias("requirement"))
    return r.select(F.col("rule_id").alias("row"), X.word_set(F.col("requirement")).alias("words"))


@query("""
WITH t AS (SELECT rule_id, any_value(domain) AS domain, any_value(list_distinct(list_filter(regexp_extract_all(lower(requirement), '([\\p{L}\\p{N}]+)', 1), lambda w: length(w) >= 3))) AS ws FROM rules WHERE requirement IS NOT NULL GROUP BY rule_id),
w AS (SELECT rule_id, domain, len(ws) AS n, unnest(ws) AS word FROM t),
i AS (SELECT a.rule_id AS a, b.rule_id AS b, a.domain AS da, b.domain AS db, a.n AS na, b.n AS nb, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.rule_id < b.rule_id GROUP BY ALL)
SELECT count(*) FILTER (WHERE da = db) AS intra, count(*) FILTER (WHERE da <> db) AS across FROM i WHERE c / (na + nb - c) >= 0.8""")
def duplicates_intra_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs within a domain and across domains."""
    domains = load(spark, sf_dir, "rules").groupBy(F.col("rule_id").alias("row")).agg(F.min("domain").alias("label"))
    return similar.count_pairs(similar.near_classes(_requirement_sets(spark, sf_dir)), domains).select(F.col("same").alias("intra"), F.col("different").alias("across"))


@query(f"""WITH {RULES}, k AS (SELECT rule_id, repo, {SLUG.format("coalesce(repo, '')")} AS rs, entities, endpoints FROM r)
SELECT DISTINCT e AS id, 'nodes/entities/' || regexp_replace(e, '^entity\\.', '') || '.md' AS file, replace(regexp_replace(e, '^entity\\.', ''), '-', '_') AS mermaid FROM (SELECT unnest(entities) AS e FROM k)""")
def node_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and diagram ids of entities."""
    e = load(spark, sf_dir, "rules").select(F.explode("entities").alias("id")).distinct()
    return e.select("id", X.node_file(F.lit("entity"), F.col("id")).alias("file"), X.mermaid_id(F.regexp_replace("id", r"^entity\.", "")).alias("mermaid"))


@query("SELECT replace(lower(r_name), ' ', '_') || ' --> ' || replace(lower(n_name), ' ', '_') AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagram line for each edge."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    name = lambda c: X.mermaid_id(F.replace(F.lower(c), F.lit(" "), F.lit("-")))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(name(F.col("r_name")), F.lit(" --> "), name(F.col("n_name"))).alias("line"))


