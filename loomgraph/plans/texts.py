"""Queries of scalar functions, scans and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import windows
from ..tables import load
from .catalog import query

_EXT = "lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{g}'" for e, g in X.LANGUAGES.items()) + " ELSE '' END"
SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT {_LANG} AS language, count(DISTINCT file_id) AS n_files FROM files_extracted GROUP BY 1")
def scan_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the language of their extension."""
    f = load(spark, sf_dir, "files_extracted").select("file_id", "path").distinct()
    return f.withColumn("language", X.language_of(F.col("path"))).groupBy("language").agg(F.count_distinct("file_id").alias("n_files"))


@query("""
SELECT doc_id, contains(t, chr(0)) OR (length(t) - length(regexp_replace(t, '[\\x01-\\x08\\x0e-\\x1f\\x7f]', '', 'g'))) * 100 > length(t) * 30 AS is_binary
FROM (SELECT doc_id, left(coalesce(text, ''), 8000) AS t FROM documents)""")
def scan_binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document looks binary."""
    return load(spark, sf_dir, "documents").select("doc_id", X.looks_binary(F.col("text")).alias("is_binary"))


@query(r"""
SELECT DISTINCT file_id FROM files_extracted
WHERE len(list_filter(string_split(path, '/'), lambda x: (starts_with(x, '.') AND x NOT IN ('.', '..')) OR regexp_full_match(x, 'vendor|node_modules|third.party|[^/]*\.min\.[^/]*'))) = 0""")
def scan_exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left after exclusion by name and glob pattern."""
    f = load(spark, sf_dir, "files_extracted").select("file_id", "path")
    return f.where(~X.excluded(F.col("path"), ["vendor", "node_modules", "third?party", "*.min.*"])).select("file_id").distinct()


@query("""
WITH f AS (SELECT DISTINCT repo, path FROM files_extracted)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS walk_pos, row_number() OVER (PARTITION BY repo ORDER BY path) AS plain_pos FROM f""")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the order of a walk, folder by folder, and in plain order."""
    f = load(spark, sf_dir, "files_extracted").select("repo", "path").distinct()
    walked = windows.numbered(f.withColumn("__s", F.split("path", "/")), ["repo"], ["__s"], "walk_pos").drop("__s")
    return windows.numbered(walked, ["repo"], ["path"], "plain_pos")


@query(r"""
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS n_lines
FROM documents WHERE text IS NOT NULL""")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document."""
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.line_count(F.col("text")).alias("n_lines"))


@query(f"SELECT DISTINCT rule_id, {SLUG.format('title')} AS title_slug FROM rules WHERE title IS NOT NULL")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of titles."""
    return load(spark, sf_dir, "rules").where("title is not null").select("rule_id", X.slugify(F.col("title")).alias("title_slug")).distinct()


@query(f"SELECT DISTINCT rule_id, array_to_string(string_split({SLUG.format('coalesce(slug, title)')}, '-')[1:5], '-') AS short_slug FROM rules WHERE coalesce(slug, title) IS NOT NULL")
def slug_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of at most five words."""
    r = load(spark, sf_dir, "rules").select("rule_id", F.coalesce("slug", "title").alias("s")).where("s is not null")
    return r.select("rule_id", X.slug_words(F.col("s")).alias("short_slug")).distinct()


_SEGMENTS = r"list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '\\+|::|/'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT id, pos, s[pos] AS segment FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT DISTINCT id, {_SEGMENTS.format('namespace')} AS s FROM chunks))")
def split_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of namespaces."""
    c = load(spark, sf_dir, "chunks").select("id", X.segments(F.coalesce("namespace", F.lit(""))).alias("s")).distinct()
    return c.select("id", F.posexplode("s").alias("p", "segment")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "segment")


_PATH_DOMAIN = f"CASE WHEN strpos(p, '/') > 1 THEN {SLUG.format(chr(115) + 'plit_part(p, ' + repr('/') + ', 1)')} ELSE 'root' END"
_CLEAN = "regexp_replace(regexp_replace(coalesce(path, ''), '^\\./', ''), '^/', '')"


@query(f"SELECT file_id, event_id, {_PATH_DOMAIN} AS domain FROM (SELECT file_id, event_id, {_CLEAN} AS p FROM files_extracted)")
def domain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of paths."""
    return load(spark, sf_dir, "files_extracted").select("file_id", "event_id", X.domain_of_path(F.col("path")).alias("domain"))


def _namespace_sql(depth: int) -> str:
    inner = f"CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN {SLUG.format('s[1]')} ELSE {SLUG.format(f'array_to_string(s[2:{depth + 1}], ' + repr('-') + ')')} END"
    return f"SELECT DISTINCT id, namespace, {inner} AS domain FROM (SELECT id, namespace, {_SEGMENTS.format('namespace')} AS s FROM chunks)"


def _namespaces(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return load(spark, sf_dir, "chunks").select("id", "namespace", X.domain_of_namespace(F.col("namespace"), depth).alias("domain")).distinct()


@query(_namespace_sql(1))
def domain_namespace_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _namespaces(spark, sf_dir, 1)


@query(_namespace_sql(2))
def domain_namespace_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _namespaces(spark, sf_dir, 2)


@query(_namespace_sql(3))
def domain_namespace_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _namespaces(spark, sf_dir, 3)


@query(f"""
SELECT DISTINCT id, path, coalesce(nullif(CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN {SLUG.format('s[1]')} ELSE {SLUG.format('s[2]')} END, ''), {_PATH_DOMAIN}) AS domain
FROM (SELECT id, path, {_SEGMENTS.format('namespace')} AS s, {_CLEAN} AS p FROM chunks)""")
def domain_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespace's domain, else the path's."""
    return load(spark, sf_dir, "chunks").select("id", "path", X.domain(F.col("namespace"), F.col("path")).alias("domain")).distinct()


_RANGE = """
WITH c AS (SELECT DISTINCT rule_id, c.path AS path, c.lines AS lines FROM (SELECT rule_id, unnest(citations) AS c FROM rules)),
p AS (SELECT rule_id, path, lines, CASE WHEN regexp_full_match(lines, '[0-9]+-[0-9]+') THEN try_cast(split_part(lines, '-', 1) AS BIGINT) END AS a,
  CASE WHEN regexp_full_match(lines, '[0-9]+-[0-9]+') THEN try_cast(split_part(lines, '-', 2) AS BIGINT) END AS b FROM c),
"""


def citations(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Distinct (rule_id, ..., path, lines)."""
    r = load(spark, sf_dir, "rules")
    return r.select("rule_id", *more, F.explode("citations").alias("c")).select("rule_id", *more, "c.path", "c.lines").distinct()


@query(_RANGE + "v AS (SELECT *, coalesce(a >= 1 AND a <= b, false) AS ok FROM p) SELECT rule_id, path, lines, CASE WHEN ok THEN a END AS first_line, CASE WHEN ok THEN b END AS last_line, ok AS valid FROM v")
def parse_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of citations and whether they are valid."""
    a, b = X.range_start(F.col("lines")), X.range_end(F.col("lines"))
    return citations(spark, sf_dir).select("rule_id", "path", "lines", a.alias("first_line"), b.alias("last_line"), a.isNotNull().alias("valid"))


@query("SELECT DISTINCT id, left(sha256(path || ':' || start_line || '-' || end_line || chr(10) || content), 16) AS content_id FROM chunks WHERE path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL AND content IS NOT NULL")
def chunk_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of chunks."""
    c = load(spark, sf_dir, "chunks").where("path is not null and start_line is not null and end_line is not null and content is not null")
    return c.select("id", X.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("content_id")).distinct()


@query("""
WITH f AS (SELECT file_id, max(n_lines) AS n FROM files_extracted GROUP BY file_id),
w AS (SELECT file_id, n, unnest(range(1, greatest(1, n - 20) + 1, 230)) AS s FROM f WHERE n > 0)
SELECT file_id, s::BIGINT AS start_line, least(s + 249, n)::BIGINT AS end_line FROM w""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback windows of 250 lines with 20 of overlap."""
    f = load(spark, sf_dir, "files_extracted").groupBy("file_id").agg(F.max("n_lines").alias("n")).where("n > 0")
    w = f.select("file_id", F.explode(windows.line_windows(F.col("n"))).alias("w"))
    return w.select("file_id", F.col("w.start").cast("bigint").alias("start_line"), F.col("w.end").cast("bigint").alias("end_line"))


@query("""
SELECT DISTINCT id, sha256(array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: (s + i - 1)::VARCHAR || chr(9) || x), chr(10))) AS numbered_hash
FROM (SELECT id, content, coalesce(start_line, 1) AS s FROM chunks WHERE content IS NOT NULL)""")
def numbered_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the chunks' contents with line numbers."""
    c = load(spark, sf_dir, "chunks").where("content is not null")
    return c.select("id", F.sha2(X.numbered(F.col("content"), F.coalesce("start_line", F.lit(1))), 256).alias("numbered_hash")).distinct()


_IMPORT = "^(?:use|import)[ ]+([^\\n{(]+)"


@query(r"""
WITH l AS (SELECT DISTINCT id, unnest(string_split(content, chr(10))) AS line FROM chunks),
i AS (SELECT id, regexp_extract(line, '^(?:use|import)[ ]+([^\n{(]+)', 1) AS raw FROM l)
SELECT id, trim(regexp_replace(split_part(trim(raw), ' as ', 1), '["''`;]', '', 'g')) AS target, count(*) AS n FROM i WHERE raw <> '' GROUP BY ALL""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned targets of import lines."""
    line = load(spark, sf_dir, "chunks").select("id", F.explode(F.split("content", "\n")).alias("line")).distinct()
    raw = line.select("id", F.regexp_extract("line", r"^(?:use|import)[ ]+([^\n{(]+)", 1).alias("raw")).where("raw <> ''")
    return raw.groupBy("id", X.import_target(F.col("raw")).alias("target")).agg(F.count("*").alias("n"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't null."""
    return load(spark, sf_dir, "documents").where("text is not null")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_discount AS x, l_extendedprice AS y, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%.2f', x) AS discount, printf('%.2f', y * x) AS amount, (floor(x * 100)::BIGINT * 100 // (floor(q)::BIGINT + 1))::VARCHAR || '%' AS pct FROM v""")
def percent_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-decimal texts rounded from the exact binary value, and truncated percentages."""
    v = load(spark, sf_dir, "lineitem")
    part, total = F.floor(F.col("l_discount") * 100).cast("bigint"), F.floor("l_quantity").cast("bigint") + 1
    return v.select("l_orderkey", "l_linenumber", X.two_decimals(F.col("l_discount")).alias("discount"), X.two_decimals(F.col("l_extendedprice") * F.col("l_discount")).alias("amount"), X.percent(part, total).alias("pct"))


@query("""
SELECT doc_type, count(*) AS n, CASE WHEN sum(n_chars) >= 1000000 THEN printf('%.1fM', sum(n_chars) / 1e6) WHEN sum(n_chars) >= 1000 THEN (sum(n_chars) // 1000)::VARCHAR || 'k' ELSE sum(n_chars)::VARCHAR END AS shown
FROM documents GROUP BY doc_type""")
def token_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by type in short form."""
    d = load(spark, sf_dir, "documents").groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    return d.select("doc_type", "n", X.token_display(F.col("s")).alias("shown"))
