"""Queries of problem 4: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import skew
from ..tables import load
from .catalog import query

SHARE = 0.04


@query("""
WITH v AS (SELECT 'domain' AS field, domain AS key_value FROM rules UNION ALL SELECT 'slug', slug FROM rules)
SELECT field, key_value FROM v GROUP BY field, key_value HAVING count(*) > 0.04 * (SELECT count(*) FROM rules)""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of domain and slug on more than 4 % of the rows."""
    return skew.heavy_keys(load(spark, sf_dir, "rules"), ["domain", "slug"], SHARE).select("field", "key_value")


def _per_key_sql(key: str) -> str:
    return f"""
SELECT {key}, count(*) AS n_rows, count(*) FILTER (WHERE crosscheck = 'supported') AS n_supported, epoch_us(max(generated_at)) AS last_generated_us,
  count(DISTINCT repo) AS n_repos, count(DISTINCT rule_id) AS n_rules FROM rules GROUP BY {key}"""


def _per_key(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    rules = load(spark, sf_dir, "rules").select(key, "rule_id", "repo", "crosscheck", "generated_at")
    supported = F.when(F.col("crosscheck") == "supported", 1).otherwise(0).cast("bigint")
    out = skew.per_key(rules, key, {"n_supported": supported}, {"last_generated": F.col("generated_at")}, {"n_repos": "repo", "n_rules": "rule_id"}, share=0.01)
    return out.drop("heavy").withColumn("last_generated", F.unix_micros("last_generated")).withColumnRenamed("last_generated", "last_generated_us")


@query(_per_key_sql("domain"))
def p4_domain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-domain results, evenly worked."""
    return _per_key(spark, sf_dir, "domain")


@query(_per_key_sql("slug"))
def p4_slug_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-slug results, evenly worked."""
    return _per_key(spark, sf_dir, "slug")


@query("""
SELECT r.rule_id, r.domain, r.repo, d.n_rows AS domain_rows
FROM (SELECT rule_id, domain, repo, row_number() OVER (PARTITION BY rule_id ORDER BY received_at, generated_at) AS n FROM rules) r
LEFT JOIN (SELECT domain, count(*) AS n_rows FROM rules GROUP BY domain) d ON r.domain = d.domain WHERE r.n = 1""")
def p4_rules_with_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule with its domain's size: heavy domains by broadcast join, the others by shuffle, then union."""
    rules = load(spark, sf_dir, "rules").select("rule_id", "domain", "repo")
    sizes = load(spark, sf_dir, "rules").groupBy("domain").agg(F.count("*").alias("domain_rows")).where("domain is not null")
    return skew.skew_join(rules.dropDuplicates(["rule_id"]), sizes, "domain")
