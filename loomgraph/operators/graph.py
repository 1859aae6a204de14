"""Building the graph's nodes and edges from facts and reduced rules; relating domains; checking the result.

nodes: (id, type, title, body, sources array<struct<path,lines>>, extra map<string,string>); edges: (src, type, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import joins

#: The labels of node bodies by language.
LABELS = {
    "fr": {"table": "Table", "columns": "Colonnes", "method": "Méthode", "requirement": "Exigence (EARS)", "rationale": "Justification", "criteria": "Critères d'acceptation", "rules": "Règles", "domain": "Domaine", "links": "Liens"},
    "en": {"table": "Table", "columns": "Columns", "method": "Method", "requirement": "Requirement (EARS)", "rationale": "Rationale", "criteria": "Acceptance criteria", "rules": "Rules", "domain": "Domain", "links": "Links"},
}
#: The order of edge types.
EDGE_ORDER = {"belongs_to": 0, "touches": 1, "exposed_by": 2}
_NO_SOURCES = "cast(array() as array<struct<path:string,lines:string>>)"
_NO_EXTRA = "cast(map() as map<string,string>)"


def entity_nodes(facts: DataFrame, lang: str = "fr") -> DataFrame:
    t = LABELS[lang]
    name = F.coalesce(F.nullif(F.try_element_at("attrs", F.lit("name")), F.lit("")), F.regexp_replace("id", r"^table\.", ""))
    listed = F.array_join(F.transform(X.columns_of(F.try_element_at("attrs", F.lit("columns"))), lambda c: F.concat(F.lit("\n- `"), c, F.lit("`"))), "")
    body = F.concat(F.lit(f"**{t['table']}** : `"), name, F.lit(f"`\n\n**{t['columns']}** :"), listed)
    return facts.where("kind = 'table'").select(X.entity_id(name).alias("id"), F.lit("entity").alias("type"), name.alias("title"), body.alias("body"), F.array("source").alias("sources"), F.expr(_NO_EXTRA).alias("extra"))


def endpoint_nodes(facts: DataFrame, lang: str = "fr") -> DataFrame:
    t = LABELS[lang]
    verb, path = X.route_verb(F.col("attrs")), F.coalesce(F.try_element_at("attrs", F.lit("path")), F.lit(""))
    handler = X.route_handler(F.col("attrs"))
    body = F.concat(F.lit(f"**{t['method']}** : "), F.upper(verb), F.lit("\n\n**Path** : `"), path, F.lit("`"), F.when(handler != "", F.concat(F.lit("\n\n**Handler** : `"), handler, F.lit("`"))).otherwise(""))
    return facts.where("kind = 'route'").select(X.endpoint_id(verb, path).alias("id"), F.lit("endpoint").alias("type"), F.concat(F.upper(verb), F.lit(" "), path).alias("title"), body.alias("body"), F.array("source").alias("sources"), F.expr(_NO_EXTRA).alias("extra"))


def rule_nodes(rules: DataFrame, lang: str = "fr") -> DataFrame:
    """rules: (domain, slug, title, ears_kind, requirement, rationale, citations, entities, endpoints, acceptance_criteria, nature, origin, confidence)."""
    t = LABELS[lang]
    criteria = F.array_join(F.transform("acceptance_criteria", lambda c, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), F.coalesce(c, F.lit("")))), "")
    some = F.coalesce(F.size("acceptance_criteria") > 0, F.lit(False))
    body = F.concat(
        F.lit(f"**{t['requirement']}** : "),
        F.coalesce("requirement", F.lit("")),
        F.when(F.coalesce("rationale", F.lit("")) != "", F.concat(F.lit(f"\n\n**{t['rationale']}** : "), F.col("rationale"))).otherwise(""),
        F.when(some, F.concat(F.lit(f"\n\n**{t['criteria']}** :"), criteria)).otherwise(""),
    )
    extra = F.create_map(
        *(x for k, v in (("ears", F.coalesce("ears_kind", F.lit(""))), ("acceptance", F.coalesce(F.size("acceptance_criteria"), F.lit(0)).cast("string")), ("nature", F.coalesce("nature", F.lit(""))), ("origin", F.coalesce("origin", F.lit(""))), ("confidence", F.coalesce(X.two_decimals(F.col("confidence")), F.lit("0.00")))) for x in (F.lit(k), v))
    )
    return rules.select(F.concat(F.lit("rule."), F.col("domain"), F.lit("."), F.col("slug")).alias("id"), F.lit("rule").alias("type"), F.coalesce("title", F.lit("")).alias("title"), body.alias("body"), F.array_sort(F.coalesce("citations", F.expr(_NO_SOURCES))).alias("sources"), extra.alias("extra"))


def domain_nodes(summaries: DataFrame, rules: DataFrame, lang: str = "fr") -> DataFrame:
    """summaries: (domain, domain_summary). A domain's page lists its rules by slug."""
    t = LABELS[lang]
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("](../rules/"), F.col("domain"), F.lit("."), F.col("slug"), F.lit(".md)"))
    lists = rules.select("domain", F.struct("slug", line.alias("line")).alias("x")).groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("list"))
    body = F.concat(F.coalesce("domain_summary", F.lit("")), F.lit(f"\n\n## {t['rules']}\n\n"), F.col("list"))
    return summaries.join(lists, "domain").select(F.concat(F.lit("domain."), F.col("domain")).alias("id"), F.lit("domain").alias("type"), F.col("domain").alias("title"), body.alias("body"), F.expr(_NO_SOURCES).alias("sources"), F.expr(_NO_EXTRA).alias("extra"))


def rule_edges(rules: DataFrame) -> DataFrame:
    """A rule belongs to its domain, touches each distinct entity and is exposed by each distinct endpoint."""
    src = F.concat(F.lit("rule."), F.col("domain"), F.lit("."), F.col("slug"))
    to = lambda kind, c: F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("dst")))
    own = F.array(F.struct(F.lit("belongs_to").alias("type"), F.concat(F.lit("domain."), F.col("domain")).alias("dst")))
    return rules.select(src.alias("src"), F.explode(F.concat(own, to("touches", F.col("entities")), to("exposed_by", F.col("endpoints")))).alias("e")).select("src", "e.type", "e.dst")


def edge_rank(kind):
    out = F.when(kind == "belongs_to", 0)
    return out.when(kind == "touches", 1).when(kind == "exposed_by", 2).otherwise(3)


def domain_dependencies(imports: DataFrame, modules: DataFrame, domains: DataFrame, depth: int = 1) -> DataFrame:
    """(src, type, dst) depends_on edges between domains that exist.

    imports: (row, from_domain, target); modules: (name, domain). The longest module name that begins the target's
    segments decides; without one, module names that end the target, if they agree on one domain.
    """
    parts = imports.withColumn("parts", X.segments(F.col("target")))
    table = modules.select(F.array_join(X.segments(F.col("name")), "/").alias("key"), F.col("domain").alias("to_domain")).where("key <> ''").distinct()
    first = joins.longest_prefix(parts, table, "row", "parts", "key", "to_domain")
    rest = parts.join(first.select("row"), "row", "left_anti")
    second = joins.unique_suffix(rest, table, "row", "parts", "key", "to_domain")
    linked = imports.select("row", "from_domain").join(first.unionByName(second), "row").select("from_domain", "to_domain").where("from_domain <> to_domain").distinct()
    known = domains.select("domain").distinct()
    kept = linked.join(known, linked["from_domain"] == known["domain"], "left_semi").join(known, linked["to_domain"] == known["domain"], "left_semi")
    return kept.select(F.concat(F.lit("domain."), F.col("from_domain")).alias("src"), F.lit("depends_on").alias("type"), F.concat(F.lit("domain."), F.col("to_domain")).alias("dst"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: endpoints and entities in total, and those that a rule's edges reach."""
    used = edges.where(F.col("src").startswith("rule.") & F.col("type").isin("touches", "exposed_by")).select(F.col("dst").alias("id"), F.lit(True).alias("used")).distinct()
    n = nodes.where(F.col("type").isin("endpoint", "entity")).select("id", "type").join(used, "id", "left")
    count = lambda kind, used: F.count_if((F.col("type") == kind) & (F.coalesce("used", F.lit(False)) if used else F.lit(True)))
    return n.agg(count("endpoint", False).alias("endpoints_total"), count("endpoint", True).alias("endpoints_referenced"), count("entity", False).alias("entities_total"), count("entity", True).alias("entities_touched"))
