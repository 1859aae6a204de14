"""Best representative of each duplicate group by iterative truth discovery.

Each row of a group claims a value for each field. In a round, the votes of a group's claims are weighed by their
sources' reliabilities, which gives each value its support; then a source's reliability is estimated as the (smoothed)
mean support of its claims, and the votes are weighed anew, until no reliability moves by more than a tolerance. The
value with the highest support is chosen. A field may have an order of preference that goes before the votes
(completeness, recency, trust): a claim's tier. Only the claims of a field's highest tier vote; votes decide among the
values that the tiers leave. Where the tiers leave one value in every group, nothing is contested and no round is run.

Only groups of several keys go past the first aggregation. Tiers, votes and supports are aggregates, combined before
the shuffle: a group of a third of all rows is no one task's list. Reliabilities are a table of one row per source,
joined, never collected. Values are compared by hash in the rounds; their texts are joined to the outcome.

Defined results: groups of fewer than two keys give no row; a field without an eligible claim is null; a key that claims
a value twice counts once; null or blank requirement is in no group; supports that agree to nine decimals are equal, the
smaller value goes first. If the last round still moves a reliability by more than the tolerance, a warning says so.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Cut, cut

TOLERANCE = 0.005
ROUNDS = 12


def _valid(c: Column) -> Column:
    """Whether a citation is valid: path not empty, lines 'A-B' with 1 <= A <= B."""
    low, high = (F.regexp_extract(c["lines"], r"^(\d+)-(\d+)\z", k).try_cast("decimal(38,0)") for k in (1, 2))
    return F.coalesce((c["path"] != "") & (low >= 1) & (low <= high), F.lit(False))


def valid_citations(citations: Column) -> Column:
    """Number of distinct valid citations."""
    return F.coalesce(F.size(F.array_distinct(F.filter(citations, _valid))), F.lit(0))


def valid_criteria(criteria: Column) -> Column:
    """Number of distinct non-blank criteria after trimming spaces."""
    trimmed = F.transform(criteria, lambda c: F.trim(c))
    return F.coalesce(F.size(F.array_distinct(F.filter(trimmed, lambda c: F.coalesce(c != "", F.lit(False))))), F.lit(0))


def same_text(text: Column) -> Column:
    """Lower-cased, runs of space, tab, CR, LF made one space, trimmed; null for blank."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))
    return F.when(flat != "", flat)


def groups(rules: DataFrame, *more: Column) -> DataFrame:
    """One row for each rule delivery in a group key: the key's hash, the claims' ranks, and `more`. Lists stay behind."""
    r = rules.withColumn("__text", same_text(F.col("requirement"))).where("__text is not null")
    sure = F.coalesce((F.col("crosscheck") == "supported") & ~F.isnan("confidence") & F.col("confidence").between(0, 1), F.lit(False))
    key = lambda *c: F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("+"), F.col(x)), F.lit("-")) for x in c)), 256)
    return r.select(
        F.unhex(F.substring(key("repo", "domain", "__text"), 1, 32)).alias("g"),
        "rule_id",
        F.coalesce(F.col("generated_at"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("at"),
        valid_citations(F.col("citations")).alias("n_citations"),
        valid_criteria(F.col("acceptance_criteria")).alias("n_criteria"),
        sure.alias("sure"),
        "confidence",
        "output_id",
        *more,
    )


def several(claims: DataFrame) -> Cut:
    """The rows of groups() of the groups that have two keys or more, and each group's smallest key as group_id."""
    two = claims.groupBy("g").agg(F.min("rule_id").alias("group_id"), F.max("rule_id").alias("__last")).where("group_id < __last").drop("__last")
    return cut(claims.distinct().join(two, "g"))


def order_claims(kept: DataFrame) -> DataFrame:
    """(g, field, value, source, tier, key) where each row of several() claims to be what a field comes from.

    The tier is the field's whole order: the more complete or surer, then the later, then the smaller key.
    """
    claim = lambda name, ok, n: F.when(ok, F.struct(F.lit(name).alias("field"), F.struct(n.alias("n"), "at", (-F.col("rule_id")).alias("k")).alias("tier")))
    claims = F.array(claim("citations", F.lit(True), F.col("n_citations")), claim("confidence", F.col("sure"), F.lit(0)), claim("criteria", F.lit(True), F.col("n_criteria")))
    c = kept.select("g", "rule_id", "output_id", F.explode(claims).alias("c")).where("c is not null")
    return c.select("g", "c.field", F.col("rule_id").cast("string").alias("value"), F.coalesce(F.col("output_id").cast("string"), F.lit("")).alias("source"), "c.tier", F.col("rule_id").alias("key"))


def best_by_order(claims: DataFrame) -> DataFrame:
    """(group_id, citations_from, confidence_from, criteria_from): truth discovery over the rows' own claims, with each
    field's order as its tiers; see order_claims(). claims: groups()."""
    kept = several(claims)
    choices, _ = discover(order_claims(kept.df))
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value").cast("bigint"))).alias(f"{f}_from")
    best = choices.groupBy(F.col("group").alias("g")).agg(of("citations"), of("confidence"), of("criteria"))
    return kept.df.select("g", "group_id").distinct().join(best, "g").select("group_id", "citations_from", "confidence_from", "criteria_from")


def discover(claims: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(choices (group, field, value, support, votes), reliabilities (source, reliability, n_claims)).

    claims: (g, field, value, source, tier, key); the tier is of any type with an order, and only claims of a group's and
    field's highest tier vote, each key once for a value. A value's support is its probability given the sources'
    reliabilities: each vote weighs log(r F / (1 - r)) among F rivals. A source's reliability is the smoothed mean support
    of its contested claims; hard choices instead of supports would let one source outvote all others in the end.
    """
    c = claims.select("g", F.col("field").alias("f"), F.xxhash64("value").alias("v"), F.col("source").alias("s"), F.col("tier").alias("t"), "value", "key")
    top = c.groupBy("g", "f").agg(F.max("t").alias("t"))
    voting = c.groupBy("g", "f", "t", "v", "s").agg(F.count_distinct("key").alias("n"), F.min("value").alias("value"))
    votes = cut(voting.join(top, ["g", "f", "t"]).drop("t"))
    values = votes.df.groupBy("g", "f", "v").agg(F.sum("n").alias("votes"), F.min("value").alias("value"))
    rivals = cut(values.groupBy("g", "f").agg((F.count("*") - 1).alias("rivals"), F.min("value").alias("only"), F.sum("votes").alias("votes")))
    agreed = rivals.df.where("rivals = 0").select(F.col("g").alias("group"), F.col("f").alias("field"), F.col("only").alias("value"), F.lit(1.0).alias("support"), "votes")
    contested = cut(votes.df.drop("value").join(rivals.df.where("rivals > 0").select("g", "f", "rivals"), ["g", "f"]))
    if not contested.rows:
        return agreed, claims.sparkSession.createDataFrame([], "source string, reliability double, n_claims bigint")
    trust = cut(contested.df.groupBy("s").agg(F.lit(0.8).alias("w"), F.count("*").alias("n")))
    for k in range(1, rounds + 1):
        weight = F.log(F.col("w") * F.col("rivals") / (1 - F.col("w")))
        weighed = contested.df.join(trust.df.select("s", "w"), "s").groupBy("g", "f", "v").agg(F.sum(weight).alias("x"), F.sum("n").alias("votes"))
        held = cut(weighed)
        scaled = held.df.join(held.df.groupBy("g", "f").agg(F.max("x").alias("m")), ["g", "f"]).withColumn("e", F.exp(F.col("x") - F.col("m")))
        shifted = cut(scaled.drop("x", "m"))
        supports = cut(shifted.df.join(shifted.df.groupBy("g", "f").agg(F.sum("e").alias("z")), ["g", "f"]).select("g", "f", "v", (F.col("e") / F.col("z")).alias("support"), "votes"))
        mean = contested.df.select("g", "f", "v", "s").join(supports.df, ["g", "f", "v"]).groupBy("s").agg(F.sum("support").alias("hit"))
        new = cut(trust.df.join(mean, "s").select("s", ((F.col("hit") + 4.0) / (F.col("n") + 5.0)).alias("w"), F.abs((F.col("hit") + 4.0) / (F.col("n") + 5.0) - F.col("w")).alias("moved"), "n"))
        moved = new.df.agg(F.max("moved")).collect()[0][0]
        for x in (trust, held, shifted):
            x.drop()
        trust = new
        if moved <= tolerance or k == rounds:
            break
        supports.drop()
    if moved > tolerance:
        warnings.warn(f"reliabilities still move by {moved:.4f} after {rounds} rounds", stacklevel=2)
    told = supports.df.join(values.select("g", "f", "v", "value"), ["g", "f", "v"])
    near = F.round("support", 9)
    best = told.groupBy("g", "f").agg(F.min_by(F.struct("value", "support", "votes"), F.struct(-near, "value")).alias("x")).select(F.col("g").alias("group"), F.col("f").alias("field"), "x.*")
    return best.unionByName(agreed), trust.df.select(F.col("s").alias("source"), F.col("w").alias("reliability"), F.col("n").alias("n_claims"))


def field_claims(rules: DataFrame) -> DataFrame:
    """(g, group_id, field, value, source, tier, key) of the three fields; the source is the run that wrote the rule.

    The tier is a field's first order of preference: how many citations or criteria are valid, whether a confidence is
    sure. Claims without anything valid aren't eligible. Values are texts of what is valid, sorted.
    """
    ok = lambda c: _valid(c)
    cited = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("citations", ok), lambda c: F.concat(c["path"], F.lit(":"), c["lines"])))), "\n")
    wanted = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("acceptance_criteria", lambda c: F.trim(c)), lambda c: c != ""))), "\n")
    kept = several(groups(rules, cited.alias("citations_text"), wanted.alias("criteria_text"))).df
    claim = lambda name, value, tier: F.struct(F.lit(name).alias("field"), value.alias("value"), tier.cast("int").alias("tier"))
    claims = F.array(claim("citations", F.col("citations_text"), F.col("n_citations")), claim("confidence", F.col("confidence").cast("string"), F.col("sure")), claim("criteria", F.col("criteria_text"), F.col("n_criteria")))
    return kept.select("g", "group_id", F.col("rule_id").alias("key"), F.coalesce(F.col("output_id").cast("string"), F.lit("")).alias("source"), F.explode(claims).alias("c")).select("g", "group_id", "key", "source", "c.*").where("tier > 0")
