"""From a source tree to a rendered, verified graph, and questions about one that was rendered."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events
from .config import Config
from .durable import cut
from .functions import exprs as X
from .operators import checks, chunks, graph, joins, merge, phases, render, similar
from .operators import model as M
from .sources import facts as fact_sources
from .sources import scanners, tree
from .state import State


class IntegrityError(RuntimeError):
    """The graph has violations; nothing is rendered."""


_FACT = ["kind", "id", "attrs", "source", "origin", "certainty", "pos"]


def _ordered(df: DataFrame) -> DataFrame:
    """Facts with their order as text, so layers union."""
    return df.select(*_FACT[:-1], F.to_json(F.struct("pos")).alias("pos"))


def all_facts(spark: SparkSession, files: DataFrame, parsed: DataFrame, config: Config) -> tuple[DataFrame, dict[str, str]]:
    """Facts of the parser, extractors in order and files, merged; and the extractors' statuses."""
    external, status = fact_sources.run_extractors(spark, config.extractors, config.src, config.extractor_timeout, config.timeouts)
    given = [fact_sources.load_facts_file(spark, p) for p in config.facts]
    scripts = fact_sources.script_facts(files)
    if config.routes:  # a framework's own listing stands for the routes that were read off its files
        scripts = _ordered(scripts)
        try:
            with open(config.routes, encoding="utf-8") as f:
                scripts = merge.replace_kind(scripts, "route", _ordered(fact_sources.runtime_routes(spark, f.read())))
            status["routes"] = "ok"
        except (OSError, ValueError, AttributeError) as e:
            status["routes"] = f"failed: {e}"
    index = [fact_sources.index_facts(spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", "struct<documents:array<string>>")["documents"]).alias("document"))) for p in config.index]
    layers = [_ordered(chunks.universal_facts(parsed)), scripts if config.routes else _ordered(scripts), *map(_ordered, (*index, *external, *given))]
    return merge.merge_facts(layers), status


def allowed_endpoints(facts: DataFrame, separator: str = "\\") -> DataFrame:
    """(path, endpoints): endpoints whose handler's text contains a symbol of the file."""
    handler = F.coalesce(F.nullif(F.try_element_at("attrs", F.lit("controller")), F.lit("")), F.try_element_at("attrs", F.lit("handler")), F.lit(""))
    routes = facts.where("kind = 'route'").select(X.endpoint_id(X.route_verb(F.col("attrs")), F.coalesce(F.try_element_at("attrs", F.lit("path")), F.lit(""))).alias("endpoint"), handler.alias("target")).where("target <> ''")
    space = F.coalesce(F.try_element_at("attrs", F.lit("namespace")), F.lit(""))
    name = F.try_element_at("attrs", F.lit("name"))
    symbols = facts.where("kind = 'symbol'").select(F.col("source.path").alias("path"), F.when(space != "", F.concat(space, F.lit(separator), name)).otherwise(name).alias("fqn"))
    linked = joins.contains_link(routes, symbols, "target", "fqn")
    return linked.select("path", "endpoint").distinct().groupBy("path").agg(F.array_sort(F.collect_list("endpoint")).alias("endpoints"))


def precise_symbols(facts: DataFrame) -> DataFrame:
    a, b = X.range_start(F.col("source.lines")), X.range_end(F.col("source.lines"))
    return facts.where("kind = 'symbol' and try_element_at(attrs, 'precise') = 'true'").select(F.col("source.path").alias("path"), a.alias("start_line"), b.alias("end_line"), *(F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("")).alias(k) for k in ("name", "kind", "signature"))).where("start_line is not null")


def dependencies(facts: DataFrame, domains: DataFrame, config: Config) -> DataFrame:
    modules = facts.where("kind = 'module'").select(F.try_element_at("attrs", F.lit("name")).alias("name"), "source.path").withColumn("domain", X.domain(F.col("name"), F.col("path"), config.domain_depth, config.strategy))
    imports = facts.where("kind = 'import'").select(F.col("id").alias("row"), F.coalesce(F.try_element_at("attrs", F.lit("namespace")), F.lit("")).alias("namespace"), "source.path", F.try_element_at("attrs", F.lit("target")).alias("target"))
    placed = imports.withColumn("from_domain", X.domain(F.col("namespace"), F.col("path"), config.domain_depth, config.strategy))
    return graph.domain_dependencies(placed, modules, domains)


def violations(nodes: DataFrame, edges: DataFrame, files: DataFrame, lang: str = "fr") -> DataFrame:
    """(node_id, check, detail) of all five checks."""
    cited = nodes.select(F.col("id").alias("node_id"), F.explode("sources").alias("s")).select("node_id", "s.path", "s.lines")
    lost = checks.resolve_citations(cited, tree.line_counts(files)).where("problem is not null").select("node_id", F.lit("unresolvable-citation").alias("check"), F.col("problem").alias("detail"))
    return checks.duplicate_ids(nodes).unionByName(checks.dangling_edges(edges, nodes)).unionByName(checks.uncited_rules(nodes)).unionByName(lost).unionByName(render.round_trip(render.with_edges(nodes, edges), lang))


def stamp(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rule nodes with the digest of what they cite; one that can't be made leaves its node as it is."""
    cited = nodes.where("type = 'rule'").select("id", F.explode("sources").alias("s")).select("id", "s.path", "s.lines")
    d = checks.digests(cited, files.select("path", F.col("text").alias("content")), "id")
    j = nodes.join(d, "id", "left")
    kept = F.map_filter("extra", lambda k, _: k != "digest")
    return j.withColumn("extra", F.when(F.col("digest").isNull(), F.col("extra")).otherwise(F.map_concat(kept, F.create_map(F.lit("digest"), F.col("digest"))))).drop("digest")


def run(spark: SparkSession, config: Config, chat: M.Chat, sink: events.Sink = events.silent) -> dict:
    """Build, verify and render the graph of config.src in config.out; the counts of the summary page.

    What goes on is told to `sink` and kept in the state file: after every few units of a phase, not at its end only.
    """
    tell = lambda kind, **values: sink(events.Event(kind, values))
    tell("started", src=config.src, out=config.out)
    ok = False
    try:
        summary = _run(spark, config, chat, tell)
        ok = True
        return summary
    finally:
        tell("finished", ok=ok)


def _run(spark: SparkSession, config: Config, chat: M.Chat, tell: Callable[..., None]) -> dict:
    out = config.out
    os.makedirs(out, exist_ok=True)
    state = State(os.path.join(out, "state.json"))
    memo = lambda name, schema: phases.Memo(spark, os.path.join(os.path.abspath(out), "cache", name), schema)

    scanned = cut(tree.scan(spark, config.src, config.exclude)).df
    for r in tree.unreadable(scanned).orderBy("path").toLocalIterator():
        tell("warning", path=r.path, error=r.error)
    files = cut(tree.readable(scanned)).df
    tell("scanned", files=files.count(), unreadable=tree.unreadable(scanned).count())

    def told(phase: str) -> Callable[[int, int], None]:
        tell("phase", phase=phase)
        last = [-1]

        def hear(done: int, total: int) -> None:
            if done != last[0]:
                last[0] = done
                tell("unit", phase=phase, done=done, total=total)
                state.progress(phase, done, total)

        return hear

    parsed = cut(scanners.parse_files(files)).df
    merged, extractors = all_facts(spark, files, parsed, config)
    for name, status in extractors.items():
        tell("extractor" if status == "ok" else "warning", extractor=name, status=status)
    facts = cut(merged).df
    tell("facts", **{r["kind"]: r["n"] for r in facts.groupBy("kind").agg(F.count("*").alias("n")).collect()})
    symbols = precise_symbols(facts)
    render.write_atomic(os.path.join(out, "facts.json"), fact_sources.facts_json(facts))
    pieces = cut(chunks.chunk_files(files, parsed, config.domain_depth, config.strategy)).df

    entities = [r[0] for r in graph.entity_nodes(facts).select("id").distinct().orderBy("id").collect()]
    endpoints = [r[0] for r in graph.endpoint_nodes(facts).select("id").distinct().orderBy("id").collect()]
    mapped = cut(phases.map_chunks(pieces, allowed_endpoints(facts), entities, chat, memo("map", phases.MAP_OUT), config.lang, config.workers, config.retry_failed, symbols, told("map"))).df
    m = mapped.agg(F.count("*"), F.count_if("failed"), F.coalesce(F.sum("prompt"), F.lit(0)), F.coalesce(F.sum("completion"), F.lit(0))).collect()[0]
    state.phase("map", *m)
    tell("ended", phase="map", total=m[0], failed=m[1])
    reduced = cut(phases.reduce_domains(mapped, entities, endpoints, chat, memo("reduce", phases.REDUCE_OUT), config.lang, config.reduce_batch, config.workers, config.retry_failed, told("reduce"))).df
    r = reduced.groupBy("domain").agg(F.min("failed").alias("failed"), F.sum("prompt").alias("p"), F.sum("completion").alias("c")).agg(F.count("*"), F.count_if("failed"), F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).collect()[0]
    state.phase("reduce", *r)
    tell("ended", phase="reduce", total=r[0], failed=r[1])

    rules, summaries = phases.consolidated(reduced)
    rules = cut(rules).df
    nodes = graph.entity_nodes(facts, config.lang).unionByName(graph.endpoint_nodes(facts, config.lang)).unionByName(graph.rule_nodes(rules, config.lang)).unionByName(graph.domain_nodes(summaries, rules, config.lang))
    edges = cut(graph.rule_edges(rules).unionByName(dependencies(facts, rules.select("domain").distinct(), config))).df
    nodes = cut(nodes).df
    tally: dict[str, int] = {}
    if config.crosscheck:
        cited = nodes.where("type = 'rule'").select(F.col("id").alias("rule_id"), F.posexplode("sources").alias("src", "s")).select("rule_id", "src", "s.path", "s.lines")
        lines = checks.excerpt(cited, files.select("path", F.col("text").alias("content")))
        shown = checks.excerpt_texts(lines, cited)
        verdicts = cut(phases.crosscheck(nodes, shown, symbols, chat, memo("crosscheck", phases.VERDICT), config.repair, config.workers, config.retry_failed, told("crosscheck"))).df
        tally = phases.tally(verdicts).collect()[0].asDict()
        used = phases.usage(verdicts).collect()[0]
        state.phase("crosscheck", verdicts.count(), tally["failed"], *used)
        nodes = phases.annotate(nodes, verdicts)
    nodes = cut(stamp(nodes, files)).df

    found = violations(nodes, edges, files, config.lang)
    bad = cut(found)
    tell("violations", n=bad.rows)
    if bad.rows:
        raise IntegrityError("; ".join(f"{x.node_id}: {x.check}: {x.detail}" for x in bad.df.orderBy("node_id", "check", "detail").limit(20).collect()))
    full = cut(render.with_edges(nodes, edges)).df
    render.write_pages(render.pages(full, config.lang), out)
    render.write_atomic(os.path.join(out, "graph.json"), render.graph_json(full))
    render.write_atomic(os.path.join(out, "llms.txt"), render.listing(full))
    summary = summarise(full, edges, files, tally, extractors, {"chunks": (m[0], m[1]), "domains": (r[0], r[1])})
    render.write_atomic(os.path.join(out, "README.md"), summary_page(summary))
    state.save(phase="done", extractors=extractors)
    tell("nodes", **summary["types"])
    return summary


def summarise(nodes: DataFrame, edges: DataFrame, files: DataFrame, tally: dict[str, int], extractors: dict[str, str], units: dict[str, tuple[int, int]]) -> dict:
    """Counts and lists for the summary page; the list of pairs ends in how many more there are."""
    sets = nodes.where("type = 'rule'").select(F.col("id").alias("row"), X.word_set(X.requirement_of(F.col("body"))).alias("words"))
    near = similar.near_classes(sets)
    counts = similar.count_pairs(near, sets.select("row", X.rule_domain(F.col("row")).alias("label"))).collect()[0]
    bare = files.where("language = ''").select("path").distinct()
    return {
        "types": {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()},
        "nature": {r[0]: r[1] for r in nodes.where("type = 'rule'").groupBy(F.try_element_at("extra", F.lit("nature")).alias("k")).count().where("k <> ''").collect()},
        "origin": {r[0]: r[1] for r in nodes.where("type = 'rule'").groupBy(F.try_element_at("extra", F.lit("origin")).alias("k")).count().where("k <> ''").collect()},
        "coverage": graph.coverage(nodes, edges).collect()[0].asDict(),
        "tally": tally,
        "units": units,
        "extractors_failed": sorted(n for n, s in extractors.items() if s != "ok"),
        "no_grammar": [r[0] for r in bare.orderBy("path").toLocalIterator()],
        "duplicates": (counts.same + counts.different, counts.same, [tuple(r) for r in similar.closest(near, 20).collect()]),
        "domains": [r[0] for r in nodes.where("type = 'domain'").select(F.regexp_replace("id", r"^domain\.", "")).orderBy("id").toLocalIterator()],
        "depends_on": [tuple(r) for r in edges.where("type = 'depends_on'").select("src", "dst").orderBy("src", "dst").toLocalIterator()],
    }


def _share(part: int, total: int) -> str:
    return f"{part}/{total} ({part * 100 // total}%)" if total else f"{part}/0 (n/a)"


#: The wording of the summary page, in the order in which it appears.
PAGE = {
    "title": "# Spécification générée",
    "domain": "- Domaines : {}",
    "entity": "- Entités : {}",
    "endpoint": "- Endpoints : {}",
    "rule": "- Règles : {}",
    "nature": "  - métier : {} · présentation : {} · technique : {}",
    "origin": "  - explicites : {} · implicites : {}",
    "coverage": "## Couverture",
    "endpoints": "- Endpoints référencés par au moins une règle : {}",
    "entities": "- Entités touchées par au moins une règle : {}",
    "chunks": "- Chunks en échec : {}/{}",
    "domains": "- Domaines en échec : {}/{}",
    "no_grammar": "- Fichiers sans grammaire (fallback lignes) : {}",
    "extractors": "- Extracteurs en échec : {}",
    "review": "- Contre-vérification adversariale : {} supported, {} partial, {} unsupported",
    "repaired": ", {} réparés",
    "failed": ", {} en échec",
    "duplicates": "## Doublons candidats",
    "pairs": "{} paires de règles à l'exigence quasi identique (à réconcilier) — {} intra-domaine, {} cross-domaine :",
    "pair": "- `{}` ↔ `{}` ({:.0f}%)",
    "more": "- … et {} autres",
    "graph": "## Domaines",
}


def summary_page(s: dict) -> str:
    """The summary as a page, with the domains' diagram."""
    say = lambda key, *values: PAGE[key].format(*values)
    types, covered, units = s["types"], s["coverage"], s["units"]
    lines = [say("title"), "", *(say(k, types.get(k, 0)) for k in ("domain", "entity", "endpoint", "rule"))]
    for key, order in (("nature", X.NATURES), ("origin", X.ORIGINS)):
        if s[key]:
            lines.append(say(key, *(s[key].get(k, 0) for k in order)))
    lines += ["", say("coverage"), "", say("endpoints", _share(covered["endpoints_referenced"], covered["endpoints_total"])), say("entities", _share(covered["entities_touched"], covered["entities_total"]))]
    lines += [say(k, units[k][1], units[k][0]) for k in ("chunks", "domains")]
    lines += [say(k, ", ".join(names)) for k, names in (("no_grammar", s["no_grammar"]), ("extractors", s["extractors_failed"])) if names]
    if tally := s["tally"]:
        lines.append(say("review", *(tally[k] for k in ("supported", "partial", "unsupported"))) + "".join(say(k, tally[k]) for k in ("repaired", "failed") if tally.get(k)))
    n, within, shown = s["duplicates"]
    if n:
        lines += ["", say("duplicates"), "", say("pairs", n, within, n - within), "", *(say("pair", a, b, x * 100) for a, b, x in shown)]
        if n > len(shown):
            lines.append(say("more", n - len(shown)))
    name = lambda d: d.removeprefix("domain.").replace("-", "_")
    lines += ["", say("graph"), "", "```mermaid", "graph TD", *(f'  {name(d)}["{d}"]' for d in s["domains"]), *(f"  {name(a)} --> {name(b)}" for a, b in s["depends_on"]), "```", ""]
    return "\n".join(lines)


def verify(spark: SparkSession, config: Config) -> DataFrame:
    """Violations of a rendered graph against a tree."""
    nodes = render.load_nodes(spark, config.out)
    if not nodes.limit(1).count():
        raise IntegrityError("no nodes")
    edges = nodes.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.type", F.col("e.to").alias("dst"))
    return violations(nodes.drop("edges", "status"), edges, tree.read_tree(spark, config.src, config.exclude), config.lang)


def drift(spark: SparkSession, config: Config) -> DataFrame:
    """(rule_id, status) of a rendered graph's rules against a changed tree."""
    nodes = render.load_nodes(spark, config.out).where("type = 'rule'")
    files = tree.read_tree(spark, config.src, config.exclude)
    cited = nodes.select(F.col("id").alias("rule_id"), F.explode("sources").alias("s")).select("rule_id", "s.path", "s.lines")
    stored = nodes.select(F.col("id").alias("rule_id"), F.try_element_at("extra", F.lit("digest")).alias("digest"))
    return checks.drift(stored, checks.digests(cited, files.select("path", F.col("text").alias("content"))))
