"""Nodes as pages: rendering, parsing back, and the files of a rendered graph."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import plain_yaml
from ..functions import exprs as X
from .graph import LABELS, edge_rank

EXTRAS = ("ears", "acceptance", "nature", "origin", "confidence", "crosscheck", "digest")


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their edges array<struct<type,to>> by type and target."""
    e = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(edge_rank(F.col("type")).alias("r"), F.col("dst").alias("to"), "type"))).alias("es"))
    listed = F.transform("es", lambda x: F.struct(x["type"].alias("type"), x["to"].alias("to")))
    none = F.expr("cast(array() as array<struct<type:string,to:string>>)")
    return nodes.join(e.select(F.col("src").alias("id"), listed.alias("edges")), "id", "left").withColumn("edges", F.coalesce("edges", none))


def frontmatter() -> Column:
    """The page's head. What plain YAML would misread is quoted."""
    text = lambda p: F.to_json(F.array(p)).substr(F.lit(2), F.length(F.to_json(F.array(p))) - 2)
    quoted = lambda p: F.when(F.regexp_like(p, F.lit(r": |:$| #|^[\s\"'&*!|>%@`\[\]{},?-]|\s$|^$|[\x00-\x1f\x7f\x85\u2028\u2029]")), text(p)).otherwise(p)
    target = lambda p: F.when(F.regexp_like(p, F.lit(r"^\"|^$|[\x00-\x1f\x7f\x85\u2028\u2029]")), text(p)).otherwise(p)
    sources = F.when(F.size("sources") == 0, "sources: []\n").otherwise(F.concat(F.lit("sources:\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - path: "), quoted(s["path"]), F.lit("\n    lines: "), text(s["lines"]), F.lit("\n"))), "")))
    edges = F.when(F.size("edges") == 0, "edges: []\n").otherwise(F.concat(F.lit("edges:\n"), F.array_join(F.transform("edges", lambda e: F.concat(F.lit("  - {type: "), e["type"], F.lit(", to: "), target(e["to"]), F.lit("}\n"))), "")))
    extra = [F.when(F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}: "), F.try_element_at("extra", F.lit(k)), F.lit("\n"))).otherwise("") for k in EXTRAS]
    return F.concat(F.lit("---\nid: "), "id", F.lit("\ntype: "), "type", F.lit("\nstatus: generated\n"), sources, edges, *extra, F.lit("---\n"))


def edge_link(e: Column, lang: str) -> Column:
    """A relative link to an edge's target."""
    to = e["to"]
    link = lambda prefix, folder, text: F.concat(F.lit("["), text, F.lit(f"](../{folder}/"), F.regexp_replace(to, f"^{prefix}\\.", ""), F.lit(".md)"))
    return (
        F.when(to.startswith("domain."), link("domain", "domains", F.when(e["type"] == "depends_on", to).otherwise(F.concat(F.lit(LABELS[lang]["domain"] + " "), F.regexp_replace(to, r"^domain\.", "")))))
        .when(to.startswith("entity."), link("entity", "entities", to))
        .when(to.startswith("endpoint."), link("endpoint", "endpoints", to))
        .when(to.startswith("rule."), link("rule", "rules", to))
        .otherwise(to)
    )


def pages(nodes: DataFrame, lang: str = "fr") -> DataFrame:
    """(id, file, page) of nodes with edges."""
    cited = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("`"), s["path"], F.lit(":"), s["lines"], F.lit("`"))), " · ")
    links = F.array_join(F.transform("edges", lambda e: edge_link(e, lang)), " · ")
    page = F.concat(
        frontmatter(),
        F.lit("\n# "),
        "title",
        F.lit("\n"),
        F.when(F.col("body") != "", F.concat(F.lit("\n"), "body", F.lit("\n"))).otherwise(""),
        F.when(F.size("sources") > 0, F.concat(F.lit("\n**Sources** : "), cited, F.lit("\n"))).otherwise(""),
        F.when(F.size("edges") > 0, F.concat(F.lit(f"\n{LABELS[lang]['links']} : "), links, F.lit("\n"))).otherwise(""),
    )
    return nodes.select("id", X.node_file(F.col("type"), F.col("id")).alias("file"), page.alias("page"))


class PageError(ValueError):
    """A page that isn't a node's."""


def parse_page(page: str) -> dict:
    """A node of a page; the body is what follows its head."""
    if not page.startswith("---\n"):
        raise PageError("the page has no head")
    head, mark, body = page[4:].partition("\n---\n")
    if not mark:
        raise PageError("the page's head has no end")
    node = _written(head) or _edited(head)
    node["title"] = next((x[2:] for x in body.split("\n") if x.startswith("# ")), "")
    node["body"] = body
    return node


def _edited(head: str) -> dict:
    """A head that a hand has changed, read as YAML."""
    try:
        found = plain_yaml.load(head, typed=False)
    except ValueError as e:
        raise PageError(str(e)) from e
    if not isinstance(found, dict) or set(found) - {"id", "type", "status", "sources", "edges", *EXTRAS}:
        raise PageError("the page's head isn't a node's")
    text = lambda x: "" if x is None else str(x)
    listed = lambda k, names: [{n: text(x.get(n)) for n in names} for x in found.get(k) or []]
    try:
        node = {k: text(found.get(k)) for k in ("id", "type", "status")} | {"sources": listed("sources", ("path", "lines")), "edges": listed("edges", ("type", "to"))}
        return node | {"extra": {k: "%.2f" % float(found[k]) if k == "confidence" else text(found[k]) for k in EXTRAS if k in found}}
    except (AttributeError, TypeError, ValueError) as e:
        raise PageError(f"unreadable entry: {e}") from e


def _written(head: str) -> dict | None:
    """A head in the very form that frontmatter() gives it; None if it has any other line."""
    node: dict = {"id": "", "type": "", "status": "", "sources": [], "edges": [], "extra": {}}
    section = ""
    for line in head.split("\n"):
        if m := re.fullmatch(r"  - path: (.*)", line):
            node["sources"].append({"path": _scalar(m[1]), "lines": ""})
        elif (m := re.fullmatch(r"    lines: (.*)", line)) and node["sources"]:
            node["sources"][-1]["lines"] = _scalar(m[1])
        elif m := re.fullmatch(r"  - \{type: (.*?), to: (.*)\}", line):
            node["edges"].append({"type": _scalar(m[1]), "to": _scalar(m[2])})
        elif m := re.fullmatch(r"(\w+):\s*(.*)", line):
            section = m[1]
            if section in ("id", "type", "status"):
                node[section] = _scalar(m[2])
            elif section in EXTRAS:
                value = _scalar(m[2])
                node["extra"][section] = "%.2f" % float(value) if section == "confidence" else value
            elif section not in ("sources", "edges") or m[2] not in ("", "[]"):
                return None
        elif line.strip():
            return None
    return node


def _scalar(text: str) -> str:
    try:
        return json.loads(text) if text.startswith('"') else text
    except ValueError as e:
        raise PageError(f"unreadable text {text}") from e


NODE = "id string, type string, status string, title string, body string, sources array<struct<path:string,lines:string>>, edges array<struct<type:string,to:string>>, extra map<string,string>"


def parse_pages(files: DataFrame) -> DataFrame:
    """Nodes of pages (page); the first page that can't be read fails the query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse_page(p) for p in f["page"]], columns=["id", "type", "status", "title", "body", "sources", "edges", "extra"])

    return files.select("page").mapInPandas(run, NODE)


def load_nodes(spark, out_dir: str) -> DataFrame:
    """Nodes of a rendered graph."""
    return parse_pages(spark.read.text(os.path.join(out_dir, "nodes", "*", "*.md"), wholetext=True).withColumnRenamed("value", "page"))


def round_trip(nodes: DataFrame, lang: str = "fr") -> DataFrame:
    """A violation for each node whose page doesn't give it back."""
    fields = ["id", "type", "sources", "edges", "extra"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                try:
                    back = parse_page(r["page"])
                except (PageError, ValueError) as e:
                    rows.append((r["id"], f"regenerated frontmatter is not parsable: {e}"))
                    continue
                listed = lambda v: [dict(x) for x in v]
                for name, ok in (("id/type/status", (back["id"], back["type"]) == (r["id"], r["type"])), ("sources", back["sources"] == listed(r["sources"])), ("edges", back["edges"] == listed(r["edges"])), *((f"extra field {k}", back["extra"].get(k, "") == (dict(r["extra"] or {}).get(k) or "")) for k in EXTRAS)):
                    if not ok:
                        rows.append((r["id"], f"{name} did not survive the round-trip"))
                        break
            yield pd.DataFrame({"node_id": [r[0] for r in rows], "check": ["frontmatter-round-trip"] * len(rows), "detail": [r[1] for r in rows]}, dtype=object)

    rendered = nodes.select(*fields).join(pages(nodes, lang).select("id", "page"), "id")
    return rendered.mapInPandas(run, "node_id string, check string, detail string")


def write_atomic(path: str, data: str | Iterable[str]) -> None:
    """Write a file, given whole or in pieces, by a temporary one in its folder and a rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.writelines([data] if isinstance(data, str) else data)
    os.chmod(temp, 0o644)
    os.replace(temp, path)


def write_pages(rendered: DataFrame, out_dir: str) -> None:
    """One file for each page, written by the tasks; the folder must be one that they share."""

    def write(rows) -> None:
        for r in rows:
            write_atomic(os.path.join(out_dir, r["file"]), r["page"])

    for folder in ("domains", "entities", "endpoints", "rules"):
        place = os.path.join(out_dir, "nodes", folder)
        os.makedirs(place, exist_ok=True)
        for name in os.listdir(place):
            if name.endswith(".md"):
                os.remove(os.path.join(place, name))
    rendered.select("file", "page").foreachPartition(write)


def graph_json(nodes: DataFrame) -> Iterator[str]:
    """The graph's JSON in pieces, nodes by id, streamed to the driver a partition at a time."""
    rows = nodes.select("id", "type", X.node_file(F.col("type"), F.col("id")).alias("file"), "edges").orderBy("id").toLocalIterator()
    yield '{\n  "nodes": {'
    first = True
    for r in rows:
        entry = {"type": r["type"], "file": r["file"], "edges": [{"type": e["type"], "to": e["to"]} for e in r["edges"]]}
        text = json.dumps({r["id"]: entry}, indent=2, ensure_ascii=False)[2:-2].replace("\n", "\n  ")
        yield ("\n" if first else ",\n") + "  " + text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
        first = False
    yield "}\n}\n" if first else "\n  }\n}\n"


def listing(nodes: DataFrame) -> Iterator[str]:
    """The listing of all pages by type, in order."""
    yield "# Knowledge graph\n\n> Every node is a page with typed edges in its head.\n"
    for kind in ("domain", "entity", "endpoint", "rule"):
        rows = nodes.where(F.col("type") == kind).select(X.node_file(F.col("type"), F.col("id")).alias("file"), "title", "id").orderBy("id").toLocalIterator()
        for k, r in enumerate(rows):
            yield (f"\n## {kind}\n\n" if not k else "") + f"- {r['file']} : {r['title']}\n"
