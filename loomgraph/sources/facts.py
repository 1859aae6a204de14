"""Facts from files, commands, scripts and symbol indexes."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import best_per_key
from . import scanners

SCHEMA_TAG = "facts/v1"
#: Tags that are read: ours, with any name before it.
ACCEPTED = re.compile(r"(?:[\w.-]+/)?facts/v1")
FACT = "kind string, id string, attrs map<string,string>, source struct<path:string,lines:string>, origin string, certainty string"
TIMEOUT = 300


class FactsError(ValueError):
    """A facts file or an extractor's output that can't be used."""


def decode_envelope(data: str, origin: str = "", overwrite: bool = False) -> list[tuple]:
    """Rows of an envelope; rejects another schema tag. Missing texts are ''."""
    try:
        envelope = json.loads(data)
    except ValueError as e:
        raise FactsError(f"not JSON: {e}") from e
    if not isinstance(envelope, dict) or not ACCEPTED.fullmatch(str(envelope.get("schema"))):
        raise FactsError(f"unsupported schema {envelope.get('schema') if isinstance(envelope, dict) else None!r}")
    rows = []
    for f in envelope.get("facts") or []:
        source = f.get("source") or {}
        named = origin if overwrite or not f.get("origin") else f["origin"]
        rows.append((f.get("kind", ""), f.get("id", ""), f.get("attrs") or {}, (source.get("path", ""), source.get("lines", "")), named, f.get("certainty", "")))
    return rows


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], FACT + ", pos long")


def load_facts_file(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a file; the default origin is the file's base name. Any error is raised."""
    with open(path, encoding="utf-8") as f:
        return _frame(spark, decode_envelope(f.read(), os.path.basename(path)))


def run_extractor(spark: SparkSession, name: str, command: Sequence[str], src: str, timeout: float = TIMEOUT) -> DataFrame:
    """Facts that a command prints, with its name as origin; '{src}' in its arguments is the source root."""
    argv = [a.replace("{src}", src) for a in command]
    try:
        done = subprocess.run(argv, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired as e:
        raise FactsError(f"extractor {name} timed out after {timeout:g} s") from e
    except OSError as e:
        raise FactsError(f"extractor {name}: {e}") from e
    if done.returncode:
        raise FactsError(f"extractor {name} failed with {done.returncode}: {done.stderr.strip()[:200]}")
    return _frame(spark, decode_envelope(done.stdout, name, overwrite=True))


def run_extractors(spark: SparkSession, extractors: dict[str, Sequence[str]], src: str, timeout: float = TIMEOUT, timeouts: dict[str, float] | None = None) -> tuple[list[DataFrame], dict[str, str]]:
    """Facts of all extractors that succeed, in order, and each one's status ('ok' or what failed). `timeouts` has those
    of single extractors."""
    layers, status = [], {}
    for name, command in extractors.items():
        try:
            layers.append(run_extractor(spark, name, command, src, (timeouts or {}).get(name, timeout)))
            status[name] = "ok"
        except FactsError as e:
            status[name] = f"failed: {e}"
    return layers, status


_ROW = FACT + ", pos struct<path:string,line:int>"


def _fact(kind: str, key: str, attrs: dict[str, str], path: str, start: int, end: int, origin: str, certainty: str = "static") -> tuple:
    return kind, key, {k: v for k, v in attrs.items() if v}, {"path": path, "lines": f"{start}-{end}"}, origin, certainty, {"path": path, "line": start}


def script_facts(files: DataFrame, origin: str = "framework") -> DataFrame:
    """Routes and tables found in Go, PHP and SQL files: first of a table's name or a route's verb and path wins."""

    def found(path: str, language: str, text: str) -> Iterator[tuple]:
        if path.lower().endswith(".sql"):
            for t in scanners.parse_tables(text):
                yield _fact("table", f"table.{t['name']}", {"name": t["name"], "columns": ", ".join(t["columns"])}, path, t["line"], t["line"], origin)
        elif language == "go":
            for r in scanners.go_routes(text):
                yield _fact("route", f"route.{r['method'].lower()}.{r['path']}", {"verb": r["method"], "path": r["path"], "handler": r["handler"]}, path, r["start_line"], r["end_line"], origin)
        elif language == "php":
            for r in scanners.php_routes(text):
                yield _fact("route", f"route.{r['method']}.{r['path']}", {"method": r["method"], "path": r["path"], "controller": r["controller"], "action": r["action"]}, path, r["start_line"], r["end_line"], origin)
            for t in scanners.php_tables(text):
                yield _fact("table", f"table.{t['name']}", {"name": t["name"], "columns": ", ".join(t["columns"])}, path, t["start_line"], t["end_line"], origin)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "id", "attrs", "source", "origin", "certainty", "pos"]
        for f in frames:
            yield pd.DataFrame([r for p, g, t in zip(f["path"], f["language"], f["text"]) if t for r in found(p, g, t)], columns=columns)

    wanted = F.col("language").isin("go", "php") | F.lower("path").endswith(".sql")
    rows = files.where(wanted).select("path", "language", "text").mapInPandas(run, _ROW)
    return best_per_key(rows, "id", ["pos"]).select("kind", "id", "attrs", "source", "origin", "certainty", "pos")


def facts_json(facts: DataFrame) -> Iterator[str]:
    """An envelope of facts by id, in pieces, streamed to the driver a partition at a time."""
    yield '{\n  "schema": ' + json.dumps(SCHEMA_TAG) + ',\n  "facts": ['
    first = True
    for (row,) in facts.orderBy("id").select(F.to_json(F.struct("kind", "id", "attrs", "source", "origin", "certainty"))).toLocalIterator():
        yield ("\n" if first else ",\n") + "    " + json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n    ")
        first = False
    yield "]\n}\n" if first else "\n  ]\n}\n"


#: Fixed value: the file that a listed route is cited from where the listing names none.
LISTED_BY = "artisan"


def runtime_routes(spark: SparkSession, listing: str, origin: str = "runtime") -> DataFrame:
    """Routes of a framework's JSON listing (given as text): first verb of A|B, leading slash, certainty 'proved'.
    An entry without a method or path is left out; a closure has no controller."""
    rows = []
    for r in json.loads(listing):
        if r.get("method") is None or r.get("uri") is None:
            continue
        verb, path = r["method"].split("|")[0], "/" + r["uri"].lstrip("/")
        named = "" if r.get("action") == "Closure" else r.get("action") or ""
        controller, _, action = named.partition("@")
        attrs = {"method": verb.upper(), "path": path, "controller": controller, "action": action}
        rows.append(("route", f"route.{verb.lower()}.{path}", {k: v for k, v in attrs.items() if v}, (r.get("file") or LISTED_BY, r.get("lines") or "1-1"), origin, "proved"))
    return _frame(spark, rows)


#: Descriptor suffixes of symbol kinds in an index.
INDEX_KINDS = {7: "class", 11: "enum", 17: "function", 21: "interface", 26: "method", 49: "struct", 54: "type", 55: "type"}


def index_facts(files: DataFrame, origin: str = "index", root: str = "") -> DataFrame:
    """Precise symbols from the JSON dumps of a code index: one document a row in the column `document`.

    A document has relative_path, occurrences (symbol, symbol_roles, range, enclosing_range) and symbols (symbol,
    display_name, kind, signature_documentation). Only definitions count; the enclosing range is preferred; names come
    from the display name, else the last descriptor; nameless symbols and paths outside the root are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "id", "attrs", "source", "origin", "certainty", "pos"]
        for f in frames:
            rows = []
            for d in map(json.loads, f["document"]):
                path = d.get("relative_path", "").removeprefix("./")
                path = path.removeprefix(root.rstrip("/") + "/") if root else path
                if not path or path.startswith(("/", "../")) or "/../" in path:
                    continue
                known = {s.get("symbol"): s for s in d.get("symbols", [])}
                for o in d.get("occurrences", []):
                    span = o.get("enclosing_range") or o.get("range") or []
                    if not o.get("symbol_roles", 0) & 1 or len(span) < 3:
                        continue
                    info = known.get(o["symbol"], {})
                    parts = [p for p in re.split(r"[/#.:()\[\]`]+", o["symbol"].split(" ")[-1]) if p]
                    name = info.get("display_name") or (parts[-1] if parts else "")
                    if not name or o["symbol"].startswith("local "):
                        continue
                    start, end = span[0] + 1, (span[2] if len(span) == 4 else span[0]) + 1
                    signature = (info.get("signature_documentation") or {}).get("text", "")
                    signature = signature if len(signature) <= 400 else signature[:400] + "…"
                    attrs = {"name": name, "precise": "true", "kind": INDEX_KINDS.get(info.get("kind", 0), ""), "language": d.get("language", "").lower(), "namespace": ".".join(parts[:-1]), "signature": signature}
                    rows.append(_fact("symbol", f"symbol.{path}#{name}:{start}", attrs, path, start, end, origin, "proved"))
            yield pd.DataFrame(rows, columns=columns)

    return best_per_key(files.select("document").mapInPandas(run, _ROW), "id", ["pos"]).select("kind", "id", "attrs", "source", "origin", "certainty", "pos")
