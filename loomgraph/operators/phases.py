"""The phases that call a model, over DataFrames, each with a memo table as its only resume point.

Calls run in mapInPandas, as many at a time as there are partitions (`workers`). What a phase returns is written to its
memo and read back, so no later plan repeats a call. Failed units are remembered, too, unless `retry_failed`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..events import Polled
from ..functions import exprs as X
from . import joins, merge, windows
from . import model as M

BATCH = 30
#: Units, or seconds, after which a task stores what it has finished.
FLUSH, FLUSH_SECONDS = 4, 30
Told = Callable[[int, int], None] | None
PROMPT_VERSION = "2"
Chat = M.Chat
CITATION = "struct<path:string,lines:string>"
RULE = f"struct<title:string,ears_kind:string,requirement:string,citations:array<{CITATION}>,entities:array<string>,endpoints:array<string>,nature:string,origin:string,confidence:double,slug:string,rationale:string,acceptance_criteria:array<string>>"
MAP_OUT = f"chunk_id string, path string, start_line int, end_line int, chunk_summary string, rules array<{RULE}>, failed boolean, error string, prompt bigint, completion bigint"
REDUCE_OUT = f"domain string, batch bigint, candidates_hash string, domain_summary string, rules array<{RULE}>, failed boolean, error string, dropped int, prompt bigint, completion bigint"
VERDICT = f"rule_id string, input_hash string, verdict string, reason string, new_citations array<{CITATION}>, failed boolean, error string, prompt bigint, completion bigint"


class Memo:
    """A table of finished units in a shared folder; new ones are appended."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def missing(self, units: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
        done = self.read()
        return units.join(done.where("not failed") if retry_failed else done, keys, "left_anti")

    def work(self, units: DataFrame, keys: list[str], call: Callable[[dict], tuple], workers: int, told: Callable[[int, int], None] | None = None) -> None:
        """Call every unit and store what it gives, in a file for each few that a task has finished.

        A run that is stopped loses at most FLUSH units of each worker: the next one finds the others done. A task that
        is tried again skips the units that its first try has stored. `told` hears how many units are done, of how many.
        """
        total = units.count()
        if not total:
            return
        path, names, schema = self.path, [c.split()[0] for c in _columns(self.schema)], to_arrow_schema(self.spark.createDataFrame([], self.schema).schema)
        run = uuid.uuid4().hex[:12]

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store = _Store(path, f"{run}-{TaskContext.get().partitionId()}", schema)
            done = store.keys(keys)
            rows: list[dict] = []
            began = time.monotonic()
            for f in frames:
                for u in f.to_dict("records"):
                    if tuple(u[k] for k in keys) in done:
                        continue
                    rows.append(dict(zip(names, call(u))))
                    if len(rows) >= FLUSH or time.monotonic() - began >= FLUSH_SECONDS:
                        store.write(rows)
                        rows, began = [], time.monotonic()
            store.write(rows)
            yield pd.DataFrame({"ok": [True]})

        before = _Store(path, run, schema)
        with Polled(lambda: told(before.rows(), total) if told else None):
            units.repartition(workers).mapInPandas(task, "ok boolean").count()

    def latest(self, keys: list[str]) -> DataFrame:
        """One row for each unit: a successful one before a failed one."""
        df = self.read()
        return merge.best_per_key(df, keys, ["failed", F.to_json(F.struct(*[c for c in df.columns if c not in keys]))])


class _Store:
    """Files of one run, or of one of its tasks, in a memo's folder; any file system that Arrow knows."""

    def __init__(self, path: str, mark: str, schema: pa.Schema):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        self.mark, self.schema = mark, schema

    def _own(self) -> list[str]:
        found = self.fs.get_file_info(pa.fs.FileSelector(self.folder, allow_not_found=True))
        return [i.path for i in found if i.base_name.startswith(f"units-{self.mark}-")]

    def keys(self, keys: list[str]) -> set[tuple]:
        return {tuple(r[k] for k in keys) for p in self._own() for r in pq.read_table(p, columns=keys, filesystem=self.fs).to_pylist()}

    def rows(self) -> int:
        return sum(pq.read_metadata(p, filesystem=self.fs).num_rows for p in self._own())

    def write(self, rows: list[dict]) -> None:
        """A whole file or none: written under a hidden name, then renamed."""
        if rows:
            name = uuid.uuid4().hex
            self.fs.create_dir(self.folder, recursive=True)
            hidden = f"{self.folder}/_{name}"
            pq.write_table(pa.Table.from_pylist(rows, self.schema), hidden, filesystem=self.fs)
            self.fs.move(hidden, f"{self.folder}/units-{self.mark}-{name}.parquet")


def _rule(r: dict) -> dict:
    text = lambda k: r.get(k) or ""
    return {
        "title": text("title"), "ears_kind": text("ears_kind"), "requirement": text("requirement"), "nature": text("nature"), "origin": text("origin"), "slug": text("slug"), "rationale": text("rationale"),
        "citations": [{"path": c.get("path") or "", "lines": c.get("lines") or ""} for c in r.get("citations") or []],
        "entities": list(r.get("entities") or []), "endpoints": list(r.get("endpoints") or []), "acceptance_criteria": list(r.get("acceptance_criteria") or []), "confidence": float(r.get("confidence") or 0),
    }


def catalog(symbols: Column) -> Column:
    """Precise symbols (start_line, end_line, name, kind, signature) as lines, by start."""
    kind = lambda x: F.coalesce(F.nullif(x["kind"], F.lit("")), F.lit("symbol"))
    shown = lambda x: F.when(F.coalesce(x["signature"], F.lit("")) != "", F.concat(F.lit(": "), x["signature"])).otherwise("")
    line = lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), kind(x), F.lit(") lines "), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), shown(x))
    return F.array_join(F.transform(F.array_sort(symbols), line), "\n")


SYMBOL = "path string, start_line bigint, end_line bigint, name string, kind string, signature string"


def symbols_by_chunk(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, symbols): the catalog of the precise symbols that lie on each chunk's lines; see SYMBOL."""
    s = symbols.select("path", F.struct("start_line", "end_line", "name", "kind", "signature").alias("s"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    met = joins.overlap(chunks.select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line"), s, "path", "start_line", "end_line", "__s", "__e")
    return met.groupBy("chunk_id").agg(catalog(F.collect_list("s")).alias("symbols"))


def map_chunks(chunks: DataFrame, allowed: DataFrame, entities: list[str], chat: Chat, memo: Memo, lang: str = "fr", workers: int = 4, retry_failed: bool = False, symbols: DataFrame | None = None, told: Told = None) -> DataFrame:
    """Candidate rules of each chunk. `allowed`: (path, endpoints array<string>); `symbols`: see SYMBOL. The domain is not remembered."""
    units = chunks.withColumnRenamed("id", "chunk_id").join(allowed, "path", "left").select("chunk_id", "path", "start_line", "end_line", X.numbered(F.col("content"), F.col("start_line")).alias("shown"), F.when(F.col("context") != "", X.numbered(F.col("context"), F.col("context_start"))).otherwise("").alias("head"), "endpoints")
    if symbols is not None:
        units = units.join(symbols_by_chunk(chunks, symbols), "chunk_id", "left")
    language = "English" if lang == "en" else "French"

    def call(u: dict) -> tuple:
        endpoints = [] if u["endpoints"] is None else list(u["endpoints"])
        content = f"File {u['path']}, lines {u['start_line']}-{u['end_line']}.\n"
        if u["head"]:
            content += f"CONTEXT (not to be cited):\n{u['head']}\n"
        content += f"CODE:\n{u['shown']}\nEntities: {json.dumps(entities)}\nEndpoints: {json.dumps(endpoints)}"
        if u.get("symbols"):
            content += f"\nSYMBOLS (exact; cite their lines):\n{u['symbols']}"
        messages = [{"role": "system", "content": f"State the rules that the code enforces as JSON with chunk_summary and rules, in {language}. Cite path and lines of this chunk only."}, {"role": "user", "content": content}]
        check = lambda reply: M.validate_map(reply, u["path"], u["start_line"], u["end_line"], entities, endpoints)
        base = (u["chunk_id"], u["path"], u["start_line"], u["end_line"])
        try:
            reply, spent = M.chat_json(chat, messages, check, 2)
            return (*base, reply.get("chunk_summary") or "", [_rule(r) for r in reply.get("rules") or []], False, None, *spent)
        except M.ModelError as e:
            return (*base, "", [], True, str(e)[:200], 0, 0)

    memo.work(memo.missing(units, ["chunk_id"], retry_failed), ["chunk_id"], call, workers, told)
    return memo.latest(["chunk_id"]).join(chunks.select(F.col("id").alias("chunk_id"), "domain"), "chunk_id")


def _columns(schema: str) -> list[str]:
    """The fields of a schema text, split at the commas outside of brackets."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[begin:k].strip())
            begin = k + 1
    return out


def usable(mapped: DataFrame) -> DataFrame:
    """Outputs that did not fail and have rules."""
    return mapped.where(~F.coalesce("failed", F.lit(False)) & (F.coalesce(F.size("rules"), F.lit(0)) > 0))


def candidates_hash(rules: Column) -> Column:
    """Content hash of an array of candidate rules, with the prompt's version; by requirement and title, so their order doesn't count."""
    line = lambda r: F.concat(F.coalesce(r["requirement"], F.lit("")), F.lit("\t"), F.coalesce(r["title"], F.lit("")), F.lit("\t"), F.to_json(r))
    return X.short_hash(F.concat(F.lit(PROMPT_VERSION + "\n"), F.array_join(F.array_sort(F.transform(rules, line)), "\n")))


def usage(rows: DataFrame, *by: str) -> DataFrame:
    """(.., prompt, completion): tokens summed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return rows.groupBy(*by).agg(total("prompt"), total("completion"))


def reduce_domains(mapped: DataFrame, entities: list[str], endpoints: list[str], chat: Chat, memo: Memo, lang: str = "fr", size: int = BATCH, workers: int = 4, retry_failed: bool = False, told: Told = None) -> DataFrame:
    """(domain, domain_summary, rules, failed): the candidates of each domain consolidated.

    Batches of `size` candidates, by path and line, are the units of work and of the memo, so a domain that holds most
    candidates is no one task's. Rules of one requirement are merged over batches, slugs made unique after.
    """
    candidates = usable(mapped).select("domain", "path", "start_line", F.posexplode("rules").alias("pos", "rule"))
    numbered = windows.batches(candidates, ["domain"], ["path", "start_line", "pos"], size)
    rows = numbered.groupBy("domain", "batch").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "pos", "rule"))).alias("xs"))
    units = rows.select("domain", "batch", candidates_hash(F.transform("xs", lambda x: x["rule"])).alias("candidates_hash"), F.to_json(F.transform("xs", lambda x: x["rule"])).alias("candidates"))
    language = "English" if lang == "en" else "French"

    def call(u: dict) -> tuple:
        def ask(part: list[dict], corrections: int) -> tuple[dict, M.Usage]:
            cited = {(c["path"], c["lines"]) for r in part for c in r.get("citations") or []}
            messages = [{"role": "system", "content": f"Consolidate the candidate rules of one domain as JSON with domain_summary and rules, in {language}. Keep citations word for word."}, {"role": "user", "content": f"Domain {u['domain']}\n{json.dumps(part, ensure_ascii=False)}\nEntities: {json.dumps(entities)}\nEndpoints: {json.dumps(endpoints)}"}]
            return M.chat_json(chat, messages, lambda reply: M.validate_reduce(reply, cited, entities, endpoints), corrections)

        got = M.reduce_adaptively(json.loads(u["candidates"]), ask)
        failed = not got.rules and bool(got.error)
        return (u["domain"], u["batch"], u["candidates_hash"], got.summary, [_rule(r) for r in got.rules], failed, got.error[:200] if got.error else None, got.dropped, *got.usage)

    keys = ["domain", "batch", "candidates_hash"]
    memo.work(memo.missing(units, keys, retry_failed), keys, call, workers, told)
    return memo.latest(keys).join(units.select(*keys), keys, "left_semi")


def consolidated(reduced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, summaries) of usable batches: rules with their domain, one for each requirement, slugs unique."""
    ok = reduced.where(~F.col("failed"))
    r = ok.select("domain", "batch", F.posexplode("rules").alias("pos", "rule")).select("domain", "batch", "pos", "rule.*")
    merged = merge.merge_by_requirement(r, ["domain"], ["batch", "pos"])
    named = merge.name_uniquely(merged, ["domain"], "slug", ["batch", "pos"], "unique").withColumn("slug", F.col("unique")).drop("unique", "batch", "pos")
    summaries = ok.groupBy("domain").agg(F.coalesce(F.min_by("domain_summary", F.when(F.col("domain_summary") != "", F.col("batch"))), F.lit("")).alias("domain_summary"))
    return named, summaries


def crosscheck(rules: DataFrame, excerpts: DataFrame, symbols: DataFrame, chat: Chat, memo: Memo, repair: bool = False, workers: int = 4, retry_failed: bool = False, told: Told = None) -> DataFrame:
    """A verdict for each rule node (id, title, body, sources); with `repair`, better citations for what isn't supported.

    excerpts: (rule_id, excerpt); symbols: see SYMBOL; each rule gets those of its cited paths. A rule that cites something
    without an excerpt raises: its file can't be read.
    """
    base = rules.where("type = 'rule'").join(excerpts.withColumnRenamed("rule_id", "id"), "id", "left")
    lost = base.where("excerpt is null and size(sources) > 0").orderBy("id").select("id").limit(5).collect()
    if lost:
        raise FileNotFoundError(f"cited lines that can't be read: {', '.join(r[0] for r in lost)}")
    base = base.withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    hashed = base.withColumn("input_hash", X.short_hash(F.concat_ws("\n", "id", "title", "body", "excerpt")))
    each = F.collect_list(F.struct("start_line", "end_line", "name", "kind", "signature"))
    spans = symbols.groupBy("path").agg(each.alias("spans"), catalog(each).alias("shown"))
    near = hashed.select("id", F.explode("sources.path").alias("path")).distinct().join(spans, "path").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "spans", "shown"))).alias("symbols"))
    units = hashed.join(near, "id", "left").select(F.col("id").alias("rule_id"), "input_hash", "title", "body", "excerpt", F.to_json("sources").alias("sources"), F.to_json("symbols").alias("symbols"))

    def call(u: dict) -> tuple:
        sources, held = json.loads(u["sources"] or "[]"), json.loads(u["symbols"] or "[]")
        known = {s["path"]: [(x["start_line"], x["end_line"]) for x in s["spans"]] for s in held}
        messages = [{"role": "system", "content": "Does the cited code support the rule? Reply as JSON with verdict and reason."}, {"role": "user", "content": f"{u['title']}\n{u['body']}\n{u['excerpt']}"}]
        try:
            reply, spent = M.chat_json(chat, messages, M.validate_verdict, 2)
            verdict, reason, new = reply["verdict"], reply["reason"], []
            if repair and verdict in ("partial", "unsupported") and known:
                listed = "\n".join(f"{s['path']}:\n{s['shown']}" for s in held)
                ask = [{"role": "system", "content": "Propose citations that support the rule, as JSON with citations of path and lines."}, {"role": "user", "content": f"{u['title']}\n{u['body']}\n{listed}"}]
                try:
                    proposed, more = M.chat_json(chat, ask, lambda r: list(r.get("citations") or []), 1)
                    spent = (spent[0] + more[0], spent[1] + more[1])
                    new = M.grounded(proposed, {s["path"] for s in sources}, known)
                except M.ModelError:
                    new = []
                if new:
                    verdict = "repaired"
            return (u["rule_id"], u["input_hash"], verdict, reason, new, False, None, *spent)
        except M.ModelError as e:
            return (u["rule_id"], u["input_hash"], None, None, [], True, str(e)[:200], 0, 0)

    keys = ["rule_id", "input_hash"]
    memo.work(memo.missing(units, keys, retry_failed), keys, call, workers, told)
    return memo.latest(keys).join(units.select(*keys), keys, "left_semi")


#: The counters of a review.
TALLY = ("supported", "partial", "unsupported", "repaired", "failed")


def tally(verdicts: DataFrame) -> DataFrame:
    """One row: how many reviews ended with each verdict; a failed one counts as failed alone."""
    return verdicts.agg(*(F.count_if(~F.col("failed") & (F.col("verdict") == k)).alias(k) for k in TALLY[:-1]), F.count_if("failed").alias("failed"))


def annotate(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Nodes with their verdicts; a failed or missing one leaves a node as it is, a repaired one has new sources."""
    v = verdicts.where(~F.col("failed")).select(F.col("rule_id").alias("id"), "verdict", "new_citations")
    j = nodes.join(v, "id", "left")
    kept = F.map_filter("extra", lambda k, _: k != "crosscheck")
    extra = F.when(F.col("verdict").isNull(), F.col("extra")).otherwise(F.map_concat(kept, F.create_map(F.lit("crosscheck"), F.col("verdict"))))
    sources = F.when(F.col("verdict") == "repaired", F.array_sort("new_citations")).otherwise(F.col("sources"))
    return j.withColumns({"extra": extra, "sources": sources}).drop("verdict", "new_citations")


