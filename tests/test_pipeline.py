"""A small tree, a model that is a function, the whole way: run, verify, drift; twice, with equal bytes."""

import json
import os
import re

import pytest

from loomgraph import pipeline
from loomgraph.config import Config
from loomgraph.operators import checks

ALLOCATOR = """<?php

namespace Depot\\Lockers\\Placement;

use Depot\\Goods\\Weights\\Parcel;

final class Allocator
{
    public function choose(array $free, Parcel $parcel): ?string
    {
        foreach ($free as $door => $grams) {
            if ($grams >= $parcel->grams()) {
                return $door; // the first that bears it }
            }
        }
        return null;
    }
}
"""
PARCEL = """<?php

namespace Depot\\Goods\\Weights;

use Depot\\Lockers\\Placement\\Allocator;

final class Parcel
{
    public function grams(): int { return $this->kilos * 1000; }
}
"""
DOORS = """<?php

use Depot\\Lockers\\Placement\\Allocator;

Route::put('lockers/{door}/parcel', 'Allocator@choose');
Route::delete('/lockers/{door}', [Allocator::class, 'choose']);
"""
SCHEMA = """-- doors of one wall
create table parcel_doors
(
  door varchar(8) not null,
  grams_borne int default 5000, -- as tested
  check (grams_borne > 0)
);
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in (("lib/Allocator.php", ALLOCATOR), ("lib/Parcel.php", PARCEL), ("http/doors.php", DOORS), ("sql/doors.sql", SCHEMA), ("skipped/twin.php", ALLOCATOR), (".cache/x.php", ALLOCATOR), ("notes/_empty.txt", ""), ("bin/raw.dat", "\0\1")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def chat(messages):
    """A model that finds one rule in each chunk and passes candidates on."""
    system, user = messages[0]["content"], messages[1]["content"]
    if "support" in system:
        return json.dumps({"verdict": "supported", "reason": "cited"}), (3, 1)
    if "candidate" in system:
        rules = json.loads(user.split("\n")[1])
        return "```json\n" + json.dumps({"domain_summary": "What " + user.split("\n")[0], "rules": rules}) + "\n```", (5, 2)
    path, a, b = re.match(r"File (.*), lines (\d+)-(\d+)", user).groups()
    rule = {"title": f"Rule of {path}", "ears_kind": "ubiquitous", "requirement": f"The system shall keep {path} lines {a} to {b}.", "citations": [{"path": path, "lines": f"{a}-{b}"}], "nature": "business", "origin": "explicit", "confidence": 0.125, "entities": ["entity.parcel-doors"]}
    return json.dumps({"chunk_summary": "s", "rules": [rule]}), (10, 4)


def everything(folder):
    out = {}
    for at, _, names in os.walk(folder):
        for n in names:
            p = os.path.join(at, n)
            if "cache" not in p and not n.startswith("state"):
                with open(p, "rb") as f:
                    out[os.path.relpath(p, folder)] = f.read()
    return out


def test_run_verify_drift(spark, tree, tmp_path):
    out = str(tmp_path / "spec")
    config = Config(src=tree, out=out, exclude=["skipped"], crosscheck=True).checked()
    def counted(messages):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        return chat(messages)

    summary = pipeline.run(spark, config, counted)
    assert summary["types"]["entity"] == 1 and summary["types"]["endpoint"] == 2
    assert summary["types"]["rule"] == 4 and summary["tally"]["supported"] == 4
    assert summary["coverage"]["entities_touched"] == 1
    n_calls = len((tmp_path / "calls").read_text())
    assert n_calls == 4 + summary["types"]["domain"] + 4
    first = everything(out)
    page = first["nodes/entities/parcel-doors.md"].decode()
    assert "- `door:varchar(8)`\n- `grams_borne:int`" in page and "check" not in page
    rule = next(v.decode() for k, v in first.items() if k.startswith("nodes/rules/") and "Allocator.php" in v.decode())
    assert "confidence: 0.12\n" in rule and "crosscheck: supported\n" in rule and re.search(r"digest: [0-9a-f]{16}\n", rule)
    assert json.loads(first["graph.json"])["nodes"]["entity.parcel-doors"]["file"] == "nodes/entities/parcel-doors.md"
    assert pipeline.verify(spark, config).count() == 0

    def refuse(messages):
        raise AssertionError("a remembered unit was called again")

    pipeline.run(spark, config, refuse)
    assert everything(out) == first
    assert (tmp_path / "calls").read_text() == "x" * n_calls

    assert checks.drift_report(pipeline.drift(spark, config)).collect()[0]["drifted"] is False
    path = os.path.join(tree, "lib/Allocator.php")
    with open(path) as f:
        text = f.read()
    with open(path, "w") as f:
        f.write(text.replace("$grams >= $parcel", "$grams > $parcel"))
    os.remove(os.path.join(tree, "sql/doors.sql"))
    status = {r.rule_id: r.status for r in pipeline.drift(spark, config).collect()}
    assert sorted(status.values()) == ["broken", "ok", "ok", "stale"]
    assert {r.check for r in pipeline.verify(spark, config).collect()} == {"unresolvable-citation"}


def test_a_stopped_phase_goes_on_where_it_was(spark, tree, tmp_path):
    """A run that is stopped half-way through a phase loses no finished unit; what goes on is told and kept."""
    from loomgraph.state import State

    out, calls, told = str(tmp_path / "spec"), tmp_path / "calls", []
    config = Config(src=tree, out=out, exclude=["skipped"], workers=1).checked()

    def counted(limit):
        def call(messages):
            if calls.exists() and len(calls.read_text()) >= limit:
                raise RuntimeError("the power is out")
            with open(calls, "a") as f:
                f.write("x")
            return chat(messages)

        return call

    from loomgraph.operators import phases

    for k in range(10):  # more chunks than are stored at a time
        with open(os.path.join(tree, f"more{k}.txt"), "w") as f:
            f.write(f"keep {k}\n")
    with pytest.raises(Exception, match="power is out"):
        pipeline.run(spark, config, counted(10), told.append)
    assert told[0].kind == "started" and told[-1].values == {"ok": False}
    state = State(os.path.join(out, "state.json")).data
    assert state["phase"] == "map" and 1 <= state["counters"]["map"]["done"] <= 10
    stored = state["counters"]["map"]["done"]
    assert stored >= 10 - phases.FLUSH
    calls.unlink()
    told.clear()
    summary = pipeline.run(spark, config, counted(10_000), told.append)
    n_chunks, n_domains = summary["units"]["chunks"][0], summary["units"]["domains"][0]
    assert len(calls.read_text()) == n_chunks - stored + n_domains
    kinds = [e.kind for e in told]
    assert {"started", "scanned", "facts", "phase", "unit", "ended", "violations", "nodes", "finished"} <= set(kinds) and told[-1].values == {"ok": True}
    assert [e.values["done"] for e in told if e.kind == "unit" and e.values["phase"] == "map"][-1] == n_chunks - stored


def test_index_routes_and_symbols_reach_the_run(spark, tree, tmp_path):
    """An index gives precise symbols to prompts and repairs, a listing stands for the routes in files, a citation that can't be read stops the review."""
    from loomgraph.operators import phases

    symbol = "x . Allocator#choose()."
    document = {"relative_path": "lib/Allocator.php", "language": "PHP", "symbols": [{"symbol": symbol, "kind": 26, "display_name": "choose"}], "occurrences": [{"symbol": symbol, "symbol_roles": 1, "range": [8, 4, 9], "enclosing_range": [8, 4, 16, 5]}]}
    (tmp_path / "index.json").write_text(json.dumps({"documents": [document]}))
    (tmp_path / "routes.json").write_text(json.dumps([{"method": "PATCH|HEAD", "uri": "doors/{d}", "action": "Allocator@choose"}]))
    with open(os.path.join(tree, "artisan"), "w") as f:
        f.write("#!/usr/bin/env php\n")
    prompts = tmp_path / "prompts"

    def seen(messages):
        with open(prompts, "a") as f:
            f.write(messages[1]["content"] + "\n")
        if "support" in messages[0]["content"] and "Propose" not in messages[0]["content"]:
            return json.dumps({"verdict": "partial", "reason": "half of it"}), (1, 1)
        if "Propose" in messages[0]["content"]:
            return json.dumps({"citations": [{"path": "lib/Allocator.php", "lines": "10-12"}, {"path": "lib/Allocator.php", "lines": "1-2"}]}), (1, 1)
        return chat(messages)

    config = Config(src=tree, out=str(tmp_path / "spec"), exclude=["skipped"], repair=True, index=[str(tmp_path / "index.json")], routes=str(tmp_path / "routes.json")).checked()
    summary = pipeline.run(spark, config, seen)
    assert summary["types"]["endpoint"] == 1 and summary["tally"]["repaired"] == 1 and summary["tally"]["partial"] == summary["types"]["rule"] - 1
    assert "SYMBOLS (exact; cite their lines):\n- choose (method) lines 9-17" in prompts.read_text()
    pages = [v.decode() for k, v in everything(config.out).items() if "Allocator.php" in v.decode() and k.startswith("nodes/rules/")]
    assert len(pages) == 1 and 'lines: "10-12"' in pages[0]
    nodes = spark.createDataFrame([("rule.a.b", "rule", "t", "b", [("gone.php", "1-2")])], "id string, type string, title string, body string, sources array<struct<path:string,lines:string>>")
    memo = phases.Memo(spark, str(tmp_path / "memo"), phases.VERDICT)
    with pytest.raises(FileNotFoundError, match=r"rule\.a\.b"):
        phases.crosscheck(nodes, spark.createDataFrame([], "rule_id string, excerpt string"), spark.createDataFrame([], phases.SYMBOL), seen, memo)


def test_summary_names_all_files_without_a_grammar(spark):
    nodes = spark.createDataFrame([], "id string, type string, title string, body string, sources array<struct<path:string,lines:string>>, extra map<string,string>")
    edges = spark.createDataFrame([], "src string, type string, dst string")
    names = [f"d/f{k:04}.txt" for k in range(2100)]
    files = spark.createDataFrame([(n, "") for n in reversed(names)] + [("a.go", "go")], "path string, language string")
    page = pipeline.summary_page(pipeline.summarise(nodes, edges, files, {}, {}, {"chunks": (0, 0), "domains": (0, 0)}))
    assert f"- Fichiers sans grammaire (fallback lignes) : {', '.join(names)}\n" in page
