import json
import random
import sys

import pytest

import __spark_entry__ as entry
from loomgraph import plain_yaml
from loomgraph.config import ConfigError, resolve
from loomgraph.operators import chunks, render
from loomgraph.sources import facts, scanners, tree
from loomgraph.state import State


def spans(found, kind="definitions"):
    return [(d["kind"], d["name"], d["start_line"], d["end_line"]) for d in found[kind]]


def test_scanners_by_language():
    php = "<?php\nnamespace A\\B;\nuse C\\D;\nuse E\\{F, G as H};\nabstract class X\n{\n  use T;\n  public static function m() { $s = \"} {$x}\"; }\n}\nfunction f() {\n}\n$g = function () {};\n"
    f = scanners.parse("php", php)
    assert spans(f) == [("class", "X", 5, 9), ("method", "m", 8, 8), ("function", "f", 10, 11)]
    assert f["definitions"][1]["visibility"] == "public" and f["modules"][0]["name"] == "A\\B"
    assert [i["target"] for i in f["imports"]] == ["C\\D", "F", "G"]
    go = "package m\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() {\n\tfmt.Println(\"}\")\n}\n\nfunc main() {}\n"
    f = scanners.parse("go", go)
    assert spans(f) == [("type", "T", 8, 10), ("method", "M", 12, 14), ("function", "main", 16, 16)]
    assert [i["target"] for i in f["imports"]] == ["fmt", "a/b"] and f["modules"][0]["name"] == "m"
    ts = "import x from 'y';\ninterface I { a: string }\ntype T = string;\nenum E { A }\nexport class C {\n  private async m(a: { b: number }): Promise<void> {\n    if (a) { return; }\n  }\n}\nfunction f() { return `}${1}` }\n"
    f = scanners.parse("typescript", ts)
    assert spans(f) == [("interface", "I", 2, 2), ("type", "T", 3, 3), ("enum", "E", 4, 4), ("class", "C", 5, 9), ("method", "m", 6, 8), ("function", "f", 10, 10)]
    assert [i["target"] for i in f["imports"]] == ["y"]
    rust = "use std::fmt as g;\nmod m {}\nstruct S;\nenum E { A }\ntrait T { fn q(); }\nimpl S {\n    pub fn n(&self) -> char { '}' }\n}\nfn f() {}\n"
    f = scanners.parse("rust", rust)
    assert spans(f) == [("struct", "S", 3, 3), ("enum", "E", 4, 4), ("trait", "T", 5, 5), ("impl", "S", 6, 8), ("function", "n", 7, 7), ("function", "f", 9, 9)]
    assert f["imports"][0]["target"] == "std::fmt" and f["modules"][0]["name"] == "m"
    for g in scanners.SCANNERS:
        assert scanners.parse(g, "")["definitions"] == [] and scanners.parse(g, b"\xff{{{((")


def test_tables():
    script = """/* create table not_this (x int); */
CREATE UNLOGGED TABLE harbour.`tide log`(station char(3),level DOUBLE PRECISION, -- metres (above datum)
  at timestamptz default (now() at time zone 'utc'), depth decimal(6, 3), unique (station, at), "key" text, KEY by_station (station)
);
drop table berth;
create temporary table if not exists "berth" ( number smallint,
  quay text check (quay in ('n', 's')), CONSTRAINT numbered primary key (number) ) with (fillfactor = 70);
CREATE TABLE broken (a int, b varchar(9
"""
    assert [(t["name"], t["columns"], t["line"]) for t in scanners.parse_tables(script)] == [
        ("harbour.`tide log", ["station:char(3)", "level:double", "at:timestamptz", "depth:decimal(6", "key:text"], 2),
        ("berth", ["number:smallint", "quay:text"], 6),
    ]
    assert scanners.parse_tables("") == scanners.parse_tables("create table x") == scanners.parse_tables("create (a int)") == []
    assert scanners.parse_tables("create table e ()") == [{"name": "e", "columns": [], "line": 1}]


def test_go_routes():
    text = """package quay

func (d *Desk) mount(mux *Mux, tides Almanac) {
    coast := mux.Group("/coast/")
    north := coast.Group("/north")
    north.Patch("/tides/:day", tides.Correct)
    coast.DELETE("", d.forget)
    mux.Handle("OPTIONS", "/any", preflight())
    mux.HandleFunc("PUT /moorings/{n}", func(w W, r *R) { north.GET("/inner", moor) })
    north.Patch("/tides/:day", later)
    log.Get("no path here", d)
}

func other(north *Mux) {
    north.GET("/plain", moor)
}
"""
    got = [(r["method"], r["path"], r["handler"], r["closure"], r["start_line"]) for r in scanners.go_routes(text)]
    assert sorted(got) == [
        ("DELETE", "/coast", "quay.Desk.forget", False, 7), ("GET", "/coast/north/inner", "quay.moor", False, 9), ("GET", "/plain", "quay.moor", False, 15), ("OPTIONS", "/any", "quay.preflight", False, 8),
        ("PATCH", "/coast/north/tides/:day", "quay.Almanac.Correct", False, 6), ("PUT", "/moorings/{n}", "", True, 9),
    ]


def test_php_routes_and_tables():
    text = "<?php\n// Route::get('/never', 'X@y');\nRoute::patch('buoys/{id}', [\\Sea\\Buoys::class, 'drift']);\nRoute::any('/bells', 'Bells@toll');\nRoute::get($computed, 'X@y');\nSchema::create('buoys', function ($row) {\n  $row->decimal('lat', 9, 6);\n  $row->text('mark')->nullable();\n});\n"
    assert [(r["method"], r["path"], r["controller"], r["action"], r["start_line"]) for r in scanners.php_routes(text)] == [("patch", "/buoys/{id}", "Sea\\Buoys", "drift", 3), ("any", "/bells", "Bells", "toll", 4)]
    assert [(t["name"], t["columns"], t["start_line"], t["end_line"]) for t in scanners.php_tables(text)] == [("buoys", ["lat:decimal", "mark:text"], 6, 9)]


def test_chunks(spark):
    body = "\n".join(f"        $x{k} = {k};" for k in range(170))
    big = "<?php\n\nclass Big\n{\n    private $a;\n\n" + "".join(f"    public function m{k}()\n    {{\n{body}\n    }}\n" for k in range(2)) + "}\n"
    files = spark.createDataFrame([("a.php", "php", big), ("n.xyz", "", "\n".join(map(str, range(600)))), ("e.go", "go", ""), ("s.go", "go", "package p\n\nfunc f() {\n}\n")], "path string, language string, text string")
    parsed = scanners.parse_files(files.withColumnRenamed("text", "content"))
    got = {(r.path, r.start_line, r.end_line): r for r in chunks.chunk_files(files, parsed).collect()}
    assert sorted(got) == [("a.php", 7, 179), ("a.php", 180, 352), ("n.xyz", 1, 250), ("n.xyz", 231, 480), ("n.xyz", 461, 600), ("s.go", 3, 4)]
    assert got["a.php", 7, 179].context.startswith("class Big") and got["a.php", 7, 179].context_start == 3 and got["s.go", 3, 4].namespace == "p"
    f = {r.id: r.attrs for r in chunks.universal_facts(parsed).collect()}
    assert f["symbol.a.php#m0:7"]["container"] == "Big" and f["module.p"] == {"name": "p", "language": "go"}


def test_chunk_spans_equal_loops():
    rng = random.Random(7)
    inside = lambda o, x: o != x and o[0] <= x[0] and x[1] <= o[1]
    for _ in range(300):
        spans = [(a := rng.randint(1, 40), a + rng.randint(0, 30)) for _ in range(rng.randint(0, 12))]
        want = set()
        for t in {x for x in spans if not any(inside(o, x) for o in spans)}:
            held = {x for x in spans if inside(t, x)} if t[1] - t[0] + 1 > 8 else set()
            parts = {x for x in held if not any(inside(o, x) for o in held)}
            first = min((x[0] for x in parts), default=t[0])
            want |= {(*x, *((t[0], first - 1) if first > t[0] else (None, None))) for x in parts or {t}}
        got = chunks.spans_of(spans, 8)
        assert len(got) == len(set(got)) and set(got) == want


def test_part_of_two_spans_is_given_once_for_each(spark):
    files = spark.createDataFrame([("p", "go", "\n".join(map(str, range(1, 601))))], "path string, language string, text string")
    spans = [{"start_line": a, "end_line": b} for a, b in ((1, 400), (200, 600), (250, 300))]
    parsed = spark.createDataFrame([("p", spans, [{"name": "m", "start_line": 260}, {"name": "k", "start_line": 10}])], "path string, definitions array<struct<start_line:int,end_line:int>>, modules array<struct<name:string,start_line:int>>").selectExpr("path", "'go' as language", "definitions", "modules")
    got = chunks.chunk_files(files, parsed, max_lines=100).collect()
    assert sorted((r.start_line, r.end_line, r.context_start, r.context[:3], r.namespace) for r in got) == [(250, 300, 1, "1\n2", "k"), (250, 300, 200, "200", "k")]


def test_source_chunks_move_texts_once(spark):
    plan = entry.queries()["source_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tree(spark, tmp_path):
    for name, data in (("a/x.PHP", b"<?php"), ("a-b/_y.go", b""), ("b.bin", b"\0"), ("é.txt", "é".encode()), ("latin.txt", b"\xe9" * 9), (".h/z", b"z"), ("node_modules/q.js", b"q")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path: r.language for r in tree.read_tree(spark, str(tmp_path), ["node_modules"]).collect()} == {"a/x.PHP": "php", "a-b/_y.go": "go", "é.txt": ""}
    assert tree.looks_binary("é".encode() * 3999 + b"\xc3") is False and tree.looks_binary(b"\x01" * 4 + b"a" * 6)


def test_fact_sources(spark, tmp_path):
    envelope = {"schema": "facts/v1", "facts": [{"kind": "table", "id": "table.t", "attrs": {"name": "t"}, "source": {"path": "p", "lines": "1-2"}}]}
    path = tmp_path / "given.json"
    path.write_text(json.dumps(envelope))
    assert facts.load_facts_file(spark, str(path)).collect()[0].origin == "given.json"
    path.write_text(json.dumps(envelope | {"schema": "x"}))
    with pytest.raises(facts.FactsError):
        facts.load_facts_file(spark, str(path))
    script = f"import sys; print({json.dumps(json.dumps(envelope))})"
    layers, status = facts.run_extractors(spark, {"good": [sys.executable, "-c", script, "{src}"], "bad": [sys.executable, "-c", "sys.exit(3)"], "none": ["/no/such/program"], "noise": [sys.executable, "-c", "print(1)"]}, "src")
    assert layers[0].collect()[0].origin == "good" and status["good"] == "ok" and all(status[n].startswith("failed") for n in ("bad", "none", "noise"))
    with pytest.raises(facts.FactsError):
        facts.run_extractor(spark, "slow", [sys.executable, "-c", "import time; time.sleep(9)"], "", timeout=0.5)
    routes = facts.runtime_routes(spark, '[{"method": "GET|HEAD", "uri": "a/b", "action": "C@m"}]').collect()[0]
    assert routes.id == "route.get./a/b" and routes.certainty == "proved" and routes.attrs["action"] == "m"
    doc = {"relative_path": "./s.go", "language": "Go", "symbols": [{"symbol": "g . p/T#M().", "kind": 26}], "occurrences": [{"symbol": "g . p/T#M().", "symbol_roles": 1, "range": [4, 1, 2], "enclosing_range": [4, 0, 8, 1]}, {"symbol": "g . p/T#M().", "symbol_roles": 0, "range": [9, 1, 2]}]}
    got = facts.index_facts(spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc | {"relative_path": "../x"}),)], "document string")).collect()
    assert [(r.id, r.source.lines, r.attrs["kind"], r.certainty) for r in got] == [("symbol.s.go#M:5", "5-9", "method", "proved")]


def test_pages_round_trip(spark):
    rows = [("rule.d.s", "rule", "T: é", "b", [("a: b.php", "1-2"), ("c.php", "3-4")], {"ears": "event", "confidence": "0.50", "digest": "0" * 16}), ("domain.d", "domain", "d", "", [], {})]
    nodes = spark.createDataFrame(rows, "id string, type string, title string, body string, sources array<struct<path:string,lines:string>>, extra map<string,string>")
    edges = spark.createDataFrame([("rule.d.s", "touches", "entity.z"), ("rule.d.s", "belongs_to", "domain.d")], "src string, type string, dst string")
    full = render.with_edges(nodes, edges)
    assert render.round_trip(full).count() == 0
    page = {r.id: r.page for r in render.pages(full).collect()}["rule.d.s"]
    assert page.startswith('---\nid: rule.d.s\ntype: rule\nstatus: generated\nsources:\n  - path: "a: b.php"\n    lines: "1-2"\n') and "[Domaine d](../domains/d.md) · [entity.z]" in page
    assert [e["type"] for e in render.parse_page(page)["edges"]] == ["belongs_to", "touches"]
    for bad in ("x", "---\nid: a\n", "---\nwhat: 1\n---\n"):
        with pytest.raises(render.PageError):
            render.parse_page(bad)
    assert json.loads("".join(render.graph_json(full)))["nodes"]["domain.d"]["edges"] == []


def test_settings_files(tmp_path):
    from loomgraph import cli

    text = """# settings of a tree
exclude: [cache, 'old stuff']
extractors:
  - name: tides
    cmd: tidal
    args: [--from, "{src}"]   # the root
    timeout: 1m30s
  - {name: bells, cmd: bell}
facts_files:
- a.json
domain_strategy: directory
domain_depth: 2
"""
    (tmp_path / "loomgraph.yaml").write_text(text)
    _, c = cli.parse(["run", "--src", str(tmp_path), "--facts", "b.json", "--facts", "a.json"])
    assert (c.exclude, c.strategy, c.domain_depth, c.facts) == (["cache", "old stuff"], "directory", 2, ["b.json", "a.json"])
    assert c.extractors == {"tides": ["tidal", "--from", "{src}"], "bells": ["bell"]} and c.timeouts == {"tides": 90}
    _, c = cli.parse(["run", "--src", str(tmp_path), "--exclude", "x, y", "--strategy", "auto", "--domain-depth", "3", "--reduce-batch", "9", "--format", "json"])
    assert (c.exclude, c.strategy, c.domain_depth, c.reduce_batch, c.format) == (["x", "y"], "auto", 3, 9, "json")
    assert "vendor" in resolve({}, env={}).exclude and resolve({}, {"exclude": []}, {}).exclude == resolve({}, env={}).exclude
    for bad in ({"extractors": [{"name": "a"}]}, {"extractors": [{"name": "a", "cmd": "b", "timeout": "soon"}]}, {"format": "xml"}, {"log_level": "loud"}):
        with pytest.raises(ConfigError):
            resolve({}, bad, {})
    for bad in ("a: 1\n  b: 2\n", "a: [1, 2\n", "a: &x 1\n", "a: 1\na: 2\n", "\ta: 1\n"):
        with pytest.raises(ValueError):
            plain_yaml.load(bad)
    assert plain_yaml.load("a:\n- b: 'it''s'\n  c: |\n    x\n     y\n- - 1\n  - ~\nd: >-\n  e\n  f\n") == {"a": [{"b": "it's", "c": "x\n y\n"}, [1, None]], "d": "e f"} and plain_yaml.load("# none\n") is None


def test_hand_edited_pages():
    page = "---\n# moved\ntype: rule\nid: 'rule.a.b'\nstatus:   kept\nsources: [{path: \"x y.go\", lines: 1-2}]\nedges:\n  - type: belongs_to\n    to: domain.a\nconfidence: .5\n---\n\n# T\n"
    node = render.parse_page(page)
    assert (node["id"], node["status"], node["title"]) == ("rule.a.b", "kept", "T") and node["sources"] == [{"path": "x y.go", "lines": "1-2"}]
    assert node["edges"] == [{"type": "belongs_to", "to": "domain.a"}] and node["extra"] == {"confidence": "0.50"}


def test_settings_and_state(tmp_path):
    c = resolve({"model": "m", "repair": True, "domain_depth": 0, "facts": ["a"]}, {"model": "n", "endpoint": "e", "facts": ["b", "a"]}, {"LOOMGRAPH_ENDPOINT": "env"})
    assert (c.model, c.endpoint, c.crosscheck, c.domain_depth, c.facts) == ("m", "env", True, 1, ["a", "b"])
    for bad in ({"lang": "de"}, {"workers": 0}, {"strategy": "x"}, {"nonsense": 1}):
        with pytest.raises(ConfigError):
            resolve(bad, env={})
    with pytest.raises(ConfigError):
        resolve({}, env={}).needs_model()
    s = State(str(tmp_path / "s.json"))
    s.phase("map", 5, 1, 10, 2)
    s = State(str(tmp_path / "s.json"))
    s.phase("map", 3, 0, 1, 1)
    assert s.data["tokens"]["map"] == {"prompt": 11, "completion": 3} and s.data["counters"]["map"] == {"total": 3, "done": 3, "failed": 0}


def test_all_rules_have_heads(spark, tmp_path):
    """Nulls, NaN and odd paths give heads that read back as they were."""
    import datetime as dt

    from loomgraph.operators import render
    from loomgraph.plans import catalog
    from loomgraph.plans import sources as plans

    at = dt.datetime(2024, 1, 1)
    odd = [("a b/c: d.go", "1-2"), ("", "x"), (None, "3-4"), ("p.go", None), ('q"\\.go', 'l"\\'), ("é\n#.go", "5-6"), ("- z", "7-8"), None]
    rows = [
        (1, "d", "s1", "t", odd, ["entity.a", None], [None, "endpoint.get.x"], 0.5), (2, "d", "s2", "t", [("ok.go", "1-2")], None, None, float("nan")), (3, None, "s3", None, None, [None], None, None),
        (4, "d", None, "t", [], [], [], 1.0), (5, "d", "s5", "t", [(p, "1-1") for p in ("tail ", "*x", "a #b", "plain")], ['entity."q', "entity.l\nm"], [""], 0.25),
    ]
    schema = "rule_id bigint, domain string, slug string, title string, citations array<struct<path:string,lines:string>>, entities array<string>, endpoints array<string>, confidence double, ears_kind string, requirement string, rationale string, acceptance_criteria array<string>, nature string, origin string, received_at timestamp, generated_at timestamp"
    spark.createDataFrame([(*r, "event", "req", None, None, "business", "explicit", at, at) for r in rows], schema).write.parquet(str(tmp_path / "rules.parquet"))
    run = lambda name: {r.id: r["head"] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    heads = run("frontmatter_render")
    assert set(heads) == {"rule.1.s1", "rule.2.s2", "rule.3.s3", "rule.4.", "rule.5.s5"}
    assert not render.round_trip(plans._with_edges(spark, str(tmp_path))).count()
    node = render.parse_page(heads["rule.1.s1"])
    assert sorted((c["path"], c["lines"]) for c in node["sources"]) == sorted((c[0] or "", c[1] or "") if c else ("", "") for c in odd)
    assert [e["to"] for e in node["edges"]] == ["domain.1", "entity.a", "endpoint.get.x"]
    assert render.parse_page(heads["rule.2.s2"])["extra"]["confidence"] == "0.00"
