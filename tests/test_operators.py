"""Joins, merges and checks against plain loops on random input, and their defined results on odd input."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph import durable
from loomgraph.operators import checks, graph, joins, merge, similar, skew
from loomgraph.operators import model as M


def strictly(o, i):
    return o[0] <= i[0] and i[1] <= o[1] and o != i


def test_span_joins_equal_loops(spark):
    rng = random.Random(3)
    spans = {}
    for k in range(60):
        a = rng.randint(1, 40)
        spans[f"f{k % 3}|{k:02}"] = (a, a + rng.randint(0, 20))
    df = spark.createDataFrame([(r.split("|")[0], r, *s) for r, s in spans.items()] + [(None, "none", 1, 2)], "key string, row string, start int, end int")
    peers = lambda r: [x for x in spans if x[:2] == r[:2]]
    got = {r.row: r.container for r in joins.containers(df).collect()}
    want = {}
    for r, s in spans.items():
        around = [(spans[o][1] - spans[o][0], spans[o][0], o) for o in peers(r) if strictly(spans[o], s)]
        if around:
            want[r] = min(around)[2]
    assert got == want
    tops = {r.row for r in joins.top_level(df).collect()} - {"none"}
    assert tops == {r for r in spans if not any(strictly(spans[o], spans[r]) for o in peers(r))}
    pairs = {tuple(r) for r in joins.direct_children(df, joins.top_level(df)).collect()}
    brute = set()
    for p in tops:
        inside = [r for r in peers(p) if strictly(spans[p], spans[r])]
        brute |= {(p, r) for r in inside if not any(strictly(spans[o], spans[r]) for o in inside)}
    assert pairs == brute


def test_as_of_falls_back_to_the_first(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 1), (4, None, 1)], "row int, key string, at int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 9, "z")], "key string, start int, value string")
    assert {r.row: r.value for r in joins.as_of(left, right, "key", "at", "start", "value").collect()} == {1: "y", 2: "x", 3: None, 4: None}


def test_prefix_suffix_and_substring(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "b"]), (3, [])], "row int, parts array<string>")
    table = spark.createDataFrame([("a", "d1"), ("a/b", "d2"), ("b", "d3"), ("x/b", "d3"), ("c", "d4"), ("b/c", "d5")], "key string, value string")
    assert {tuple(r) for r in joins.longest_prefix(left, table, "row", "parts", "key", "value").collect()} == {(1, "d2"), (2, "d3")}
    assert {tuple(r) for r in joins.unique_suffix(left, table, "row", "parts", "key", "value").collect()} == {(2, "d3")}
    targets = spark.createDataFrame([("App\\FooBar@x",), ("",)], "target string")
    names = spark.createDataFrame([("App\\Foo",), ("",), ("Bar",), ("zz",)], "name string")
    few = {tuple(r) for r in joins.contains_link(targets, names, "target", "name").collect()}
    assert few == {("App\\FooBar@x", "App\\Foo"), ("App\\FooBar@x", "Bar"), ("App\\FooBar@x", ""), ("", "")}


def test_contains_link_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("abé\\") for _ in range(rng.randint(least, most)))
    texts, names = [(word(0, 12), k) for k in range(80)] + [(None, 99)], [(word(0, 5), k) for k in range(60)] + [(None, 99), ("", 98)]
    got = joins.contains_link(spark.createDataFrame(texts, "t string, k int"), spark.createDataFrame(names, "n string, j int"), "t", "n")
    assert sorted(map(tuple, got.select("k", "j").collect())) == sorted((k, j) for t, k in texts for n, j in names if t is not None and n is not None and n in t)


def test_as_of_equals_brute_force(spark):
    """Also over keys that range over several partitions, with ties, nulls and rows before the first."""
    rng = random.Random(8)
    right = [(rng.choice("aaaab"), rng.randint(0, 60), rng.choice("wxyz")) for _ in range(300)] + [(None, 1, "n"), ("a", None, "n"), ("c", 50, None)]
    left = [(k, rng.choice("aaaabcd"), rng.randint(-5, 70)) for k in range(300)] + [(900, None, 3), (901, "a", None)]
    l, r = spark.createDataFrame(left, "row int, key string, at int"), spark.createDataFrame(right, "key string, s int, v string")
    got = {x.row: x.v for x in joins.as_of(l, r, "key", "at", "s", "v").collect()}
    for row, key, at in left:
        own = [(s, v or "") for k, s, v in right if k == key and k is not None and s is not None] if at is not None else []
        before = [x for x in own if x[0] <= at]
        assert got[row] == ((max(before) if before else min(own))[1] or None if own else None), (row, key, at)


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 14))] for _ in range(60)]
    sets = {k: sorted(set(w)) for k, w in enumerate(base + [w[:-1] + ["zz"] for w in base] + base[:10] + [[]])}
    df = spark.createDataFrame(list(sets.items()), "row int, words array<string>")
    for t in (0.8, 0.4):
        got = {(r.a, r.b): r.similarity for r in similar.similar_sets(df, threshold=t).collect()}
        want = {}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b]:
                    x, y = set(sets[a]), set(sets[b])
                    if len(x & y) / len(x | y) >= t:
                        want[a, b] = len(x & y) / len(x | y)
        assert got == want
        near = similar.near_classes(df, threshold=t)
        for k in (1, 7, 30, 500):
            assert [tuple(r) for r in similar.closest(near, k).collect()] == sorted(((a, b, x) for (a, b), x in want.items()), key=lambda p: (-p[2], p[:2]))[:k]
        labels = {k: [None, "x", "y", "z"][k % 4] for k in sets}
        both = [(labels[a], labels[b]) for a, b in want if labels[a] and labels[b]]
        assert tuple(similar.count_pairs(near, spark.createDataFrame(list(labels.items()), "row int, label string")).collect()[0]) == (sum(a == b for a, b in both), sum(a != b for a, b in both))
    assert similar.similar_sets(df.limit(0)).count() == 0


def test_frequent_words_are_keys_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "RARE", 3)
    test_similar_sets_equal_brute_force(spark)


@pytest.mark.parametrize("query", ["duplicates_intra_cross", "near_duplicates"])
def test_duplicate_reports_keep_sets_whole(spark, monkeypatch, query):
    """No cut of a report is made by exploding words and joining them one by one."""
    plans = []
    monkeypatch.setattr(similar, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or durable.cut(df))
    entry.queries()[query](spark, "/root/testdata/sf0.001")
    assert plans and not [p for p in plans if "explode" in p]


def test_thresholds_as_fractions():
    assert [similar._fraction(t) for t in (0.8, 0.4, 1.0)] == [(4, 5), (2, 5), (1, 1)]
    for t in (1 / 3, 0.87654321, 1e-9):
        p, q = similar._fraction(t)
        assert 0 < q <= similar.FINEST and p > 0 and (p / q <= t < (p + 1) / q or p == 1)


def test_merges(spark):
    cols = "id string, certainty string, origin string, pos int, v string"
    a = spark.createDataFrame([("x", "static", "tree-sitter", 0, "a"), ("y", "proved", "tree-sitter", 1, "b"), ("y", "proved", "tree-sitter", 2, "c")], cols)
    b = spark.createDataFrame([("x", "static", "php", 0, "d"), ("y", "proved", "php", 0, "e")], cols)
    for layers in ([a, b], [b, a]):
        got = {r.id: r.v for r in merge.merge_facts(layers).collect()}
        assert got["x"] == "d" and got["y"] == ("b" if layers[0] is a else "e")
    rng = random.Random(1)
    rows = [(g, rng.choice(["a", "a-2", "b", "a-2-2", "a-3"]), k) for g in "pq" for k in range(40)]
    df = spark.createDataFrame(rows, "g string, name string, k int")
    got = {(r.g, r.k): r.unique_name for r in merge.name_uniquely(df, ["g"], "name", ["k"]).collect()}
    for g in "pq":
        taken = set()
        for gg, name, k in rows:
            if gg == g:
                assert got[g, k] == M.unique(name, taken)
    r = spark.createDataFrame([("d", "q", 1, "t1", [("p", "1-2")]), ("d", "q", 2, "t2", [("p", "1-2"), ("a", "3-4")]), ("d", None, 3, "t3", None)], "domain string, requirement string, n int, title string, citations array<struct<path:string,lines:string>>")
    got = {x.title: x.citations for x in merge.merge_by_requirement(r, ["domain"], ["n"]).collect()}
    assert got == {"t1": [("a", "3-4"), ("p", "1-2")], "t3": None}


def test_checks_and_drift(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\nd\ne\n")], "path string, content string")
    cited = spark.createDataFrame([("ok", "f", "3-5"), ("gone", "g", "1-2"), ("long", "f", "3-9"), ("last", "f", "6-6")], "rule_id string, path string, lines string")
    before = checks.digests(cited, files)
    d = {r.rule_id: r.digest for r in before.collect()}
    assert d["ok"] and d["last"] and d["gone"] is None and d["long"] is None
    for text, status in (("a\nB\nc\nd\ne\n", "ok"), ("a\nb\nC\nd\ne\n", "stale"), ("a\n", "broken")):
        now = checks.digests(cited, spark.createDataFrame([("f", text)], "path string, content string"))
        assert {r.rule_id: r.status for r in checks.drift(before.where("rule_id = 'ok'"), now).collect()} == {"ok": status}
    assert {r.status for r in checks.drift(before.where("rule_id = 'gone'"), before).collect()} == {"unknown"}
    odd = spark.createDataFrame([("../x", "1-2"), ("/x", "1-2"), ("", "1-2"), (None, "1-2"), ("f", "2-1"), ("h", "1-1"), ("f", "1-6"), ("f", "1-5"), ("a/../f", "1-1")], "path string, lines string")
    counts = spark.createDataFrame([("f", 5)], "path string, n_lines bigint")
    got = [(r.path, r.lines, (r.problem or "")[-12:]) for r in checks.resolve_citations(odd, counts).collect()]
    assert sum(p == "" for _, _, p in got) == 1 and sum(p == " source root" for _, _, p in got) == 6
    lines = checks.excerpt(spark.createDataFrame([("r", 0, "f", "3-3"), ("r", 1, "f", "9-9"), ("r", 2, "f", "5-5")], "rule_id string, src int, path string, lines string"), files, context=1, budget=5)
    assert [r.line for r in lines.orderBy("src", "line_no").collect()] == ["    2 · b", "    3 > c", "    4 · d", "    4 · d", "    5 > e"]


def test_graph_dependencies(spark):
    modules = spark.createDataFrame([("App\\Billing", "billing"), ("App\\Billing\\Tax", "tax"), ("reviews", "reviews"), ("x/util", "u1"), ("y/util", "u2")], "name string, domain string")
    imports = spark.createDataFrame([(1, "crm", "App\\Billing\\Tax\\Rate"), (2, "crm", "corp/pkg/reviews"), (3, "crm", "corp/util"), (4, "tax", "App\\Billing\\Tax"), (5, "nobody", "App\\Billing")], "row int, from_domain string, target string")
    domains = spark.createDataFrame([(d,) for d in ("crm", "tax", "reviews", "billing")], "domain string")
    assert {tuple(r) for r in graph.domain_dependencies(imports, modules, domains).collect()} == {("domain.crm", "depends_on", "domain.tax"), ("domain.crm", "depends_on", "domain.reviews")}


def test_skew(spark):
    rows = [("hot",)] * 4000 + [(f"k{k}",) for k in range(3000)] + [(None,)] * 500
    df = spark.createDataFrame(rows, "k string").repartition(5).withColumn("v", F.monotonically_increasing_id() % 7)
    assert {(r.key_value, r.n_rows) for r in skew.heavy_keys(df, ["k"], 0.05).collect()} == {("hot", 4000), (None, 500)}
    assert skew.heavy_keys(df.limit(0), ["k"], 0.05).count() == 0
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left"):
        want = sorted(map(str, df.join(small, "k", how).select("k", "v", "w").collect()))
        assert sorted(map(str, skew.skew_join(df, small, "k", how=how).select("k", "v", "w").collect())) == want
        assert sorted(map(str, skew.skew_join(df, small, "k", how=how, rows_per_key=1).select("k", "v", "w").collect())) == want
    got = {r.k: (r.n_rows, r.s, r.d, r.heavy) for r in skew.per_key(df, "k", {"s": F.col("v")}, {"m": F.col("v")}, {"d": "v"}).collect()}
    plain = {r.k: (r.n, r.s, r.d) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count_distinct("v").alias("d")).collect()}
    assert {k: v[:3] for k, v in got.items()} == plain and got["hot"][3] and not got["k1"][3]


def test_replies():
    good = {"ears_kind": "event", "citations": [{"path": "p", "lines": "2-3"}], "nature": "business", "origin": "explicit", "confidence": 0.5, "entities": ["e"], "title": "A b"}
    check = lambda **k: M.validate_map({"rules": [good | k]}, "p", 1, 9, ["e"], [])
    check()
    for bad in ({"ears_kind": "x"}, {"citations": []}, {"citations": [{"path": "q", "lines": "2-3"}]}, {"citations": [{"path": "p", "lines": "2-30"}]}, {"entities": ["z"]}, {"endpoints": ["z"]}, {"nature": ""}, {"confidence": 1.7}):
        try:
            check(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    out = M.validate_reduce({"rules": [good, good | {"slug": "A b c d e f"}]}, {("p", "2-3")}, ["e"], [])
    assert [r["slug"] for r in out["rules"]] == ["a-b", "a-b-c-d-e"]
    replies = iter(["no", '```json\n{"verdict": "partial", "reason": "r"}\n```'])
    assert M.chat_json(lambda m: (next(replies), (1, 2)), [], M.validate_verdict, 2) == ({"verdict": "partial", "reason": "r"}, (2, 4))
    calls = []

    def call(part, corrections):
        calls.append((len(part), corrections))
        if any(c == 66 for c in part):
            raise M.ModelError("poison")
        return {"rules": [{"x": c} for c in part]}, (1, 1)

    got = M.reduce_adaptively(list(range(80)), call)
    assert got.dropped == 5 and len(got.rules) == 75 and calls[0] == (80, 0) and calls[-1][1] in (0, 2)
    assert M.grounded([{"path": "p", "lines": "5-9"}, {"path": "p", "lines": "5-9"}, {"path": "q", "lines": "1-2"}, {"path": "p", "lines": "90-91"}], {"p"}, {"p": [(8, 20)]}) == [{"path": "p", "lines": "5-9"}]


def test_http_client():
    import http.server
    import json
    import threading

    import pytest

    answers = [500, 429, 200, 400]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/v1/chat/completions" and body["temperature"] == 0.1 and self.headers["Authorization"] == "Bearer k"
            status = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "hello"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = M.HttpChat(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k", backoff=(0, 0, 0))
    assert chat([{"role": "user", "content": "x"}]) == ("hello", (3, 2))
    with pytest.raises(M.ModelError, match="status 400"):
        chat([])
    assert not answers
    server.shutdown()


def test_documents_with_carriage_returns(spark, tmp_path):
    """Against plain loops: CR is text in digests and excerpts, and no part of extracted lines."""
    import hashlib

    from loomgraph.plans import catalog

    body = "t{}\r\n**Exigence (EARS)** : Le système{}\r\nx\ry\r\n" + "z\r\n" * 25
    docs = {k: body.format(k, k) for k in range(1, 9)} | {9: "a\nb\nc", 10: "a\r\nb\r\nc", 11: "one\rline", 12: None, 13: "", 14: "a\n**Exigence (EARS)** : S\rT\nc\r"}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    held = {k: t for k, t in docs.items() if t is not None}

    def digest(k, text):
        ls = text.split("\n")
        return hashlib.sha256((f"d{k}|1-3\n" + "\n".join(ls[:3]) + "\n").encode()).hexdigest()[:16] if len(ls) >= 3 else None

    want = {}
    for k, t in held.items():
        a, b = digest(k, t), None if k % 10 == 0 else digest(k, t.upper() if k % 2 == 0 else t)
        want[k] = (a, "unknown" if a is None else "broken" if b is None else "ok" if a == b else "stale")
    assert {r.doc_id: (r.digest, r.status) for r in run("digest_and_drift")} == want
    states = [s for _, s in want.values()]
    assert tuple(run("drift_report")[0]) == (*(states.count(s) for s in ("ok", "stale", "broken", "unknown")), True)
    first = {k: t.split("\n")[0].removesuffix("\r") for k, t in held.items()}
    stated = {k: f"Le système{k}" if k < 9 else "S\rT" if k == 14 else "" for k in held}
    assert {r.doc_id: (r.first_line, r.stated) for r in run("requirement_extract")} == {k: (first[k], stated[k]) for k in held}
    lines = []
    for k, t in held.items():
        ls, own = t.split("\n"), []
        for src, (a, b) in enumerate(((3, 5), (20, 22), (60, 61))):
            own += [(k, src, n, f"{n:5} {'>' if a <= n <= b else '·'} {ls[n - 1]}") for n in range(max(1, a - 10), min(b + 10, len(ls)) + 1)]
        lines += own[:40]
    assert sorted(map(tuple, run("excerpt_budget"))) == sorted(lines)
