"""Operators of the engine on small cases."""

import datetime as dt
import json
import random
import re
import time

import pytest

from corvane.functions import pysyntax
from corvane.operators import chunks, graph, manifest, navigation, paths, provenance, ranking, symbols, text, vectors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    data = [(1, "beta needle\n", "x"), (2, "needle alpha\r\nnext needle needle\n\n", "x"), (3, "é日needle", "x"), (4, None, "x"), (5, "", "x"), (6, "Needle\x00", "x")]
    return spark.createDataFrame(data, "doc_id long, text string, line string")


def test_lines_and_literals(docs, rows):
    assert rows(text.lines(docs, ["doc_id"], "text")) == [(1, 1, "beta needle"), (2, 1, "needle alpha"), (2, 2, "next needle needle"), (2, 3, ""), (3, 1, "é日needle"), (6, 1, "Needle\x00")]
    got = text.literal_matches(docs, ["doc_id"], "text", "needle")
    assert rows(got, "doc_id", "line", "column") == [(1, 1, 6), (2, 1, 1), (2, 2, 13), (2, 2, 6), (3, 1, 6)]
    assert text.literal_matches(docs, ["doc_id"], "text", "+.(").count() == 0
    # A small limit is the head of the whole result.
    order = ["doc_id", "line", "column"]
    assert got.orderBy(*order).limit(2).collect() == got.orderBy(*order).collect()[:2]


def test_regex_prefilter_equals_unfiltered(spark, rows):
    rng = random.Random(3)
    data = [(i, "".join(rng.choice(["ab", "a1b", "é", "\n", " ", "xx7", "-"]) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for pattern in ("a[0-9]b", "xx[0-9]+", "b.?a", "é+"):
        want = []
        for i, t in data:
            for n, line in enumerate(t.split("\n"), 1):
                want += [(i, n, len(line[: m.start()].encode()) + 1, m[0]) for m in re.finditer(pattern, line)]
        assert rows(text.regex_matches(df, ["doc_id"], "text", pattern)) == sorted(want, key=repr)


def test_patterns():
    assert text.required_literals("abc[0-9]+def?g") == ["abc", "de", "g"]
    assert text.required_literals("a|b") == [] and text.required_literals(r"Refs: #\d+") == ["Refs: #"]
    for bad, code in (("a" * 600, "bytes"), ("|".join("abc" * 20), "alternations"), (r"(a)\1", "back-reference"), ("(?=a)", "look-around"), ("a*" * 70, "quantifiers"), ("(", "syntax"), ("", "empty")):
        with pytest.raises(text.PatternError) as e:
            text.check_pattern(bad)
        assert e.value.code == code


def test_pages_slices_and_comments(spark, docs, rows):
    hits = text.literal_matches(docs, ["doc_id"], "text", "needle").drop("excerpt")
    order = ["doc_id", "line", "column"]
    page = text.page_after(hits, order, None, 3).orderBy(*order).collect()
    assert [r.resume for r in page] == [False, False, False, True]
    rest = text.page_after(hits, order, tuple(page[-1][c] for c in order), 3).orderBy(*order).collect()
    assert [tuple(r)[:3] for r in page[:3] + rest] == [tuple(r) for r in hits.orderBy(*order).collect()]
    got = text.slice_lines(docs, ["doc_id"], "text", 1, 2, 14)
    assert rows(got.where("doc_id = 2")) == [(2, "needle alpha", 31, 2)]
    df = spark.createDataFrame([("<!-- a\nb -->\nx",), ("x <!-- a -->",)], "t string")
    assert [r[0] for r in df.select(text.scrub_leading_comment(F.col("t"))).collect()] == ["\n\nx", "x <!-- a -->"]


def test_manifest_diff_counts_mtime(spark, rows):
    t = dt.datetime(2025, 1, 1)
    snaps = spark.createDataFrame([(s, "r", "w", "manifest", t + dt.timedelta(days=i), t) for i, s in enumerate(("s1", "s2"))] + [("p", "r", "w", "changed_only", t + dt.timedelta(days=9), t)], "snapshot_id string, repository_id string, worktree string, kind string, created_at timestamp_ntz, delivered_at timestamp_ntz")
    files = spark.createDataFrame(
        [("s1", "r", "a", "1", 1, 1, t), ("s1", "r", "b", "1", 1, 1, t), ("s1", "r", "c", "1", 1, None, t), ("s2", "r", "a", "1", 1, 2, t), ("s2", "r", "c", "1", 1, None, t), ("s2", "r", "d", "1", 1, 1, t), ("p", "r", "a", "9", 1, 2, t), ("p", "r", "d", "9", 2, 1, t)],
        "snapshot_id string, repository_id string, path string, sha256 string, size_bytes long, mtime_ns long, delivered_at timestamp_ntz",
    )
    assert rows(manifest.manifest_diff(snaps, files)) == [("s2", "a", "modified"), ("s2", "b", "deleted"), ("s2", "d", "added")]
    assert rows(manifest.snapshot_freshness(snaps, files)) == [("s2", 3, 2, False)]
    assert rows(manifest.changed_only_reuse(snaps, files)) == [("p", 2, 1, 1)]
    assert rows(manifest.retained_snapshots(snaps, 1)) == [("r", "s2", 1)]


def test_paths(spark):
    told = {"crates/x/src/a.rs": "crates/x/src", "packages/editor-ui/package.json": "packages/editor-ui", "desktop/tests/layout.rs": "desktop", "src/a/b.rs": "src/a", "README.md": None}
    df = spark.createDataFrame([(k,) for k in told], "path string")
    assert {r.path: r.s for r in df.select("path", paths.subtree_root(F.col("path")).alias("s")).collect()} == told
    data = [("r", "src/api/tokenStore.rs"), ("r", "tests/api/token_store_test.rs"), ("r", "tests/tokenStoreTest.rs"), ("r", "bin/app/main.go"), ("r", "bin/app/go.mod"), ("q", "src/api/tokenStore.rs")]
    df = spark.createDataFrame(data, "repository_id string, path string")
    links = paths.test_subject_links(df).collect()
    # Shared terms make a link, an equal stem a stronger one.
    assert sorted((r.test_path, r.subject_path, r.shared, r.score) for r in links) == [("tests/api/token_store_test.rs", "src/api/tokenStore.rs", 3, 35), ("tests/tokenStoreTest.rs", "src/api/tokenStore.rs", 2, 31)]
    beside = spark.createDataFrame([("r", p) for p in ("bin/app/server.ts", "bin/app/server.config.ts", "bin/server/package.json", "bin/other/go.mod", "src/server/main.py", "src/server/pyproject.toml")], "repository_id string, path string")
    got = {(r.src_path, r.dst_path, r.kind): r.score for r in paths.companions(beside).collect()}
    assert got[("src/server/main.py", "src/server/pyproject.toml", "entrypoint_config")] == 118 and ("bin/app/server.ts", "bin/other/go.mod", "entrypoint_config") not in got


def test_nearest_to_queries(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<float>")
    got = vectors.nearest_to_queries(df, df.where("id % 50 = 0"), 4)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    for r in got.collect():
        score = np.round(unit @ unit[r.query_id], 4)
        score[r.query_id] = -9
        assert np.lexsort((np.arange(300), -score))[r["rank"] - 1] == r.vec_id
    assert got.count() == 24
    assert vectors.nearest_to_queries(df, df.limit(0), 4).count() == 0


def test_chunks():
    body = "\n".join(f"line {i}" for i in range(65)) + "\n"
    assert [(a, b) for a, b, _ in chunks.chunk_lines(body, False)] == [(1, 64), (65, 65)]
    assert [(a, b) for a, b, _ in chunks.chunk_lines("a\n# h\nb\n\n# i\n", True)] == [(1, 1), (2, 4), (5, 5)]
    assert chunks.chunk_lines(" \n\n", False) == []
    parts = chunks.chunk_lines("é" * 5000, False)
    assert "".join(p for _, _, p in parts) == "é" * 5000 and max(len(p) for _, _, p in parts) == 2400


def test_symbols(spark, rows):
    text_ = "\n".join(["// head", "pub fn a(x) {", "  b(x); other(1)", "}", "fn b(y) {", "  return y", "}"])
    texts = spark.createDataFrame([("f", text_), ("g", None), ("h", "")], "file string, text string")
    code = symbols.source_lines(texts)
    spans = symbols.symbols(texts)
    assert rows(spans, "file", "kind", "name", "start_line", "end_line") == [("f", "function", "a", 2, 4), ("f", "function", "b", 5, 7)]
    assert rows(symbols.calls(code, spans, declared_only=True)) == [("f", "a", "b", 1)]
    hits = code.where("line in (1, 3, 6)").select("file", "line")
    assert rows(symbols.enclosing_symbol(hits, spans), "line", "name") == [(1, None), (3, "a"), (6, "b")]
    assert rows(symbols.symbol_at_or_before(hits, spans), "line", "name", "distance") == [(1, None, -1), (3, "a", 1), (6, "b", 1)]
    assert rows(symbols.references(code, spans)) == [("b", 1, 1)]
    assert rows(symbols.symbol_rank(spans, "A"), "name", "rank") == [("a", 4)]


def test_nested_symbols(spark, rows):
    text_ = "\n".join(["class Store:", "    def load(self):", "        if x:", "            return open(path)", "", "    @wrapped", "    def save(self):", "        def inner(y):", "            return 1", "        return inner(2)", "", "VALUE = 1", "impl<T> Table {", "    pub fn load(", "        x: i32", "    ) -> T {", "        helper(x)", "    }", "}", "func (r *Reader) Next() int {", "  return 1", "}"])
    texts = spark.createDataFrame([("f", text_)], "file string, text string")
    spans = symbols.symbols(texts)
    want = [("Store", 1, 10, None, "Store"), ("load", 2, 4, "Store", "Store.load"), ("save", 7, 10, "Store", "Store.save"), ("inner", 8, 9, "save", "Store.save.inner"), ("Table", 13, 19, None, "Table"), ("load", 14, 18, "Table", "Table.load"), ("Next", 20, 22, None, "Next")]
    assert rows(spans, "name", "start_line", "end_line", "container", "canonical") == sorted(want, key=repr)
    tree = rows(symbols.outline_rows(spans), "place", "parent_place", "depth", "name")
    assert tree == [(1, 0, 0, "Store"), (2, 1, 1, "load"), (3, 1, 1, "save"), (4, 3, 2, "inner"), (5, 0, 0, "Table"), (6, 5, 1, "load"), (7, 0, 0, "Next")]
    hits = spark.createDataFrame([("f", n) for n in (4, 9, 10, 12, 17)], "file string, line int")
    assert rows(symbols.enclosing_symbol(hits, spans), "line", "name") == [(10, "save"), (12, None), (17, "load"), (4, "load"), (9, "inner")]
    assert rows(symbols.symbol_at_or_before(hits, spans), "line", "name", "inside") == [(10, "save", True), (12, "inner", False), (17, "load", True), (4, "load", True), (9, "inner", True)]
    assert rows(symbols.calls(symbols.source_lines(texts), spans), "caller", "callee") == [("load", "helper"), ("load", "open"), ("save", "inner")]
    assert rows(symbols.symbol_rank(spans, "store.load"), "canonical", "rank") == [("Store.load", 1)]
    assert rows(symbols.symbol_rank(spans, "load"), "canonical", "rank") == [("Store.load", 3), ("Table.load", 3)]


def test_graph(spark, rows):
    nodes = spark.createDataFrame([("u",), ("s",), ("v",), ("l",), (None,)], "id string")
    edges = spark.createDataFrame([("s", "u", "defined_in"), ("s", "v", "calls"), ("s", "v", "calls"), ("s", "l", "refers_to"), ("s", "?", "calls"), (None, "u", "calls")], "src string, dst string, kind string")
    known, unknown = graph.edge_set(edges, nodes)
    assert known.count() == 3 and unknown.count() == 2
    near = graph.adjacency(known)
    assert near.where("id = 's' and direction = 'out'").count() == 3 and near.where("id = 'v' and direction = 'in'").count() == 1
    hits = graph.graph_hits(spark.createDataFrame([("v", 1.0)], "id string, weight double"), known)
    assert rows(hits) == [("s", 0.95, 1)]


def test_index_records(spark, rows):
    doc = {
        "relative_path": "a.php",
        "occurrences": [{"symbol": "s1", "range": [0, 1, 5], "symbol_roles": 1}, {"symbol": "s1", "range": [3, 1, 4, 2], "symbol_roles": 0}, {"symbol": "", "range": [1, 1, 1]}, {"symbol": "s1", "range": [1, 1]}, {"symbol": "s1", "range": [3, 1, 2, 9]}],
        "symbols": [{"symbol": "s1", "display_name": "S", "kind": "class", "relationships": [{"symbol": "s2", "is_implementation": True, "is_reference": True}, {"symbol": "s2"}]}],
    }
    index = spark.createDataFrame([(json.dumps({"documents": [doc, {"relative_path": " ", "occurrences": doc["occurrences"][:1], "symbols": []}]}),)], "j string").select(F.from_json("j", graph.INDEX_SCHEMA).alias("x")).select("x.*")
    got = graph.index_records(index)
    assert rows(got["occurrences"]) == [("a.php", "s1", 1, 2, 1, 6, True), ("a.php", "s1", 4, 2, 5, 3, False)]
    assert got["symbols"].count() == 1
    assert rows(got["relationships"], "kind") == [("implementation",), ("reference",)]
    assert rows(got["problems"], "code") == [("missing_path",), ("missing_symbol",), ("range_length",), ("range_order",), ("relationship_kind",)]
    assert rows(graph.symbol_references(got["occurrences"]), "symbol", "defined_in", "defined_at") == [("s1", "a.php", 1)]
    new = got["symbols"].withColumn("display_name", F.lit("T"))
    assert graph.replace_files(got["symbols"], new).count() == 1 and graph.replace_files(got["symbols"], new, overlay=True).count() == 2


def test_fusion(spark, rows):
    data = [("lexical", 1, 10, 0.68, "a b"), ("lexical", 1, 30, 0.65, "c"), ("lexical", 2, 20, 0.72, "d"), ("semantic", 1, 10, 0.4, "s")]
    df = spark.createDataFrame(data, "channel string, document long, line int, raw_score double, excerpt string")
    blended = ranking.blend(ranking.normalise(df), ranking.Weights(lexical=1.0, semantic=0.0))
    assert rows(blended, "document", "line", "blended", "sources", "excerpt") == [(1, 10, 0.944444, "lexical,semantic", "a b"), (1, 30, 0.902778, "lexical", "c"), (2, 20, 1.0, "lexical", "d")]
    cols = "document long, line int, lexical double, witness double, graph double, semantic double, blended double"
    anchors = spark.createDataFrame([(1, 1, 0.68, 0.0, 0.0, 0.0, 0.68, "a"), (1, 2, 0.65, 0.0, 0.0, 0.2, 0.65, "more words here"), (1, 3, 0.5, 0.0, 0.0, 0.0, 0.5, None)], cols + ", excerpt string")
    got = ranking.roll_up(anchors, ranking.Weights(lexical=1.0, semantic=0.0)).collect()[0]
    # Channels add up by themselves, and the anchor that says most represents the document.
    assert (round(got.score, 5), got.line, got.anchors, got.semantic) == (0.77443, 2, 3, 0.07)
    pool = spark.createDataFrame([(d, i, 0.0, 0.0, 0.0, 0.0, 1.0 - d / 10) for d in range(6) for i in range(3)], cols)
    kept = ranking.bounded_pool(pool, 8)
    assert kept.count() == 10 and rows(kept.where("reserve"), "document") == [(3,), (4,)]


def test_diversify_equals_a_rescan():
    rng = random.Random(4)
    pool = [{"score": rng.random(), "group": rng.randrange(5), "rank": i} for i in range(60)]
    got = ranking.diversify(pool, 20)
    seen, rest, want = {}, list(pool), []
    for _ in range(20):
        rest.sort(key=lambda r: (-(r["score"] - 0.35 * seen.get(r["group"], 0) + (0 if r["group"] in seen else 0.1)), r["rank"]))
        want.append(rest.pop(0))
        seen[want[-1]["group"]] = seen.get(want[-1]["group"], 0) + 1
    assert got == want


def test_rules(spark):
    df = spark.createDataFrame([(True, False), (False, True), (None, True)], "a boolean, b boolean")
    rules = [ranking.Rule("x", factor=2.0, all_of=("a",)), ranking.Rule("y", add=1.0, any_of=("a", "b"), none_of=("a",))]
    score, fired = ranking.apply_rules(F.lit(1.0), rules, {"a": F.col("a"), "b": F.col("b")})
    assert [tuple(r) for r in df.select(score, fired).collect()] == [(2.0, ["x"]), (2.0, ["y"]), (1.0, [])]


def test_provenance(spark, rows):
    assert provenance.sanitise_value({"b": "x" * 300, "a": list(range(20)), "c": {"d": {"e": {"f": {"g": {"h": {}}}}}}}) == {"a": list(range(8)), "b": "x" * 256 + "...", "c": {"d": {"e": {"f": {"g": {"h": None}}}}}}
    a = spark.createDataFrame([("t", 0, "x"), ("t", 1, "y"), ("t", 2, None)], "k string, i int, tool string")
    b = spark.createDataFrame([("t", 0, "x"), ("t", 1, "z"), ("t", 3, "w")], "k string, i int, tool string")
    assert rows(provenance.trace_diff(a, b, "k", "i", ["tool"])) == [("t", 1, "tool", True), ("t", 2, "missing", False), ("t", 3, "extra", False)]
    groups = spark.createDataFrame([("g", "src/a.rs", False), ("h", "src/", True), ("i", "x", False)], "group_id string, expected string, is_prefix boolean")
    results = spark.createDataFrame([("src/a.rs",), ("src/b.rs",)], "path string")
    assert rows(provenance.group_matches(groups, results)) == [("g", True, False, True), ("h", False, True, False), ("i", False, False, False)]


def test_last_names_are_read_from_the_end(spark, rows):
    told = {"text a#b.c_1@12.": "12", "a b": "b", "...": "", "": "", "x\n": "x", "naïve()": "ve", "é": "", "_": "_", None: None}
    df = spark.createDataFrame([(k,) for k in told], "symbol string")
    assert {r.symbol: r.n for r in df.select("symbol", navigation.identifier(F.col("symbol")).alias("n")).collect()} == told
    # A search that starts anew at every letter takes minutes for this.
    long = spark.createDataFrame([("p", "a" * 60_000 + "é" * 3 + "b", "shown", "k"), ("p", "x#other@", "shown", "k")], "path string, symbol string, display_name string, kind string")
    began = time.monotonic()
    assert rows(navigation.name_rank(long, "OTHER", "B"), "display_name", "rank") == [("shown", 4), ("shown", 8)]
    assert time.monotonic() - began < 20
    plan = navigation.name_rank(long, "OTHER", "B")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_navigation(spark, rows):
    a = "class Base:\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n"
    b = "class Child(Base):\n    def go(self):\n        return helper(2)\n"
    texts = spark.createDataFrame([("a.py", a), ("b.py", b)], "file string, text string")
    spans, code = symbols.symbols(texts), symbols.source_lines(texts)
    index = navigation.text_index(code, spans)
    uses = navigation.definitions_of_uses(index["occurrences"], index["symbols"])
    assert rows(uses, "path", "start_line", "display_name", "defined_in", "defined_at", "same_file") == [("a.py", 3, "helper", "a.py", 5, True), ("b.py", 1, "Base", "a.py", 1, False), ("b.py", 3, "helper", "a.py", 5, False)]
    assert navigation.nearest_references(uses, 1).where("display_name = 'helper'").collect()[0].path == "a.py"
    # The place in a name, behind it, before anything in its line, and before all.
    places = spark.createDataFrame([("a.py", 3, 17), ("a.py", 3, 40), ("a.py", 6, None), ("b.py", 1, 3), ("z.py", 1, 1)], "path string, line int, column int")
    got = rows(navigation.symbol_at(index["occurrences"], index["symbols"], places).withColumn("name", navigation.identifier(F.regexp_replace("symbol", "@.*", ""))), "path", "line", "name", "contained")
    assert got == [("a.py", 3, "helper", False), ("a.py", 3, "helper", True), ("a.py", 6, "helper", False), ("b.py", 1, None, False), ("z.py", 1, None, False)]
    ranks = navigation.name_rank(index["symbols"], "HELPER", "base")
    assert rows(ranks, "display_name", "rank") == [("Base", 7), ("helper", 3)]
    edges = navigation.heritage(code, spans)
    assert rows(edges) == [("b.py", "Child", 1, "Base", "extends")]
    more = spark.createDataFrame([("c", 1, "impl<T> Shape for Square<T> {"), ("c", 2, "class A extends B implements C {")], "file string, line int, body string")
    heads = spark.createDataFrame([("c", "Square", 1), ("c", "A", 2)], "file string, name string, start_line int")
    assert rows(navigation.heritage(more, heads), "name", "base", "kind") == [("A", "B", "extends"), ("A", "C", "implements"), ("Square", "Shape", "implements")]
    known = index["symbols"].select("symbol", "display_name")
    relationships = edges.join(known.toDF("from_symbol", "name"), "name").join(known.toDF("to_symbol", "base"), "base").select("from_symbol", "to_symbol", "kind")
    assert rows(navigation.implementations(relationships, index["symbols"], index["occurrences"]), "display_name", "path", "kind") == [("Child", "b.py", "extends")]
    asked = spark.createDataFrame([("helper",), ("go",), ("nowhere",)], "name string")
    exact = navigation.definitions(index["occurrences"], index["symbols"]).where("display_name = 'helper'")
    assert rows(navigation.go_to_definition(exact, spans, asked)) == [("go", "b.py", 2, "heuristic"), ("helper", "a.py", 5, "precise"), ("nowhere", None, -1, "unavailable")]


def test_python_structure(spark, rows):
    text_ = "def f(a):\n    return g(a)\n\nclass C:\n    def m(self):\n        return g(1)\n"
    df = spark.createDataFrame([("a.py", text_), ("b.py", "not python ("), ("c.py", None)], "file string, text string")
    assert rows(pysyntax.search_structural(df, F.col("file"), F.col("text"), "Call", "g", "ClassDef"), "file", "line", "column") == [("a.py", 6, 16)]
    stack = pysyntax.inspect_syntax_tree(df, F.col("file"), F.col("text"), F.lit(6), F.lit(16))
    assert [r.kind for r in stack.orderBy("depth").collect()] == ["ClassDef", "FunctionDef", "Return", "Call", "Name"]
    assert {r.kind: r.nodes for r in pysyntax.node_counts(df, F.col("text")).collect()}["Call"] == 2


def test_exact_pairs_equal_all_pairs(spark, rows):
    # Common terms are worked out by signature; the result is that of comparing every row with every other.
    rng = random.Random(7)
    words = ["core", "item", "view", "alpha", "beta", "gamma", "delta"]
    make = lambda side: [("g", f"{side}{i:03}", sorted({words[0], *rng.sample(words, rng.randrange(1, 4)), f"r{rng.randrange(40)}"}), rng.choice(["s1", "s2", f"t{i}"]), rng.randrange(2)) for i in range(60)]
    left, right = make("l"), make("r")
    frame = lambda data: spark.createDataFrame(data, "g string, path string, terms array<string>, stem string, k int").withColumn("traits", F.struct("k"))
    score = lambda shared, same, a, b: shared * 10 + same.cast("int") * 6 + (F.col(f"{a}.k") == F.col(f"{b}.k")).cast("int")
    got = paths.closest_pairs(frame(left), frame(right), ["g"], score, lambda a, b: F.lit(True), 4, common=8)
    want = []
    for _, p, terms, stem, k in left:
        scored = [(-(10 * len(set(terms) & set(t)) + 6 * (stem == s) + (k == kk)), q) for _, q, t, s, kk in right if set(terms) & set(t) or stem == s]
        want += [(p, q, -n) for n, q in sorted(scored)[:4]]
    assert rows(got, "left_path", "right_path", "score") == sorted(want, key=repr)


def _pairs_case(spark, seed, n, words):
    rng = random.Random(seed)
    make = lambda: [(rng.choice("gh"), f"p{i:03}", rng.sample(words, rng.randrange(0, 6)), rng.choice(["", "s1", "Beta", "beta", f"t{i}"]), rng.randrange(2)) for i in rng.sample(range(n * 2), n)]
    left, right = make(), make()
    frame = lambda data: spark.createDataFrame(data, "g string, path string, terms array<string>, stem string, k int").withColumn("traits", F.struct("k"))
    return left, right, frame(left), frame(right)


@pytest.mark.parametrize("listed", [512, 8, 0])
def test_pairs_by_sets_equal_all_pairs(spark, rows, monkeypatch, listed):
    # Rows share paths with the other side, some have no items; rows with many items are set apart where `listed` says so.
    words = ["alpha", "beta", "gamma", "delta", "x1", "x2", "x3"]
    left, right, one, two = _pairs_case(spark, 11, 70, words)
    score = lambda shared, same, a, b: F.least(shared + F.col("extra"), F.lit(3)) * 12 + same.cast("int") * 18 + (F.col(f"{a}.k") == F.col(f"{b}.k")).cast("int") * 6
    by_items, asked = paths._pairs_by_items, []
    monkeypatch.setattr(paths, "_pairs_by_items", lambda *a: asked.append(1) or by_items(*a))
    got = rows(paths.closest_pairs(one, two, ["g"], score, lambda a, b: F.lit(True), 4, listed=listed), "g", "left_path", "right_path", "shared", "score")
    want = []
    for g, p, terms, stem, k in left:
        scored = []
        for h, q, t, s, kk in right:
            both, same = set(terms) & set(t), stem == s != ""
            if g == h and p != q and (both or same):
                scored.append((-(12 * min(len(both) + (same and stem.lower() not in both), 3) + 18 * same + 6 * (k == kk)), q, len(both)))
        want += [(g, p, q, n, -v) for v, q, n in sorted(scored)[:4]]
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in sorted(want, key=repr)]
    assert bool(asked) == (listed < 512)


def test_pairs_by_equal_stems_alone(spark, rows, monkeypatch):
    # A score that asks for nothing but equal stems needs sets of one item, however many items rows have.
    monkeypatch.setattr(paths, "_pairs_by_items", None)
    left, right, one, two = _pairs_case(spark, 5, 60, [f"w{i}" for i in range(9)])
    longer = lambda df: df.withColumn("terms", F.when(F.col("k") == 1, F.concat("terms", F.array(*[F.lit(f"y{i}") for i in range(25)]))).otherwise(F.col("terms"))).withColumn("traits", F.struct(F.lit(0).alias("none")))
    got = rows(paths.closest_pairs(longer(one), longer(two), ["g"], lambda shared, same, a, b: same.cast("int") * 20 + 80, lambda a, b: F.lit(True), 3, single=True), "g", "left_path", "right_path", "score")
    want = []
    for g, p, terms, stem, k in left:
        scored = [(-(80 + 20 * (stem == s != "")), q) for h, q, t, s, kk in right if g == h and p != q and (set(terms) & set(t) or k == kk == 1 or stem == s != "")]
        want += [(g, p, q, -v) for v, q in sorted(scored)[:3]]
    assert got == sorted(want, key=repr)


def test_pairs_by_equal_stems_of_rows_with_any_number_of_items(spark, rows):
    # Rows of more items than an integer has bits meet too, by their first term, their last and their stem.
    many = [f"w{i}" for i in range(70)]
    frame = lambda data: spark.createDataFrame([("g", *r) for r in data], "g string, path string, terms array<string>, stem string").withColumn("traits", F.struct(F.lit(0).alias("none")))
    left, right = frame([("a", many, "s"), ("b", ["x"], "t")]), frame([("c", ["w0"], ""), ("d", ["w69"], ""), ("e", ["y"], "s"), ("f", [*many, "x"], "t")])
    got = paths.closest_pairs(left, right, ["g"], lambda shared, same, a, b: same.cast("int") * 20 + 80, lambda a, b: F.lit(True), 8, single=True)
    assert rows(got, "left_path", "right_path", "score") == [("a", "c", 80), ("a", "d", 80), ("a", "e", 100), ("a", "f", 80), ("b", "f", 100)]


def _broadcasts(df):
    """Of each side that a plan broadcasts the lines below it."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            out.append([])
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                out[-1].append(below)
    return out


def test_links_broadcast_no_listed_sets(spark):
    # What lists the sets of small files is not small; before, the sets of all tests went to the driver.
    files = spark.createDataFrame([("r", f"{d}/item_{i}{e}") for i in range(4) for d, e in (("src/api", ".rs"), ("tests/api", "_test.rs"))], "repository_id string, path string")
    found = _broadcasts(paths.test_subject_links(files))
    assert found and all(re.search("_words|<[lr]_kind:bigint(,[lr]_traits:.*)?>$", below[-1]) and not any("Generate" in line for line in below) for below in found)


def test_companions_broadcast_no_rows(spark):
    # Neither sets nor the paths of all files go to the driver.
    files = spark.createDataFrame([("r", f"src/api{i}/{name}") for i in range(4) for name in ("main.py", "api.py", "pyproject.toml", "test_api.py")], "repository_id string, path string")
    found = _broadcasts(paths.companions(files))
    assert found and all(re.search("_words|<[lr]_kind:bigint(,[lr]_traits:.*)?>$", below[-1]) and not any("Generate" in line for line in below) for below in found)
