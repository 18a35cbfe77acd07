"""What a search looks at, what excerpts tell, and reindexing as a whole."""

import pytest

from corvane.functions import excerpts
from corvane.operators import candidates, paths, ranking, reindex
from corvane.operators.surfaces import names, with_surfaces
from corvane.sources import sinks
from pyspark.sql import functions as F

FILES = "repository_id string, path string"


def test_universe_and_supplements(spark, rows):
    manifest = spark.createDataFrame([("s1", "r", "./src/a.rs"), ("s1", "r", "src/a.rs"), ("s0", "r", "src/old.rs"), ("s1", "r", "docs/x.md"), ("s1", "r", None)], "snapshot_id string, " + FILES)
    valid = spark.createDataFrame([("r", "s1")], "repository_id string, snapshot_id string")
    walk = spark.createDataFrame([("q", "lib/b.py"), ("r", "src/never.rs")], FILES)
    assert rows(candidates.universe(manifest, valid, walk)) == [("q", "lib/b.py", "walk"), ("r", "docs/x.md", "manifest"), ("r", "src/a.rs", "manifest")]
    assert rows(candidates.universe(manifest, valid, walk, language="rust")) == [("r", "src/a.rs", "manifest")]
    assert rows(candidates.universe(manifest, valid, walk, repositories=["q"], path_regex="b")) == [("q", "lib/b.py", "walk")]
    base = spark.createDataFrame([("r", "src/a.rs")], FILES)
    listing = spark.createDataFrame([("r", p) for p in (".github/workflows/ci.yml", "Cargo.toml", "sub/Cargo.toml", "src/a.rs", "notes.txt")], FILES)
    assert rows(candidates.with_supplements(base, listing, {"ci", "config"})) == [("r", ".github/workflows/ci.yml", "workflow"), ("r", "Cargo.toml", "config"), ("r", "src/a.rs", "base")]
    assert rows(candidates.with_supplements(base, listing, {"docs"})) == [("r", "src/a.rs", "base")]
    tried = []
    found = candidates.first_that_finds([lambda: candidates.paths_with_terms(listing, ["zzz"]), lambda: tried.append(1) or candidates.paths_with_terms(listing, ["CARGO"]), lambda: tried.append(2) or listing])
    assert found.count() == 2 and tried == [1]


def test_symbols_by_class_and_latest(spark, rows):
    data = [("src/a.rs", "run"), ("src/a.rs", "tests.works"), ("src/a_test.rs", "x"), ("tests/b.rs", "y"), ("docs/c.rs", "z")]
    symbols = spark.createDataFrame(data, "path string, canonical string")
    assert rows(candidates.symbols_of_class(symbols, "path", "runtime"), "canonical") == [("run",)]
    assert rows(candidates.symbols_of_class(symbols, "path", "support"), "canonical") == [("y",)]
    assert candidates.symbols_of_class(symbols, "path", None, "docs").count() == 1
    hits = spark.createDataFrame([("r", "a", True), ("r", "b", True), ("r", "c", False)], FILES + ", old boolean")
    latest = spark.createDataFrame([("r", "a")], FILES)
    assert rows(candidates.in_latest(hits, latest, F.col("old")), "path") == [("a",), ("c",)]
    assert candidates.frontier({"ci", "tests"}, 5) == 128 and candidates.frontier(set(), 50) == 100


def test_path_witnesses(spark, rows):
    files = spark.createDataFrame([("r", p) for p in ("src/token/store.rs", "src/other/view.rs", "tests/token_test.rs", "z.rs")], FILES)
    weights = spark.createDataFrame([("src/token/store.rs", "token", 30), ("z.rs", "token", 5)], "path string, term string, weight long")
    boosts = spark.createDataFrame([("src/other/view.rs", 400, ), ("z.rs", 1)], "path string, boost long")
    got = candidates.path_witnesses(files, ["token", "store"], weights, boosts, 10)
    assert rows(got, "path", "score") == [("src/other/view.rs", 0.4), ("src/token/store.rs", 2.28), ("tests/token_test.rs", 1.0), ("z.rs", 0.131)]
    assert rows(candidates.seeds(got, 2), "path", "late") == [("src/other/view.rs", True), ("z.rs", True)] or candidates.seeds(got, 2).count() == 2
    relations = spark.createDataFrame([("src/token/store.rs", "tests/token_test.rs", "src/token", ["a", "b"]), ("q", "w", "q", ["a"])], "src_path string, dst_path string, subtree string, families array<string>")
    assert rows(candidates.relation_terms(relations, weights, ["token"]), "src_path", "src_weight", "dst_weight") == [("src/token/store.rs", 30, 0)]
    coverage = spark.createDataFrame([("src/token", "a", "src/token/store.rs")], "subtree string, source_class string, exemplar string")
    assert rows(candidates.coverage_hints(coverage, relations, F.col("families"))) == [("a", "q", ["w"]), ("a", "src/token", ["src/token/store.rs", "tests/token_test.rs"]), ("b", "src/token", ["tests/token_test.rs"])]


def test_surfaces(spark):
    told = {
        "is_entrypoint": ["src/main.rs", "a/b/src/lib.rs", "cmd/x/root.go", "app/src/main/MainActivity.kt", "platform/main.roc", "lua/cli/x.lua", "init.lua", "tools/run.py", "web/server.mts", "packages/cli/src/index.ts"],
        "is_test_support": ["tests/a.rs", "x/test/b.py", "a_test.go", "pkg/test_x.py", "tests/scripts/run.sh", "test/pest.php"],
        "is_runtime_config_artifact": [".cargo/config.toml", "x/go.sum", "a.rockspec", "app/AndroidManifest.xml", ".env"],
        "is_build_config": ["Makefile", "x/vite.config.ts", "build.zig.zon"], "is_workspace_config": ["Cargo.toml", "sub/turbo.json", "gradle/init.gradle"], "is_ci_workflow": [".github/workflows/x.yaml"],
        "is_build_workflow": [".github/workflows/release-linux.yml"], "is_runtime_companion": ["src/store.rs", "app/Models/User.php"], "is_frontend_noise": ["a/frontend/x.js", "web/a.css", "docs/x.ts"],
        "is_android_screen": ["m/src/main/HomeScreen.kt", "m/src/main/HomeViewModel.kt"], "is_blade_component": ["resources/views/x/components/y.blade.php"], "is_runtime_doc": ["docs/a.md", "CHANGELOG.md"],
        "is_cli_command_entrypoint": ["src/cli.py", "cmd/a/main.go"], "is_runtime_anchor_test": ["tests/server_test.rs", "tests/cli.rs"], "is_error_contract": ["contracts/errors.json"], "is_module_index": ["src/store/index.ts"],
    }
    not_so = {"is_entrypoint": ["tests/main.go", "src/main/Store.kt", "x/index.ts", None], "is_test_support": ["tests/fixtures/a.rs", "tests/Cargo.toml", "tests/notes.md"], "is_runtime_companion": ["src/main.rs", "docs/a.rs"], "is_build_workflow": [".github/workflows/lint.yml"]}
    df = spark.createDataFrame([(p, n, v) for d, v in ((told, True), (not_so, False)) for n, ps in d.items() for p in ps], "path string, name string, want boolean")
    got = with_surfaces(df)
    assert len(names()) >= 55 and set(names()) <= set(got.columns)
    wrong = [(r.path, r["name"]) for r in got.collect() if bool(r[r["name"]]) != r.want]
    assert not wrong
    classes = {"src/a.rs": "runtime", "platform/x.roc": "runtime", "app/a.php": "runtime", "resources/views/a.blade.php": "support", "x/tests": "support", "a.nims": "runtime", "a.md": "project", "x/example/src/a.rs": "support"}
    df = spark.createDataFrame([(p,) for p in classes], "path string")
    assert {r.path: r.path_class for r in with_surfaces(df, "path_class").collect()} == classes
    roots = {"packages/x": "packages/x", "src/a.rs": "src/a.rs", "crates/x/api/y/z.rs": "crates/x/api", "./pages/x/y": "pages/x", "lib/a/b": "lib"}
    df = spark.createDataFrame([(p,) for p in roots], "path string")
    assert {r.path: r.s for r in df.select("path", paths.subtree_root(F.col("path")).alias("s")).collect()} == roots


def test_excerpts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(excerpts.plain_term(F.lit(t))) for t in ("Commands", "cmd", "pkgs", "class", "boxes", "entries", "is")] == ["command", "command", "package", "class", "box", "entry", "is"]
    assert value(excerpts.fuzzy_overlap(F.array(F.lit("cmd"), F.lit("x")), F.array(F.lit("commands")))) == 1
    assert round(value(excerpts.alignment(F.lit("let token_store = load(token);"), ["token", "token_store"])), 6) == round(1.14 * 1.18, 6)
    assert round(value(excerpts.alignment(F.lit("run: cargo build"), ["cargo"], True)), 6) == round(1.05 * 1.24, 6)
    assert value(excerpts.anchor_score(F.lit("fn token_store(view)"), F.array(F.lit("view")), ["token_store"])) == 4 + 2 + 8
    assert value(F.length(excerpts.trimmed(F.lit("x" * 200)))) == 163 and value(excerpts.trimmed(F.lit(" a "))) == "a"
    assert value(excerpts.first_line(F.lit("\n  \r\n  two \n three"))) == "two" and value(excerpts.first_line(F.lit(""))) == ""
    names_ = {"rust-analyzer cargo x 1.0 store/Token#load().": "load", "a/b/`my name`.": "my name", "pkg/List<T>#": "List", "local 4": "local 4"}
    assert {s: value(excerpts.index_identifier(F.lit(s))) for s in names_} == names_
    assert value(excerpts.slug(F.lit("  My Repo/№1 "))) == "my-repo-1" and value(excerpts.snake_case(F.lit("TypeAlias"))) == "type_alias"
    assert value(excerpts.repository_key(F.lit("/x"), F.lit("!"))).startswith("repository-")
    assert value(excerpts.record_id(F.lit(None), F.lit("a"))) != value(excerpts.record_id(F.lit(""), F.lit("a")))
    assert [value(excerpts.stem_factor(F.lit(s), F.lit("store"))) for s in ("Store", "store_test", "restore")] == [1.65, 0.78, 1.0]


def test_order_and_gates(spark, rows):
    cols = "document string, score double, lexical double, witness double, graph double, semantic double, excerpt string"
    docs = spark.createDataFrame([("a", 0.9, 0.0, 0.9, 0.0, 0.9, ""), ("b", 0.2, 0.2, 0.0, 0.0, 0.0, "has Token Store here"), ("c", 0.5, 0.7, 0.0, 0.0, 0.0, "no"), ("d", 0.1, 0.0, 0.0, 0.0, 0.0, "")], cols)
    symbols = spark.createDataFrame([("d",)], "document string")
    got = ranking.guarded(docs, "token store", symbols).orderBy(F.col("_order").desc()).collect()
    assert [(r.document, r.reasons) for r in got] == [("d", "exact_symbol"), ("b", "exact_text,more_than_path"), ("c", "strong_text,more_than_path"), ("a", "more_than_path")]
    gates = ranking.gates("code", 20, 16, True, True)
    assert not gates.graph and not gates.semantic and gates.lexical_factor == 1 and len(gates.notes) == 2
    assert ranking.gates("language", 3, 16, False, True) == ranking.Gates(True, True, 4, ("text widened: few documents",))


def test_reindex(spark, rows, tmp_path):
    root = str(tmp_path / "index")
    schema = "path string, sha256 string, size_bytes long, mtime long, content_text string"
    scan = lambda *files: spark.createDataFrame([(p, d, len(d), 1, d) for p, d in files], schema)
    made = []
    derive = {"words": lambda files: made.append(sorted(r.path for r in files.collect())) or files.select("path", F.explode(F.split("content_text", " ")).alias("word"))}
    first = reindex.reindex(root, "s1", scan(("a", "x y"), ("b", "z")), derive)
    assert (first["added"], first["deleted"]) == (2, 0)
    second = reindex.reindex(root, "s2", scan(("a", "x y"), ("c", "w")), derive)
    assert (second["scanned"], second["added"], second["modified"], second["deleted"], second["unchanged"]) == (2, 1, 0, 1, 1)
    assert made == [["a", "b"], ["c"]] and rows(sinks.read_head(spark, root, "words")) == [("a", "x"), ("a", "y"), ("c", "w")]
    assert reindex.reindex(root, "s3", scan(("a", "x y"), ("c", "w")), derive)["version"] == second["version"]

    def fails(files):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        reindex.reindex(root, "s4", scan(("a", "new")), {"words": fails})
    assert sinks.head(spark, root) == second["version"]
    third = sinks.rebuild(spark, root, "words", lambda read: read("manifest").select("path", F.lit("w").alias("word")))
    assert rows(sinks.read_head(spark, root, "words")) == [("a", "w"), ("c", "w")] and third.startswith("s2")
    assert sinks.rollback(spark, root) == second["version"] and rows(sinks.read_head(spark, root, "words")) == [("a", "x"), ("a", "y"), ("c", "w")]
    # Of two writers that saw the same head one is told that it has moved.
    with pytest.raises(sinks.HeadMoved):
        sinks.publish({"t": spark.range(1)}, root, "s5", expected_head=first["version"])
    diagnostics = spark.createDataFrame([("read", "p"), ("read", "q"), ("walk", "p")], "kind string, path string")
    assert rows(reindex.diagnostics_by_kind(reindex.merged_diagnostics(diagnostics, diagnostics))) == [("read", 2), ("walk", 1)]
    log = str(tmp_path / "log")
    for day in range(1, 5):
        sinks.append_bounded(spark.range(10).select("id", F.expr(f"timestamp '2025-01-0{day}' + make_interval(0,0,0,0,0,0,id)").alias("at")), log, "at", keep=15)
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("_day")]) == 2
    assert sinks.read_bounded(spark, log, "at", 15).count() == 15
    sinks.write_artifact(diagnostics, str(tmp_path / "x"), ["kind", "path"])
    assert spark.read.text(str(tmp_path / "x")).count() == 3
