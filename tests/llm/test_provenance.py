"""Files that are not hand-written: names, trees, texts and sizes."""

import datetime as dt

from corvane.llm.provenance import EMPTY, evidence, foreign_files, merkle_folders, text_class, with_path_class
from pyspark.sql import functions as F

FILES = "snapshot_id string, repository_id string, path string, sha256 string, size_bytes long, delivered_at timestamp_ntz, class string"
SNAPS = "snapshot_id string, worktree string, class string"
TEXTS = "sha256 string, path string, content_text string, class string"
NOW = dt.datetime(2025, 1, 1)


def files(spark, *rows):
    return spark.createDataFrame([(s, r, p, d, n, NOW, "x") for s, r, p, d, n in rows], FILES)


def test_path_class(spark):
    told = {
        "vendored": ["node_modules/a/b.js", "src/third_party/x/LICENSE", "static/js/lib/grid-4.2.1/a.c", "Pods/A/b.h", ".venv/lib/python3.11/site-packages/a/b.py"],
        "generated": ["api/a.pb.go", "x/proto/a_pb2_grpc.py", "a/b.g.dart", "Forms/A.Designer.cs", "grammar/lex.yy.c", "src/zz_generated_x.go", "src/a_generated.rs", "src/generated/b.rs", "target/debug/build/x/out/bindings.rs", "Cargo.lock"],
        "minified": ["public/a.min.js", "static/a-min.js", "www/a.5f5807d5.chunk.mjs", "a.umd.cjs", "public/js/a.js.map", "static/a.bundle.js"],
        None: ["src/math/min.py", "web/a/admin.js", "src/generation/a.rs", "app/models/vendor.rs", "docs/vendoring_a.md", "src/external_api/a.rs", "src/codegen/b.ts", "config/a.chunk.toml", "src/sourcemap.rs", "web/src/a_bundle_loader.ts", "", "README.md"],
    }
    data = [(p, k) for k, paths in told.items() for p in paths]
    df = spark.createDataFrame(data, "path string, want string").transform(lambda d: with_path_class(d, "path", "got"))
    assert [(r.path, r.got) for r in df.collect()] == data


def test_text_class(spark):
    squeezed = "".join(f"function {c}(a){{return b[{i}]||c}};" for i, c in enumerate("abcdefgh" * 20))
    data = [("// Code generated by xgen 3. DO NOT EDIT.\nx", "a.go", "generated"), ("x\n\n@generated by y\n", "a.js", "generated"), (squeezed, "a.js", "minified"), (squeezed, "a.md", None), ("The files are rewritten by the ranker.\n", "a.md", None), ("", "a", None)]
    df = spark.createDataFrame(data, "text string, path string, want string").withColumn("got", text_class(F.col("text"), F.col("path")))
    assert [r.got for r in df.collect()] == [x[2] for x in data]


def trees(spark, rows):
    df = spark.createDataFrame(rows, "snapshot_id string, repository_id string, path string, d1 long")
    return merkle_folders(df.select("*", F.col("d1").alias("d2"), F.lit(1).cast("long").alias("solid"), F.lit(10).cast("long").alias("code"), F.lit(NOW).alias("first")))


def test_merkle_hashes_tell_equal_trees(spark):
    rows = [("s1", "r1", "lib/x/a.c", 1), ("s1", "r1", "lib/x/sub/b.c", 2), ("s2", "r2", "other/deep/x/a.c", 1), ("s2", "r2", "other/deep/x/sub/b.c", 2), ("s2", "r2", "other/y/a.c", 1), ("s2", "r2", "other/y/sub/b.c", 3), ("s2", "r2", "top", 3)]
    # The second snapshot of a repository has the same trees but one.
    rows += [("s3", "r1", "lib/x/a.c", 1), ("s3", "r1", "lib/x/sub/b.c", 2), ("s3", "r1", "lib/z/b.c", 2)]
    found = trees(spark, rows).collect()
    got = {(r.repository_id, r.folder): ((r.h1, r.h2), r.files, r.direct) for r in found}
    assert got["r1", "lib/x"] == ((got["r2", "other/deep/x"][0]), 2, 1) and got["r1", "lib/x"][0] != got["r2", "other/y"][0]
    assert got["r1", "lib/x/sub"][0] == got["r2", "other/deep/x/sub"][0]
    assert got["r2", "other"][1:] == (4, 0) and got["r2", ""][1:] == (5, 1)
    assert sorted(r.files for r in found if (r.repository_id, r.folder) == ("r1", "lib")) == [2, 3]
    assert len([r for r in found if (r.repository_id, r.folder) == ("r1", "lib/x")]) == 1
    assert trees(spark, rows[:0]).count() == 0


def test_deep_trees_have_hashes_of_their_own(spark):
    deep = "/".join(f"d{i}" for i in range(24))
    got = {(r.repository_id, r.folder): (r.h1, r.h2) for r in trees(spark, [("s1", "r1", f"{deep}/a.c", 1), ("s2", "r2", f"x/{deep}/a.c", 1), ("s2", "r2", f"y/{deep}/a.c", 2)]).collect()}
    assert got["r1", deep] == got["r2", f"x/{deep}"] != got["r2", f"y/{deep}"]
    assert got["r1", "d0"] == got["r2", "x/d0"] != got["r2", "y/d0"]


def test_copies_are_told_from_their_origin(spark, rows):
    early, late = NOW, NOW + dt.timedelta(days=40)
    tree = [(f"{n}.c", f"aa{n:02}") for n in range(4)] + [("util/z.c", "aa99")]
    data = [("a1", "a", f"src/core/parser/{p}", d, 50, early, "x") for p, d in tree] + [("b1", "b", f"lib/deep/parser/{p}", d, 50, late, "x") for p, d in tree] + [("c1", "c", f"parser/{p}", d, 50, late, "x") for p, d in tree]
    data += [(s, r, f"src/{r}{i}.c", f"{r}{i}0", 50, t, "x") for s, r, t in (("a1", "a", early), ("b1", "b", late), ("c1", "c", late)) for i in range(12)]
    # A later state of the origin, in which the tree has moved on.
    data += [("a2", "a", f"src/core/parser/{p}", d + "ff", 50, late, "x") for p, d in tree]
    # A single large source file is a tree too; an empty one and a small one are not.
    data += [("a1", "a", "own/one/big.c", "bb", 5000, early, "x"), ("c1", "c", "far/one/big.c", "bb", 5000, late, "x")]
    data += [(s, r, f"{r}/pkg/__init__.py", EMPTY, 0, NOW, "x") for s, r in (("a1", "a"), ("b1", "b"))] + [(s, r, f"{r}/cfg/t.py", "cc", 20, NOW, "x") for s, r in (("a1", "a"), ("b1", "b"))]
    snaps = spark.createDataFrame([("a1", "a", "x"), ("a2", "a", "x"), ("b1", "b", "x"), ("c1", "c", "x")], SNAPS)
    got = evidence(spark.createDataFrame(data, FILES), snaps)
    want = {("b1", f"lib/deep/parser/{p}") for p, _ in tree} | {("c1", f"parser/{p}") for p, _ in tree} | {("c1", "far/one/big.c")}
    assert {(r.snapshot_id, r.path) for r in got.where("by_tree = 'vendored'").collect()} == want
    assert rows(foreign_files(spark.createDataFrame(data, FILES), snaps), "snapshot_id", "path") == sorted(want, key=repr)


def test_forks_keep_what_they_share(spark):
    late = NOW + dt.timedelta(days=40)
    own = [(f"src/m{i % 4}/f{i}.rs", f"ee{i:02}") for i in range(16)]
    copy = [(f"{n}.c", f"ab{n}") for n in range(4)]
    # f forks o and adds a copy of a tree of p; v has that copy too, and more of its own.
    data = [("o1", "o", p, d, 50, NOW, "x") for p, d in own] + [("f1", "f", p, d, 50, late, "x") for p, d in own] + [("p1", "p", f"core/{p}", d, 50, NOW, "x") for p, d in copy]
    data += [("f1", "f", f"ext/core/{p}", d, 50, late, "x") for p, d in copy] + [("v1", "v", f"lib/core/{p}", d, 50, late, "x") for p, d in copy]
    snaps = spark.createDataFrame([], SNAPS)
    got = {(r.snapshot_id, r.path) for r in foreign_files(spark.createDataFrame(data, FILES), snaps).collect()}
    assert got == {("f1", f"ext/core/{p}") for p, _ in copy} | {("v1", f"lib/core/{p}") for p, _ in copy}


def test_foreign_files(spark, rows):
    copy = [(f"{n}.c", f"c{n}") for n in range(4)]
    own = [(f"src/f{n}.rs", f"d{n}") for n in range(12)]
    data = [("S1", "r1", f"widgets/tool/{p}", d, 10) for p, d in copy] + [("s1", "r1", p, "1" + d, 10) for p, d in own]
    data += [("s2", "r2", f"deep/er/tool/{p}", d, 10) for p, d in copy] + [("s2", "r2", f"pkg/{i}/{p}", "2" + d + str(i), 10) for i in range(3) for p, d in own]
    data += [("s1", "r1", "big.py", "e0", 2_000_000), ("s3", "r1", ".\\big.py", "e1", None), ("s4", "r1", "big.py", "e9", 5), ("s1", "r1", "big.bin", "e2", 9_000_000), ("s1", "r1", "hand.go", "E3", 10), ("s3", "r1", "hand.go", "e4", 10)]
    data += [("s9", None, "a.min.js", None, -1), (None, "r", "a.min.js", None, 1), ("s9", "r", None, None, 1), ("s1", "r1", "big.py", "e0", 2_000_000)]
    snaps = spark.createDataFrame([("s1", "w1", "x"), ("s3", "w1", "x"), ("s3", "w1", "x"), ("s4", "w4", "x"), ("s2", "w2", "x"), (None, None, "x")], SNAPS)
    texts = spark.createDataFrame([("e3", "hand.go", "// Code generated by x. DO NOT EDIT.", "x"), ("e4", None, None, "x")], TEXTS)
    got = {(r.snapshot_id, r.path): r["class"] for r in foreign_files(files(spark, *data), snaps, texts).collect()}
    want = {("s1", f"widgets/tool/{p}"): "vendored" for p, _ in copy} | {("s2", f"deep/er/tool/{p}"): "vendored" for p, _ in copy}
    want |= {("s1", "big.py"): "data", ("s3", "big.py"): "data", ("s1", "hand.go"): "generated", ("s3", "hand.go"): "generated", ("s9", "a.min.js"): "minified"}
    assert got == want
    empty = files(spark)
    assert foreign_files(empty, snaps, texts).count() == 0
    assert foreign_files(files(spark, *data), snaps.limit(0), texts.limit(0)).count() > 0


def test_headers_below_licences(spark):
    licence = [f"Line {i} of a licence; it goes on; and on." for i in range(40)]
    slashes, block = "\n".join("// " + x for x in licence), "/*\n" + "\n".join("  " + x for x in licence) + "\n*/"
    made = "// Code generated by xgen 3. DO NOT EDIT."
    code = "\n".join(f"a{i} = {i}" for i in range(20))
    data = [(slashes + "\n\n" + made + "\nx", "generated"), (block + "\n" + made + "\nx", "generated"), (block + "\r\n\r\npackage x\r\n" + made, "generated"), ("a;" * 20 + " /* @generated */", "generated")]
    data += [("# x\n" * 50_000 + made, "generated"), (block + "\n" + code + "\n" + made, None), (slashes + "\n" + code + "\nt = '" + made + "'", None), (block, None)]
    df = spark.createDataFrame(data, "text string, want string").withColumn("got", text_class(F.col("text"), F.lit("a.go")))
    assert [r.got for r in df.collect()] == [x[1] for x in data]
