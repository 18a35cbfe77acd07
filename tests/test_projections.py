"""Projections, boosts, pools, statuses."""

from corvane.operators import projections as op
from corvane.sources import sinks
from pyspark.sql import functions as F


def test_bundle_can_be_published(spark, tmp_path, rows):
    files = spark.createDataFrame([("r", p) for p in ("src/api/store.rs", "tests/api/store_test.rs", "bin/app/main.go", "bin/app/go.mod", "README.md", None)], "repository_id string, path string")
    tables = op.bundle(files)
    version = sinks.publish(tables, str(tmp_path / "v"), "s1")
    assert version.startswith("s1-") and sinks.read_head(spark, str(tmp_path / "v"), "path_witness").count() == 5
    assert rows(tables["entrypoint_surface"], "path") == [("bin/app/main.go",)]
    assert rows(tables["path_relation"], "src_path", "dst_path", "kind") == [("bin/app/main.go", "bin/app/go.mod", "companion_surface"), ("bin/app/main.go", "bin/app/go.mod", "entrypoint_config"), ("tests/api/store_test.rs", "src/api/store.rs", "subject")]
    boosts = op.overlay_boosts(tables["test_subject"], tables["path_relation"].where("kind <> 'subject'"))
    assert rows(boosts, "path", "sources") == [("bin/app/go.mod", "config"), ("src/api/store.rs", "test"), ("tests/api/store_test.rs", "subject")]


def test_small_ones(spark, rows):
    pool = [{"rank": i, "group": g} for i, g in enumerate("aaaaabbcdefghijk")]
    assert [r["rank"] for r in op.grouped_pool(pool, 4)] == [0, 1, 2, 3, 5, 7, 8, 9]
    heads = spark.createDataFrame([("a", "s2"), ("b", "s1")], "repository_id string, snapshot_id string")
    latest = spark.createDataFrame([("a", "s2"), ("b", "s2"), ("c", "s1")], "repository_id string, snapshot_id string")
    assert rows(op.semantic_status(heads, latest)) == [("a", "s2", "ok"), ("b", "s2", "degraded"), ("c", "s1", "unavailable")]
    one = spark.createDataFrame([(1, "x"), (2, "y")], "line int, v string")
    two = spark.createDataFrame([(2, "z"), (3, "w")], "line int, v string")
    assert rows(op.overlay_rows(one, two, ["line"])) == [(1, "x", False), (2, "y", False), (3, "w", True)]
    assert rows(op.surface_difference(one.select("line"), two.select("line"))) == [(1, "declared"), (3, "found")]
    assert rows(op.with_handles(two, ["line"], 1)) == [(2, "z", "m1")]
    ranked = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(op.pivots(ranked, spark.createDataFrame([("a",), ("a",), ("c",)], "path string"))) == [("a", 2)]


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two one"), (3, None), (4, " ")], "id long, t string")
    got = {r.key: r.embedding for r in op.hash_embedding(df, F.col("id"), F.col("t"), 16).collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert got[3] == got[4] == [0.0] * 16
