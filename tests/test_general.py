"""The general problems against brute force and on the awkward cases."""

import datetime as dt
import json
import os
import random

import pytest

from corvane.functions import jsontext
from corvane.joins import is_small, lookup_join
from corvane.operators.nested import assemble_objects, assemble_values, nested_objects, nested_values, records, shred, stripe_record
from corvane.operators.references import orphan_references, orphan_report
from corvane.operators.snapshots import snapshot_changes, snapshot_series, validity_intervals
from corvane.session import intermediate_tables, is_local, materialise, measured, shared_dir
from corvane.tables import norm_key, norm_path
from pyspark.sql import functions as F

SNAP = "snapshot_id string, repository_id string, worktree string, kind string, created_at timestamp_ntz, delivered_at timestamp_ntz, deleted_at timestamp_ntz, seq string, path string"
FILES = "snapshot_id string, path string, sha256 string, delivered_at timestamp_ntz, worktree string, row_hash string, last_seq int"


def day(n, month=1):
    return dt.datetime(2025, month, 1) + dt.timedelta(days=n)


def snap(spark, *rows):
    return spark.createDataFrame([(i, None, w, k, c, None, None, "x", "y") for i, w, k, c in rows], SNAP)


def files(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], FILES)


def test_snapshot_changes_small(spark, rows):
    snaps = snap(spark, ("S1", "w", "manifest", day(1)), (" s2 ", "w", "manifest", day(2)), ("s2", "w", "manifest", day(2)), ("s3", "w", "manifest", day(3)), ("s4", "w", "changed_only", day(4)), ("s5", "w", "manifest", day(5)), (None, "w", "manifest", day(6)), ("s7", None, "manifest", day(6)), ("gone", "w", "manifest", day(4)))
    manifest = files(
        spark,
        ("s1", "a", "01", day(1)), ("s1", ".\\b\\c", "02", day(1)), ("s1", "n", None, day(1)),
        ("s2", "a", "01", day(1)), ("s2", "a", "03", day(2)), ("s2", "./b/c", "02", day(1)), ("S2", "n", None, None), ("s2", "d", "AA", day(1)),
        ("s3", "a", "03", day(1)), ("s3", "d", "aa", day(1)), ("s3", "n", "05", day(1)),
        ("s4", "zz", "01", day(1)),
        ("s5", "b/c", "02", day(1)), ("s5", "d", "aa", day(1)), ("s5", "d", "aa", day(1)), ("s5", None, "aa", day(1)),
        (None, "a", "01", day(1)),
    )
    assert rows(snapshot_changes(snaps, manifest)) == [
        ("s2", "a", "modified"), ("s2", "d", "added"),
        ("s3", "b/c", "deleted"), ("s3", "n", "modified"),
        ("s5", "a", "deleted"), ("s5", "b/c", "added"), ("s5", "n", "deleted"),
    ]


def test_snapshot_changes_random_against_sets(spark, rows):
    rng = random.Random(5)
    state, snaps, listing = {}, [], []
    for w in "uv":
        for i in range(7):
            snaps.append((f"{w}{i}", w, "manifest", day(i)))
            state[w, i] = {p: rng.choice(["01", "02"]) for p in "abcdefgh" if rng.random() < 0.6}
            listing += [(f"{w}{i}", p, d, day(1)) for p, d in state[w, i].items()]
    want = []
    for w in "uv":
        for i in range(1, 7):
            a, b = state[w, i - 1], state[w, i]
            want += [(f"{w}{i}", p, "added" if p not in a else "deleted" if p not in b else "modified") for p in {*a, *b} if a.get(p) != b.get(p)]
    snaps, listing = snap(spark, *snaps), files(spark, *listing, *listing[:9])
    assert rows(snapshot_changes(snaps, listing)) == sorted(want)
    got = validity_intervals(listing, snapshot_series(snaps, listing))
    covered = sorted((r.worktree, r.path, i) for r in got.collect() for i in range(r.start_seq, r.end_seq + 1))
    assert covered == sorted((w, p, i + 1) for (w, i), s in state.items() for p in s)


def test_snapshot_changes_empty(spark):
    assert snapshot_changes(snap(spark), files(spark)).count() == 0
    assert snapshot_changes(snap(spark, ("s", "w", "manifest", day(1))), files(spark)).count() == 0


def test_lookup_join_shuffles_beyond_the_bound(spark, rows):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (2, "y")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(lookup_join(big, small, ["k"], how, salt_on=["id"], rows=1)) == rows(lookup_join(big, small, ["k"], how))


def walk(value, path="", parent="", root=True):
    if isinstance(value, dict):
        if not root:
            yield path, parent
        inner = "" if root else path
        for k, x in value.items():
            yield from walk(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", inner, False)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from walk(x, f"{path}/{i}", parent, False)


def scalars(value, path="", holder=""):
    if isinstance(value, dict):
        for k, x in value.items():
            yield from scalars(x, f"{path}/{k}", path)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from scalars(x, f"{path}/{i}", holder)
    else:
        yield holder, path[len(holder) :], json.dumps(value)


def any_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice(["a", "b", "c", "~/", ""]): any_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.75:
        return [any_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 1, 2.5, "x", ""])


def test_levels_rebuild_every_object():
    rng = random.Random(1)
    for _ in range(3000):
        value = jsontext.parse(json.dumps(any_value(rng, 6)))
        want = sorted(walk(value))
        assert sorted(assemble_objects(stripe_record(value, objects_only=True))) == want
        assert sorted(assemble_objects(stripe_record(value))) == want
    for _ in range(300):
        value = json.loads(json.dumps(any_value(rng, 5)).replace("~/", "d"))
        got = sorted((h, f) for h, f, _, _ in assemble_values(stripe_record(value)))
        assert got == sorted((h, f) for h, f, _ in scalars(value))


def test_json_is_strict_and_deep():
    for bad in ("", "{", "[1,]", "NaN", "{'a':1}", '{"a":Infinity}', "[1] x", '"\t"'):
        with pytest.raises(ValueError):
            jsontext.parse(bad)
        with pytest.raises(ValueError):
            jsontext._parse_deep(bad)
    rng = random.Random(2)
    for _ in range(500):
        text = json.dumps(any_value(rng, 5), indent=rng.choice([None, 1]))
        assert jsontext.parse(text) == jsontext._parse_deep(text)
    assert jsontext.parse("9" * 6000) == "9" * 6000


def test_nested_objects_awkward(spark, rows):
    deep = '{"a":' * 3000 + "{}" + "}" * 3000
    data = [
        ("t1", 0, '{"a":{"b":[{"c":{}},null,"x",{"d/e":{"~":{}}}]}}', "clash"),
        ("t1", 0, '{"a":{"b":[{"c":{}},null,"x",{"d/e":{"~":{}}}]}}', "clash"),
        ("t2", 1, json.dumps('[{"k":{}},[{}]]'), "z"),
        ("t2", 2, json.dumps(json.dumps('{"k":{}}')), "z"),
        ("t3", 0, None, "z"), ("t3", 1, "", "z"), ("t3", 2, "{broken", "z"), ("t3", 3, "7", "z"), ("t3", 4, "{}", "z"),
        (None, 1, '{"a":{}}', "z"),
        ("deep", 0, deep, "z"),
        ("u", 0, '{"\\ud800":{}}', "z"),
    ]
    df = spark.createDataFrame(data, "trace_id string, call_index int, payload_json string, node_path string")
    recs = records(df, "provenance_event", F.concat("trace_id", F.lit("#"), "call_index"), F.col("payload_json"))
    got = nested_objects(recs)
    assert rows(got.where("record_id = 't1#0'"), "node_path", "parent_path") == [
        ("/a", ""), ("/a/b/0", "/a"), ("/a/b/0/c", "/a/b/0"), ("/a/b/3", "/a"), ("/a/b/3/d~1e", "/a/b/3"), ("/a/b/3/d~1e/~0", "/a/b/3/d~1e"),
    ]
    assert rows(got.where("record_id like 't2%'"), "record_id", "node_path", "parent_path") == [("t2#1", "/0", ""), ("t2#1", "/0/k", "/0"), ("t2#1", "/1/0", "")]
    assert got.where("record_id like 't3%'").count() == 0
    assert got.where("record_id is null").count() == 1
    assert got.where("record_id = 'deep#0'").count() == 3000
    assert got.where("record_id = 'u#0'").count() == 1
    assert shred(recs.where("record_id = 't1#0'")).count() > 0
    assert nested_values(recs).where("record_id = 't1#0'").count() == 2
    assert nested_objects(recs.limit(0)).count() == 0


def test_orphans(spark, rows):
    parents = spark.createDataFrame(
        [("A", day(0), None), ("b", day(20, 2), None), ("c", day(0), day(10, 2)), ("d", None, None), (None, day(0), None), ("e", day(0), day(5)), ("e", day(9), None)],
        "k string, created timestamp_ntz, gone timestamp_ntz",
    )
    kids = spark.createDataFrame(
        [("a ", "r1", day(3)), ("b", "r2", day(3)), ("b", "r2", day(4)), ("b", "r3", day(3, 2)), ("c", "r4", day(3)), ("c", "r5", day(3, 2)), ("d", "r6", day(3)), (None, "r7", day(3)), ("e", "r8", day(3)), ("x", None, day(3)), ("x", "r9", None)],
        "k string, r string, at timestamp_ntz",
    )
    args = "t", norm_key("k"), norm_path("r"), F.col("at"), norm_key("k"), F.col("created"), F.col("gone")
    got = orphan_references(kids, parents, *args)
    assert rows(got) == sorted([("t", "b", "r2", "2025-01", 2), ("t", "c", "r5", "2025-02", 1), ("t", "d", "r6", "2025-01", 1), ("t", "x", None, "2025-01", 1)], key=repr)
    assert rows(orphan_report(got)) == [("t", "2025-01", 3, 4), ("t", "2025-02", 1, 1)]
    assert orphan_references(kids, parents.limit(0), *args).count() == 8
    assert orphan_references(kids.limit(0), parents, *args).count() == 0


def test_lookup_beyond_a_broadcast(spark, rows):
    # A third of the rows has one key and some have none; the lookup side has 300 000 rows.
    big = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 != 0, F.col("id") % 300_000).alias("k"), "id")
    small = spark.range(300_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = lookup_join(big, small, ["k"], how, salt_on=["id"], hot_rows=20_000)
        total = lambda df: df.agg(F.count(F.lit(1)), F.sum("id"), F.count("k")).first()
        assert total(joined) == total(big.join(small, ["k"], how)), how


def test_tables_are_measured(spark):
    wide = materialise(spark.createDataFrame([(1, "x" * 1000, ["y"])], "a int, b string, c array<string>"))
    assert measured(wide).rows == 1 and 1000 < measured(wide).size < 2000
    assert measured(materialise(wide.limit(0))).rows == 0
    assert is_small(wide) and not is_small(wide, size=500) and not is_small(wide, rows=0) and not is_small(spark.range(1))
    with intermediate_tables(spark):
        within = materialise(spark.range(3))
        assert within.count() == 3
        folder = within.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    stub = type("Session", (), {"conf": {}, "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        shared_dir(stub)
    stub.conf["spark.checkpoint.dir"] = "hdfs://x/y"
    assert shared_dir(stub) == "hdfs://x/y"
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[3,2,1000]")
