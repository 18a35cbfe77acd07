"""Sources, sinks and streams."""

import json
import os
import time

import pytest

from corvane.sources import files, sinks
from corvane.streaming import refresh
from pyspark.sql import functions as F


def write(root, **texts):
    for name, body in texts.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_scan(spark, tmp_path, rows):
    tree = {"src/a.rs": "fn a", "src/b.log": "x", "target/x": "x", "build/keep.txt": "k", "build/drop.txt": "d", "bad.bin": b"\xff\xfe", "deep/build/z": "z"}
    write(tmp_path, **{k.replace("/", "__"): v for k, v in tree.items()})
    rules = ["# comment", "*.log", "/build/*", "!/build/keep.txt"]
    got = files.scan_files(spark, str(tmp_path), rules)
    assert rows(got, "path") == [("bad.bin",), ("build/keep.txt",), ("deep/build/z",), ("src/a.rs",)]
    assert {r.path: r.valid_utf8 for r in got.collect()}["bad.bin"] is False
    assert rows(got.where("path = 'src/a.rs'"), "size_bytes", "content_text") == [(4, "fn a")]
    meta = files.scan_metadata(spark, str(tmp_path), rules)
    before = got.select("path", "size_bytes", "mtime", "sha256")
    again = files.changed_only_scan(meta, before.where("path <> 'bad.bin'"), dirty=["src/a.rs"])
    assert rows(again.where("sha256 is null"), "path") == [("bad.bin",), ("src/a.rs",)]


@pytest.mark.parametrize("rule,yes,no", [("*.log", ["a.log", "d/a.log"], ["a.logs"]), ("/a/b", ["a/b", "a/b/c"], ["x/a/b"]), ("build/", ["build/x", "d/build/x"], ["build"]), ("a/**/z", ["a/z", "a/b/c/z"], ["z"]), ("f?o[12].c", ["fxo1.c"], ["fo1.c", "fxo3.c"])])
def test_ignore_rules(rule, yes, no):
    import re

    pattern, _ = files.glob_pattern(rule)
    assert all(re.search(pattern, p) for p in yes) and not any(re.search(pattern, p) for p in no)


def test_artifacts(spark, tmp_path, rows):
    trace = {"trace_schema": "v1", "playbook_id": "p", "step_count": 1, "steps": [{"step_index": 0, "step_id": "s", "tool_name": "t", "params_json": "{}", "outcome": {"status": "ok", "response_json": "{}"}}]}
    (tmp_path / "t.json").write_text(json.dumps(trace))
    assert rows(files.read_traces(spark, str(tmp_path / "t.json")), "step_id", "status") == [("s", "ok")]
    header = {"playbook_id": "p", "query": "q", "witness_groups": [{"group_id": "g", "match_any": ["a.rs"], "accepted_prefixes": ["src/"]}]}
    (tmp_path / "p.md").write_text("<!-- " + json.dumps(header) + " -->\n\n# Title\n")
    (tmp_path / "q.md").write_text("# No header\n")
    books = files.read_playbooks(spark, str(tmp_path / "*.md"))
    assert books.where("header is not null").count() == 1 and sorted(r.body for r in books.collect()) == ["# No header\n", "# Title\n"]
    assert rows(files.playbook_groups(books)) == [("p", "q", 8, "g", "a.rs", False), ("p", "q", 8, "g", "src/", True)]
    (tmp_path / "i.json").write_text(json.dumps({"documents": [{"relative_path": "a", "occurrences": [], "symbols": []}]}))
    assert files.read_code_index(spark, str(tmp_path / "i.json")).count() == 1


def test_publish(spark, tmp_path):
    root = str(tmp_path / "out")
    one = spark.range(3)
    assert sinks.head(spark, root) is None
    first = sinks.publish({"a": one, "b": one}, root, "s1")
    assert sinks.read_head(spark, root, "a").count() == 3
    second = sinks.publish({"a": spark.range(5)}, root, "s2", expected_head=first)
    assert sinks.head(spark, root) == second and sinks.read_head(spark, root, "a").count() == 5
    with pytest.raises(RuntimeError):
        sinks.publish({"a": one}, root, "s3", expected_head=first)
    assert sinks.prune_versions(spark, root, keep=1) == [first]
    events = spark.createDataFrame([(i, i) for i in range(30)], "id long, n long").withColumn("at", F.timestamp_seconds("n"))
    sinks.append_bounded(events, root + "/log", "at")
    assert sorted(r.id for r in sinks.read_bounded(spark, root + "/log", "at", keep=4).collect()) == [26, 27, 28, 29]
    sinks.overwrite_partitions(events.withColumn("k", F.col("id") % 2), root + "/p", ["k"])
    sinks.overwrite_partitions(events.limit(0).union(events.where("id = 1")).withColumn("k", F.lit(1).cast("long")), root + "/p", ["k"])
    assert spark.read.parquet(root + "/p").groupBy("k").count().orderBy("k").collect()[1]["count"] == 1


def events(folder, name, rows):
    tmp = folder.parent / (name + ".tmp")
    tmp.write_text("\n".join(json.dumps(dict(zip(("repository_id", "path", "event_time"), r))) for r in rows))
    os.replace(tmp, folder / (name + ".json"))


def test_stream_debounces_and_refreshes_in_two_stages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "repository_id string, path string, event_time timestamp"
    events(folder, "1", [("r", "a", "2025-01-01T00:00:00Z"), ("r", "b", "2025-01-01T00:00:01Z"), ("q", "a", "2025-01-01T00:00:00Z"), (None, "x", "2025-01-01T00:00:00Z")])
    seen = []

    def manifest_step(batch, number):
        return batch

    def semantic_step(changed, number):
        seen.extend((r.repository_id, r.events) for r in changed.collect())

    stream = refresh.change_stream(spark, str(folder), schema, per_trigger=1)
    query = refresh.run_refresh(refresh.refresh_sessions(stream), manifest_step, semantic_step, str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        assert not seen  # bursts are open until the watermark passes
        events(folder, "2", [("r", "c", "2025-01-01T00:01:00Z")])
        query.processAllAvailable()
        events(folder, "3", [("r", "d", "2025-01-01T00:02:00Z")])
        query.processAllAvailable()
        for _ in range(20):
            if len(seen) >= 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(seen)[:3] == [("q", 1), ("r", 1), ("r", 2)]


def test_hints_are_bounded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events(folder, "1", [("r", p, f"2025-01-01T00:00:0{i}Z") for i, p in enumerate("abcdeb")])
    stream = refresh.change_stream(spark, str(folder), "repository_id string, path string, event_time timestamp")
    query = refresh.recent_hints(stream).writeStream.format("memory").queryName("hints").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert [(r.paths, r.events) for r in spark.sql("select * from hints").collect()] == [(["c", "d", "e", "b"], 6)]
    finally:
        query.stop()


def test_retry_plan(spark, rows):
    data = [("r", "manifest", 1, False), ("r", "manifest", 2, True), ("r", "manifest", 3, False), ("r", "manifest", 4, False), ("q", "manifest", 1, False), ("q", "manifest", 2, True)]
    df = spark.createDataFrame(data, "repository_id string, refresh_class string, n long, ok boolean").withColumn("at", F.timestamp_seconds("n"))
    assert rows(refresh.retry_plan(df).select("repository_id", F.unix_seconds("next_at").alias("n"), "failures")) == [("r", 9, 2)]
