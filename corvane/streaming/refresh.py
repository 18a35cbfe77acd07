"""Incremental refresh from a stream of change events."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Dirty paths that are kept as hints.
HINTS = 4


def debounced_sessions(events: DataFrame, key: str, at: str, gap: str = "2 seconds") -> DataFrame:
    """Bursts of events of one key: key, first_event, due, events. Every event moves the due time to `gap` after it.

    The same plan serves a table and a stream; for a stream set a watermark on `at` first.
    """
    window = F.session_window(F.col(at), gap)
    grouped = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key), window.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("first_event"), F.col("w.end").alias("due"), "events")


def change_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Change events as they are written to a folder in JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def refresh_sessions(stream: DataFrame, debounce: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Debounced refresh requests of a change stream (repository_id, path, event_time). Events later than `late` are dropped, which is our choice."""
    return debounced_sessions(stream.withWatermark("event_time", late), "repository_id", "event_time", debounce)


def recent_hints(stream: DataFrame, hints: int = HINTS) -> DataFrame:
    """The last `hints` distinct dirty paths of each repository after each batch: repository_id, paths, events. State is bounded."""

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, count = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for batch in batches:
            for path in batch.sort_values(["event_time", "path"])["path"]:
                count += 1
                if path is not None:
                    paths = [p for p in paths if p != path] + [path]
                    paths = paths[-hints:]
        state.update((paths, count))
        yield pd.DataFrame({"repository_id": [key[0]], "paths": [paths], "events": [count]})

    return stream.groupBy("repository_id").applyInPandasWithState(advance, "repository_id string, paths array<string>, events long", "paths array<string>, events long", "update", GroupStateTimeout.NoTimeout)


def retry_plan(outcomes: DataFrame, delay_s: int = 5) -> DataFrame:
    """What to run again: repository_id, refresh_class, next_at, failures in a row. A success clears; `outcomes` has repository_id, refresh_class, at, ok. One task a class runs at a time, so the last outcome decides."""
    runs = outcomes.groupBy("repository_id", "refresh_class").agg(F.max("at").alias("last_at"), F.max_by("ok", "at").alias("last_ok"), F.max(F.when(F.col("ok"), F.col("at"))).alias("good_at"))
    failing = outcomes.join(runs, ["repository_id", "refresh_class"]).where("not last_ok and not ok and (good_at is null or at > good_at)")
    return failing.groupBy("repository_id", "refresh_class").agg((F.max("last_at") + F.make_interval(secs=F.lit(delay_s))).alias("next_at"), F.count(F.lit(1)).alias("failures"))


def run_refresh(sessions: DataFrame, manifest_step: Callable[[DataFrame, int], DataFrame], semantic_step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Two stages a batch: the manifest refresh first, the semantic follow-up on what it changed.

    Both get the batch number; a step that writes under that number can be repeated after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        changed = manifest_step(batch, number)
        semantic_step(changed, number)

    return sessions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()
