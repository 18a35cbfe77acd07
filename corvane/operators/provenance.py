"""Logs of tool calls: workload counts, retention, sanitised export, comparison of traces, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_calls(events: DataFrame) -> DataFrame:
    """trace_id, call_index, tool, status, repository_id, duration_ms, family of each call; what the payload does not say is null, payloads that are no JSON objects say nothing."""
    said = lambda path: F.get_json_object("payload_json", path)
    rows = events.select("trace_id", "call_index", F.lower(F.trim("tool_name")).alias("tool"), said("$.outcome.status").alias("status"), said("$.params.repository_id").alias("repository_id"), said("$.outcome.duration_ms").try_cast("long").alias("duration_ms"), said("$.normalized_workload.family").alias("family"), "created_at")
    return rows.distinct()


def workload(calls: DataFrame) -> DataFrame:
    """tool, status, calls, repositories, total_ms."""
    return calls.groupBy("tool", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("repository_id").alias("repositories"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_ms"))


def keep_latest(events: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The `keep` latest rows. A bound on the order columns is found by a top-k, so nothing is sorted as a whole."""
    return events.orderBy(*order).limit(keep)


def sanitise(column: Column, most: int = 256) -> Column:
    """Text cut to `most` characters, with a mark; control characters become blanks."""
    clean = F.regexp_replace(column, r"[\x00-\x1f\x7f]", " ")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def sanitise_value(value, text: int = 256, items: int = 8, keys: int = 16, depth: int = 6):
    """A JSON value within bounds: shorter texts, fewer items and sorted keys; what lies deeper than `depth` becomes null."""
    if isinstance(value, str):
        return value if len(value) <= text else value[:text] + "..."
    if isinstance(value, (list, dict)) and depth <= 0:
        return None
    if isinstance(value, list):
        return [sanitise_value(x, text, items, keys, depth - 1) for x in value[:items]]
    if isinstance(value, dict):
        return {k: sanitise_value(value[k], text, items, keys, depth - 1) for k in sorted(value)[:keys]}
    return value


def trace_diff(expected: DataFrame, replayed: DataFrame, key: str, step: str, fields: list[str]) -> DataFrame:
    """Steps in which two runs of a trace differ: key, step, difference (missing, extra or the first field that differs), first (of its trace)."""
    a = expected.select(key, step, *[F.col(f).alias("a_" + f) for f in fields], F.lit(True).alias("in_a"))
    b = replayed.select(key, step, *[F.col(f).alias("b_" + f) for f in fields], F.lit(True).alias("in_b"))
    joined = a.join(b, [key, step], "full")
    difference = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra")
    for f in fields:
        difference = difference.when(~F.col("a_" + f).eqNullSafe(F.col("b_" + f)), f)
    rows = joined.withColumn("difference", difference).where("difference is not null")
    return rows.withColumn("first", F.row_number().over(Window.partitionBy(key).orderBy(step)) == 1).select(key, step, "difference", "first")


def group_matches(groups: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each group of expected paths is met: group_id, exact, prefix, passed.

    groups: group_id, expected (a path), is_prefix. Only an exact hit passes; a hit by prefix is reported.
    """
    exact = groups.where("not is_prefix").join(results.select(F.col("path").alias("expected")).distinct(), "expected", "left_semi").select("group_id").distinct().withColumn("exact", F.lit(True))
    prefixes = groups.where("is_prefix").select("group_id", "expected", F.length("expected").alias("n"))
    # Equal heads instead of a comparison of all pairs: each length of prefix gives one key a path.
    sizes = prefixes.select("n").distinct()
    heads = results.select("path").distinct().join(F.broadcast(sizes), F.length("path") >= F.col("n")).select(F.substring("path", F.lit(1), F.col("n")).alias("expected")).distinct()
    by_prefix = prefixes.join(heads, "expected", "left_semi").select("group_id").distinct().withColumn("prefix", F.lit(True))
    return groups.select("group_id").distinct().join(exact, "group_id", "left").join(by_prefix, "group_id", "left").select("group_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("prefix", F.lit(False)).alias("prefix"), F.coalesce("exact", F.lit(False)).alias("passed"))
