"""Queries about tool calls and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import provenance as op
from corvane.streaming.refresh import debounced_sessions
from corvane.tables import load


def provenance_calls(spark, folder):
    return op.tool_calls(load(spark, folder, "provenance_event")).select("trace_id", "call_index", "tool", "status", "family", "created_at")


def provenance_by_tool(spark, folder):
    return op.workload(op.tool_calls(load(spark, folder, "provenance_event")))


def provenance_retention(spark, folder):
    """The latest 500 calls."""
    calls = load(spark, folder, "provenance_event").select("trace_id", "call_index", "created_at").distinct()
    return op.keep_latest(calls, [F.col("created_at").desc(), F.col("trace_id"), F.col("call_index")], 500)


def workload_export(spark, folder):
    events = load(spark, folder, "provenance_event").where("payload_json is not null")
    return events.select("trace_id", "call_index", op.sanitise(F.col("payload_json")).alias("payload")).distinct()


def trace_diff(spark, folder):
    """Each call against the call before it in the same trace."""
    calls = op.tool_calls(load(spark, folder, "provenance_event")).groupBy("trace_id", "call_index").agg(F.min("tool").alias("tool"), F.min(F.coalesce("status", F.lit(""))).alias("status"))
    return op.trace_diff(calls, calls.withColumn("call_index", F.col("call_index") + 1), "trace_id", "call_index", ["tool", "status"])


def debounce_sessions(spark, folder):
    return debounced_sessions(load(spark, folder, "events"), "user_id", "ts", "6 hours")


QUERIES = {f.__name__: f for f in (provenance_calls, provenance_by_tool, provenance_retention, workload_export, trace_diff, debounce_sessions)}

_CALLS = """said AS (SELECT trace_id, call_index, lower(trim(tool_name)) AS tool, created_at, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM provenance_event),
calls AS (SELECT DISTINCT trace_id, call_index, tool, json_extract_string(j, '$.outcome.status') AS status, json_extract_string(j, '$.params.repository_id') AS repository_id, try_cast(json_extract_string(j, '$.outcome.duration_ms') AS BIGINT) AS duration_ms, json_extract_string(j, '$.normalized_workload.family') AS family, created_at FROM said)"""
SQL = {
    "provenance_calls": f"WITH {_CALLS} SELECT trace_id, call_index, tool, status, family, created_at FROM calls",
    "provenance_by_tool": f"WITH {_CALLS} SELECT tool, coalesce(status, 'unknown') AS status, count(*) AS calls, count(DISTINCT repository_id) AS repositories, coalesce(sum(duration_ms), 0)::BIGINT AS total_ms FROM calls GROUP BY 1, 2",
    "provenance_retention": "SELECT DISTINCT trace_id, call_index, created_at FROM provenance_event ORDER BY created_at DESC, trace_id, call_index LIMIT 500",
    "workload_export": """WITH c AS (SELECT trace_id, call_index, regexp_replace(payload_json, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS p FROM provenance_event WHERE payload_json IS NOT NULL)
SELECT DISTINCT trace_id, call_index, CASE WHEN length(p) > 256 THEN substr(p, 1, 256) || '...' ELSE p END AS payload FROM c""",
    "trace_diff": f"""WITH {_CALLS}, once AS (SELECT trace_id, call_index, min(tool) AS tool, min(coalesce(status, '')) AS status FROM calls GROUP BY 1, 2),
prev AS (SELECT trace_id, call_index + 1 AS call_index, tool, status FROM once),
d AS (SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, coalesce(a.call_index, b.call_index)::INTEGER AS call_index,
  CASE WHEN b.trace_id IS NULL THEN 'missing' WHEN a.trace_id IS NULL THEN 'extra' WHEN a.tool IS DISTINCT FROM b.tool THEN 'tool' WHEN a.status IS DISTINCT FROM b.status THEN 'status' END AS difference
  FROM once a FULL JOIN prev b ON a.trace_id = b.trace_id AND a.call_index = b.call_index)
SELECT trace_id, call_index, difference, row_number() OVER (PARTITION BY trace_id ORDER BY call_index) = 1 AS first FROM d WHERE difference IS NOT NULL""",
    "debounce_sessions": """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS first_event, max(ts) + INTERVAL 6 HOUR AS due, count(*) AS events FROM n GROUP BY user_id, s""",
}
