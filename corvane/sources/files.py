"""Reading source trees and the artifacts that lie beside them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.graph import INDEX_SCHEMA

#: First folders that are never scanned.
HARD_EXCLUDES = (".git", "target")


def glob_pattern(rule: str) -> tuple[str, bool]:
    """(pattern over relative paths, whether the rule takes files back in) of one line of an ignore file."""
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    rule = rule[1:] if rule.startswith("\\") else rule
    only_folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    signs = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def translate(part: str) -> str:
        if part[0] == "[" and part[-1] == "]" and len(part) > 2:
            return "[" + ("^" + part[2:-1] if part[1] in "!^" else part[1:-1]).replace("\\", "\\\\") + "]"
        return signs.get(part) or re.escape(part)

    out = "".join(translate(t) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|[^*?\[/]+|/|\[", rule.lstrip("/")))
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_folder else "(?:/.*)?$"), back


def keep_paths(path: Column, rules: list[str]) -> Column:
    """Whether a relative path is scanned under ignore rules: the last rule that fits decides."""
    kept = F.lit(True)
    for rule in rules:
        rule = rule.rstrip()
        if rule and not rule.startswith("#"):
            pattern, back = glob_pattern(rule)
            kept = F.when(path.rlike(pattern), F.lit(back)).otherwise(kept)
    return kept & ~F.substring_index(path, "/", 1).isin(*HARD_EXCLUDES)


def _relative(root: str) -> Column:
    return F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/+", "")


def scan_metadata(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """path, size_bytes, mtime of every file below `root` that the rules keep. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).where(keep_paths(F.col("path"), list(rules)))


def scan_files(spark: SparkSession, root: str, rules: list[str] = (), max_bytes: int | None = None) -> DataFrame:
    """As `scan_metadata`, with sha256 and the text; valid_utf8 tells whether the text is exact. Files beyond `max_bytes` keep their row without text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    body = F.col("content") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.col("content"))
    rows = files.select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(body.cast("string")).alias("content_text"), F.is_valid_utf8(body.cast("string")).alias("valid_utf8"))
    return rows.where(keep_paths(F.col("path"), list(rules)))


def changed_only_scan(metadata: DataFrame, previous: DataFrame, dirty: list[str] = ()) -> DataFrame:
    """path, size_bytes, mtime, sha256 (null where the file must be hashed again): a digest is taken over if size and mtime are equal and the path is no dirty hint."""
    before = previous.select("path", F.col("size_bytes").alias("s"), F.col("mtime").alias("m"), F.col("sha256").alias("d"))
    same = (F.col("size_bytes") == F.col("s")) & (F.col("mtime") == F.col("m")) & ~F.col("path").isin(*dirty) if dirty else (F.col("size_bytes") == F.col("s")) & (F.col("mtime") == F.col("m"))
    return metadata.join(before, "path", "left").select("path", "size_bytes", "mtime", F.when(same, F.col("d")).alias("sha256"))


def read_code_index(spark: SparkSession, path: str) -> DataFrame:
    """Code-index files in JSON, one per file, for `operators.graph.index_records`."""
    return spark.read.schema(INDEX_SCHEMA).option("multiLine", "true").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Step traces: playbook_id, step_index, step_id, tool_name, params_json, status, code, message."""
    schema = "trace_schema string, playbook_id string, step_count int, steps array<struct<step_index:int,step_id:string,tool_name:string,params_json:string,outcome:struct<status:string,response_json:string,code:string,message:string>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("playbook_id", F.explode("steps").alias("s")).select("playbook_id", "s.step_index", "s.step_id", "s.tool_name", "s.params_json", "s.outcome.status", "s.outcome.response_json", "s.outcome.code", "s.outcome.message")


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Markdown playbooks with a JSON header in their leading comment: file, header fields as JSON text, body; header is null where it is no JSON."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    header = F.regexp_extract("text", r"^\s*<!--\s*(?:[\w-]+:?\s*)?(\{(?s:.*?)\})\s*-->", 1)
    return texts.select("file", F.when(F.get_json_object(header, "$").isNotNull(), header).alias("header"), F.regexp_replace("text", r"^\s*<!--(?s:.*?)-->\s*", "").alias("body"))


def playbook_groups(playbooks: DataFrame) -> DataFrame:
    """playbook_id, query, top_k, group_id, expected, is_prefix of the witness groups in playbook headers."""
    schema = "playbook_id string, query string, top_k int, witness_groups array<struct<group_id:string,match_any:array<string>,match_mode:string,accepted_prefixes:array<string>>>"
    parsed = playbooks.where("header is not null").select(F.from_json("header", schema).alias("h")).select("h.playbook_id", "h.query", F.coalesce("h.top_k", F.lit(8)).alias("top_k"), F.explode("h.witness_groups").alias("g"))
    exact = F.transform(F.coalesce("g.match_any", F.array().cast("array<string>")), lambda p: F.struct(p.alias("expected"), F.lit(False).alias("is_prefix")))
    prefix = F.transform(F.coalesce("g.accepted_prefixes", F.array().cast("array<string>")), lambda p: F.struct(p.alias("expected"), F.lit(True).alias("is_prefix")))
    return parsed.select("playbook_id", "query", "top_k", F.col("g.group_id").alias("group_id"), F.explode(F.concat(exact, prefix)).alias("e")).select("playbook_id", "query", "top_k", "group_id", "e.*")

