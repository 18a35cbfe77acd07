"""Cutting files into chunks for embedding, by lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_SIZE = 64, 2_400
_HEADING = re.compile(r"^#{1,6} ")


# Endings of files that are chunked, and what they hold.
CHUNKED = ((".blade.php", "blade"), (".rs", "rust"), (".php", "php"), (".md", "markdown"), (".markdown", "markdown"), (".json", "json"), (".toml", "toml"), (".txt", "text"), (".yaml", "yaml"), (".yml", "yaml"))


def chunk_language(path: Column) -> Column:
    """What a file that is chunked holds, by its ending; null for files that are not."""
    low, out = F.lower(path), None
    for ending, name in CHUNKED:
        out = F.when(low.endswith(ending), name) if out is None else out.when(low.endswith(ending), name)
    return out


def chunk_lines(text: str, markdown: bool, max_lines: int = MAX_LINES, max_size: int = MAX_SIZE) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the chunks of a file; blank chunks are left out.

    A chunk ends after `max_lines` lines, before the line that would bring it over `max_size` bytes, and before a
    markdown heading; lines that have no bytes yet before them never end one. A chunk that is still too large
    is cut every `max_size` characters. A small file that is no markdown is one chunk by these rules.
    """
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out: list[tuple[int, int, str]] = []
    begin, size = 0, 0

    def flush(end: int) -> None:
        body = "\n".join(lines[begin:end]).rstrip("\r\n")
        if body.strip():
            out.extend((begin + 1, max(end, begin + 1), body[at : at + max_size]) for at in range(0, len(body), max_size))

    for i, line in enumerate(lines):
        bare = line.rstrip("\r")
        more = len(bare.encode("utf-8", "replace"))
        if size and (i - begin >= max_lines or size + more + 1 > max_size or (markdown and _HEADING.match(bare))):
            flush(i)
            begin, size = i, 0
        size += more + (size > 0)
    flush(len(lines))
    return out


def chunk_files(df: DataFrame, key: Column, path: Column, text: Column) -> DataFrame:
    """key, path, language, chunk_index, start_line, end_line, chunk_id, content of the files that are chunked (`chunk_language`): an id hashes all but the snapshot, so unchanged chunks keep theirs. Null texts have no chunks."""
    schema = pa.schema([("key", pa.string()), ("path", pa.string()), ("language", pa.string()), ("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("chunk_id", pa.string()), ("content", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k, p, kind, scalar in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), batch.column(2)):
                body = scalar.as_py()
                for i, (first, last, piece) in enumerate(chunk_lines(body, kind == "markdown")):
                    digest = hashlib.sha256("\0".join((k or "", p or "", str(i), str(first), str(last), piece)).encode("utf-8", "replace")).hexdigest()[:32]
                    rows.append((k, p, kind, i, first, last, digest, piece))
                held += len(body)
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "key string, path string, language string, chunk_index int, start_line int, end_line int, chunk_id string, content string"
    return df.select(key.alias("key"), path.alias("path"), text.alias("text"), chunk_language(path).alias("language")).where("text is not null and language is not null").mapInArrow(run, ddl)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    size = F.octet_length("content")
    return chunks.groupBy("key", "path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("longest"))
