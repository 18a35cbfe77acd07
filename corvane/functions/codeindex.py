"""Code indexes in their binary form, read without generated classes.

The wire format is read as it is published: a key holds a field number and a wire type; field numbers
below are those of the index's public schema.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Field numbers.
DOCUMENTS, PATH, OCCURRENCES, SYMBOLS = 2, 1, 2, 3
RANGE, OCCURRENCE_SYMBOL, ROLES = 1, 2, 3
SYMBOL, RELATIONSHIPS, KIND, DISPLAY_NAME = 1, 4, 5, 6
RELATED, FLAGS = 1, {2: "is_reference", 3: "is_implementation", 4: "is_type_definition", 5: "is_definition"}


class WireError(ValueError):
    """Bytes that are no message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        elif kind in (1, 5, 2):
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            if at + size > len(data):
                raise WireError("length")
            if kind == 2:  # the schema has no fields of fixed size
                yield key >> 3, data[at : at + size]
            at += size
        else:
            raise WireError("wire type")


def _int32(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _text(value: int | bytes) -> str:
    if not isinstance(value, bytes):
        raise WireError("text")
    return value.decode("utf-8", "replace")


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [_int32(value)]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(_int32(n))
    return out


def read_index(data: bytes) -> list[dict]:
    """The documents of an index, in the shape of `operators.graph.INDEX_SCHEMA`."""
    return [_document(v) for n, v in fields(data) if n == DOCUMENTS and isinstance(v, bytes)]


def _document(data: bytes) -> dict:
    out: dict = {"relative_path": "", "occurrences": [], "symbols": []}
    for n, v in fields(data):
        if n == PATH:
            out["relative_path"] = _text(v)
        elif n == OCCURRENCES and isinstance(v, bytes):
            occurrence: dict = {"symbol": "", "range": [], "symbol_roles": 0}
            for k, x in fields(v):
                if k == RANGE:
                    occurrence["range"] += _numbers(x)
                elif k == OCCURRENCE_SYMBOL:
                    occurrence["symbol"] = _text(x)
                elif k == ROLES and isinstance(x, int):
                    occurrence["symbol_roles"] = _int32(x)
            out["occurrences"].append(occurrence)
        elif n == SYMBOLS and isinstance(v, bytes):
            symbol: dict = {"symbol": "", "display_name": "", "kind": "0", "relationships": []}
            for k, x in fields(v):
                if k == SYMBOL:
                    symbol["symbol"] = _text(x)
                elif k == DISPLAY_NAME:
                    symbol["display_name"] = _text(x)
                elif k == KIND and isinstance(x, int):
                    symbol["kind"] = str(x)
                elif k == RELATIONSHIPS and isinstance(x, bytes):
                    relation: dict = {"symbol": "", **dict.fromkeys(FLAGS.values(), False)}
                    for j, y in fields(x):
                        if j == RELATED:
                            relation["symbol"] = _text(y)
                        elif j in FLAGS:
                            relation[FLAGS[j]] = bool(y)
                    symbol["relationships"].append(relation)
            out["symbols"].append(symbol)
    return out


_TYPE = pa.list_(
    pa.struct([
        ("relative_path", pa.string()),
        ("occurrences", pa.list_(pa.struct([("symbol", pa.string()), ("range", pa.list_(pa.int32())), ("symbol_roles", pa.int32())]))),
        ("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("display_name", pa.string()), ("kind", pa.string()), ("relationships", pa.list_(pa.struct([("symbol", pa.string()), *((f, pa.bool_()) for f in FLAGS.values())])))]))),
    ])
)


def read_binary_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Binary index files: file, problem (null if it could be read), documents as `operators.graph.index_records` takes them."""
    from corvane.operators.graph import INDEX_SCHEMA

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    documents, problem = read_index(content.as_py()), None
                except WireError as e:
                    documents, problem = [], str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([problem], pa.string()), pa.array([documents], _TYPE)], names=["file", "problem", "documents"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, problem string, {INDEX_SCHEMA}")
