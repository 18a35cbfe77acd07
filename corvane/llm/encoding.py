"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.llm.bytepair import BytePairTrie, vocabulary_path

#: Texts encoded together share one trie; their number and their characters are bounded.
TEXTS, CHARACTERS = 4_096, 8_000_000

_encoders: dict[str, BytePairTrie] = {}


def encoder(path: str | None) -> BytePairTrie:
    """One encoder a Python worker; the default path is looked up where the worker runs."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = BytePairTrie(path)
    return _encoders[path]


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(offset, texts) of bounded groups of a column."""
    group: list[str | None] = []
    start = size = 0
    for i, scalar in enumerate(column):
        text = scalar.as_py()
        group.append(text)
        size += len(text or "")
        if len(group) >= TEXTS or size >= CHARACTERS:
            yield start, group
            group, start, size = [], i + 1, 0
    if group:
        yield start, group


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None, as_id: str = "doc_id") -> DataFrame:
    """Token ids of every text: `as_id` and ids, a list of integers, without special tokens.

    A null or empty text has the empty list. A repeated row comes out as often as it came
    in. Spellings of special tokens in a text are ordinary text. Texts are cut into words and every
    distinct word of a group of texts is encoded once, in one walk over the trie of those words;
    nothing is shuffled. `path` names the vocabulary file on the workers; unset, the installed
    byte_bpe_50k is used. Other columns are ignored.
    """
    kind = df.schema[id_col]
    out = StructType([StructField(as_id, kind.dataType, True), *StructType.fromDDL("ids array<int>").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder(path)
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                ids = pa.array(trie.encode_batch(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], names=[as_id, "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str | None = None) -> DataFrame:
    """The columns `keep` and `tokens`, the length of the text in tokens; 0 for null and empty texts."""
    out = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("tokens bigint").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder(path)
        for batch in batches:
            rest = batch.columns[1:]
            for start, texts in text_groups(batch.column(0)):
                sizes = pa.array([len(x) for x in trie.encode_batch(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(texts)) for c in rest), sizes], names=[*keep, "tokens"])

    return df.select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, out)
