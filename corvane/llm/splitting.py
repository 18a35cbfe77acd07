"""Splitting of oversized items at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise

LIMIT, OVERLAP = 4_096, 256

#: Endings of prose and of settings; any other ending is code.
PROSE = ("md", "markdown", "mdown", "mdx", "rst", "txt", "adoc", "tex", "license", "changes", "changelog", "readme", "notice", "copying", "authors")
SETTINGS = ("toml", "yaml", "yml", "ini", "cfg", "conf", "json", "xml", "html", "svg", "csv", "tsv", "properties", "lock", "plist")

# Patterns by strength, the strongest first; a piece may end where a match ends.
_EVERY = (
    rb"(?:[.!?][\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[ \t]*",  # end of a sentence
    rb"[;,:)}\]>|][ \t]*|\xe3\x80\x81|\xef\xbc\x8c",  # end of a clause
    rb"\s+",
    rb"[._/\\-]",
)
_BLANK, _LINE = rb"\r?\n(?:[ \t]*(?:\r\n|\n|\r))+", rb"\r\n|\n|\r"
_KINDS = {
    "prose": (rb"(?:\r\n|\n|\r)(?=#{1,6} |=+ \S)", _BLANK, rb"(?:\r\n|\n|\r)(?=[ \t]*(?:[-*+>|]|\d+[.)]) )", _LINE, *_EVERY),
    "code": (rb"\r?\n(?:[ \t]*(?:\r\n|\n|\r))+(?=[^\s})\]])", _BLANK, rb"(?:\r\n|\n|\r)(?=[^\s})\]])", rb"[;{}](?:[ \t]*(?:\r\n|\n|\r))", _LINE, *_EVERY),
    "settings": (_BLANK + rb"(?=[^\s])", rb"(?:\r\n|\n|\r)(?=\[|- |<)", rb"(?:\r\n|\n|\r)(?=[^\s})\]])", _LINE, *_EVERY),
}
_COMPILED = {kind: tuple(re.compile(p) for p in patterns) for kind, patterns in _KINDS.items()}
_FENCE = re.compile(rb"^(?:```|~~~).*$", re.M)


def kind_of(path: str | None) -> str:
    """prose, settings or code, told by the ending of the path; prose without one."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    ending = name.rsplit(".", 1)[-1]
    return "prose" if not name or ending in PROSE else "settings" if ending in SETTINGS or name.startswith(".") else "code"


def _fences(data: bytes) -> list[int]:
    """Borders of fenced code: an even number of borders before a place means it lies outside."""
    return [m.end() if i % 2 else m.start() for i, m in enumerate(_FENCE.finditer(data))]


def _whole(data: bytes, at: int, low: int, high: int) -> int:
    """The place nearest to `at` within low..high where no character is cut; marks stay with their letter."""
    starts = [i for i in range(max(low, at - 64), min(high, at + 64) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
    near = sorted(starts, key=lambda i: (abs(i - at), i))

    def joins(i: int) -> bool:
        head = data[i : i + 4].decode("utf-8", "ignore")[:1]
        tail = data[max(0, i - 4) : i].decode("utf-8", "ignore")[-1:]
        return bool(head) and (unicodedata.combining(head) > 0 or head in "‍︎️" or tail == "‍" or (tail, head) == ("\r", "\n"))

    return next((i for i in near if not joins(i)), near[0])


def _cut(data: bytes, target: int, low: int, high: int, first: int, last: int, patterns: tuple, fences: list[int]) -> int:
    """The end of the strongest boundary within low..high, the one nearest to `target` among equals.

    Without a boundary the nearest place between two characters within first..last.
    """
    inside = []
    for pattern in patterns:
        found = -1
        # Two bytes more on either side let a match that ends within be seen.
        for m in pattern.finditer(data, max(0, low - 2), min(len(data), high + 2)):
            at = m.end()
            if low <= at <= high and (found < 0 or abs(at - target) < abs(found - target)):
                if fences and bisect_left(fences, at) % 2:
                    inside.append(at)
                else:
                    found = at
        if found >= 0:
            return found
    if inside:
        return min(inside, key=lambda at: (abs(at - target), at))
    return _whole(data, target, first, last)


def _overlap_start(data: bytes, cut: int, begin: int, overlap: int) -> int:
    """Where the next piece starts: at most `overlap` bytes before `cut`, at a line or word if there is one."""
    low = max(begin, cut - overlap)
    while low < cut and data[low] & 0xC0 == 0x80:
        low += 1
    if low == begin or not overlap:
        return low
    if (line := data.find(b"\n", low - 1, cut - overlap // 2)) >= 0:
        return line + 1
    word = re.compile(rb"\s(?=\S)").search(data, low - 1, max(low, cut - overlap // 2))
    return word.end() if word else low


def split_bytes(data: bytes, kind: str = "prose", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own, end) of the pieces of UTF-8 text: bytes start..end, of which start..own repeat the piece before.

    Works out the fewest pieces, places targets so that all pieces have equal lengths and snaps
    each to the strongest boundary near it. If a piece can't keep the limit, one piece more is tried.
    """
    size = len(data)
    if size <= limit:
        return [(0, 0, size)]
    if limit < 2 * overlap + 16:
        raise ValueError("the limit must exceed twice the overlap by 16 bytes")
    patterns, fences = _COMPILED[kind], _fences(data) if kind == "prose" else []
    count = 1 + -(-(size - limit) // (limit - overlap))
    while True:
        length = (size + (count - 1) * overlap) / count  # of a piece with what it repeats
        reach = max(16, length / 4)
        pieces, start, own = [], 0, 0
        for i in range(1, count):
            target = int(i * (length - overlap) + overlap)
            first, last = own + 1, min(start + limit, size)
            # What is left after this cut should fit into the pieces that remain.
            low = min(max(first, int(target - reach), size - (count - i) * (limit - overlap)), last)
            high = max(low, min(last, int(target + reach)))
            cut = _cut(data, min(max(target, low), high), low, high, first, last, patterns, fences)
            pieces.append((start, own, cut))
            start, own = _overlap_start(data, cut, start, overlap), cut
            if own >= size:
                break
        if own < size:
            pieces.append((start, own, size))
        if all(end - begin <= limit for begin, _, end in pieces):
            return pieces
        count += 1


def split_items(df: DataFrame, item: Column, path: Column, text: Column, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Ordered pieces of every text of more than `limit` bytes: item, piece, start, own, end[, text].

    A piece is the bytes start..end of the text in UTF-8 and takes at most `limit` of them;
    start..own repeats the end of the piece before (at most `overlap` bytes) and is empty for piece
    0. Joined from own to end the pieces are the text. They end at the strongest break that the
    kind of file, told by the path, allows near the balanced place; no character is cut. Texts
    that are null or within the limit give no rows, nor do rows without item. An item delivered
    more than once is split once: the row with the least path, then text, counts. Without
    `with_text` only places are returned.
    """
    wide = df.select(item.alias("item"), path.alias("path"), text.alias("text")).where((F.octet_length("text") > limit) & F.col("item").isNotNull())
    ones = pa.schema([("item", pa.string()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "own", "end")), *([("text", pa.string())] if with_text else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, where, scalar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = scalar.as_py().encode("utf-8")
                for i, (start, own, end) in enumerate(split_bytes(data, kind_of(where), limit, overlap)):
                    rows.append((key, i, start, own, end, *([data[start:end].decode("utf-8")] if with_text else [])))
                held += len(data)
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ones)], schema=ones)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ones)], schema=ones)

    return _once(wide).mapInArrow(run, "item string, piece int, start bigint, own bigint, end bigint" + (", text string" if with_text else ""))


def _once(wide: DataFrame) -> DataFrame:
    """One row per item. Only items that come more than once are shuffled with their texts; the table is read three times, once to find them.

    Partial aggregation leaves one row a task of an item that comes very often.
    """
    repeated = materialise(wide.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item"))
    once = lookup_join(wide, repeated, ["item"], "left_anti", salt_on=["path"])
    least = F.min(F.struct(F.coalesce("path", F.lit("")).alias("path"), "text")).alias("row")
    chosen = lookup_join(wide, repeated, ["item"], "left_semi", salt_on=["path"]).groupBy("item").agg(least)
    return once.unionByName(chosen.select("item", "row.path", "row.text"))
