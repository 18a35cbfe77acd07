"""Deeply nested records as related flat tables.

A record is striped into columns, one per leaf path of the record's own schema. A leaf path is a
sequence of steps: `{` the value is an object, `.name` the object has that field, `[` the value is a
list that has an element, `=` the value is a scalar, `]` the value is an empty list. Each entry of a
column is (repetition level, definition level, value): the first tells at which list of the path the
entry starts a new element (0: a new record), the second how many steps of the path are defined.
Every repeated or optional ancestor can be rebuilt from the levels of any one leaf below it.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsontext import Number, parse

LEVELS = "source_table string, record_id string, leaf array<string>, r array<int>, d array<int>, v array<string>"
OBJECTS = "source_table string, record_id string, node_path string, parent_path string"
ROWS = "source_table string, record_id string, table string, row_path string, parent_table string, parent_path string"
VALUES = "source_table string, record_id string, object_path string, field string, kind string, value string"


class _Node:
    """What stands at one place of the schema, over all elements that share it."""

    __slots__ = ("elem", "empty_list", "fields", "scalar", "columns")

    def __init__(self) -> None:
        self.fields: dict[str, _Node] | None = None
        self.elem: _Node | None = None
        self.empty_list = self.scalar = False
        self.columns: dict[str, tuple[list, list, list]] = {}

    def see(self, value) -> None:
        if isinstance(value, dict):
            fields = self.fields = {} if self.fields is None else self.fields
            for name, x in value.items():
                if (child := fields.get(name)) is None:
                    child = fields[name] = _Node()
                child.see(x)
        elif isinstance(value, list):
            if value:
                elem = self.elem = self.elem or _Node()
                for x in value:
                    elem.see(x)
            else:
                self.empty_list = True
        else:
            self.scalar = True

    def only_objects(self) -> bool:
        """Keep the fewest columns that still tell of every object; whether any is left."""
        self.scalar = self.empty_list = False
        if self.fields is not None:
            self.fields = {k: x for k, x in self.fields.items() if x.only_objects()}
        if self.elem is not None and not self.elem.only_objects():
            self.elem = None
        return self.fields is not None or self.elem is not None

    def put(self, leaf: str, r: int, d: int, value) -> None:
        column = self.columns.get(leaf)
        if column is None:
            column = self.columns[leaf] = ([], [], [])
        column[0].append(r)
        column[1].append(d)
        column[2].append(value)

    def missing(self, r: int, d: int) -> None:
        """An entry in each column below this place, defined as far as `d`."""
        if self.scalar:
            self.put("=", r, d, None)
        if self.empty_list and self.elem is None:
            self.put("]", r, d, None)
        if self.fields is not None:
            self.missing_fields(r, d)
        if self.elem is not None:
            self.elem.missing(r, d)

    def missing_fields(self, r: int, d: int) -> None:
        if not self.fields:
            self.put("{", r, d, None)
        for child in self.fields.values():
            child.missing(r, d)

    def stripe(self, value, r: int, d: int, depth: int) -> None:
        """Write `value` into the columns below; `depth` lists lie around this place."""
        is_object, is_list = isinstance(value, dict), isinstance(value, list)
        if self.scalar:
            self.put("=", r, d if is_object or is_list else d + 1, None if is_object or is_list else value)
        if self.empty_list and self.elem is None:
            self.put("]", r, d + 1 if is_list else d, None)
        if self.fields is not None:
            if not is_object:
                self.missing_fields(r, d)
            elif not self.fields:
                self.put("{", r, d + 1, None)
            else:
                for name, child in self.fields.items():
                    if name in value:
                        child.stripe(value[name], r, d + 2, depth)
                    else:
                        child.missing(r, d + 1)
        if self.elem is not None:
            if is_list and value:
                for x in value:
                    self.elem.stripe(x, r, d + 1, depth + 1)
                    r = depth + 1
            else:
                self.elem.missing(r, d)

    def leaves(self, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], tuple[list, list, list]]]:
        for step, column in self.columns.items():
            yield (*path, step), column
        for name, child in (self.fields or {}).items():
            yield from child.leaves((*path, "{", "." + name))
        if self.elem is not None:
            yield from self.elem.leaves((*path, "["))


def stripe_record(value, objects_only: bool = False) -> list[tuple[tuple[str, ...], tuple[list, list, list]]]:
    """The columns of one record: (leaf path, (repetition levels, definition levels, values)).

    objects_only leaves out columns that are not needed to rebuild which objects there are.
    """
    schema = _Node()
    schema.see(value)
    if objects_only and not schema.only_objects():
        return []
    schema.stripe(value, 0, 0, 0)
    return list(schema.leaves(()))


def _pointer(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _walk(columns: Iterable[tuple[tuple[str, ...], tuple[list, list, list]]], wanted: str) -> Iterator[tuple[tuple[str, ...], int, int, list[str], list[int]]]:
    """Every time a place of the schema that ends in the step `wanted` comes into being: (leaf, steps of the place, place around, pointers by number of steps, list positions).

    Each place is rebuilt from the first column below it. Columns come in the order of a walk, so those with a common
    prefix stand together, and what the column before shares has been told. Pointers are kept from entry to entry:
    behind the list that an entry continues they are written anew, as far as the entry is defined.
    """
    last: tuple[str, ...] = ()
    for leaf, (rs, ds, _) in columns:
        shared = next((i for i, (x, y) in enumerate(zip(leaf, last)) if x != y), min(len(leaf), len(last)))
        last = leaf
        places = [i + 1 for i, step in enumerate(leaf) if step == wanted]
        fresh = [n for n in places if n > shared]
        if not fresh:
            continue
        around = dict(zip(places, [0, *places]))
        steps = [None if s == "[" else "/" + _pointer(s[1:]) if s[0] == "." else "" for s in leaf]
        lists = [0]
        for s in leaf:
            lists.append(lists[-1] + (s == "["))
        starts = [0, *(i for i, s in enumerate(leaf) if s == "[")]
        at, pointers = [0] * (lists[-1] + 1), [""] * (len(leaf) + 1)
        for r, d in zip(rs, ds):
            if r:
                at[r] += 1
                at[r + 1 :] = [0] * (lists[-1] - r)
            first = starts[r]
            for i in range(first, min(d, fresh[-1])):
                pointers[i + 1] = pointers[i] + (f"/{at[lists[i + 1]]}" if steps[i] is None else steps[i])
            # A place is new where its own list, or one around it, goes on: behind `first`.
            for n in fresh[bisect_left(fresh, first + 1) : bisect_right(fresh, d)]:
                if r <= lists[n]:
                    yield leaf, n, around[n], pointers, at


def assemble_objects(columns: Iterable[tuple[tuple[str, ...], tuple[list, list, list]]]) -> list[tuple[str, str]]:
    """(node_path, parent_path) of each object of a record, from the level sequences alone. The root object is not listed."""
    return [(pointers[n], pointers[above]) for _, n, above, pointers, _ in _walk(columns, "{") if n > 1]


def assemble_rows(columns: Iterable[tuple[tuple[str, ...], tuple[list, list, list]]]) -> list[tuple[str, str, str, str]]:
    """(table, row_path, parent_table, parent_path) of each element of each list of a record: a table for each repeated place of
    the schema, its rows linked to those of the repeated place around it; "" is the record."""
    names: dict[tuple[int, int], str] = {}
    out, seen = [], None
    for leaf, n, above, pointers, _ in _walk(columns, "["):
        if leaf is not seen:
            seen, names = leaf, {}
        for end in (n, above):
            if (0, end) not in names:
                names[0, end] = "".join("/[]" if s == "[" else "/" + _pointer(s[1:]) if s[0] == "." else "" for s in leaf[:end])
        out.append((names[0, n], pointers[n], names[0, above], pointers[above]))
    return out


def assemble_values(columns: Iterable[tuple[tuple[str, ...], tuple[list, list, list]]]) -> list[tuple[str, str, str, str | None]]:
    """(object_path, field, kind, value) of each scalar of a record, from the level sequences.

    `field` is the pointer from the nearest object around to the scalar. A JSON null has kind
    `null` and no value.
    """
    out = []
    for leaf, (rs, ds, vs) in columns:
        if leaf[-1] != "=":
            continue
        holder = max((i + 1 for i, step in enumerate(leaf) if step == "{"), default=0)
        at = [0] * (leaf.count("[") + 1)
        for r, d, v in zip(rs, ds, vs):
            if r:
                at[r] += 1
                at[r + 1 :] = [0] * (len(at) - r - 1)
            if d < len(leaf):
                continue
            parts, depth = [], 0
            for s in leaf:
                if s == "[":
                    depth += 1
                parts.append(f"/{at[depth]}" if s == "[" else "/" + _pointer(s[1:]) if s[0] == "." else "")
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, Number) else "string"
            out.append(("".join(parts[:holder]), "".join(parts[holder:]), kind, None if v is None else str(v).lower() if kind == "boolean" else str(v)))
    return out


def read_payload(text: str | None):
    """(whether there is a record, its value): a payload that is itself a JSON string is read once more."""
    if text is None:
        return False, None
    try:
        value = parse(text)
        if type(value) is str:
            value = parse(value)
    except ValueError:
        return False, None
    return True, value


def _each_record(batches: Iterable[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(1_000_000)
    for batch in batches:
        rows: list[tuple] = []
        for table, record, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            there, value = read_payload(text)
            if there:
                rows.extend((table, record, *x) for x in make(value))
            if len(rows) >= 20_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _text(value):
    """Half a surrogate pair can be escaped in JSON but not be written as UTF-8."""
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) and not value.isascii() else value


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_text(x) for x in column], field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _strings(n: int) -> pa.Schema:
    names = ("source_table", "record_id", *(f"c{i}" for i in range(n)))
    return pa.schema([(x, pa.string()) for x in names])


def records(df: DataFrame, source_table: str, record_id: Column, payload: Column) -> DataFrame:
    """The three columns that the functions below read."""
    return df.select(F.lit(source_table).alias("source_table"), record_id.cast("string").alias("record_id"), payload.cast("string").alias("payload"))


def shred(recs: DataFrame) -> DataFrame:
    """Columns of every record with their levels: source_table, record_id, leaf, r, d, v.

    `v` holds scalars as text. A payload that is null or no valid JSON gives no row.
    """
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    schema = pa.schema([("source_table", pa.string()), ("record_id", pa.string()), ("leaf", strings), ("r", ints), ("d", ints), ("v", strings)])

    def run(batches):
        def make(value):
            for leaf, (r, d, v) in stripe_record(value):
                yield list(map(_text, leaf)), r, d, [x if x is None else str(x).lower() if isinstance(x, bool) else _text(str(x)) for x in v]

        return _each_record(batches, make, schema)

    return recs.mapInArrow(run, LEVELS)


def nested_objects(recs: DataFrame) -> DataFrame:
    """One row per object inside each record: source_table, record_id, node_path, parent_path.

    Paths are JSON pointers. Records with the same id are merged: no row comes twice. Null,
    empty and broken payloads give no row, and neither do payloads without inner objects.
    """

    def run(batches):
        return _each_record(batches, lambda value: assemble_objects(stripe_record(value, objects_only=True)), _strings(2))

    return recs.mapInArrow(run, OBJECTS).distinct()


def nested_values(recs: DataFrame) -> DataFrame:
    """One row per scalar inside each record, linked to its object by object_path."""

    def run(batches):
        return _each_record(batches, lambda value: assemble_values(stripe_record(value)), _strings(4))

    return recs.mapInArrow(run, VALUES).distinct()


def nested_rows(recs: DataFrame) -> DataFrame:
    """A table for each repeated place: source_table, record_id, table, row_path, parent_table, parent_path, one row per list element.

    `table` is the place in the schema, such as /children/[]/types/[]; the parent is the element of the repeated place around.
    """

    def run(batches):
        return _each_record(batches, lambda value: assemble_rows(stripe_record(value)), _strings(4))

    return recs.mapInArrow(run, ROWS).distinct()


def leaf_statistics(levels: DataFrame) -> DataFrame:
    """Of the columns that `shred` gives, by leaf path: source_table, leaf_path, records, entries, defined (entries that reach the leaf), repeated (the largest repetition level)."""
    told = levels.select("source_table", F.array_join("leaf", "").alias("leaf_path"), F.size("r").alias("n"), F.size(F.filter("d", lambda d: d == F.size("leaf"))).alias("full"), F.array_max("r").alias("top"))
    return told.groupBy("source_table", "leaf_path").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("entries"), F.sum("full").alias("defined"), F.max("top").alias("repeated"))
