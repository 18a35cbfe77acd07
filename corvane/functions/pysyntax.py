"""Symbols, nodes and the stack of nodes at a place of Python source, from its syntax tree."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "file string, kind string, name string, qualified string, start_line int, end_line int, start_column int, end_column int"
_KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}


def parse(text: str) -> ast.AST | None:
    """The tree, or None for what is no Python or nests too deeply."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def declared(text: str) -> list[tuple]:
    """(kind, name, qualified name, first line, last line, first column, last column): functions, methods, classes and upper-case constants of modules and classes. Columns are byte offsets plus one."""
    tree = parse(text)
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str, bool]] = [(tree, "", False)] if tree else []
    while stack:
        node, scope, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            kind = _KINDS.get(type(child))
            if kind:
                qualified = f"{scope}.{child.name}" if scope else child.name
                out.append(("method" if in_class and kind == "function" else kind, child.name, qualified, child.lineno, child.end_lineno, child.col_offset + 1, child.end_col_offset + 1))
                stack.append((child, qualified, kind == "class"))
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and isinstance(node, (ast.Module, ast.ClassDef)):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name) and target.id.isupper():
                        out.append(("const", target.id, f"{scope}.{target.id}" if scope else target.id, child.lineno, child.end_lineno, child.col_offset + 1, child.end_col_offset + 1))
            else:
                stack.append((child, scope, in_class))
    return sorted(out, key=lambda r: (r[3], r[5], r[1]))


def matching_nodes(text: str, kind: str, name: str | None = None, within: str | None = None) -> list[tuple[str, str | None, int, int, int]]:
    """(kind, name, line, column, last line) of nodes of a kind, such as Call or Import, with that name, inside a node of kind `within`."""
    tree = parse(text)
    out = []
    stack: list[tuple[ast.AST, bool]] = [(tree, within is None)] if tree else []
    while stack:
        node, inside = stack.pop()
        if inside and type(node).__name__ == kind and (name is None or _name(node) == name) and hasattr(node, "lineno"):
            out.append((kind, _name(node), node.lineno, node.col_offset + 1, node.end_lineno))
        inside = inside or type(node).__name__ == within
        stack += [(c, inside) for c in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda r: (r[2], r[3], r[4]))


def _name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        node = node.func
    for field in ("name", "id", "attr", "arg", "module"):
        if isinstance(value := getattr(node, field, None), str):
            return value
    return None


def stack_at(text: str, line: int, column: int) -> list[tuple[str, str | None, int, int]]:
    """(kind, name, first line, last line) of the nodes around a place, the outermost first."""
    node, out = parse(text), []
    place = (line, column - 1)
    while node is not None:
        node = next((c for c in ast.walk(node) if c is not node and hasattr(c, "lineno") and (c.lineno, c.col_offset) <= place < (c.end_lineno, c.end_col_offset)), None)
        if node is not None:
            out.append((type(node).__name__, _name(node), node.lineno, node.end_lineno))
    return out


def python_symbols(df: DataFrame, file: Column, text: Column) -> DataFrame:
    """Exact symbols of Python files: file, kind, name, qualified, start_line, end_line, start_column, end_column. Other texts have none."""
    types = [pa.string()] * 4 + [pa.int32()] * 4
    names = [c.split()[0] for c in SYMBOLS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *s) for f, t in zip(batch.column(0).to_pylist(), batch.column(1)) for s in declared(t.as_py())]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return df.select(file.cast("string").alias("file"), text.alias("text")).where("text is not null").mapInArrow(run, SYMBOLS)


MATCHES = "file string, kind string, name string, line int, column int, last_line int"
STACK = "file string, line int, column int, depth int, kind string, name string, first_line int, last_line int"


def _rows(df: DataFrame, make: Callable[[tuple], Iterable[tuple]], schema: str, texts: dict[str, pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [texts[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for record in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))) for r in make(record)]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return df.mapInArrow(run, schema)


_TYPES = {"string": pa.string(), "int": pa.int32()}


def search_structural(df: DataFrame, file: Column, text: Column, kind: str, name: str | None = None, within: str | None = None) -> DataFrame:
    """Nodes of a kind (and name, and inside a node of another kind) in Python texts: file, kind, name, line, column, last_line. Other texts have none."""
    rows = df.select(file.cast("string").alias("file"), text.alias("text")).where("text is not null")
    return _rows(rows, lambda r: ((r[0], *m) for m in matching_nodes(r[1], kind, name, within)), MATCHES, _TYPES)


def inspect_syntax_tree(df: DataFrame, file: Column, text: Column, line: Column, column: Column) -> DataFrame:
    """The nodes around a place of each Python text, the outermost first: file, line, column, depth, kind, name, first_line, last_line."""
    rows = df.select(file.cast("string").alias("file"), text.alias("text"), line.cast("int").alias("line"), column.cast("int").alias("column")).where("text is not null and line is not null and column is not null")
    return _rows(rows, lambda r: ((r[0], r[2], r[3], i, *n) for i, n in enumerate(stack_at(r[1], r[2], r[3]))), STACK, _TYPES)


def node_counts(df: DataFrame, text: Column) -> DataFrame:
    """How many nodes of each kind the Python texts have: kind, nodes. Counts of a text are folded before rows leave it."""

    def kinds(record: tuple) -> Iterable[tuple]:
        tree = parse(record[0])
        return Counter(type(n).__name__ for n in ast.walk(tree)).items() if tree else ()

    counted = _rows(df.select(text.alias("text")).where("text is not null"), kinds, "kind string, nodes int", _TYPES)
    return counted.groupBy("kind").agg(F.sum("nodes").alias("nodes"))
