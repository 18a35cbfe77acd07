"""Syntax trees, binary indexes, query intent and the tools."""

import pytest

from corvane.api import Corpus
from corvane.functions import codeindex, intent, pysyntax
from corvane.operators import graph
from pyspark.sql import functions as F

SOURCE = "LIMIT = 3\n\nclass User:\n    KEY: int = 1\n\n    def save(self):\n        return validate(self)\n\n\ndef validate(x):\n    def inner():\n        pass\n    return save(x)\n"


def test_python_symbols(spark, rows):
    assert [(k, q, a, b) for k, _, q, a, b, _, _ in pysyntax.declared(SOURCE)] == [("const", "LIMIT", 1, 1), ("class", "User", 3, 7), ("const", "User.KEY", 4, 4), ("method", "User.save", 6, 7), ("function", "validate", 10, 13), ("function", "validate.inner", 11, 12)]
    assert pysyntax.declared("def (") == [] and pysyntax.declared("") == []
    assert [r[1:3] for r in pysyntax.matching_nodes(SOURCE, "Call")] == [("validate", 7), ("save", 13)]
    assert pysyntax.matching_nodes(SOURCE, "Call", "save", within="ClassDef") == []
    assert [k for k, *_ in pysyntax.stack_at(SOURCE, 7, 16)][:2] == ["ClassDef", "FunctionDef"]
    df = spark.createDataFrame([("a", SOURCE), ("b", None), ("c", "fn x() {")], "f string, t string")
    assert pysyntax.python_symbols(df, F.col("f"), F.col("t")).count() == 6


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def msg(number, body):
    body = body.encode() if isinstance(body, str) else body
    return varint(number << 3 | 2) + varint(len(body)) + body


def num(number, value):
    return varint(number << 3) + varint(value)


def test_binary_index(spark, tmp_path, rows):
    occurrence = msg(1, b"".join(map(varint, (2, 4, 9)))) + msg(2, "pkg User#") + num(3, 1)
    relation = msg(1, "pkg Base#") + num(3, 1)
    symbol = msg(1, "pkg User#") + msg(4, relation) + num(5, 7) + msg(6, "User")
    data = msg(1, b"meta") + msg(2, msg(1, "src/user.php") + msg(2, occurrence) + msg(2, num(1, -1) + msg(2, "x")) + msg(3, symbol) + b"\x09" + b"\0" * 8)
    (tmp_path / "ok.bin").write_bytes(data)
    (tmp_path / "bad.bin").write_bytes(data[:-3])
    got = codeindex.read_binary_indexes(spark, str(tmp_path / "*.bin"))
    assert rows(got.select(F.substring_index("file", "/", -1), F.col("problem").isNull())) == [("bad.bin", False), ("ok.bin", True)]
    records = graph.index_records(got.where("problem is null").select("documents"))
    assert rows(records["occurrences"]) == [("src/user.php", "pkg User#", 3, 5, 3, 10, True)]
    assert rows(records["relationships"]) == [("src/user.php", "pkg User#", "pkg Base#", "implementation")]
    assert rows(records["symbols"], "display_name", "kind") == [("User", "7")]
    assert rows(records["problems"], "code") == [("range_length",)]
    for broken in (b"\xff", b"\x0a\x05a", b"\x0b"):
        with pytest.raises(codeindex.WireError):
            list(codeindex.fields(broken))


def test_intent():
    got = intent.read_query("where is the checkout handler tested", 10)
    assert got.shape == "language" and "runtime" in got.flags and got.terms == ("checkout", "handler", "tested")
    assert intent.read_query("handle_checkout_request").shape == "code"
    assert intent.overlap_terms("parseHTTPRequest snake_case") == ["parsehttprequest", "parse", "http", "request", "snake_case", "snake", "case"]
    assert intent.ascii_lower("ÉA") == "Éa"
    assert intent.limits(16, "code") == (18, 64) and intent.limits(9999, "language")[0] == 200


def test_tools(spark, rows):
    data = [
        ("r1", "src/checkout.rs", "pub fn handle_checkout(x: u8) {\n    validate(x);\n    render(x);\n}\n\nfn validate(x: u8) {\n    x + 1;\n}\n"),
        ("r1", ".\\tests\\checkout_test.rs", "fn test_checkout() {\n    handle_checkout(1);\n}\n"),
        ("r2", "README.md", "Where is checkout handled? See handle_checkout.\n"),
        ("r2", "empty.rs", None),
    ]
    corpus = Corpus(spark.createDataFrame(data, "repository_id string, path string, text string"))
    assert rows(corpus.search_text("handle_checkout"), "path", "line", "column") == [("README.md", 1, 32), ("src/checkout.rs", 1, 8), ("tests/checkout_test.rs", 2, 5)]
    assert corpus.restricted(language="rust").search_text("fn [a-z_]+", regex=True).count() == 3
    assert corpus.restricted(repository="r2").search_text("checkout", per_file=1).count() == 1
    with pytest.raises(ValueError):
        corpus.restricted(language="klingon")
    with pytest.raises(ValueError):
        corpus.search_text(" ")
    assert rows(corpus.search_symbol("VALIDATE"), "name", "rank") == [("validate", 4)]
    assert rows(corpus.document_symbols("src/checkout.rs"), "name", "start_line", "end_line") == [("handle_checkout", 1, 4), ("validate", 6, 8)]
    assert rows(corpus.find_references("handle_checkout"), "line", "is_definition") == [(1, False), (1, True), (2, False)]
    assert rows(corpus.go_to_definition("validate"), "file", "start_line") == [("r1:src/checkout.rs", 6)]
    assert rows(corpus.outgoing_calls("handle_checkout"), "callee") == [("render",), ("validate",)]
    assert rows(corpus.incoming_calls("handle_checkout"), "caller") == [("test_checkout",)]
    assert corpus.read_file("src/checkout.rs", 2, 3).collect()[0].content == "    validate(x);\n    render(x);"
    assert rows(corpus.explore("src/checkout.rs", "x", limit=2), "line", "column", "resume") == [(1, 24, False), (2, 14, False), (3, 12, True)]
    ranked = corpus.search_hybrid("checkout handler").collect()
    assert ranked[0].document == "r2:README.md" and {r.document for r in ranked} >= {"r1:src/checkout.rs", "r1:tests/checkout_test.rs"}
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
