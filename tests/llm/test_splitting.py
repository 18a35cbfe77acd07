"""Splitting against its rules: whole again, within limits, no cut character, natural ends."""

import random

import pytest

from corvane.llm.splitting import kind_of, split_bytes, split_items
from pyspark.sql import functions as F


def check(data, kind, limit, overlap):
    pieces = split_bytes(data, kind, limit, overlap)
    assert b"".join(data[own:end] for _, own, end in pieces) == data
    for i, (start, own, end) in enumerate(pieces):
        assert end - start <= limit and 0 <= own - start <= overlap
        assert end > own or not data
        data[start:end].decode()
        data[own:end].decode()
        if i:
            assert own == pieces[i - 1][2]
    return pieces


@pytest.mark.parametrize("kind", ["prose", "code", "settings"])
def test_any_text_keeps_the_rules(kind):
    rng = random.Random(4)
    parts = ["a", "é", "日", "\U0001f600", "\n", "\r\n", " ", "é", "‍", "```\n", "\n\n# x\n", "word. ", "}\n", "\n\nfn f() {\n"]
    for _ in range(1500):
        data = "".join(rng.choice(parts) for _ in range(rng.randrange(400))).encode()
        for limit, overlap in ((64, 16), (100, 0), (33, 8)):
            check(data, kind, limit, overlap)
    for text in ("", "x" * 4096, "x" * 4097, "日" * 5000, "\n" * 9000, " " * 9000, "é" * 4000):
        pieces = check(text.encode(), kind, 4096, 256)
        if len(text.encode()) > 4096:
            assert len(pieces) == 1 + -(-(len(text.encode()) - 4096) // 3840)


def test_ends_lie_at_natural_boundaries():
    functions = "\n\n".join(f"fn f{i}() {{\n    let a = {i};\n\n    a + 1;\n}}" for i in range(400)).encode()
    for start, own, end in check(functions, "code", 4096, 256)[:-1]:
        assert functions[end : end + 3] == b"fn "
    text = "\n\n".join("A sentence of some length stands here. " * 9 for _ in range(60)).encode()
    for _, _, end in check(text, "prose", 4096, 256)[:-1]:
        assert text[end - 2 : end] == b"\n\n"
    fenced = ("Some words. " * 150 + "\n```\n" + "x = 1\n\n" * 120 + "```\n\n" + "More words. " * 200 + "\n\nEnd.").encode()
    for _, _, end in check(fenced, "prose", 4096, 256)[:-1]:
        assert fenced[:end].count(b"```") % 2 == 0
    assert [kind_of(p) for p in ("a/b.MD", "x\\LICENSE", "a.toml", "a.rs", None, ".env")] == ["prose", "prose", "settings", "code", "prose", "settings"]
    with pytest.raises(ValueError):
        split_bytes(b"x" * 100, "code", 64, 32)


def test_split_items(spark, rows):
    long, other = "line of text\n" * 600, "日本語。" * 900
    data = [("a", "p.md", long, "x"), ("a", "p.md", long, "x"), ("a", "a.rs", other, "x"), ("b", None, other, "x"), ("c", "c.py", None, "x"), ("d", "d.py", "", "x"), ("e", "e", "x" * 4096, "x"), (None, "f", long, "x")]
    df = spark.createDataFrame(data, "id string, path string, text string, piece string")
    out = split_items(df, F.col("id"), F.col("path"), F.col("text"))
    texts = {"a": other.encode(), "b": other.encode()}
    got = sorted(out.collect())
    assert {r.item for r in got} == {"a", "b"}
    for item, data in texts.items():
        mine = [r for r in got if r.item == item]
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert b"".join(data[r.own : r.end] for r in mine) == data
        assert all(r.text.encode() == data[r.start : r.end] for r in mine)
    assert split_items(df.limit(0), F.col("id"), F.col("path"), F.col("text"), with_text=False).count() == 0
