"""The encoder against the library that publishes the vocabulary, and the mixture against its rules."""

import random

import pytest

from corvane.llm.bytepair import BytePairTrie, vocabulary_path
from corvane.llm.encoding import count_tokens, encode_corpus
from corvane.llm.mixing import mix_sources, plan_budgets

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def strange_texts(n):
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "\x1c", "\x85", " ", "​", "1", "22", "'s", "’", "==", "\0", "ſ", "Ⅷ", "\U0001f600", "é", "<|endoftext|>"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(n // 10)]
    return [*out, "a" * 5000, " " * 5000, "=" * 3000, "ab" * 3000, "é" * 2000]


def test_encoder_equals_the_library(reference):
    texts = strange_texts(3000)
    trie = BytePairTrie(vocabulary_path(), remember=100)
    got = [ids for i in range(0, len(texts), 50) for ids in trie.encode_batch(texts[i : i + 50])]
    assert got == reference(texts)


def test_encode_corpus(spark, reference):
    texts = ["one two", "", None, "one two", "x" * 200_000, "   ", "日本語"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "one two", None)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == []
    assert [got[i] for i in (0, 3, 4, 5, 6)] == reference([texts[i] for i in (0, 3, 4, 5, 6)])
    assert got[None] == got[0]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    sizes = {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"], "text").collect()}
    assert sizes == {i: len(ids) for i, ids in got.items()}


def test_plan_budgets():
    plan = {p[0]: p for p in plan_budgets({"a": 100, "b": 1000, "d": 7}, [("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 3)])}
    assert plan["a"][5] == 200 and plan["b"][5] == 100 and plan["c"][5] == 0
    plan = {p[0]: p[5] for p in plan_budgets({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, 1)], total=900)}
    assert plan == {"a": 200, "b": 700}
    assert plan_budgets({}, [("a", 1.0, 1)])[0][5] == 0


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, s, rng.randrange(1, 60)) for s, n in (("big", 4000), ("mid", 600), ("small", 40), ("free", 50)) for i in range(n)]
    docs = [(k, s, t) for k, (_, s, t) in enumerate(docs)] + [(9001, None, 5), (9002, "big", None), (9003, "mid", 0)]
    sized = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, tokens long, copies string")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("none", 0.1, 2), (None, 0.2, 1), ("nul", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(sized, weights, ["doc_id"])
    limits = {"big": 1, "mid": 2, "small": 3}
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.copies <= limits[r.source] for r in rows)
    assert sum(r.copies == 3 for r in rows if r.source == "small") == 40  # the scarcest source is used up
    total = sum(r.tokens * r.copies for r in rows)
    said = {r.source: r for r in report.collect()}
    for source, want in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        got = sum(r.tokens * r.copies for r in rows if r.source == source)
        assert said[source].mixed_tokens == got
        assert abs(got / total - want) < 0.002
        assert said[source].actual_share == pytest.approx(got / total)
    assert {"none", "free", "nul"} < set(said) and said["free"].mixed_tokens == 0 and said["none"].actual_share == 0
    empty, report = mix_sources(sized.limit(0), weights, ["doc_id"])
    assert empty.count() == 0 and {r.source for r in report.collect()} == {"big", "mid", "small", "none", "nul"}
    assert mix_sources(sized, weights.limit(0), ["doc_id"])[0].count() == 0


def test_mixture_of_one_repeated_document(spark):
    sized = spark.createDataFrame([(1, "a", 10)] * 20 + [(2, "b", 10)] * 5, "doc_id long, source string, tokens long")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mix_sources(sized, weights, ["doc_id"])
    assert sum(r.copies for r in chosen.collect() if r.source == "b") == 5
