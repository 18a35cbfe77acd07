"""Nearest vectors against brute force."""

import random

import numpy as np

from corvane.llm.neighbours import CentroidGraph, IndexSettings, _blocks, fit_centroids, nearest_vectors, prepared, similar_pairs
from pyspark.sql import functions as F

SCHEMA = "vec_id long, model string, embedding array<float>, dimensions int, cosine string"


def brute(vectors, k, least):
    ids = np.array(sorted(vectors))
    unit = np.stack([np.asarray(vectors[i], np.float32).astype(float) for i in ids])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    out = {}
    for r, i in enumerate(ids):
        order = [c for c in np.argsort(-cosine[r], kind="stable") if ids[c] != i and cosine[r, c] >= least][:k]
        out[int(i)] = [int(ids[c]) for c in order]
    return out


def find(spark, data, k=5, least=-1.0, settings=IndexSettings()):
    df = spark.createDataFrame(data, SCHEMA)
    return nearest_vectors(df, F.col("vec_id"), [F.col("model")], F.col("embedding"), F.col("dimensions"), k, least, settings)


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def test_recall_on_random_and_clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    points = np.concatenate([c + 0.25 * rng.normal(size=(40, 24)) for c in centres] + [rng.normal(size=(400, 24))])
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(points)}
    want = brute(vectors, 5, -1.0)
    got = as_lists(find(spark, [(i, "m", v, 24, "x") for i, v in vectors.items()], settings=IndexSettings(list_size=64)))
    hits = sum(len(set(want[i]) & set(got.get(i, []))) for i in want)
    assert hits / sum(map(len, want.values())) > 0.93
    least = brute(vectors, 5, 0.85)
    close = as_lists(find(spark, [(i, "m", v, 24, "x") for i, v in vectors.items()], least=0.85, settings=IndexSettings(list_size=64)))
    assert sum(len(set(least[i]) & set(close.get(i, []))) for i in least) / sum(map(len, least.values())) > 0.97


def test_ties_copies_groups_and_unusable(spark, rows):
    rng = random.Random(2)
    one, two, far = [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    data = [(i, "m", one, 3, "x") for i in range(20, 40)] + [(i, "m", two, 3, "x") for i in (5, 50)] + [(7, "m", far, 3, "x"), (8, None, one, 3, "x"), (9, None, two, 3, "x"), (60, "m", [1.0, 0.0], 2, "x")]
    bad = [(100, "m", None, 3, "x"), (101, "m", one, None, "x"), (102, "m", one, 2, "x"), (103, "m", [0.0] * 3, 3, "x"), (104, "m", [float("nan"), 1.0, 1.0], 3, "x"), (105, "m", [float("inf"), 1.0, 1.0], 3, "x"), (106, "m", [None, 1.0, 1.0], 3, "x"), (107, "m", [], 0, "x"), (None, "m", one, 3, "x")]
    rng.shuffle(data)
    got = as_lists(find(spark, data + bad, least=0.85))
    vectors = {i: v for i, m, v, d, _ in data if m == "m" and d == 3}
    want = {i: n for i, n in brute(vectors, 5, 0.85).items() if n} | {8: [9], 9: [8]}
    assert got == want
    pairs = rows(similar_pairs(find(spark, data, least=0.85)))
    assert pairs == sorted({(min(a, b), max(a, b)) for a, n in want.items() for b in n}, key=repr)
    assert find(spark, []).count() == 0
    assert find(spark, bad).count() == 0
    assert as_lists(find(spark, [(1, "m", [1e30, 1e30], 2, "x"), (2, "m", [1e-30, 1e-30], 2, "x")])) == {1: [2], 2: [1]}


def test_one_direction_of_many_lengths(spark):
    # A fifth of the rows points one way, with lengths of all sizes; none of it but six rows reaches a list.
    rng = np.random.default_rng(4)
    way = rng.normal(size=16)
    centres = rng.normal(size=(50, 16))
    points = [way * rng.uniform(0.1, 40) if i % 5 == 0 else centres[i % 50] + 0.25 * rng.normal(size=16) for i in range(2500)]
    vectors = {i: np.asarray(v, np.float32).tolist() for i, v in enumerate(points)}
    settings = IndexSettings(list_size=64, least_rows=1_000)
    got = as_lists(find(spark, [(i, "m", v, 16, "x") for i, v in vectors.items()], settings=settings))
    want = brute(vectors, 5, -1.0)
    assert all(got[i] == want[i] for i in vectors if i % 5 == 0)
    assert np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in vectors]) > 0.93
    rows = spark.createDataFrame([(i, "m", v, 16, "x") for i, v in vectors.items()], SCHEMA)
    ways = prepared(rows.where("vec_id % 5 = 0"), F.col("vec_id"), [F.col("model")], F.col("embedding"), F.col("dimensions")).select("h1", "h2").distinct().count()
    assert ways <= 16


def test_large_lists_are_cut_and_refined(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([c + 0.3 * rng.normal(size=(50, 12)) for c in rng.normal(size=(24, 12))])
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(points)}
    data, want = [(i, "m", v, 12, "x") for i, v in vectors.items()], brute(vectors, 5, -1.0)
    recall = lambda got: np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in vectors])
    # Blocks compare every holder of a list with every asker, so without centroids the result is exact.
    assert as_lists(find(spark, data, settings=IndexSettings(groups=0, least_rows=100, block=300))) == want
    assert recall(as_lists(find(spark, data, settings=IndexSettings(least_rows=100, list_size=300, block=100)))) > 0.97
    assert recall(as_lists(find(spark, data, settings=IndexSettings(groups=0, inner=200, list_size=64)))) > 0.9


def test_blocks_hold_every_pair_once():
    ids, pieces = np.arange(50, dtype=np.int64), np.array([1, 3, 2])
    cell, role = np.arange(50) % 3, (1 + np.arange(50) % 3).astype(np.int8)
    row, cells, block, part = _blocks(ids, np.arange(50), cell, role, pieces)
    assert len(set(zip(row, cells, block))) == len(row)
    met = [(a, h) for b in set(zip(cells, block)) for a in row[(cells == b[0]) & (block == b[1]) & ((part & 2) > 0)] for h in row[(cells == b[0]) & (block == b[1]) & ((part & 1) > 0)]]
    want = {(a, h) for a in range(50) for h in range(50) if cell[a] == cell[h] and role[a] & 2 and role[h] & 1}
    assert len(met) == len(want) and set(met) == want


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(4000, 16)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    centroids = fit_centroids(data, 300, 1)
    assert 200 <= len(centroids) <= 900
    graph = CentroidGraph(centroids, 16, 1)
    ids, cosines = graph.search(data[:500], 16)
    exact = np.argsort(-(data[:500] @ centroids.T), axis=1)[:, :4]
    assert np.mean([len(set(a[:16]) & set(b)) / 4 for a, b in zip(ids, exact)]) > 0.95
    assert (np.diff(cosines, axis=1) <= 1e-6).all()
    single = CentroidGraph(centroids[:1], 16, 1)
    assert single.search(data[:3], 8)[0].tolist() == [[0]] * 3
