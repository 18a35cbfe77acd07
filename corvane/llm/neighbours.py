"""Most similar vectors for every vector, by balanced posting lists.

A bounded sample is clustered into many small balanced cells whose centroids stay in memory, joined
into a neighbour graph. Every vector goes into the list of its nearest centroid and, near a border,
into those of further cells too. A search walks the graph to the nearest centroids and reads only
lists whose centroids are nearly as near as the nearest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise, measured


@dataclass(frozen=True)
class IndexSettings:
    """Bounds of the index.

    At most `sample` rows of a group (model and dimensions), and `total_sample` rows of all, are taken to the driver
    to fit centroids, for the `groups` largest groups of more than `least_rows` rows; any other group is one list. A
    group has a list for every `list_size` rows, up to a quarter of its sample (25 000 lists). Lists of
    more than `block` rows are searched in blocks of holders and askers, each a task of its own; of more than `inner` holders
    in a block lists are made anew within it, so that the number of lists grows with the data.
    """

    sample: int = 100_000
    total_sample: int = 400_000
    groups: int = 4_000
    least_rows: int = 2_048
    list_size: int = 128
    block: int = 32_768
    inner: int = 8_192
    copies: int = 4
    copy_ratio: float = 1.15
    probes: int = 6
    probe_ratio: float = 1.3
    degree: int = 24
    beam: int = 24
    seed: int = 11


def _split(data: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of a few rounds of spherical k-means with a penalty on large cells, which keeps them balanced."""
    centres = data[rng.choice(len(data), parts, replace=False)]
    fair, weight = len(data) / parts, np.zeros(parts, np.float32)
    labels = np.zeros(len(data), np.int64)
    for _ in range(6):
        labels = np.argmax(data @ centres.T - weight, axis=1)
        counts = np.bincount(labels, minlength=parts)
        weight = (0.02 * np.maximum(0, counts / fair - 2)).astype(np.float32)
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, data)
        lone = counts == 0
        if lone.any():
            sums[lone] = data[rng.choice(len(data), int(lone.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return labels


def fit_centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """About `lists` unit centroids of unit vectors, by splitting the largest cells again and again."""
    sample = np.unique(sample.astype(np.float32), axis=0)
    rng = np.random.default_rng(seed)
    most = max(1, math.ceil(len(sample) / max(1, lists)))
    open_, done = [np.arange(len(sample))], []
    while open_:
        cell = open_.pop()
        parts = min(16, len(cell), math.ceil(len(cell) / most))
        if parts < 2:
            done.append(cell)
            continue
        labels = _split(sample[cell], parts, rng)
        pieces = [cell[labels == p] for p in np.unique(labels)]
        if len(pieces) == 1:
            done.append(cell)
        else:
            open_ += pieces
    centres = np.stack([sample[c].mean(axis=0) for c in done])
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class CentroidGraph:
    """Centroids joined to their nearest ones in both directions, searched from a few hubs."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int) -> None:
        self.centroids = centroids
        n = len(centroids)
        degree = min(degree, n - 1)
        near = np.empty((n, degree), np.int32)
        for at in range(0, n, 1024):
            close = centroids[at : at + 1024] @ centroids.T
            close[np.arange(len(close)), np.arange(at, at + len(close))] = -2
            near[at : at + 1024] = np.argpartition(-close, degree - 1, axis=1)[:, :degree] if degree else near[at : at + 1024]
        # A link back from each neighbour keeps every centroid within reach; rows are padded with themselves.
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near):
            for j in row[: max(1, degree // 3)]:
                if len(back[j]) < degree // 2 + 1:
                    back[j].append(i)
        wide = degree + max((len(b) for b in back), default=0)
        self.links = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, max(1, wide)))
        self.links[:, :degree] = near
        for i, b in enumerate(back):
            self.links[i, degree : degree + len(b)] = b
        hubs = min(n, max(16, 2 * math.isqrt(n)))
        self.hubs = np.sort(np.random.default_rng(seed).choice(n, hubs, replace=False)).astype(np.int32)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of the `beam` nearest found for each query, the nearest first."""
        n = len(self.centroids)
        beam = min(beam, n)
        ids, cosines = np.empty((len(queries), beam), np.int32), np.empty((len(queries), beam), np.float32)
        for at in range(0, len(queries), 512):
            ids[at : at + 512], cosines[at : at + 512] = self._search(queries[at : at + 512], beam)
        return ids, cosines

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))[:, None]
        hub = q @ self.centroids[self.hubs].T
        first = min(beam, hub.shape[1])
        top = np.argpartition(-hub, first - 1, axis=1)[:, :first]
        ids, cosines = self.hubs[top], hub[rows, top]
        seen = np.zeros((len(q), len(self.centroids)), bool)
        seen[rows, ids] = True
        opened = np.zeros(ids.shape, bool)
        alive = np.arange(len(q))
        while len(alive):
            # Open the four nearest unopened of each beam at once.
            score = np.where(opened[alive], -9, cosines[alive])
            width = min(4, score.shape[1])
            pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
            useful = np.take_along_axis(score, pick, 1) > -9
            keep = useful.any(axis=1)
            alive, pick, useful = alive[keep], pick[keep], useful[keep]
            if not len(alive):
                break
            opened[alive[:, None], pick] = True
            nxt = self.links[ids[alive[:, None], pick]].reshape(len(alive), -1)
            fresh = ~seen[alive[:, None], nxt] & np.repeat(useful, self.links.shape[1], axis=1)
            order = np.sort(np.where(fresh, nxt, -1), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            who, col = np.nonzero(order >= 0)
            if not len(who):
                continue
            new = order[who, col]
            seen[alive[who], new] = True
            value = np.einsum("ij,ij->i", q[alive[who]], self.centroids[new])
            # Pack each query's new centroids to the left and keep the best of them and the beam.
            counts = np.bincount(who, minlength=len(alive))
            place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
            more_ids, more = np.zeros((len(alive), counts.max()), np.int32), np.full((len(alive), counts.max()), -8, np.float32)
            more_ids[who, place], more[who, place] = new, value
            all_ids = np.concatenate([ids[alive], more_ids], axis=1)
            all_cos = np.concatenate([cosines[alive], more], axis=1)
            all_open = np.concatenate([opened[alive], more <= -8], axis=1)
            if all_ids.shape[1] > beam:
                best = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
                all_ids, all_cos, all_open = (np.take_along_axis(x, best, 1) for x in (all_ids, all_cos, all_open))
            if all_ids.shape[1] != ids.shape[1]:
                grow = all_ids.shape[1] - ids.shape[1]
                ids, cosines, opened = np.pad(ids, ((0, 0), (0, grow))), np.pad(cosines, ((0, 0), (0, grow)), constant_values=-8), np.pad(opened, ((0, 0), (0, grow)), constant_values=True)
            ids[alive], cosines[alive], opened[alive] = all_ids, all_cos, all_open
        if ids.shape[1] < beam:
            grow = beam - ids.shape[1]
            ids, cosines = np.pad(ids, ((0, 0), (0, grow))), np.pad(cosines, ((0, 0), (0, grow)), constant_values=-8)
        order = np.argsort(-cosines, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that squares neither overflow nor vanish."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of 32-bit floats of equal length, kept as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def _assign(vectors: np.ndarray, graph: CentroidGraph, s: IndexSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, role) of the lists each vector lies in (role 1), looks into (2) or both (3)."""
    near, cosines = graph.search(_unit(vectors).astype(np.float32), max(s.beam, s.copies, s.probes))
    reach = np.sqrt(np.maximum(0, 2 - 2 * cosines)) + 1e-6
    rank = np.arange(near.shape[1])[None, :]
    real = cosines > -8
    lies = real & ((rank == 0) | ((rank < s.copies) & (reach <= s.copy_ratio * reach[:, :1])))
    looks = real & ((rank == 0) | ((rank < s.probes) & (reach <= s.probe_ratio * reach[:, :1])))
    row, col = np.nonzero(lies | looks)
    return row, near[row, col], (lies[row, col] + 2 * looks[row, col]).astype(np.int8)


def _best(ids: np.ndarray, vectors: np.ndarray, asks: np.ndarray, holds: np.ndarray, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each asking row of one list: its k best holders, itself among them: (id, ids, rounded cosines)."""
    unit = _unit(vectors)
    order = np.flatnonzero(holds)
    order = order[np.argsort(ids[order], kind="stable")]
    members, member_ids = unit[order], ids[order]
    asking = np.flatnonzero(asks)
    block = max(1, 4_000_000 // max(1, len(order)))
    for at in range(0, len(asking), block):
        some = asking[at : at + block]
        cosine = np.round(unit[some] @ members.T, 6)
        width = min(k, len(order))
        # One whole number orders by cosine and then by the smaller id.
        key = np.rint(cosine * 1e6).astype(np.int64) * len(order) - np.arange(len(order))
        top = np.argpartition(-key, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        got = np.take_along_axis(cosine, top, 1)
        for i, row in enumerate(some):
            good = got[i] >= least
            yield ids[row], member_ids[top[i][good]], got[i][good]


def _search_list(ids: np.ndarray, vectors: np.ndarray, role: np.ndarray, k: int, least: float, s: IndexSettings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What `_best` gives of one list; a large one gets lists of its own first, so an asker may come several times."""
    asks, holds = (role & 2) > 0, (role & 1) > 0
    if not asks.any() or not holds.any():
        return
    if holds.sum() <= s.inner:
        yield from _best(ids, vectors, asks, holds, k, least)
        return
    rng = np.random.default_rng(s.seed)
    held = np.flatnonzero(holds)
    sample = vectors[np.sort(rng.choice(held, min(len(held), s.sample), replace=False))]
    graph = CentroidGraph(fit_centroids(_unit(sample).astype(np.float32), len(held) // s.list_size, s.seed), s.degree, s.seed)
    row, cell, inner = _assign(vectors, graph, s)
    inner &= role[row]
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        some = row[part]
        if (inner[part] & 1).any() and (inner[part] & 2).any():
            yield from _best(ids[some], vectors[some], (inner[part] & 2) > 0, (inner[part] & 1) > 0, k, least)


def _blocks(ids: np.ndarray, row: np.ndarray, cell: np.ndarray, role: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, cell, block, role): a list of p pieces has p * p blocks; holders go to a row of them, askers to a column."""
    p = pieces[cell]
    if (p == 1).all():
        return row, cell, np.zeros(len(row), np.int32), role
    mixed = ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mine = ((mixed >> np.uint64(33)) % p.astype(np.uint64)).astype(np.int64)
    out: dict[str, list] = {"at": [], "block": [], "role": []}
    for bit in (1, 2):
        at = np.repeat(np.flatnonzero(role & bit), p[(role & bit) > 0])
        each = np.arange(len(at)) - np.repeat(np.cumsum(p[(role & bit) > 0]) - p[(role & bit) > 0], p[(role & bit) > 0])
        out["at"].append(at)
        out["block"].append(mine[at] * p[at] + each if bit == 1 else each * p[at] + mine[at])
        out["role"].append(np.full(len(at), bit, np.int8))
    at, block, kind = (np.concatenate(out[c]) for c in ("at", "block", "role"))
    # Where a vector holds and asks in the same block it is sent once.
    order = np.lexsort((block, at))
    at, block, kind = at[order], block[order], kind[order]
    fresh = np.r_[True, (np.diff(at) != 0) | (np.diff(block) != 0)]
    return row[at[fresh]], cell[at[fresh]], block[fresh].astype(np.int32), np.add.reduceat(kind, np.flatnonzero(fresh)).astype(np.int8)


def directions(unit: np.ndarray) -> np.ndarray:
    """Unit vectors in millionths: whole numbers that vectors of one direction share, whatever their lengths."""
    return np.rint(unit * 1e6).astype(np.int32)


def prepared(df: DataFrame, vec_id: Column, group: list[Column], embedding: Column, dimensions: Column) -> DataFrame:
    """The usable vectors: id, grp and g (their group and its hash), v (32-bit floats as bytes), h1, h2 (128 bits of hash of group and direction).

    A vector is usable if it has exactly `dimensions` elements, all finite as 32-bit floats and not all zero. Rows without id are left out.
    """
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\0")) for c in group], dimensions.cast("string"))
    rows = df.select(vec_id.cast("long").alias("id"), key.alias("grp"), F.xxhash64(key).alias("g"), embedding.cast("array<float>").alias("v"), dimensions.cast("int").alias("d"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lengths, wanted = batch.column(3).value_lengths().to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                where = np.flatnonzero((lengths == d) & (wanted == d))
                if not len(where) or d < 1:
                    continue
                vectors = _matrix(batch.column(3).take(pa.array(where))).astype(np.float32)
                good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
                where, vectors = where[good], vectors[good]
                if not len(where):
                    continue
                part = batch.take(pa.array(where))
                way, seeds = directions(_unit(vectors)), part.column(2).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
                hashes = [np.array([xxhash.xxh64_intdigest(row, (seed + n) & 0xFFFFFFFFFFFFFFFF) for row, seed in zip(way, seeds)], np.uint64).view(np.int64) for n in (1, 2)]
                width = int(d) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(np.arange(0, (len(where) + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(vectors.astype("<f4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), packed, *map(pa.array, hashes)], names=["id", "grp", "g", "v", "h1", "h2"])

    fit = F.col("v").isNotNull() & F.col("d").isNotNull() & F.col("id").isNotNull() & (F.size("v") == F.col("d"))
    return rows.where(fit).mapInArrow(run, "id long, grp string, g long, v binary, h1 long, h2 long")


def nearest_vectors(df: DataFrame, vec_id: Column, group: list[Column], embedding: Column, dimensions: Column, k: int = 5, min_cosine: float = -1.0, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """The k most similar vectors of every usable vector: vec_id, neighbour_id, cosine, rank from 1.

    Compared are vectors of the same `group` and dimensions; cosines are rounded to 6 decimals, those
    below `min_cosine` are left out and on equal cosine the smaller id comes first. Unusable vectors
    (see `prepared`), and rows without id, are left out. All
    vectors are indexed and all are searched; the bounded sample of `settings` serves
    only to place the centroids. The result is approximate: a neighbour is missed when
    it shares no list with the vector.

    Of vectors of one direction (equal at length one to a millionth in every element, so that their cosines are 1) the
    k + 1 smallest ids go into the lists, and the neighbours of the others are those of these. So a
    group of copies of any size costs no more than k + 1 rows in a list. Others see the direction
    by these k + 1, which may differ from the rest in the last decimal of a cosine.
    """
    spark, s = df.sparkSession, settings
    # Written once; the steps below read only the columns they need.
    good = materialise(prepared(df, vec_id, group, embedding, dimensions))

    # Only the k + 2 smallest ids of each direction are shuffled: the rank filter is applied before the exchange too.
    by_copy = Window.partitionBy("h1", "h2").orderBy("id")
    least = good.select("h1", "h2", "id").withColumn("rn", F.row_number().over(by_copy)).where(f"rn <= {k + 2}")
    copies = least.groupBy("h1", "h2").agg(F.max("rn").alias("n"), F.min("id").alias("first"), F.max(F.when(F.col("rn") <= k + 1, F.col("id"))).alias("last"))
    many = materialise(copies.where(f"n > {k + 1}").drop("n"))
    folded = measured(many).rows > 0
    marked = lookup_join(good, many, ["h1", "h2"], "left", salt_on=["id"]) if folded else None
    kept = (marked.where("last is null or id <= last") if folded else good).select("id", "grp", "g", "v")

    counts = materialise(good.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r.grp: r.n for r in counts.where(F.col("n") > s.least_rows).orderBy(F.col("n").desc(), "grp").limit(s.groups).collect()}
    index = _fit(good, sizes, s)
    shared = spark.sparkContext.broadcast(index)
    # Groups without centroids are one list each; only if there are too many groups may such a list need blocks.
    rest = counts.where(F.col("n") > s.block)
    if rest.count() > sum(n > s.block for n in sizes.values()):
        kept = lookup_join(kept, rest, ["grp"], "left", salt_on=["id"]).select("id", "grp", "g", "v", "n")
    else:
        kept = kept.withColumn("n", F.lit(None).cast("long"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(names.tolist()):
                where = np.flatnonzero(names == name)
                vectors, ids = _floats(batch.column(3).take(pa.array(where))), all_ids[where]
                if name in known:
                    graph, pieces = known[name]
                    row, cell, role = _assign(vectors, graph, s)
                else:
                    row, cell, role = np.arange(len(ids)), np.zeros(len(ids), np.int32), np.full(len(ids), 3, np.int8)
                    pieces = np.array([-(-(batch.column(4)[int(where[0])].as_py() or 1) // s.block)])
                row, cell, block, role = _blocks(ids, row, cell, role, pieces)
                width = vectors.shape[1] * 4
                buffer = pa.py_buffer(vectors.astype("<f4")[row].tobytes())
                offsets = pa.py_buffer(np.arange(0, (len(row) + 1) * width, width, dtype=np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, buffer])
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(where[row])), pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(role, pa.int8()), pa.array(ids[row]), packed], names=["g", "cell", "block", "role", "id", "v"])

    placed = kept.mapInArrow(place, "g long, cell int, block int, role tinyint, id long, v binary")

    def search(table: pa.Table) -> pa.Table:
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        found = list(_search_list(ids, _floats(table.column("v")), role, k + 1, min_cosine, s))
        lists = pa.list_(pa.struct([("off", pa.int32()), ("id", pa.int64())]))
        near = [[{"off": int(o), "id": int(i)} for o, i in zip(np.rint(-c * 1e6), n)] for _, n, c in found]
        return pa.table({"id": pa.array([int(f[0]) for f in found], pa.int64()), "near": pa.array(near, lists)})

    partial = placed.groupBy("g", "cell", "block").applyInArrow(search, "id long, near array<struct<off:int,id:bigint>>")
    # A vector looked into few lists, so what is gathered here is bounded by probes times blocks times k + 1.
    merged = partial.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))
    if folded:
        merged = materialise(merged)
        of_first = lookup_join(merged, many.select(F.col("first").alias("id")), ["id"], "left_semi", salt_on=["near"]).withColumnRenamed("id", "first")
        of_copies = lookup_join(marked.where("id > last").select("id", "first"), of_first, ["first"], salt_on=["id"])
        merged = merged.unionByName(of_copies.select("id", "near"))
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return merged.select("id", F.posexplode(own).alias("pos", "n")).select(F.col("id").alias("vec_id"), F.col("n.id").alias("neighbour_id"), (F.col("n.off") / -1e6).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def _fit(good: DataFrame, sizes: dict[str, int], s: IndexSettings) -> dict[str, tuple[CentroidGraph, np.ndarray]]:
    """For each group a centroid graph and the pieces each list is cut into, of a sample chosen by hash and bounded as IndexSettings says."""
    if not sizes:
        return {}
    most = max(1, min(s.sample, s.total_sample // len(sizes)))
    shares = good.sparkSession.createDataFrame([(name, min(1.0, 0.9 * most / n)) for name, n in sizes.items()], "grp string, share double")
    chosen = good.join(F.broadcast(shares), "grp").where((F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(1_000_000)) / 1e6) < F.col("share"))
    table = chosen.select("grp", "v").toArrow()
    names = np.array(table.column("grp").to_pylist(), dtype=object)
    out = {}
    for name, n in sizes.items():
        where = np.flatnonzero(names == name)[:most]
        if not len(where):
            continue  # one list
        sample = _floats(table.column("v").take(pa.array(where)))
        lists = min(max(1, len(sample) // 4), max(1, round(n / s.list_size)))
        graph = CentroidGraph(fit_centroids(_unit(sample).astype(np.float32), lists, s.seed), s.degree, s.seed)
        pieces = np.ones(len(graph.centroids), np.int64)
        if n > s.block // 4:
            # Rows of a list, told by some of the sample and by the mean.
            some = sample[np.random.default_rng(s.seed).permutation(len(sample))[:10_000]]
            row, cell, _ = _assign(some, graph, s)
            rows = n / len(some) * np.maximum(np.bincount(cell, minlength=len(pieces)), len(row) / len(pieces))
            pieces = np.maximum(1, np.ceil(rows / s.block)).astype(np.int64)
        out[name] = graph, pieces
    return out


def similar_pairs(nearest: DataFrame) -> DataFrame:
    """Distinct pairs vec_id_a < vec_id_b of which at least one is a neighbour of the other."""
    pair = F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")
    return nearest.select(*pair).distinct()
