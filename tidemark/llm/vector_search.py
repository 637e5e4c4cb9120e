"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is halved again and again into clusters of equal size, whose means are
the lists' centroids; so a dense region gets many lists, and lists stay even. A
neighbour graph over the centroids, which is bounded by the sample, lives in each
worker's memory and is searched best-first. A vector goes to the list of its nearest
centroid and, near a boundary, also to others that are hardly farther. A query reads the
lists whose centroids are within a ratio of the nearest one. The ratio is measured: for a
few probes, to which no centroid was fitted, one pass over the table finds the exact
neighbours, and the ratio is the least that finds them with the recall asked for.

Neighbouring lists are compared together, in blocks of bounded size. Beyond the sample's
number of lists, lists grow; a block of one long list is then cut into clusters of its
own, and those that cannot hold a nearer vector, by their radius, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize

SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors, or fewer of ``sample_bytes`` in all, fit lists and ratio; every vector is indexed.

    ``list_rows``: vectors in a list, as far as the sample's size allows (``list_sample`` of it
    for a list). ``replicas``: lists that hold a boundary vector at most, each within
    ``boundary`` times the distance of the nearest. ``recall``: what the ratio is measured
    for, with ``probes`` vectors of the sample's last quarter; the ``least`` nearest lists are
    always read. ``beam`` bounds only the graph's search: a query with more lists
    within the ratio looks through all centroids. ``block_rows`` and ``block_queries`` bound a task.
    """

    sample: int = 16_384
    sample_bytes: int = 32 << 20
    list_rows: int = 100
    list_sample: int = 24
    replicas: int = 3
    boundary: float = 1.05
    recall: float = 0.97
    least: int = 4
    probes: int = 256
    degree: int = 16
    beam: int = 48
    block_rows: int = 6_000
    block_queries: int = 20_000


def usable(v: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of ``lists`` clusters of the rows, of equal size up to rounding: each step halves a cluster along its two centres."""
    rng, todo, out = np.random.default_rng(seed), [(np.arange(len(x)), lists)], []
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            out.append(x[rows].mean(0))
            continue
        own = x[rows]
        a, b = own[rng.choice(len(rows), 2, replace=False)]
        near = len(rows) * (n // 2) // n
        for _ in range(6):
            order = np.argsort(((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1), kind="stable")
            a, b = own[order[:near]].mean(0), own[order[near:]].mean(0)
        todo += [(rows[order[:near]], n // 2), (rows[order[near:]], n - n // 2)]
    return np.array(out)


class CentroidGraph:
    """Centroids with links to their nearest ones and some far ones, searched best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, settings: Settings, seed: int = 3):
        self.c, self.s = centroids, settings
        self.short, self.square = centroids.astype(np.float32), (centroids**2).sum(1).astype(np.float32)
        n, rng = len(centroids), np.random.default_rng(seed)
        near = np.concatenate([np.argsort((self.c**2).sum(1) - 2 * part @ self.c.T, axis=1, kind="stable")[:, : settings.degree + 1] for part in np.array_split(self.c, -(-n // 1000))])
        far = rng.integers(0, n, (n, max(2, settings.degree // 4)))
        self.links = np.concatenate([near, far], 1).astype(np.int32)
        self.entries = np.arange(0, n, max(1, n // 16))[:32]

    def gaps(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each row of ``x`` to its centroids ``at``, without the row's own square."""
        return self.square[at] - 2 * np.einsum("nkd,nd->nk", self.short[at], x)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` nearest centroids that the graph leads to, nearest first, with distances; -1 where there are fewer."""
        n, rows, short = len(x), np.arange(len(x))[:, None], x.astype(np.float32)
        beam = min(beam, len(self.c))
        seen = np.zeros((n, len(self.c)), bool)
        at = np.repeat(self.entries[None], n, 0)
        seen[rows, at] = True
        d, opened = self.gaps(short, at), np.zeros(at.shape, bool)
        while True:
            if at.shape[1] > beam:
                order = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                at, d, opened = at[rows, order], d[rows, order], opened[rows, order]
            waiting = np.where(opened, np.inf, d)
            if not np.isfinite(waiting).any():
                break
            first = np.argsort(waiting, axis=1)[:, :3]  # the nearest few not yet expanded
            real = np.isfinite(waiting[rows, first])
            opened[rows, first] = True
            to = np.sort(self.links[at[rows, first]].reshape(n, -1), axis=1)
            fresh = ~seen[rows, to]
            fresh[:, 1:] &= to[:, 1:] != to[:, :-1]
            if not real.all():
                fresh &= real.any(1)[:, None]
            width = int(fresh.sum(1).max())
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            to, fresh = to[rows, order], fresh[rows, order]
            new = np.nonzero(fresh)
            seen[new[0], to[new]] = True
            at = np.concatenate([at, to], 1)
            d = np.concatenate([d, np.where(fresh, self.gaps(short, to), np.inf)], 1)
            opened = np.concatenate([opened, ~fresh], 1)
        order = np.argsort(d, axis=1, kind="stable")
        at, d = at[rows, order], d[rows, order]
        found = np.isfinite(d)
        true = np.sqrt(((self.c[at] - x[:, None, :]) ** 2).sum(2))
        return np.where(found, at, -1), np.where(found, true, np.inf)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that hold each vector, a row each, nearest first, and which of the row's places count."""
        at, d = self.search(x, 4 * self.s.replicas)
        at, d = at[:, : self.s.replicas], d[:, : self.s.replicas]
        return at, (at >= 0) & (d <= self.s.boundary * d[:, :1])

    def lists_for(self, q: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The lists within ``ratio`` times the distance of the nearest centroid, and the ``least`` nearest."""
        if np.isfinite(ratio):
            at, d = self.search(q, self.s.beam)
            near = (at >= 0) & ((d <= ratio * d[:, :1]) | (np.arange(at.shape[1]) < self.s.least))
            out = [at[k][near[k]] for k in range(len(q))]
            again = np.flatnonzero(near[:, -1]) if at.shape[1] < len(self.c) else np.zeros(0, int)
        else:
            out, again = [np.zeros(0, int)] * len(q), np.arange(len(q))
        for k in again:
            every = np.sqrt(((self.c - q[k]) ** 2).sum(1))
            out[k] = np.flatnonzero(every <= max(ratio * every.min(), np.sort(every)[: self.s.least][-1]))
        return out


def probe_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, dim: int, size: float, k: int) -> list[tuple[int, np.ndarray]]:
    """The exact k nearest vectors of a few probes in the whole table, as ``(probe, scaled vector)``: one pass, of which each task keeps k for each probe."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best, kept = np.full((len(x), k), np.inf), np.zeros((len(x), k, dim))
        for batch in batches:
            v = np.clip(batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(float) / size, -1e150, 1e150)
            d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ v.T + (v**2).sum(1))
            d[ids[:, None] == batch.column(0).to_numpy()[None]] = np.inf
            all_d = np.concatenate([best, d], 1)
            order = np.argpartition(all_d, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(all_d, order, 1)
            kept = np.stack([np.where((o < k)[:, None], kept[i][np.minimum(o, k - 1)], v[np.maximum(o - k, 0)]) for i, o in enumerate(order)])
        probe, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), pa.array(best[probe, place]), pa.array([kept[i, j].tobytes() for i, j in zip(probe, place)], pa.binary())], ["probe", "d", "v"])

    found = rows.select("id", "v").mapInArrow(run, "probe int, d double, v binary")
    first = F.row_number().over(Window.partitionBy("probe").orderBy("d", "v"))
    return [(r["probe"], np.frombuffer(r["v"])) for r in found.withColumn("r", first).where(F.col("r") <= k).select("probe", "v").collect()]


def measured_ratio(x: np.ndarray, neighbours: list[tuple[int, np.ndarray]], graph: CentroidGraph, settings: Settings) -> float:
    """The least ratio with which ``recall`` of the probes' neighbours stand in lists that the probes read; infinite without any."""
    if not neighbours:
        return float("inf")
    homes, held = graph.homes(np.stack([v for _, v in neighbours]))
    to = np.sqrt(np.maximum(0, ((x**2).sum(1)[:, None] - 2 * x @ graph.c.T) + (graph.c**2).sum(1)))
    probe = np.array([p for p, _ in neighbours])
    needed = np.where(held, np.take_along_axis(to[probe], np.maximum(homes, 0), 1), np.inf).min(1)
    return float(np.quantile(needed / np.maximum(to[probe].min(1), 1e-300), settings.recall)) + 1e-6


class Block:
    """Vectors of one task, of several lists or a part of one, against queries that read some of the lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, settings: Settings):
        order = np.lexsort((ids, lists))
        self.ids, self.x, self.lists, self.s = ids[order], x[order], lists[order], settings
        self.scale = max(float(np.abs(self.x).max()), 1e-300)
        self.z = self.x / self.scale
        self.square = (self.z**2).sum(1)
        self.unique, self.place = np.unique(self.ids, return_inverse=True)
        self.by_id = np.argsort(self.place, kind="stable")
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(self.place[self.by_id]) > 0]))
        self.clusters = self.cut() if len(self.x) > 4 * settings.list_rows and self.lists[0] == self.lists[-1] else None

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = balanced_centroids(self.z, len(self.z) // self.s.list_rows)
        own = np.concatenate([(((c**2).sum(1) - 2 * part @ c.T)).argmin(1) for part in np.array_split(self.z, -(-len(self.z) // 1000))])
        radius = np.zeros(len(c))
        np.maximum.at(radius, own, np.sqrt(((self.z - c[own]) ** 2).sum(1)))
        return c, own, radius

    def squares(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ self.z[rows].T + self.square[rows])

    def distances(self, q: np.ndarray, reads: list[set[int]], k: int) -> np.ndarray:
        """Squared distances of scaled queries to the rows they read; infinite to the others."""
        out = np.full((len(q), len(self.x)), np.inf)
        if self.clusters is None:
            names, starts = np.unique(self.lists, return_index=True)
            for name, rows in zip(names.tolist(), np.split(np.arange(len(self.x)), starts[1:])):
                asking = [i for i, r in enumerate(reads) if name in r]
                if asking:
                    out[np.ix_(asking, rows)] = self.squares(q[asking], rows)
            return out
        c, own, radius = self.clusters
        to = np.sqrt(np.maximum(0, ((q**2).sum(1)[:, None] - 2 * q @ c.T) + (c**2).sum(1)))
        least = np.maximum(0, to - radius)
        bound = np.sort(np.where(np.bincount(own, minlength=len(c)) > 0, to + radius, np.inf), axis=1)
        # the k + 1 clusters with the least farthest distance hold k + 1 ids or more if ids do not repeat
        limit = bound[:, min(k, len(c) - 1)] if len(self.unique) == len(self.ids) else np.full(len(q), np.inf)
        for j in range(len(c)):
            rows, asking = np.flatnonzero(own == j), np.flatnonzero(least[:, j] <= limit * (1 + 1e-9) + 1e-9)
            if len(rows) and len(asking):
                out[np.ix_(asking, rows)] = self.squares(q[asking], rows)
        return out

    def nearest(self, asking: np.ndarray, q: np.ndarray, reads: list[set[int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per query its id, and ids and distances of the k nearest other ids read, exact for these; all of the last one's ties."""
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            # the block's scale also fits queries of other sizes: a tolerance of rounding goes with the largest square
            z = part / self.scale
            d = self.distances(z, reads[at : at + 256], k)
            d[asking[at : at + 256, None] == self.ids[None]] = np.inf
            best = np.minimum.reduceat(d[:, self.by_id], self.first, axis=1)
            room = 1e-12 * ((z**2).sum(1) + self.square.max())
            for i in range(len(part)):
                last = np.partition(best[i], k - 1)[k - 1] if best.shape[1] > k else np.inf
                rows = np.flatnonzero(np.isfinite(d[i]) & (best[i][self.place] <= last + room[i]))
                if not np.isfinite(room[i]):
                    rows = np.flatnonzero(~np.isposinf(d[i]) & (self.ids != asking[at + i]))
                if len(rows):
                    yield asking[at + i], self.ids[rows], exact(self.x[rows], part[i])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares leave its range, by scaled differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = x - q
        d = np.sqrt((gap**2).sum(1))
        odd = ~np.isfinite(d) | (d < 1e-150)
        if odd.any():
            most = np.abs(gap[odd]).max(1)
            d[odd] = np.where((most > 0) & np.isfinite(most), most * np.sqrt(((gap[odd] / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)), most)
    return d


def nearest(vectors: DataFrame, queries: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """The ``k`` nearest other vectors found of each row where ``queries`` holds, by Euclidean distance in double precision.

    Returns ``query_id, rank, vec_id, score``; all others if there are fewer than ``k``;
    ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part. Vectors of different dimensions have no distance: each
    dimension is searched by itself. An id that repeats counts once. An empty table gives
    an empty result; other columns are not read.
    """
    v = F.col(vector_col)
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    found = vectors.sparkSession.createDataFrame([], SCHEMA)
    for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # one row, where the table holds one kind of vector
        found = found.unionByName(_of_dimension(rows.where(F.size("v") == r["dim"]), r["dim"], r["count"], k, settings))
    return found


def _of_dimension(rows: DataFrame, dim: int, n: int, k: int, settings: Settings) -> DataFrame:
    spark = rows.sparkSession
    kind = np.dtype("<f4") if rows.schema["v"].dataType.elementType == T.FloatType() else np.dtype("<f8")
    rows = rows.withColumn("v", F.col("v").cast("array<float>" if kind.itemsize == 4 else "array<double>"))
    sample = min(settings.sample, max(64, settings.sample_bytes // (8 * dim)))
    order = F.xxhash64("id", F.lit("vector sample"))
    some = rows.where((order.cast("double") / F.lit(2.0**64) + 0.5) * n < 1.2 * sample + 50).select(order.alias("o"), "id", "v").orderBy("o", "id").limit(sample)
    some = some.collect()
    x = np.array([r["v"] for r in some], float).reshape(-1, dim)
    size = max(float(np.abs(x).max(initial=0)), 1e-300)  # lists are found among scaled vectors, so that squares stay in range
    x = x / size
    fitted = x[: max(1, len(x) * 3 // 4)]
    lists = max(1, min(n // settings.list_rows, len(fitted) // settings.list_sample))
    centroids = CentroidGraph(balanced_centroids(fitted, lists), settings)
    probes = slice(len(x) * 3 // 4, len(x) * 3 // 4 + settings.probes)
    near = probe_neighbours(rows, np.array([r["id"] for r in some[probes]]), x[probes], dim, size, k)
    ratio = measured_ratio(x[probes], near, centroids, settings)
    graph = spark.sparkContext.broadcast(centroids)
    together = max(1, int(settings.block_rows // (settings.replicas * max(settings.list_rows, n / lists))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = graph.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, asks = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                scaled = np.clip(x.astype(float) / size, -1e150, 1e150)
                homes, held = own.homes(scaled)
                at, place = np.nonzero(held)
                found = list(zip(at.tolist(), homes[at, place].tolist(), [None] * len(at)))
                asking = np.flatnonzero(asks)
                if len(asking):
                    for i, cs in zip(asking.tolist(), own.lists_for(scaled[asking], ratio)):
                        for g in np.unique(cs // together).tolist():
                            found.append((i, g * together, cs[cs // together == g].astype(np.int32).tobytes()))
                at = np.array([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array([x[i].astype(kind).tobytes() for i in at], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())],
                    ["id", "v", "list", "reads"],
                )

    placed = materialize(rows.mapInArrow(place, "id long, v binary, list int, reads binary").withColumn("part", F.floor(F.col("list") / together).cast("int")), "posting-lists")
    asks = F.col("reads").isNotNull()
    sizes = placed.groupBy("part").agg(F.count_if(~asks).alias("n"), F.count_if(asks).alias("q"))
    sizes = sizes.select("part", F.ceil(F.col("n") / settings.block_rows).cast("int").alias("blocks"), F.ceil(F.col("q") / settings.block_queries).cast("int").alias("turns"))
    placed = placed.join(F.broadcast(sizes), "part").where("blocks > 0 and turns > 0")  # one row per part, fewer than lists, which the sample bounds
    own_block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posts = placed.where(~asks).select("part", own_block(F.col("blocks")).alias("block"), every("turns").alias("turn"), "id", "v", "list")
    asked = placed.where(asks).select(F.col("part").alias("q_part"), every("blocks").alias("q_block"), own_block(F.col("turns")).alias("q_turn"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), "reads")
    vectors_of = lambda column: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(float)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            block = Block(left["id"].to_numpy(), vectors_of(left["v"]), left["list"].to_numpy(), settings)
            reads = [set(np.frombuffer(r, np.int32).tolist()) for r in right["reads"].to_pylist()]
            for q, ids, d in block.nearest(right["q_id"].to_numpy(), vectors_of(right["q_v"]), reads, k):
                best = np.lexsort((ids, d))
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])[:k]]
                out.append((np.full(len(best), q), ids[best], d[best]))
        cols = [np.concatenate([o[i] for o in out]) if out else [] for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    met = posts.groupBy("part", "block", "turn").cogroup(asked.groupBy("q_part", "q_block", "q_turn")).applyInArrow(compare, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
