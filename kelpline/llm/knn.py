"""Most similar vectors for every vector: balanced posting lists under an in-memory centroid graph.

* Points are reduced to distinct vectors; equal vectors share one representative that carries its at most
  ``k + 1`` smallest ids, which is all that any list of neighbours can need of them.
* Centroids are trained by spherical k-means on a bounded sample (at most ``SAMPLE`` vectors), in two levels
  where there are many, and linked to a neighbour graph.  Their number grows with the points, up to
  ``MAX_CENTROIDS``; every executor searches the graph in memory.
* Every vector joins the posting list of its nearest centroid and, near a boundary, those of further
  centroids (at most ``REPLICAS``) whose distance is within ``BOUNDARY`` of the nearest.
* A query visits its ``LEAST_PROBES`` nearest lists and those whose centroid distance is within ``RATIO`` of
  its nearest (at most ``PROBES``).
* Neighbouring lists share a *shelf* of about ``SHELF`` lists.  A query's vector is sent once to each shelf,
  with the lists it visits there, and only its best neighbours come back from it.
* Shelves are balanced: one with more than ``SHELF_ROWS`` members is split into salted parts and its queries
  into as many blocks; every block meets every part, so no task holds an unbounded list, nor all its
  queries, and no member is dropped.

Up to ``MAX_CENTROIDS * LIST_SIZE / 4`` vectors (8 million) lists keep their length, so work and shuffle grow
with the number of vectors; beyond that lists grow, and a greater ``MAX_CENTROIDS`` is needed.

Stated loss: with the defaults recall@5 against brute force is at least 0.9 (measured figures are in the
README).  Similarities of found neighbours are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import salted_join
from ..session import materialize

K = 5
SAMPLE = 524_288
MAX_CENTROIDS = 65_536
#: sampled vectors per centroid, and the least sample
PER_CENTROID, LEAST_SAMPLE = 8, 20_000
#: centroids that one level of k-means may train
ONE_LEVEL = 1024
LIST_SIZE = 512
SHELF, SHELF_ROWS = 16, 16_384
REPLICAS = 3
BOUNDARY = 1.08
PROBES = 48
RATIO = 1.5
#: lists that a query visits in any case: a vector that is nearly a centroid would else see its own list only
LEAST_PROBES = 8
#: neighbours of a centroid in the graph, and how many candidates the search keeps
DEGREE, BEAM = 24, 48
#: up to so many centroids a product with all of them is cheaper than gathering those that a walk visits
DENSE = 4096


def usable(points: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, vector)`` once per id, without null, zero or non-finite vectors.  Of rows with one id and
    different vectors the greatest vector counts."""
    v = F.col("vector")
    return (
        points.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        .where(F.col("id").isNotNull() & v.isNotNull())
        .where(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .groupBy("id")
        .agg(F.max("vector").alias("vector"))
    )


def representatives(vectors: DataFrame, k: int = K) -> DataFrame:
    """``(rep, ids, vector)``: one row per distinct vector with its ``k + 1`` smallest ids.

    The ids are taken in two steps (within salted parts, then over the parts), so that a vector shared by
    a third of all points is never collected whole.
    """
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    w = Window.partitionBy("vector", "salt").orderBy("id")
    part = salted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    return part.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")


def kmeans(x: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty clusters are re-seeded from the largest."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        for a in range(0, len(x), 8192):
            best[a : a + 8192] = np.argmax(x[a : a + 8192] @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        count = np.bincount(best, minlength=n)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return c.astype(np.float32)


def centroids_of(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` centroids; many are trained within the cells of a coarse k-means, in proportion to their members."""
    if n <= ONE_LEVEL:
        return kmeans(x, n, seed=seed)
    coarse = kmeans(x, math.isqrt(n), rounds=6, seed=seed)
    cell = np.concatenate([np.argmax(x[a : a + 8192] @ coarse.T, axis=1) for a in range(0, len(x), 8192)])
    size = np.bincount(cell, minlength=len(coarse))
    share = np.minimum(size, np.maximum(size > 0, np.round(n * size / len(x)).astype(np.int64)))
    return np.concatenate([kmeans(x[cell == j], int(m), rounds=6, seed=seed) for j, m in enumerate(share) if m])


class CentroidGraph:
    """Neighbour graph over unit centroids with a batched beam search from pivots."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        self.graph = np.zeros((n, max(degree, 1)), np.int32)
        for a in range(0, n, 2048):
            sim = centroids[a : a + 2048] @ centroids.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
            if degree:
                self.graph[a : a + 2048] = np.argpartition(-sim, degree - 1, axis=1)[:, :degree]
        rng = np.random.default_rng(3)
        self.pivots = np.sort(rng.choice(n, min(n, max(64, 4 * math.isqrt(n))), replace=False))

    def _search_dense(self, q: np.ndarray, want: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The same walk where one product gives all similarities for less than gathering the visited centroids."""
        full = q @ self.c.T
        rows = np.arange(len(q))[:, None]
        seen = np.zeros(full.shape, bool)
        seen[:, self.pivots] = True
        half = max(1, beam // 2)
        score = np.where(seen, full, np.float32(-2))
        for _ in range(6):
            lead = np.argpartition(-score, half - 1, axis=1)[:, :half]
            seen[rows, self.graph[lead].reshape(len(q), -1)] = True
            new = np.where(seen, full, np.float32(-2))
            done = np.array_equal(new, score)
            score = new
            if done:
                break
        top = np.argpartition(-score, want - 1, axis=1)[:, :want] if want < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        sim = np.take_along_axis(score, top, 1)
        order = np.lexsort((top, -sim), axis=1)
        return np.take_along_axis(top, order, 1), np.take_along_axis(sim, order, 1)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and similarities of about the ``want`` nearest centroids of each row, best first."""
        n = len(self.c)
        beam = min(n, max(BEAM, want))
        if n <= DENSE:
            return self._search_dense(q, want, beam)
        sim = q @ self.c[self.pivots].T
        top = min(beam, sim.shape[1])
        part = np.argpartition(-sim, top - 1, axis=1)[:, :top]
        cand, score = self.pivots[part], np.take_along_axis(sim, part, 1)
        rows = np.arange(len(q))[:, None]
        for _ in range(6):
            lead = np.take_along_axis(cand, np.argsort(-score, axis=1)[:, : beam // 2], 1)
            fresh = self.graph[lead].reshape(len(q), -1)
            seen = np.zeros((len(q), n), bool)
            seen[rows, cand] = True
            new = ~seen[rows, fresh]
            s = np.where(new, np.einsum("qd,qkd->qk", q, self.c[fresh]), -2.0)
            # repeats get the score -2: of equal ids, which are adjacent once sorted, the first one counts
            both, all_s = np.concatenate([cand, fresh], 1), np.concatenate([score, s], 1)
            order = np.lexsort((-all_s, both), axis=1)
            both, all_s = np.take_along_axis(both, order, 1), np.take_along_axis(all_s, order, 1)
            all_s[:, 1:] = np.where(both[:, 1:] == both[:, :-1], -2.0, all_s[:, 1:])
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            nc, ns = np.take_along_axis(both, keep, 1), np.take_along_axis(all_s, keep, 1)
            done = np.array_equal(np.sort(nc, 1), np.sort(cand, 1)) if nc.shape == cand.shape else False
            cand, score = nc, ns
            if done:
                break
        order = np.argsort(-score, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.ListArray) -> np.ndarray:
    dim = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def fit(reps: DataFrame, n: int, list_size: int = LIST_SIZE) -> np.ndarray:
    """Centroids from at most ``SAMPLE`` vectors, chosen by hash."""
    want = min(MAX_CENTROIDS, max(1, round(2 * n * REPLICAS**0.5 / list_size)))
    take = min(1.0, min(SAMPLE, max(LEAST_SAMPLE, PER_CENTROID * want)) / max(n, 1))
    rows = reps.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(2**31)) <= int(take * 2**31)).select("vector").toArrow()
    column = rows.column("vector").combine_chunks()
    x = _unit(_matrix(column)).astype(np.float32)
    return centroids_of(x, min(want, max(1, len(x) // PER_CENTROID)))


def shelves(centroids: np.ndarray) -> np.ndarray:
    """The shelf of every list: neighbouring lists together."""
    n = max(1, round(len(centroids) / SHELF))
    heads = centroids_of(centroids, n)
    return np.concatenate([np.argmax(centroids[a : a + 8192] @ heads.T, axis=1) for a in range(0, len(centroids), 8192)]).astype(np.int64)


def _visits(graph: CentroidGraph, vectors: pa.ListArray, want: int, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, list)`` of the lists that each vector belongs to or visits, in order of rows."""
    idx, sim = graph.search(_unit(_matrix(vectors)).astype(np.float32), want)
    dist = np.sqrt(np.maximum(2 - 2 * sim, 1e-12))
    keep = dist <= np.maximum(dist[:, :1] * ratio, 1e-5)
    keep[:, :least] = True
    row, col = np.nonzero(keep)
    return row, idx[row, col].astype(np.int64)


def _post(graph: CentroidGraph, shelf: np.ndarray):
    """Rows ``(shelf, list, salt, rep, vector)``: the posting lists of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                row, lists = _visits(graph, part.column("vector"), REPLICAS, BOUNDARY, 0)
                at = pa.array(row)
                salt = (np.asarray(part.column("rep"))[row] * 2654435761 >> 7) & 0xFFFF
                yield pa.RecordBatch.from_arrays([pa.array(shelf[lists]), pa.array(lists), pa.array(salt), part.column("rep").take(at), part.column("vector").take(at)], names=["shelf", "list", "salt", "rep", "vector"])

    return run


def _ask(graph: CentroidGraph, shelf: np.ndarray, parts: np.ndarray):
    """Rows ``(shelf, part, block, lists, rep, vector)``: each query once per part of each shelf it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                row, lists = _visits(graph, part.column("vector"), PROBES, RATIO, LEAST_PROBES)
                order = np.lexsort((lists, shelf[lists], row))
                row, lists = row[order], lists[order]
                on = shelf[lists]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (on[1:] != on[:-1])]) if len(row) else np.zeros(0, np.int64)
                visited = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(lists))
                row, on = row[first], on[first]
                times = parts[on]
                again = np.repeat(np.arange(len(row)), times)
                within = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                at = pa.array(row[again])
                # the queries of a split shelf are split likewise, so that each task sees one block of it
                block = (np.asarray(part.column("rep"))[row[again]] * 2654435761 >> 9 & 0xFFFF) % times[again]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(on[again]), pa.array(within.astype(np.int64)), pa.array(block.astype(np.int64)), visited.take(pa.array(again)), part.column("rep").take(at), part.column("vector").take(at)],
                    names=["shelf", "part", "block", "lists", "rep", "vector"],
                )

    return run


def _search_shelf(k: int):
    """The ``k + 1`` best members for every query of a shelf, over the lists that it visits."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": [], "other": [], "sim": []}).astype({"rep": "int64", "other": "int64", "sim": "float64"})
        if not len(left) or not len(right):
            return none
        member, lists = right["rep"].to_numpy(), right["list"].to_numpy()
        order = np.lexsort((member, lists))
        member, lists = member[order], lists[order]
        m = _unit(np.stack(right["vector"].to_numpy()[order]).astype(np.float64))
        query, q = left["rep"].to_numpy(), _unit(np.stack(left["vector"].to_numpy()).astype(np.float64))
        visits = left["lists"].to_numpy()
        row, want = np.repeat(np.arange(len(left)), [len(v) for v in visits]), np.concatenate(visits)
        found = []
        for x in np.unique(want):
            a, b = np.searchsorted(lists, [x, x + 1])
            rows = row[want == x]
            if a == b:
                continue
            top = min(k + 1, b - a)
            for c in range(0, len(rows), 2048):
                at = rows[c : c + 2048]
                s = np.round(q[at] @ m[a:b].T, 12)
                s[query[at, None] == member[None, a:b]] = -9
                # ties at the edge go to the smaller id, in the order by which they are ranked below
                edge = -np.partition(-s, top - 1, axis=1)[:, top - 1 : top]
                r, col = np.nonzero((s >= edge) & (s > -9))
                found.append((at[r], member[a + col], s[r, col]))
        row, other, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if not len(row):
            return none
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])]  # a replica is found again right behind
        row, other, sim = row[new], other[new], sim[new]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ok = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) <= k
        return pd.DataFrame({"rep": query[row[ok]], "other": other[ok], "sim": sim[ok]})

    return run


def neighbours(points: DataFrame, id: str = "id", vector: str = "vector", k: int = K, list_size: int = LIST_SIZE) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: the ``k`` most similar other points of every usable point.

    Similarity is cosine in double precision rounded to 12 decimals, ties go to the smaller id.  Points
    with null, zero or non-finite vectors are left out, every id counts once, vectors must share one
    length.  Empty input gives an empty result.
    """
    clean = materialize(usable(points, id, vector), "vectors")
    reps = materialize(representatives(clean, k), "reps")
    n = reps.count()
    schema = "id long, neighbour long, similarity double, rank int"
    if n == 0:
        return points.sparkSession.createDataFrame([], schema)
    centroids = fit(reps, n, list_size)
    graph, shelf = CentroidGraph(centroids), shelves(centroids)
    postings = materialize(reps.select("rep", "vector").mapInArrow(_post(graph, shelf), "shelf long, list long, salt long, rep long, vector array<float>"), "postings")
    # at most MAX_CENTROIDS / SHELF rows: the sizes of the shelves, to split the long ones
    parts = np.ones(int(shelf.max()) + 1, np.int64)
    for r in postings.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect():
        parts[r["shelf"]] = max(1, math.ceil(r["n"] / SHELF_ROWS))
    queries = reps.select("rep", "vector").mapInArrow(_ask(graph, shelf, parts), "shelf long, part long, block long, lists array<long>, rep long, vector array<float>")
    many = points.sparkSession.createDataFrame([(x, int(p)) for x, p in enumerate(parts)], "shelf long, many long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))
    members = postings.join(F.broadcast(many), "shelf").select("shelf", F.pmod("salt", "many").alias("part"), blocks.alias("block"), "list", "rep", "vector")
    on = ("shelf", "part", "block")
    found = queries.groupBy(*on).cogroup(members.groupBy(*on)).applyInPandas(_search_shelf(k), "rep long, other long, sim double")
    return _expand(_top_distinct(found, "rep", "other", "sim", k + 1), reps, clean, k)


def _top_distinct(df: DataFrame, key: str, other: str, sim: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key, each ``other`` once, by one shuffle on the key: equal rows share a dense rank."""
    w = Window.partitionBy(key).orderBy(F.col(sim).desc(), F.col(other))
    return df.withColumn("rn", F.dense_rank().over(w)).where(F.col("rn") <= k).groupBy(key, other).agg(F.max(sim).alias(sim))


def _expand(best: DataFrame, reps: DataFrame, clean: DataFrame, k: int) -> DataFrame:
    """From representatives back to points: ids of equal vectors are neighbours of similarity 1.

    Only vectors that several points share are looked up, by salted joins: one may be on a third of all points.
    """
    several = materialize(reps.where(F.size("ids") > 1), "shared")
    wide = salted_join(best, several.select(F.col("rep").alias("other"), "ids"), ["other"], "left", by="rep")
    wide = wide.select("rep", "sim", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    own = several.select("rep", F.lit(1.0).alias("sim"), F.explode("ids").alias("neighbour"))
    lists = _top_distinct(wide.unionByName(own), "rep", "neighbour", "sim", k + 1)
    # every point of a group of equal vectors reads the same k + 1 candidates and drops itself
    copies = salted_join(clean, several.select("rep", "vector"), ["vector"], "inner", by="id").select("id", "rep")
    packed = lists.join(several.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("sim", "neighbour")).alias("list"))
    copied = salted_join(copies, packed, ["rep"], "inner", by="id").select("id", F.explode("list").alias("x")).select("id", "x.neighbour", F.col("x.sim").alias("similarity"))
    single = lists.join(several.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "neighbour", F.col("sim").alias("similarity"))
    every = single.unionByName(copied).where("id <> neighbour")
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("neighbour"))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")


def neighbour_pairs(points: DataFrame, k: int = K) -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b``: pairs of which at least one is among the other's ``k`` nearest."""
    found = neighbours(points, k=k)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
