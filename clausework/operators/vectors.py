"""Nearest vectors by cosine: scoring in blocks, and a partitioned index that is exact by triangle bounds.

Scores are matrix products on Arrow batches; each task keeps the best k of each query, so what is shuffled does
not grow with the vectors.  The index puts every vector into the list of its nearest centroid; the centroids
are fitted on a bounded sample, which decides speed alone.  A list is opened for a query only if its ring of
distances to the centroid can hold something better than the k-th best that the nearest lists gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.sources.tables import kept

#: Vectors that centroids are fitted on at most, lists at most, rounds of fitting, lists that are always opened.
SAMPLE, LISTS, ROUNDS, FIRST = 20_000, 1024, 8, 4
#: Vectors of a list that one task compares at once.
PART = 20_000
DIGITS = 4
_SLACK = 0.5 * 10**-DIGITS + 1e-6


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of length one; a vector without length stays zero."""
    n = len(column)
    flat = np.asarray(column.flatten().cast(pa.float64()))
    x = flat.reshape(n, -1) if n else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Best:
    """The k best of each query by rounded score, then id."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kept_rows = order[place < self.k]
        self.q, self.id, self.score = q[kept_rows], ids[kept_rows], score[kept_rows]

    def add_block(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is vectors x queries; what is below the k-th of a block can't be among the best."""
        if len(ids) > 4 * self.k:
            least = -np.partition(-scores, self.k - 1, axis=0)[self.k - 1]
            v, q = np.nonzero(scores >= least)
        else:
            v, q = (x.ravel() for x in np.indices(scores.shape))
        self.add(q, ids[v], scores[v, q])

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.q]), pa.array(self.id), pa.array(self.score)], names=["qid", "id", "score"])


_HITS = "qid bigint, id bigint, score double"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block of queries."""
    t = queries.select("qid", "embedding").toArrow().combine_chunks()
    return t["qid"].to_numpy().astype(np.int64), unit_rows(t["embedding"].chunk(0) if t.num_rows else t["embedding"].combine_chunks())


def all_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) of a block of queries against all vectors: one pass, no shuffle of vectors."""
    names, q = collected(queries)
    shared = vectors.sparkSession.sparkContext.broadcast((names, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = Best(len(names), k)
        for b in batches:
            if b.num_rows and len(names):
                best.add_block(b.column("id").to_numpy(), np.round(unit_rows(b.column("embedding")) @ q.T, DIGITS))
        yield best.batch(names)

    return _ranked(vectors.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInArrow(run, _HITS), k)


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``sample`` vectors, those with the smallest hashes of their id."""
    t = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().combine_chunks()
    x = unit_rows(t["embedding"].chunk(0)) if t.num_rows else np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(c) else 0):
        nearest = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


class Index:
    """Every vector in a list: ``table(list, part, id, embedding, far)``, centroids, and each list's nearest and farthest vector."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, near: dict[int, float], far: dict[int, float]):
        self.table, self.centroids, self.near, self.far = table, centroids, near, far


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of ``vectors(id, embedding)``: about the square root of their number of lists, at most ``LISTS``."""
    n = vectors.count()
    c = centroids(vectors, lists or min(LISTS, max(1, int(n**0.5))), sample)
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if b.num_rows:
                near = unit_rows(b.column("embedding")) @ c.T
                own = np.argmax(near, axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(own)), own]))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("id"), b.column("embedding"), pa.array(far)], names=["list", "id", "embedding", "far"])

    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    put = rows.mapInArrow(assign, f"list int, id bigint, embedding {kind}, far double")
    # hot lists are cut into parts, so no task gets an unbounded one
    size = kept(put, "vector-lists")
    parts = size.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"), F.min("far").alias("near"), F.max("far").alias("most"))
    rings = {r.list: r for r in parts.collect()}  # at most LISTS rows
    table = size.join(F.broadcast(parts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    return Index(kept(table, "vector-index"), c, {i: r.near for i, r in rings.items()}, {i: r.most for i, r in rings.items()})


def _open(index: Index, names: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, worst: np.ndarray | None) -> DataFrame:
    """Hits of queries in the lists that ``wanted`` (lists x queries) opens for them, one part of a list a task."""
    spark = index.table.sparkSession
    shared = spark.sparkContext.broadcast((names, q, wanted, index.centroids, worst))

    def run(table: pa.Table) -> pa.Table:
        names, q, wanted, c, worst = shared.value
        at = table["list"][0].as_py()
        asks = np.flatnonzero(wanted[at])
        v = unit_rows(pa.concat_arrays(table["embedding"].chunks))
        score = np.round(v @ q[asks].T, DIGITS)
        if worst is not None:
            # a vector is as far from the query as its and the query's distances to the centroid differ, at least
            gap = np.abs(table["far"].to_numpy()[:, None] - np.sqrt(np.maximum(0, 2 - 2 * (q[asks] @ c[at])))[None, :])
            score = np.where(gap <= worst[asks][None, :], score, -np.inf)
        best = Best(len(asks), k)
        best.add_block(table["id"].to_numpy(), score)
        b = best.batch(names[asks])
        return pa.Table.from_batches([b.filter(pa.array(best.score > -np.inf))])

    opened = np.flatnonzero(wanted.any(axis=1)).tolist()
    return index.table.where(F.col("list").isin(opened)).groupBy("list", "part").applyInArrow(run, _HITS)


def nearest(index: Index, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, float]:
    """((qid, id, score, rank), share of pairs of list and query that were opened): exactly the k best of each query of a block."""
    names, q = collected(queries)
    c = index.centroids
    if not len(names) or not len(c):
        return index.table.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0), 0.0
    distance = np.sqrt(np.maximum(0, 2 - 2 * (c @ q.T)))  # lists x queries
    held = np.array([i in index.far for i in range(len(c))])
    order = np.argsort(np.where(held[:, None], distance, np.inf), axis=0, kind="stable")
    start = np.zeros(distance.shape, bool)
    np.put_along_axis(start, order[:first], True, axis=0)
    start &= held[:, None]
    found = kept(_ranked(_open(index, names, q, start, k, None), k), "vector-first")
    # the k-th score so far, as a distance with room for rounded scores; queries with fewer hits open all lists
    least = {r.qid: r.s for r in found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}
    worst = np.array([np.sqrt(max(0.0, 2 - 2 * (least[x] - 2 * _SLACK))) if x in least else np.inf for x in names.tolist()])
    near, far = (np.array([ring.get(i, np.inf) for i in range(len(c))])[:, None] for ring in (index.near, index.far))
    gap = np.maximum(0, np.maximum(distance - far, near - distance))
    more = held[:, None] & ~start & (gap <= worst[None, :])
    share = float((start | more)[held].mean())
    if not more.any():
        return found, share
    rest = _open(index, names, q, more, k, worst)
    return _ranked(found.drop("rank").union(rest), k), share
