"""Ranked lexical search on dual-sorted wavelet trees.

The queries are a stated set (the benchmark's items), read in blocks of bounded size.  One pass over
the documents counts what the weights need; a second one searches.  Every task cuts its documents into
shards of a few megabytes and builds one index per shard: the posting lists of all terms one behind
the other, each by falling impact, as the sequence of a wavelet tree over local document numbers (kept
level by level).  So a list can be read in either order: its front holds its highest impacts, and every
node of the tree holds, still by falling impact, its part in a range of documents.  What a shard's
postings hold of a node is an interval; the impact at its start bounds all documents of the range.

All terms of an item go down the tree together.  A node's bound is the sum of weight times first
impact over the terms that still have an interval there; nodes are taken best first, and a node of one
document has its exact score.  The k-th score found so far, over all shards of the task, ends the
search: what cannot beat it is never opened.  Local numbers follow the document ids, so equal scores
are settled by the same bound.  Each task returns k rows an item at most; they are merged in two steps.

Documents are indexed under the terms that some item of the block asks for, all of them; other words
count in the lengths alone.

Defined results: null texts and texts without terms are never found and count nowhere; several rows
of one item id are one item with the terms of all; items without id or terms give no rows; rows with
the same document id, or none, are documents of their own (ids are ranked ascending, rows without id
last); empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clausework.llm import textnp
from clausework.llm.shared import written

TOP = 50
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
#: Nodes of an item that are opened at once.
OPENED = 32
#: Parts in which an item's rows are merged first.
SALTS = 64
_LAST = np.iinfo(np.int64).max


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one behind the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Items:
    """The terms of a block of items: sorted hashes, and per item the places of its terms."""

    def __init__(self, texts: list[list[str]]):
        flat = pa.array([t for own in texts for t in own], pa.string())
        raw, offs = textnp.buffer(flat)
        words = textnp.Words(textnp.LOWER[raw], offs, textnp.ALNUM)
        self.terms, slot = np.unique(words.hashes, return_inverse=True)
        owner = np.repeat(np.repeat(np.arange(len(texts)), [len(x) for x in texts]), np.diff(words.first))
        pairs = np.unique(owner * max(1, len(self.terms)) + slot.ravel())
        self.item, self.term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        self.count = len(texts)


def postings(batch: pa.RecordBatch, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, tf) of the terms asked for, and the number of words of each row."""
    data, offs = textnp.buffer(batch.column("text"))
    words = textnp.Words(textnp.LOWER[data], offs, textnp.ALNUM)
    n = np.diff(words.first)
    if not len(terms):
        return *[np.zeros(0, np.int64)] * 3, n
    slot = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
    known = terms[slot] == words.hashes
    row = np.repeat(np.arange(len(n)), n)[known]
    pairs, tf = np.unique(slot[known] * len(n) + row, return_counts=True)
    return pairs // len(n), pairs % len(n), tf, n


class DualSorted:
    """Posting lists by falling impact in a wavelet tree over document numbers."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.depth = max(1, (n_docs - 1).bit_length())
        n = len(doc)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        self.impact = np.zeros((self.depth + 1, n), np.int32)
        for level in range(self.depth):
            self.impact[level] = impact
            one = (doc >> (self.depth - 1 - level) & 1).astype(bool)
            np.cumsum(one, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            doc, impact = np.concatenate([doc[~one], doc[one]]), np.concatenate([impact[~one], impact[one]])
        self.impact[self.depth] = impact


class Best:
    """The k best (score, document id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.nul = np.zeros(0, bool)
        # scores of 0 are never kept
        self.least, self.least_id = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def beats(self, item: np.ndarray, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (bound > self.least[item]) | (bound == self.least[item]) & (ids < self.least_id[item])

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, nul: np.ndarray) -> None:
        item, score, ids, nul = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.nul, nul)))
        order = np.lexsort((ids, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        self.item, self.score, self.id, self.nul = item[place < self.k], score[kept], ids[kept], nul[kept]
        full = order[place == self.k - 1]
        which = item[place == self.k - 1]
        self.least[which], self.least_id[which] = score[full], ids[full]


class Nodes:
    """Open nodes: item, level, number and bound each; ``lo``, ``hi`` and ``weight`` of its terms' intervals, node by node."""

    def __init__(self, item, level, number, bound, size, lo, hi, weight):
        self.item, self.level, self.number, self.bound, self.size, self.lo, self.hi, self.weight = item, level, number, bound, size, lo, hi, weight

    def take(self, at: np.ndarray) -> Nodes:
        size = self.size[at]
        flat = np.repeat((np.cumsum(self.size) - self.size)[at], size) + ranges(size)
        return Nodes(self.item[at], self.level[at], self.number[at], self.bound[at], size, self.lo[flat], self.hi[flat], self.weight[flat])

    def join(self, other: Nodes) -> Nodes:
        return Nodes(*(np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("item", "level", "number", "bound", "size", "lo", "hi", "weight")))


def roots(index: DualSorted, items: Items, weight: np.ndarray) -> Nodes:
    lo, hi = index.first[items.term], index.first[items.term + 1]
    some = lo < hi
    lo, hi, own, w = lo[some], hi[some], items.item[some], weight[items.term[some]]
    item, start, size = np.unique(own, return_index=True, return_counts=True)
    bound = np.add.reduceat(w * index.impact[0, lo], start) if len(item) else np.zeros(0, np.int64)
    zero = np.zeros(len(item), np.int64)
    return Nodes(item, zero, zero.copy(), bound, size, lo, hi, w)


def children(index: DualSorted, nodes: Nodes) -> Nodes:
    """Both halves of each node, without those that no posting is in."""
    level = np.repeat(nodes.level, nodes.size)
    node = np.repeat(np.arange(len(nodes.size)), nodes.size)
    a, b = index.ones[level, nodes.lo].astype(np.int64), index.ones[level, nodes.hi].astype(np.int64)
    z = index.zeros[level]
    lo, hi = np.concatenate([nodes.lo - a, z + a]), np.concatenate([nodes.hi - b, z + b])
    child = np.concatenate([2 * node, 2 * node + 1])
    some = np.flatnonzero(lo < hi)
    some = some[np.argsort(child[some], kind="stable")]
    half = len(level)
    lo, hi, child, level, weight = lo[some], hi[some], child[some], level[some % half] + 1, nodes.weight[some % half]
    start = np.flatnonzero(np.r_[True, child[1:] != child[:-1]]) if len(child) else np.zeros(0, np.int64)
    bound = np.add.reduceat(weight * index.impact[level, lo], start) if len(start) else np.zeros(0, np.int64)
    own = child[start] // 2
    return Nodes(nodes.item[own], level[start], 2 * nodes.number[own] + child[start] % 2, bound, np.diff(np.r_[start, len(child)]), lo, hi, weight)


def search(index: DualSorted, items: Items, weight: np.ndarray, ids: np.ndarray, nul: np.ndarray, best: Best, opened: int = OPENED) -> int:
    """Best-first search for all items at once; ``ids`` ascend by local number. Returns how many nodes were opened."""
    first = lambda x: ids[np.minimum(x.number << (index.depth - x.level), len(ids) - 1)]
    pool, count = roots(index, items, weight), 0
    while True:
        pool = pool.take(np.flatnonzero(best.beats(pool.item, pool.bound, first(pool))))
        if not len(pool.item):
            return count
        order = np.lexsort((first(pool), -pool.bound, pool.item))
        ranked = pool.item[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        now = place < max(opened, len(order) // (4 * items.count))
        count += int(now.sum())
        got = children(index, pool.take(order[now]))
        leaf = got.level == index.depth
        done = got.take(np.flatnonzero(leaf))
        ok = best.beats(done.item, done.bound, first(done))
        best.add(done.item[ok], done.bound[ok], ids[done.number[ok]], nul[done.number[ok]])
        pool = pool.take(order[~now]).join(got.take(np.flatnonzero(~leaf)))


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The length norm m of documents of n words."""
    value, place = np.unique(n, return_inverse=True)
    return np.array([50 + 50 * x * docs // words for x in value.tolist()], np.int64)[place.ravel()]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _count(shared):
    """mapInArrow: per task, documents with terms (place -2), words (-1) and documents per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        total = np.zeros(len(terms) + 2, np.int64)
        for batch in textnp.slices(batches, "text", SHARD_BYTES):
            term, _, _, n = postings(batch, terms)
            total += np.concatenate([[int((n > 0).sum()), int(n.sum())], np.bincount(term, minlength=len(terms))])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some - 2), pa.array(total[some])], names=["place", "n"])

    return run


def _find(shared, docs: int, words: int, weight: np.ndarray, top: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = Best(items.count, top)
        for batch in textnp.slices(batches, "text", shard_bytes):
            key = batch.column("id")
            nul = key.is_null().to_numpy(zero_copy_only=False)
            ids = np.where(nul, _LAST, key.fill_null(0).to_numpy())
            order = np.argsort(ids, kind="stable")
            local = np.empty(len(ids), np.int64)
            local[order] = np.arange(len(ids))
            term, row, tf, n = postings(batch, items.terms)
            index = DualSorted(term, local[row], impacts(tf, lengths(n, docs, words)[row]), len(items.terms), len(ids))
            search(index, items, weight, ids[order], nul[order], best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), pa.array(best.id, mask=best.nul)], names=["item", "score", "id"])

    return run


def ranked(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): the ``top`` highest-scoring documents of each row of ``queries``.

    ``shard_bytes`` bounds the text of an index, ``block_bytes`` what is read of the queries at once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = StructType([StructField("number", LongType()), StructField("name", asked.schema["item"].dataType)])
    out = None
    for b in range(blocks):
        texts: dict[object, list[str]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            texts.setdefault(r["item"], []).append(r["text"])
        names = sorted(texts)
        items = Items([texts[x] for x in names])
        shared = spark.sparkContext.broadcast(items)
        counts = {r.place: r.n for r in rows.mapInArrow(_count(shared), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        docs, words = counts.get(-2, 0), counts.get(-1, 0)
        weight = weights(docs, np.array([counts.get(i, 0) for i in range(len(items.terms))], np.int64))
        found = rows.mapInArrow(_find(shared, docs, words, weight, top, shard_bytes), "item bigint, score bigint, id bigint")
        order = (F.col("score").desc(), F.col("id").asc_nulls_last())
        part = found.withColumn("salt", F.spark_partition_id() % SALTS)
        first = part.withColumn("at", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("at") <= top)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        named = last.join(spark.createDataFrame(list(enumerate(names)), kind), F.col("item") == F.col("number"))
        block = named.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        if blocks > 1:
            block = written(block, "ranked")
            shared.destroy()
        out = block if out is None else out.union(block)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
m AS (SELECT r, doc_id, 100 - 50 + (50 * CAST(len(w) AS BIGINT) * n_docs) // n_words AS m FROM d, a WHERE len(w) > 0),
s AS (SELECT item_id, r, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
