"""Similarity join on word n-grams by a token-group matrix.

A document's set is its distinct word shingles.  Documents with equal sets are one class.  Classes
are compared on the rarest part of their sets: two sets of Jaccard similarity t or more share a
token among the first ``n - ceil(t n) + 1`` of each, in any common order.  The order used puts long
shingles first and shingles that are frequent anywhere in the corpus last, so that common passages
rarely come into play.  ``clausework.llm.linkage`` partitions similar classes into groups, counts
each class's tokens in the groups' token unions, and opens only the groups that pass the bound.
All links are verified on the whole texts, as ratios of integers.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are their
own component; equal ids are one node, which has the links of each of its texts; rows without id get
the component of their copies, else null; an empty table gives an empty result; repeated rows come
as often as they are; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp
from clausework.llm.linkage import bounded, link_components
from clausework.llm.shared import drop, small_batches, written

K, NUM, DEN = 4, 85, 100
#: The most frequent shingles that are moved to the end of the order; a bound on what is broadcast.
MAX_COMMON = 100_000
_TOP = np.uint64(1 << 63)


def token_lists(col: pa.Array, k: int, common: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in the common order: rare and long first.

    A token has a bit for ``common``, six bits for its length (long first) and a 57-bit hash.
    """
    data, offs = textnp.buffer(col)
    words = textnp.Words(textnp.LOWER[data], offs, textnp.NON_SPACE)
    h, sizes = words.hashes, np.concatenate([[0], np.cumsum(words.ends - words.starts)])

    def token(total: np.ndarray, long: np.ndarray) -> np.ndarray:
        t = (np.uint64(63) - np.minimum(long, 63).astype(np.uint64) << np.uint64(57)) | (textnp.mix(total) >> np.uint64(7))
        if len(common) and len(t):
            at = np.minimum(np.searchsorted(common, t), len(common) - 1)
            t = np.where(common[at] == t, t | _TOP, t)
        return t

    m = max(0, len(h) - k + 1)
    total = np.zeros(m, np.uint64)
    for j in range(k):
        total += h[j : j + m] * textnp._STEPS[j]
    flat = token(total, sizes[k : k + m] - sizes[:m]) if m else total
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(flat[a : b - k + 1])
        elif b > a:
            steps = textnp._STEPS[: b - a]
            yield token(np.array([(h[a:b] * steps).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64), np.array([sizes[b] - sizes[a]]))
        else:
            yield flat[:0]


def _common(k: int, least: int = 3):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in textnp.slices(batches, "__text", 3 << 20):
            lists = list(token_lists(batch.column("__text"), k, none))
            value, count = np.unique(np.concatenate(lists), return_counts=True)
            often = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often])], names=["token", "n"])

    return run


def _prefixes(shared, k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, "__text"):
            n, one, two, parts, ends = [], [], [], [], [0]
            for s in token_lists(batch.column("__text"), k, shared.value):
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s))
                one.append(digest[0])
                two.append(digest[1])
                parts.append(s[: len(s) + (num * len(s) // -den) + 1] if len(s) else s)
                ends.append(ends[-1] + len(parts[-1]))
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array(n, pa.int64()), pa.array(np.array(one, np.int64)), pa.array(np.array(two, np.int64)), textnp.as_list(flat, np.array(ends), pa.int64())], names=["__key", "n", "d1", "d2", "tokens"]
            )

    return run


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN, max_common: int = MAX_COMMON) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id`` (the smallest linked id).

    Two documents link when ``den * intersection >= num * union`` of their sets of k-word shingles.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    counted = rows.mapInArrow(_common(k), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    often = counted.where("n >= 16").orderBy(F.col("n").desc(), "token").limit(max_common).select("token").toPandas()["token"]
    shared = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))
    slim = written(rows.mapInArrow(_prefixes(shared, k, num, den), "__key bigint, n bigint, d1 bigint, d2 bigint, tokens array<bigint>"), "prefixes")
    classes = written(slim.where("n > 0").groupBy("d1", "d2").agg(F.min("__key").alias("rep")), "classes")
    reps = slim.join(classes, ["d1", "d2"]).where("__key = rep")
    postings = reps.select(F.explode("tokens").alias("token"), F.col("__key").alias("node"), "n")

    def texts(ids: DataFrame, n: int) -> DataFrame:
        return rows.select(F.col("__key").alias("node"), F.col("__text").alias("text")).where("node IS NOT NULL").join(bounded(ids, n), "node")

    none = np.zeros(0, np.uint64)

    def compare(one: pa.Array, two: pa.Array) -> list[bool]:
        return [_similar(a, b, num, den) for a, b in zip(token_lists(one, k, none), token_lists(two, k, none), strict=True)]

    def first_link(ids: list[int], one: pa.ChunkedArray, others: list[int], two: pa.ChunkedArray) -> tuple[list[int], list[int]]:
        sets = [s for c in two.chunks for s in token_lists(c, k, none)]
        union = np.unique(np.concatenate(sets)) if sets else none
        a, b = [], []
        for q, s in zip(ids, (s for c in one.chunks for s in token_lists(c, k, none)), strict=True):
            if den * len(np.intersect1d(s, union, assume_unique=True)) < num * len(s):
                continue
            for m, t in zip(others, sets, strict=True):
                if q != m and _similar(s, t, num, den):
                    a.append(q)
                    b.append(m)
                    break
        return a, b

    # With c shared tokens among the first p = n - ceil(t n) + 1 of each set, the sets share at most
    # c + max(n - p, hn - p'), and a link takes t / (1 + t) * (n + hn).
    t = num / den
    most = lambda n, h: t / (1 + t) * (n + h) - (F.ceil(t * F.greatest(n, h)) - 1) - 1e-6
    n, hn, c, lo, hi = (F.col(x) for x in ("n", "hn", "c", "lo", "hi"))
    near = (F.least(n, hn) >= t * F.greatest(n, hn) - 1e-6) & (c >= 0.5 * most(n, hn))
    low, high = F.greatest(lo.cast("double"), t * n), F.least(hi.cast("double"), n / t)
    # the bound is lowest at the ends of the sizes that can link; one is added for rounded sizes
    may = (low <= high + 1e-6) & (c + 1 >= F.least(most(n, low), most(n, high)))
    linked = link_components(postings, texts, compare, first_link, near, may)
    keyed = slim.select("__key", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("__key", "n", "rep")
    out = keyed.join(linked, keyed.rep == linked.node, "left")
    return out.select(F.col("__key").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "__key").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a WHERE r.m < l.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(m) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
