"""Benchmark decontamination by FM-index.

Every task cuts its documents into shards of a few megabytes and builds one FM-index per shard: the
suffix array of the word sequence, its Burrows-Wheeler transform in a wavelet matrix (a wavelet tree
stored level by level) and sampled suffix positions.  All windows of the benchmark are searched
backwards through wavelet ranks at once; the occurrences are located by walking to the next sampled
position; the words they cover are merged into removal spans.

The index alphabet is the benchmark's vocabulary: a word that no item holds can be in no window, so
runs of such words are one separator.  Each separator and each text end sorts as a symbol of its
own, which makes the suffix order final where a run ends.

The benchmark is the stated query set.  It is read in blocks of bounded size; more blocks are more
passes over the documents, each row carrying its spans along, without any shuffle.

Defined results: a null or empty text has no words and no spans; item rows with null id or without
words are skipped; several rows of one item id count as one item; repeated documents come as often
as they are; an empty benchmark leaves all documents clean; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 16
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of symbols in order; every 0 is a separator unlike all others.

    Ranks by ever longer prefixes (three ranks at a time); from the second pass on only suffixes
    that are still tied are sorted again.  The last symbol must be 0.
    """
    n = len(text)
    sep = text == 0
    n_sep = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + (n_sep - 1))
    big = int(rank.max()) + 1

    def keys(at: np.ndarray, width: int, size: int) -> tuple[np.ndarray, int]:
        second = rank[np.minimum(at + width, n - 1)]
        if size**3 < 1 << 62:
            return (rank[at] * size + second) * size + rank[np.minimum(at + 2 * width, n - 1)], 3
        return rank[at] * size + second, 2

    key, times = keys(np.arange(n), 1, big)
    sa = np.argsort(key, kind="stable")
    width, slots, ordered = times, np.arange(n), key[sa]
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        head = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        new = rank if width > 3 else np.empty(n, np.int64)
        new[sa[slots]] = head
        rank = new
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = slots[tied]
        if not len(slots):
            return sa
        at = sa[slots]
        key, times = keys(at, width, n)
        order = np.argsort(key, kind="stable")
        sa[slots], ordered = at[order], key[order]
        width *= times


class FMIndex:
    """Backward search and locate over one shard; symbols are 0 (separator) to ``sigma - 1``."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        row = self.bwt
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, self.n - int(count[-1]), count))
            row = np.concatenate([row[~ones], row[ones]])
        # a position behind a separator is always sampled: no walk crosses a separator
        kept = (sa % sample == 0) | (self.bwt == 0)
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.places = sa[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each row."""
        low, high = np.zeros_like(row), row
        for bit, zeros, count in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = count[low], count[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern; patterns are right-aligned in the matrix."""
        last = patterns[:, -1]
        lo, hi = self.before[last].copy(), self.before[last + 1].copy()
        for back in range(2, patterns.shape[1] + 1):
            live = np.flatnonzero((sizes >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, -back]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[at[todo]]
            ready = todo[done]
            out[ready] = self.places[self.kept_rank[at[ready]]] + steps[ready]
            todo = todo[~done]
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


class Phrases:
    """Windows of a block of items: distinct word sequences and the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data = pa.array([t for _, t in items], pa.string())
        raw, offs = textnp.buffer(data)
        words = textnp.Words(textnp.LOWER[raw], offs, textnp.ALNUM)
        self.vocabulary, symbol = np.unique(words.hashes, return_inverse=True)
        symbol = symbol.astype(np.int32) + 1
        held: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for i, (item, _) in enumerate(items):
            own = symbol[words.first[i] : words.first[i + 1]]
            size = min(window, len(own))
            for j in range(len(own) - size + 1 if size else 0):
                w = own[j : j + size]
                held.setdefault(w.tobytes(), (w, set()))[1].add(item)
        self.sizes = np.array([len(w) for w, _ in held.values()], np.int64)
        self.matrix = np.zeros((len(held), window), np.int32)
        for i, (w, _) in enumerate(held.values()):
            self.matrix[i, window - len(w) :] = w
        self.names = sorted({x for _, s in held.values() for x in s})
        number = {x: i for i, x in enumerate(self.names)}
        each = [sorted(number[x] for x in s) for _, s in held.values()]
        self.item_first = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        self.items = np.array([x for s in each for x in s], np.int64)

    def hits(self, words: textnp.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, window) of every occurrence in a shard."""
        n_docs, n = len(words.first) - 1, len(words.hashes)
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not n:
            return none, none, none
        slot = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[slot] == words.hashes, slot + 1, 0).astype(np.int32)
        # a separator behind each document; one for each run of unknown words
        spread = np.zeros(n + n_docs, np.int32)
        place = np.arange(n) + np.repeat(np.arange(n_docs), np.diff(words.first))
        spread[place] = symbol
        origin = np.zeros(n + n_docs, np.int64)
        origin[place] = np.arange(n)
        keep = spread > 0
        keep[1:] |= spread[:-1] > 0
        text, origin = spread[keep], origin[keep]
        if not len(text):
            return none, none, none
        if text[-1]:
            text, origin = np.append(text, np.int32(0)), np.append(origin, 0)
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.matrix, self.sizes)
        counts = hi - lo
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        return origin[index.locate(rows)], self.sizes[which], which


def _search(shared, first_pass: bool, last_pass: bool, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch in textnp.slices(batches, "__text", shard_bytes):
            data, offs = textnp.buffer(batch.column("__text"))
            words = textnp.Words(textnp.LOWER[data], offs, textnp.ALNUM)
            starts, sizes, which = phrases.hits(words)
            n_docs, n = batch.num_rows, len(words.hashes)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + sizes, -1)
            if not first_pass:
                for i, old in enumerate(batch.column("spans").to_pylist()):
                    for s in old:
                        edge[words.first[i] + s["first"]] += 1
                        edge[words.first[i] + s["end"]] -= 1
            hit = np.zeros(n + 2, bool)
            hit[1:-1] = np.cumsum(edge)[:-1] > 0
            # spans end with their document: ends and starts are looked for with the documents apart
            cut = np.zeros(n + 2, bool)
            cut[words.first[:-1] + 1] = True
            begin = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[1:-1]))
            end = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[2:])) + 1
            owner = np.searchsorted(words.first, begin, "right") - 1
            span_first = np.searchsorted(begin, words.first)
            spans = pa.ListArray.from_arrays(
                pa.array(span_first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - words.first[owner]), pa.array(end - words.first[owner])], names=["first", "end"])
            )
            doc = np.searchsorted(words.first, starts, "right") - 1
            pairs = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
            items: list[list[str]] = [[] for _ in range(n_docs)] if first_pass else batch.column("items").to_pylist()
            found: dict[int, set[str]] = {}
            for d, w in pairs.T.tolist():
                found.setdefault(d, set()).update(phrases.names[x] for x in phrases.items[phrases.item_first[w] : phrases.item_first[w + 1]].tolist())
            for d, own in found.items():
                items[d] = sorted(own.union(items[d]))
            columns = {"__key": batch.column("__key"), "n_words": pa.array(np.diff(words.first)), "spans": spans, "items": pa.array(items, pa.list_(pa.string()))}
            if not last_pass:
                columns["__text"] = batch.column("__text")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def removal_spans(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None, found_col: str = "__found") -> DataFrame:
    """One row per document: words, merged spans (word places, end excluded) and the items found.

    ``block_bytes`` bounds what is read of the benchmark at once; ``shard_bytes`` bounds an index.
    With ``carry``, these columns of ``df`` come back with one struct ``found_col`` in place of the
    separate columns; nothing is joined or shuffled.
    """
    spark = df.sparkSession
    wanted = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("t")).where("item IS NOT NULL AND t IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    key = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.col(id_col).cast("bigint")
    rows = df.select(key.alias("__key"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString() if not carry else "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema["__key"].dataType) + ">"
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r.item, r.t) for r in sorted(block)], window))
        last = b == blocks - 1
        rows = rows.mapInArrow(_search(shared, b == 0, last, shard_bytes), f"__key {kind}, n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>" + ", __text string" * (not last))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    if carry:
        return rows.select("__key.*", F.struct("n_words", n_hit.alias("n_hit"), "spans", "items").alias(found_col))
    return rows.select(F.col("__key").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")


def contaminated(found: str | None = None) -> Column:
    """The rule: some word is hit, and at least one word in twenty."""
    n_hit, n_words = (F.col(f"{found}.{c}" if found else c) for c in ("n_hit", "n_words"))
    return (n_hit > 0) & (20 * n_hit >= n_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.size("spans").cast("bigint").alias("n_spans")
    )


SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
p AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h)),
s AS (SELECT doc_id, count(*) AS n_spans FROM p WHERE b IS NULL OR p > b + 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)
"""
