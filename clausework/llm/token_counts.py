"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token's best segmentation is found by forward scores: the best score of a prefix is the best
over its last pieces.  The score of a prefix does not depend on what follows, so the distinct
pre-tokens of a batch are put into a trie and each shared prefix is scored once; the place where a
pre-token ends keeps its piece count.  The trie is walked depth first over the sorted pre-tokens:
the path to the last one is the stack, and only what is behind the common prefix is scored anew.

The vocabulary is a public byte-level one (every byte is a piece, so every text has a segmentation);
its ranks give the scores by Zipf's law, log p = -log(rank + 2.7), so nothing is trained.  Ties go
to fewer pieces.  A task keeps the counts of at most ``MEMO`` pre-tokens; nothing is shuffled.

Defined results: null and empty texts count 0; rows repeat as they come; an empty table gives an
empty result; only the two named columns are read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp

SHIFT = 2.7
MEMO = 400_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Unigram:
    """Pieces with scores; ``counts`` gives the piece counts of sorted pre-tokens."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        ends: dict[bytes, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        # lengths of the pieces that may end with two given bytes; one-byte pieces end anywhere
        self.lengths = {k: sorted(v) for k, v in ends.items() if len(k) == 2}
        self.none: list[int] = []

    @classmethod
    def from_ranks(cls, path: str | None = None) -> "Unigram":
        with open(path or vocabulary_path(), "rb") as f:
            return cls({base64.b64decode(a): -math.log(int(b) + SHIFT) for a, b in map(bytes.split, f)})

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces of each word's best segmentation; ``words`` are sorted, so that a walk over them is a walk over their trie."""
        scores, lengths, none = self.scores, self.lengths, self.none
        best, pieces, last, out = [0.0], [0], b"", []
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, few = best[end - 1] + scores[word[end - 1 : end]], pieces[end - 1] + 1
                for size in lengths.get(word[end - 2 : end], none):
                    if size > end:
                        break
                    score = scores.get(word[end - size : end])
                    if score is not None:
                        score += best[end - size]
                        if score > top or (score == top and pieces[end - size] + 1 < few):
                            top, few = score, pieces[end - size] + 1
                best.append(top)
                pieces.append(few)
            out.append(pieces[-1])
            last = word
        return out


def _count(path: str | None, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        model, split = Unigram.from_ranks(path), regex.compile(public_tokenizers.PATTERN)
        known: dict[str, int] = {}
        for batch in textnp.slices(batches, "__text", 4 << 20):
            texts = [split.findall(t or "") for t in batch.column("__text").to_pylist()]
            fresh = set().union(*texts).difference(known)
            if len(known) + len(fresh) > memo:
                known, fresh = {}, set().union(*texts)
            pairs = sorted((w.encode("utf-8", "surrogatepass"), w) for w in fresh)
            known.update(zip([w for _, w in pairs], model.counts([b for b, _ in pairs]), strict=True))
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(get, t)) for t in texts], pa.int64())], names=["__key", "n_pretokens", "n_tokens"]
            )

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, memo: int = MEMO) -> DataFrame:
    """One row per input row: id, ``n_pretokens``, ``n_tokens``."""
    rows = df.select(F.col(id_col).cast("bigint").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(_count(vocabulary, memo), "__key bigint, n_pretokens bigint, n_tokens bigint").withColumnRenamed("__key", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
