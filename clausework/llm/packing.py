"""Sum-of-squares online packing of tokenised texts into fixed windows.

A document's ids are cut into full windows; its rest is one item.  Items go, one after another, to
the fill level that minimises the sum of squared counts of partially filled windows; a level array
holds these counts, so a placement looks at no window but only at levels.  When a packer has seen
its last item, the few windows that are still open are emptied into full ones (cutting freely), and
the last rest is laid out in windows of powers of two, which need no padding.

Each task packs the rows of its own partition in their order: nothing is shuffled, no packer sees
more than a partition, and the work of a lost executor is repeated alike.  ``sequence_id`` is the
partition's number times 2**33 plus a running number.

Ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` (special strings in a text keep their
own id, as is that library's default); they are made by ``tiktoken`` from the same vocabulary's
ranks, which gives equal ids several times faster (``tests/llm/test_packing_and_tokens.py`` compares them).

Defined results: a null or empty text is the end id alone; rows repeat as they come, each with its
own pieces; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp

WINDOW = 1024
END = 0
#: Fixed value: the special token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "__key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary() -> str:
    """The default vocabulary file: ranks of the byte-level BPE with 50k ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None):
    """A tokenizer for the ranks file; it is read where the task runs."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(tok, text: str) -> np.ndarray:
    """Ids of a whole text and the end id, as 32-bit integers."""
    ids = tok.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else tok.encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END
    return out


class Packer:
    """Open windows by fill level; ``put`` gives the window and the offset for an item."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # level[h]: open windows filled to h; 0 and the last stay 0
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> tuple[int, int]:
        """Place an item of 1 to window - 1 ids."""
        top = self.window - size
        here = self.level[1 : top + 1]
        held = np.flatnonzero(here)
        # change of the sum of squares when a window rises from h to h + size; a full window leaves the sum
        cost = np.where(held + 1 == top, -2 * here[held] + 1, 2 * (self.level[held + 1 + size] - here[held]) + 2)
        fresh = 2 * self.level[size] + 1
        best = int(np.argmin(cost)) if len(held) else -1
        if best >= 0 and cost[best] <= fresh:
            at = int(held[best]) + 1
            which = self.open[at].pop()
            self.level[at] -= 1
        else:
            at, which = 0, self.new()
        if at + size < self.window:
            self.level[at + size] += 1
            self.open[at + size].append(which)
        return which, at

    def left(self) -> list[tuple[int, int]]:
        """(window, fill) of the open windows, fullest first."""
        return [(w, h) for h in range(self.window - 1, 0, -1) for w in self.open[h]]


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def _run(path: str | None, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = encoder(path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        packer = _Online(window)
        names = ["__key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            arrays[5] = pa.array(np.asarray(columns[5], np.int64) + base)
            return pa.RecordBatch.from_arrays(arrays + [pa.array(list(c), pa.list_(pa.int64())) for c in columns[7:]], names=names)

        rows: list[tuple] = []
        for batch in textnp.slices(batches, "__text"):
            for key, text in zip(batch.column("__key").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                packer.add(key, encode(tok, text or ""), rows, with_ids)
                if len(rows) >= 8192:
                    yield out(rows)
                    rows = []
        packer.end(rows, with_ids)
        if rows:
            yield out(rows)

    return run


class _Online:
    """``pack`` for items that come one at a time; only ids of open windows are held."""

    def __init__(self, window: int):
        self.window, self.packer = window, Packer(window)
        self.inside: dict[int, list[tuple]] = {}

    @staticmethod
    def row(rows: list[tuple], piece: tuple, which: int, at: int, with_ids: bool) -> None:
        key, total, start, ids = piece
        rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, which, at, *([ids.tolist()] if with_ids else [])))

    def lay(self, pieces: list[tuple], which: int, rows: list[tuple], with_ids: bool) -> None:
        at = 0
        for piece in pieces:
            self.row(rows, piece, which, at, with_ids)
            at += len(piece[3])

    def add(self, key: int | None, ids: np.ndarray, rows: list[tuple], with_ids: bool) -> None:
        n = len(ids)
        full = n - n % self.window
        for start in range(0, full, self.window):
            self.row(rows, (key, n, start, ids[start : start + self.window]), self.packer.new(), 0, with_ids)
        if full < n:
            which, at = self.packer.put(n - full)
            own = self.inside.setdefault(which, [])
            own.append((key, n, full, ids[full:].copy()))
            if at + n - full == self.window:
                self.lay(self.inside.pop(which), which, rows, with_ids)

    def end(self, rows: list[tuple], with_ids: bool) -> None:
        """Move what the emptiest open windows hold into the fullest; the last rest goes to powers of two."""
        left = self.packer.left()
        i, j, loose = 0, len(left) - 1, []
        while i <= j:
            which, fill = left[i]
            own, room = self.inside[which], self.window - fill
            while room and (loose or j > i):
                if not loose:
                    loose = self.inside.pop(left[j][0])
                    j -= 1
                key, total, start, ids = loose.pop()
                take = min(room, len(ids))
                own.append((key, total, start + len(ids) - take, ids[len(ids) - take :]))
                if take < len(ids):
                    loose.append((key, total, start, ids[: len(ids) - take]))
                room -= take
            if room:
                loose = own + loose
            else:
                self.lay(own, which, rows, with_ids)
            i += 1
        queue = loose[::-1]
        for size in powers(sum(len(x[3]) for x in loose)):
            room, own = size, []
            while room:
                key, total, start, ids = queue.pop()
                take = min(room, len(ids))
                own.append((key, total, start, ids[:take]))
                if take < len(ids):
                    queue.append((key, total, start + take, ids[take:]))
                room -= take
            self.lay(own, self.packer.new(), rows, with_ids)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds the ids."""
    rows = df.select(F.col(id_col).cast("bigint").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    packed = rows.mapInArrow(_run(vocabulary_path, window, with_ids), PIECES + ", ids array<bigint>" * with_ids)
    return packed.withColumnRenamed("__key", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
