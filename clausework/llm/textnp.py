"""Whole-batch text handling on Arrow string buffers with numpy.

The functions below look at all texts of a batch at once: one byte buffer and the offsets of the
texts in it.  No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: ASCII lower-casing of A-Z alone; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased texts.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, _U)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=_U)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``max_bytes`` of ``column``; a longer text is a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffer(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more offset than texts); null is empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a batch of texts: ``starts``, ``ends`` (bytes), ``hashes``; ``first[i]`` is text i's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray, hashed: bool = True, window: int = 1 << 20):
        starts, ends, hashes = [], [], []
        n, at = len(data), 0
        edges = offs[1:-1]
        while at < n:
            to = min(n, at + window)
            if to < n:  # end a window behind a byte that is in no word
                gap = np.flatnonzero(~table[data[at:to]])
                while not len(gap) and to < n:
                    to = min(n, to + window)
                    gap = np.flatnonzero(~table[data[at:to]])
                to = at + int(gap[-1]) + 1 if len(gap) and to < n else to
            part = data[at:to]
            inside = np.zeros(to - at + 2, bool)
            inside[1:-1] = table[part]
            here = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, to, "left")] - at
            cut = np.zeros(to - at + 1, bool)
            cut[here] = True
            begin = inside[1:-1] & (~inside[:-2] | cut[:-1])
            end = inside[1:-1] & (~inside[2:] | cut[1:])
            s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            starts.append(s + at)
            ends.append(e + at)
            if hashed and len(s):
                head = np.zeros(len(part), np.int64)
                head[s] = s
                place = np.arange(len(part)) - np.maximum.accumulate(head)
                place[~inside[1:-1]] = 0
                value = _powers(int((e - s).max()))[place] * (part.astype(_U) + _U(1))
                value[~inside[1:-1]] = 0
                hashes.append(mix(np.add.reduceat(value, s) ^ ((e - s).astype(_U) << _U(48))))
            at = to
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.ends = cat(starts, np.int64), cat(ends, np.int64)
        self.hashes = cat(hashes, _U)
        self.first = np.searchsorted(self.starts, offs)


_STEPS = mix(np.arange(1, 65, dtype=_U) * _U(_BASE)) | _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; fewer words, but not none, are one run."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, _U)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _STEPS[j % 64]
    return mix(total + _U(width))


def as_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
