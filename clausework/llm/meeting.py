"""Pairs of items that share a key, found among packed rows dealt to partitions by key.

A task packs its rows (numpy records with a ``token``, the key) into one block for each bucket of
tokens; Spark deals the blocks, and a partition sorts its rows by token.  Most keys are met by one
item alone and go no further.  Of the others all pairs are tried with what the rows tell, without
texts, and the pairs that stay are few: an item is hardly ever near another one that only shares a
passage with it.

Two kinds of keys are passed on whole, with all their rows, to ``linkage``, where an item meets one
anchor first: those with more than ``TRIED`` trials a row, and those of which more than ``KEPT`` pairs
a row stay (a large class of items that are all near each other).  So the work on a key is in
proportion to its rows, and no pair is lost.  A partition's rows are bounded: beyond ``HELD_BYTES``
the rows of keys with more than ``HOT`` rows are passed on at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

_U = np.uint64
#: Keys of lines with many words: two signatures, words and characters of the line, and the key's place in words.
RUNS = np.dtype([("token", "<u8"), ("node", "<i8"), ("sig", "<i8"), ("more", "<i8"), ("n", "<i4"), ("size", "<i4"), ("place", "<i4")])
#: Keys of short lines: ``own`` ones are the index, the others probe it.
SEGMENTS = np.dtype([("token", "<u8"), ("node", "<i8"), ("sig", "<i8"), ("size", "<i4"), ("own", "?")])
#: Pairs of a key that are tried, and that may stay, for each of its rows.
TRIED, KEPT = 8192, 64
HELD_BYTES, HOT = 64 << 20, 4096


def dealt(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) for each bucket that has rows."""
    bucket = (rows["token"] % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else []
    for a, b in zip(at, [*at[1:], len(rows)], strict=True):
        yield int(bucket[a]), rows[a:b].tobytes()


def _shared(rows: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows whose token others have too, sorted by token and then ``by``, and a number for each token."""
    order = np.argsort(rows["token"])
    token = rows["token"][order]
    same = token[1:] == token[:-1]
    rows = rows[order[np.append(False, same) | np.append(same, False)]] if len(rows) else rows
    rows = rows[np.lexsort([rows[c] for c in (*by[::-1], "token")])]
    if len(rows):
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in ("token", *by):
            new[1:] |= rows[c][1:] != rows[c][:-1]
        rows = rows[new]
    return rows, np.cumsum(np.append(False, rows["token"][1:] != rows["token"][:-1]))[: len(rows)]


def _tried(who: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each item i of ``who`` with the ``count`` items from ``start`` on, in parts of about ``most`` pairs."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        n = count[at:to]
        yield np.repeat(who[at:to], n), np.arange(int(n.sum())) + np.repeat(start[at:to] - (ends[at:to] - n - before), n)
        at = to


def _pairs(node: np.ndarray, token: np.ndarray, who: np.ndarray, start: np.ndarray, count: np.ndarray, tests: list[Callable]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pairs of items that pass one of the tests, and for each test which tokens are passed on instead. A test gives the places of those pairs (i, j) that pass."""
    size, some = np.bincount(token), count > 0
    who, start, count = who[some], start[some], count[some]
    heavy = np.bincount(token[who], count, len(size)) > TRIED * size
    some = ~heavy[token[who]]
    who, start, count = who[some], start[some], count[some]
    stay = [np.zeros(len(size), np.int64) for _ in tests]
    for i, j in _tried(who, start, count):
        for n, test in zip(stay, tests, strict=True):
            np.add.at(n, token[i[test(i, j)]], 1)
    dense = [heavy | (n > KEPT * size) for n in stay]
    some = np.any([(n > 0) & ~d for n, d in zip(stay, dense, strict=True)], axis=0)[token[who]]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _tried(who[some], start[some], count[some]):
        for d, test in zip(dense, tests, strict=True):
            ok = test(i, j)
            ok = ok[~d[token[i[ok]]]]
            one, two = node[i[ok]], node[j[ok]]
            a.append(np.maximum(one, two))
            b.append(np.minimum(one, two))
    return np.concatenate(a), np.concatenate(b), dense


def _alike(node: np.ndarray, *signatures: np.ndarray) -> Callable:
    """Those of the pairs (i, j) at the places ``ok`` that are different items with no more than ``most`` different bits."""
    parts = [np.ascontiguousarray(x).view(_U) for x in signatures]

    def run(i: np.ndarray, j: np.ndarray, ok: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        i, j = i[ok], j[ok]
        bits = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in parts)
        return ok[(bits <= most) & (node[i] != node[j])]

    return run


def run_pairs(rows: np.ndarray, edits: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pairs (a, b) of lines that may link by a shared run, and the rows passed on: for links by words, by characters or both.

    Two linked lines have some shared run at places that differ, counted from the left and from the
    right, by no more than the edits on each side (``reach`` for both kinds of links); an edit of words
    changes two bits of a signature at most, one of characters four (it parts or joins up to three
    words). A line that has a run at several places is one item with the first and the last of them.
    Items of a token are sorted by classes of length, of which two linked lines are in the same or in
    neighbouring ones, and then by place, so that only those near by are tried.
    """
    rows, token = _shared(rows, ("n", "node", "place"))
    head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (rows["node"][1:] != rows["node"][:-1])))[: len(rows)]
    first, last = rows["place"][head].astype(np.int64), rows["place"][np.append(head[1:], len(rows))[: len(head)] - 1].astype(np.int64)
    edges = [0]
    while edges[-1] <= rows["n"].max(initial=0):
        edges.append(edges[-1] + max(edges[-1] // words, 2 * edits, 1))
    step = np.searchsorted(edges, rows["n"][head], "right") - 1
    order = np.lexsort((first, step, token[head]))
    head, first, last, step = head[order], first[order], last[order], step[order]
    of, n, size, node = token[head], rows["n"][head].astype(np.int64), rows["size"][head], rows["node"][head]
    bound, alike = n // words, _alike(node, rows["sig"][head], rows["more"][head])
    reach = np.maximum(bound, 2 * edits)
    key = lambda step, place: (of << 38) + (step << 28) + np.clip(place, 0, (1 << 28) - 1)
    keys, all_ = key(step, first), np.arange(len(of))
    wide = np.zeros(int(of.max(initial=-1)) + 1, np.int64)
    np.maximum.at(wide, of, last - first)
    ranges = [(all_ + 1, np.searchsorted(keys, key(step, last + reach), "right")), (np.searchsorted(keys, key(step + 1, first - reach - wide[of])), np.searchsorted(keys, key(step + 1, last + reach), "right"))]

    def apart(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much longer j is than i, and how far its place is at least from where those words would all stand before or all behind it."""
        more = n[j] - n[i]
        return more, np.maximum(np.maximum(first[j] - last[i] - np.maximum(more, 0), np.minimum(more, 0) - last[j] + first[i]), 0)

    def by_words(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        more, off = apart(i, j)
        e = np.minimum(bound[i], bound[j])
        ok = np.flatnonzero(np.abs(more) + 2 * off <= e)
        return alike(i, j, ok, 2 * e[ok])

    def by_characters(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.flatnonzero(np.abs(size[j] - size[i]) <= edits)
        more, off = apart(i[ok], j[ok])
        return alike(i, j, ok[(np.abs(more) <= 2 * edits) & (off <= 2 * edits)], 4 * edits)

    start, stop = (np.concatenate(x) for x in zip(*ranges, strict=True))
    a, b, (dense, close) = _pairs(node, of, np.append(all_, all_), start, stop - start, [by_words, by_characters])
    on = (dense | close)[token]
    return a, b, rows[on], [dense[token[on]], close[token[on]]]


def segment_pairs(rows: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of lines of which one probes a segment of the other, and the rows passed on. An edit changes two pairs of characters on either side."""
    rows, token = _shared(rows, ("own", "node"))
    # of a token those that probe stand first: each own row is tried with all before it
    who = np.flatnonzero(rows["own"])
    start = np.searchsorted(token, token[who])
    size, node = np.ascontiguousarray(rows["size"]), np.ascontiguousarray(rows["node"])
    alike = _alike(node, rows["sig"])
    near = lambda i, j: alike(i, j, np.flatnonzero(np.abs(size[j] - size[i]) <= edits), 4 * edits)
    a, b, (dense,) = _pairs(node, token, who, start, who - start, [near])
    return a, b, rows[dense[token]]


class Held:
    """Rows of one kind that a partition has so far."""

    def __init__(self, kind: np.dtype):
        self.kind, self.blocks, self.bytes, self.most, self.hot = kind, [], 0, HELD_BYTES, np.zeros(0, _U)

    def add(self, block: bytes) -> np.ndarray:
        """Take a block; gives the rows of keys that have become too large to hold."""
        rows = np.frombuffer(block, self.kind)
        out = [rows[:0]]
        if len(self.hot):
            hot = np.isin(rows["token"], self.hot)
            out.append(rows[hot])
            rows = rows[~hot]
        self.blocks.append(rows)
        self.bytes += rows.nbytes
        if self.bytes > self.most:
            rows = self.rows()
            token, n = np.unique(rows["token"], return_counts=True)
            self.hot = np.union1d(self.hot, token[n > HOT])
            hot = np.isin(rows["token"], self.hot)
            out.append(rows[hot])
            self.blocks = [rows[~hot]]
            self.bytes = self.blocks[0].nbytes
            self.most = max(self.most, 2 * self.bytes)
        return np.concatenate(out)

    def rows(self) -> np.ndarray:
        return np.concatenate(self.blocks) if self.blocks else np.zeros(0, self.kind)
