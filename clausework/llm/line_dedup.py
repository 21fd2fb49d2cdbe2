"""Line deduplication with a segment-partition edit join.

Lines are compared trimmed and with A-Z lower-cased.  Two different lines link when their edit
distance is at most ``edits`` (code points).  A line of length l is cut into ``edits + 1`` segments;
a line within the bound holds one of them unchanged, at a place that is bounded by the segment's
number and the difference of the lengths.  So each line of few words puts its segments into an index by
(length, segment number, substring) and probes the substrings at those places for each length from its
own down to ``edits`` less.  Candidates are verified by banded bit-parallel edit distance.

Long lines also link by words, with a bound that grows with the line: two lines of at least ``words``
words link when the edit distance of their words is at most one for each full ``words`` words of the
shorter.  Such lines share a run of words: in n words, n // 20 edits leave a run of at least
(n - n // 20) / (n // 20 + 1) words, the n-th entry of ``spans``.  Of each so many words in a row the
least hash of the ``RUN``-word runs in them is a key, so a shared span gives a shared key (the least
hash of a long span is also that of the shorter ones in it that hold it) and a line has keys in
proportion to its length.  Words end at white space;
a CJK character is a word of its own.  The same keys find the links by characters between long lines:
an edit of a character changes two words of a line at most (three if the line has CJK characters), so
the other words stand in ``edits + 1`` runs.  Only lines too short for that have segments (``few``).

Keys are packed and dealt to partitions, which try the pairs of each key by size, place and signature
(``meeting``).  What stays is compared once, text by text; keys that large classes share go to
``linkage``.

Of every class of linked or equal lines the first line, by (document id, hash of the whole text, line
number), stays and all others are removed.  Lines shorter than ``min_chars`` are only ever equal, not
near: this is part of the rule, not of the search.  Two edits are over a tenth of a shorter line, and
"Page 1" and "Part 2" are no copies; any value down to ``edits + 1`` is exact.  Blank lines are no
lines and stay.

Defined results: a null or empty text has no lines; a null id sorts first; rows with equal ids (or both without) and
equal texts are one document, so that repeated rows keep the same lines, while different texts with
one id, or without id, each lose their own lines alone; an empty table gives an empty result; only the named columns are
read, all columns are returned by ``deduplicated``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import meeting, textnp
from clausework.llm.linkage import bounded, connected_components, link_components, paired_texts, verify_pairs
from clausework.llm.shared import small_batches, written

EDITS, MIN_CHARS = 2, 20
#: Words for each of which a long line may have one more word edit; no fewer than 4 * RUN.
WORDS = 20
#: Words of a key of long lines; they share at least twice as many in a row.
RUN = 5
#: Longer spans are cut to this, which lines of 20 to 39 words can reach; shorter ones are always right.
MOST_SPAN = 19
#: Bytes of text for each partition of keys, whose rows take about as much; packed rows of a task before they are dealt.
PART_BYTES, PACKED_BYTES = 4 << 20, 4 << 20
#: Characters of a gram in the finer keys of crowded segments.
GRAM = 4
#: Grams of an anchor of which the count is told to each of its lines: fewer than this, the most frequent ones.
MOST_GRAMS = 2048
#: Words of a gram in the finer keys of long lines.
WORD_GRAM = 2
_CJK = "\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD, _PLAIN = re.compile(f"[{_CJK}]|[^ \t\n\x0b\x0c\r{_CJK}]+"), re.compile("[^ \t\n\x0b\x0c\r]+")
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64."""
    if base not in _TABLES or len(_TABLES[base]) < n:
        p = np.full(max(n, 1 << 16), base, _U)
        p[0] = 1
        _TABLES[base] = np.cumprod(p, dtype=_U)
    return _TABLES[base]


def _blank(points: np.ndarray) -> np.ndarray:
    """Whether each code point is white space."""
    return (points == 32) | (points <= 13) & (points >= 9)


class Lines:
    """The lines of a batch of texts with a word in them, trimmed and lower-cased.

    ``first`` and ``end`` are places among the code points ``points``; ``doc`` and ``number`` say
    where the line stands (numbers count all lines of the text from 0).
    """

    def __init__(self, col: pa.Array):
        data, offs = textnp.buffer(col)
        low = textnp.LOWER[data]
        lead = (low & 0xC0) != 0x80
        points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) == int(lead.sum()):
            offs = np.concatenate([[0], np.cumsum(lead)])[offs]
        else:  # not UTF-8: bytes are the characters
            points = low.astype(np.uint32)
        self.points = points
        breaks = np.flatnonzero(points == 10)
        docs = np.searchsorted(offs, breaks, "right") - 1
        begin = np.concatenate([offs[:-1], breaks + 1])
        owner = np.concatenate([np.arange(len(offs) - 1), docs])
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        new = np.searchsorted(owner, np.arange(len(offs) - 1))
        number = np.arange(len(begin)) - new[owner]
        stop = np.append(breaks, len(points))[np.searchsorted(breaks, begin)]
        stop = np.minimum(stop, offs[owner + 1])
        solid = np.flatnonzero(~_blank(points))
        a, b = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
        some = a < b
        self.first, self.end = solid[a[some]], solid[b[some] - 1] + 1
        self.doc, self.number = owner[some], number[some]

    def spans(self, most: int = 1 << 20) -> Iterator[tuple[int, int, "Hashes"]]:
        """Runs of lines [i, j) with a hasher; a run spans about ``most`` code points."""
        i, n = 0, len(self.first)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + most)))
            yield i, j, Hashes(self.points[self.first[i] : self.end[j - 1]], self.first[i])
            i = j


class Hashes:
    """64-bit hashes of any substrings of a run of code points."""

    def __init__(self, points: np.ndarray, base: int):
        self.base = base
        self.back = _table(_BACK, len(points) + 1)
        self.sums = np.zeros(len(points) + 1, _U)
        np.cumsum((points.astype(_U) + _U(1)) * _table(_BASE, len(points) + 1)[: len(points)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a - self.base, b - self.base
        return textnp.mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(_U))


def line_hashes(lines: Lines) -> np.ndarray:
    parts = [h.of(lines.first[i:j], lines.end[i:j]) for i, j, h in lines.spans()]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def keys(hashes: Hashes, first: np.ndarray, end: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, in the index) of the given lines, all at least edits + 1 long.

    Place p of segment i of a line of length l is kept if it is within i edits from the left and
    within edits - i from the right end; the place that is the line's own segment is its index key.
    """
    size, parts = end - first, edits + 1
    line, key, own = [], [], []
    for less in range(edits + 1):
        length = size - less
        long = length % parts
        short = length // parts
        for i in range(parts):
            # the last `long` segments have one character more
            extra = np.maximum(0, i - (parts - long))
            place = i * short + extra
            width = short + (i >= parts - long)
            low = np.maximum(np.maximum(0, place - i), place + less - (edits - i))
            high = np.minimum(np.minimum(size - width, place + i), place + less + (edits - i))
            for step in range(2 * edits + 1):
                at = low + step
                ok = np.flatnonzero((at <= high) & (width > 0) & (length >= parts))
                if not len(ok):
                    break
                a = first[ok] + at[ok]
                key.append(textnp.mix(hashes.of(a, a + width[ok]) ^ textnp.mix(length[ok].astype(_U) * _U(64) + _U(i))))
                line.append(ok)
                own.append(at[ok] == place[ok] if less == 0 else np.zeros(len(ok), bool))
    if not key:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(line), np.concatenate(key).view(np.int64), np.concatenate(own)


def _head(a: str | list, b: str | list) -> int:
    """How many units a and b begin with in common."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


@functools.lru_cache(maxsize=256)
def _words(text: str) -> list[str]:
    """The words of a line; one without CJK characters needs no ranges."""
    return (_PLAIN if text.isascii() or max(text) < "\u2e80" else _WORD).findall(text)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most ``edits``: banded, one bit for each row of the band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    head = _head(a, b)
    a, b = a[head:], b[head:]
    tail = _head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not b:
        return len(a) <= edits
    width, m, n = 2 * edits + 1, len(a), len(b)
    ones, corner = (1 << width) - 1, 1 << (width - 1)
    up, down, distance, side = ones << edits & ones, 0, edits, corner >> 1
    for j in range(n):
        same = 0
        for row in range(max(0, j - edits), min(m, j + edits + 1)):
            if a[row] == b[j]:
                same |= 1 << (row - j + edits)
        zero = ((((same & up) + up) ^ up) | same | down) & ones
        right, left = (down | ~(zero | up)) & ones, zero & up
        if j + edits < m:  # along the lower edge of the band
            distance += not zero & corner
        else:  # along the last row
            distance += bool(right & side) - bool(left & side)
            side >>= 1
        if distance > 2 * edits + 1 + m - n:
            return False
        up, down = (left | ~(zero >> 1 | right)) & ones, zero >> 1 & right
    return distance <= edits


@functools.cache
def spans(words: int, most: int) -> np.ndarray:
    """For lines of 0 .. most words, how many words in a row each link of theirs surely leaves."""
    n = np.arange(most + 1)
    left = -(-(n - n // words) // (n // words + 1))
    # the shorter line of a link has as many words, or one less for each edit
    out = left.copy()
    for less in range(1, most // words + 1):
        ok = np.flatnonzero(n // words >= less)
        out[ok] = np.minimum(out[ok], left[ok - less])
    return out


def few(edits: int, words: int) -> int:
    """From so many words on lines also link by characters through their runs. Two lines within the edits differ by 2 * edits words at most, so those of less than that more have segments."""
    return max(words, 3 * edits + (edits + 1) * (RUN - 1) + 1)


def word_keys(hashes: Hashes, points: np.ndarray, first: np.ndarray, end: np.ndarray, words: int, edits: int) -> tuple[np.ndarray, ...]:
    """Words of each of the given lines, two signatures, and the keys (line, key, place of the key's first word) of those with at least ``words`` words.

    Each different word has a bit in one of the signatures: an edit changes two bits at most.
    """
    base = hashes.base
    part = points[base : base + len(hashes.sums) - 1]
    solid = ~_blank(part)
    # a word begins at a character behind white space or beside a CJK one, and with each line, as nothing parts two texts
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    alone = np.zeros(0, np.int64)
    high = np.flatnonzero(part >= 0x2E80)
    if len(high):
        c = part[high]
        alone = high[(c <= 0xD7FF) | (c >= 0xF900) & (c <= 0xFAFF) | (c >= 0x20000) & (c <= 0x3FFFF)]
        begin[alone] = True
        after = alone[alone + 1 < len(part)] + 1
        begin[after] = solid[after]
    begin[first - base] = True
    starts = np.flatnonzero(begin)
    # a word ends before white space or the next word
    stop = ~solid
    stop[starts] = True
    stop = np.append(np.flatnonzero(stop), len(part))
    ends = stop[np.searchsorted(stop, starts, "right")] + base
    starts += base
    line = np.searchsorted(first, starts, "right") - 1
    inside = (line >= 0) & (starts < end[line])
    starts, ends, line = starts[inside], np.minimum(ends[inside], end[line[inside]]), line[inside]  # a text's end need not part words
    n = np.bincount(line, minlength=len(first))
    long = n[line] >= words
    starts, ends, line = starts[long], ends[long], line[long]
    signatures = np.zeros((2, len(first)), _U)
    if len(starts) < 2 * RUN:
        return n, signatures.view(np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    each = hashes.of(starts, ends)
    bits = _U(1) << (each >> _U(8) & _U(63))
    heads = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    for k in range(2):
        signatures[k, line[heads]] = np.bitwise_or.reduceat(np.where(each & _U(1) == k, bits, _U(0)), heads)
    place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    grams = textnp.shingles(each, RUN)
    wide = spans(words, 1 << int(n.max()).bit_length())[n]  # words of each line's spans
    cjk = np.zeros(len(first), bool)
    cjk[np.maximum(np.searchsorted(first, alone + base, "right") - 1, 0)] = True
    runs = -(-(n - np.where(cjk, 3, 2) * edits) // (edits + 1))
    wide = np.where((n >= few(edits, words)) & (n < 3 * edits * (words + 1)), np.minimum(wide, runs), wide)
    size = np.minimum(wide, MOST_SPAN)[line] - RUN + 1  # runs in each of them
    # least[k] has where the first least of 2 ** k runs in a row is; two of these cover any span
    least = [np.arange(len(grams))]
    while 2 << len(least) - 1 <= MOST_SPAN - RUN + 1:
        one, step = least[-1], 1 << len(least) - 1
        a, b = one[:-step], one[step:]
        least.append(np.where(grams[a] <= grams[b], a, b))
    at = np.flatnonzero(place[: len(grams)] + size[: len(grams)] + RUN - 1 <= n[line[: len(grams)]])
    level = np.log2(size[at]).astype(np.int64)
    found = np.zeros(len(grams), bool)
    for k, table in enumerate(least):
        x = at[level == k]
        a, b = table[x], table[x + size[x] - (1 << k)]
        found[np.where(grams[a] <= grams[b], a, b)] = True
    at = np.flatnonzero(found)
    return n, signatures.view(np.int64), line[at], grams[at], place[at]


def words_within(a: list[str], b: list[str], words: int) -> bool:
    """Whether the edit distance of two lists of words is at most one for each ``words`` words of the shorter: bit-parallel, one bit for each word of a."""
    edits = min(len(a), len(b)) // words
    if not edits or abs(len(a) - len(b)) > edits:
        return False
    one, two = set(a), set(b)
    if len(one - two) > edits or len(two - one) > edits:
        return False
    head = _head(a, b)
    a, b = a[head:], b[head:]
    tail = _head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    if len(a) == len(b) and sum(map(operator.ne, a, b)) <= edits:
        return True
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    ones, corner = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = ones, 0, len(a)
    for j, w in enumerate(b, 1):
        same = places.get(w, 0)
        zero = (((same & up) + up) ^ up) | same
        right, left = (down | ~(zero | up)) & ones, up & zero
        distance += bool(right & corner) - bool(left & corner)
        if distance - (len(b) - j) > edits:
            return False
        right, side = right << 1 | 1, same | down
        up, down = (left << 1 | ~(side | right)) & ones, right & side & ones
    return distance <= edits


def _signatures(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A bit for each of about a quarter of a line's different pairs of characters."""
    size = end - first - 1
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(first - (ends - size), size)
    pair = textnp.mix(points[at].astype(_U) << _U(32) | points[at + 1].astype(_U))
    bits = np.where(pair & _U(3) == 0, _U(1) << (pair >> _U(8) & _U(63)), _U(0))
    return np.bitwise_or.reduceat(bits, ends - size) if len(bits) else np.zeros(len(first), _U)


#: Rows of documents (kind 0, with their lines), pairs (1) and keys that are passed on (2: segments, 3: runs).
_FOUND = "kind int, key bigint, version bigint, lines array<struct<hash:bigint,number:int,size:int>>, token bigint, node bigint, n int, size int, place int, sig bigint, by_words boolean, by_characters boolean"
_LINE = pa.struct([("hash", pa.int64()), ("number", pa.int32()), ("size", pa.int32())])
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("version", pa.int64()), ("lines", pa.list_(_LINE)), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("place", pa.int32()), ("sig", pa.int64()), ("by_words", pa.bool_()), ("by_characters", pa.bool_())])
_DEALT = "bucket int, kind int, key bigint, version bigint, lines array<struct<hash:bigint,number:int,size:int>>, block binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("version", pa.int64()), ("lines", pa.list_(_LINE)), ("block", pa.binary())])


def _rows(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """n rows of a schema; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in schema], schema=schema)


def _lines(edits: int, min_chars: int, words: int, buckets: int):
    """A row for each text with its lines, and packed keys of the lines, the first of equal ones in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {2: meeting.SEGMENTS, 3: meeting.RUNS}
        packed: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
        texts = 0

        def deal() -> Iterator[pa.RecordBatch]:
            for kind, rows in packed.items():
                if rows:
                    bucket, blocks = zip(*meeting.dealt(np.concatenate(rows), buckets), strict=True)
                    rows.clear()
                    yield _rows(_DEALT_ARROW, len(bucket), bucket=bucket, kind=np.full(len(bucket), kind), block=pa.array(blocks, pa.binary()))

        def pack(kind: int, token: np.ndarray, **columns: np.ndarray) -> None:
            if len(token):
                out = np.empty(len(token), kinds[kind])
                out["token"] = token
                for c, x in columns.items():
                    out[c] = x
                packed[kind].append(out)

        for batch in textnp.slices(batches, "__text", 1 << 18):
            lines = Lines(batch.column("__text"))
            nodes = [np.zeros(0, np.int64)]
            for i, j, hashes in lines.spans():
                first, end = lines.first[i:j], lines.end[i:j]
                node, size = hashes.of(first, end).view(np.int64), end - first
                nodes.append(node)
                some = np.flatnonzero(size >= min_chars)
                once = np.sort(some[np.unique(node[some], return_index=True)[1]])
                if not len(once):
                    continue
                first, end, node, size = first[once], end[once], node[once], size[once]
                n, signatures, long, word, place = word_keys(hashes, lines.points, first, end, words, edits)
                pack(3, word, node=node[long], sig=signatures[0, long], more=signatures[1, long], n=n[long], size=size[long], place=place)
                pick = np.flatnonzero(n < few(edits, words) + 2 * edits)
                line, key, own = keys(hashes, first[pick], end[pick], edits)
                signature = _signatures(lines.points, first[pick], end[pick])
                pack(2, key, node=node[pick[line]], sig=signature[line].view(np.int64), size=size[pick[line]], own=own)
            ends = np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(nodes)), pa.array(lines.number, pa.int32()), pa.array(lines.end - lines.first, pa.int32())], fields=list(_LINE))
            yield _rows(_DEALT_ARROW, batch.num_rows, bucket=(np.arange(batch.num_rows) + texts) % buckets, kind=np.zeros(batch.num_rows, np.int32), key=batch.column("__key"), version=batch.column("__version"), lines=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each))
            texts += batch.num_rows
            if sum(x.nbytes for rows in packed.values() for x in rows) > PACKED_BYTES:
                yield from deal()
        yield from deal()

    return run


def _meet(edits: int, words: int):
    """Rows of documents as they come, pairs of lines that may link, and the keys that large classes share."""

    def passed(kind: int, rows: np.ndarray, by_words: np.ndarray, by_characters: np.ndarray) -> pa.RecordBatch:
        more = {c: np.ascontiguousarray(rows[c]) for c in (("n", "place") if kind == 3 else ())}
        return _rows(_FOUND_ARROW, len(rows), kind=np.full(len(rows), kind), token=rows["token"].view(np.int64), node=np.ascontiguousarray(rows["node"]), size=np.ascontiguousarray(rows["size"]), sig=np.ascontiguousarray(rows["sig"]), by_words=by_words, by_characters=by_characters, **more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {2: meeting.Held(meeting.SEGMENTS), 3: meeting.Held(meeting.RUNS)}

        def both(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                yield passed(kind, rows, rows["own"] if kind == 2 else np.ones(len(rows), bool), np.ones(len(rows), bool))

        for batch in batches:
            texts = batch.filter(pa.compute.equal(batch.column("kind"), 0))
            yield _rows(_FOUND_ARROW, texts.num_rows, **{c: texts.column(c) for c in ("kind", "key", "version", "lines")})
            blocks = batch.filter(pa.compute.greater(batch.column("kind"), 0))
            for kind, block in zip(blocks.column("kind").to_pylist(), blocks.column("block"), strict=True):
                yield from both(kind, held[kind].add(block.as_buffer()))
        one, two, rows = meeting.segment_pairs(held.pop(2).rows(), edits)
        yield from both(2, rows)
        a, b, rows, dense = meeting.run_pairs(held.pop(3).rows(), edits, words)
        if len(rows):
            yield passed(3, rows, *dense)
        pairs = np.unique(np.stack([np.append(one, a), np.append(two, b)]), axis=1)
        yield _rows(_FOUND_ARROW, pairs.shape[1], kind=np.ones(pairs.shape[1], np.int32), token=pairs[1], node=pairs[0])

    return run


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of wanted lines: rows hold a document and the hashes wanted from it."""
    for batch in textnp.slices(batches, "__text", 1 << 18):
        lines = Lines(batch.column("__text"))
        node = line_hashes(lines)
        at = np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
        out_node, out_text = [], []
        for d, wanted in enumerate(batch.column("wanted").to_pylist()):
            left = set(wanted)
            for x in range(at[d], at[d + 1]):
                if (h := int(node[x])) in left:
                    left.discard(h)
                    out_node.append(h)
                    out_text.append(lines.points[lines.first[x] : lines.end[x]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_text, pa.string())], names=["node", "text"])


def _digest(h: int, kind: int, data: bytes) -> int:
    """A 64-bit key of an anchor, a kind and a piece of text."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=h.to_bytes(8, "little", signed=True), person=kind.to_bytes(2, "little")).digest(), "little", signed=True)


def _apart(places: Iterable[int], gram: int = GRAM) -> int:
    """The fewest edits that change all these places of a line."""
    n, free = 0, None
    for p in sorted(places):
        if free is None or p >= free:
            n, free = n + 1, p + gram
    return n


def _first_grams(places: list[tuple], edits: int, gram: int) -> int:
    """How many of the ordered places (gram, place) make the shortest run of first grams that so many edits cannot change together; else all."""
    need = lambda n: _apart((p for _, p in places[:n]), gram)
    n = bisect.bisect_right(range(len(places) + 1), edits, key=need)
    while n < len(places) and places[n][0] == places[n - 1][0]:
        n += 1
    return min(n, len(places))


def _near(places: list[int], gram: int, size: int) -> list[int]:
    """The units of a line that lie in the grams at these places."""
    return sorted({x for p in places for x in range(max(p, 0), min(p + gram, size))})


def _without(units: list[str] | str, gone: tuple[int, ...]) -> str:
    """A line's text without some of its units."""
    cuts = zip((-1, *gone), (*gone, len(units)), strict=True)
    return "\r".join(x for a, b in cuts for x in (units[a + 1 : b] if isinstance(units, list) else (units[a + 1 : b],)))


def _grams(units: list[str] | str, gram: int) -> list[bytes]:
    """The grams of a line with blanks at both ends; place p of the list's entry p + gram - 1."""
    padded = ["\n"] * (gram - 1) + list(units) + ["\n"] * (gram - 1)
    return ["\r".join(padded[i : i + gram]).encode("utf-8", "surrogatepass") for i in range(len(units) + gram - 1)]


def _beyond(by_words: bool):
    """Of each line its places whose grams the anchor lacks, with those grams."""
    gram = WORD_GRAM if by_words else GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, "q_text", 1 << 20):
            split, out, last, known = _WORD.findall if by_words else str, [], None, set()
            for h, a, b in zip(*(batch.column(c).to_pylist() for c in ("h", "q_text", "h_text")), strict=True):
                if last != h:
                    last, known = h, set(_grams(split(b), gram))
                out.append([{"gram": int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "little", signed=True), "pos": i - gram + 1} for i, g in enumerate(_grams(split(a), gram)) if g not in known])
            kind = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("h"), batch.column("q_text"), pa.array(out, kind)], names=["node", "h", "text", "grams"])

    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, gram, n) of grams that a batch has twice or more, counted before anything is shuffled; lines of one anchor come together.

    The counts only order the grams of an anchor and say which are common, so that what a batch has
    once need not count: any order and any set of common grams gives the same links.
    """
    for batch in batches:
        lists = batch.column("grams")
        t = pa.table({"h": batch.column("h").take(pa.compute.list_parent_indices(lists)), "gram": lists.flatten().field("gram")})
        t = t.group_by(["h", "gram"]).aggregate([("gram", "count")]).select(["h", "gram", "gram_count"]).rename_columns(["h", "gram", "n"])
        t = t.filter(pa.compute.greater(t["n"], 1))
        yield from t.combine_chunks().to_batches()


def _keyed(edits: int, words: int, by_words: bool):
    """Keys of each line, and the edits that change all its places, as its rank; see ``refine``."""
    gram = WORD_GRAM if by_words else GRAM

    def bounds(n: int) -> list[int]:
        """The bounds of a line's pairs; by words that is of the shorter line."""
        return [e for e in range((n - n // words) // words, n // words + 1) if e] if by_words else [edits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, "text", 1 << 20):
            split = _WORD.findall if by_words else str
            out: list[list[list[int]]] = [[], [], []]
            ranks = []
            lists, last, often = batch.column("common"), None, {}
            for i, (h, text, grams, most) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "text", "grams", "most")), strict=True)):
                if h != last:  # an anchor's lines have one list and mostly stand together
                    common = lists[i].values
                    last, often = h, dict(zip(*(common.field(c).to_pylist() for c in ("gram", "n")), strict=True)) if common else {}
                key = lambda *x, h=h: int.from_bytes(hashlib.blake2b("\r".join(map(str, x)).encode("utf-8", "surrogatepass"), digest_size=8, key=h.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                units = split(text)
                n = len(units)
                places = sorted(((often.get(x["gram"], 0), x["gram"]), x["pos"]) for x in grams if often.get(x["gram"], 0) <= most)
                at = sorted(p for _, p in places)
                need, top = _apart(at, gram), bounds(n)[-1]
                ranks.append(need)
                near = _near(at, gram, n)
                first = lambda e: {key(0, g) for (_, g), _ in places[: _first_grams(places, e, gram)]}
                both, own, asks = set(), set(), set()
                if top < 3 and len(near) <= top * (2 * gram - 1):
                    own |= first(top)
                    asks |= first(top - 1)
                else:
                    both |= first(top)
                for e in bounds(n):
                    step, reach = e // 2 + 1, gram - 1 + e
                    if e < 3 and len(near) <= e * (2 * gram - 1):
                        both.update(key(1, e, _without(units, gone)) for size in range(e + 1) for gone in itertools.combinations(near, size))
                    if need > e:
                        continue
                    if e > 2:
                        both.update(key(1, e, x // (4 * reach)) for p in at for x in (p - reach, p, p + reach))
                    if e == 2:  # with more, the keys above find what has a changed place in common
                        own.update(key(2, e, p // reach) for p in at)
                        if need < e:
                            asks.update(key(2, e, p // reach + i) for p in at for i in (-1, 0, 1))
                    own.add(key(3, e, need, n // step))
                    asks.update(key(3, e, j, x // step) for j in range(e - need + 1) for x in range(n - e, n + e + 1, step))
                    asks.update(key(3, e, j, (n + e) // step) for j in range(e - need + 1))
                for column, values in zip(out, (both, own, asks), strict=True):
                    column.append(list(values))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("h"), pa.array(ranks, pa.int32()), *(pa.array(c, pa.list_(pa.int64())) for c in out)], names=["node", "h", "rank", "both", "own", "asks"])

    return run


def _marked(df: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with their lines (key, version, lines), the places of lines that come twice or may link (key, version, number, size, hash), and for each line of which some place goes its first place and that of its class (hash, at, top)."""
    if words < 4 * RUN:
        raise ValueError(f"words must be at least {4 * RUN}: shorter lines need not share {2 * RUN} words in a row")
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    parts = -(-(rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 1) // PART_BYTES)
    parsed = rows.withColumn("__version", F.xxhash64("__text")).mapInArrow(_lines(edits, max(min_chars, edits + 1), words, 4 * parts), _DEALT)
    found = written(parsed.repartition(parts, "bucket").mapInArrow(_meet(edits, words), _FOUND), "found")
    docs = found.where("kind = 0").select("key", "version", "lines")
    lines = docs.select("key", "version", F.explode("lines").alias("x")).select("key", "version", F.col("x.number").cast("bigint").alias("number"), F.col("x.size").cast("bigint").alias("size"), "x.hash")
    pairs = found.where("kind = 1").select(F.col("node").alias("q"), F.col("token").alias("h")).distinct()
    passed = found.where("kind > 1")
    many = {(r.kind, r.by_words, r.by_characters) for r in passed.select("kind", "by_words", "by_characters").distinct().collect()}
    pairs = written(pairs, "pairs")
    near = pairs.select(F.explode(F.array("q", "h")).alias("hash"))
    near = written((near.union(passed.select("node")) if many else near).distinct(), "near")
    again = docs.select(F.explode("lines.hash").alias("hash")).groupBy("hash").count().where("count > 1").select("hash")
    wanted = written(again.union(near).distinct(), "wanted")
    held = written(lines.join(bounded(wanted, wanted.count()), "hash").select("key", "version", "number", "size", "hash"), "held")
    firsts = written(held.groupBy("hash").agg(F.min(F.struct("key", "version", "number")).alias("at"), F.min("key").alias("known"), F.count("*").alias("n")), "firsts")

    def read() -> DataFrame:
        """(node, text) of the lines in ``near``: one document that holds the line is read, that with the smallest id, or of those without id one by its text's hash."""
        where = firsts.join(near, "hash")
        named = written(where.groupBy(F.col("known").alias("__key"), F.when(F.col("known").isNull(), F.col("at.version")).alias("v")).agg(F.collect_set("hash").alias("wanted")), "readers")
        n = named.count()
        held = rows.join(bounded(named.where("__key IS NOT NULL").select("__key", "wanted"), n), "__key").select("__text", "wanted")
        if not named.where("__key IS NULL").isEmpty():
            free = rows.where("__key IS NULL").withColumn("v", F.xxhash64("__text"))
            held = held.union(free.join(bounded(named.where("__key IS NULL").select("v", "wanted"), n), "v").dropDuplicates(["v"]).select("__text", "wanted"))
        return held.mapInArrow(_find, "node bigint, text string").dropDuplicates(["node"])

    known = written(read(), "texts")

    def texts(ids: DataFrame, n: int) -> DataFrame:
        """Texts by line."""
        return ids.join(known.toDF("node", "text"), "node")

    def apart(crowded: DataFrame) -> DataFrame:
        """Rows of common runs by the line's length and the run's place in it, neither of which differs by more than the edits."""
        n, at = F.col("n"), F.col("place")
        bounds = F.filter(F.sequence(F.floor((n - F.floor(n / words)) / words), F.floor(n / words)), lambda e: e > 0)
        rows = crowded.withColumn("place", F.explode("places")).withColumn("e", F.explode(bounds)).withColumn("w", 2 * F.col("e") + 1)
        e, w = F.col("e"), F.col("w")
        cell = lambda x, y, ix=False: F.struct(F.floor(x / w).alias("i"), F.floor(y / w).alias("j"), F.lit(ix).alias("ix"))
        rows = rows.withColumn("c", F.explode(F.array(cell(n, at, True), *[cell(x, y) for x in (n - e, n + e) for y in (at - e, at + e)])))
        return rows.select(F.xxhash64("token", "e", "c.i", "c.j").alias("token"), "node", "n", F.col("c.ix").alias("ix"), (~F.col("c.ix")).alias("asks"), F.lit(False).alias("mutual"), "h", "component", "sig").distinct()

    def compare(one: pa.Array, two: pa.Array) -> list[bool]:
        return [within(a, b, edits) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)]

    def first_link(ids: list[int], one: pa.ChunkedArray, others: list[int], two: pa.ChunkedArray) -> tuple[list[int], list[int]]:
        members = list(zip(others, two.to_pylist(), strict=True))
        a, b = [], []
        for q, text in zip(ids, one.to_pylist(), strict=True):
            link = next((m for m, other in members if m != q and within(text, other, edits)), None)
            if link is not None:
                a.append(q)
                b.append(link)
        return a, b

    def compare_all(one: pa.Array, two: pa.Array) -> list[bool]:
        return [within(a, b, edits) or words_within(_words(a), _words(b), words) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)]

    def compare_words(one: pa.Array, two: pa.Array) -> list[bool]:
        return [words_within(_words(a), _words(b), words) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)]

    def first_word_link(ids: list[int], one: pa.ChunkedArray, others: list[int], two: pa.ChunkedArray) -> tuple[list[int], list[int]]:
        members = [(m, _words(text)) for m, text in zip(others, two.to_pylist(), strict=True)]
        a, b = [], []
        for q, text in zip(ids, one.to_pylist(), strict=True):
            own = _words(text)
            link = next((m for m, other in members if m != q and words_within(own, other, words)), None)
            if link is not None:
                a.append(q)
                b.append(link)
        return a, b

    def refine(pairs: DataFrame, by_words: bool = False) -> tuple[DataFrame, DataFrame]:
        """Keys from what a line has beyond its anchor, and the table they are made from.

        A place of a line is beyond if its gram is neither in the anchor nor common among the
        anchor's lines (which are padded at both ends).  An edit changes as many neighbouring places
        as a gram has units.  Let the beyond grams of each line stand in one fixed order, those that
        are frequent among the anchor's lines last.  If two linked lines share a beyond gram that the
        edits leave, those before the first such gram are all changed by the edits, so both lines
        have it among the shortest run of first grams whose places so many edits cannot change
        together; these are keys (0).

        Lines with few beyond places and up to two edits need fewer: if each edit changes a beyond
        place in both lines, the lines are equal without some of the units there, and a line's text
        without each such set is a key (1).  Else a line in which one edit changes no beyond place
        asks with the grams that one edit less cannot change.

        Lines that share no such gram are changed at all their beyond places; the number of edits
        that this takes is a line's rank.  If an edit changes a beyond place in both, these lie near
        each other (keys 2, or 1 for more than two edits), and of two edits the other is missed by
        one line, so its rank is lower.  If none does, the ranks add up to the edits at most (key 3,
        with the length).  Such lines mostly link to the line of the lowest rank, with which they
        are compared first.
        """
        schema = "node bigint, h bigint, rank int, both array<bigint>, own array<bigint>, asks array<bigint>"
        beyond = written(paired_texts(pairs, texts).mapInArrow(_beyond(by_words), "node bigint, h bigint, text string, grams array<struct<gram:bigint,pos:int>>"), "grams")
        often = beyond.select("h", "grams").mapInArrow(_gram_counts, "h bigint, gram bigint, n bigint").groupBy("h", "gram").agg(F.sum("n").alias("n"))
        many = beyond.groupBy("h").agg(F.greatest(F.lit(8), F.count("*") / 8).alias("most"), (F.sum(F.size("grams")) / MOST_GRAMS).alias("some"))
        common = often.join(many, "h").where("n > 8 AND n > some").groupBy("h").agg(F.collect_list(F.struct("gram", "n")).alias("common"), F.first("most").alias("most"))
        lists = beyond.join(common, "h", "left").select("h", "node", "text", "grams", "common", F.coalesce("most", F.lit(8.0)).alias("most"))
        return lists.mapInArrow(_keyed(edits, words, by_words), schema), beyond

    n, hn, lo, hi = (F.col(x) for x in ("n", "hn", "lo", "hi"))
    sides = [written(verify_pairs(pairs, texts, compare_all), "links")]
    if any(kind == 2 for kind, _, _ in many):
        postings = found.where("kind = 2").select("token", "node", F.col("by_words").alias("own"), F.lit(0).alias("n"))
        linked = link_components(postings, texts, compare, first_link, F.lit(True), None, "own", refine)
        sides.append(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    if any(kind == 3 and c for kind, _, c in many):
        postings = found.where("kind = 3 AND by_characters").select("token", "node", F.col("size").alias("n"))
        linked = link_components(postings, texts, compare, first_link, F.abs(n - hn) <= edits, (n >= lo - edits) & (n <= hi + edits), None, refine)
        sides.append(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    if any(kind == 3 and w for kind, w, _ in many):
        runs = found.where("kind = 3 AND by_words").select("token", "node", F.col("n").cast("bigint").alias("n"), F.array("place").alias("places"), "sig")
        # lengths that can link differ by one for each `words` words of the shorter
        fits = lambda a, b: b - a <= F.floor(a / words)
        # an edit changes two bits of a signature at most; a key's group of one signature is judged by it
        sig, one, two = (F.col(x) for x in ("sig", "one", "two"))
        close = lambda a, b, x, y: F.bit_count(x.bitwiseXOR(y)) <= 2 * F.floor(F.least(a, b) / words)
        alone = fits(n, lo) & fits(hi, n) & ((one != two) | close(n, hi, sig, one))
        linked = link_components(runs, texts, compare_words, first_word_link, fits(n, hn) & fits(hn, n) & close(n, hn, sig, F.col("hsig")), fits(n, lo) & fits(hi, n), None, lambda pairs: refine(pairs, True), apart, alone)
        sides.append(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    linked = connected_components(functools.reduce(DataFrame.union, sides))
    classed = linked.join(firsts, linked.node == firsts.hash).select("node", "component", "at")
    tops = classed.groupBy("component").agg(F.min("at").alias("top"))
    tops = classed.join(tops, "component").select("node", "top")
    # lines that come once and link to none stay; only the others are looked up
    marks = firsts.join(tops, firsts.hash == tops.node, "left").where("n > 1 OR NOT top <=> at AND top IS NOT NULL").select("hash", "at", F.coalesce("top", "at").alias("top"))
    return docs, held, written(marks, "marks")


def _judged(lines: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    here = F.struct("key", "version", "number")
    first = F.col("at").isNull() | here.eqNullSafe(F.col("at"))
    found = lines.join(bounded(marks, marks.count()), "hash", how)
    return found.select("key", "version", "number", "size", (~first).alias("exact"), (first & ~F.col("at").eqNullSafe(F.col("top"))).alias("near"), F.coalesce("top", here).alias("top"))


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, words: int = WORDS) -> DataFrame:
    """One row per line with a word: key, version (hash of the whole text), number, size, ``exact`` and ``near`` (either removes it), and ``top``, the first line of its class."""
    docs, _, marks = _marked(df, id_col, text_col, edits, min_chars, words)
    lines = docs.select("key", "version", F.explode("lines").alias("x")).select("key", "version", F.col("x.number").cast("bigint").alias("number"), F.col("x.size").cast("bigint").alias("size"), "x.hash")
    return _judged(lines, marks, "left")


def _removed(held: DataFrame, marks: DataFrame) -> DataFrame:
    """The decisions on removed lines alone, once for each text that several rows have."""
    return _judged(held, marks, "inner").where("exact OR near").dropDuplicates(["key", "version", "number"])


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, words: int = WORDS) -> DataFrame:
    """One row per input row: lines, lines removed as equal or near, characters that stay, and for each removed line its number and the id and line number of its class's first line."""
    docs, held, marks = _marked(df, id_col, text_col, edits, min_chars, words)
    removed = F.struct("number", F.col("top.key").alias("first_id"), F.col("top.number").alias("first_number"))
    per = _removed(held, marks).groupBy(F.col("key").alias("__key"), F.col("version").alias("__version")).agg(F.count_if("exact").alias("n_exact"), F.count_if("near").alias("n_near"), F.sum("size").alias("cut"), F.sort_array(F.collect_list(removed)).alias("gone"))
    docs = docs.select("key", "version", F.size("lines").alias("n_lines"), F.aggregate("lines.size", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    lists = [F.coalesce(F.col(f"gone.{c}"), F.array().cast("array<bigint>")).alias(name) for c, name in (("number", "removed_lines"), ("first_id", "first_ids"), ("first_number", "first_lines"))]
    rows = docs.join(per, docs["key"].eqNullSafe(per["__key"]) & (docs["version"] == per["__version"]), "left").withColumn("kept_chars", F.col("chars") - F.coalesce("cut", F.lit(0)))
    return rows.select(F.col("key").alias(id_col), *(zero(c) for c in ("n_lines", "n_exact", "n_near", "kept_chars")), *lists)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, words: int = WORDS, count_col: str | None = None) -> DataFrame:
    """The rows of ``df`` with removed lines cut from their texts; ``count_col`` adds how many were cut."""
    _, held, marks = _marked(df, id_col, text_col, edits, min_chars, words)
    gone = _removed(held, marks).groupBy(F.col("key").alias("__key"), F.col("version").alias("__version")).agg(F.collect_set("number").alias("__gone"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).cast("bigint").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__text_hash"))
    joined = rows.join(gone, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__text_hash") == F.col("__version")), "left")
    text = F.col(f"__row.`{text_col}`").cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i.cast("bigint"))), "\n")
    new = F.when(F.col("__gone").isNull(), text).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns], *([F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias(count_col)] if count_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
