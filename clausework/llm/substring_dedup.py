"""Removal of repeated word runs by prefix-partitioned suffix trees.

A suffix starts at every word that has ``window`` words to its end.  Its dealing prefix decides which
group it goes to, so equal runs of ``window`` words always meet:

* the prefix is short where that is enough: the one gram of the suffix's first ``window`` words that
  is longest (then: has the least hash).  Neighbouring suffixes mostly share it and travel together as
  one segment of text, of which each group gets ``window - 1`` words more than it has suffixes;
* where such a prefix has more suffixes than a share of a group, it is extended to the whole
  ``window`` words, and each suffix travels alone.

One pass over the texts counts the prefixes, group by group, and tells each shard the fate of its own: a
prefix that one document alone has can begin no repeat and is dropped; so only what may repeat travels.

So groups are sized for memory.  In each, a suffix array of the group's segments with the lengths of
common prefixes is the suffix tree: neighbours that share ``window`` words or more are below one deep
internal node, whose smallest document keeps the run.  The others' windows come back as spans; spans
that overlap or touch are one maximal repeat of the document.

The texts are written once in compressed shards of a few megabytes, which fates and spans are joined
to.  Before anything is sent, equal segments of one shard are combined: those of larger documents are
spans at once, so a passage that a third of all documents share travels once a shard.

Defined results: words are ``[^\x20\x09-\x0D]+`` as written; a null text has none; rows without id
neither lose words nor take them from others; rows of one id, equal or not, do not take from each
other, and lose what documents with smaller ids hold; a text of any length is read in pieces that
overlap by ``window - 1`` words; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp
from clausework.llm.decontaminate import suffix_array
from clausework.llm.shared import written

WINDOW, GRAM = 13, 3
SHARD_BYTES = 3 << 20
#: Text of one group. A segment repeats its neighbours' words, hence about three bytes for each of the corpus.
GROUP_BYTES = 8 << 20
SPREAD = 3
SEGMENT_BYTES = 120
_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[:1] = 1
    return np.cumprod(p, dtype=_U)


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` keys the place of the (first) smallest."""
    value, place, have = keys, np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        take = value[:-step] <= value[step:]
        value, place, have = np.where(take, value[:-step], value[step:]), np.where(take, place[:-step], place[step:]), have + step
    return place


class Shard:
    """Segments of a batch of texts: ``start`` (word), ``windows``, ``owner`` (text) and ``prefix``, and a hash of their words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.window = window
        self.words = words = textnp.Words(data, offs, textnp.NON_SPACE)
        self.data = data
        h, n = words.hashes, len(words.hashes)
        self.text_of = np.repeat(np.arange(len(offs) - 1), np.diff(words.first))
        none = np.zeros(0, np.int64)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * _powers(_BASE, n), dtype=_U)])
        self.back = _powers(_INVERSE, n + 1)
        if n < window:
            self.start = self.windows = self.owner = none
            self.prefix = np.zeros(0, _U)
            return
        m = n - gram + 1
        total = np.zeros(m, _U)
        for j in range(gram):
            total += h[j : j + m] * textnp._STEPS[j]
        total = textnp.mix(total)
        # letters alone: white space between the words does not count
        size = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        long = size[gram : gram + m] - size[:m]
        keys = (_U(63) - np.minimum(long >> 1, 63).astype(_U) << _U(58)) | (total >> _U(6))
        place = least_places(keys, window - gram + 1)
        whole = self.text_of[: len(place)] == self.text_of[window - 1 :]
        fresh = np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]]
        self.start = np.flatnonzero(whole & fresh)
        ends = np.flatnonzero(whole & np.r_[fresh[1:] | ~whole[1:], True]) + 1
        self.windows, self.owner, self.prefix = ends - self.start, self.text_of[self.start], total[place[self.start]]

    def only(self, mask: np.ndarray) -> None:
        self.start, self.windows, self.owner, self.prefix = self.start[mask], self.windows[mask], self.owner[mask], self.prefix[mask]

    def extend(self, often: np.ndarray) -> None:
        """Suffixes of these prefixes (sorted) travel alone, dealt by all their ``window`` words."""
        if not len(often) or not len(self.prefix):
            return
        hot = _held(often, self.prefix)
        if not hot.any():
            return
        size = self.windows[hot]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(self.start[hot], size) + inner
        self.start = np.concatenate([self.start[~hot], start])
        self.windows = np.concatenate([self.windows[~hot], np.ones(len(start), np.int64)])
        self.owner = np.concatenate([self.owner[~hot], np.repeat(self.owner[hot], size)])
        self.prefix = np.concatenate([self.prefix[~hot], self.hashes(start, start + self.window)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textnp.mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U))

    def combine(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sent, local): segments of the smallest document among equal ones, and those of larger documents.

        ``doc`` has each text's id.
        """
        same = self.hashes(self.start, self.start + self.windows + self.window - 1)
        ids = doc[self.owner]
        order = np.lexsort((self.start, ids, same))
        fresh = np.ones(len(order), bool)
        fresh[1:] = same[order[1:]] != same[order[:-1]]
        least = ids[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else ids
        late = ids[order] > least
        self.same = same
        return order[~late], order[late]

    def texts(self) -> tuple[bytes, np.ndarray]:
        """All words with one byte between them, and where each begins."""
        words = self.words
        size = words.ends - words.starts
        mask = np.zeros(len(self.data) + 1, bool)
        if len(size):
            edge = np.zeros(len(self.data) + 2, np.int8)
            edge[words.starts] += 1
            np.add.at(edge, words.ends + 1, -1)  # a word and the byte behind it
            mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        padded = np.append(self.data, np.uint8(32))
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        if int(mask.sum()) == int(begin[-1]):
            return padded[mask].tobytes(), begin
        # two texts without white space between them
        out = np.full(int(begin[-1]), 32, np.uint8)
        at = np.repeat(begin[:-1] - words.starts, size) + np.flatnonzero(textnp.NON_SPACE[self.data])
        out[at] = self.data[textnp.NON_SPACE[self.data]]
        return out.tobytes(), begin


def pieces(data: np.ndarray, offs: np.ndarray, max_bytes: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first word) of a shard; a single long text comes in pieces that overlap by so many words."""
    if len(offs) > 2 or len(data) <= 2 * max_bytes:
        yield data, offs, 0
        return
    at, word = 0, 0
    while at < len(data):
        to = min(len(data), at + max_bytes)
        while True:
            words = textnp.Words(data[at:to], np.array([0, to - at]), textnp.NON_SPACE, hashed=False)
            n = len(words.starts) - (to < len(data))  # the last word may go on
            if n > 2 * overlap or to == len(data):
                break
            to = min(len(data), to + max_bytes)
        if not n:
            return
        end = int(words.ends[n - 1])
        yield data[at : at + end], np.array([0, end]), word
        if to == len(data):
            return
        word, at = word + n - overlap, at + int(words.starts[n - overlap])


_SHARDS = pa.schema([("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary()), ("bytes", pa.int64())])
_SENT = pa.schema([("grp", pa.int64()), ("shard", pa.int64()), ("packed", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("docs", "firsts")], *[(c, pa.list_(pa.int32())) for c in ("rows", "windows", "times")]])


def _kind(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} " + (f"array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else names[f.type]) for f in schema)


def _pack(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in textnp.slices(batches, "text", max_bytes):
            data, offs = textnp.buffer(batch.column("text"))
            docs = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc"))
            yield pa.RecordBatch.from_arrays([docs, textnp.as_list(np.diff(offs), np.array([0, batch.num_rows]), pa.int64()), pa.array([packer.compress(data.tobytes())], pa.binary()), pa.array([len(data)])], schema=_SHARDS)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Shard by shard: its row, the bytes and offsets of its texts, and their ids."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            offs = np.concatenate([[0], np.cumsum(row.column("sizes").flatten().to_numpy())]).astype(np.int64)
            yield row, np.frombuffer(unpack.decompress(row.column("packed")[0].as_py()), np.uint8), offs, row.column("docs").flatten()


def _ids(docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)


def _several(prefix: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each prefix belongs to more than one of the documents."""
    if not len(prefix):
        return np.zeros(0, bool)
    value, slot = np.unique(prefix, return_inverse=True)
    order = np.argsort(slot.ravel(), kind="stable")
    start = np.searchsorted(slot.ravel()[order], np.arange(len(value)))
    return (np.minimum.reduceat(doc[order], start) < np.maximum.reduceat(doc[order], start))[slot.ravel()]


def _count(groups: int, window: int, gram: int, shard_bytes: int):
    """mapInArrow over shards: the prefixes of a shard and how many segments it would send of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, data, offs, docs in _opened(batches):
            doc, valid = _ids(docs)
            found = []
            for part, cuts, _ in pieces(data, offs, shard_bytes, window - 1):
                shard = Shard(part, cuts, window, gram)
                shard.only(valid[shard.owner])
                found.append(shard.prefix[shard.combine(doc)[0]])
            prefix, n = np.unique(np.concatenate(found) if found else np.zeros(0, _U), return_counts=True)
            if not len(prefix):
                continue
            group = prefix % _U(groups)
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            edges = np.r_[cut, len(order)]
            packed = [(prefix[order[a:b]].tobytes(), n[order[a:b]].astype(np.uint32).tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[order[cut]].astype(np.int64)), pa.array([row.column("shard")[0].as_py()] * len(cut), pa.int64()), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())], names=["grp", "shard", "prefixes", "counts"]
            )

    return run


def _fates(most: int):
    """Prefixes of a group that several shards have, and those of more than ``most`` segments, back to their shards."""

    def run(table: pa.Table) -> pa.Table:
        prefix = [np.frombuffer(x.as_py(), _U) for x in table["prefixes"]]
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
        owner = np.repeat(np.arange(len(prefix)), [len(x) for x in prefix])
        flat = np.concatenate(prefix)
        value, slot, shards = np.unique(flat, return_inverse=True, return_counts=True)
        slot = slot.ravel()
        often = np.bincount(slot, weights=n) > most
        kept = np.flatnonzero((shards[slot] > 1) | often[slot])
        edges = np.searchsorted(owner[kept], np.arange(len(prefix) + 1)).tolist()
        pairs = list(zip(edges[:-1], edges[1:], strict=True))
        back = pa.table({"shard": table["shard"], "prefixes": pa.array([flat[kept[a:b]].tobytes() for a, b in pairs], pa.binary()), "often": pa.array([often[slot[kept[a:b]]].tobytes() for a, b in pairs], pa.binary())})
        return back.filter(pa.array([a < b for a, b in pairs]))

    return run


def _deal(groups: int, window: int, gram: int, shard_bytes: int):
    """mapInArrow over shards and their prefixes' fates: segments packed by group; spans found in the shard itself go by the upper half of the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for row, data, offs, docs in _opened(batches):
            doc, valid = _ids(docs)
            number = row.column("shard")[0].as_py()
            fates = row.column("fates").flatten()
            shared = np.concatenate([np.zeros(0, _U), *[np.frombuffer(x.as_py(), _U) for x in fates.field(0)]])
            often = np.concatenate([np.zeros(0, bool), *[np.frombuffer(x.as_py(), bool) for x in fates.field(1)]])
            order = np.argsort(shared)
            shared, often = shared[order], np.sort(shared[often])
            for part, cuts, base in pieces(data, offs, shard_bytes, window - 1):
                shard = Shard(part, cuts, window, gram)
                shard.only(valid[shard.owner])
                # a prefix of one document only can begin no repeat
                shard.only(_held(shared, shard.prefix) | _several(shard.prefix, doc[shard.owner]))
                shard.extend(often)
                yield from _rows(shard, doc, base, number, groups, window, packer)

    return run


def _held(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)] == asked


def _rows(shard: Shard, doc: np.ndarray, base: int, number: int, groups: int, window: int, packer: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    sent, local = shard.combine(doc)
    if not len(sent):
        return
    first = shard.start - shard.words.first[shard.owner] + base
    lists = lambda values, ends, kind: textnp.as_list(values, ends, kind)
    # one record for equal segments of one text
    group = (shard.prefix[sent] % _U(groups)).astype(np.int64)
    order = np.lexsort((shard.start[sent], shard.owner[sent], shard.same[sent], group))
    sent, group = sent[order], group[order]
    fresh = np.r_[True, (shard.same[sent[1:]] != shard.same[sent[:-1]]) | (shard.owner[sent[1:]] != shard.owner[sent[:-1]])]
    record = np.flatnonzero(fresh)
    times = np.diff(np.r_[record, len(sent)])
    ones = sent[record]
    text, begin = shard.texts()
    lo = begin[shard.start[ones]].tolist()
    hi = (begin[shard.start[ones] + shard.windows[ones] + window - 1] - 1).tolist()
    cut = np.flatnonzero(np.r_[True, group[record[1:]] != group[record[:-1]]])
    edges = np.r_[cut, len(record)]
    packed = [packer.compress(b"\n".join([text[x:y] for x, y in zip(lo[a:b], hi[a:b], strict=True)])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(group[record[cut]]), pa.array([number] * len(cut), pa.int64()), pa.array(packed, pa.binary()), lists(doc[shard.owner[ones]], edges, pa.int64()), lists(first[sent], np.r_[record, len(sent)][edges], pa.int64()),
            lists(shard.owner[ones], edges, pa.int32()), lists(shard.windows[ones], edges, pa.int32()), lists(times, edges, pa.int32()),
        ],
        schema=_SENT,
    )
    if len(local):
        ends = np.array([0, len(local)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([groups + number % groups]), pa.array([number], pa.int64()), pa.array([None], pa.binary()), lists(doc[shard.owner[local]], ends, pa.int64()), lists(first[local], ends, pa.int64()),
                lists(shard.owner[local], ends, pa.int32()), lists(shard.windows[local], ends, pa.int32()), lists(np.ones(len(local)), ends, pa.int32()),
            ],
            schema=_SENT,
        )


def deep_nodes(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes starting at ``at`` in order, and for each the topmost node of the tree that is ``depth`` words deep.

    ``text`` is a sequence of symbols with 0 behind each segment; every such suffix has ``depth`` words.
    """
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    shared = np.ones(max(0, len(order) - 1), bool)
    for j in range(depth):
        shared &= text[order[1:] + j] == text[order[:-1] + j]
    return order, np.cumsum(np.r_[False, ~shared])


_FLAGS = "shard bigint, rows array<int>, firsts array<bigint>, windows array<int>"


def _tree(groups: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        if table["grp"][0].as_py() >= groups:
            return table.select(["shard", "rows", "firsts", "windows"])
        flat = {c: pa.concat_arrays([x.flatten() for x in table[c].chunks]).to_numpy() for c in ("docs", "rows", "windows", "times", "firsts")}
        records = pa.concat_arrays([x.value_lengths() for x in table["docs"].chunks]).to_numpy()
        windows, times = flat["windows"].astype(np.int64), flat["times"].astype(np.int64)
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"\n".join(unpack.decompress(x.as_py()) for x in table["packed"]), np.uint8)
        words = textnp.Words(data, np.array([0, len(data)]), textnp.NON_SPACE)
        size = windows + window - 1
        segment = np.repeat(np.arange(len(size)), size)
        _, symbol = np.unique(words.hashes, return_inverse=True)
        text = np.zeros(len(symbol) + len(size), np.int32)
        text[np.arange(len(symbol)) + segment] = symbol.ravel() + 1
        begin = np.cumsum(size + 1) - size - 1
        own = np.repeat(np.arange(len(windows)), windows)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, node = deep_nodes(text, begin[own] + inner, window)
        owner = np.zeros(len(text), np.int64)
        owner[begin[own] + inner] = own
        doc = flat["docs"][owner[order]]
        least = np.minimum.reduceat(doc, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
        hit = np.zeros(len(text) + 2, bool)
        hit[order[doc > least[node]] + 1] = True
        # the windows of a segment end before its last words, so runs never touch those of the next
        a, b = np.flatnonzero(hit[1:-1] & ~hit[:-2]), np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1
        which = owner[a]
        first_time = np.cumsum(times) - times
        repeat = times[which]
        at = np.repeat(first_time[which], repeat) + np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        own = np.repeat(which, repeat)
        edges = np.searchsorted(own, np.concatenate([[0], np.cumsum(records)]))
        back = pa.table({
            "shard": table["shard"], "rows": textnp.as_list(flat["rows"][own], edges, pa.int32()), "firsts": textnp.as_list(flat["firsts"][at] + np.repeat(a - begin[which], repeat), edges, pa.int64()),
            "windows": textnp.as_list(np.repeat(b - a, repeat), edges, pa.int32()),
        })
        return back.filter(pa.array(np.diff(edges) > 0))

    return run


def _cut(window: int):
    """mapInArrow over shards and their repeats: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, data, offs, docs in _opened(batches):
            words = textnp.Words(data, offs, textnp.NON_SPACE, hashed=False)
            n = len(words.starts)
            runs = row.column("runs").flatten()
            of, first, count = (np.concatenate([np.zeros(0, np.int64), *[x.values.to_numpy() for x in runs.field(i)]]).astype(np.int64) for i in range(3))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, words.first[of] + first, 1)
            np.add.at(edge, words.first[of] + first + count + window - 1, -1)
            gone = np.zeros(n + 2, bool)
            gone[1:-1] = np.cumsum(edge)[:-1] > 0
            cut = np.zeros(n + 2, bool)
            cut[words.first + 1] = True
            a = np.flatnonzero(gone[1:-1] & (~gone[:-2] | cut[1:-1]))
            b = np.flatnonzero(gone[1:-1] & (~gone[2:] | cut[2:])) + 1
            span_first = np.searchsorted(a, words.first)
            base = words.first[np.searchsorted(words.first, a, "right") - 1]
            spans = pa.ListArray.from_arrays(pa.array(span_first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], names=["first", "end"]))
            raw, stay = data.tobytes(), ~gone[1:-1]
            starts, ends, kept = words.starts.tolist(), words.ends.tolist(), []
            for i, (x, y) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if span_first[i] == span_first[i + 1]:
                    kept.append(b" ".join(raw[offs[i] : offs[i + 1]].split()))
                else:
                    kept.append(b" ".join([raw[starts[j]:ends[j]] for j in (x + np.flatnonzero(stay[x:y])).tolist()]))
            removed = np.concatenate([[0], np.cumsum(~stay)])
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(np.diff(words.first)), pa.array(removed[words.first[1:]] - removed[words.first[:-1]]), spans, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "spans", "kept"]
            )

    return run


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, ``spans`` (maximal repeats, word places, end excluded) and the ``kept`` text.

    ``shard_bytes`` bounds what a task reads at once, ``group_bytes`` the text of a suffix tree.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    shards = written(rows.mapInArrow(_pack(shard_bytes), _kind(_SHARDS)).withColumn("shard", F.monotonically_increasing_id()), "shards")
    size = shards.agg(F.sum("bytes")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * partitions, -(-SPREAD * size // group_bytes))
    # what a prefix may have: an eighth of a group
    most = max(16, SPREAD * size // groups // SEGMENT_BYTES // 8)
    count_groups = max(partitions, -(-size // (4 * group_bytes)))
    counted = shards.mapInArrow(_count(count_groups, window, gram, shard_bytes), "grp bigint, shard bigint, prefixes binary, counts binary")
    fates = counted.groupBy("grp").applyInArrow(_fates(most), "shard bigint, prefixes binary, often binary").groupBy("shard").agg(F.collect_list(F.struct("prefixes", "often")).alias("fates"))
    none = F.array().cast("array<struct<prefixes:binary,often:binary>>")
    told = shards.join(fates.hint("shuffle_hash"), "shard", "left").select("shard", "docs", "sizes", "packed", F.coalesce("fates", none).alias("fates"))
    dealt = told.mapInArrow(_deal(groups, window, gram, shard_bytes), _kind(_SENT))
    found = dealt.groupBy("grp").applyInArrow(_tree(groups, window), _FLAGS).groupBy("shard").agg(F.collect_list(F.struct("rows", "firsts", "windows")).alias("runs"))
    none = F.array().cast("array<struct<rows:array<int>,firsts:array<bigint>,windows:array<int>>>")
    met = shards.join(found.hint("shuffle_hash"), "shard", "left").select("docs", "sizes", "packed", F.coalesce("runs", none).alias("runs"))
    out = met.mapInArrow(_cut(window), "doc bigint, n_words bigint, n_removed bigint, spans array<struct<first:bigint,end:bigint>>, kept string")
    return out.withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("bigint").alias("n_spans"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM g JOIN (SELECT g, min(doc_id) AS m FROM g GROUP BY g) USING (g) WHERE doc_id > m),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM r),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b IS NULL OR p > b + 1) AS n_spans FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.p) AS kept FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
