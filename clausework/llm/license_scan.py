"""License notices: exact phrases and fuzzy short notices.

Base phrases are found word by word.  The fuzzy search covers short notices with a bounded number
of character edits: a notice is split into ``edits + 1`` seeds, so that any place within the bound
holds one seed unchanged (pigeonhole); one automaton finds all seeds, and the ``regex`` library
verifies a small window around each seed with ``{e<=edits}`` and reports the span and the edits.
A place begins and ends at word borders and holds the notice's distinguishing word unchanged; a
notice of fewer than eight characters for each edit has fewer edits; a place inside a place of a
longer notice is not reported.

Both searches run on the words of a text joined by single blanks.  Texts are whole: a long text is
searched in one piece and its places are counted one after another, so memory follows the text.

Defined results: a null or empty text has no words, no spans, empty labels and score 0; rows repeat
as they come; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import textnp

#: Phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices (lower case, words joined by blanks), their labels and weights.
NOTICES = {
    "under the mit license": ("mit", 0.9),
    "permission is hereby granted free of charge to any person": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache-2", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license version": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
#: The word that must stand unchanged in a place of a notice.
MUST = {
    "under the mit license": "mit", "licensed under the apache license version 2 0": "apache", "gnu general public license": "gnu", "gnu lesser general public license": "lesser", "gnu affero general public license": "affero",
    "mozilla public license version": "mozilla", "creative commons attribution noncommercial": "noncommercial", "creative commons attribution sharealike": "sharealike", "creative commons attribution": "attribution", "all rights reserved": "all",
}
EDITS = 2
#: Characters of a notice for each edit.
PER_EDIT = 8

SPANS = "array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:int>>"
SCHEMA = f"__key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, spans {SPANS}"


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of nearly equal length, with their places."""
    n, k = len(notice), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Fuzzy notices in a text of blank-separated words."""

    def __init__(self, notices: dict[str, tuple[str, float]], edits: int):
        import ahocorasick
        import regex

        self.edits = {n: min(edits, len(n) // PER_EDIT) for n in notices}
        self.patterns = {n: regex.compile(f"(?e)(?<= )(?:{regex.escape(n, literal_spaces=True)}){{e<={self.edits[n]}}}(?= )") for n in notices}
        self.must = {n: f" {MUST[n]} " for n in notices if n in MUST}
        self.labels = {n: label for n, (label, _) in notices.items()}
        held: dict[str, list[tuple[str, int]]] = {}
        for n in notices:
            for at, seed in seeds(n, self.edits[n]):
                held.setdefault(seed, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in held.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(label, notice, start, end, edits) in characters of a text ``' w1 ... wn '``; places of one notice don't overlap."""
        windows: dict[str, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            start = end + 1 - size
            for notice, at in where:
                lo = start - at - self.edits[notice] - 1
                windows.setdefault(notice, []).append((max(0, lo), min(len(text), lo + len(notice) + 2 * self.edits[notice] + 2)))
        found = []
        for notice, own in windows.items():
            done = 0
            for lo, hi in _merged(own):
                at = max(lo, done)
                while m := self.patterns[notice].search(text, at, hi):
                    if self.must.get(notice, " ") in f" {m[0]} ":
                        found.append((self.labels[notice], notice, m.start(), m.end(), sum(m.fuzzy_counts)))
                        at = done = m.end()
                    else:
                        at = m.start() + 1
        return sorted(_outermost(found), key=lambda x: (x[2], x[3], x[1]))


def _outermost(found: list[tuple[str, str, int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """Places that lie within no place of a longer notice; one sweep, as places of one notice don't overlap."""
    out, open_places = [], []
    for _, group in groupby(sorted(found, key=lambda x: x[2]), key=lambda x: x[2]):
        here = list(group)
        # at most one open place a notice
        open_places = [y for y in open_places if y[3] > here[0][2]] + here
        out += [x for x in here if not any(x[3] <= y[3] and len(x[1]) < len(y[1]) for y in open_places)]
    return out


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of windows, in order; windows that meet become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Starts of the phrase's words in a text with a blank before and behind each word."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def _scan(phrases: dict[str, str], notices: dict[str, tuple[str, float]], edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        finder = Finder(notices, edits)
        wanted = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        for batch in textnp.slices(batches, "__text"):
            data, offs = textnp.buffer(batch.column("__text"))
            low = textnp.LOWER[data]
            words = textnp.Words(low, offs, textnp.ALNUM, hashed=False)
            joined = _joined(low, words, offs)
            whole = joined[0].tobytes()
            near = {i for i in np.unique(np.searchsorted(joined[1], [end for end, _ in finder.automaton.iter(whole.decode("latin-1"))], "right") - 1).tolist()} if len(whole) else set()
            exact = {int(np.searchsorted(joined[1], at, "right")) - 1 for p, _ in wanted for at in _places(whole, p)}
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                starts: list[int] = []
                labels: set[str] = set()
                spans = []
                if i in exact or i in near:
                    text = whole[joined[1][i] : joined[1][i + 1]]
                    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    if i in exact:
                        for p, label in wanted:
                            if at := _places(text, p):
                                labels.add(label)
                                starts += (np.searchsorted(blanks, at)).tolist()
                    if i in near:
                        plain = text.decode("utf-8", "replace")
                        if len(plain) != len(text):  # places are in characters
                            blanks = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32)
                        places = finder.spans(plain)
                        before = np.searchsorted(blanks, [[a + 1, b] for _, _, a, b, _ in places]).reshape(-1, 2) - 1
                        for (label, notice, _, _, e), (first, last) in zip(places, np.maximum(before, 0).tolist(), strict=True):
                            spans.append({"label": label, "notice": notice, "first_word": first, "last_word": max(first, last), "edits": e})
                for column, value in zip(out, (int(words.first[i + 1] - words.first[i]), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), spans), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["__key", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"])

    return run


def _joined(low, words, offs):
    """The words of all texts, each text as ``' w1 w2 ... wn '``, and where each text begins."""
    import numpy as np

    sizes = words.ends - words.starts
    counts = np.diff(words.first)
    text_sizes = np.add.reduceat(np.append(sizes, 0), words.first[:-1]) if len(counts) else np.zeros(0, np.int64)
    text_sizes = np.where(counts > 0, text_sizes + counts + 1, 1)
    begin = np.concatenate([[0], np.cumsum(text_sizes)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    if len(sizes):
        owner = np.repeat(np.arange(len(counts)), counts)
        before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        rank = np.arange(len(sizes)) - words.first[owner]
        dest = begin[owner] + 1 + rank + before - before[words.first[owner]]
        inside = np.repeat(dest - before, sizes) + np.arange(int(sizes.sum()))
        source = np.repeat(words.starts - before, sizes) + np.arange(int(sizes.sum()))
        out[inside] = low[source]
    return out, begin


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, float]] = NOTICES, edits: int = EDITS) -> DataFrame:
    """One row per input row: words, exact places, labels and the spans of fuzzy notices."""
    rows = df.select(F.col(id_col).cast("bigint").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    found = rows.mapInArrow(_scan(phrases, notices, edits), SCHEMA)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    weight = F.create_map(*[F.lit(x) for n, (_, w) in notices.items() for x in (n, w)])
    one = F.transform("spans", lambda s: weight[s["notice"]] * (F.lit(1.0) - s["edits"] / F.lit(2.0 * (edits + 1))))
    score = F.round(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(one), F.lit(0.0))), 6)
    return found.select(F.col("__key").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", labels.alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("bigint").alias("n_spans")
    )

