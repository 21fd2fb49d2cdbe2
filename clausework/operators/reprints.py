"""Statutes with a table of contents: pages to sections.

A reprint is lines in order, page by page: ``lines(instrument, page, pos, text)``.  Running headers and
footers go (``cleaned``), editorial notes at the foot of a page are set aside, the table of contents is
read (``contents``), and its entries are aligned with the numbered lines of the body: a numbered line is
a section where its number and, above it, the heading and Part lines agree with an entry.  Exact
agreement is an equi-join on keys of the last lines above it; where a number has none, a ratio of
matching blocks of 0.9 counts.  Of all ways to take numbered lines in the order of the contents, the
one with the most agreeing headings, then the most sections, is chosen.  Without contents every
numbered line is a section.

Everything is windows and joins per instrument but the choice of the alignment, which sees an
instrument's numbered lines only.  No line is lost: each gets one bucket, and ``summary`` accounts for
all letters and digits.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clausework.functions import text as T
from clausework.sources.tables import PART_ROWS, dealt, kept

# How reprints of statutes, English and Malay, number sections and title their parts.
NUMBERED = r"^(\d{1,4}[A-Z]{0,3})\s*\.\s*(?:[—–-]\s*)?(.*)$"
CONTENTS_TITLES = ["arrangement of sections", "arrangement of provisions", "table of contents", "susunan seksyen"]
CONTENTS_LABELS = ["section", "sections", "seksyen"]
LONG_TITLE = r"(?i)^(?:an|suatu)\s+(?:act|akta|ordinance|ordinan|enactment|enakmen)\b"
ORDINALS = "first second third fourth fifth sixth".split()
BACK_MATTER = ["jadual", "list of amendments", "list of sections amended", "senarai pindaan", "seksyen yang dipinda", "legislative history", "legislative source", "appendix", "lampiran", "dicetak oleh", "printed by"]
NOTE = r"(?i)^\*+\s*(?:note|catatan)\b"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?$"
ITEM = r"^\([\p{L}\p{N}_]{1,4}\)"
PARAGRAPH_WORDS = ["ILLUSTRATION", "ILLUSTRATIONS", "Illustration", "Illustrations", "Explanation", "Exception", "Provided", "Huraian", "Penjelasan", "Pengecualian", "Contoh", "Dengan syarat"]
LABEL_WORDS = ["ILLUSTRATION", "ILLUSTRATIONS", "Illustration", "Illustrations", "CONTOH", "Contoh", "HURAIAN", "Huraian"]
QUOTES = "“\"‘"
CLAUSE_ENDS = r"[.;:—–\-\]]$"
#: Lines at a page's edge that may be headers, pages and share of pages they must recur on, their longest shape.
EDGE, LEAST_PAGES, LEAST_SHARE, LONGEST = 3, 3, 0.3, 80
#: Lines above a number that a heading may fill, those compared by ratio, and the ratio.
ABOVE, ABOVE_CLOSE, CLOSE = 16, 6, 0.9
TITLE_LINES = 5
_UPPER = [*BACK_MATTER, "schedule", "schedules", "the schedule", "the schedules", *[f"{the}{n} schedule{s}" for the in ("", "the ") for n in ORDINALS for s in ("", "s")]]
BACK = r"(?i)^(?:" + "|".join(_UPPER) + r")\b"
_BY = ["instrument"]


def _above(n: int):
    return Window.partitionBy(*_BY).orderBy("at").rowsBetween(-n, -1)


def _numbered(text: Column, part: int) -> Column:
    return F.when(text.rlike(NUMBERED), F.regexp_extract(text, NUMBERED, part))


def cleaned(lines: DataFrame) -> DataFrame:
    """``lines`` with ``dropped``: 'rule' for lines without letters and digits, 'chrome' for running headers and footers, else null.

    A shape counts as running when it recurs at the edges of enough pages; such lines go only as far as
    they reach in from an edge without a gap, at the foot together with page numbers.
    """
    page = Window.partitionBy("instrument", "page")
    down, up = page.orderBy("pos"), page.orderBy(F.col("pos").desc())
    rows = lines.select("instrument", "page", "pos", T.squeezed(F.col("text")).alias("text")).where("text <> ''")
    rows = rows.withColumns({"shape": T.line_shape(F.col("text")), "rule": ~F.col("text").rlike(r"[\p{L}\p{N}]")})
    edge = rows.withColumns({"t": F.row_number().over(down), "b": F.row_number().over(up)}).where(f"t <= {EDGE} OR b <= {EDGE}")
    pages = rows.groupBy("instrument").agg(F.count_distinct("page").alias("pages"))
    often = edge.where(F.length("shape") <= LONGEST).groupBy("instrument", "shape").agg(F.count_distinct("page").alias("n")).join(pages, "instrument")
    often = often.where(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(LEAST_SHARE * F.col("pages")))).select("instrument", "shape", F.lit(True).alias("often"))
    kept = rows.where(~F.col("rule")).join(often, ["instrument", "shape"], "left").withColumn("often", F.coalesce("often", F.lit(False)))
    run = lambda w, test: F.min(test.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    kept = kept.withColumn("top", run(down, F.col("often")) & (F.row_number().over(down) <= EDGE))
    foot = ~F.col("top") & (F.col("often") | F.col("text").rlike(PAGE_NUMBER))
    kept = kept.withColumn("foot", run(up, foot) & (F.row_number().over(up) <= EDGE))
    marked = kept.select("instrument", "page", "pos", "text", "shape", F.when(F.col("top") | F.col("foot"), "chrome").alias("dropped"))
    return marked.union(rows.where("rule").select("instrument", "page", "pos", "text", "shape", F.lit("rule").alias("dropped")))


def _stream(lines: DataFrame) -> DataFrame:
    """Kept lines with ``note`` (from a note's mark to the end of its page), ``at`` (place among the others), ``number`` and ``rest``."""
    rows = cleaned(lines).where("dropped IS NULL")
    so_far = Window.partitionBy("instrument", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("instrument", "page", "pos", "text", T.comparison_key(F.col("text")).alias("key"), (F.max(F.col("text").rlike(NOTE).cast("int")).over(so_far) == 1).alias("note"))
    place = F.sum((~F.col("note")).cast("int")).over(Window.partitionBy(*_BY).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.when(~F.col("note"), F.col("text"))
    return rows.withColumns({"at": place.cast("int"), "number": _numbered(text, 1), "rest": F.trim(_numbered(text, 2))})


def _bounds(rows: DataFrame) -> DataFrame:
    """Per instrument with contents: ``title`` (where they begin), ``body`` (where they end) and whether a long title ends them."""
    text = rows.where(~F.col("note"))
    title = text.where(F.lower("text").isin(CONTENTS_TITLES)).groupBy(*_BY).agg(F.min("at").alias("title"))
    later = text.join(title, "instrument").where("at > title")
    long = later.where(F.col("text").rlike(LONG_TITLE)).groupBy(*_BY).agg(F.min("at").alias("long"))
    first = later.where("number IS NOT NULL").groupBy(*_BY).agg(F.min_by("number", "at").alias("first"), F.min("at").alias("first_at"))
    again = later.join(first, "instrument").where("number = first AND at > first_at").groupBy(*_BY).agg(F.min("at").alias("again"))
    last = text.groupBy(*_BY).agg((F.max("at") + 1).alias("none"))
    out = title.join(last, "instrument").join(long, "instrument", "left").join(again, "instrument", "left")
    body = F.coalesce(F.least("long", "again"), "none")
    return out.select("instrument", "title", body.alias("body"), F.coalesce(F.col("long") == body, F.lit(False)).alias("titled"), (body == F.col("none")).alias("open"))


def contents(lines: DataFrame) -> DataFrame:
    """Entries of the tables of contents: (instrument, entry, number, head, tail, before, body, title).

    ``head`` has the lines of the heading, ``tail`` those behind it (Part lines of the next entry);
    ``before`` is the last entry's tail, for the first entry what stands before it. ``body`` is where the
    text begins: at the long title, or where the first number comes again.
    """
    return _contents(kept(_stream(lines), "reprint-lines"))


def _contents(rows: DataFrame) -> DataFrame:
    bounds = _bounds(rows)
    inner = rows.where(~F.col("note")).join(bounds, "instrument").where("at > title AND at < body").where(~F.lower("text").isin(CONTENTS_LABELS))
    entry = F.sum(F.col("number").isNotNull().cast("int")).over(Window.partitionBy(*_BY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    own = F.when(F.col("number").isNotNull(), F.trim(F.regexp_replace("rest", r"^\([\p{L}\p{N}_]{1,3}\)\s*", ""))).otherwise(F.col("text"))
    inner = inner.select("instrument", "at", "number", entry.cast("int").alias("entry"), own.alias("line"), "body", "titled", "open", "title")
    mine = Window.partitionBy("instrument", "entry").orderBy("at")
    # the first line is heading, and so are lines that go on in lower case or in brackets
    filled = inner.where("line <> ''").withColumn("goes_on", (F.row_number().over(mine) == 1) | F.col("line").rlike(r"^(?:\p{Ll}|\()"))
    filled = filled.withColumn("heads", F.min(F.col("goes_on").cast("int")).over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", "line")))), lambda x: x["line"])
    per = filled.groupBy("instrument", "entry").agg(ordered(F.col("heads")).alias("head"), ordered(~F.col("heads")).alias("tail"), ordered(F.lit(True)).alias("lines"))
    starts = inner.where("number IS NOT NULL").select("instrument", "entry", "number", "body", "titled", "open", "title")
    none = F.array().cast("array<string>")
    listed = starts.join(per, ["instrument", "entry"], "left").withColumns({c: F.coalesce(c, none) for c in ("head", "tail")})
    lead = per.where("entry < 0").select("instrument", F.col("lines").alias("lead"))
    order = Window.partitionBy(*_BY).orderBy("entry")
    listed = listed.join(lead, "instrument", "left").withColumn("before", F.coalesce(F.lag("tail").over(order), F.col("lead"), none))
    # where the numbers begin again without a long title, what follows the last heading is body already
    last = (F.col("entry") == F.max("entry").over(Window.partitionBy(*_BY))) & ~F.col("titled") & ~F.col("open")
    back = F.max(F.when(last, F.size("tail")).otherwise(0)).over(Window.partitionBy(*_BY))
    return listed.select("instrument", "entry", "number", "head", F.when(last, none).otherwise(F.col("tail")).alias("tail"), "before", (F.col("body") - back).cast("int").alias("body"), "title")


@F.pandas_udf(DoubleType())
def close_ratio(one: pd.Series, other: pd.Series) -> pd.Series:
    """Twice the length of matching blocks over both lengths, as the standard library's matcher counts them."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(one, other, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _least_close(one: pd.Series, other: pd.Series) -> pd.Series:
    """``close_ratio`` where it may reach CLOSE, else null: matching blocks hold no more than the characters that both have, each as often."""
    letters: dict[str, Counter] = {}
    known: dict[tuple[str, str], float | None] = {}

    def of(text: str) -> Counter:
        if text not in letters:
            letters[text] = Counter(text)
        return letters[text]

    def ratio(a: str, b: str) -> float | None:
        if (a, b) not in known:
            x, y = of(a), of(b)
            both = sum(min(n, y[c]) for c, n in x.items() if c in y)
            known[a, b] = SequenceMatcher(None, a, b).ratio() if 2 * both >= CLOSE * (len(a) + len(b)) - 1e-9 else None
        return known[a, b]

    return pd.Series([ratio(a, b) for a, b in zip(one, other, strict=True)], dtype=float)


def _joined(keys: Column) -> Column:
    return F.array_join(keys, "")


def heading_matches(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(instrument, at, entry, parts, heads, exact) of numbered lines whose headings above agree with an entry of their number.

    ``rows`` is the stream of the body, ``entries`` as ``contents`` gives them; parts and heads count the
    Part lines and heading lines among those above.
    """
    above = rows.withColumn("above", F.collect_list("key").over(_above(ABOVE))).where("number IS NOT NULL").select("instrument", "at", "number", "above")
    above = above.where(F.size("above") > 0)
    keyed = entries.select("instrument", "entry", "number", *[F.transform(c, T.comparison_key).alias(c) for c in ("before", "head", "tail")])
    own = F.concat("head", "tail")
    # an entry's heading may have fewer or more lines than the contents suggest, and fewer Part lines above it
    options = keyed.select("instrument", "entry", "number", F.size("head").alias("usual"), own.alias("own"), "before", F.explode(F.sequence(F.lit(0), F.size("before"))).alias("skip"))
    options = options.where(F.size("own") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("own"))).alias("take"))
    part = _joined(F.slice("before", F.col("skip") + 1, F.greatest(F.size("before") - F.col("skip"), F.lit(0))))
    options = options.select("instrument", "entry", "number", part.alias("part"), F.concat(part, _joined(F.slice("own", F.lit(1), F.col("take")))).alias("key"), F.struct((F.col("skip") + F.abs(F.col("take") - F.col("usual"))).alias("off"), (-F.col("take")).alias("take")).alias("rank"))
    tails = above.select("instrument", "at", "number", "above", F.explode(F.sequence(F.lit(1), F.size("above"))).alias("k"))
    taken = F.slice("above", F.size("above") - F.col("k") + 1, F.col("k"))
    tails = tails.select("instrument", "at", "number", "k", taken.alias("taken"), _joined(taken).alias("key"))
    met = tails.join(options, ["instrument", "number", "key"]).groupBy("instrument", "at", "entry").agg(F.min_by(F.struct("k", "taken", "part"), F.struct("rank", "k")).alias("m"))
    reach = lambda x: F.transform(F.sequence(F.lit(0), F.size(x)), lambda j: F.length(_joined(F.slice(x, F.lit(1), j))))
    cut = F.greatest(F.array_position(reach(F.col("m.taken")), F.length("m.part")).cast("int") - 1, F.lit(0))
    exact = met.select("instrument", "at", "entry", cut.alias("parts"), (F.col("m.k") - cut).alias("heads"), F.lit(True).alias("exact"))
    left = tails.where(f"k <= {ABOVE_CLOSE}").join(exact.select("instrument", "at").distinct(), ["instrument", "at"], "left_anti")
    size, want = F.length("key"), F.length("wanted")
    pairs = left.join(options.withColumnRenamed("key", "wanted"), ["instrument", "number"]).where((2 * F.least(size, want) >= CLOSE * (size + want)) & (size > 0))
    scored = pairs.withColumn("ratio", _least_close("key", "wanted")).where(F.col("ratio") >= CLOSE)
    best = scored.groupBy("instrument", "at", "entry").agg(F.min_by(F.struct("k", "taken", "part"), F.struct(-F.col("ratio"), "rank", "k")).alias("m"))
    off = lambda x, t: F.transform(F.sequence(F.lit(0), F.size(x)), lambda j: F.struct(F.abs(F.length(_joined(F.slice(x, F.lit(1), j))) - t).alias("d"), j.alias("j")))
    near = F.array_min(off(F.col("m.taken"), F.length("m.part")))["j"]
    return exact.union(best.select("instrument", "at", "entry", near.alias("parts"), (F.col("m.k") - near).alias("heads"), F.lit(False).alias("exact")))


def number_key(number: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)(.*)", number)
    return (int(m[1]), m[2]) if m else (0, number)


_CHOSEN = "instrument string, at int, entry int, parts int, heads int, exact boolean, stop boolean"


def _aligned(names: list[str], lines: list[tuple]) -> tuple[list[tuple], int | None]:
    """The lines that start sections, as (at, entry, parts, heads, exact), and the place of the line that ends the body, if any.

    ``names`` are the numbers of the entries in order, ``lines`` (at, entry, stops, number, parts, heads, exact) of
    numbered lines, one for each entry of their number (entry None: there is none), and of lines that stop.
    A line whose heading agrees may follow any earlier entry; one without may only follow the entry just before its own.
    """
    n = len(names)
    score = np.full(n + 1, -1, np.int64)  # of the best chain that ends with entry i - 1
    score[0] = 0
    link: list = [None] * (n + 1)
    stop = None
    loose = []
    for at, group in itertools.groupby(sorted(lines, key=lambda x: (x[0], x[1] is None, x[1] or 0)), key=lambda x: x[0]):
        group = list(group)
        if any(x[2] for x in group):
            if (score[1:] > 0).any() or loose and not n:
                stop = at
                break
            continue
        update = []
        for _, e, _, number, parts, heads, exact in group:
            if e is None:
                loose.append((at, number))
                continue
            agrees = heads is not None
            before = int(score[: e + 1].argmax()) if agrees else e
            if score[before] >= 0:
                # one agreeing heading outweighs any number of lines without
                found = (at, e, parts, heads, bool(exact)) if agrees else (at, e, 0, 0, None)
                update.append((e + 1, int(score[before]) + (n + 1 if agrees else 0) + 1, (found, link[before])))
        for slot, value, chain in update:
            if value > score[slot]:
                score[slot], link[slot] = value, chain
    chain, out = link[int(score.argmax())], []
    while chain is not None:
        found, chain = chain
        out.append(found)
    out.reverse()
    taken = [(x[0], number_key(names[x[1]]), x[1]) for x in out]
    if not n:
        out = [(at, None, 0, 0, None) for at, _ in loose]
    elif taken:
        i, current = -1, None
        for at, number in loose:
            while i + 1 < len(taken) and taken[i + 1][0] < at:
                i += 1
                current = taken[i][1]
            following = taken[i][2] + 1 if i >= 0 else 0
            if current is not None and number_key(number) > current and (following >= n or number_key(number) < number_key(names[following])):
                out.append((at, None, 0, 0, None))
                current = number_key(number)
    return sorted(out, key=lambda x: x[0]), stop


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """The alignment of an instrument: rows of kind 'line' (a numbered line and an entry of its number, or none), 'entry' and 'stop'."""
    whole = lambda c: [None if pd.isna(x) else int(x) for x in rows[c].tolist()]
    kinds, numbers, entries = rows["kind"].tolist(), rows["number"].tolist(), whole("entry")
    names = [number for _, number in sorted((e, x) for kind, e, x in zip(kinds, entries, numbers, strict=True) if kind == "entry")]
    each = zip(kinds, whole("at"), entries, numbers, whole("parts"), whole("heads"), rows["exact"].tolist(), strict=True)
    found, stop = _aligned(names, [(at, e, kind == "stop", *more) for kind, at, e, *more in each if kind != "entry"])
    if stop is not None:
        found.append((stop, None, 0, 0, None))
    at, entry, parts, heads, exact = zip(*found, strict=True) if found else [()] * 5
    ends = [False] * len(found)
    if stop is not None:
        ends[-1] = True
    number = lambda x: pd.array(list(x), dtype="Int32")
    instrument = [rows["instrument"].iloc[0]] * len(found)
    return pd.DataFrame({"instrument": pd.Series(instrument, dtype=object), "at": number(at), "entry": number(entry), "parts": number(parts), "heads": number(heads), "exact": pd.array(list(exact), dtype="boolean"), "stop": pd.Series(ends, dtype=bool)})


def read(lines: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed lines, entries of the contents); each step's rows are kept, so that no plan holds more than one of them."""
    rows = kept(_stream(lines).withColumn("instrument", F.col("instrument").cast("string")), "reprint-lines")
    entries = kept(_contents(rows), "reprint-contents")
    return kept(_placed(rows, entries, hints), "reprint-placed"), entries


def placed(lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Every kept line with its bucket: contents, preamble, part, heading, start, text, note, title or after.

    ``section`` counts the sections of an instrument (0: none yet), ``entry`` is the entry of the contents
    that a start belongs to. ``hints(instrument, title)`` are titles that may stand before the schedules.
    """
    return read(lines, hints)[0]


def _placed(rows: DataFrame, entries: DataFrame, hints: DataFrame | None) -> DataFrame:
    begin = entries.groupBy("instrument").agg(F.min("body").alias("body"), F.min("title").alias("title"))
    # contents without entries end nothing
    rows = rows.join(begin, "instrument", "left").withColumn("body", F.coalesce("body", F.lit(1)))
    body = rows.where(~F.col("note") & (F.col("at") >= F.col("body")))
    heads = kept(heading_matches(body, entries), "reprint-headings")
    listed = entries.select("instrument", "number", "entry")
    lined = body.where("number IS NOT NULL").select("instrument", "at", "number").join(listed, ["instrument", "number"], "left").join(heads, ["instrument", "at", "entry"], "left")
    stops = body.where(F.col("text").rlike(BACK) & (F.upper("text") == F.col("text"))).select("instrument", "at")
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, kind, at, number, entry, parts, n, exact: df.select("instrument", F.lit(kind).alias("kind"), at.alias("at"), number.alias("number"), entry.alias("entry"), parts.alias("parts"), n.alias("heads"), exact.alias("exact"))
    c = F.col
    asked = shape(lined, "line", c("at"), c("number"), c("entry"), c("parts"), c("heads"), c("exact"))
    asked = asked.union(shape(listed, "entry", none("int"), c("number"), c("entry"), none("int"), none("int"), none("boolean")))
    asked = asked.union(shape(stops, "stop", c("at"), none("string"), none("int"), none("int"), none("int"), none("boolean")))
    # numbered lines are few bytes and much work: they are dealt by their number, not by their size
    n = rows.where("number IS NOT NULL").count()
    chosen = kept(dealt(asked, "instrument", rows=n, part=PART_ROWS // 8).groupBy("instrument").applyInPandas(_chosen, _CHOSEN), "reprint-starts")
    ends = chosen.where("stop").select("instrument", F.col("at").alias("end"))
    starts = chosen.where(~F.col("stop")).select("instrument", "at", "entry", "parts", "heads", "exact", F.lit(True).alias("start"))
    rows = rows.join(ends, "instrument", "left").join(starts.withColumn("note", F.lit(False)), ["instrument", "at", "note"], "left").withColumn("start", F.coalesce("start", F.lit(False)))
    order = Window.partitionBy("instrument").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines_only = Window.partitionBy("instrument", "note").orderBy("pos")
    rows = rows.withColumn("section", F.count_if("start").over(so_far))
    # without an entry, one line that looks like a heading and follows a finished clause is the heading
    text, before = F.lag("text").over(lines_only), F.lag("text", 2).over(lines_only)
    alone = F.length(text).between(2, 140) & ~text.rlike(r"[.;,:]$") & ~text.rlike(NUMBERED) & ~F.startswith(text, F.lit("("))
    finished = before.isNull() | before.rlike(CLAUSE_ENDS) | (F.lag("section").over(lines_only) == 0) | F.lag("start", 2).over(lines_only)
    ok = alone & finished & (F.lag("at").over(lines_only) >= F.col("body"))
    rows = rows.withColumn("heads", F.when(F.col("start") & F.col("entry").isNull(), F.coalesce(ok, F.lit(False)).cast("int")).otherwise(F.col("heads")))
    back = Window.partitionBy("instrument", "note").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(F.col("start"), F.struct("at", "heads", "parts")), ignorenulls=True).over(back))
    rows = rows.withColumn("gap", F.when(~F.col("note"), F.col("next.at") - F.col("at")))
    titles = rows.where("title IS NOT NULL").where(f"NOT note AND at < title AND at >= title - {TITLE_LINES}").select("instrument", "key")
    if hints is not None:
        titles = titles.union(hints.select(F.col("instrument").cast("string"), T.comparison_key(F.col("title"))))
    rows = rows.join(titles.distinct().withColumn("titled", F.lit(True)), ["instrument", "key"], "left")
    after = F.coalesce(F.col("at") >= F.col("end"), F.lit(False)) & ~(F.col("note") & (F.col("at") < F.col("end")))
    bucket = (
        F.when(F.col("note") & ~after, "note")
        .when(F.col("at") < F.col("body"), "contents")
        .when(after, "after")
        .when(F.col("start"), "start")
        .when(F.col("gap") <= F.col("next.heads"), "heading")
        .when(F.col("gap") <= F.col("next.heads") + F.col("next.parts"), "part")
        .when(F.col("section") == 0, "preamble")
        .otherwise("text")
    )
    rows = rows.withColumn("bucket", bucket)
    # titles right before the schedules belong to neither
    tail = Window.partitionBy("instrument").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    still = F.min(F.when(F.col("bucket") == "after", None).otherwise((F.coalesce("titled", F.lit(False)) & (F.col("bucket") == "text")).cast("int"))).over(tail) == 1
    rows = rows.withColumn("bucket", F.when(F.col("end").isNotNull() & (F.col("bucket") == "text") & still, "title").otherwise(F.col("bucket")))
    # a note belongs to the last section with an asterisk on its page
    page = Window.partitionBy("instrument", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starred = F.last(F.when(~F.col("note") & F.contains("text", F.lit("*")) & (F.col("section") > 0) & (F.col("at") >= F.col("body")), F.col("section")), ignorenulls=True).over(page)
    rows = rows.withColumn("section", F.when(F.col("bucket") == "note", F.coalesce(starred, "section")).when(F.col("bucket").isin("heading", "part"), F.col("section") + 1).otherwise(F.col("section")))
    return rows.select("instrument", "page", "pos", "at", "text", "key", "number", "rest", "bucket", "section", "entry", "exact")


def _side_notes(head: Column) -> Column:
    """Keys of notes such as "(2) Exceptions" in the lines of an entry; a line without bracket goes on with the one before."""
    begins = lambda x: F.startswith(x, F.lit("("))
    marked = F.transform(F.slice(head, 2, 1000), lambda x: F.when(begins(x), F.concat(F.lit("\u0001"), F.regexp_replace(x, r"^\([\p{L}\p{N}_]{1,3}\)\s*", ""))).otherwise(x))
    # what stands before the first bracket is heading
    notes = F.slice(F.split(F.concat(F.array_join(marked, " ")), "\u0001"), 2, 1000)
    return F.filter(F.transform(notes, T.comparison_key), lambda x: F.length(x) >= 8)


def _word(words: list[str], whole: bool = False) -> str:
    return "^(?:" + "|".join(words) + (")$" if whole else r")\b")


def reflowed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the lines of each section as paragraphs. ``rows`` has ``keys``, pos, line and ``notes`` (keys of side notes).

    A line goes on with the one before unless it begins an item, an illustration or a side note, follows
    the line of such a label or note, or is a definition behind a finished clause.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    line, key = F.col("line"), F.col("line_key")
    rows = rows.withColumn("line_key", T.comparison_key(line))
    whole = F.coalesce(F.array_contains("notes", key), F.lit(False))
    piece = (F.length(key) >= 20) & F.exists("notes", lambda n: F.startswith(n, key))
    rows = rows.withColumns({"whole": whole, "side": whole | F.coalesce(piece, F.lit(False))})
    alone = F.col("whole") | line.rlike(_word(LABEL_WORDS, True))
    definition = line.rlike(f"^[{QUOTES}]") & F.lag(line).over(order).rlike(CLAUSE_ENDS)
    fresh = line.rlike(ITEM) | line.rlike(_word(PARAGRAPH_WORDS)) | F.col("side") | F.coalesce(F.lag(alone).over(order), F.lit(False)) | F.coalesce(definition, F.lit(False))
    rows = rows.withColumn("piece", F.concat(F.when(fresh, "\n").otherwise(" "), line))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
    return rows.groupBy(*keys).agg(F.trim(F.array_join(ordered, ""), F.lit(" \n")).alias("text"))


def _sections(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """All sections found, before repeated numbers and empty texts are settled."""
    keys = ["instrument", "section"]
    ordered = lambda bucket: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("pos", "text")))), lambda x: x["text"])
    at_start = lambda c: F.max(F.when(F.col("bucket") == "start", F.col(c)))
    per = rows.where("section > 0 AND bucket IN ('start', 'heading', 'part', 'note')").groupBy(*keys).agg(
        at_start("number").alias("number"), at_start("entry").alias("entry"), at_start("exact").alias("exact"), at_start("pos").alias("pos"),
        F.array_join(ordered("heading"), " ").alias("own_heading"), F.nullif(F.array_join(ordered("part"), " "), F.lit("")).alias("own_part"), ordered("note").alias("notes"),
    )
    listed = entries.select(F.col("instrument").cast("string").alias("instrument"), "entry", F.array_join("head", " ").alias("listed"), _side_notes(F.col("head")).alias("side_notes"))
    per = per.join(listed, ["instrument", "entry"], "left")
    told = per.select(*keys, F.coalesce("side_notes", F.array().cast("array<string>")).alias("notes"))
    body = rows.where("bucket = 'text' OR bucket = 'start' AND rest <> ''").select(*keys, "pos", F.when(F.col("bucket") == "start", F.col("rest")).otherwise(F.col("text")).alias("line")).join(told, keys)
    part = F.coalesce(F.last("own_part", ignorenulls=True).over(Window.partitionBy("instrument").orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(""))
    out = per.withColumn("part", part).join(reflowed(body, keys), keys, "left")
    heading = F.when(F.col("own_heading") != "", F.col("own_heading")).otherwise(F.coalesce("listed", F.lit("")))
    matched = F.when(F.col("entry").isNull(), "not_listed").when(F.col("exact"), "exact").when(~F.col("exact"), "close").otherwise("none")
    # a number that comes twice keeps its longest text, the first of equal ones
    rank = F.row_number().over(Window.partitionBy("instrument", "number").orderBy(F.length("text").desc(), "pos"))
    return out.select(*keys, "entry", "pos", "number", heading.alias("heading"), F.coalesce("text", F.lit("")).alias("text"), "part", "notes", matched.alias("matched")).withColumn("rank", rank)


def sections(lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(instrument, number, unit_path, heading, text, part, notes, matched): the sections that hold any text.

    ``matched`` tells how the heading agrees with the contents: exact, close, none (the contents' heading
    is used) or not_listed.
    """
    found = _sections(*read(lines, hints)).where("rank = 1 AND text <> ''")
    return found.select("instrument", "section", "number", F.concat(F.lit("s "), "number").alias("unit_path"), "heading", "text", "part", "notes", "matched")


def summary(lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Per instrument: characters of the body and of the placed lines, lines per bucket, removed lines and what disagrees with the contents."""
    rows, entries = read(lines, hints)
    return summarised(lines, rows, entries, kept(_sections(rows, entries), "reprint-sections"))


def summarised(lines: DataFrame, rows: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """``summary`` of lines that were read: placed lines, entries and all sections found."""
    kinds = ("preamble", "part", "heading", "start", "text", "note", "title", "contents", "after")
    size = F.length("key")
    own = F.length(T.comparison_key(F.concat("number", "rest")))
    body = F.col("bucket").isin("preamble", "part", "heading", "start", "text", "note", "title")
    per = rows.groupBy("instrument").agg(
        F.sum(F.when(body, size).otherwise(0)).alias("n_chars"), F.sum(F.when(F.col("bucket") == "start", own).when(body, size).otherwise(0)).alias("n_placed"),
        F.count("*").alias("n_kept"), *[F.count_if(F.col("bucket") == k).alias(f"n_{k}") for k in kinds], F.min_by("text", F.when(F.col("bucket") == "after", F.col("pos"))).alias("stopped_at"),
    )
    # every line that is not dropped has a bucket
    written = lines.where(T.squeezed(F.col("text")) != "").groupBy(F.col("instrument").cast("string").alias("instrument")).agg(F.count("*").alias("n_written"))
    numbers = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("section", "number")))), lambda x: x["number"])
    said = found.groupBy("instrument").agg(
        numbers(F.col("matched") == "not_listed").alias("not_listed"), numbers(F.col("matched") == "close").alias("differs"), numbers(F.col("matched") == "none").alias("unmatched"),
        numbers(F.col("rank") > 1).alias("repeated"), numbers((F.col("rank") == 1) & (F.col("text") == "")).alias("empty"), F.count_if((F.col("rank") == 1) & (F.col("text") != "")).alias("n_sections"),
    )
    missing = entries.join(found.select("instrument", "number").distinct(), ["instrument", "number"], "left_anti").groupBy("instrument").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "number"))), lambda x: x["number"]).alias("missing"))
    listed = entries.groupBy("instrument").agg(F.count("*").alias("n_entries"))
    per = per.join(written, "instrument", "left").withColumn("n_dropped", F.col("n_written") - F.col("n_kept")).drop("n_written", "n_kept")
    out = per.join(said, "instrument", "left").join(missing, "instrument", "left").join(listed, "instrument", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("not_listed", "differs", "unmatched", "repeated", "empty", "missing")}
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_dropped", "n_sections", "n_entries")}).withColumns(lists).withColumn("stopped_at", F.when(F.col("n_after") > 0, F.col("stopped_at")))
