"""Statutes with contents, manifest runs and reports on small rows; whole tables are in test_catalog."""

import datetime
import random
import time
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clausework.operators import reprints, runs


def lines(spark, pages, instrument="a"):
    rows = [(instrument, p, p * 100 + i, t) for p, page in enumerate(pages) for i, t in enumerate(page)]
    return spark.createDataFrame(rows, "instrument string, page int, pos int, text string")


def found(spark, pages, **more):
    return [tuple(r) for r in reprints.sections(lines(spark, pages), **more).orderBy("section").select("number", "heading", "text", "part", F.array_join("notes", "|"), "matched").collect()]


def test_chrome_reaches_in_from_the_edges_only(spark):
    # the running line counts at the edge; in the middle it is text; the number at the foot goes, at the head it stays
    pages = [["Laws of X 7", f"text {w}", "Laws of X 9", f"more {w}", "end", str(i)] for i, w in enumerate("abcde")] + [["12", "Laws of X 3", "tail f", "___"]]
    got = {(r.page, r.text): r.dropped for r in reprints.cleaned(lines(spark, pages)).collect()}
    assert got[0, "Laws of X 7"] == "chrome" and got[0, "Laws of X 9"] is None and got[4, "4"] == "chrome" and got[5, "___"] == "rule"
    assert got[5, "12"] is None and got[5, "Laws of X 3"] is None  # nothing behind what stays
    assert got[0, "end"] == "chrome"  # recurs at the foot of most pages


def test_two_pages_are_too_few_for_chrome(spark):
    assert reprints.cleaned(lines(spark, [["Same", "a"], ["Same", "b"]])).where("dropped IS NOT NULL").count() == 0


CONTENTS = ["ACT 5", "ARRANGEMENT OF SECTIONS", "Section", "PART I", "PRELIMINARY", "1. Short title", "2. Meaning of words used", "in this Act", "PART II", "DUTIES", "3. Duty of", "(2) Exception in favour of minors", "5A. Late duty"]
BODY = [
    "An Act to try.", "PART I", "PRELIMINARY", "Short title", "1.—(1) This is the Act.", "Meaning of words", "used in this Act", "2. In this Act—", "“word” means a word;", "“other” means", "another;", "3. a number in a definition.",
    "PART II DUTIES", "Duty off", "3. Everyone has:", "(a) one;", "(b) two", "and more.", "Exception in favour of minors", "None for minors.", "ILLUSTRATION", "A pays B.", "Late duties", "4. Late ones too.", "SCHEDULE", "9. form",
]


def test_sections_agree_with_contents(spark):
    got = found(spark, [CONTENTS, BODY])
    assert got == [
        ("1", "Short title", "(1) This is the Act.", "PART I PRELIMINARY", "", "exact"),
        ("2", "Meaning of words used in this Act", "In this Act—\n“word” means a word;\n“other” means another; 3. a number in a definition.", "PART I PRELIMINARY", "", "exact"),
        ("3", "Duty off", "Everyone has:\n(a) one;\n(b) two and more.\nException in favour of minors\nNone for minors.\nILLUSTRATION\nA pays B.", "PART II DUTIES", "", "close"),
        ("4", "Late duties", "Late ones too.", "PART II DUTIES", "", "not_listed"),
    ]
    s = reprints.summary(lines(spark, [CONTENTS, BODY])).first()
    assert (s.n_chars, s.missing, s.not_listed, s.differs, s.stopped_at, s.n_after) == (s.n_placed, ["5A"], ["4"], ["3"], "SCHEDULE", 2)


def test_contents_end_where_numbers_begin_again(spark):
    pages = [["TABLE OF CONTENTS", "1. One", "2. Two", "Tail of contents", "1. First text.", "Two", "2. Second text."]]
    entries = reprints.contents(lines(spark, pages)).orderBy("entry").collect()
    assert [(e.number, e.head, e.tail, e.body) for e in entries] == [("1", ["One"], [], 4), ("2", ["Two"], [], 4)]
    assert [(n, h, t) for n, h, t, *_ in found(spark, pages)] == [("1", "One", "First text."), ("2", "Two", "Second text.")]


def test_without_contents_each_number_is_a_section(spark):
    pages = [["THE ACT", "An Act for all.", "Name", "1. It has a name.", "not a heading;", "2. Second.", "*NOTE—old", "rest of note"], ["2. Second, the longer text.", "Heading", "3."]]
    assert found(spark, pages) == [("1", "Name", "It has a name. not a heading;", "", "", "not_listed"), ("2", "", "Second, the longer text.", "", "", "not_listed")]
    s = reprints.summary(lines(spark, pages)).first()
    assert (s.repeated, s.empty, s.n_note, s.n_chars) == (["2"], ["3"], 2, s.n_placed)


def test_a_later_agreeing_heading_outweighs_an_earlier_number(spark):
    pages = [["SUSUNAN SEKSYEN", "1. Satu", "2. Dua", "3. Tiga", "Suatu Akta untuk semua.", "Satu", "1. Teks.", "3. bukan seksyen", "2. bukan juga", "Dua", "2. Teks dua.", "Tiga", "3. Teks tiga."]]
    assert [(n, t) for n, _, t, *_ in found(spark, pages)] == [("1", "Teks. 3. bukan seksyen 2. bukan juga"), ("2", "Teks dua."), ("3", "Teks tiga.")]


def test_close_ratio_is_the_standard_matcher(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    pairs = [(a, rng.choice([a[: len(a) // 2] + "x" + a[len(a) // 2 :], a[::-1], rng.choice(words)])) for a in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", reprints.close_ratio("a", "b").alias("r")).collect()
    assert all(abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in got)


def test_choice_of_an_empty_or_unlisted_instrument():
    columns = ["instrument", "kind", "at", "number", "entry", "parts", "heads", "exact"]
    rows = pd.DataFrame([("a", "entry", None, "1", 0, None, None, None), ("a", "line", 3, "7", None, None, None, None)], columns=columns)
    assert reprints._chosen(rows).empty


@pytest.mark.parametrize("text, day", [
    ("Reprint as at 1 June 2025", (2025, 6, 1)), ("Incorporating all amendments up to 1 Ogos 2006", (2006, 8, 1)), ("as at 31 Feb 2020 then as at 2 Mac 2021", (2021, 3, 2)), ("sebagaimana pada  15 Disember 2019", (2019, 12, 15)), ("as at June 2025", None), ("", None),
])
def test_version_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(runs.version_date(F.col("t"))).first()[0]
    assert got == (day and datetime.date(*day))


def test_a_run_never_fails(spark):
    manifest = spark.createDataFrame([("SG", "SG/a", "Act 5", "https://x", "Act 5"), ("SG", "SG/b", "B", None, "B"), ("SG", "SG/c", "C", "https://x", "C"), ("SG", "SG/d", "D", "https://x", "D"), ("SG", "SG/e", "E", "https://x", "E")], "jurisdiction string, id string, title string, url string, expect_title string")
    when = datetime.datetime(2024, 1, 1)
    snapshots = spark.createDataFrame([("SG/a", when, "u", "s", None), ("SG/d", when, "u", None, "HTTP 500"), ("SG/e", when, "u", "s", None)], "id string, retrieved_at timestamp, url string, sha256 string, error string")
    outcomes, units = runs.run(manifest, snapshots, lines(spark, [["As at 3 May 2015", *CONTENTS], BODY], "SG/a"), "2024-01-01")
    got = {r.id: r for r in outcomes.collect()}
    assert {i: r.status for i, r in got.items()} == {"SG/a": "parsed", "SG/b": "needs_url", "SG/c": "skipped", "SG/d": "fetch_failed", "SG/e": "parse_failed"}
    assert got["SG/a"].version == datetime.date(2015, 5, 3) and got["SG/a"].warnings == ["as at 2015-05-03", "in contents but not found: 5A", "not in contents: 4", "heading differs: 3", "stopped at SCHEDULE"]
    assert [r.unit_path for r in units.orderBy("section").collect()] == ["s 1", "s 2", "s 3", "s 4"]
    report = runs.review_report(outcomes, units).first().report
    assert report.startswith("# SG: 1 of 5 parsed\n\n## SG/a — Act 5\nstatus: parsed\n! as at 2015-05-03") and "- **s 2** Meaning of words used in this Act: In this Act— “word”" in report
    assert "## SG/d — D\nstatus: fetch_failed (HTTP 500)" in report


def test_long_instruments_show_head_and_tail(spark):
    rows = [("a", i, f"s {i}", "h", "x" * (300 if i == 1 else 5)) for i in range(1, 11)] + [("b", i, f"s {i}", "h", "y") for i in range(1, 7)]
    got = runs.sampled(spark.createDataFrame(rows, "id string, section int, unit_path string, heading string, text string")).collect()
    assert sorted((r.id, r.section) for r in got) == [("a", i) for i in (1, 2, 3, 8, 9, 10)] + [("b", i) for i in range(1, 7)]
    assert [len(r.excerpt) for r in got if (r.id, r.section) == ("a", 1)] == [221]


def test_manifest_rules(spark):
    rows = [("SG", "SG/ok-1", "https://x", "pdf"), ("SG", "SG/two", None, "text"), ("SG", "SG/two", None, "text"), ("sg", "MY/x", "x y", "doc"), (None, None, None, None)]
    got = runs.manifest_violations(spark.createDataFrame(rows, "jurisdiction string, id string, url string, format string")).collect()
    assert {(r.id, r.violation) for r in got} == {("SG/two", "duplicate_id"), ("MY/x", "bad_jurisdiction"), ("MY/x", "bad_id"), ("MY/x", "other_jurisdiction"), ("MY/x", "bad_url"), ("MY/x", "unknown_format"), (None, "bad_jurisdiction"), (None, "bad_id"), (None, "unknown_format")}


def test_many_instruments_are_chosen_in_parallel_and_fast(spark):
    # the alignment took some 90 ms an instrument of forty sections, in as few tasks as their bytes filled
    rows = [("line", k * 10, str(k), k - 1, 0, 1, True) for k in range(1, 401)] + [("line", k * 10 + 5, str(k + 1), k, None, None, None) for k in range(1, 400)] + [("entry", None, str(k), k - 1, None, None, None) for k in range(1, 401)] + [("stop", 4001, None, None, None, None, None)]
    rows = pd.DataFrame([("a", *r) for r in rows], columns=["instrument", "kind", "at", "number", "entry", "parts", "heads", "exact"]).astype({"at": "float"})
    start = time.process_time()
    got = reprints._chosen(rows)
    assert time.process_time() - start < 0.15
    assert got["at"].tolist() == [*range(10, 4001, 10), 4001] and got["stop"].tolist() == [False] * 400 + [True] and got["entry"].isna().tolist() == [False] * 400 + [True]


def test_a_close_ratio_is_skipped_only_where_it_cannot_reach_the_bound(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    pairs = [(a, rng.choice([a, a[1:] or "b", a[: len(a) // 2] + "x" + a[len(a) // 2 :], a[::-1], rng.choice(words)])) for a in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", reprints._least_close("a", "b").alias("r")).collect()
    for r in got:
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == want if want >= reprints.CLOSE else r.r is None or r.r == want or r.r != r.r
    assert any(r.r is None or r.r != r.r for r in got)


def test_customers_lines_are_dealt_whatever_their_bytes(spark, sf):
    from clausework.plans import reprints as plan

    assert plan._lines(spark, sf).rdd.getNumPartitions() == 1  # 150 customers
    wide = plan.dealt(spark.range(40_000), "id", part=plan.PART_ROWS // 15)
    assert wide.rdd.getNumPartitions() == 4
