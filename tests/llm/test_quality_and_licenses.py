import random
import re

from clausework.llm import license_scan as L
from clausework.llm import quality_rules as Q
from tests.llm.edge import edge
from tests.llm.test_similarity import changed, distance


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen: dict = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    df = edge(spark)
    extra = spark.createDataFrame([(20, "a b c d e f g h " * 5 + "## x"), (21, "a b c d e f g h i " * 2 + "z a b c d e f g h\r\n\x0b")], "doc_id bigint, text string")
    for source in (df, extra):
        got = sorted((tuple(r) for r in Q.measure(source).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
        assert got == sorted(brute_quality(r.text) for r in source.select("text").collect())


def test_policies_and_ablations_agree_with_the_ledger(spark, sf):
    rows = Q.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    kept = Q.apply_policy(rows, "v2").where("kept").count()
    table = {r.rule: r for r in Q.ablations(rows, "v2").collect()}
    for i, (name, failed) in enumerate(Q.RULES):
        others = sum(1 << j for j in range(len(Q.RULES)) if j != i)
        assert table[name].n_failed == rows.where(failed).count()
        assert table[name].n_kept_without == rows.where(f"failed_bits & {others} = 0").count()
        assert table[name].n_kept_without - table[name].n_only == kept
    assert Q.ledger(rows.selectExpr("n_words AS doc_id", "'' AS text").limit(0)).count() == 0


def test_base_phrases_match_brute_force(spark):
    texts = ["Under the MIT License, under the mit-license; Apache License, Version 2.0", "cc by nc cc by nc", "CC-BY-NC 4.0", "nothing", None, "", "é cc by ncx cc\nby\tnc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in L.scan(df).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == sorted({label for _, label in places})
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_fuzzy_notices_are_found_within_the_bound(spark):
    texts = ["x All rigths reserved y", "released under the MTI licence", "GNU Genral Public License", "all the rights are reserved", "gnu lesser general public licens"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    assert got[0].labels == ["all-rights-reserved"] and got[0].spans[0].first_word == 1 and got[0].spans[0].last_word == 3
    assert got[2].labels == ["gpl"] and "lgpl" in got[4].labels
    assert got[3].labels == []
    assert L.scan(edge(spark)).count() == 11 and L.scan(df.limit(0)).count() == 0


def nearest(words, notice, edits):
    """Word runs of a text within the bound of a notice: (first, last, edits)."""
    found = []
    for i in range(len(words)):
        for j in range(i, min(len(words), i + len(notice.split()) + edits + 1)):
            run = " ".join(words[i : j + 1])
            if abs(len(run) - len(notice)) <= edits and (d := distance(run, notice)) <= edits:
                found.append((i, j, d))
    return found


def test_fuzzy_places_match_an_edit_distance_scan():
    random.seed(6)
    notices = {"ab ab a b": ("x", 0.5), "under the mit license": ("mit", 0.9), "gnu general public license": ("gpl", 0.9), "creative commons attribution": ("cc-by", 0.8)}
    finder = L.Finder(notices, 2)
    for _ in range(600):
        parts = []
        for _ in range(random.randint(1, 3)):
            notice = random.choice(list(notices))
            parts += [changed(notice, random.randint(0, 3), "ab tz"), random.choice(["a", "of", "b", "the x"])]
        words = " ".join(parts).split()
        text = f" {' '.join(words)} "
        spans = finder.spans(text)
        for notice in notices:
            must = L.MUST.get(notice)
            want = [x for x in nearest(words, notice, finder.edits[notice]) if must is None or must in words[x[0] : x[1] + 1]]
            mine = [(text.count(" ", 0, a + 1) - 1, text.count(" ", 0, b) - 1, e) for _, n, a, b, e in spans if n == notice]
            # every place found is one, no two overlap, and nothing within the bound is far from all of them
            assert all(any(x[:2] == y[:2] and y[2] <= x[2] for y in want) for x in mine), (text, notice)
            assert all(x[1] < y[0] for x, y in zip(mine, mine[1:], strict=False))
            assert all(any(x[0] <= y[1] and y[0] <= x[1] for y in mine) for x in want), (text, notice, want, mine)


def test_other_licenses_are_not_mistaken(spark):
    texts = ["released under the MPL license", "under the edit license", "small rights reserved", "Creative Commons Attribution-NonCommercial", "creative commons attribution sharealike 4.0", "creative commons attribution 4.0", "all rights reserved " * 2 + "word " * 50_000 + "under the mit license"]
    rows = L.scan(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")], "doc_id bigint, text string, spans string")).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert len(rows) == 8 and [got[i] for i in range(7)] == [[], [], [], ["cc-by-nc"], ["cc-by-sa"], ["cc-by"], ["all-rights-reserved", "mit"]]
    last = next(r for r in rows if r.doc_id == 6)
    assert (last.first_word, last.last_word, len(last.spans)) == (50_006, 50_006, 3)
