"""Fill-in-middle, substring dedup and ranked search against plain versions on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausework.llm import fill_middle, ranked_search, substring_dedup
from tests.llm.edge import LONG, TEXTS, edge

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# ---- fill in middle


def plain_fim(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return doc, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_of_odd_rows(spark):
    rows = [*TEXTS, (20, "\n\n\n"), (21, "a\n<S>b"), (22, "one line"), (23, "é\n𝔘𝔫𝔦\n\r\nx"), (24, "a\x85b c\nd"), (25, "<" * 9 + "\nS>\n<\nP>"), (22, "other\ntext\nof the same id"), *[(100 + i, "l\n" * i) for i in range(40)]]
    out = fill_middle.transformed(documents(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted((plain_fim(*r) for r in rows), key=key)
    assert Counter(r.back for r in out) == Counter(t or "" for _, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_middle_reads_named_columns_and_empty_tables(spark):
    clash = edge(spark).withColumn("n", F.lit("x")).withColumn("hash", F.lit(1)).withColumn("chars", F.lit(1))
    assert fill_middle.transformed(clash).count() == len(TEXTS)
    assert fill_middle.transformed(edge(spark).limit(0)).count() == 0


def test_fill_middle_of_a_long_text(spark):
    text = ("line of text é\n" * 60_000) + "end"
    r = fill_middle.transformed(documents(spark, [(1, text)])).first()
    assert (r.n, r.output) == (plain_fim(1, text)[1], plain_fim(1, text)[5])


# ---- substring dedup


def plain_dedup(rows, window=13):
    held = defaultdict(lambda: math.inf)
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                held[tuple(w[i : i + window])] = min(held[tuple(w[i : i + window])], d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and held[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        spans, kept = [], [x for i, x in enumerate(w) if i not in gone]
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i, i + 1))
        out.append((d, len(w), len(gone), tuple(spans), " ".join(kept)))
    return sorted(out, key=str)


def got_dedup(spark, rows, **more):
    out = substring_dedup.deduplicated(documents(spark, rows), **more)
    return sorted(((r.doc_id, r.n_words, r.n_removed, tuple((s["first"], s["end"]) for s in r.spans), r.kept) for r in out.collect()), key=str)


def repeated_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["a", "b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(13, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            parts.append(rng.choice([" ", "  ", "\n"]).join(p))
        rows.append((rng.choice([i, i, i, i % 7, None]), rng.choice(["\n", " \t", " "]).join(parts) if parts or i % 3 else None))
    return rows


@pytest.mark.parametrize("seed, more", [(1, {}), (2, {"shard_bytes": 500}), (3, {"shard_bytes": 200, "group_bytes": 300}), (4, {"gram": 1, "shard_bytes": 2000})])
def test_substring_dedup_against_plain_version(spark, seed, more):
    rows = repeated_texts(seed)
    assert got_dedup(spark, rows, **more) == plain_dedup(rows)


def test_substring_dedup_of_odd_rows(spark):
    same = " ".join(["x"] * 40)
    rows = [*TEXTS, (30, same), (31, same + " y"), (31, same), (29, " ".join(["x"] * 12)), (40, LONG), (41, " ".join(["nbsp"] * 20)), (42, "é " * 13), (43, "é " * 14)]
    assert got_dedup(spark, rows) == plain_dedup(rows)
    assert substring_dedup.deduplicated(edge(spark)).count() == len(TEXTS)
    assert substring_dedup.deduplicated(edge(spark).limit(0)).count() == 0


def test_frequent_prefixes_are_extended_and_long_texts_are_cut(spark):
    """One passage in every document, each with other words around it: more segments than a group may have."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'l{rng.randrange(10**6)}' for _ in range(14))} {passage} {' '.join(f'r{rng.randrange(10**6)}' for _ in range(14))}") for i in range(300)]
    rows.append((999, " ".join(t for _, t in rows[:150])))
    assert got_dedup(spark, rows, shard_bytes=3000, group_bytes=2000) == plain_dedup(rows)


def test_fates_of_prefixes():
    u = lambda *x: np.array(x, np.uint64).tobytes()
    n = lambda *x: np.array(x, np.uint32).tobytes()
    table = pa.table({"grp": [0, 0, 0], "shard": [1, 2, 3], "prefixes": pa.array([u(5, 6), u(6, 7), u(8)], pa.binary()), "counts": pa.array([n(1, 1), n(9, 1), n(50)], pa.binary())})
    back = {r["shard"]: (np.frombuffer(r["prefixes"], np.uint64).tolist(), np.frombuffer(r["often"], bool).tolist()) for r in substring_dedup._fates(20)(table).to_pylist()}
    assert back == {1: ([6], [False]), 2: ([6], [False]), 3: ([8], [True])}


def test_deep_nodes_are_equal_runs():
    text = np.array([1, 2, 3, 4, 0, 1, 2, 3, 5, 0, 2, 3, 5, 0], np.int32)
    order, node = substring_dedup.deep_nodes(text, np.array([0, 1, 5, 6, 10]), 3)
    groups = defaultdict(set)
    for at, k in zip(order.tolist(), node.tolist(), strict=True):
        groups[k].add(at)
    assert sorted(map(sorted, groups.values())) == [[0, 5], [1], [6, 10]]


# ---- ranked search


def plain_search(rows, items, top=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: TERMS.findall((t or "").translate(low))
    docs = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_words = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            asked[item].update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words if n_words else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if nul else d, -s) for i, (s, nul, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got_search(spark, rows, items, **more):
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.ranked(documents(spark, rows), q, **more).collect()), key=str)


def ranked_rows(seed, n=400):
    rng = random.Random(seed)
    words = [f"t{int(rng.expovariate(0.05))}" for _ in range(3000)] + ["The", "THE", "é9"]
    rows = [(rng.choice([i, i, i // 9, None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    rows += [(1000 + i, rows[5][1] + " copy") for i in range(120)]  # ties
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20])))) for i in range(12)] + [(3, "second row of item three t5"), (50, None), (None, "t1"), (51, ""), (52, "unknown words only"), (53, "copy")]
    return rows, items


@pytest.mark.parametrize("seed, more", [(1, {}), (2, {"shard_bytes": 3000}), (3, {"shard_bytes": 10_000, "block_bytes": 200, "top": 7})])
def test_ranked_search_against_plain_version(spark, seed, more):
    rows, items = ranked_rows(seed)
    assert got_search(spark, rows, items, **more) == plain_search(rows, items, more.get("top", 50))


def test_ranked_search_of_odd_rows(spark):
    items = [(1, "quick brown fox words"), (2, "word1 and5"), (3, "数 字")]
    assert got_search(spark, TEXTS, items) == plain_search(TEXTS, items)
    assert got_search(spark, [], items) == [] and got_search(spark, TEXTS, []) == []
    clash = edge(spark).withColumn("rank", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("id", F.lit(1))
    assert ranked_search.ranked(clash, spark.createDataFrame(items, "item_id bigint, text string")).count() == len(plain_search(TEXTS, items))


def test_search_opens_few_nodes_and_lists_read_both_ways():
    """Interval fronts are the highest impacts of a range; with one clear winner few nodes are opened."""
    rng = np.random.default_rng(1)
    n, term = 4096, np.repeat(np.arange(3), 4096)
    doc, impact = np.tile(np.arange(n), 3), rng.integers(1, 500, 3 * n)
    impact[[77, n + 77]] = 900_000
    index = ranked_search.DualSorted(term, doc, impact, 3, n)
    for t in range(3):
        own = impact[term == t]
        assert (np.diff(index.impact[0, index.first[t] : index.first[t + 1]]) <= 0).all()
        assert index.impact[0, index.first[t]] == own.max()
    items = ranked_search.Items([["a b"]])
    best = ranked_search.Best(1, 1)
    opened = ranked_search.search(index, items, np.ones(3, np.int64), np.arange(n), np.zeros(n, bool), best, opened=1)
    assert best.id.tolist() == [77] and opened <= 3 * index.depth
