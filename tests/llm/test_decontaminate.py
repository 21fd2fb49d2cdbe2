import random
import re

import numpy as np

from clausework.llm import decontaminate as D
from tests.llm.edge import edge


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    held = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            k = min(window, len(w))
            for i in range(len(w) - k + 1):
                held.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in held}:
            for i in range(len(w) - k + 1):
                if own := held.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_index_search_and_locate_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 150))
        text = rng.integers(0, 4, n).astype(np.int32)
        text[-1] = 0
        marks = np.cumsum(text == 0) - 1
        ranked = [int(marks[i]) if text[i] == 0 else 1000 + int(text[i]) for i in range(n)]
        assert D.suffix_array(text).tolist() == sorted(range(n), key=lambda i: ranked[i:])
        index = D.FMIndex(text, 5, sample=4)
        for m in (1, 2, 3, 5):
            p = rng.integers(1, 5, m).astype(np.int32)
            row = np.zeros((1, 5), np.int32)
            row[0, 5 - m :] = p
            lo, hi = index.search(row, np.array([m]))
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [i for i in range(n - m + 1) if text[i : i + m].tolist() == p.tolist()]


def test_spans_match_brute_force_in_one_and_many_blocks(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "99"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.randint(1, 9))) for i in range(30)] + [(None, text(3)), (40, None), (41, "  "), (3, text(4))]
    docs = [(i, text(random.randint(0, 60)) + random.choice(["", ". ", " zzz "]) + (items[i % 30][1] or "").upper()) for i in range(60)] + [(60, None), (61, ""), (None, items[0][1]), (7, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, items, 4)
    for block in (D.BLOCK_BYTES, 150):
        got = D.removal_spans(d, b, window=4, shard_bytes=400, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == expected
        for r in got:
            assert all(x.end < y.first for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_odd_tables(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert D.removal_spans(edge(spark), b.limit(0)).where("n_hit > 0").count() == 0
    assert D.removal_spans(edge(spark).limit(0), b).count() == 0
    df = edge(spark)
    carried = D.removal_spans(df, b, carry=df.columns)
    assert carried.columns == [*df.columns, "__found"] and carried.count() == 11
