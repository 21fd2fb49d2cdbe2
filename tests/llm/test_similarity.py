import random
import re

import pytest
from pyspark.sql import functions as F

from clausework.llm import line_dedup as L
from clausework.llm import ngram_join as N
from clausework.llm.linkage import connected_components
from tests.llm.edge import TEXTS, edge


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components(nodes, edges)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def family(base, n, edits, vocabulary):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, k, num):
    random.seed(k)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choice(vocabulary) for _ in range(40))
    texts = []
    for size in (12, 30, 90, 150):
        for _ in range(5):
            base = [random.choice(vocabulary) for _ in range(size)]
            texts += family(base, 9, max(1, size // 22), vocabulary)
            texts += [t + " " + passage for t in family(base, 3, 2, vocabulary)]
    texts += [texts[0], texts[0].upper(), "", None, "a", "A", "a b", "a b c d e f"]
    rows = list(enumerate(texts, 100))
    random.shuffle(rows)
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    expected = components(sets, links)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(df, k=k, num=num).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in sets.items()}
    # bounds on what is common do not change the result
    assert {r.doc_id: r.component_id for r in N.components(df, k=k, num=num, max_common=0).collect()} == expected


def test_join_on_odd_tables(spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in N.components(edge(spark)).collect())
    assert len(got) == 11 and (4, 0, 4) in got and (5, 0, 5) in got and (6, 0, 6) in got
    assert [x for x in got if x[0] in (1, 2)] == [(i, len(shingles(t, 4)), 1) for i, t in TEXTS if i in (1, 2)]
    assert N.components(edge(spark).limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = random.randint(0, len(out))
        kind = random.randint(0, 2)
        if kind == 0:
            out.insert(at, random.choice(letters))
        elif at < len(out):
            if kind == 1:
                del out[at]
            else:
                out[at] = random.choice(letters)
    return "".join(out)


def test_banded_distance_matches_dynamic_programming():
    random.seed(9)
    for _ in range(4000):
        k = random.randint(1, 3)
        a = "".join(random.choice("abé") for _ in range(random.randint(0, 12)))
        b = changed(a, random.randint(0, 4), "abé")
        assert L.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def brute_lines(docs, edits, least):
    trim = " \t\n\x0b\x0c\r"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    lines = sorted((i, n, low(x).strip(trim)) for i, t in docs for n, x in enumerate((t or "").split("\n")) if x.strip(trim))
    texts = sorted({x for _, _, x in lines})
    number = {x: i for i, x in enumerate(texts)}
    links = [(number[a], number[b]) for a in texts for b in texts if a < b and min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    group = components(range(len(texts)), links)
    own, top = {}, {}
    for i, n, x in lines:
        own.setdefault(x, (i, n))
        top.setdefault(group[number[x]], (i, n))
    return {(i, n): (own[x] != (i, n), own[x] == (i, n) and top[group[number[x]]] != (i, n)) for i, n, x in lines}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_decisions_match_brute_force(spark, edits):
    random.seed(edits)
    letters = "abcdeé "
    base = ["".join(random.choice(letters) for _ in range(random.randint(6, 40))).strip() + "x" for _ in range(25)]
    docs = []
    for i in range(60):
        own = [changed(random.choice(base), random.choice([0, 0, 1, 2, 3]), "abé") for _ in range(random.randint(0, 6))]
        docs.append((i, "\n".join(x.upper() if random.random() < 0.1 else f" {x}\r" if random.random() < 0.1 else x for x in own)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {(r.key, r.number): (r.exact, r.near) for r in L.decisions(df, edits=edits, min_chars=10).collect()}
    assert got == brute_lines(docs, edits, 10)
    cut = {r.doc_id: r.text for r in L.deduplicated(df, edits=edits, min_chars=10).collect()}
    for i, t in docs:
        assert cut[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if not any(got.get((i, n), (False,))))


def test_crowded_segments_match_brute_force(spark):
    random.seed(11)
    letters = "abcdefgh"
    word = lambda: "".join(random.choice(letters) for _ in range(random.randint(4, 7)))
    pool, docs = [word() for _ in range(6)], []
    for _ in range(2):
        base = [word() for _ in range(9)]
        for _ in range(70):
            w = list(base)
            w[random.randrange(9)] = random.choice(pool) if random.random() < 0.5 else word()
            docs.append((len(docs), changed(" ".join(w), random.choice([0, 0, 1, 2]), letters)))
        docs.append((len(docs), " ".join(base)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for edits in (1, 2):
        got = {(r.key, r.number): (r.exact, r.near) for r in L.decisions(df, edits=edits, min_chars=10).collect()}
        assert got == brute_lines(docs, edits, 10)


def test_lines_of_odd_tables(spark):
    df = edge(spark)
    got = {r.doc_id: r for r in L.counts(df).collect()}
    assert (got[1].n_lines, got[1].n_exact, got[1].n_near) == (3, 1, 0)
    assert (got[2].n_exact, got[2].kept_chars) == (3, 0)
    assert (got[3].n_lines, got[3].n_near) == (2, 1)
    assert got[4].n_lines == got[5].n_lines == got[6].n_lines == 0
    out = L.deduplicated(df, count_col="__n")
    assert out.columns == [*df.columns, "__n"] and out.count() == 11
    assert out.where(F.col("doc_id") == 2).first().text == ""
    assert L.deduplicated(df.limit(0)).count() == 0


def long_lines(n_docs):
    """Documents of long lines with replaced, added and lost words, a shared passage, CJK text and a very long line."""
    vocabulary = [f"w{i}" for i in range(400)]
    pick = lambda n: [random.choice(vocabulary) for _ in range(n)]
    bases = [pick(n) for n in (19, 20, 21, 39, 40, 60, 61, 100, 130, 400)] + [["the"] * 45, [chr(0x4E00 + random.randint(0, 900)) for _ in range(50)]]
    passage, docs = pick(30), []
    for i in range(n_docs):
        own = []
        for _ in range(random.randint(1, 4)):
            w = list(random.choice(bases))
            cjk = "一" <= w[0][0]
            for _ in range(random.choice([0, 1, 1, 2, 3, len(w) // 20, len(w) // 20 + 1])):
                at, kind = random.randrange(len(w)), random.randint(0, 2)
                w[at : at + (kind != 1)] = [random.choice(vocabulary)] * (kind != 2)
            own.append(("" if cjk else " ").join(w))
        docs.append((i, "\n".join([*own, " ".join(pick(15) + passage + pick(15))])))
    return docs


def test_long_lines_with_replaced_words_match_brute_force(spark):
    random.seed(5)
    docs = long_lines(60)
    texts = sorted({x for _, t in docs for x in t.split("\n")})
    split = {x: re.findall("[一-鿿]|[^ 一-鿿]+", x) for x in texts}
    number = {x: i for i, x in enumerate(texts)}

    def near(a, b):
        w, v = split[a], split[b]
        bound = min(len(w), len(v)) // 20
        if abs(len(w) - len(v)) <= bound and len(set(w) - set(v)) <= bound and distance(w, v) <= bound:
            return True
        return abs(len(a) - len(b)) <= 2 and L.within(a, b, 2)

    group = components(range(len(texts)), [(number[a], number[b]) for a in texts for b in texts if a < b and near(a, b)])
    assert len({group[x] for x in group}) > 70 and len(group) - len(set(group.values())) > 30
    own, top = {}, {}
    lines = [(i, n, x) for i, t in docs for n, x in enumerate(t.split("\n"))]
    for i, n, x in lines:
        own.setdefault(x, (i, n))
        top.setdefault(group[number[x]], (i, n))
    want = {(i, n): (own[x] != (i, n), own[x] == (i, n) and top[group[number[x]]] != (i, n)) for i, n, x in lines}
    got = {(r.key, r.number): (r.exact, r.near) for r in L.decisions(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == want


def test_word_distance_matches_dynamic_programming():
    random.seed(4)
    for _ in range(3000):
        a = [random.choice("abc") for _ in range(random.randint(4, 16))]
        b = list(changed("".join(a), random.randint(0, 5), "abc"))
        assert L.words_within(a, b, 4) == (distance(a, b) <= min(len(a), len(b)) // 4), (a, b)


def test_texts_without_id_or_with_one_id_lose_their_own_lines_alone(spark):
    rows = [(1, "seen before in the first text"), (None, "a line that comes twice here\na line that comes twice here"), (None, "top b\nonly here, far from all others"), (None, "x1\n\nthe same line at the same number"), (None, "y1\n\nthe same line at the same number")]
    rows += [(7, "z1\nseen before in the first text"), (7, "z2\nstays as no other line is like it"), (7, "z2\nstays as no other line is like it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.text for r in L.deduplicated(df).collect())
    same = [t for t in got if t[:2] in ("x1", "y1")]
    assert sorted(len(t.split("\n")) for t in same) == [2, 3]
    assert [t for t in got if t not in same] == sorted(["seen before in the first text", "a line that comes twice here", "top b\nonly here, far from all others", "z1", "z2\nstays as no other line is like it", "z2\nstays as no other line is like it"])
    assert sorted((r.n_lines, r.n_exact) for r in L.counts(df).collect() if r.doc_id == 7) == [(2, 0), (2, 0), (2, 1)]


def refined_pairs(spark, texts, by_words=False):
    """Candidate pairs that crowded lines of one anchor still have under their finer keys."""
    import pyarrow as pa

    rows = [{"q": i + 1, "h": 0, "q_text": t, "h_text": texts[0]} for i, t in enumerate(texts[1:])]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("q", pa.int64()), ("h", pa.int64()), ("q_text", pa.string()), ("h_text", pa.string())]))
    beyond = next(L._beyond(by_words)(iter([batch])))
    counts = {}
    for grams in beyond.column("grams").to_pylist():
        for g in grams:
            counts[g["gram"]] = counts.get(g["gram"], 0) + 1
    most = max(8.0, len(rows) / 8)
    common = [{"gram": g, "n": n} for g, n in counts.items() if n > max(8, sum(counts.values()) / L.MOST_GRAMS)]
    keyed = pa.RecordBatch.from_arrays([*beyond.columns, pa.array([common] * len(rows)), pa.array([most] * len(rows))], names=[*beyond.schema.names, "common", "most"])
    held, asked = {}, {}
    for r in (r for b in L._keyed(2, 20, by_words)(iter([keyed])) for r in b.to_pylist()):
        for x in r["both"] + r["own"]:
            held[x] = held.get(x, 0) + 1
        for x in r["both"] + r["asks"]:
            asked[x] = asked.get(x, 0) + 1
    return sum(n * held.get(x, 0) for x, n in asked.items())


def test_candidates_of_crowded_lines_stay_far_below_all_pairs(spark):
    numbered = lambda i: f"the same text with a number at its end {i * 7919 % 100_000}"
    small, large = (refined_pairs(spark, [numbered(i) for i in range(n)]) for n in (400, 1600))
    assert large < 1600 * 90 and large < 6.5 * small, (small, large)
    # one short word of fourteen replaced: what is left is a small part of all pairs
    replaced = lambda i: " ".join("w%d" % (i * 31 % 977) if j == i % 14 else f"word{j}" for j in range(14))
    assert refined_pairs(spark, [replaced(i) for i in range(1600)]) < 1600 * 1600 / 7


def test_lines_of_rows_without_id_link(spark):
    rows = [(None, "a line that is nearly the same as another"), (None, "a line that is nearly the sane as another"), (3, "x")]
    got = sorted((r.exact, r.near) for r in L.decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).where("size > 5").collect())
    assert sorted(got) == [(False, False), (False, True)]


def test_removed_lines_name_the_first_of_their_class(spark):
    line = "a line that is nearly the same as another"
    rows = [(1, f"first\n{line}"), (2, f"{line}\nown words here"), (3, line.replace("same", "sane")), (4, None)]
    got = {r.doc_id: (r.removed_lines, r.first_ids, r.first_lines) for r in L.counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ([], [], []), 2: ([0], [1], [1]), 3: ([0], [1], [1]), 4: ([], [], [])}


def test_equal_ids_with_different_texts_have_the_links_of_each(spark):
    random.seed(8)
    long, short = ([f"{p}{random.randint(0, 10**6)}" for _ in range(n)] for p, n in (("a", 60), ("b", 12)))
    near = long[:30] + ["changed"] + long[31:]
    rows = [(5, " ".join(long)), (5, " ".join(short)), (9, " ".join(near)), (7, " ".join(short) + " x")] + [(100 + i, " ".join(f"c{i}{j}" for j in range(20))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in N.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got[9] == got[7] == got[5] == 5 and all(got[i] == i for i in range(100, 120))


def test_an_anchors_common_grams_are_read_once_and_batches_are_small(spark, monkeypatch):
    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert L.decisions(spark.createDataFrame([(1, "a line that stands alone here")], "doc_id bigint, text string")).count() == 1
    sizes = spark.range(5000).repartition(1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n bigint").agg({"n": "max"}).first()[0]
    assert sizes <= 1000
    common = [{"gram": g, "n": 9} for g in range(2048)]
    grams = [[{"gram": g, "pos": g - 3}] for g in range(40)]
    columns = [pa.array(range(40), pa.int64()), pa.array([0] * 20 + [1] * 20, pa.int64()), pa.array(["some text of a line"] * 40), pa.array(grams), pa.array([common] * 20 + [None] * 20), pa.array([8.0] * 40)]
    batch = pa.RecordBatch.from_arrays(columns, names=["node", "h", "text", "grams", "common", "most"])
    rows = [r for b in L._keyed(2, 20, False)(iter([batch])) for r in b.to_pylist()]
    # common grams give the first anchor's lines no changed place, the other's lines keep theirs
    assert [r["rank"] for r in rows] == [0] * 20 + [1] * 20


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from clausework.llm.shared import CLEANUP, drop, written

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.length()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    setting, before = spark.conf.get(CLEANUP), held()
    table = written(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(CLEANUP) == setting
    assert {(r.k, r["count"]) for r in table.collect()} == {(k, 715 if k < 2 else 714) for k in range(7)}
    drop(table)


def near_classes(lines, near):
    """The least member of each line's class, by brute force."""
    return components(range(len(lines)), [(a, b) for a in range(len(lines)) for b in range(a) if near(lines[a], lines[b])])


def test_lines_without_large_classes_take_no_joins_of_keys(spark, monkeypatch):
    from clausework.llm import linkage

    random.seed(12)
    pick = lambda n: [f"w{random.randrange(500)}" for _ in range(n)]
    passage, lines = pick(30), []
    for _ in range(40):  # all share a passage; every second one has a near copy
        w = pick(20) + passage + pick(20)
        lines += [" ".join(w)] + [" ".join([*w[:5], "other", *w[6:]])] * (len(lines) % 3 == 0)
    labels = []
    for module in (L, linkage):
        monkeypatch.setattr(module, "written", lambda df, label, f=module.written: labels.append(label) or f(df, label))
    got = {r.key: r.near for r in L.decisions(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)).collect()}
    first = near_classes(lines, lambda a, b: L.words_within(a.split(), b.split(), 20))
    assert got == {i: first[i] != i for i in first} and sum(got.values()) > 10
    assert "labelled" not in labels and len(labels) < 40, labels


def test_keys_of_large_classes_match_brute_force(spark, monkeypatch):
    random.seed(13)
    base, calls = [f"w{i}" for i in range(30)], []
    lines = [" ".join([*base[:14], f"x{i}", *base[15:]]) for i in range(150)] + [f"a row of some list with number {i:03d}" for i in range(160)]
    random.shuffle(lines)
    monkeypatch.setattr(L, "link_components", lambda *a, f=L.link_components: calls.append(a) or f(*a))
    got = {r.key: r.near for r in L.decisions(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)).collect()}
    first = near_classes(lines, lambda a, b: L.within(a, b, 2) or L.words_within(a.split(), b.split(), 20))
    assert calls and got == {i: first[i] != i for i in first}


def test_a_texts_last_word_ends_with_it(spark):
    words = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "the"), (2, words), (3, "the"), (4, words.replace("w7", "changed")), (5, "the")]
    got = {r.key: r.near for r in L.decisions(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()}
    assert got[4] and not got[2]
