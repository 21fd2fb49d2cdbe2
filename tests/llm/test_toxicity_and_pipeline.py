import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from clausework.llm import decontaminate, ngram_join, toxicity
from tests.llm.edge import edge
from tests.llm.test_packing_and_tokens import check_packed


@pytest.fixture(scope="module")
def small(spark):
    return "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, small):
    scored = toxicity.query(spark, small).cache()
    assert scored.count() == 1000 and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    both = scored.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out")
    right = both.where("predicted = toxic").count()
    assert right / both.count() > 0.93
    assert both.where("toxic = 0 AND predicted = 1").count() <= 2


def test_odd_documents_are_scored(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    df = edge(spark)
    out = model.score(df, "text", df.columns, "value")
    assert out.count() == 11 and out.where("value IS NULL").count() == 0
    none = toxicity.score(df, labels.limit(0)).collect()
    assert len(none) == 11 and {r.score for r in none} == {0.0}
    assert toxicity.score(df.limit(0), labels).count() == 0


def naive_features(text, stems):
    """FEATURES of one text, word by word; ``stems`` maps a stem's bytes to its weight."""
    import math
    import re

    data = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    word = rb"[0-9a-z\x80-\xff]+"
    words = re.findall(word, low)
    insults, second = ({x.encode() for x in own} for own in (toxicity.INSULTS, toxicity.SECOND_PERSON))

    def weight(w):
        return max([stems.get(("stem", w[:k]), 0.0) for k in toxicity.STEMS if len(w) >= k] + [stems.get(("word", w), 0.0)])

    weights = [weight(w) for w in words]
    hits = [w in insults or x > 0 for w, x in zip(words, weights, strict=True)]
    you = [i for i, w in enumerate(words) if w in second]
    near = sum(h and any(abs(i - j) <= toxicity.NEAR for j in you) for i, h in enumerate(hits))
    dropped = set(b"*!.-_'^~#%&+=,;:?()\"/\\|<>[]{}`")
    clear = bytes(ord(toxicity.DISGUISE.get(chr(b), chr(b))) if b < 128 else b for b in data if b not in dropped)
    clear = re.findall(word, bytes(b + 32 if 65 <= b <= 90 else b for b in clear))
    disguised = max(0, sum(w in insults or weight(w) > 0 for w in clear) - sum(hits))
    raw = re.findall(rb"[^\x20\x09-\x0d]+", data)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    upper, odd = (lambda b: 65 <= b <= 90), (lambda b: b in b"0134570@$!*")
    count = lambda test, own: sum(map(test, own))
    many, chars, r = max(1, len(words)), max(1, len(data)), max(1, len(raw))
    n_insults, learned = sum(w in insults for w in words), sum(x > 0 for x in weights)
    punctuation = {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)}
    return [
        100 * n_insults / many, 100 * learned / many, 100 * sum(weights) / many, max(weights, default=0.0), math.log1p(learned), math.log1p(n_insults),
        100 * near / many, 100 * len(you) / many, count(upper, data) / max(1, count(letter, data)),
        sum(count(upper, w) == count(letter, w) > 1 for w in raw) / r, count(lambda b: b in b"!?", data) / chars, count(lambda b: b in punctuation, data) / chars,
        sum(count(letter, w) > 1 and count(odd, w[:-1]) > 0 for w in raw) / r, disguised, math.log1p(len(words)),
    ]


def test_features_match_brute_force():
    import random

    import numpy as np
    import pyarrow as pa

    from clausework.llm import textnp

    random.seed(2)
    pool = ["you", "IDIOT", "1d10t!", "i.d.i.o.t", "scum", "Dein", "büro", "hello,", "A", "OK!", "w0rd", "grumble", "grumbling", "x*y", "¿qué?", "\n", "\t"]
    texts = [" ".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(80)] + ["", None, "!", "YOU scum"]
    # stems of one learned word, by the hashes that the operator itself makes of it
    data, offs = textnp.buffer(pa.array(["grumble"]))
    words = textnp.Words(data, offs, textnp.ALNUM)
    made = toxicity._stems(data, words)
    stems = np.array([made[1][0], made[-1][0]], np.uint64)
    order = np.argsort(stems)
    weights = np.array([1.5, 2.5])
    x = toxicity.features(*textnp.buffer(pa.array(texts, pa.string())), stems[order], weights[order])
    known = {("stem", b"grumb"): 1.5, ("word", b"grumble"): 2.5}
    assert np.allclose(x, [naive_features(t, known) for t in texts])


def test_obfuscated_words_count():
    import numpy as np
    import pyarrow as pa

    from clausework.llm import textnp

    none = np.zeros(0, np.uint64)
    x = toxicity.features(*textnp.buffer(pa.array(["you 1d10t!", "you i.d.i.o.t", "you idiot", "you all", None, ""])), none, np.zeros(0))
    at = toxicity.FEATURES.index
    assert x[0, at("disguised_hits")] == x[1, at("disguised_hits")] == 1 and x[2, at("disguised_hits")] == 0
    assert x[2, at("near_second_person")] == 50 and x[3, at("near_second_person")] == 0
    assert not x[4].any() and not x[5].any()


def test_stages_take_effect_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(edge(spark, extra=False), allowMissingColumns=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert ngram_join.components(docs, k=5, num=80).where("doc_id <> component_id").count() == 0
    found = decontaminate.removal_spans(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert found.where(decontaminate.contaminated()).count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packed(rows, [])
    assert sum(r.start == 0 for r in rows) == docs.count()


def test_stages_on_columns_of_clashing_names(spark, sf):
    docs = edge(spark)
    for name in ("__found", "__removed", "__other", "component_id", "__keep"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and docs.where("`__found` <> 'mine' OR `__removed` <> 'mine' OR key <> 'x'").count() == 0, name
    assert docs.where("doc_id IN (4, 5)").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
