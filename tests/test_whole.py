"""Operators over whole tables, where they once took less."""

import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clausework.functions import values as V
from clausework.operators import clauses as C
from clausework.operators import routing
from clausework.operators import search as S
from clausework.plans import catalog, texts
from clausework.streaming import limits


def test_dense_over_every_twentieth_vector(spark, sf, monkeypatch):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(v @ v.T, 4)
    want = {int(q): sorted(((-score[i, j], int(ids[j])) for j in range(len(ids))))[:20] for i, q in enumerate(ids) if q % 20 == 0}
    whole = sorted(map(tuple, catalog.QUERIES["dense_topk"](spark, sf).collect()))
    assert len(whole) == sum(map(len, want.values())) and {r[0] for r in whole} == set(want)
    assert all(abs(s + want[q][rank - 1][0]) < 2e-4 for q, _, s, rank in whole)
    monkeypatch.setattr(S, "MAX_QUERIES", 2)
    assert sorted(map(tuple, catalog.QUERIES["dense_topk"](spark, sf).collect())) == whole
    assert {r.qid for r in catalog.QUERIES["rrf_fusion"](spark, sf).collect()} == set(want)


def test_limiter_of_a_hot_key(spark):
    random.seed(3)
    hits = [(1, float(random.randint(0, 3000)), i) for i in range(600)] + [(None, float(random.randint(0, 400)), i) for i in range(600, 700)] + [(k, random.random() * 5000, 1000 + k) for k in range(50)] + [(1, None, 5000)]
    want = {}
    for key in {h[0] for h in hits}:
        own = sorted((h for h in hits if h[0] == key and h[1] is not None), key=lambda h: h[1:])
        want |= dict(zip((h[2] for h in own), limits.judge([h[1] for h in own], [], 2, 60.0)[0], strict=True))
    df = limits.limited(spark.createDataFrame(hits, "key bigint, at double, hit_id bigint").repartition(3), limit=2)
    assert {r.hit_id: r.allowed for r in df.collect()} == want | {5000: True}
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_catalogue_above_one_block(spark):
    one = spark.createDataFrame(texts.ENDPOINTS[1:2], texts.ENDPOINT_SCHEMA).drop("endpoint_id", "registry_pos")
    n = routing.MAX_ENDPOINTS + 50
    many = spark.range(n).select(F.concat(F.lit("e"), "id").alias("endpoint_id"), F.col("id").cast("int").alias("registry_pos")).join(one)
    got = routing.plan(spark.createDataFrame(texts.REQUESTS[:1], texts.REQUEST_SCHEMA), many)
    assert got.agg(F.count("*"), F.count_distinct("endpoint_id"), F.sum((F.col("rank") == F.substring("endpoint_id", 2, 9).cast("bigint") + 1).cast("int"))).first()[:] == (n, n, n)


def test_support_reads_every_turn(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = catalog.QUERIES["lexical_support_turns"](spark, sf)
    assert got.count() == c.count() - c.select("conv_id").distinct().count()


CONTRACT = ["This agreement is made today.", "1. Definitions. Terms have meanings.", "1.1 More terms.", "2. Term. The term is three (3) years.", "(a) renewal", "3. Liability: capped at S$ 2,500.50 in total", "Annex"]
FIXTURE = {
    "clause_segmentation": [(0, "", "Preamble", "This agreement is made today."), (1, "1", "Definitions", "Terms have meanings.\n1.1 More terms."), (2, "2", "Term", "The term is three (3) years.\n(a) renewal"), (3, "3", "Liability", "capped at S$ 2,500.50 in total"), (4, "", "Annex", "")],
    "clause_labels": [(0, "parties", 0.7), (1, "definitions", 0.91), (2, "term", 0.6), (3, "liability", 0.91), (4, "other", 0.0)],
    "rule_evaluation": [("r1", "fallback", 0.9), ("r2", "non_standard", 0.9), ("r3", "missing", 0.85), ("r5", "standard", 0.8), ("r6", "non_standard", 0.8)],
    "law_rule_pairs": [(2, "t1"), (3, "t2")],
    "routing_plan": [("byo", "no_byo_credential", 0), ("far", "", 1), ("near", "", 2), ("off", "endpoint_disabled", 0), ("rules", "", 3)],
}


def test_fixture_queries_run_over_whole_tables(spark, tmp_path):
    docs = [(1, "\n".join(CONTRACT), "en"), (2, "Mutual Non-Disclosure\nthree hundred and five", "en"), (3, "5.000.000 đồng at 12.5% or 3 phần trăm", "vi"), (4, None, "en"), (5, "\n".join(CONTRACT), "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "thời hạn 24 tháng"), (1, 1, "a term of 36 months"), (1, 2, "Personal data stays here. Nothing else"), (2, 0, "the rule applies abroad"), (2, 1, "Abroad the rule applies"), (2, 2, "")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    for name in ("clause_labels", "rule_evaluation", "law_rule_pairs"):
        got = rows(f"{name}_documents")
        assert [r[1:] for r in got if r[0] == 1] == [r[1:] for r in got if r[0] == 5] == FIXTURE[name]
    assert [r[1:] for r in rows("clause_segmentation_documents") if r[0] == 5] == FIXTURE["clause_segmentation"]
    assert [r[0] for r in rows("rule_evaluation_documents") if r[1] == "r3"] == [1, 2, 3, 4, 5]
    values = {r[0]: r[1:] for r in catalog.QUERIES["parse_values_documents"](spark, str(tmp_path)).collect()}
    assert len(values) == 5 and values[3] == ("", "VND 5000000.0", "12.5,3.0", "", "")
    assert (2, 1, 305) in rows("words_to_int_documents") and len(rows("words_to_int_documents")) == 17
    assert {(r[0], r[1], r[3], r[4]) for r in rows("bilingual_diffs_conversations") if r[2] == "duration"} >= {(1, 0, "primary", "24"), (1, 0, "other", "36")}
    cited = {r[:3]: r[3:] for r in rows("citation_validation_conversations")}
    assert cited[(2, 0, 0)][:2] == ("2-1", "supported") and cited[(1, 2, 1)][:2] == ("1-3", "invalid_source") and len(cited) == 6
    assert rows("contract_type_documents") == [(1, "OTHER"), (2, "NDA"), (3, "OTHER"), (4, "OTHER"), (5, "OTHER")]
    plan = rows("routing_plan_documents")
    assert len(plan) == 25 and sorted(r[1:] for r in plan if r[0] == 1) == FIXTURE["routing_plan"]


def test_citations_of_each_kind(spark):
    note = 'The rule applies to data transfer abroad [[src:u1]]. It says "personal data shall not leave" [[src:u1]]. Nothing is cited here. Old law holds [[src:u2]]. Unknown unit [[src:u9]]. It says "never written anywhere" [[src:u1]].'
    units = [("u1", "Personal data shall not leave the country; transfer abroad of data needs consent, and the rule applies.", "2014-07-02", None, "in_force"), ("u2", "Old law.", "1990-01-01", "2000-01-01", "repealed")]
    u = spark.createDataFrame(units, "unit_id string, text string, effective_from string, effective_to string, status string").withColumns({c: F.to_date(c) for c in ("effective_from", "effective_to")})
    got = [tuple(r)[1:] for r in S.validated(spark.createDataFrame([(1, note)], "note_id bigint, text string"), u, "2024-06-01").orderBy("claim_no").collect()]
    assert got == [(0, "u1", "supported", 1.0), (1, "u1", "supported", 0.9), (2, "", "uncited", 0.0), (3, "u2", "not_in_force", 0.0), (4, "u9", "invalid_source", 0.0), (5, "u1", "misquoted", 0.0)]


def test_routing_of_three_requests(spark):
    p = routing.plan(spark.createDataFrame(texts.REQUESTS, texts.REQUEST_SCHEMA), spark.createDataFrame(texts.ENDPOINTS, texts.ENDPOINT_SCHEMA))
    got = sorted((r.request_id, r.endpoint_id, r.reason or "", r.rank or 0) for r in p.collect())
    assert got == sorted([(1, *x) for x in FIXTURE["routing_plan"]] + [
        (2, "rules", "", 2), (2, "far", "", 1), (2, "near", "matter_conflict_deny", 0), (2, "byo", "matter_not_allowlisted", 0), (2, "off", "matter_not_allowlisted", 0),
        (3, "rules", "capability_missing:vision", 0), (3, "far", "residency", 0), (3, "near", "capability_missing:vision", 0), (3, "byo", "residency", 0), (3, "off", "endpoint_disabled", 0),
    ])


def test_only_clauses_that_a_rule_names_are_read(spark, monkeypatch):
    values = V.values
    monkeypatch.setattr(C.V, "values", lambda body: values(F.when(body.contains("unread"), F.raise_error(F.lit("read in vain"))).otherwise(body)))
    clauses = spark.createDataFrame([(1, 0, "Preamble", "unread", "parties"), (1, 1, "Term", "36 months", "term"), (1, 2, "Annex", "unread", "other"), (2, 0, "", "unread", None)], "doc_id bigint, idx bigint, heading string, text string, clause_key string")
    got = C.evaluated(spark.createDataFrame(texts.RULES, texts.RULE_SCHEMA), clauses, spark.range(1, 3).withColumnRenamed("id", "doc_id"))
    assert sorted(r[:3] for r in got.collect() if r.rule_key == "r1") == [(1, "r1", "fallback"), (2, "r1", "missing")]
