"""The vector index against all pairs, and records on small rows; whole tables are in test_catalog."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.operators import records, reports
from clausework.operators import search as S
from clausework.operators import vectors as V


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} bigint, embedding array<float>")


def plain(x, q, k):
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(np.float32(q).astype(float)) @ unit(np.float32(x).astype(float)).T, 4)
    return sorted((i, int(j), rank + 1) for i in range(len(q)) for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:k]))


def clustered(seed, n=400, dim=12, groups=10):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, dim)) * 0.3


@pytest.mark.parametrize("seed, lists, part", [(1, None, 20_000), (2, 10, 17), (3, 1, 50)])
def test_index_is_exact(spark, monkeypatch, seed, lists, part):
    monkeypatch.setattr(V, "PART", part)
    x, rng = clustered(seed), np.random.default_rng(seed + 9)
    x[7] = x[8] = x[9]  # ties
    q = np.concatenate([x[:6] + 0.01, rng.normal(size=(4, 12)), x[9:10]])
    want = plain(x, q, 5)
    v, asked = frame(spark, x), frame(spark, q, "qid")
    assert sorted((r.qid, r.id, r.rank) for r in V.all_pairs(v, asked, 5).collect()) == want
    hits, share = V.nearest(V.build(v, lists), asked, 5, first=1)
    assert sorted((r.qid, r.id, r.rank) for r in hits.collect()) == want and 0 < share <= 1


def test_index_leaves_far_lists_closed(spark):
    x = clustered(5, n=600, dim=8, groups=12)
    hits, share = V.nearest(V.build(frame(spark, x), 12), frame(spark, x[:5], "qid"), 3, first=1)
    assert share < 0.6 and hits.count() == 15


def test_index_of_few_or_no_vectors(spark):
    x = np.eye(3)
    hits, _ = V.nearest(V.build(frame(spark, x)), frame(spark, x[:1], "qid"), 5)
    assert sorted((r.id, r.score) for r in hits.collect()) == [(0, 1.0), (1, 0.0), (2, 0.0)]
    assert S.indexed(frame(spark, np.zeros((0, 2))), frame(spark, np.zeros((0, 2)), "qid"), 3).count() == 0
    assert S.dense(frame(spark, x), frame(spark, np.zeros((0, 2)), "qid"), 3).count() == 0


def test_dense_in_blocks(spark, monkeypatch):
    x = clustered(6, n=60)
    want = plain(x, x[:9], 4)
    monkeypatch.setattr(S, "MAX_QUERIES", 4)
    for search in (S.dense, S.indexed):
        assert sorted((r.qid, r.id, r.rank) for r in search(frame(spark, x), frame(spark, x[:9], "qid"), 4).collect()) == want


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 40, list(np.random.default_rng(1).exponential(size=3000)), [0.0, 1e9, *np.linspace(0, 1, 99)]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "event_type string, value double")
    got = {r.event_type: (r.p50, r.p95) for r in reports.percentiles(df).collect()}
    assert got["a"] == pytest.approx((round(float(np.percentile(values, 50)), 4), round(float(np.percentile(values, 95)), 4)), abs=1e-4) and got["b"] == (1.0, 1.0)


def test_disposition_rules(spark):
    rows = [("edit", None, None), ("edit", " \t", None), ("edit", "x", None), ("reject", None, None), ("reject", None, "other"), ("reject", None, "mood"), ("accept", None, None), (None, None, None), ("burn", None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, t string, c string").select("i", records.disposition_problem(F.col("a"), F.col("t"), F.col("c")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == ["edited_text_required", "edited_text_required", None, "reason_code_required", None, "unknown_reason_code", None, "unknown_action", "unknown_action"]


def test_replacing_touches_named_keys_only(spark):
    kind = "doc_id int, clause string"
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], kind), spark.createDataFrame([(1, "z")], kind)
    assert sorted(map(tuple, records.replaced(old, new, ["doc_id"]).collect())) == [(1, "z"), (2, "c"), (3, "d")]
    touched = spark.createDataFrame([(1,), (3,)], "doc_id int")
    assert sorted(map(tuple, records.replaced(old, new, ["doc_id"], touched).collect())) == [(1, "z"), (2, "c")]


def test_requests_with_unknown_users_are_refused(spark):
    kind = "matter_id int, user_id int, access string"
    after, refused = records.members_after(spark.createDataFrame([(1, 1, "o"), (2, 1, "o")], kind), spark.createDataFrame([(1, 2, "n"), (2, 2, "n"), (2, 9, "n")], kind), spark.createDataFrame([(1,), (2,)], "user_id int"))
    assert sorted(map(tuple, after.collect())) == [(1, 2, "n"), (2, 1, "o")] and [tuple(r) for r in refused.collect()] == [(2, [9])]


def test_marks_tell_what_they_found(spark):
    sources = spark.createDataFrame([("a", "unverified", None, None)], "id string, review_status string, verified_by string, verified_at int")
    after, found = records.marked_verified(sources, spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "id string, by string, at int"))
    assert [tuple(r) for r in after.collect()] == [("a", "verified", "y", 2)] and {r.id: r.found for r in found.collect()} == {"a": True, "b": False}


def test_outcomes_and_dry_runs(spark):
    plan = lambda rows: spark.createDataFrame(rows, "request_id int, endpoint_id string, reason string, rank int")
    p = plan([(1, "a", None, 1), (1, "b", None, 2), (2, "a", None, 1), (3, "a", "budget_exceeded", None), (4, "a", "residency", None)])
    calls = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "a", False)], "request_id int, endpoint_id string, ok boolean")
    assert sorted(map(tuple, records.outcomes(p, calls).collect())) == [(1, "ok", "b", 2), (2, "all_failed", None, 1), (3, "budget_exceeded", None, 0), (4, "no_candidate", None, 0)]
    q = plan([(1, "a", None, 2), (1, "b", None, 1), (2, "a", None, 1), (3, "a", None, 1), (4, "a", "residency", None)])
    assert sorted(map(tuple, records.changed_choices(p, q).collect())) == [(1, "a", "b"), (3, None, "a")]


def test_findings_speak_vietnamese(spark):
    d = spark.createDataFrame([(1, "date", "primary", "2020-01-01", "high", 0.9), (1, "negation", "primary", "", "medium", 0.6)], "pair_id int, kind string, side string, value string, severity string, confidence double")
    prevailing = spark.createDataFrame([(5, None, "en")], "doc_id int, by_primary string, by_other string")
    got = records.version_findings(d, prevailing, spark.createDataFrame([(1, 5)], "pair_id int, doc_id int"), "vi").collect()
    assert [(r.summary, r.rationale[:38]) for r in got] == [("Ngày khác nhau giữa hai bản (chỉ bản tiếng Việt: 2020-01-01).", "Theo điều khoản ngôn ngữ, bản tiếng An")]


def test_requests_are_dealt_by_number_and_only_answers_are_joined(spark, monkeypatch):
    from clausework.operators import records, routing
    from clausework.plans import texts

    monkeypatch.setattr(routing, "PART_ROWS", 20)
    endpoints = spark.createDataFrame(texts.ENDPOINTS, texts.ENDPOINT_SCHEMA)
    requests = spark.createDataFrame([(i, *texts.REQUESTS[0][1:]) for i in range(40)], texts.REQUEST_SCHEMA)
    p = routing.plan(requests, endpoints)
    assert p.rdd.getNumPartitions() == 10  # 40 requests of 5 endpoints; dealt again they would be four
    plan = spark.createDataFrame([(1, "a", None, 1), (1, "b", None, 2), (2, "a", "budget_exceeded", None), (3, "a", "x", None), (4, "a", None, 1)], "request_id int, endpoint_id string, reason string, rank int")
    calls = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "a", True), (4, "a", None)], "request_id int, endpoint_id string, ok boolean")
    assert sorted(tuple(r) for r in records.outcomes(plan, calls).collect()) == [(1, "ok", "b", 2), (2, "budget_exceeded", None, 0), (3, "no_candidate", None, 0), (4, "all_failed", None, 1)]
