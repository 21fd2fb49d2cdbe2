"""Loose answers, rounds, scores and telemetry on small rows; whole tables are in test_catalog."""

import pytest
from pyspark.sql import functions as F

from clausework.operators import answers, ingest, scores
from clausework.streaming import ledger


@pytest.mark.parametrize("text, problem", [('x {"a": {"b": 1}} y', None), ("{}", None), ('{"a": 1} {"b": 2}', "invalid_json"), ('{"a": 1}, {"b": 2}', "invalid_json"), ('{"a": 1} }', "invalid_json"), ("{a}", "invalid_json"), ("none", "no_object"), ("", "no_object"), (None, "no_object"), ('[{"a": 1}]', None)])
def test_outermost_object(spark, text, problem):
    got = spark.createDataFrame([(text,)], "t string").select(answers.outermost_object(F.col("t")).alias("o")).first().o
    assert got.problem == problem and (got.json is None) == (problem is not None)


def test_each_round_reads_what_is_open(spark):
    asked = []

    def answerer(name, right, has=lambda: F.lit(True)):
        def ask(rows):
            asked.append((name, sorted((r.id, list(r.feedback), r.attempts) for r in rows.collect())))
            return rows.where(has()).select("id", F.when(right, "right").otherwise("wrong").alias("note"))

        return name, ask

    judge = lambda a: a.select("id", (F.col("note") == "right").alias("passed"), F.when(F.col("note") != "right", F.array(F.concat(F.lit("no "), F.col("id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("feedback"))
    i = F.col("id")
    got = answers.rounds(spark.range(6), "id", [answerer("a", i < 2), answerer("b", i == 2), answerer("c", i == 3, lambda: F.col("id") != 5)], judge, "note string")
    assert sorted((r.id, r.note, r.via, r.attempts, r.settled) for r in got.collect()) == [(0, "right", "a", 1, True), (1, "right", "a", 1, True), (2, "right", "b", 2, True), (3, "right", "c", 3, True), (4, "wrong", "c", 3, False), (5, "wrong", "b", 2, False)]
    assert asked == [("a", [(k, [], 0) for k in range(6)]), ("b", [(k, [f"no {k}"], 1) for k in range(2, 6)]), ("c", [(k, [f"no {k}"], 2) for k in range(3, 6)])]


def test_rounds_end_when_all_is_settled(spark):
    def never(rows):
        raise AssertionError("nobody is left to ask")

    judge = lambda a: a.select("id", F.lit(True).alias("passed"), F.array().cast("array<string>").alias("feedback"))
    got = answers.rounds(spark.range(2), "id", [("a", lambda r: r.select("id", F.lit("x").alias("note"))), ("b", never)], judge, "note string")
    assert {r.attempts for r in got.collect()} == {1}
    assert answers.rounds(spark.range(0), "id", [("a", lambda r: r.select("id", F.lit("x").alias("note")))], judge, "note string").count() == 0


def test_acceptance_needs_required_rules_and_those_of_present_clauses(spark):
    rules = spark.createDataFrame([("a", "x", True), ("b", "y", False), ("c", "z", False)], "rule_key string, clause_key string, required boolean")
    clauses = spark.createDataFrame([(1, "y"), (2, "y"), (3, "q"), (4, "y")], "doc_id bigint, clause_key string")
    found = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.9), (3, "a", 0.4), (3, "c", 0.9)], "doc_id bigint, rule_key string, confidence double")
    got = {r.doc_id: (r.acceptable, r.missing) for r in answers.accepted(clauses.select("doc_id"), found, rules, clauses).collect()}
    assert got == {1: (True, []), 2: (False, ["b"]), 3: (False, []), 4: (False, ["a", "b"])}


def test_labels_of_a_closed_list(spark):
    segments = spark.createDataFrame([(1, 0, "A", "t", "B", "u"), (1, 1, "", "x" * 2000, "H", ""), (1, 2, "C", "", "", "")], "doc_id bigint, idx bigint, heading string, text string, heading_alt string, text_alt string")
    labels = spark.createDataFrame([(1, 0, "term", 1.5), (1, 1, "strange", -1.0)], "doc_id bigint, idx bigint, key string, confidence double")
    assert [(r.key, r.confidence) for r in answers.labelled(segments, labels, ["term"]).orderBy("idx").collect()] == [("term", 1.0), ("other", 0.0), ("other", 0.0)]
    assert [(r.heading, len(r.text)) for r in answers.label_texts(segments).orderBy("idx").collect()] == [("A / B", 3), ("H", 1500), ("C", 0)]


def test_scores_of_sets_and_places(spark):
    kinds = lambda rows: spark.createDataFrame(rows, "k int, kind string")
    s = scores.discrepancy_scores(kinds([(1, "date"), (1, "amount"), (2, "date")]), kinds([(1, "date"), (1, "date"), (1, "number"), (3, "date"), (3, "amount")]), ["k"]).first()
    # a number where something else is expected is no noise; what is reported of 3 is
    assert tuple(s) == (3, 1, 3, 2, round(1 / 3, 6), round(1 / 3, 6))
    assert tuple(scores.discrepancy_scores(kinds([]), kinds([]), ["k"]).first()) == (0, 0, 0, 0, 0.0, 0.0)
    keys = lambda rows: spark.createDataFrame(rows, "doc_id int, pos int, key string")
    got = scores.positional_accuracy(keys([(1, 5, "a"), (1, 9, "x"), (1, 11, "c")]), keys([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")])).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 1, 0)]


def test_ingestion_parts_languages_by_document(spark):
    rows = [
        (1, 0, "Điều 1. Giao hàng: Bên bán phải giao hàng.", []), (1, 1, "Article 1. Delivery: The seller shall deliver it to the party.", []), (1, 2, "Điều 2. Giá cả. Bên mua phải trả.", []), (1, 3, "Article 2. Price. The buyer shall pay the party in full.", []),
        (2, 0, "This services agreement is made by Acme Trading Pte. Ltd. and the party of Singapore.", []), (2, 1, "1. Delivery. The seller shall deliver it to the party.", []),
    ]
    blocks = spark.createDataFrame([(*r, False) for r in rows], "doc_id bigint, pos int, text string, cells array<string>, is_heading boolean")
    hints = spark.createDataFrame([("delivery", 0, "deliver"), ("price", 1, "price")], "key string, ord int, hint string")
    documents, found = ingest.reviewed(blocks, {"SERVICES": ["services agreement"]}, {"SG": ["singapore"]}, hints)
    told = {r.doc_id: (r.contract_type, r.law, r.parties, r.primary, r.other, r.output, r.layout) for r in documents.collect()}
    assert told == {1: ("OTHER", None, [], "vi", "en", "both", "paragraphs"), 2: ("SERVICES", "SG", ["Acme Trading Pte. Ltd."], "en", None, "en", "single")}
    got = [(r.doc_id, r.number, r.heading, r.heading_alt, r.text_alt, r.clause_key) for r in ingest.comparable(found).orderBy("doc_id", "idx").collect()]
    assert got == [(1, "1", "Giao hàng", "Delivery", "The seller shall deliver it to the party.", "delivery"), (1, "2", "Giá cả", "Price", "The buyer shall pay the party in full.", "price"), (2, "1", "Delivery", "", "", "delivery")]


EVENTS = [(1, "export.created", '{"format": "docx"}'), (2, "export.created", "{}"), (3, "export.created", "no"), (4, "other", "{}"), (5, "finding.dispositioned", '{"action": "accept", "confidence": "high"}'), (6, None, None), (7, "review.started", None)]


def test_typed_events(spark):
    got = {r.event_id: r for r in ledger.typed(spark.createDataFrame(EVENTS, "event_id bigint, event_type string, payload string")).collect()}
    assert {i: r.problem for i, r in got.items()} == {1: None, 2: "incomplete", 3: "malformed", 4: "unknown_type", 5: "malformed", 6: "unknown_type", 7: "malformed"}
    assert got[1].export_created.format == "docx" and got[1].review_started is None and got[3].payload == "no"


def test_a_batch_replayed_after_a_failure_is_there_once(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    schema = "event_id bigint, event_type string, payload string"
    spark.createDataFrame(EVENTS[:4], schema).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    failed = []

    def once(batch_id):
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("killed behind the write")

    with pytest.raises(Exception, match="killed behind the write"):
        ledger.start(stream(), table, checkpoint, failing=once).awaitTermination(60)
    assert spark.read.parquet(table).count() == 4  # written, not marked as done
    ledger.start(stream(), table, checkpoint, failing=once).awaitTermination(60)
    spark.createDataFrame(EVENTS[4:], schema).coalesce(1).write.mode("append").parquet(folder)
    ledger.start(stream(), table, checkpoint).awaitTermination(60)
    rows = spark.read.parquet(table).select("event_id").collect()
    assert sorted(r.event_id for r in rows) == [1, 2, 3, 4, 5, 6, 7]


def test_places_are_compared_in_partitions_of_bounded_rows(spark, monkeypatch):
    from clausework.operators import scores
    from clausework.sources import tables

    monkeypatch.setattr(tables, "PART_ROWS", 50)
    gold = spark.sql("SELECT id div 4 AS doc_id, id % 4 AS pos, CAST(id % 4 AS STRING) AS key FROM range(400) UNION ALL SELECT NULL, 0, '0'")
    said = spark.sql("SELECT id div 3 AS doc_id, id % 3 AS pos, CAST(id % 3 AS STRING) AS key FROM range(303) UNION ALL SELECT NULL, 0, '0'")  # document 100 is not asked for
    got = scores.positional_accuracy(said, gold)
    assert got.rdd.getNumPartitions() >= 16  # twice 401 rows; as many as there were shuffle partitions before
    assert sorted(tuple(r) for r in got.collect() if r.doc_id is not None) == [(i, 4, 3) for i in range(100)]
    assert [(r.n, r.n_right) for r in got.collect() if r.doc_id is None] == [(1, 0)]
