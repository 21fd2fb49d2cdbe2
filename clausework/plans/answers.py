"""Named queries on answers of models, scores against what was planted, and telemetry. Answers are written from orders and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausework.operators import answers, scores
from clausework.plans import written
from clausework.plans.catalog import query, table
from clausework.sources.tables import dealt
from clausework.streaming import ledger

_RULES = [("cap", "liability", "high", True), ("term", "term", "medium", False), ("notice", "notice", "low", False)]


def _outputs(spark, sf_dir):
    """(doc_id, output): JSON in prose, in fences and nested, with wrong rules, verdicts, indexes and confidences, and text that is none."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("doc_id"), k.cast("string").alias("k"), (k % 8).alias("m"))
    item = lambda rule, verdict, index, confidence: F.concat(F.lit(f'{{"rule_key": "{rule}", "classification": "{verdict}", "clause_index": '), index, F.lit(', "confidence": '), confidence, F.lit(', "summary": "clause {'), F.col("k"), F.lit('}"}'))
    good = item("cap", "non_standard", F.lit("1"), F.when(F.col("doc_id") % 3 == 0, "0.25").otherwise("0.75"))
    other = item("term", "standard", F.when(F.col("doc_id") % 5 == 0, "9").otherwise("0"), F.when(F.col("doc_id") % 7 == 0, "1.5").otherwise("0.5"))
    listed = F.concat(F.lit('{"findings": ['), good, F.lit(", "), other, F.lit("]}"))
    m = F.col("m")
    output = (
        F.when(m == 0, F.concat(F.lit("Here it is: "), listed, F.lit(" as asked.")))
        .when(m == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(m == 2, F.concat(F.lit('{"findings": ['), item("gap", "standard", F.lit("0"), F.lit("0.9")), F.lit(", "), item("cap", "fine", F.lit('"x"'), F.lit('"high"')), F.lit(", 7]}")))
        .when(m == 3, F.concat(listed, F.lit(" and } more")))
        .when(m == 4, "no object at all")
        .when(m == 5, '{"notes": {"findings": []}}')
        .when(m == 6, F.concat(F.lit('{"findings": ['), good, F.lit("]}")))
    )
    clauses = parts.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit("term").alias("clause_key")), F.struct(F.lit(1).alias("idx"), F.lit("liability").alias("clause_key")))).alias("c")).select("doc_id", "c.*")
    return parts.select("doc_id", output.alias("output")), spark.createDataFrame(_RULES, "rule_key string, clause_key string, severity string, required boolean"), clauses


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 8 AS m FROM part), s AS (SELECT doc_id, 'clause {' || doc_id || '}' AS summary, m FROM p)
SELECT doc_id, 0::BIGINT AS at, 'cap' AS rule_key, 'liability' AS clause_key, 1::BIGINT AS clause_index, 'non_standard' AS classification, 'high' AS severity, CASE WHEN doc_id % 3 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS confidence, summary FROM s WHERE m IN (0, 1, 6)
UNION ALL SELECT doc_id, 1, 'term', 'term', CASE WHEN doc_id % 5 <> 0 THEN 0 END, 'standard', 'info', CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0.5 END, summary FROM s WHERE m IN (0, 1)""")
def loose_findings(spark, sf_dir):
    """Findings read from loose text."""
    return answers.findings_of(*_outputs(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 8 AS m FROM part)
SELECT doc_id, NULL::BIGINT AS at, CASE m WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'no_findings' ELSE 'no_object' END AS violation FROM p WHERE m IN (3, 4, 5, 7)
UNION ALL SELECT doc_id, 1, 'unknown_clause' FROM p WHERE m IN (0, 1) AND doc_id % 5 = 0
UNION ALL SELECT doc_id, 1, 'odd_confidence' FROM p WHERE m IN (0, 1) AND doc_id % 7 = 0
UNION ALL SELECT doc_id, x.a, x.v FROM p, (VALUES (0, 'unknown_rule'), (1, 'unknown_class'), (1, 'unknown_clause'), (1, 'odd_confidence'), (2, 'not_an_object')) x(a, v) WHERE m = 2""")
def loose_violations(spark, sf_dir):
    """What is wrong with loose text."""
    return answers.violations_of(*_outputs(spark, sf_dir))


@query("""SELECT p_partkey AS doc_id, p_partkey % 8 IN (0, 1) AND p_partkey % 3 <> 0 AS acceptable, CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 6 THEN 'term' ELSE 'cap,term' END AS missing FROM part""")
def acceptance(spark, sf_dir):
    """Answers that cover all rules they must, with confidence."""
    outputs, rules, clauses = _outputs(spark, sf_dir)
    found = answers.findings_of(outputs, rules, clauses)
    a = answers.accepted(outputs, found, rules, clauses)
    return a.select("doc_id", "acceptable", F.array_join("missing", ",").alias("missing"))


def _note_rows(spark, sf_dir):
    """Pairs (an order and its customer's unit; every eleventh order finds none), and the units."""
    c = F.col("c_custkey")
    text = F.concat(F.lit("Customer "), c.cast("string"), F.lit(" must repay all amounts due within "), (c % 60 + 1).cast("string"), F.lit(" days. Interest runs after that."))
    day = lambda s: F.lit(s).cast("date")
    units = table(spark, sf_dir, "customer").select(c.alias("unit_id"), text.alias("text"), day("2000-01-01").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("in_force").alias("status"))
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("pair_id"), F.when(k % 11 != 0, F.col("o_custkey")).alias("unit_id"), F.when(k % 2 == 0, "vi").otherwise("en").alias("language"))
    met = orders.join(units.select("unit_id", F.col("text").alias("unit_text")), "unit_id", "left")
    pairs = met.select("pair_id", F.lit("Repayment.").alias("issue"), "language", F.when(F.col("unit_text").isNotNull(), F.col("unit_id")).alias("unit_id"), "unit_text")
    return pairs, units


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS u FROM orders), c AS (SELECT o.*, c_custkey IS NOT NULL AS known FROM o LEFT JOIN customer ON c_custkey = u),
s AS (SELECT *, CASE WHEN NOT known THEN 0 WHEN k % 3 <> 0 THEN 1 WHEN k % 2 = 0 THEN 2 WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 3 WHEN k % 7 = 0 THEN -2 ELSE -3 END AS n FROM c),
q AS (SELECT *, '"Customer ' || u || ' must repay all amounts due within ' || (u % 60 + 1) || ' days" [[src:' || u || ']].' AS quote FROM s)
SELECT k AS pair_id, CASE WHEN n > 0 THEN 'accepted' ELSE 'needs_human' END AS status,
CASE WHEN n = 0 THEN '' WHEN n = 3 THEN 'Better: ' || 'Repayment: the provision states ' || quote WHEN n < 0 THEN 'He must pay.' ELSE CASE WHEN k % 2 = 0 THEN 'Repayment: quy định nêu ' ELSE 'Repayment: the provision states ' END || quote END AS note,
CASE WHEN n = 0 THEN 0 WHEN n = -3 THEN 0.3 WHEN n = -2 THEN 0.6 WHEN n = 3 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, abs(n)::INTEGER AS attempts,
CASE abs(n) WHEN 0 THEN '' WHEN 1 THEN 'first' WHEN 2 THEN 'retry' ELSE 'higher tier' END AS via, CASE WHEN n > 0 THEN '' WHEN n = 0 THEN 'no_sources' ELSE 'citation_validation_failed' END AS rationale FROM q""")
def law_check(spark, sf_dir):
    """Notes that quote the best unit; some fail and are asked for again with feedback, some go to a higher tier, some to a human."""
    pairs, units = _note_rows(spark, sf_dir)
    k = F.col("pair_id")
    right = answers.note_of_top_hit(F.col("issue"), F.col("unit_id"), F.col("unit_text"), F.col("language"))
    wrong_quote = F.concat(F.lit('It says "nobody has to pay anything" [[src:'), F.col("unit_id").cast("string"), F.lit("]]."))
    said = lambda note, sure: lambda rows: rows.select("pair_id", note.alias("note"), sure.alias("confidence"))
    first = said(F.when(k % 3 == 0, wrong_quote).otherwise(right), F.lit(0.6))
    # the retry is told what was wrong; without that it would make the same mistake
    retry = said(F.when((k % 2 == 0) & F.array_contains("feedback", F.concat(F.lit("misquoted: "), F.col("unit_id").cast("string"))), right).otherwise("He must pay."), F.lit(0.6))
    better = F.when(k % 5 != 0, F.concat(F.lit("Better: "), answers.note_of_top_hit(F.col("issue"), F.col("unit_id"), F.col("unit_text"), F.lit("en")))).otherwise("He must pay.")
    higher = lambda rows: said(better, F.when(k % 5 != 0, 0.9).otherwise(0.3))(rows.where(k % 7 != 0))
    return answers.law_notes(pairs, units, [("first", first), ("retry", retry), ("higher tier", higher)], "2024-06-01")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), planted AS (SELECT k, x.kind FROM (SELECT c_custkey AS k FROM customer), (VALUES (3, 'date'), (4, 'tax_code'), (5, 'number'), (6, 'figure_words')) x(m, kind) WHERE k % x.m = 0),
e AS (SELECT k, kind FROM planted WHERE k % 7 <> 0 UNION ALL SELECT k, 'amount' FROM c WHERE k % 11 = 0),
j AS (SELECT coalesce(e.kind, p.kind) AS kind, e.k IS NOT NULL AS e, p.k IS NOT NULL AND e.k IS NOT NULL AS hit, p.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.k = p.k) AS noise FROM e FULL JOIN planted p USING (k, kind))
SELECT kind, count(*) FILTER (e) AS n_expected, count(*) FILTER (hit) AS n_found, count(*) FILTER (hit OR noise) AS n_reported, count(*) FILTER (noise) AS n_noise,
round(coalesce(count(*) FILTER (hit)::DOUBLE / nullif(count(*) FILTER (e), 0), 0), 6) AS recall, round(coalesce((count(*) FILTER (hit OR noise) - count(*) FILTER (noise))::DOUBLE / nullif(count(*) FILTER (hit OR noise), 0), 0), 6) AS precision FROM j GROUP BY kind""")
def discrepancy_scores(spark, sf_dir):
    """Recall and precision of differences between versions by kind; some are planted but not expected, some expected but not planted."""
    got = written.bilingual_diffs(spark, sf_dir).select(F.col("pair_id").alias("k"), "kind").distinct()
    k = F.col("c_custkey")
    kinds = F.array_compact(F.array(*[F.when(k % m == 0, F.lit(kind)) for m, kind in ((3, "date"), (4, "tax_code"), (5, "number"), (6, "figure_words"), (11, "amount"))]))
    expected = table(spark, sf_dir, "customer").where(k % 7 != 0).select(k.alias("k"), F.explode(kinds).alias("kind"))
    return scores.discrepancy_scores(expected, got, ["k"], by_kind=True)


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r, l_linenumber FROM lineitem)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE r <> 3 OR l_linenumber % 5 <> 0) - count(*) FILTER (WHERE r = m AND m > 4 AND (r <> 3 OR l_linenumber % 5 <> 0)) AS n_right FROM (SELECT *, max(r) OVER (PARTITION BY doc_id) AS m FROM l) GROUP BY doc_id""")
def label_accuracy(spark, sf_dir):
    """Labels compared place by place: long documents lack the last one."""
    l = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")), "doc_id")  # noqa: E741
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = l.withColumn("place", place).withColumn("most", F.max("place").over(Window.partitionBy("doc_id")))
    gold = rows.select("doc_id", "pos", F.concat(F.lit("k"), F.col("place").cast("string")).alias("key"))
    wrong = (F.col("place") == 3) & (F.col("pos") % 5 == 0)
    predicted = rows.where((F.col("place") < F.col("most")) | (F.col("most") <= 4)).select("doc_id", "pos", F.when(wrong, "x").otherwise(F.concat(F.lit("k"), F.col("place").cast("string"))).alias("key"))
    return scores.positional_accuracy(predicted, gold)


@query("""SELECT l_orderkey AS doc_id, 'r' || l_returnflag AS rule_key, 'standard' AS want, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'standard' ELSE 'missing' END, l_linenumber) AS got, arg_max(l_linenumber % 2 = 0, l_linenumber) AS "right" FROM lineitem GROUP BY l_orderkey, l_returnflag
UNION ALL SELECT o_orderkey, 'none', 'missing', NULL, FALSE FROM orders""")
def verdict_accuracy(spark, sf_dir):
    """Verdicts by rule; the last of several counts, and some rules have none."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    actual = l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("r"), "l_returnflag").alias("rule_key"), F.col("l_linenumber").alias("at"), F.when(F.col("l_linenumber") % 2 == 0, "standard").otherwise("missing").alias("classification"))
    expected = actual.select("doc_id", "rule_key").distinct().withColumn("want", F.lit("standard")).union(table(spark, sf_dir, "orders").select("o_orderkey", F.lit("none"), F.lit("missing")))
    return scores.finding_accuracy(expected, actual)


_KINDS = ["review.started", "escalation.completed", "finding.dispositioned", "redline.edited", "citation.overridden", "export.created", "page.viewed"]


def _telemetry(spark, sf_dir):
    """Telemetry written from events: every type, one unknown, some payloads malformed or without their main field."""
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (i % len(_KINDS)).cast("int"))
    text = lambda s: F.lit(s)
    good = F.when(i % 7 == 0, text('{"playbook": "nda", "version": 2, "source": "ui"}')).when(i % 7 == 1, text('{"task": "law_check", "tier": "T2", "needs_human": false}')).when(i % 7 == 2, F.concat(text('{"action": "'), F.when(i % 3 == 0, "accept").otherwise("edit"), text('", "confidence": '), (i % 100 / 100).cast("string"), text(', "reviewer_role": "r'), (i % 4).cast("string"), text('"}')))
    good = good.when(i % 7 == 3, text('{"clause_key": "term", "final": "x"}')).when(i % 7 == 4, text('{"status": "misquoted"}')).when(i % 7 == 5, text('{"format": "docx"}')).otherwise(text("{}"))
    payload = F.when(i % 11 == 0, "not json").when(i % 13 == 0, '{"other": 1}').otherwise(good)
    return table(spark, sf_dir, "events").select(i.alias("event_id"), kind.alias("event_type"), payload.alias("payload"))


@query(f"""WITH e AS (SELECT event_id AS i, {str(_KINDS)}[event_id % {len(_KINDS)} + 1] AS event_type FROM events)
SELECT event_type, CASE WHEN i % 7 = 6 THEN 'unknown_type' WHEN i % 11 = 0 THEN 'malformed' WHEN i % 13 = 0 THEN 'incomplete' ELSE '' END AS problem, count(*) AS n FROM e GROUP BY 1, 2""")
def telemetry_types(spark, sf_dir):
    """Events by type and what is wrong with them."""
    return ledger.typed(_telemetry(spark, sf_dir)).groupBy("event_type", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


@query("""SELECT 'r' || (event_id % 4) AS reviewer_role, count(*) AS n, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS accepted, round(avg(event_id % 100 / 100), 6) AS confidence FROM events WHERE event_id % 7 = 2 AND event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1""")
def dispositions_by_role(spark, sf_dir):
    """Typed payloads aggregated."""
    return ledger.dispositions(ledger.typed(_telemetry(spark, sf_dir)))
