"""Answers of models as data: loose text to typed rows, acceptance, and rounds that ask again for what is still open.

An answer is text that should hold one JSON object.  Reading it never fails: what is wrong becomes a row of
violations.  ``rounds`` asks a list of answerers in turn, each only for the rows that no earlier one could
settle, and tells it what was wrong; what none settles is left for a human.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import search
from clausework.sources.tables import kept

#: Verdicts on a clause, those of citations that let a note stand, least confidence, longest summary, longest text of a label.
CLASSES = ["standard", "fallback", "non_standard", "missing"]
PASSING = ["supported", "partial"]
LEAST_CONFIDENCE, SUMMARY_CHARS, LABEL_CHARS = 0.5, 2000, 1500


def outermost_object(text: Column) -> Column:
    """(json, problem) of the outermost braces of a text: problem is no_object, invalid_json or null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    # as the one element of a list, so that text behind the object is an error
    listed = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    parsed = F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), listed)
    problem = F.when(found == "", "no_object").when(parsed.isNull(), "invalid_json")
    return F.struct(F.when(problem.isNull(), found).alias("json"), problem.alias("problem"))


def clamped(value: Column) -> Column:
    """A confidence between 0 and 1; 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(1.0)))


def _items(outputs: DataFrame) -> DataFrame:
    """``outputs(doc_id, output)`` with one row per listed finding; ``problem`` says why there is none."""
    rows = outputs.withColumn("o", outermost_object(F.col("output")))
    listed = rows.select("doc_id", "o.problem", F.from_json("o.json", "findings array<string>")["findings"].alias("items"))
    listed = listed.withColumn("problem", F.coalesce("problem", F.when(F.col("items").isNull(), "no_findings")))
    each = listed.select("doc_id", "problem", F.posexplode_outer("items").alias("at", "item"))
    kind = "rule_key string, classification string, clause_index string, confidence string, summary string"
    return each.select("doc_id", "problem", "at", F.from_json("item", kind).alias("x"), (F.col("item").isNotNull() & ~F.ltrim(F.col("item")).startswith("{")).alias("odd"))


def findings_of(outputs: DataFrame, rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """Findings that ``outputs(doc_id, output)`` list, as the rules allow them.

    Unknown rules and verdicts go, an index of no clause of the document becomes null, a standard clause is
    information only, confidences are clamped and summaries cut. ``rules`` has rule_key, clause_key, severity.
    """
    x = _items(outputs).where("problem IS NULL AND NOT odd").select("doc_id", "at", "x.*")
    known = x.where(F.col("classification").isin(CLASSES)).join(rules.select("rule_key", "clause_key", "severity"), "rule_key")
    index = F.col("clause_index").try_cast("bigint")
    held = clauses.select("doc_id", F.col("idx").cast("bigint").alias("index")).distinct()
    met = known.withColumn("index", index).join(held.withColumn("held", F.lit(True)), ["doc_id", "index"], "left")
    severity = F.when(F.col("classification") == "standard", "info").otherwise(F.col("severity"))
    return met.select("doc_id", F.col("at").cast("bigint").alias("at"), "rule_key", "clause_key", F.when(F.col("held"), F.col("index")).alias("clause_index"), "classification", severity.alias("severity"), clamped(F.col("confidence")).alias("confidence"), F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS).alias("summary"))


def violations_of(outputs: DataFrame, rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """(doc_id, at, violation): what is wrong with an output as a whole (at is null) or with one of its findings."""
    rows = _items(outputs).join(rules.select(F.col("rule_key").alias("known")), F.col("x.rule_key") == F.col("known"), "left")
    held = clauses.select("doc_id", F.col("idx").cast("bigint").alias("index")).distinct().withColumn("held", F.lit(True))
    rows = rows.withColumn("index", F.col("x.clause_index").try_cast("bigint")).join(held, ["doc_id", "index"], "left")
    confidence = F.col("x.confidence").try_cast("double")
    listed = F.col("at").isNotNull()
    wrong = {
        "not_an_object": listed & F.col("odd"), "unknown_rule": listed & ~F.col("odd") & F.col("known").isNull(), "unknown_class": listed & ~F.col("odd") & ~F.coalesce(F.col("x.classification").isin(CLASSES), F.lit(False)),
        "unknown_clause": F.col("x.clause_index").isNotNull() & F.col("held").isNull(), "odd_confidence": listed & ~F.col("odd") & ~F.coalesce(confidence.between(0, 1), F.lit(False)),
    }
    found = F.array_compact(F.array(F.col("problem"), *[F.when(test, F.lit(name)) for name, test in wrong.items()]))
    return rows.select("doc_id", F.col("at").cast("bigint").alias("at"), F.explode(found).alias("violation"))


def known_or(value: Column, known: list[str], default: str | None) -> Column:
    """A value of a closed list, else the default."""
    return F.when(value.isin(known), value).otherwise(F.lit(default))


def accepted(outputs: DataFrame, findings: DataFrame, rules: DataFrame, clauses: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(doc_id, acceptable, missing): whether an output answers all rules it must and is confident throughout.

    A rule must be answered if it is required or its clause is there. ``findings`` has doc_id, rule_key, confidence.
    """
    present = clauses.select("doc_id", "clause_key").distinct()
    needed = present.join(rules.where("NOT required").select("rule_key", "clause_key"), "clause_key").select("doc_id", "rule_key")
    always = rules.where("required").select("rule_key")
    every = outputs.select("doc_id").distinct()
    # one row per document and required rule: rules are a playbook's, a few dozen
    needed = needed.union(every.join(F.broadcast(always), F.lit(True)) if always.count() <= 10_000 else every.join(always, F.lit(True)))
    seen = findings.groupBy("doc_id", "rule_key").agg(F.min("confidence").alias("confidence"))
    open_rules = needed.distinct().join(seen, ["doc_id", "rule_key"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("rule_key")).alias("missing"))
    sure = findings.groupBy("doc_id").agg((F.min("confidence") >= least).alias("sure"))
    rows = every.join(open_rules, "doc_id", "left").join(sure, "doc_id", "left")
    return rows.select("doc_id", (F.col("missing").isNull() & F.coalesce("sure", F.lit(True))).alias("acceptable"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def rounds(open_rows: DataFrame, key: str, answerers: list[tuple[str, Callable[[DataFrame], DataFrame]]], judge: Callable[[DataFrame], DataFrame], payload: str) -> DataFrame:
    """(key, answer columns, attempts, via, settled, feedback): each answerer in turn for the rows that are still open.

    An answerer gets the open rows with ``feedback`` (what was wrong the last time) and gives rows of ``key`` and
    the columns of ``payload``, a schema; a row that it leaves out has no answerer of this kind and keeps its last
    answer. ``judge`` gives (key, passed, feedback) of answers. Each round's rows are kept, so a later round
    reads what is open and nothing else.
    """
    columns = [c.split()[0] for c in payload.split(", ")]
    none = F.array().cast("array<string>")
    todo = kept(open_rows.withColumns({"feedback": none, "attempts": F.lit(0)}), "round")
    last = todo.select(key, *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in payload.split(", ")], F.lit(None).cast("string").alias("via"), "attempts", "feedback")
    done = []
    for i, (name, ask) in enumerate(answerers):
        answers = kept(ask(todo).select(key, *columns), "round-answers")
        verdicts = judge(answers)
        now = answers.join(verdicts, key, "left").select(key, *columns, F.lit(name).alias("via"), F.lit(i + 1).alias("attempts"), F.coalesce("feedback", none).alias("feedback"), F.coalesce("passed", F.lit(False)).alias("passed"))
        now = kept(now, "round-judged")
        done.append(now.where("passed").drop("passed").withColumn("settled", F.lit(True)))
        again = now.where("NOT passed").drop("passed")
        last = kept(again.union(last.join(now.select(key), key, "left_anti")), "round-last")
        todo = kept(todo.drop("feedback", "attempts").join(again.select(key, "feedback", "attempts"), key), "round")
        if i + 1 < len(answerers) and todo.isEmpty():
            break
    return reduce(DataFrame.union, [*done, last.withColumn("settled", F.lit(False))])


def note_of_top_hit(issue: Column, unit_id: Column, unit_text: Column, language: Column) -> Column:
    """A note that quotes the first sentence of the best unit and cites it."""
    quote = F.concat(F.lit('"'), T.first_sentence(unit_text), F.lit('" [[src:'), unit_id.cast("string"), F.lit("]]."))
    return F.concat(F.rtrim(issue, F.lit(". ")), F.when(language == "vi", ": quy định nêu ").otherwise(": the provision states "), quote)


def law_notes(pairs: DataFrame, units: DataFrame, answerers: list[tuple[str, Callable[[DataFrame], DataFrame]]], asof: str) -> DataFrame:
    """Notes on local law: (pair_id, status, note, confidence, attempts, via, rationale).

    ``pairs(pair_id, issue, language, unit_id, unit_text)`` carries the best unit found (null if none); a note
    stands when all its claims' citations pass. Without a unit nobody is asked. ``units`` is what citations may name.
    """
    units = units.withColumn("unit_id", F.col("unit_id").cast("string"))

    def judge(answers: DataFrame) -> DataFrame:
        checked = search.validated(answers.where("note <> ''").select(F.col("pair_id").alias("note_id"), F.col("note").alias("text")), units, asof)
        passed = F.col("result").isin(PASSING)
        said = F.transform(F.array_sort(F.collect_list(F.when(~passed, F.struct("claim_no", "unit_id", "result")))), lambda x: F.concat_ws(": ", x["result"], x["unit_id"]))
        return checked.groupBy(F.col("note_id").alias("pair_id")).agg(F.bool_and(passed).alias("passed"), said.alias("feedback"))

    found = rounds(pairs.where("unit_id IS NOT NULL"), "pair_id", answerers, judge, "note string, confidence double")
    status = F.when(F.col("settled"), "accepted").otherwise("needs_human")
    why = F.when(F.col("settled"), "").otherwise("citation_validation_failed")
    out = found.select("pair_id", status.alias("status"), F.coalesce("note", F.lit("")).alias("note"), clamped(F.col("confidence")).alias("confidence"), "attempts", F.coalesce("via", F.lit("")).alias("via"), why.alias("rationale"))
    without = pairs.where("unit_id IS NULL").select("pair_id", F.lit("needs_human"), F.lit(""), F.lit(0.0), F.lit(0), F.lit(""), F.lit("no_sources"))
    return out.union(without)


def labelled(segments: DataFrame, labels: DataFrame, known: list[str]) -> DataFrame:
    """Clauses with their label: ``labels(doc_id, idx, key, confidence)``; an unknown or missing one is 'other'."""
    one = labels.groupBy("doc_id", "idx").agg(F.last("key").alias("key"), F.last("confidence").alias("confidence"))
    met = segments.join(one, ["doc_id", "idx"], "left")
    return met.withColumns({"key": known_or(F.col("key"), known, "other"), "confidence": F.when(F.col("key").isNull(), F.lit(0.0)).otherwise(clamped(F.col("confidence")))})


def label_texts(segments: DataFrame) -> DataFrame:
    """What is shown for labelling: both languages' headings and texts, cut to a length."""
    some = lambda sep, *c: F.array_join(F.filter(F.array(*[F.coalesce(x, F.lit("")) for x in c]), lambda x: x != ""), sep)
    return segments.select("doc_id", "idx", some(" / ", "heading", "heading_alt").alias("heading"), F.substring(some("\n", "text", "text_alt"), 1, LABEL_CHARS).alias("text"))
