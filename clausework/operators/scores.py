"""How well findings agree with what was planted: by sets, by position and by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.sources.tables import dealt


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def discrepancy_scores(expected: DataFrame, reported: DataFrame, keys: list[str], by_kind: bool = False) -> DataFrame:
    """n_expected, n_found, n_reported, n_noise, recall and precision of sets of (keys, kind), perhaps by kind.

    A reported pair is noise only if nothing at all is expected of its keys: a wrong kind where something is
    expected is no second fault.
    """
    columns = [*keys, "kind"]
    flags = expected.select(*columns, F.lit(True).alias("e"), F.lit(False).alias("r")).union(reported.select(*columns, F.lit(False), F.lit(True)))
    pairs = flags.groupBy(*columns).agg(F.bool_or("e").alias("e"), F.bool_or("r").alias("r"))
    known = F.bool_or("e").over(Window.partitionBy(*keys))
    marked = pairs.select("kind", "e", (F.col("e") & F.col("r")).alias("hit"), (F.col("r") & ~known).alias("noise"))
    out = marked.groupBy(*["kind"] * by_kind).agg(F.count_if("e").alias("n_expected"), F.count_if("hit").alias("n_found"), F.count_if(F.col("hit") | F.col("noise")).alias("n_reported"), F.count_if("noise").alias("n_noise"))
    return out.withColumns({"recall": _ratio(F.col("n_found"), F.col("n_expected")), "precision": _ratio(F.col("n_reported") - F.col("n_noise"), F.col("n_reported"))})


def positional_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document, n and n_right of ``(doc_id, pos, key)`` compared place by place; what one side has more of is wrong."""
    side = lambda rows, gold: rows.select("doc_id", "pos", "key", F.lit(gold).alias("gold"))
    # dealt once by document, all that follows stays in its partition; about as many rows are predicted as are asked
    both = dealt(side(gold, True).union(side(predicted, False)), "doc_id", rows=2 * gold.count())
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "gold").orderBy("pos")))
    per = placed.groupBy("doc_id", "place").agg(F.bool_or("gold").alias("asked"), F.max(F.when(F.col("gold"), F.col("key"))).alias("want"), F.max(F.when(~F.col("gold"), F.col("key"))).alias("got"))
    return per.where("asked").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if((F.col("want") == F.col("got")) & F.col("doc_id").isNotNull()).alias("n_right"))


def finding_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``expected(doc_id, rule_key, want)`` with the verdict reached (null if none) and whether it is right; of several the last by ``at`` counts."""
    last = actual.groupBy("doc_id", "rule_key").agg(F.max_by("classification", "at").alias("got"))
    met = expected.join(last, ["doc_id", "rule_key"], "left")
    return met.withColumn("right", F.coalesce(F.col("want") == F.col("got"), F.lit(False)))
