"""Spend, audit and review reports. Each is one pass over its table and one shuffle on small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decisions(events: DataFrame) -> DataFrame:
    """Routing decisions from the event stream: matter, task, tier, exact cost and time."""
    tier = F.concat(F.lit("T"), (F.get_json_object("props", "$.k").cast("bigint") % 3).cast("string"))
    return events.select("event_id", F.col("user_id").alias("matter"), F.col("event_type").alias("task"), tier.alias("tier"), F.col("value").cast("decimal(12,2)").alias("cost"), F.col("ts").alias("created_at"))


def spend(log: DataFrame) -> DataFrame:
    """Cost and calls by matter, by task and by tier: grouping sets, so the log is read and shuffled once."""
    keys = log.select(F.col("matter").cast("string").alias("matter"), "task", "tier", "cost")
    sets = keys.groupingSets([["matter"], ["task"], ["tier"]], "matter", "task", "tier").agg(F.grouping_id().alias("g"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"), F.count("*").alias("calls"))
    dim = F.when(F.col("g") == 3, "matter").when(F.col("g") == 5, "task").otherwise("tier")
    return sets.select(dim.alias("dim"), F.when(F.col("g") == 3, F.col("matter")).when(F.col("g") == 5, F.col("task")).otherwise(F.col("tier")).alias("key"), "cost", "calls")


def month_to_date(log: DataFrame, now: str) -> DataFrame:
    """All-time spend of each matter and the part since the first of the month of ``now``."""
    at = F.lit(now).cast("timestamp_ntz")
    this = (F.col("created_at") >= F.date_trunc("month", at)) & (F.col("created_at") <= at)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return log.groupBy("matter").agg(zero(F.sum("cost")).alias("all_time"), zero(F.sum(F.when(this, F.col("cost")))).alias("month"))


def tier_share(log: DataFrame) -> DataFrame:
    """Calls per tier, their share of all calls and of the largest tier (bar widths)."""
    per = log.groupBy("tier").agg(F.count("*").alias("calls"))
    everything = Window.partitionBy(F.lit(1))  # over one row per tier
    ratio = lambda x: F.round(F.col("calls") / x("calls").over(everything), 6)
    return per.select("tier", "calls", ratio(F.sum).alias("share"), ratio(F.max).alias("width"))


def cost_of(log: DataFrame, wanted: Column) -> DataFrame:
    """Summed cost of the wanted decisions; 0 if there are none."""
    return log.where(wanted).agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"), F.count("*").alias("n"))


def audit_log(events: DataFrame, action: str | None = None, matter: int | None = None, limit: int = 100) -> DataFrame:
    """The newest entries, optionally of one action and one matter."""
    rows = events
    if action is not None:
        rows = rows.where(F.col("event_type") == action)
    if matter is not None:
        rows = rows.where(F.col("user_id") == matter)
    return rows.orderBy(F.desc("event_id")).limit(min(max(limit, 1), 1000))


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key: an aggregate, not a window, so maps combine first."""
    top = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t.*")


def next_version(owners: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """``coalesce(max(version), 0) + 1`` for every owner."""
    top = versions.groupBy(key).agg(F.max(version).alias("_v"))
    return owners.select(key).distinct().join(top, key, "left").select(key, (F.coalesce("_v", F.lit(0)) + 1).cast("bigint").alias("next_version"))


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and value per time window and type."""
    per = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


BINS = 1024


def percentiles(events: DataFrame) -> DataFrame:
    """Exact median and 95th percentile of the value by type, between neighbours as the rank falls.

    Values are counted in bins between a type's least and largest; only the bins that hold a wanted rank are
    ranked, so no task sorts a whole type.
    """
    rows = events.select("event_type", F.col("value").cast("double").alias("v")).where("v IS NOT NULL")
    edges = rows.groupBy("event_type").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    bin_of = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
    binned = rows.join(edges, "event_type").select("event_type", "v", "n", bin_of.alias("bin"))
    filled = binned.groupBy("event_type", "bin").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    before = F.sum("m").over(Window.partitionBy("event_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    asked = filled.withColumn("before", before).select("*", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("q")).withColumn("at", F.col("q") * (F.col("n") - 1))
    asked = asked.where((F.floor("at") < F.col("before") + F.col("m")) & (F.ceil("at") >= F.col("before"))).select("event_type", "bin", "before", "q", "at")
    held = binned.join(asked.select("event_type", "bin").distinct(), ["event_type", "bin"]).groupBy("event_type", "bin", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = held.withColumn("upto", upto).join(asked, ["event_type", "bin"]).withColumns({"first": F.col("before") + F.col("upto") - F.col("c"), "last": F.col("before") + F.col("upto") - 1})
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))
    per = met.groupBy("event_type", "q").agg(at(F.floor("at")).alias("a"), at(F.ceil("at")).alias("b"), F.first("at").alias("at"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    of = lambda q: F.round(F.max(F.when(F.col("q") == q, value)), 4)
    return per.groupBy("event_type").agg(of(0.5).alias("p50"), of(0.95).alias("p95"))
