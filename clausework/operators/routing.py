"""Endpoint routing: ordered hard filters and a ranking, as one CASE chain and one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.sources.tables import PART_ROWS, dealt

#: Tiers in order, and the provider that is not a third party.
TIERS = {"T0": 0, "T1": 1, "T2": 2}
FIRST_PARTY = "self"
#: Endpoints that are broadcast at once.
MAX_ENDPOINTS = 10_000


def tier(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(-1)
    for name, rank in TIERS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def merged_policy(matters: DataFrame, overrides: DataFrame) -> DataFrame:
    """``matters(matter_id, deny, allow, residency)`` under ``overrides`` of the same columns: denials add up, an override's allow list replaces, the matter's own residency stays."""
    o = overrides.select("matter_id", *[F.col(c).alias(f"o_{c}") for c in ("deny", "allow", "residency")])
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("deny", none), F.coalesce("o_deny", none)))
    return matters.join(o, "matter_id", "left").select("matter_id", both.alias("deny"), F.coalesce("o_allow", "allow").alias("allow"), F.coalesce("residency", "o_residency").alias("residency"))


def plan(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Per request and endpoint: the first reason that excludes it, or null, and the rank of those left.

    ``requests`` carry the merged policy: deny, allow (null: all; empty: first party alone),
    residency, requires, sizes, ``max_tier``, ``preferred_tier``, escalated, byo_providers, budget; and,
    where the columns are there, the tenant's: tenant_deny, tenant_allow, home_region, offshore_allowed,
    byo_allowed, proxy_allowed (the last three true by default).  Reasons and their order are fixed.
    Endpoints left are ranked: the preferred tier, then lower ones, then higher ones, nearest first;
    then those that speak all languages (an empty list does), the cheaper, the earlier registered.
    A catalogue above ``MAX_ENDPOINTS`` is taken in hash blocks of about half of that; the ranks are
    over all of them.
    """
    n = endpoints.count()
    # a request is few bytes and as many rows as there are endpoints; dealt by request, they are ranked where they are
    requests = dealt(requests, "request_id", part=max(PART_ROWS // max(min(n, MAX_ENDPOINTS), 1), 1))
    blocks = 1 if n <= MAX_ENDPOINTS else -(-2 * n // MAX_ENDPOINTS)
    block = F.pmod(F.xxhash64("endpoint_id", "registry_pos"), F.lit(blocks).cast("bigint"))
    p = requests.join(F.broadcast(endpoints if blocks == 1 else endpoints.where(block == 0)), F.lit(True))
    for i in range(1, blocks):
        p = p.union(requests.join(F.broadcast(endpoints.where(block == i)), F.lit(True)))
    none = F.lit(None).cast("array<string>")
    given = lambda name, default: F.coalesce(F.col(name), default) if name in requests.columns else default
    allowed = lambda name: given(name, F.lit(True))
    third = F.array_except("parties", F.array(F.lit(FIRST_PARTY)))
    rank, most = tier("tier"), tier("max_tier")
    serves = lambda region: F.array_contains("regions", "*") | F.array_contains("regions", region)
    missing = F.array_except("requires", "capabilities")
    cost = (F.col("est_in") * F.col("price_in") + F.col("est_out") * F.col("price_out")) / 1e6
    reason = (
        F.when(F.arrays_overlap("parties", "deny"), "matter_conflict_deny")
        .when(F.col("allow").isNotNull() & (F.size(F.array_except(third, F.coalesce("allow", F.expr("array()").cast("array<string>")))) > 0), "matter_not_allowlisted")
        .when(F.coalesce(F.arrays_overlap("parties", given("tenant_deny", none)), F.lit(False)), "tenant_provider_denied")
        .when(given("tenant_allow", none).isNotNull() & (F.size(F.array_except(third, F.coalesce(given("tenant_allow", none), F.expr("array()").cast("array<string>")))) > 0), "tenant_provider_not_allowed")
        .when(~F.col("enabled"), "endpoint_disabled")
        .when(F.col("residency").isNotNull() & ~serves(F.col("residency")), "residency")
        .when(given("home_region", F.lit(None).cast("string")).isNotNull() & ~given("offshore_allowed", F.lit(True)) & ~serves(given("home_region", F.lit(None).cast("string"))), "offshore_processing_denied")
        .when((F.col("sensitivity") == "restricted") & ~F.array_contains("regions", "*") & F.col("residency").isNull(), "restricted_requires_self_hosted")
        .when(F.size(missing) > 0, F.concat(F.lit("capability_missing:"), F.array_join(missing, ",")))
        .when(F.col("est_in") + F.col("est_out") > F.col("max_context"), "context_too_long")
        .when(rank > most, "tier_above_rule")
        .when(F.col("escalated") & (rank < most), "below_escalation_tier")
        .when((F.col("quality_floor") == "high") & (F.col("tier") == "T0"), "below_quality_floor")
        .when((F.col("billing") == "byo") & ~allowed("byo_allowed"), "byo_disabled")
        .when((F.col("billing") == "byo") & ~F.array_contains("byo_providers", F.col("provider")), "no_byo_credential")
        .when((F.col("billing") == "proxy") & ~allowed("proxy_allowed"), "proxy_not_enabled")
        .when(cost > F.col("budget"), "budget_exceeded")
    )
    judged = p.withColumn("reason", reason).withColumn("cost", F.round(cost, 6))
    wished = tier("preferred_tier")
    speaks = F.when((F.size("speaks") == 0) | (F.size(F.array_except("languages", "speaks")) == 0), 0).otherwise(1)
    order = Window.partitionBy("request_id", F.col("reason").isNull()).orderBy(F.when(rank == wished, 0).when(rank < wished, 1).otherwise(2), F.abs(rank - wished), speaks, "cost", "registry_pos")
    ranked = judged.withColumn("rank", F.when(F.col("reason").isNull(), F.row_number().over(order)).cast("bigint"))
    return ranked.select("request_id", "endpoint_id", "reason", "cost", "rank")
