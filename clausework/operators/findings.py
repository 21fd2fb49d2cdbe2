"""Review state: findings, citations, walls, export gate, memo, redlines, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of severities.
SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}


def severity_rank(c: str = "severity") -> Column:
    rank = F.lit(9)
    for name, at in SEVERITY.items():
        rank = F.when(F.col(c) == name, at).otherwise(rank)
    return rank


def is_open() -> Column:
    """Not info, and without a final disposition; deferred ones still count."""
    return (F.col("severity") != "info") & (F.col("disposition").isNull() | (F.col("disposition") == "deferred"))


def filtered(findings: DataFrame, severity: str = "all", kind: str | None = None, state: str | None = None) -> DataFrame:
    rows = findings
    if severity == "issues":
        rows = rows.where("severity <> 'info'")
    elif severity != "all":
        rows = rows.where(F.col("severity") == severity)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if state == "open":
        rows = rows.where(is_open())
    elif state == "done":
        rows = rows.where(~is_open())
    elif state == "needs_human":
        rows = rows.where("status = 'needs_human'")
    return rows


def ordered(findings: DataFrame, clauses: DataFrame, run: str = "run_id") -> DataFrame:
    """``position``: severity, then place in the document (9999 unknown, 10000 none), then rule."""
    placed = findings.join(clauses.select("clause_id", F.col("idx").alias("_i")), "clause_id", "left")
    place = F.when(F.col("clause_id").isNull(), 10000).otherwise(F.coalesce("_i", F.lit(9999)))
    order = Window.partitionBy(run).orderBy(severity_rank(), place, "rule_key", "id")
    return placed.withColumn("position", F.row_number().over(order).cast("bigint")).drop("_i")


def counts(findings: DataFrame, run: str = "run_id") -> DataFrame:
    n = lambda c: F.count_if(c)
    return findings.groupBy(run).agg(
        F.count("*").alias("total"), n(F.col("severity") != "info").alias("issues"), n(is_open()).alias("open"), n(F.col("status") == "needs_human").alias("needs_human"),
        *[n(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY],
    )


def blockers(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """What keeps a run from export: open findings, and unsupported citations of findings not rejected."""
    undecided = findings.where(is_open()).select("run_id", F.lit("finding").alias("kind"), F.col("id").alias("ref"))
    live = findings.where("disposition IS NULL OR disposition <> 'rejected'").select(F.col("id").alias("finding_id"), "run_id")
    bad = citations.where((F.col("status") != "supported") & (F.coalesce("override_reason", F.lit("")) == ""))
    cited = bad.join(live, "finding_id").select("run_id", F.lit("citation").alias("kind"), F.col("citation_id").alias("ref"))
    return undecided.unionByName(cited)


def gate(runs: DataFrame, findings: DataFrame, citations: DataFrame) -> DataFrame:
    """``open`` iff the run is completed and nothing blocks it."""
    per = blockers(findings, citations).groupBy("run_id").agg(F.count_if(F.col("kind") == "finding").alias("n_findings"), F.count_if(F.col("kind") == "citation").alias("n_citations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = runs.join(per, "run_id", "left").select("run_id", "status", zero("n_findings"), zero("n_citations"))
    return out.select("run_id", "n_findings", "n_citations", ((F.col("status") == "completed") & (F.col("n_findings") + F.col("n_citations") == 0)).alias("open"))


def with_citations(findings: DataFrame, citations: DataFrame, text: Column) -> DataFrame:
    """Findings with their citations nested as one sorted list."""
    nested = citations.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("citations"), F.count("*").alias("n"))
    joined = findings.join(nested, F.col("id") == F.col("finding_id"), "left")
    return joined.select("id", F.coalesce("citations", F.lit("")).alias("citations"), F.coalesce("n", F.lit(0)).alias("n_citations"))


def memo(findings: DataFrame, points: int = 20, chars: int = 500) -> DataFrame:
    """Per run: issues, counts, missing clauses, and the first points of high and medium severity."""
    top = F.col("severity").isin("high", "medium")
    rank = F.row_number().over(Window.partitionBy("run_id", top).orderBy(severity_rank(), "clause_key", "id"))
    rows = findings.withColumn("_r", F.when(top, rank))
    keep = F.when(F.col("_r") <= points, F.struct("_r", F.substring("summary", 1, chars).alias("s")))
    return rows.groupBy("run_id").agg(
        F.count_if(F.col("severity") != "info").alias("issues"), F.count_if(F.col("severity") == "high").alias("high"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("classification") == "missing", F.col("clause_key")))), ",").alias("missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["s"]), " | ").alias("points"),
    )


def redlines(findings: DataFrame, examples: DataFrame, templates: DataFrame) -> DataFrame:
    """Changes for accepted or edited findings that need one: firm wording first, else the template."""
    need = findings.where("kind = 'playbook' AND classification IN ('non_standard', 'missing')")
    both = need.join(examples, "clause_key", "left").join(templates, "rule_key", "left")
    new = F.coalesce("edited_text", "example", "template")
    op = F.when(F.col("classification") == "missing", "insert").otherwise("replace")
    confidence = F.when(F.col("edited_text").isNotNull(), 1.0).when(F.col("example").isNotNull(), 0.75).otherwise(0.65)
    return both.where(new.isNotNull()).select("id", op.alias("op"), new.alias("new_text"), confidence.alias("confidence"))


def in_force(asof: Column, start: str = "effective_from", end: str = "effective_to", status: str = "status") -> Column:
    """Half-open validity; repealed units never hold."""
    return (F.col(status) != "repealed") & (F.col(start).isNull() | (F.col(start) <= asof)) & (F.col(end).isNull() | (F.col(end) > asof))


def visible(matters: DataFrame, members: DataFrame, tenant: int | None) -> DataFrame:
    """Matters of the tenant with a member who is not screened; no tenant, no rows."""
    if tenant is None:
        return matters.limit(0)
    return matters.where(F.col("tenant_id") == tenant).join(members.where("access = 'member'"), "matter_id", "left_semi")


def few_shot(findings: DataFrame, visible_runs: DataFrame, n: int = 3) -> DataFrame:
    """Newest distinct wordings per clause key in visible runs."""
    seen = findings.join(visible_runs, "run_id", "left_semi").groupBy("clause_key", "wording").agg(F.max("disposition_at").alias("at"))
    newest = Window.partitionBy("clause_key").orderBy(F.desc("at"), "wording")
    return seen.withColumn("rank", F.row_number().over(newest).cast("bigint")).where(F.col("rank") <= n)


def claimable(runs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """Runs that a worker may claim: queued, or running with an expired lease."""
    lapsed = (F.col("status") == "running") & (F.col("lease_expires") < now)
    return runs.where((F.col("attempts") < max_attempts) & (F.col("not_before") <= now) & ((F.col("status") == "queued") | lapsed))


def after_failure(runs: DataFrame, backoff: tuple[int, ...] = (5, 30, 120), max_attempts: int = 3) -> DataFrame:
    """Retry state: failed at the last attempt, else queued again after a growing pause (seconds, 0 once failed)."""
    last = F.col("attempts") >= max_attempts
    wait = F.element_at(F.array(*[F.lit(x) for x in backoff]), F.greatest(F.lit(1), F.least(F.col("attempts"), F.lit(len(backoff)))).cast("int"))
    return runs.select("run_id", "attempts", F.when(last, "failed").otherwise("queued").alias("status"), F.when(~last, wait).otherwise(0).cast("bigint").alias("wait_seconds"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources after an upsert: a new snapshot resets the review, an equal one keeps it."""
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o.snapshot_sha256").eqNullSafe(F.col("n.snapshot_sha256"))
    fresh = F.col("n.id").isNotNull()
    keep = lambda c, reset: F.when(fresh & ~same, reset).when(fresh & F.col("o.id").isNull(), reset).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(
        F.coalesce("o.id", "n.id").alias("id"), F.coalesce("n.title", "o.title").alias("title"), F.when(fresh, F.col("n.snapshot_sha256")).otherwise(F.col("o.snapshot_sha256")).alias("snapshot_sha256"),
        keep("review_status", F.lit("unverified")).alias("review_status"), keep("verified_by", F.lit(None)).alias("verified_by"),
    )
