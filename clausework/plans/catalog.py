"""Named queries over the driver tables, each with its SQL twin for the oracle.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``SQL`` has the DuckDB text that gives
the same rows.  The driver tables stand in for the review tables: customers are matters, orders are
review runs, line items are findings, events are decisions, documents are units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import findings as R
from clausework.operators import reports as P
from clausework.operators import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decisions(table(spark, sf_dir, "events"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings: every column follows by rule from the row."""
    line = table(spark, sf_dir, "lineitem")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    key, number = F.col("l_partkey"), F.col("l_linenumber")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("run_id"), (key % 40).alias("clause_id"), F.concat(F.lit("c"), key % 12).alias("clause_key"),
        F.concat(F.lit("r"), F.col("l_suppkey") % 9).alias("rule_key"), pick(number, "playbook", "law", "bilingual").alias("kind"), pick(key, "high", "medium", "low", "info").alias("severity"),
        pick(key + number, "standard", "non_standard", "missing").alias("classification"), pick(F.col("l_suppkey"), "ok", "ok", "needs_human").alias("status"),
        pick(key + F.col("l_suppkey"), None, "accepted", "edited", "rejected", "deferred").alias("disposition"), F.concat(F.lit("w"), key % 50).alias("wording"), F.col("l_shipdate").alias("disposition_at"), F.concat_ws(" ", F.lit("part"), key, F.lit("line"), number).alias("summary"),
    )


FINDINGS = """f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS run_id, l_partkey % 40 AS clause_id, 'c' || (l_partkey % 12) AS clause_key,
 'r' || (l_suppkey % 9) AS rule_key, ['playbook','law','bilingual'][l_linenumber % 3 + 1] AS kind, ['high','medium','low','info'][l_partkey % 4 + 1] AS severity,
 ['standard','non_standard','missing'][(l_partkey + l_linenumber) % 3 + 1] AS classification, ['ok','ok','needs_human'][l_suppkey % 3 + 1] AS status,
 [NULL,'accepted','edited','rejected','deferred'][(l_partkey + l_suppkey) % 5 + 1] AS disposition, 'w' || (l_partkey % 50) AS wording, l_shipdate AS disposition_at, concat_ws(' ', 'part', l_partkey, 'line', l_linenumber) AS summary FROM lineitem)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = findings(spark, sf_dir).where("kind = 'law'")
    return line.select(F.concat(F.lit("cite-"), F.col("id")).alias("citation_id"), F.col("id").alias("finding_id"), F.when(F.col("clause_id") % 5 == 0, "misquoted").otherwise("supported").alias("status"), F.when(F.col("clause_id") % 10 == 0, F.lit("checked")).alias("override_reason"))


CITATIONS = "c AS (SELECT 'cite-' || id AS citation_id, id AS finding_id, CASE WHEN clause_id % 5 = 0 THEN 'misquoted' ELSE 'supported' END AS status, CASE WHEN clause_id % 10 = 0 THEN 'checked' END AS override_reason FROM f WHERE kind = 'law')"
OPEN = "severity <> 'info' AND (disposition IS NULL OR disposition = 'deferred')"
RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 9 END"
LOG = "e AS (SELECT event_id, user_id AS matter, event_type AS task, 'T' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS tier, CAST(value AS DECIMAL(12,2)) AS cost, ts AS created_at FROM events)"
NOW = "2024-01-20 12:00:00"


@query(f"""WITH {LOG} SELECT 'matter' AS dim, CAST(matter AS VARCHAR) AS key, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost, count(*) AS calls FROM e GROUP BY matter
UNION ALL SELECT 'task', task, CAST(coalesce(sum(cost), 0) AS DOUBLE), count(*) FROM e GROUP BY task UNION ALL SELECT 'tier', tier, CAST(coalesce(sum(cost), 0) AS DOUBLE), count(*) FROM e GROUP BY tier""")
def spend_grouping_sets(spark, sf_dir):
    return P.spend(log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT matter, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS all_time,
CAST(coalesce(sum(cost) FILTER (WHERE created_at >= date_trunc('month', TIMESTAMP '{NOW}') AND created_at <= TIMESTAMP '{NOW}'), 0) AS DOUBLE) AS month FROM e GROUP BY matter""")
def spend_month_to_date(spark, sf_dir):
    return P.month_to_date(log(spark, sf_dir), NOW)


@query(f"WITH {LOG}, t AS (SELECT tier, count(*) AS calls FROM e GROUP BY tier) SELECT tier, calls, round(calls / sum(calls) OVER (), 6) AS share, round(calls / max(calls) OVER (), 6) AS width FROM t")
def spend_tier_share(spark, sf_dir):
    return P.tier_share(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost, count(*) AS n FROM e WHERE task IN ('purchase', 'error') AND tier = 'T2'")
def cost_of_decisions(spark, sf_dir):
    return P.cost_of(log(spark, sf_dir), F.col("task").isin("purchase", "error") & (F.col("tier") == "T2"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def audit_filter_latest(spark, sf_dir):
    return P.audit_log(table(spark, sf_dir, "events"), action="error").select("event_id", "user_id", "event_type")


@query(f"""SELECT event_id, c_name AS name FROM (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
JOIN customer ON user_id = c_custkey WHERE k % 7 <> 0 AND ts + INTERVAL 10 DAY > TIMESTAMP '{NOW}' ORDER BY ts DESC, event_id DESC LIMIT 200""")
def live_sessions_join_users(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    live = e.where((F.col("k") % 7 != 0) & (F.expr("ts + INTERVAL 10 DAY") > F.lit(NOW).cast("timestamp_ntz")))
    named = live.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey"))
    return named.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", F.col("c_name").alias("name"))


@query("SELECT c_custkey AS matter_id, c_name AS name FROM customer WHERE c_nationkey = 7 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def visible_matters_semi(spark, sf_dir):
    matters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("matter_id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_name").alias("name"))
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("matter_id"), F.when(F.col("o_orderpriority").startswith("1"), "member").otherwise("screened").alias("access"))
    return R.visible(matters, members, 7).select("matter_id", "name")


@query(f"""WITH {FINDINGS}, s AS (SELECT clause_key, wording, max(disposition_at) AS newest FROM f WHERE run_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clause_key ORDER BY newest DESC, wording) AS rank FROM s) SELECT clause_key, wording, rank FROM r WHERE rank <= 3""")
def few_shot_top_n(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return R.few_shot(findings(spark, sf_dir), runs).select("clause_key", "wording", "rank")


@query("SELECT l_partkey AS part, l_linenumber AS version, l_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_orderkey DESC) AS r FROM lineitem WHERE l_returnflag <> 'R') WHERE r = 1")
def latest_version_per_key(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("version"), F.col("l_orderkey").alias("run"))
    return P.latest_by(line, ["part"], ["version", "run"], ["version", "run"])


@query("SELECT c_custkey AS owner, CAST(coalesce(max(o_orderkey % 97), 0) + 1 AS BIGINT) AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 97).alias("version"))
    return P.next_version(owners, versions, "owner", "version")


@query("SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def unknown_users_anti(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct().join(known, "user_id", "left_anti")


@query(f"WITH {FINDINGS}, {CITATIONS}, n AS (SELECT finding_id, string_agg(citation_id || ':' || status, '; ' ORDER BY citation_id) AS t, count(*) AS n FROM c GROUP BY 1) SELECT f.id, coalesce(t, '') AS citations, coalesce(n, 0) AS n_citations FROM f LEFT JOIN n ON id = finding_id")
def findings_with_citations_nested(spark, sf_dir):
    return R.with_citations(findings(spark, sf_dir), citations(spark, sf_dir), F.concat_ws(":", "citation_id", "status"))


@query(f"WITH {FINDINGS} SELECT id, severity, disposition FROM f WHERE severity <> 'info' AND kind = 'playbook' AND {OPEN}")
def findings_filter_open(spark, sf_dir):
    return R.filtered(findings(spark, sf_dir), "issues", "playbook", "open").select("id", "severity", "disposition")


@query(f"""WITH {FINDINGS}, k AS (SELECT n_nationkey + 10 AS clause_id, n_regionkey AS idx FROM nation)
SELECT id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, CASE WHEN f.clause_id IS NULL THEN 10000 ELSE coalesce(idx, 9999) END, rule_key, id) AS position FROM f LEFT JOIN k USING (clause_id)""")
def findings_sort_order(spark, sf_dir):
    clauses = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).alias("clause_id"), F.col("n_regionkey").alias("idx"))
    return R.ordered(findings(spark, sf_dir), clauses).select("id", "run_id", "position")


@query(f"""WITH {FINDINGS} SELECT run_id, count(*) AS total, count(*) FILTER (severity <> 'info') AS issues, count(*) FILTER ({OPEN}) AS open, count(*) FILTER (status = 'needs_human') AS needs_human,
count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, count(*) FILTER (severity = 'info') AS n_info FROM f GROUP BY run_id""")
def findings_counts(spark, sf_dir):
    return R.counts(findings(spark, sf_dir))


@query(f"""WITH {FINDINGS}, {CITATIONS}, b AS (SELECT run_id, 1 AS a, 0 AS z FROM f WHERE {OPEN} UNION ALL SELECT run_id, 0, 1 FROM c JOIN f ON finding_id = f.id WHERE c.status <> 'supported' AND coalesce(override_reason, '') = '' AND (disposition IS NULL OR disposition <> 'rejected')),
g AS (SELECT run_id, sum(a) AS a, sum(z) AS z FROM b GROUP BY run_id)
SELECT o_orderkey AS run_id, CAST(coalesce(a, 0) AS BIGINT) AS n_findings, CAST(coalesce(z, 0) AS BIGINT) AS n_citations, o_orderstatus = 'F' AND coalesce(a, 0) + coalesce(z, 0) = 0 AS open FROM orders LEFT JOIN g ON run_id = o_orderkey""")
def export_gate_blockers(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return R.gate(runs, findings(spark, sf_dir), citations(spark, sf_dir))


@query(f"""WITH {FINDINGS}, r AS (SELECT *, CASE WHEN severity IN ('high', 'medium') THEN row_number() OVER (PARTITION BY run_id, severity IN ('high', 'medium') ORDER BY {RANK}, clause_key, id) END AS r FROM f)
SELECT run_id, count(*) FILTER (severity <> 'info') AS issues, count(*) FILTER (severity = 'high') AS high, coalesce(string_agg(DISTINCT clause_key, ',' ORDER BY clause_key) FILTER (classification = 'missing'), '') AS missing,
coalesce(string_agg(summary[:500], ' | ' ORDER BY r) FILTER (r <= 20), '') AS points FROM r GROUP BY run_id""")
def memo_aggregate(spark, sf_dir):
    return R.memo(findings(spark, sf_dir))


@query(f"""WITH {FINDINGS}, n AS (SELECT id, CASE WHEN classification = 'missing' THEN 'insert' ELSE 'replace' END AS op, CASE WHEN disposition = 'edited' THEN 'edit ' || id WHEN p.clause_key IS NOT NULL THEN 'firm ' || f.clause_key WHEN t.rule_key IS NOT NULL THEN 'template ' || f.rule_key END AS new_text,
CAST(CASE WHEN disposition = 'edited' THEN 1.0 WHEN p.clause_key IS NOT NULL THEN 0.75 ELSE 0.65 END AS DOUBLE) AS confidence FROM f LEFT JOIN (SELECT 'c' || n_nationkey AS clause_key FROM nation WHERE n_nationkey < 5) p ON p.clause_key = f.clause_key LEFT JOIN (SELECT 'r' || n_nationkey AS rule_key FROM nation WHERE n_nationkey < 4) t ON t.rule_key = f.rule_key
WHERE kind = 'playbook' AND classification IN ('non_standard', 'missing')) SELECT * FROM n WHERE new_text IS NOT NULL""")
def redline_change_set(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    examples = nation.where("n_nationkey < 5").select(F.concat(F.lit("c"), "n_nationkey").alias("clause_key")).withColumn("example", F.concat(F.lit("firm "), F.col("clause_key")))
    templates = nation.where("n_nationkey < 4").select(F.concat(F.lit("r"), "n_nationkey").alias("rule_key")).withColumn("template", F.concat(F.lit("template "), F.col("rule_key")))
    edited = findings(spark, sf_dir).withColumn("edited_text", F.when(F.col("disposition") == "edited", F.concat(F.lit("edit "), F.col("id"))))
    return R.redlines(edited, examples, templates)


@query("SELECT o_orderkey AS unit_id, c_nationkey AS source_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND o_orderdate <= DATE '1998-06-01' AND o_orderdate + INTERVAL 90 DAY > DATE '1998-06-01'")
def in_force_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_custkey", F.when(F.col("o_orderstatus") == "P", "repealed").otherwise("in_force").alias("status"), F.to_date("o_orderdate").alias("effective_from"), F.date_add(F.to_date("o_orderdate"), 90).alias("effective_to"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source_id"))
    return o.where(R.in_force(F.lit("1998-06-01").cast("date"))).join(sources, "o_custkey").select("unit_id", "source_id")


@query("SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def disposition_previous(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("SELECT user_id AS instrument, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stamp, max_by(event_id, (ts, event_id)) AS snapshot FROM events GROUP BY user_id")
def snapshot_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("instrument"), "ts", "event_id")
    return P.latest_by(e, ["instrument"], ["ts", "event_id"], ["ts", "event_id"]).select("instrument", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("event_id").alias("snapshot"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def telemetry_window_rollup(spark, sf_dir):
    return P.windowed(table(spark, sf_dir, "events"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return P.percentiles(table(spark, sf_dir, "events"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 5 < 3 AND o_orderdate <= TIMESTAMP '1999-01-01' AND (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate + INTERVAL 60 DAY < TIMESTAMP '1999-01-01'))")
def queue_eligible(spark, sf_dir):
    now = F.lit("1999-01-01").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("not_before"), F.expr("o_orderdate + INTERVAL 60 DAY").alias("lease_expires"))
    return R.claimable(runs, now).select("run_id")


@query("SELECT o_orderkey AS run_id, o_orderkey % 5 AS attempts, CASE WHEN o_orderkey % 5 >= 3 THEN 'failed' ELSE 'queued' END AS status, CAST(CASE WHEN o_orderkey % 5 < 3 THEN [5, 5, 30][o_orderkey % 5 + 1] ELSE 0 END AS BIGINT) AS wait_seconds FROM orders")
def retry_transition(spark, sf_dir):
    return R.after_failure(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("attempts")))


@query("""WITH o AS (SELECT 's' || o_custkey AS id, 't' || max(o_orderkey) AS title, 'h' || (max(o_orderkey) % 3) AS sha, CASE WHEN o_custkey % 2 = 0 THEN 'verified' ELSE 'unverified' END AS rs, CASE WHEN o_custkey % 2 = 0 THEN 'km' END AS vb FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey),
n AS (SELECT 's' || c_custkey AS id, c_name AS title, 'h' || (c_custkey % 3) AS sha FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN n.id IS NOT NULL THEN n.sha ELSE o.sha END AS snapshot_sha256,
CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.sha IS DISTINCT FROM n.sha) THEN 'unverified' ELSE rs END AS review_status, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.sha IS DISTINCT FROM n.sha) THEN NULL ELSE vb END AS verified_by FROM o FULL JOIN n ON o.id = n.id""")
def upsert_verification_reset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    even = F.col("o_custkey") % 2 == 0
    old = o.select(F.concat(F.lit("s"), "o_custkey").alias("id"), F.concat(F.lit("t"), "m").alias("title"), F.concat(F.lit("h"), F.col("m") % 3).alias("snapshot_sha256"), F.when(even, "verified").otherwise("unverified").alias("review_status"), F.when(even, "km").alias("verified_by"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("h"), F.col("c_custkey") % 3).alias("snapshot_sha256"))
    return R.upserted(old, new)
