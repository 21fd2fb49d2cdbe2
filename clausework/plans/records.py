"""Named queries on records of a review; the tables stand in as in ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.operators import findings as R
from clausework.operators import records
from clausework.plans import contracts, written
from clausework.plans.catalog import CITATIONS, FINDINGS, RANK, citations, findings, query, table
from clausework.sources.tables import kept


@query(f"""WITH {FINDINGS}, {CITATIONS}, n AS (SELECT finding_id, string_agg('s ' || citation_id || ' (' || status || CASE WHEN override_reason IS NOT NULL THEN ', overridden' ELSE '' END || ')', '; ' ORDER BY citation_id) AS t FROM c GROUP BY 1)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, clause_key, id) AS position, clause_key AS clause, severity, CASE WHEN disposition = 'edited' AND kind = 'law' THEN 'edit ' || id ELSE summary END AS text, coalesce(disposition, '') AS disposition, coalesce(t, '') AS sources
FROM f LEFT JOIN n ON finding_id = id WHERE severity <> 'info' AND coalesce(disposition, '') <> 'rejected'""")
def memo_issues(spark, sf_dir):
    """The table of issues of each run's memo."""
    c = citations(spark, sf_dir).withColumns({"pinpoint": F.concat(F.lit("s "), "citation_id"), "source_unit_id": F.lit("u")})
    return records.memo_rows(findings(spark, sf_dir).withColumn("edited_text", F.concat(F.lit("edit "), "id")), c)


@query("""SELECT o_orderkey AS id, ['accepted', 'edited', 'rejected', 'deferred'][o_orderkey % 4 + 1] AS previous, CASE o_orderkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' WHEN 3 THEN 'rejected' ELSE ['accepted', 'edited', 'rejected', 'deferred'][o_orderkey % 4 + 1] END AS disposition,
CASE WHEN o_orderkey % 6 = 1 THEN 'text ' || o_orderkey END AS edited_text FROM orders""")
def dispositions_applied(spark, sf_dir):
    """Decisions on findings: accept, edit, edit without text, reject, reject with a strange reason, an unknown action; the last good one counts."""
    k = F.col("o_orderkey")
    m = k % 6
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.get(F.array(*map(F.lit, ["accepted", "edited", "rejected", "deferred"])), (k % 4).cast("int")).alias("disposition"), m.alias("m"), k.alias("k"))
    action = F.when(F.col("m") == 0, "accept").when(F.col("m") < 3, "edit").when(F.col("m") < 5, "reject").otherwise("burn")
    one = rows.select("id", F.lit(1).alias("at"), action.alias("action"), F.when(F.col("m") == 1, F.concat(F.lit("text "), F.col("k").cast("string"))).when(F.col("m") == 2, "  ").alias("edited_text"), F.when(F.col("m") == 3, "law_outdated").when(F.col("m") == 4, "bad mood").alias("reason_code"))
    later = rows.where("m = 3").select("id", F.lit(2), F.lit("edit"), F.lit(""), F.lit(None).cast("string"))  # refused, so the first stands
    return records.dispositioned(rows.select("id", "disposition"), one.union(later))


@query("""SELECT run_id FROM (SELECT o_orderkey AS run_id, o_orderdate AS d FROM orders WHERE o_orderkey % 5 < 3 AND o_orderdate <= TIMESTAMP '1999-01-01' AND (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate + INTERVAL 60 DAY < TIMESTAMP '1999-01-01'))) ORDER BY d, run_id LIMIT 1""")
def oldest_claimable(spark, sf_dir):
    """The run that a worker takes next."""
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("not_before"), F.expr("o_orderdate + INTERVAL 60 DAY").alias("lease_expires"))
    return R.claimable(runs, F.lit("1999-01-01").cast("timestamp_ntz")).orderBy("not_before", "run_id").limit(1).select("run_id")


@query("""WITH q AS (SELECT o_orderkey % 500 AS matter_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 3 = 0), bad AS (SELECT DISTINCT matter_id FROM q WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7)),
good AS (SELECT DISTINCT matter_id FROM q WHERE matter_id NOT IN (SELECT matter_id FROM bad))
SELECT matter_id, user_id, 'member' AS access FROM q WHERE matter_id IN (SELECT matter_id FROM good) UNION ALL SELECT c_custkey % 500, c_custkey, 'old' FROM customer WHERE c_custkey % 500 NOT IN (SELECT matter_id FROM good)""")
def members_replaced(spark, sf_dir):
    """Members of matters after requests replaced them; requests with unknown users are refused."""
    members = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("matter_id"), F.col("c_custkey").alias("user_id"), F.lit("old").alias("access"))
    requests = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 500).alias("matter_id"), F.col("o_custkey").alias("user_id"), F.lit("member").alias("access"))
    users = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 7").select(F.col("c_custkey").alias("user_id"))
    return records.members_after(members, requests, users)[0]


@query("""WITH m AS (SELECT o_custkey AS id, max(o_orderkey) AS mark FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT c_custkey AS id, c_name AS title, CASE WHEN m.id IS NOT NULL THEN 'verified' ELSE 'unverified' END AS review_status, CASE WHEN m.id IS NOT NULL THEN 'km' || (mark % 9) END AS verified_by, mark AS verified_at FROM customer LEFT JOIN m ON m.id = c_custkey""")
def sources_verified(spark, sf_dir):
    """Sources after reviewers marked some of them."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("unverified").alias("review_status"), F.lit(None).cast("string").alias("verified_by"), F.lit(None).cast("bigint").alias("verified_at"))
    marks = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("km"), (F.col("o_orderkey") % 9).cast("string")).alias("by"), F.col("o_orderkey").alias("at"))
    return records.marked_verified(sources, marks)[0]


@query("""WITH o AS (SELECT l_partkey AS k, max(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY 1), n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0)
SELECT k AS book, x.v AS version, x.b AS body, x.a AS active FROM (SELECT o.k, o.v AS last, n.k IS NOT NULL AS fresh FROM o LEFT JOIN n USING (k)), LATERAL (SELECT last AS v, 'old' AS b, NOT fresh AS a UNION ALL SELECT last + 1, 'a', FALSE WHERE fresh UNION ALL SELECT last + 2, 'b', TRUE WHERE fresh) x
UNION ALL SELECT n.k, x.v, x.b, x.a FROM n, (VALUES (1, 'a', FALSE), (2, 'b', TRUE)) x(v, b, a) WHERE n.k NOT IN (SELECT k FROM o)""")
def versions_activated(spark, sf_dir):
    """Versions of playbooks after two new ones of every other book."""
    old = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("book")).agg(F.max("l_linenumber").alias("version")).select("book", "version", F.lit("old").alias("body"), F.lit(True).alias("active"))
    new = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("book"), F.explode(F.array(F.struct(F.lit(1).alias("created_at"), F.lit("a").alias("body")), F.struct(F.lit(2).alias("created_at"), F.lit("b").alias("body")))).alias("x")).select("book", "x.*")
    return records.activated(old, new, "book")


@query("""SELECT coalesce(CASE WHEN user_id % 3 <> 0 THEN 'M' || user_id END, 'walled') AS number, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS cost, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY 1""")
def spend_walled(spark, sf_dir):
    """Spend by matter number; matters behind a wall are one row."""
    spend = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("matter")).agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("cost"), F.count("*").alias("calls"))
    seen = spend.where("matter % 3 <> 0").select("matter", F.concat(F.lit("M"), F.col("matter").cast("string")).alias("number"))
    return records.labelled_spend(spend, seen).select("number", F.col("cost").cast("double").alias("cost"), F.col("calls").cast("bigint").alias("calls"))


@query("""SELECT o.u AS unit_id, c_custkey IS NOT NULL AS found, CASE WHEN c_custkey % 2 = 0 THEN 'Điều ' || c_custkey || ' ' || c_mktsegment ELSE c_mktsegment || ', s ' || c_custkey END AS pinpoint, c_name AS text FROM (SELECT DISTINCT o_custkey + o_orderkey % 2 AS u FROM orders) o LEFT JOIN customer ON c_custkey = o.u""")
def unit_lookup(spark, sf_dir):
    """Units by id with their pinpoint; some do not exist."""
    c = F.col("c_custkey")
    units = table(spark, sf_dir, "customer").select(c.alias("unit_id"), F.concat(F.when(c % 2 == 0, "Điều ").otherwise("s "), c.cast("string")).alias("path"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("text"))
    return records.pinpointed(table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2).alias("unit_id")), units)


@query("""SELECT c_custkey AS id, lower(c_mktsegment) || '-' || (c_nationkey % 5) AS idp_id FROM customer WHERE c_nationkey % 5 <> 3 AND c_custkey % 7 <> 0""")
def idp_by_domain(spark, sf_dir):
    """Identity providers by the domain of an address; one of five is off, some addresses have no domain."""
    k, n = F.col("c_custkey"), (F.col("c_nationkey") % 5).cast("string")
    domain = F.concat(F.col("c_mktsegment"), F.lit("-"), n, F.lit(".Example"))
    customers = table(spark, sf_dir, "customer").select(k.alias("id"), domain.alias("domain"), F.concat(F.lower("c_mktsegment"), F.lit("-"), n).alias("idp_id"), (F.col("c_nationkey") % 5 != 3).alias("enabled"))
    emails = customers.select(F.when(F.col("id") % 7 != 0, F.concat(F.col("id").cast("string"), F.lit("@"), F.upper("domain"))).otherwise(F.col("domain")).alias("email"))
    got = records.idp_of(emails, customers.select("domain", "idp_id").distinct(), customers.select("idp_id", "enabled").distinct())
    return got.select(F.substring_index("email", "@", 1).cast("bigint").alias("id"), "idp_id")


@query("""SELECT o_orderkey AS pair_id, 'planted ' || (o_orderkey % 4) AS summary, 'price  of 5' AS primary_span, 'GIÁ 5' AS other_span FROM orders WHERE o_orderkey % 4 IN (0, 3) AND o_orderkey % 5 <> 0""")
def grounded_differences(spark, sf_dir):
    """Reported differences whose spans stand in both versions and that are not known already."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("pair_id"), F.when(k % 4 == 1, "nothing").otherwise("The price of 5 holds").alias("primary"), F.when(k % 4 == 2, "không").otherwise("có giá  5 đồng").alias("other"), (k % 4).alias("m"))
    reported = rows.select("pair_id", F.concat(F.lit("planted "), F.col("m").cast("string")).alias("summary"), F.lit("price  of 5").alias("primary_span"), F.lit("GIÁ 5").alias("other_span"))
    return records.grounded(reported, rows, reported.where("pair_id % 5 = 0"))


@query("""WITH o AS (SELECT o_orderkey AS pair_id, o_orderkey % 900 + 100 AS m, o_custkey % 50 AS pc, o_custkey % 25 + 1 AS d FROM orders WHERE o_orderkey % 11 <> 0),
x AS (SELECT pair_id, 'amount' AS kind, 'Amounts' AS l, format('{:,.2f}', m * 1000.0) AS p, format('{:,.2f}', (m + 1) * 1000.0) AS q FROM o WHERE pair_id % 5 = 0 UNION ALL SELECT pair_id, 'percent', 'Percentages', CAST(pc::DOUBLE AS VARCHAR), CAST((pc + 1)::DOUBLE AS VARCHAR) FROM o WHERE pair_id % 7 = 0
UNION ALL SELECT pair_id, 'duration', 'Durations', d || ' d', (d + 1) || ' d' FROM o WHERE pair_id % 3 = 0)
SELECT pair_id, kind, l || ' differ between versions (Vietnamese only: ' || p || '; English only: ' || q || ').' AS summary, CASE WHEN (pair_id // 100) % 2 = 0 THEN 'The Vietnamese version prevails under the contract''s language clause; the other version should be aligned to it.' ELSE 'The contract does not say which language version prevails.' END AS rationale,
p AS primary_span, q AS other_span, 'high' AS severity, 0.9::DOUBLE AS confidence FROM x""")
def version_findings(spark, sf_dir):
    """Differences between versions as findings with texts and rationale."""
    d = contracts.version_differences(spark, sf_dir)
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.floor(F.col("o_orderkey") / 100).alias("doc_id"))
    prevailing = pairs.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 2 == 0, "vi").alias("by_primary"), F.lit(None).cast("string").alias("by_other"))
    return records.version_findings(d, prevailing, pairs)


_PLANNED = f"""p AS ({written.ROUTING_SQL})"""


@query(f"""WITH {_PLANNED}, c AS (SELECT *, reason = '' AND (request_id + CAST(endpoint_id AS BIGINT)) % 4 = 0 AS ok FROM p),
g AS (SELECT request_id, min(rank) FILTER (ok) AS r, count(*) FILTER (reason = '') AS n, count(*) FILTER (reason = 'budget_exceeded') AS dear FROM c GROUP BY 1)
SELECT g.request_id, CASE WHEN r IS NOT NULL THEN 'ok' WHEN n > 0 THEN 'all_failed' WHEN dear > 0 THEN 'budget_exceeded' ELSE 'no_candidate' END AS outcome, c.endpoint_id, CAST(coalesce(r, n) AS BIGINT) AS tried FROM g LEFT JOIN c ON c.request_id = g.request_id AND c.rank = g.r AND c.ok""")
def routing_outcomes(spark, sf_dir):
    """What became of planned requests when three of four endpoints fail."""
    p = kept(written.routing_plan(spark, sf_dir), "routing-plan").withColumn("reason", F.nullif("reason", F.lit("")))
    calls = p.where("reason IS NULL").select("request_id", "endpoint_id", ((F.col("request_id") + F.col("endpoint_id").cast("bigint")) % 4 == 0).alias("ok"))
    return records.outcomes(p, calls)


@query("""SELECT o_orderkey AS run_id, 'jsonl' AS format, CAST(strlen(o_orderkey || ':' || o_orderpriority) AS BIGINT) AS bytes, sha256(o_orderkey || ':' || o_orderpriority) AS sha256 FROM orders""")
def export_digests(spark, sf_dir):
    """Exports with their digest."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("jsonl").alias("format"), F.concat_ws(":", "o_orderkey", "o_orderpriority").cast("binary").alias("content"))
    return records.export_rows(files)
