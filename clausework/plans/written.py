"""Named queries on clauses, labels, rules, citations, types and routing over contracts written from columns.

Texts are written from orders, customers and parts by rule and read back, so the SQL twin derives from
the columns alone what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.functions import values as V
from clausework.operators import clauses as C
from clausework.operators import routing
from clausework.operators import search as S
from clausework.plans.catalog import query, table
from clausework.plans.texts import HINTS, RULE_SCHEMA, RULES, TYPES
from clausework.sources.tables import PART_ROWS, dealt


def _contract_clauses(spark, sf_dir):
    """A contract for each order: preamble, three numbered clauses, and for even orders an annex."""
    k = F.col("o_orderkey")
    months, amount = (F.col("o_custkey") % 90 + 1).cast("string"), F.format_number(F.col("o_orderkey") % 20 * 100 + 0.5, 2)
    line = lambda text, heading=False: F.struct(text.alias("text"), F.lit(heading).alias("is_heading"))
    blocks = F.array(
        line(F.lit("This agreement is made today.")), line(F.lit("1. Definitions. Terms have meanings.")), line(F.lit("1.1 More terms.")), line(F.concat(F.lit("2. Term. The term is "), months, F.lit(" months."))),
        line(F.lit("(a) renewal")), line(F.concat(F.lit("3. Liability: capped at S$ "), amount, F.lit(" in total"))),
    )
    annex = F.when(k % 2 == 0, F.array(line(F.lit("Annex"), True))).otherwise(F.slice(blocks, 1, 0))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", part=PART_ROWS // 7)
    rows = orders.select(k.alias("doc_id"), F.posexplode(F.concat(blocks, annex)).alias("pos", "b"))
    return C.segmented(rows.select("doc_id", "pos", "b.*"), together=True)


def _contract_labels(spark, sf_dir):
    return C.labelled(_contract_clauses(spark, sf_dir), spark.createDataFrame(HINTS, "key string, ord int, hint string"))


_ORDERS = "o AS (SELECT o_orderkey AS doc_id, o_custkey % 90 + 1 AS m, o_orderkey % 20 * 100 + 0.5 AS a FROM orders)"


@query(f"""WITH {_ORDERS} SELECT doc_id, x.idx, x.number, x.heading, x.text FROM o, LATERAL (SELECT unnest([
{{'idx': 0::BIGINT, 'number': '', 'heading': 'Preamble', 'text': 'This agreement is made today.'}}, {{'idx': 1, 'number': '1', 'heading': 'Definitions', 'text': 'Terms have meanings.' || chr(10) || '1.1 More terms.'}},
{{'idx': 2, 'number': '2', 'heading': 'Term', 'text': 'The term is ' || m || ' months.' || chr(10) || '(a) renewal'}}, {{'idx': 3, 'number': '3', 'heading': 'Liability', 'text': 'capped at S$ ' || format('{{:,.2f}}', a::DOUBLE) || ' in total'}},
{{'idx': 4, 'number': '', 'heading': 'Annex', 'text': ''}}]) AS x) WHERE x.idx < 4 OR doc_id % 2 = 0""")
def clause_segmentation(spark, sf_dir):
    return _contract_clauses(spark, sf_dir).withColumn("number", F.coalesce("number", F.lit("")))


@query(f"""WITH {_ORDERS}, l(idx, clause_key, confidence) AS (VALUES (0::BIGINT, 'parties', 0.7::DOUBLE), (1, 'definitions', 0.91), (2, 'term', 0.6), (3, 'liability', 0.91), (4, 'other', 0.0))
SELECT doc_id, idx, clause_key, confidence FROM o, l WHERE idx < 4 OR doc_id % 2 = 0""")
def clause_labels(spark, sf_dir):
    return _contract_labels(spark, sf_dir).select("doc_id", "idx", "clause_key", "confidence")


@query(f"""WITH {_ORDERS} SELECT doc_id, 'r1' AS rule_key, CASE WHEN m >= 60 THEN 'standard' WHEN m >= 24 THEN 'fallback' ELSE 'non_standard' END AS classification, CASE WHEN m >= 60 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM o
UNION ALL SELECT doc_id, 'r2', CASE WHEN a > 1000 THEN 'non_standard' ELSE 'standard' END, CASE WHEN a > 1000 THEN 0.9 ELSE 0.8 END FROM o
UNION ALL SELECT doc_id, r.k, r.c, r.s FROM o, (VALUES ('r3', 'missing', 0.85), ('r5', 'standard', 0.8), ('r6', 'non_standard', 0.8)) r(k, c, s)""")
def rule_evaluation(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return C.evaluated(spark.createDataFrame(RULES, RULE_SCHEMA), _contract_labels(spark, sf_dir), docs)


@query(f"""WITH {_ORDERS} SELECT doc_id, r.idx, r.law_rule FROM o, (VALUES (2::BIGINT, 't1'), (3, 't2')) r(idx, law_rule) UNION ALL SELECT doc_id, 3, 't4' FROM o WHERE a > 1000""")
def law_rule_pairs(spark, sf_dir):
    """Clauses that rules on local law look at: by key alone, and by words in the clause."""
    rules = [("t1", ["term"], []), ("t2", ["liability", "term"], ["CAPPED"]), ("t3", ["definitions"], ["penalty"]), ("t4", ["liability"], [f"S$ 1,{n}00" for n in range(10)])]
    return C.law_pairs(spark.createDataFrame(rules, "law_rule string, clause_keys array<string>, triggers array<string>"), _contract_labels(spark, sf_dir))


#: Written currencies, before and behind the amount, and their codes.
_MONEY = [("VNĐ", "VND"), ("vnd", "VND"), ("đồng", "VND"), ("usd", "USD"), ("US$", "USD"), ("EUR", "EUR"), ("€", "EUR"), ("Sgd", "SGD"), ("S$", "SGD"), ("MYR", "MYR"), ("RM", "MYR"), ("IDR", "IDR"), ("Rp.", "IDR"), ("$", "")]
_TERMS = [("{n} năm", 12), ("{n} bulan", 1), ("ten ({n}) years", 12), ("{n} (ba) tháng", 1), ("{n} tahun", 12)]
_SHORT = [("{n} hours", "h"), ("{n} giờ", "h"), ("{n} ngày làm việc", "bd"), ("{n} hari kerja", "bd"), ("{n} weeks", "w"), ("{n} minggu", "w"), ("{n} hari", "d"), ("{n} working days", "bd")]
_RATES = ["{n}%", "{n} phần trăm", "{n} per cent", "{n} percent"]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(f"""SELECT o_orderkey AS id, {_list(c for _, c in _MONEY)}[o_orderkey % {len(_MONEY)} + 1] AS currency, CAST(o_orderkey % 5000 * 1000 AS DOUBLE) AS amount, CAST((o_custkey % 40 + 1) * {_list(f for _, f in _TERMS)}[o_orderkey % {len(_TERMS)} + 1] AS BIGINT) AS months,
CAST(o_custkey % 20 + 1 AS BIGINT) AS short, {_list(u for _, u in _SHORT)}[o_orderkey % {len(_SHORT)} + 1] AS unit, CAST(o_custkey % 100 AS DOUBLE) AS percent, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '-001' ELSE '' END AS tax_code,
CASE WHEN o_orderkey % 3 = 0 THEN 200 ELSE 100 END::BIGINT AS spelled, CAST(o_custkey % 50 AS BIGINT) AS number FROM orders""")
def parse_values(spark, sf_dir):
    """All written currencies, terms, short periods and percentages, tax codes, and amounts that contradict their words."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda forms, by: F.get(F.array(*[F.lit(x) for x in forms]), (by % len(forms)).cast("int"))
    put = lambda form, n: F.replace(form, F.lit("{n}"), n.cast("string"))
    figure = F.translate(F.format_number(k % 5000 * 1000, 0), ",", ".")
    cur = pick([w for w, _ in _MONEY], k)
    money = F.when((k % 2 == 0) | cur.isin("Rp.", "$", "US$", "S$"), F.concat(cur, F.lit(" "), figure)).otherwise(F.concat(figure, cur))
    words = F.when(k % 3 == 0, "in words: two hundred dollars").otherwise("một trăm đồng")
    text = F.concat_ws("; ", money, put(pick([w for w, _ in _TERMS], k), c % 40 + 1), put(pick([w for w, _ in _SHORT], k), c % 20 + 1), put(pick(_RATES, k), c % 100), F.concat(F.lpad(k.cast("string"), 10, "0"), F.when(k % 2 == 0, "-001").otherwise("")), F.concat(F.lit("100 ("), words, F.lit(")")), F.concat((c % 50).cast("string"), F.lit(" copies")))
    v = F.col("v")
    first = lambda x: F.get(x, F.lit(0))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), V.values(text).alias("v"))
    of = lambda test: first(F.filter(v["periods"], test))
    long, short = of(lambda x: x["unit"] == "mo"), of(lambda x: x["unit"] != "mo")
    return rows.select("id", first(v["amounts"])["currency"].alias("currency"), first(v["amounts"])["value"].alias("amount"), long["value"].alias("months"), short["value"].alias("short"), short["unit"].alias("unit"), first(v["percents"]).alias("percent"), first(v["tax_codes"]).alias("tax_code"), first(v["spelled"])["words_value"].alias("spelled"), first(v["numbers"]).alias("number"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 1000 * 1000 + c_custkey % 1000 AS BIGINT) END AS value FROM customer")
def words_to_int(spark, sf_dir):
    """Numbers spelled in English or Vietnamese, read back; every seventh has a word that is none."""
    en = [w for w, n in sorted(V.EN_UNITS.items(), key=lambda x: x[1]) if n < 20]
    tens = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
    vi = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
    at = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    some = lambda test, *parts: F.when(test, F.concat(*parts))
    n = F.col("c_custkey") % 1000
    h, r = F.floor(n / 100), n % 100
    english = F.concat_ws(" ", some(h > 0, at(en, h), F.lit(" hundred")), some((h > 0) & (r > 0), F.lit("and")), F.when(r < 20, some((r > 0) | (n == 0), at(en, r))).otherwise(F.concat(at(tens, F.floor(r / 10)), F.when(r % 10 > 0, F.concat(F.lit("-"), at(en, r % 10))).otherwise(""))))
    viet = F.concat_ws(" ", some(h > 0, at(vi, h), F.lit(" trăm")), some((h > 0) & r.between(1, 9), F.lit("linh")), F.when(r < 10, some((r > 0) | (n == 0), at(vi, r))).otherwise(F.concat_ws(" ", F.when(r < 20, "mười").otherwise(F.concat(at(vi, F.floor(r / 10)), F.lit(" mươi"))), some(r % 10 > 0, at(vi, r % 10)))))
    k = F.col("c_custkey")
    words = F.when(k % 2 == 0, F.concat(english, F.lit(" thousand "), english)).otherwise(F.concat(viet, F.lit(" nghìn "), viet))
    # nothing in front of a scale is one of it, zero is none of it
    return table(spark, sf_dir, "customer").select(k.alias("id"), V.words_to_int(F.when(k % 7 == 0, F.concat(words, F.lit(" roughly"))).otherwise(words)).alias("value"))


@query("""WITH c AS (SELECT c_custkey AS k, make_date(2020, CAST(c_custkey % 12 + 1 AS INT), CAST(c_custkey % 27 + 1 AS INT)) AS d, c_custkey % 40 + 1 AS n, 1000000000 + c_custkey AS t FROM customer)
SELECT k AS pair_id, x.kind, x.side, x.value FROM c, LATERAL (SELECT unnest([
{'kind': 'date', 'side': 'primary', 'value': CAST(d AS VARCHAR), 'on': k % 3 = 0}, {'kind': 'date', 'side': 'other', 'value': CAST(d + 1 AS VARCHAR), 'on': k % 3 = 0}, {'kind': 'tax_code', 'side': 'primary', 'value': CAST(t AS VARCHAR), 'on': k % 4 = 0}, {'kind': 'tax_code', 'side': 'other', 'value': CAST(t + 5 AS VARCHAR), 'on': k % 4 = 0},
{'kind': 'number', 'side': 'primary', 'value': CAST(n AS VARCHAR), 'on': k % 5 = 0}, {'kind': 'number', 'side': 'other', 'value': CAST(n + 1 AS VARCHAR), 'on': k % 5 = 0}, {'kind': 'figure_words', 'side': 'other', 'value': '100 (in words: two hundred)', 'on': k % 6 = 0}]) AS x) WHERE x.on""")
def bilingual_diffs(spark, sf_dir):
    """Dates, tax codes, numbers and amounts in words of two versions written from customers."""
    k = F.col("c_custkey")
    off = lambda n, by=1: F.when(k % n == 0, by).otherwise(0)
    text = lambda x: x.cast("string")
    day, month, copies, code = k % 27 + 1, k % 12 + 1, k % 40 + 1, k + 1_000_000_000
    vi = F.concat(F.lit("Ký ngày "), text(day), F.lit(" tháng "), text(month), F.lit(" năm 2020, mã số thuế "), text(code), F.lit(", lập thành "), text(copies), F.lit(" bản, phạt 100 đồng (Bằng chữ: Một trăm đồng)"))
    en = F.concat(F.lit("Signed on "), text(day + off(3)), F.lit("/"), text(month), F.lit("/2020, tax code "), text(code + off(4, 5)), F.lit(", made in "), text(copies + off(5)), F.lit(" originals, penalty VND 100 (in words: "), F.when(k % 6 == 0, "two").otherwise("one"), F.lit(" hundred)"))
    return C.differences(table(spark, sf_dir, "customer").select(k.alias("pair_id"), vi.alias("primary"), en.alias("other")))


@query("""WITH o AS (SELECT o_orderkey AS note_id, o_orderkey % 6 AS m, o_custkey AS u, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT note_id, 0::BIGINT AS claim_no, CASE m WHEN 1 THEN '' WHEN 2 THEN 'none' WHEN 4 THEN 'old' || u ELSE CAST(u AS VARCHAR) END AS unit_id,
CASE WHEN m = 1 THEN 'uncited' WHEN m = 2 OR NOT known THEN 'invalid_source' WHEN m = 3 THEN 'misquoted' WHEN m = 4 THEN 'not_in_force' WHEN m = 5 THEN 'partial' ELSE 'supported' END AS result, CASE WHEN known AND m = 0 THEN 0.9 WHEN known AND m = 5 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM o""")
def citation_validation(spark, sf_dir):
    """Notes on orders that cite their customer's unit: quoted, uncited, unknown, misquoted, out of force, in other words."""
    k, u = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    cite = lambda words, unit: F.concat(F.lit(words + " [[src:"), unit, F.lit("]]."))
    note = F.when(k == 0, cite('It says "must repay all amounts due"', u)).when(k == 1, "Nothing is cited here.").when(k == 2, "An unknown unit [[src:none]].").when(k == 3, cite('It says "never written anywhere"', u)).when(k == 4, cite("Old law holds", F.concat(F.lit("old"), u))).otherwise(cite("Customers must repay quickly", u))
    c = F.col("c_custkey").cast("string")
    day = lambda s: F.lit(s).cast("date")
    unit = lambda key, start, end, status: F.struct(key.alias("unit_id"), F.concat(F.lit("Customer "), c, F.lit(" must repay all amounts due.")).alias("text"), day(start).alias("effective_from"), day(end).alias("effective_to"), F.lit(status).alias("status"))
    units = table(spark, sf_dir, "customer").select(F.explode(F.array(unit(c, "2000-01-01", None, "in_force"), unit(F.concat(F.lit("old"), c), "1990-01-01", "2000-01-01", "repealed"))).alias("x")).select("x.*")
    return S.validated(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), note.alias("text")), units, "2024-06-01")


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'NDA' WHEN 1 THEN 'SERVICES' WHEN 2 THEN 'DPA' WHEN 3 THEN 'NDA' ELSE 'OTHER' END AS kind FROM part")
def contract_type(spark, sf_dir):
    """Titles in upper and lower case, one with two types (the first in order counts), one beyond what is read."""
    k = F.col("p_partkey") % 5
    title = F.when(k == 0, F.concat(F.lit("Mutual NON-Disclosure on "), "p_name")).when(k == 1, F.concat(F.lit("Master SERVICES Agreement on "), "p_name")).when(k == 2, "Data processing terms").when(k == 3, "Services agreement and confidentiality agreement").otherwise(F.concat(F.repeat(F.lit("lease "), 600), F.lit("services agreement")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.contract_type(title, TYPES).alias("kind"))


ROUTING_SQL = """WITH e AS (SELECT n_nationkey AS n, n_nationkey % 3 AS tier, n_nationkey % 5 = 0 AS byo, 'p' || n_regionkey AS provider, n_nationkey % 4 = 0 AS anywhere, 'R' || n_regionkey AS region, n_nationkey % 2 = 0 AS vision, n_nationkey % 3 = 0 AS speaks_vi, 1000 * (n_nationkey + 1) AS most FROM nation),
r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'R' || (c_custkey % 4) END AS residency, c_custkey % 20 * 500 AS est_in, c_custkey % 3 AS top, (c_custkey // 3) % 3 AS wished FROM customer),
j AS (SELECT k AS request_id, CAST(n AS VARCHAR) AS endpoint_id, n, tier, wished, CASE WHEN k % 2 = 1 OR speaks_vi THEN 0 ELSE 1 END AS speaks, round((est_in * n + 500 * 2 * n) / 1e6, 6) AS cost,
CASE WHEN k % 6 = 1 AND provider = 'p1' THEN 'matter_conflict_deny' WHEN k % 6 = 2 AND provider <> 'p2' THEN 'matter_not_allowlisted' WHEN n % 7 = 3 THEN 'endpoint_disabled' WHEN residency IS NOT NULL AND NOT anywhere AND region <> residency THEN 'residency'
WHEN k % 8 = 0 AND NOT anywhere AND residency IS NULL THEN 'restricted_requires_self_hosted' WHEN k % 3 = 0 AND NOT vision THEN 'capability_missing:vision' WHEN est_in + 500 > most THEN 'context_too_long' WHEN tier > top THEN 'tier_above_rule' WHEN k % 10 = 0 AND tier < top THEN 'below_escalation_tier'
WHEN k % 9 = 0 AND tier = 0 THEN 'below_quality_floor' WHEN byo AND NOT (k % 7 = 0 AND provider IN ('p0', 'p3')) THEN 'no_byo_credential' WHEN (est_in * n + 500 * 2 * n) / 1e6 > 0.05 THEN 'budget_exceeded' ELSE '' END AS reason FROM r, e)
SELECT request_id, endpoint_id, reason, CASE WHEN reason = '' THEN row_number() OVER (PARTITION BY request_id, reason = '' ORDER BY CASE WHEN tier = wished THEN 0 WHEN tier < wished THEN 1 ELSE 2 END, abs(tier - wished), speaks, cost, n) ELSE 0 END AS rank FROM j"""


@query(ROUTING_SQL)
def routing_plan(spark, sf_dir):
    """A request for each customer over endpoints written from nations."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    some = lambda test, *items: F.when(test, F.array(*map(F.lit, items))).otherwise(F.array().cast("array<string>"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    provider = text("p", F.col("n_regionkey"))
    endpoints = table(spark, sf_dir, "nation").select(
        n.cast("string").alias("endpoint_id"), provider.alias("provider"), F.array(provider).alias("parties"), text("T", n % 3).alias("tier"), F.when(n % 5 == 0, "byo").otherwise("plan").alias("billing"), F.when(n % 4 == 0, F.array(F.lit("*"))).otherwise(F.array(text("R", F.col("n_regionkey")))).alias("regions"),
        F.concat(F.array(F.lit("json")), some(n % 2 == 0, "vision")).alias("capabilities"), F.concat(F.array(F.lit("en")), some(n % 3 == 0, "vi")).alias("speaks"), ((n + 1) * 1000).cast("int").alias("max_context"), n.cast("double").alias("price_in"), (n * 2).cast("double").alias("price_out"), (n % 7 != 3).alias("enabled"), n.cast("int").alias("registry_pos"),
    )
    requests = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), some(k % 6 == 1, "p1").alias("deny"), F.when(k % 6 == 2, F.array(F.lit("p2"))).alias("allow"), F.when(k % 5 == 0, text("R", k % 4)).alias("residency"), F.concat(F.array(F.lit("json")), some(k % 3 == 0, "vision")).alias("requires"), F.when(k % 8 == 0, "restricted").otherwise("normal").alias("sensitivity"),
        F.when(k % 9 == 0, "high").otherwise("low").alias("quality_floor"), F.when(k % 2 == 0, F.array(F.lit("vi"))).otherwise(F.array(F.lit("en"))).alias("languages"), (k % 20 * 500).cast("int").alias("est_in"), F.lit(500).alias("est_out"), text("T", k % 3).alias("max_tier"), text("T", F.floor(k / 3) % 3).alias("preferred_tier"),
        (k % 10 == 0).alias("escalated"), some(k % 7 == 0, "p0", "p3").alias("byo_providers"), F.lit(0.05).alias("budget"),
    )
    p = routing.plan(requests, endpoints)
    return p.select("request_id", "endpoint_id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("rank", F.lit(0)).alias("rank"))
