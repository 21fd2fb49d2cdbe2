"""Named queries on contracts in two languages, statutes, parties and filtered search.

The driver tables hold no contracts: texts are written from table columns by rule and read back, so
that the SQL twin can tell from the columns what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.functions import values as V
from clausework.operators import bilingual as B
from clausework.operators import clauses as C
from clausework.operators import ingest
from clausework.operators import parties as P
from clausework.operators import search as S
from clausework.operators import statutes
from clausework.plans.catalog import query, table
from clausework.plans.texts import TYPES


@query("""SELECT o_orderkey AS id, 'USD' AS currency, round(o_totalprice, 2) AS amount, CAST(o_orderkey % 90 AS DOUBLE) AS percent, CAST(o_orderdate AS DATE) AS day,
CAST(CASE WHEN o_orderkey % 2 = 0 THEN 12 * (o_custkey % 9 + 1) ELSE o_custkey % 48 + 1 END AS INT) AS months, CAST(o_custkey % 30 + 1 AS BIGINT) AS notice, 'bd' AS unit, CAST(o_orderkey % 97 AS BIGINT) AS copies FROM orders""")
def order_values(spark, sf_dir):
    """Amounts, percentages, dates, durations, periods and plain numbers of texts written from orders."""
    day = lambda f: F.date_format("o_orderdate", f)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(k % 3 == 0, day("d/M/yyyy")).when(k % 3 == 1, day("d MMMM yyyy")).otherwise(day("'ngày' dd 'tháng' MM 'năm' yyyy"))
    term = F.when(k % 2 == 0, F.concat((c % 9 + 1).cast("string"), F.lit(" Năm"))).otherwise(F.concat(F.lit("twelve ("), (c % 48 + 1).cast("string"), F.lit(") MONTHS")))
    text = F.concat(F.lit("The price is Us$ "), F.format_number("o_totalprice", 2), F.lit(" since "), date, F.lit(", fee "), (k % 90).cast("string"), F.lit(" Per Cent, for "), term, F.lit(", notice "), (c % 30 + 1).cast("string"), F.lit(" business days, in "), (k % 97).cast("string"), F.lit(" copies"))
    v, first = F.col("v"), lambda found: F.get(found, F.lit(0))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), V.values(text).alias("v"))
    months, short = (first(F.filter(v["periods"], test)) for test in (lambda x: x["unit"] == "mo", lambda x: x["unit"] != "mo"))
    rows = rows.select("id", "v", months.alias("long"), short.alias("short"), first(v["amounts"]).alias("a"))
    return rows.select("id", "a.currency", F.col("a.value").alias("amount"), first(v["percents"]).alias("percent"), first(v["dates"])["value"].alias("day"), F.col("long.value").cast("int").alias("months"), F.col("short.value").alias("notice"), "short.unit", first(v["numbers"]).alias("copies"))


_SIDES = "(SELECT 'primary' AS side UNION ALL SELECT 'other')"


@query(f"""WITH o AS (SELECT o_orderkey AS pair_id, o_orderkey % 900 + 100 AS m, o_custkey % 50 AS pc, o_custkey % 25 + 1 AS d, o_orderkey % 11 = 0 AS alone FROM orders),
x AS (SELECT pair_id, side, 'amount' AS kind, format('{{:,.2f}}', (m + CASE WHEN side = 'other' AND pair_id % 5 = 0 THEN 1 ELSE 0 END) * 1000.0) AS value FROM o, {_SIDES} WHERE NOT alone AND pair_id % 5 = 0
UNION ALL SELECT pair_id, side, 'percent', CAST(CAST(pc + CASE WHEN side = 'other' THEN 1 ELSE 0 END AS DOUBLE) AS VARCHAR) FROM o, {_SIDES} WHERE NOT alone AND pair_id % 7 = 0
UNION ALL SELECT pair_id, side, 'duration', CAST(d + CASE WHEN side = 'other' THEN 1 ELSE 0 END AS VARCHAR) || ' d' FROM o, {_SIDES} WHERE NOT alone AND pair_id % 3 = 0
UNION ALL SELECT pair_id, 'primary', 'negation', '' FROM o WHERE NOT alone AND pair_id % 13 = 0
UNION ALL SELECT pair_id, 'primary', 'missing_counterpart', '' FROM o WHERE alone)
SELECT pair_id, kind, side, value, CASE WHEN kind IN ('negation', 'missing_counterpart') THEN 'medium' ELSE 'high' END AS severity, CASE kind WHEN 'negation' THEN 0.6 WHEN 'missing_counterpart' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM x""")
def version_differences(spark, sf_dir):
    """Differences between two language versions written from orders, with planted ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    off = lambda n: F.when(k % n == 0, 1).otherwise(0)
    money = lambda more: F.format_number((k % 900 + 100 + more) * 1000, 0)
    vi = F.concat(F.lit("Giá "), F.translate(money(F.lit(0)), ",", "."), F.lit(" VND, phạt "), (c % 50).cast("string"), F.lit("%, trong vòng "), (c % 25 + 1).cast("string"), F.lit(" ngày"), F.when(k % 13 == 0, ", bên bán không được từ chối.").otherwise("."))
    en = F.concat(F.lit("The price is VND "), money(off(5)), F.lit(", penalty "), (c % 50 + off(7)).cast("string"), F.lit("%, within "), (c % 25 + 1 + off(3)).cast("string"), F.lit(" days."))
    pairs = table(spark, sf_dir, "orders").select(k.alias("pair_id"), vi.alias("primary"), F.when(k % 11 == 0, "").otherwise(en).alias("other"))
    return C.differences(pairs, graded=True)


_CLAUSES = """SELECT c_custkey // 40 AS doc_id, k, 'Điều ' || k || '. Bên bán phải giao hàng cho ' || c_custkey || '.' AS vi, 'Article ' || k || '. The seller shall deliver to ' || c_custkey || '.' AS en FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS k FROM customer)"""


def _written_clauses(spark, sf_dir):
    from pyspark.sql import Window

    doc = F.floor(F.col("c_custkey") / 40)
    k = F.row_number().over(Window.partitionBy(doc).orderBy("c_custkey"))
    rows = table(spark, sf_dir, "customer").select(doc.alias("doc_id"), k.alias("k"), F.col("c_custkey").cast("string").alias("who"))
    line = lambda head, body: F.concat(F.lit(head), F.col("k").cast("string"), F.lit(body), F.col("who"), F.lit("."))
    return rows.select("doc_id", "k", line("Điều ", ". Bên bán phải giao hàng cho ").alias("vi"), line("Article ", ". The seller shall deliver to ").alias("en"))


def _layout_blocks(spark, sf_dir):
    """Table rows, inline pairs, alternating paragraphs and one language, one document for forty customers."""
    rows, d = _written_clauses(spark, sf_dir), F.col("doc_id") % 4
    none = F.array().cast("array<string>")
    block = lambda pos, text, cells: F.struct(pos.cast("int").alias("pos"), text.alias("text"), cells.alias("cells"))
    one = block(F.col("k") * 2, F.when(d == 0, F.concat_ws(" | ", "vi", "en")).when(d == 1, F.concat_ws(" ", "vi", "en")).otherwise(F.col("vi")), F.when(d == 0, F.array("vi", "en")).otherwise(none))
    return rows.select("doc_id", F.explode(F.when(d == 2, F.array(one, block(F.col("k") * 2 + 1, F.col("en"), none))).otherwise(F.array(one))).alias("b")).select("doc_id", "b.*", F.lit(False).alias("is_heading"))


@query(f"""WITH c AS ({_CLAUSES}), b AS (SELECT doc_id, k, 0 AS h, vi AS text, CASE WHEN doc_id % 4 IN (0, 1) THEN en ELSE '' END AS alt FROM c UNION ALL SELECT doc_id, k, 1, '', en FROM c WHERE doc_id % 4 = 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, h) - 1 AS INT) AS pos, text, alt, CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'inline' WHEN 2 THEN 'paragraphs' ELSE 'single' END AS layout FROM b""")
def bilingual_layouts(spark, sf_dir):
    return B.separated(_layout_blocks(spark, sf_dir)).select("doc_id", "pos", "text", "alt", "layout")


@query(f"""WITH c AS ({_CLAUSES}), n AS (SELECT doc_id, max(k) AS last FROM c GROUP BY 1)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS idx, CAST(k AS VARCHAR) AS number, CASE WHEN last >= 2 THEN '' WHEN k = last THEN 'Title' ELSE '' END AS heading_alt, CASE WHEN last < 2 THEN en ELSE substring(en, 12 + length(CAST(k AS VARCHAR)) - 1) END AS text_alt, last >= 2 AS halves FROM c JOIN n USING (doc_id)""")
def two_halves(spark, sf_dir):
    """All English clauses in the last Vietnamese one, given back by number; without a preamble their title has no place."""
    rows = _written_clauses(spark, sf_dir)
    split = T.heading_split(T.clause_number(F.col("vi"))["rest"])
    # the whole other version meets the last clause alone
    every = rows.groupBy("doc_id").agg(F.max("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "en"))), lambda x: x["en"]), "\n").alias("all"))
    clauses = rows.join(every, ["doc_id", "k"], "left").select("doc_id", (F.col("k") - 1).cast("bigint").alias("idx"), F.col("k").cast("string").alias("number"), split["heading"].alias("heading"), split["body"].alias("text"), F.when(F.col("all").isNotNull(), "Title").otherwise("").alias("heading_alt"), F.coalesce("all", F.lit("")).alias("text_alt"))
    return B.redistributed(clauses).select("doc_id", "idx", "number", "heading_alt", "text_alt", "halves")


@query(f"""WITH c AS ({_CLAUSES}), n AS (SELECT doc_id, min(k) FILTER (k % 3 = 0) AS third, max(k) AS last FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN third IS NOT NULL THEN 'vi' END AS by_primary, CASE WHEN third IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'vi' ELSE 'en' END END AS by_other, CAST(third - 1 AS BIGINT) AS idx, CASE WHEN third IS NULL THEN 'no_prevailing' WHEN doc_id % 2 = 1 THEN 'contradict' ELSE 'prevails' END AS finding FROM n""")
def prevailing_language(spark, sf_dir):
    """Every third clause names the version that prevails; the versions of every other document contradict each other."""
    rows, third = _written_clauses(spark, sf_dir), F.col("k") % 3 == 0
    en = F.when(F.col("doc_id") % 2 == 0, "The Vietnamese version shall prevail.").otherwise("The English text will prevail.")
    return B.prevailing(rows.select("doc_id", (F.col("k") - 1).cast("bigint").alias("idx"), F.when(third, "Bản tiếng Việt sẽ được ưu tiên.").otherwise(F.col("vi")).alias("primary"), F.when(third, en).otherwise(F.col("en")).alias("other")))


_STATUTES = """SELECT s_suppkey // 40 AS instrument, k, s_suppkey AS who, max(k) OVER (PARTITION BY s_suppkey // 40) AS last FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey // 40 ORDER BY s_suppkey) AS k FROM supplier)"""


def _statute_lines(spark, sf_dir):
    """Lines of a statute for forty suppliers: they are its articles, two to a chapter; article 2 quotes article 1 at the start of a line."""
    from pyspark.sql import Window

    instrument = F.floor(F.col("s_suppkey") / 40)
    w = Window.partitionBy(instrument)
    rows = table(spark, sf_dir, "supplier").select(instrument.alias("instrument"), F.row_number().over(w.orderBy("s_suppkey")).alias("k"), F.col("s_suppkey").cast("string").alias("who"), F.count("*").over(w).alias("last"))
    k = F.col("k").cast("string")
    some = lambda test, *lines: F.when(test, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        some(F.col("k") == 1, F.lit("LUẬT"), F.concat(F.lit("Luật số: "), F.col("instrument").cast("string"), F.lit("/2020/QH14"))),
        some(F.col("k") % 2 == 1, F.concat(F.lit("Chương "), k), F.lit("QUY ĐỊNH")),
        F.array(F.concat(F.lit("Điều "), k, F.lit(". Nhà cung cấp "), F.col("who")), F.lit("1. Khoản một"), F.lit("nối tiếp"), F.lit("a) Điểm a")),
        some(F.col("k") == 2, F.lit("Điều 1. Được dẫn lại")),
        some(F.col("k") % 5 == 0, F.lit("[1] Ghi chú")),
        some(F.col("k") == F.col("last"), F.lit("Luật này có hiệu lực từ ngày 01 tháng 07 năm 2021."), F.lit("Nơi nhận: lưu trữ"), F.lit("Điều 999. Sau cùng")),
    )
    return rows.select("instrument", F.col("k").alias("block"), F.posexplode(lines).alias("i", "text")).select("instrument", (F.col("block") * 100 + F.col("i")).alias("pos"), "text")


@query(f"""WITH s AS ({_STATUTES}) SELECT instrument, CAST(k AS VARCHAR) AS number, 'Nhà cung cấp ' || who AS heading,
'1. Khoản một nối tiếp' || chr(10) || 'a) Điểm a' || CASE WHEN k = 2 THEN ' Điều 1. Được dẫn lại' ELSE '' END || CASE WHEN k = last THEN ' Luật này có hiệu lực từ ngày 01 tháng 07 năm 2021.' ELSE '' END AS text,
'Chương ' || (k - (k + 1) % 2) || ' QUY ĐỊNH' AS part, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_notes, DATE '2021-07-01' AS effective_from, instrument || '/2020/QH14' AS document_number FROM s""")
def article_units(spark, sf_dir):
    a = statutes.articles(_statute_lines(spark, sf_dir))
    return a.select("instrument", "number", "heading", "text", "part", F.size("notes").alias("n_notes"), "effective_from", "document_number")


@query(f"""WITH s AS ({_STATUTES}), n AS (SELECT instrument, max(k) AS n FROM s GROUP BY 1)
SELECT instrument, TRUE AS complete, n AS n_start, n // 5 AS n_note, 2 * ((n + 1) // 2) AS n_structure, 2::BIGINT AS n_preamble, 2::BIGINT AS n_closing, 3 * n + CASE WHEN n >= 2 THEN 1 ELSE 0 END + 1 AS n_body FROM n""")
def statute_accounting(spark, sf_dir):
    a = statutes.accounting(_statute_lines(spark, sf_dir))
    return a.select("instrument", ((F.col("n_chars") == F.col("n_placed")) & (F.size("skipped") == 0)).alias("complete"), "n_start", "n_note", "n_structure", "n_preamble", "n_closing", "n_body")


_LAWS = {"SG": ["singapore"], "MY": ["malaysia"], "VN": ["việt nam", "vietnam"]}


_FORMS = ["Pte Ltd", "Sdn. Bhd.", "Berhad", "JSC", "Co., Ltd.", "Limited", "LLC", "Inc."]


@query(f"""SELECT c_custkey AS id, translate(upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]), ' ', '') || ' Trading ' || {str(_FORMS)}[c_custkey % {len(_FORMS)} + 1] || CASE WHEN c_custkey % 3 = 0 THEN ',PT Maju Jaya' ELSE '' END AS parties,
CASE c_custkey % 4 WHEN 0 THEN 'VN' WHEN 1 THEN 'MY' WHEN 2 THEN 'SG' END AS law, CASE c_custkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 ELSE 0 END::DOUBLE AS confidence FROM customer""")
def parties_and_law(spark, sf_dir):
    """Who signs a contract with each customer, in all forms of companies; a law clause outweighs another law's name elsewhere."""
    k = F.col("c_custkey")
    name = F.concat(F.translate(F.initcap("c_mktsegment"), " ", ""), F.lit(" Trading "), F.get(F.array(*map(F.lit, _FORMS)), (k % len(_FORMS)).cast("int")))
    law = F.when(k % 4 == 0, " (seat: Singapore). Governing law: the law of Vietnam.").when(k % 4 == 1, " in Malaysia.").when(k % 4 == 2, " in Singapore, not Malaysia.").otherwise(" sign.")
    text = F.concat(F.lit("this deed is made between the seller, "), name, F.when(k % 3 == 0, " (one) and PT Maju Jaya of the islands, and again ").otherwise(" and "), name, law)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("t"))
    g = P.governing_law(F.col("t"), _LAWS)
    return rows.select("id", F.array_join(P.parties(F.col("t")), ",").alias("parties"), g["law"].alias("law"), g["confidence"].alias("confidence"))


_BOOKS = [("firm", "tenant", 1, ["web"], []), ("de_only", "tenant", 0, ["forum"], ["de"]), ("starter_en", "starter", 0, [], ["en"]), ("starter_any", "starter", 1, ["news", "forum"], [])]


@query("""WITH b(book_key, origin, ord, t, l) AS (VALUES ('firm', 'tenant', 1, ['web'], []), ('de_only', 'tenant', 0, ['forum'], ['de']), ('starter_en', 'starter', 0, [], ['en']), ('starter_any', 'starter', 1, ['news', 'forum'], [])),
m AS (SELECT doc_id, book_key, origin, row_number() OVER (PARTITION BY doc_id ORDER BY origin = 'starter', ord) AS r FROM documents, b WHERE (len(t) = 0 OR list_contains(t, source)) AND (len(l) = 0 OR list_contains(l, lang)))
SELECT d.doc_id, book_key, origin FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND r = 1""")
def playbook_choice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("contract_type"), F.col("lang").alias("law"))
    return P.chosen_playbooks(d, spark.createDataFrame(_BOOKS, "book_key string, origin string, ord int, contract_types array<string>, laws array<string>"))


@query(r"""WITH u AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 5 <> 0 AND DATE '2020-01-01' + CAST(doc_id % 3000 AS INT) <= DATE '2024-06-01' AND doc_id % 3 <> 0),
q AS (SELECT item_id AS qid, lower(coalesce(text, '')) AS t FROM benchmark),
qw AS (SELECT qid, f, w, row_number() OVER (PARTITION BY qid, f ORDER BY min(p)) AS r FROM (SELECT qid, f, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT qid, f, regexp_extract_all(CASE f WHEN 0 THEN t ELSE replace(strip_accents(t), 'đ', 'd') END, '[\p{L}\p{N}]{2,}') AS ws FROM q, (SELECT unnest([0, 1]) AS f)))
WHERE NOT list_contains(string_split('the,and,for,that,this,with,shall,any,are,not,under,such,all,may,its,which,from,been,has,have,each,other,into,of,to,in,on,or,by,be,an,as,at,is,it,if,no,và,của,các,có,được,cho,là,với,theo,trong,này,những,một,khi,thì,để,đã,sẽ,tại,về,do,từ,đến,hoặc,nếu,mà,như,trên,bị,vào,ra,phải,không', ','), w) GROUP BY 1, 2, 3),
uw AS (SELECT id, f, w, count(*) AS tf FROM (SELECT id, f, unnest(regexp_extract_all(CASE f WHEN 0 THEN t ELSE replace(strip_accents(t), 'đ', 'd') END, '[\p{L}\p{N}]{2,}')) AS w FROM u, (SELECT unnest([0, 1]) AS f)) GROUP BY 1, 2, 3),
s AS (SELECT qid, id, f, round(sum(tf) * 0.1, 6) AS score FROM uw JOIN qw USING (f, w) WHERE r <= 24 GROUP BY 1, 2, 3), m AS (SELECT qid, id, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY 1, 2)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 20""")
def filtered_search(spark, sf_dir):
    """Verified units in force of two jurisdictions (here languages), as written and without accents."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    units = d.select(i.alias("id"), "text", F.col("lang").alias("jurisdiction"), F.when(i % 5 == 0, "repealed").otherwise("in_force").alias("status"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 3000).cast("int")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.when(i % 3 == 0, "unverified").otherwise("verified").alias("review_status"))
    return S.searched(units, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), ["en", "fr"], "2024-06-01", require_verified=True)


@query("""WITH l AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, 'page # of ' || lower(l_returnflag) || '-##' AS shape FROM lineitem), n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1)
SELECT doc_id, shape, count(DISTINCT page) AS n_pages FROM l JOIN n USING (doc_id) GROUP BY doc_id, shape, pages HAVING count(DISTINCT page) >= greatest(3, ceil(pages * 0.3))""")
def line_shape_headers(spark, sf_dir):
    """Running headers with changing numbers, on the pages of a document for each supplier."""
    page = F.col("l_linenumber")
    text = F.concat(F.lit("Page  "), page.cast("string"), F.lit(" of "), "l_returnflag", F.lit("-"), (F.col("l_orderkey") % 90 + 10).cast("string"))
    return C.chrome(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), page.alias("page"), text.alias("text")))


_INGEST = f"""WITH c AS ({_CLAUSES}), n AS (SELECT doc_id, max(k) AS last FROM c GROUP BY 1)"""


@query(f"""{_INGEST} SELECT doc_id, k - 1 AS idx, CAST(k AS VARCHAR) AS number, 'Article' AS dummy, CASE WHEN doc_id % 4 = 3 THEN '' ELSE substring(en, 12 + length(CAST(k AS VARCHAR)) - 1) END AS text_alt, 'delivery' AS clause_key FROM c""".replace("'Article' AS dummy, ", ""))
def ingested_clauses(spark, sf_dir):
    """Clauses of contracts in all layouts with both versions and their label."""
    _, found = ingest.reviewed(_layout_blocks(spark, sf_dir), TYPES, _LAWS, spark.createDataFrame([("delivery", 0, "giao hàng"), ("delivery", 0, "deliver"), ("other_key", 1, "insurance")], "key string, ord int, hint string"))
    return found.select("doc_id", "idx", "number", "text_alt", "clause_key")


@query(f"""{_INGEST} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'vi' ELSE 'both' END AS output, CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'inline' WHEN 2 THEN 'paragraphs' ELSE 'single' END AS layout, 'OTHER' AS contract_type FROM n""")
def ingested_documents(spark, sf_dir):
    """Languages, layout and type of these contracts."""
    documents, _ = ingest.reviewed(_layout_blocks(spark, sf_dir), TYPES, _LAWS, spark.createDataFrame([("delivery", 0, "deliver")], "key string, ord int, hint string"))
    return documents.select("doc_id", "output", "layout", "contract_type")
