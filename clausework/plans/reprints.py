"""Named queries on statutes with tables of contents, written from customers: forty to an instrument, one section each.

Every fourth instrument has no contents.  Planted: running headers and page numbers, Part lines, headings
over two lines, misspelt and missing headings, entries without section and sections without entry, lines
that look like the next section, notes, a repeated section, and schedules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausework.operators import reprints, runs
from clausework.plans.catalog import query, table
from clausework.sources.tables import PART_ROWS, dealt

_BASE = """SELECT c_custkey // 40 AS instrument, c_custkey % 40 + 1 AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS who, (c_custkey // 40) % 4 <> 3 AS listed FROM customer"""
_SECTIONS = f"""WITH c AS ({_BASE}), s AS (SELECT *, max(k) OVER (PARTITION BY instrument) AS last FROM c)
SELECT instrument, k, who, listed, CASE WHEN NOT listed OR k % 11 = 0 THEN 'not_listed' WHEN k % 17 = 0 THEN 'none' WHEN k % 9 = 0 THEN 'close' ELSE 'exact' END AS matched,
listed AND k % 4 = 0 AND k < last AND (k + 1) % 11 <> 0 AND (k + 1) % 13 <> 0 AND (k + 1) % 17 <> 0 AS alike, listed AND k % 7 = 0 AS wrapped, last FROM s WHERE NOT listed OR k % 13 <> 0"""


def _lines(spark, sf_dir):
    """(instrument, page, pos, text): page 0 has the contents, page k section k, the last one the schedules."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.floor(key / 40).alias("instrument"), (key % 40 + 1).cast("int").alias("k"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij").alias("who"))
    # a customer is some fifteen lines
    rows = dealt(rows, "instrument", part=PART_ROWS // 15)
    rows = rows.withColumns({"listed": F.col("instrument") % 4 != 3, "last": F.max("k").over(Window.partitionBy("instrument"))})
    k, listed, lit = F.col("k"), F.col("listed"), F.lit
    none = F.array().cast("array<string>")
    name = lambda n: n.cast("string")
    some = lambda test, *lines: F.when(test, F.array(*lines)).otherwise(none)
    part = lambda: some(listed & (k % 5 == 0), F.concat(lit("PART "), name(k)), F.concat(lit("Matters of part "), name(k)))
    wrapped = lambda: some(listed & (k % 7 == 0), lit("towards the seller"))
    header, footer = F.concat(lit("Laws of Territory "), name(F.col("instrument"))), name(k)
    entry = F.concat(part(), F.array(F.concat(name(k), lit(". Duties of customer "), F.col("who"))), wrapped())
    front = F.concat(some(k == 1, header, F.concat(lit("ACT "), name(F.col("instrument"))), lit("ARRANGEMENT OF SECTIONS"), lit("Section")), F.when(k % 11 != 0, entry).otherwise(none))
    heading = some(k % 17 != 0, F.concat(lit("Duties of custo"), F.when(k % 9 == 0, "mmer ").otherwise("mer "), F.col("who")))
    alike = listed & (k % 4 == 0) & (k < F.col("last")) & ((k + 1) % 11 != 0) & ((k + 1) % 13 != 0) & ((k + 1) % 17 != 0)
    own = F.concat(
        part(), heading, F.when(k % 17 != 0, wrapped()).otherwise(none), F.array(F.concat(name(k), lit(". Each customer pays "), F.col("who"), lit(" in")), F.when(k % 6 == 0, "full at once.*").otherwise("full at once."), F.concat(lit("(a) item "), F.col("who"), lit(";"))),
        some(alike, F.concat(name(k + 1), lit(". is only a number in a list."))), some(~listed & (k % 19 == 0), F.concat(name(k), lit(". Again."))), some(k % 6 == 0, F.concat(lit("*NOTE—see "), F.col("who")), lit("of the report")),
    )
    page = F.concat(F.array(header), some(k == 1, lit("An Act to bind customers.")), F.when(listed & (k % 13 == 0), none).otherwise(own), F.array(lit("- - -"), footer))
    back = some(k == F.col("last"), header, F.concat(lit("ACT "), name(F.col("instrument"))), lit("FIRST SCHEDULE"), lit("1. A form"))
    block = lambda page, base, lines: F.struct(page.alias("page"), base.alias("base"), lines.alias("lines"))
    pages = F.array(block(lit(0), k * 100, F.when(listed, front).otherwise(none)), block(k, 1_000_000 + k * 10_000, page), block(k + 1, 1_000_000 + (k + 1) * 10_000, back))
    return rows.select("instrument", F.explode(pages).alias("p")).select("instrument", "p.page", "p.base", F.posexplode("p.lines").alias("i", "text")).select("instrument", "page", (F.col("base") + F.col("i")).alias("pos"), "text")


def _titles(spark, sf_dir):
    number = F.floor(F.col("c_custkey") / 40)
    return table(spark, sf_dir, "customer").select(number.alias("instrument"), F.concat(F.lit("Act "), number.cast("string")).alias("title")).distinct()


@query(f"""WITH s AS ({_SECTIONS}) SELECT CAST(instrument AS VARCHAR) AS instrument, CAST(k AS VARCHAR) AS number,
CASE WHEN k % 17 = 0 AND NOT (listed AND k % 11 <> 0) THEN '' ELSE 'Duties of custo' || CASE WHEN k % 9 = 0 AND k % 17 <> 0 THEN 'mmer ' ELSE 'mer ' END || who END || CASE WHEN wrapped THEN ' towards the seller' ELSE '' END AS heading,
'Each customer pays ' || who || ' in full at once.' || CASE WHEN k % 6 = 0 THEN '*' ELSE '' END || chr(10) || '(a) item ' || who || ';' || CASE WHEN alike THEN ' ' || (k + 1) || '. is only a number in a list.' ELSE '' END AS text,
CASE WHEN listed AND k >= 5 THEN 'PART ' || (k - k % 5) || ' Matters of part ' || (k - k % 5) ELSE '' END AS part, CASE WHEN k % 6 = 0 THEN '*NOTE—see ' || who || '|of the report' ELSE '' END AS notes, matched FROM s""")
def reprint_sections(spark, sf_dir):
    """Sections of statutes with and without contents, as paragraphs, with Part lines and notes."""
    s = reprints.sections(_lines(spark, sf_dir), _titles(spark, sf_dir))
    return s.select("instrument", "number", "heading", "text", "part", F.array_join("notes", "|").alias("notes"), "matched")


@query(f"""WITH c AS ({_BASE}), s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY k) AS r FROM c WHERE listed AND k % 11 <> 0)
SELECT instrument, CAST(r - 1 AS INTEGER) AS entry, CAST(k AS VARCHAR) AS number, 'Duties of customer ' || who || CASE WHEN k % 7 = 0 THEN '|towards the seller' ELSE '' END AS head,
CASE WHEN k % 5 = 0 THEN 'PART ' || k || '|Matters of part ' || k ELSE '' END AS before FROM s""")
def contents_entries(spark, sf_dir):
    """Entries of the tables of contents, with wrapped headings and the Part lines before them."""
    e = reprints.contents(_lines(spark, sf_dir))
    return e.select("instrument", "entry", "number", F.array_join("head", "|").alias("head"), F.array_join("before", "|").alias("before"))


@query(f"""WITH c AS ({_BASE}), n AS (SELECT instrument, max(k) AS last, bool_or(listed) AS listed FROM c GROUP BY 1),
x AS (SELECT instrument, count(*) FILTER (NOT listed OR k % 13 <> 0) AS n_sections, count(*) FILTER (listed AND k % 11 <> 0) AS n_entries, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (listed AND k % 13 = 0 AND k % 11 <> 0), '') AS missing,
coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (listed AND k % 13 <> 0 AND k % 11 <> 0 AND k % 9 = 0), '') AS differs, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (listed AND k % 13 <> 0 AND k % 17 = 0), '') AS unmatched,
coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (NOT listed AND k % 19 = 0), '') AS repeated FROM c GROUP BY 1)
SELECT CAST(x.instrument AS VARCHAR) AS instrument, TRUE AS complete, n_sections, n_entries, missing, differs, unmatched, repeated, 'FIRST SCHEDULE' AS stopped_at, CAST(2 AS BIGINT) AS n_after, 3 * last + 1 + CASE WHEN listed THEN 1 ELSE 0 END AS n_dropped FROM x JOIN n USING (instrument)""")
def reprint_summary(spark, sf_dir):
    """What was found, what disagrees with the contents, and whether every character has a place."""
    s = reprints.summary(_lines(spark, sf_dir), _titles(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("missing", "differs", "unmatched", "repeated")]
    return s.select("instrument", (F.col("n_chars") == F.col("n_placed")).alias("complete"), "n_sections", "n_entries", *lists, "stopped_at", "n_after", "n_dropped")


def _run(spark, sf_dir):
    """A manifest of the instruments with every outcome planted, by number modulo 7."""
    i = F.col("i")
    numbers = _titles(spark, sf_dir).select(F.col("instrument").alias("i"))
    name = F.concat(F.when(i % 2 == 0, "SG/act-").otherwise("MY/act-"), i.cast("string"))
    manifest = numbers.select(
        F.when(i % 2 == 0, "SG").otherwise("MY").alias("jurisdiction"), name.alias("id"), F.concat(F.lit("Act "), i.cast("string")).alias("title"), F.when(i % 7 != 6, F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("url"),
        F.when(i % 7 == 3, "Another Act").otherwise(F.concat(F.lit("Laws of Territory "), i.cast("string"))).alias("expect_title"), F.lit("pdf").alias("format"),
    )
    held = numbers.where(i % 7 < 5).select(name.alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v"), i)
    snapshots = held.select("id", F.timestamp_seconds(F.col("v") * 1000).alias("retrieved_at"), F.lit("x").alias("url"), F.concat(F.lit("sha"), F.col("v").cast("string")).alias("sha256"), F.when((i % 7 == 4) & (F.col("v") == 2), "HTTP 404").alias("error"))
    all_lines = _lines(spark, sf_dir).withColumn("i", F.col("instrument"))
    dated = numbers.select(i.alias("instrument"), F.lit(0).alias("page"), F.lit(-1).alias("pos"), F.concat(F.lit("Incorporating all amendments up to 1 Mac "), (F.lit(2010) + i % 15).cast("string")).alias("text"), i).where(i % 5 != 0)
    lines = all_lines.where((i % 7 != 2) | F.col("page").between(1, 2)).union(dated).select(name.alias("instrument"), F.col("page").cast("int").alias("page"), F.col("pos").cast("int").alias("pos"), "text")
    return manifest, snapshots, lines


@query("""WITH n AS (SELECT DISTINCT c_custkey // 40 AS i FROM customer), s AS (SELECT c_custkey // 40 AS i, c_custkey % 40 + 1 AS k, (c_custkey // 40) % 4 <> 3 AS listed FROM customer),
c AS (SELECT i, count(*) FILTER (NOT listed OR k % 13 <> 0) AS n_units FROM s GROUP BY 1)
SELECT CASE i % 2 WHEN 0 THEN 'SG' ELSE 'MY' END AS jurisdiction, CASE i % 2 WHEN 0 THEN 'SG' ELSE 'MY' END || '/act-' || i AS id, CASE i % 7 WHEN 2 THEN 'parse_failed' WHEN 3 THEN 'parse_failed' WHEN 4 THEN 'fetch_failed' WHEN 5 THEN 'skipped' WHEN 6 THEN 'needs_url' ELSE 'parsed' END AS status,
CASE i % 7 WHEN 2 THEN 'only 2 sections' WHEN 3 THEN 'expected title ''Another Act'' not found' WHEN 4 THEN 'HTTP 404' WHEN 5 THEN 'no snapshot yet' WHEN 6 THEN 'no address and no supplied file' ELSE '' END AS detail,
CASE WHEN i % 7 < 2 AND i % 5 <> 0 THEN make_date(2010 + i % 15, 3, 1) END AS version, CASE WHEN i % 7 < 2 THEN n_units ELSE 0 END AS n_units,
i % 7 < 2 AND i % 5 = 0 AS undated, i % 7 < 2 AND i % 5 <> 0 AND make_date(2010 + i % 15, 3, 1) < DATE '2025-01-01' - 1825 AS stale FROM n JOIN c USING (i)""")
def manifest_run(spark, sf_dir):
    """Each instrument's outcome, version and number of units."""
    outcomes, _ = runs.run(*_run(spark, sf_dir), "2025-01-01")
    has = lambda start: F.exists("warnings", lambda w: F.startswith(w, F.lit(start)))
    return outcomes.select("jurisdiction", "id", "status", "detail", "version", "n_units", has("no version").alias("undated"), has("as at").alias("stale"))


@query("""SELECT CASE WHEN o_orderkey % 6 = 1 THEN 'sg' ELSE 'SG' END AS jurisdiction, x.id, x.v AS violation FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 6 WHEN 2 THEN 'MY/' WHEN 3 THEN 'SG:' ELSE 'SG/' END || 'act-' || CASE WHEN o_orderkey % 6 = 5 THEN -(o_orderkey // 12) ELSE o_orderkey END AS id FROM orders) t,
LATERAL (SELECT id, unnest(CASE o_orderkey % 6 WHEN 1 THEN ['bad_jurisdiction', 'other_jurisdiction'] WHEN 2 THEN ['other_jurisdiction'] WHEN 3 THEN ['bad_id', 'other_jurisdiction'] WHEN 4 THEN ['bad_url', 'unknown_format'] ELSE [] END) AS v) x
UNION ALL SELECT 'SG', 'SG/act-' || -d, 'duplicate_id' FROM (SELECT o_orderkey // 12 AS d, count(*) AS n FROM orders WHERE o_orderkey % 6 = 5 GROUP BY 1) WHERE n > 1""")
def manifest_violations(spark, sf_dir):
    """What is wrong with a manifest written from orders."""
    k = F.col("o_orderkey")
    number = F.when(k % 6 == 5, -F.floor(k / 12)).otherwise(k).cast("string")
    prefix = F.when(k % 6 == 2, "MY/").when(k % 6 == 3, "SG:").otherwise("SG/")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 6 == 1, "sg").otherwise("SG").alias("jurisdiction"), F.concat(prefix, F.lit("act-"), number).alias("id"), F.when(k % 6 == 4, "ftp://x").when(k % 2 == 0, "https://example.org/a").alias("url"), F.when(k % 6 == 4, "odt").otherwise("pdf").alias("format"))
    return runs.manifest_violations(rows)


@query("""WITH n AS (SELECT DISTINCT c_custkey // 40 AS i FROM customer), s AS (SELECT c_custkey // 40 AS i, c_custkey % 40 + 1 AS k, (c_custkey // 40) % 4 <> 3 AS listed FROM customer)
SELECT CASE i % 2 WHEN 0 THEN 'SG' ELSE 'MY' END AS jurisdiction, '# ' || CASE i % 2 WHEN 0 THEN 'SG' ELSE 'MY' END || ': ' || count(*) FILTER (i % 7 < 2) || ' of ' || count(*) || ' parsed' AS head, count(*) AS n_instruments, CAST(6 * count(*) FILTER (i % 7 < 2) AS BIGINT) AS n_shown FROM n GROUP BY i % 2""")
def run_reports(spark, sf_dir):
    """A Markdown report for each jurisdiction: its head, instruments and shown units."""
    r = runs.review_report(*runs.run(*_run(spark, sf_dir), "2025-01-01"))
    lines = lambda start: F.size(F.filter(F.split("report", "\n"), lambda x: F.startswith(x, F.lit(start)))).cast("bigint")
    return r.select("jurisdiction", F.substring_index("report", "\n", 1).alias("head"), lines("## ").alias("n_instruments"), lines("- **").alias("n_shown"))
