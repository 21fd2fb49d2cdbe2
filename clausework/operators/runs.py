"""Runs over a manifest of instruments: validation, the outcome of each, its units and a review report.

A parse never fails a run: what goes wrong with one instrument is a row with a status and a reason, and the
manifest is the left side of every join, so each of its rows comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import reprints
from clausework.sources.tables import kept

# Shapes of ids, jurisdictions and addresses, known formats, least sections, lines that titles and dates are looked for in.
ID, JURISDICTION, URL = r"^[A-Z]{2}/[A-Za-z0-9_.-]{2,80}$", r"^[A-Z]{2}$", r"^https?://\S+$"
FORMATS = ["sso_html", "pdf", "text", "vbpl_html", "docx"]
LEAST_SECTIONS, TITLE_LINES, DATE_LINES, STALE_DAYS = 3, 150, 200, 5 * 365
#: What stands before the date of a version, and first letters of months, English and Malay.
AS_AT = ["current version as at", "reprint as at", "as at", "revised edition", "incorporating all amendments up to", "sebagaimana pada"]
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mac": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "ogo": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dis": 12}
EXCERPT, SHOWN = 220, 3


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(jurisdiction, id, violation) of ``manifest(jurisdiction, id, url, format)``: ids, addresses and formats that don't fit, and ids that come twice."""
    twice = F.count("*").over(Window.partitionBy("jurisdiction", "id")) > 1
    wrong = {
        "bad_jurisdiction": ~F.coalesce(F.col("jurisdiction").rlike(JURISDICTION), F.lit(False)), "bad_id": ~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "other_jurisdiction": F.substring_index("id", "/", 1) != F.col("jurisdiction"),
        "bad_url": F.col("url").isNotNull() & ~F.col("url").rlike(URL), "unknown_format": ~F.coalesce(F.col("format").isin(FORMATS), F.lit(False)), "duplicate_id": F.col("twice"),
    }
    rows = manifest.withColumn("twice", twice)
    return rows.select("jurisdiction", "id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in wrong.items()]))).alias("violation")).distinct()


def version_date(text: Column) -> Column:
    """The first valid date behind words such as 'as at'."""
    pattern = r"(?i)(?:" + "|".join(p.replace(" ", r"\s+") for p in AS_AT) + r")\s+(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def day(found: Column) -> Column:
        part = F.split(found, r"\s+")
        month = F.element_at(months, F.lower(F.substring(F.get(part, F.lit(1)), 1, 3)))
        return F.try_to_date(F.concat_ws("-", F.get(part, F.lit(2)), month.cast("string"), F.get(part, F.lit(0))), "y-M-d")

    return F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), day), lambda d: d.isNotNull()), F.lit(0))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each instrument."""
    columns = [c for c in snapshots.columns if c != "id"]
    return snapshots.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("retrieved_at", "sha256")).alias("s")).select("id", "s.*")


def run(manifest: DataFrame, snapshots: DataFrame, lines: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, units) of ``manifest(jurisdiction, id, title, url, expect_title)``.

    ``snapshots(id, retrieved_at, url, sha256, error)`` has what was fetched or why not, ``lines(instrument, page,
    pos, text)`` the text of the newest ones. An outcome is parsed, needs_url, skipped (no snapshot yet), fetch_failed
    or parse_failed, with a reason, the version's date, warnings and counts. Only parsed instruments have units.
    """
    held = manifest.join(latest(snapshots).select("id", F.col("url").alias("source"), "sha256", "error"), "id", "left")
    # read three times below, and larger than their compressed columns tell: lines are never broadcast
    lines = kept(lines, "run-lines")
    text = lines.join(held.where("sha256 IS NOT NULL AND error IS NULL").select(F.col("id").alias("instrument"), "title", "expect_title").hint("merge"), "instrument")
    place = F.row_number().over(Window.partitionBy("instrument").orderBy("pos"))
    head = text.withColumn("n", place).where(F.col("n") <= DATE_LINES).groupBy("instrument").agg(F.first("expect_title").alias("expect"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    words = lambda n: F.array_join(F.transform(F.slice("l", 1, n), lambda x: x["text"]), " ")
    head = head.select(F.col("instrument").alias("id"), F.contains(T.comparison_key(words(TITLE_LINES)), T.comparison_key(F.col("expect"))).alias("titled"), version_date(words(DATE_LINES)).alias("version"))
    hints = held.select(F.col("id").alias("instrument"), F.explode(F.array("title", "expect_title")).alias("title"))
    placed, entries = reprints.read(text.select("instrument", "page", "pos", "text"), hints)
    found = kept(reprints._sections(placed, entries), "run-sections")
    stats = reprints.summarised(text.select("instrument", "page", "pos", "text"), placed, entries, found)
    stats = stats.withColumnRenamed("instrument", "id")
    rows = held.join(head, "id", "left").join(stats, "id", "left")
    few = F.coalesce("n_sections", F.lit(0)) < LEAST_SECTIONS
    ends = lambda status, detail: F.struct(F.lit(status).alias("status"), detail.alias("detail"))
    reason = (
        F.when(F.col("error").isNotNull(), ends("fetch_failed", F.col("error")))
        .when(F.col("sha256").isNull() & F.col("url").isNull(), ends("needs_url", F.lit("no address and no supplied file")))
        .when(F.col("sha256").isNull(), ends("skipped", F.lit("no snapshot yet")))
        .when(~F.coalesce("titled", F.lit(False)), ends("parse_failed", F.concat(F.lit("expected title '"), "expect_title", F.lit("' not found"))))
        .when(few, ends("parse_failed", F.concat(F.lit("only "), F.coalesce("n_sections", F.lit(0)).cast("string"), F.lit(" sections"))))
        .otherwise(ends("parsed", F.lit("")))
    )
    rows = rows.withColumn("r", reason).withColumns({"status": F.col("r.status"), "detail": F.col("r.detail")})
    parsed = F.col("status") == "parsed"
    told = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + " "), F.array_join(F.slice(c, 1, 15), ", ")))
    warnings = F.array_compact(F.array(
        F.when(F.col("version").isNull(), "no version date"), F.when(F.datediff(F.lit(today).cast("date"), F.col("version")) > STALE_DAYS, F.concat(F.lit("as at "), F.col("version").cast("string"))),
        F.when(F.col("n_chars") != F.col("n_placed"), "characters not placed"), told("in contents but not found:", F.col("missing")), told("not in contents:", F.when(F.col("n_entries") > 0, F.col("not_listed"))), told("heading differs:", F.col("differs")),
        told("heading of contents used:", F.col("unmatched")), told("repeated:", F.col("repeated")), told("empty:", F.col("empty")), F.when(F.col("stopped_at").isNotNull(), F.concat(F.lit("stopped at "), F.substring("stopped_at", 1, 60))),
    ))
    outcomes = kept(rows.select("jurisdiction", "id", "title", "status", "detail", F.coalesce("source", "url").alias("url"), "sha256", F.when(parsed, F.col("version")).alias("version"), F.when(parsed, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(parsed, F.col("n_sections")).otherwise(0).alias("n_units"), F.when(parsed, F.col("n_entries")).otherwise(0).alias("n_entries")), "run-outcomes")
    good = outcomes.where("status = 'parsed'").select(F.col("id").alias("instrument"), "version")
    units = found.where("rank = 1 AND text <> ''").join(good, "instrument").select(F.col("instrument").alias("id"), "section", F.concat(F.lit("s "), "number").alias("unit_path"), "heading", "text", "part", "notes", F.col("version").alias("effective_from"), F.lit("in_force").alias("status"))
    return outcomes, units


def sampled(units: DataFrame, shown: int = SHOWN) -> DataFrame:
    """All units of instruments with at most twice ``shown``, else the first and last ``shown`` in order; texts cut to an excerpt."""
    mine = Window.partitionBy("id")
    rows = units.withColumns({"first": F.row_number().over(mine.orderBy("section")), "n": F.count("*").over(mine)})
    rows = rows.where((F.col("first") <= shown) | (F.col("first") > F.col("n") - shown))
    flat = F.regexp_replace("text", r"\s+", " ")
    return rows.withColumn("excerpt", F.when(F.length(flat) > EXCERPT, F.concat(F.rtrim(F.substring(flat, 1, EXCERPT)), F.lit("…"))).otherwise(flat))


def review_report(outcomes: DataFrame, units: DataFrame) -> DataFrame:
    """(jurisdiction, report): a Markdown review of each jurisdiction's run, instruments by id."""
    shown = sampled(units).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.concat(F.lit("- **"), "unit_path", F.lit("** "), "heading", F.lit(": "), "excerpt").alias("line")))), lambda x: x["line"]), "\n").alias("sample"))
    part = F.concat_ws("\n", F.concat(F.lit("## "), "id", F.lit(" — "), "title"), F.concat(F.lit("status: "), "status", F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise("")), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("! "), w)), "\n"), "sample")
    each = outcomes.join(shown, "id", "left").select("jurisdiction", "id", "status", F.regexp_replace(part, "\n{2,}", "\n").alias("part"))
    head = F.concat(F.lit("# "), "jurisdiction", F.lit(": "), F.count_if(F.col("status") == "parsed").cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" parsed"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), "\n\n")
    return each.groupBy("jurisdiction").agg(F.concat(head, F.lit("\n\n"), body).alias("report"))
