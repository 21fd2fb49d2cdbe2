"""Statutes made of articles: lines to units, with parts, notes, dates and an account of every character.

Where an article starts depends on the ones before it: per instrument an aggregate over the few
candidate lines decides; all else is windows per instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import text as T

# How Vietnamese statutes mark articles, structure, closing lines, notes, items, numbers and commencement.
ARTICLE = r"(?U)^Điều\s+(\d{1,4}[a-z]?)\s*[.:]\s*(.*)$"
STRUCTURE = r"(?U)^(?:PHẦN|Phần|CHƯƠNG|Chương|MỤC|Mục|TIỂU MỤC|Tiểu mục)\s+\w+\b"
CLOSING = r"(?U)^(?:Nơi nhận\s*:|TM\.\s|KT\.\s|Q\.\s|CHỦ TỊCH\b|THỦ TƯỚNG\b|BỘ TRƯỞNG\b|PHỤ LỤC\b|(?:Bộ luật|Luật|Pháp lệnh|Nghị quyết) này (?:đã )?được Quốc hội)"
NOTE = r"^\[\d{1,3}\]\s"
WRAPPED = r"\n(?!(?:\d{1,2}\.|[a-zđ]\)|\d{1,2}\.\d{1,2}\.|[-–•])\s)"
DOCUMENT_NUMBER = r"(?iU)\b(?:(?:Bộ luật|Luật|Pháp lệnh|Nghị định|Nghị quyết|Thông tư)\s+)?số\s*:?\s*(\d{1,4}/\d{4}/[A-ZĐ0-9-]+)"
EFFECTIVE = r"(?iU)có hiệu lực(?: thi hành)?(?: kể)? từ ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"


def legacy_encoded(text: Column) -> Column:
    """Whether letters look like a Vietnamese font encoding from before Unicode."""
    n = F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(1))
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", "")) / n
    return (count(r"\x{1ea0}-\x{1ef9}ăĂđĐơƠưƯ") < 0.005) & (count(r"\x{a1}-\x{ff}") > 0.03)


def _starts(candidates: Column) -> Column:
    """Places of the lines that start articles, of (pos, n) in order.

    Numbers go up by one; a jump is taken only if the expected number never comes later.
    """
    none = F.array().cast("array<struct<pos:int,numbers:string>>")
    zero = F.struct(F.lit(1).alias("expected"), F.array().cast("array<int>").alias("at"), none.alias("skipped"))

    def step(s: Column, x: Column) -> Column:
        later = F.exists(candidates, lambda y: (y["pos"] > x["pos"]) & (y["n"] == s["expected"]))
        jump = (x["n"] > s["expected"]) & ~later
        gap = F.when(jump, F.array(F.struct(x["pos"].alias("pos"), F.concat_ws("-", s["expected"].cast("string"), (x["n"] - 1).cast("string")).alias("numbers")))).otherwise(none)
        taken = F.struct((x["n"] + 1).alias("expected"), F.concat(s["at"], F.array(x["pos"])).alias("at"), F.concat(s["skipped"], gap).alias("skipped"))
        return F.when((x["n"] == s["expected"]) | jump, taken).otherwise(s)

    return F.aggregate(candidates, zero, step, lambda s: F.struct(s["at"].alias("at"), s["skipped"].alias("skipped")))


def placed(lines: DataFrame) -> DataFrame:
    """``lines(instrument, pos, text)`` with the bucket of each line: start, body, note, structure, preamble or closing; its article (0: none) and part."""
    mine = Window.partitionBy("instrument").orderBy("pos")
    run = mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("instrument", F.col("pos").cast("int").alias("pos"), T.squeezed(F.col("text")).alias("text")).where("text <> ''")
    number = F.regexp_extract(F.regexp_extract("text", ARTICLE, 1), r"\d+", 0).try_cast("int")
    found = rows.where(F.col("text").rlike(ARTICLE)).groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("pos", number.alias("n")))).alias("c"))
    found = found.withColumn("s", _starts(F.col("c"))).select("instrument", "s.at", "s.skipped")
    ends = rows.where(F.col("text").rlike(CLOSING)).join(found, "instrument").where(F.col("pos") > F.get("at", F.lit(0))).groupBy("instrument").agg(F.min("pos").alias("end"))
    rows = rows.join(found, "instrument", "left").join(ends, "instrument", "left")
    closing = F.coalesce(F.col("pos") >= F.col("end"), F.lit(False))
    starts = ~closing & F.coalesce(F.array_contains("at", F.col("pos")), F.lit(False))
    skipped = F.transform(F.filter("skipped", lambda x: F.coalesce(x["pos"] < F.col("end"), F.lit(True))), lambda x: x["numbers"])
    marked = rows.select("instrument", "pos", "text", skipped.alias("skipped"), closing.alias("closing"), starts.alias("starts"), (~closing & ~starts & F.col("text").rlike(STRUCTURE)).alias("label"))
    upper = (F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))
    title = ~F.col("closing") & ~F.col("starts") & ~F.col("label") & upper & F.coalesce(F.lag("label").over(mine), F.lit(False))
    marked = marked.withColumn("title", title)
    named = F.when(F.lead("title").over(mine), F.concat_ws(" ", "text", F.lead("text").over(mine))).otherwise(F.col("text"))
    marked = marked.withColumn("named", F.when(F.col("label"), named))
    marked = marked.withColumn("part", F.coalesce(F.last("named", ignorenulls=True).over(run), F.lit(""))).withColumn("article", F.count_if("starts").over(run))
    bucket = F.when(F.col("closing"), "closing").when(F.col("starts"), "start").when(F.col("label") | F.col("title"), "structure").when(F.col("article") == 0, "preamble").when(F.col("text").rlike(NOTE), "note").otherwise("body")
    return marked.select("instrument", "pos", "text", "article", "part", "skipped", bucket.alias("bucket"))


def articles(lines: DataFrame) -> DataFrame:
    """(instrument, article, number, unit_path, heading, text, part, notes, effective_from, document_number) of each article that holds anything.

    A line that begins no item goes on with the line before it.
    """
    rows = placed(lines)
    ordered = lambda bucket: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("pos", "text")))), lambda x: x["text"])
    start = lambda c: F.max(F.when(F.col("bucket") == "start", c))
    per = rows.where("bucket IN ('start', 'body', 'note')").groupBy("instrument", "article").agg(
        start(F.regexp_extract("text", ARTICLE, 1)).alias("number"), start(F.trim(F.regexp_extract("text", ARTICLE, 2))).alias("heading"), F.regexp_replace(F.array_join(ordered("body"), "\n"), WRAPPED, " ").alias("text"), start(F.col("part")).alias("part"), ordered("note").alias("notes")
    )
    head = Window.partitionBy("instrument").orderBy("pos")
    lead = rows.where("bucket = 'preamble'").withColumn("r", F.row_number().over(head)).where("r <= 40").groupBy("instrument").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("head"))
    said = per.where(F.col("text").rlike(EFFECTIVE)).groupBy("instrument").agg(F.max_by("text", "article").alias("t"))
    part = lambda i: F.regexp_extract("t", EFFECTIVE, i)
    since = said.select("instrument", F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "y-M-d").alias("effective_from"))
    named = lead.select("instrument", F.nullif(F.regexp_extract("head", DOCUMENT_NUMBER, 1), F.lit("")).alias("document_number"))
    out = per.where("text <> '' OR heading <> ''").join(since, "instrument", "left").join(named, "instrument", "left")
    return out.select("instrument", "article", "number", F.concat(F.lit("Điều "), "number").alias("unit_path"), "heading", "text", "part", "notes", "effective_from", "document_number")


def accounting(lines: DataFrame) -> DataFrame:
    """Per instrument: characters (letters and digits) of all lines and of the placed ones, lines per bucket, and article numbers never found."""
    size = F.length(T.comparison_key(F.col("text")))
    total = lines.groupBy("instrument").agg(F.sum(size).alias("n_chars"))
    kinds = ("start", "body", "note", "structure", "preamble", "closing")
    per = placed(lines).groupBy("instrument").agg(F.sum(size).alias("n_placed"), *[F.count_if(F.col("bucket") == k).alias(f"n_{k}") for k in kinds], F.coalesce(F.first("skipped"), F.array().cast("array<string>")).alias("skipped"))
    return total.join(per, "instrument", "left")
