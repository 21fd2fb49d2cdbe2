"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing is a text sink whose rows are whole records, so archives can be in any store that Spark
writes to.  Of equal payloads of at least ``MIN_REVISIT`` bytes only the one with the smallest id is
stored; the others are revisit records that refer to it.

Reading cuts the archives at every ``WARC/1.0`` line, in parallel and inside files.  Each cut is a
candidate record with a successor: its own place plus the lengths that its header names.  A payload
may hold the magic line, even whole records, so candidates are no proof.  Pointer jumping from the
start of each file over these successors keeps the reachable candidates alone; within a block of a
file the jumps double in numpy, between blocks in joins (about log2 of a file's blocks).  Candidates
inside a payload are put back into their record.

Defined results: a null payload is empty; a null id is written as ``null`` and read as null; a null
url is written empty; line breaks in urls are percent-encoded; rows tied at the smallest id of equal
payloads are all responses; a repeated id may have several payloads, and a revisit is resolved by id
and digest; an empty table gives no files and an empty result; a record that the
chain can't reach (a damaged file) is not returned; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.linkage import bounded
from clausework.llm.shared import drop, new_folder, written

MAGIC = "WARC/1.0\r\n"
MIN_REVISIT = 100
_M = len(MAGIC)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", max_records: int = 50_000) -> None:
    """One record per row, in files of at most ``max_records`` records below ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    firsts = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "warc-firsts")
    # payloads are shuffled only if there are more repeated ones than may be broadcast
    joined = rows.join(bounded(firsts, firsts.count()), F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit("\r\n\r"),  # the sink adds the last line feed
    )
    joined.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", max_records).text(path)


def _field(name: str):
    return F.regexp_extract("header", f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)


def _described(df: DataFrame) -> DataFrame:
    """Header fields, payload length and digest of ``value`` (a record without its magic)."""
    df = df.withColumn("header", F.substring_index("value", "\r\n\r\n", 1))
    body = F.substring("value", F.length("header") + 5, F.greatest(F.length("value") - F.length("header") - 8, F.lit(0)))
    df = df.withColumn("payload", body).withColumn("size", F.octet_length("value").cast("bigint"))
    page = lambda name: F.regexp_extract(_field(name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return df.select(
        *[c for c in df.columns if c not in ("header", "payload", "size")], "size", "payload",
        F.octet_length("header").cast("bigint").alias("header_bytes"), _field("Content-Length").try_cast("bigint").alias("length"),
        F.lower(_field("WARC-Type")).alias("record_type"), page("WARC-Record-ID").alias("record_page"), page("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"), F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("named_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
    )


def _jumps(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor within the block; its own where there is none."""
    at = np.searchsorted(offset, successor)
    inside = at < len(offset)
    inside[inside] = offset[at[inside]] == successor[inside]
    return np.where(inside, at, np.arange(len(offset)))


def _exits(table: pa.Table) -> pa.Table:
    """Where the chain from each candidate leaves the block."""
    table = table.sort_by("offset")
    offset, successor = table["offset"].to_numpy(), table["successor"].to_numpy()
    jump = _jumps(offset, successor)
    while True:
        double = jump[jump]
        if (double == jump).all():
            break
        jump = double
    return pa.table({"file": table["file"], "offset": table["offset"], "leaves": pa.array(successor[jump])})


def _marked(table: pa.Table, entries: pa.Table) -> pa.Table:
    """Candidates on the chain that enters the block, and for each candidate the record it lies in."""
    table = table.sort_by("offset")
    offset = table["offset"].to_numpy()
    jump = _jumps(offset, table["successor"].to_numpy())
    reached = np.isin(offset, entries["offset"].to_numpy())
    while True:
        before = int(reached.sum())
        reached[jump[reached]] = True
        jump = jump[jump]
        if int(reached.sum()) == before and (jump[jump] == jump).all():
            break
    record = np.maximum.accumulate(np.where(reached, offset, -1)) if len(offset) else offset
    return pa.table({"file": table["file"], "block": table["block"], "offset": table["offset"], "reached": pa.array(reached), "record": pa.array(record)})


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(file, offset, record_type, record_page, refers_to, url, named_digest, payload_bytes, payload_digest[, payload]) of all records."""
    cuts = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    pieces = _described(cuts.withColumn("mark", F.xxhash64("value")))
    pieces = written(pieces.drop("value", *[] if with_payload else ["payload"]), "warc-pieces")
    # offsets: lengths before a piece in its block, and lengths of the blocks before
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + _M).alias("total"))
    base = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", base.alias("base"))
    inside = F.coalesce(F.sum(F.col("size") + _M).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("inside", inside).join(blocks, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside") - _M).where("offset >= 0")
    successor = F.coalesce(F.col("offset") + _M + F.col("header_bytes") + 4 + F.col("length") + 4, F.lit(-1))
    placed = written(placed.withColumn("successor", successor).drop("inside", "base", "seq"), "warc-candidates")
    links = placed.select("file", "block", "offset", "successor")
    most = links.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    entries = links.where("offset = 0").select("file", "offset")
    if most > 1:
        jump = written(links.groupBy("file", "block").applyInArrow(_exits, "file string, offset bigint, leaves bigint"), "warc-jumps")
        reach = entries
        for _ in range(int(most).bit_length()):
            step = reach.join(jump, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
            reach = written(reach.union(step).distinct(), "warc-reach")
            far = jump.select("file", F.col("offset").alias("from"), F.col("leaves").alias("offset")).join(jump, ["file", "offset"])
            jump = written(far.select("file", F.col("from").alias("offset"), "leaves"), "warc-jumps")
        entries = reach.join(links.select("file", "offset"), ["file", "offset"])
    entries = written(entries.join(links.select("file", "block", "offset"), ["file", "offset"]), "warc-entries")
    marks = written(links.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(_marked, "file string, block bigint, offset bigint, reached boolean, record bigint"), "warc-marks")
    if most > 1:  # a record may go on in the next block
        last = marks.groupBy("file", "block").agg(F.max("record").alias("last"))
        ahead = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        marks = marks.join(last.select("file", "block", ahead.alias("ahead")), ["file", "block"]).withColumn("record", F.when(F.col("record") < 0, F.col("ahead")).otherwise(F.col("record"))).drop("ahead")
    columns = ["file", "offset", "record_type", "record_page", "refers_to", "url", "named_digest", "payload_bytes", "payload_digest", *["payload"] * with_payload]
    all_pieces = placed.join(marks.select("file", "offset", "reached", "record"), ["file", "offset"])
    whole = all_pieces.where("reached AND payload_bytes = length").select(*columns)
    torn = written(all_pieces.where("reached AND NOT payload_bytes <=> length").select("file", F.col("offset").alias("record")), "warc-torn")
    if torn.isEmpty():
        drop(torn)
        return whole
    # payloads that hold the magic: their pieces are read once more and joined
    parts = all_pieces.select("file", "offset", "record", "mark").join(torn, ["file", "record"])
    texts = cuts.select("file", "value", F.xxhash64("value").alias("mark")).join(parts.select("file", "mark").distinct(), ["file", "mark"]).dropDuplicates(["file", "mark"])
    joined = parts.join(texts, ["file", "mark"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("v"))
    value = F.array_join(F.transform("v", lambda x: x["value"]), MAGIC)
    mended = _described(joined.select("file", F.col("record").alias("offset"), value.alias("value")))
    return whole.union(mended.where("payload_bytes = length").select(*columns))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload, which a revisit takes from the response of its page and digest."""
    one = records.where("record_type = 'response'").groupBy(F.col("record_page").alias("page"), F.col("payload_digest").alias("d")).agg(F.min("payload_bytes").alias("b"))
    back = records.where("record_type = 'revisit'").join(one, (F.col("refers_to") == F.col("page")) & (F.col("named_digest") == F.col("d")), "left")
    columns = ["record_page", "record_type", "refers_to"]
    return records.where("record_type <> 'revisit'").select(*columns, "payload_bytes", "payload_digest").union(back.select(*columns, "b", "d"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_archives(spark, path)).select(F.col("record_page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)
"""
