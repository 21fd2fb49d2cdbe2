"""Fill-in-middle transformation by relational units.

A text's units are the matches of a pattern, exploded with their ordinal.  A window over each
document sums their lengths, so the row of unit k knows how many code points end with it.  Each
document asks for two cuts, each behind a number of units drawn from a hash of its id; the requests
are joined with the units by ordinal, and an aggregate puts a document's two offsets side by side.
The text itself meets them once, at the end, where three substrings are rearranged.  All of it is
DataFrame expressions; units travel as three numbers, never as text.

Defined results: a null text is empty; an empty text, and one that contains a sentinel, stays as it
is (``plain``, null offsets); a null id draws like the empty string; repeated rows come as often as
they are; equal ids with different texts are cut alike by number, each on its own units; an empty
table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines with their end.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned integers from the first 8-digit groups of the hash of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def offsets(docs: DataFrame, unit: str, seed: int) -> DataFrame:
    """(id, hash, n, chars, first, second) of the documents that have units: code points in all and before both cuts.

    ``docs`` has (id, hash, text); id and hash together stand for one text of one id.
    """
    key = ["id", "hash"]
    found = docs.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit(f"({unit})"), F.lit(1))).alias("at", "unit"))
    # all that follows wants a document's units together, so they are dealt once
    dealt = found.select(*key, "at", F.length("unit").alias("size")).repartition(*key)
    # a repeated row repeats its units: the aggregate keeps one of each
    units = dealt.groupBy(*key, "at").agg(F.max("size").cast("bigint").alias("size"))
    summed = units.select(*key, (F.col("at") + 1).alias("ordinal"), F.sum("size").over(Window.partitionBy(*key).orderBy("at")).alias("end"))
    counts = units.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    one, two = (h % (F.col("n") + 1) for h in draws(F.col("id"), seed, 2))
    asked = counts.select(*key, "n", "chars", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.least(one, two).alias("ordinal")), F.struct(F.lit(2).alias("cut"), F.greatest(one, two).alias("ordinal")))).alias("r")).select(*key, "n", "chars", "r.*")
    met = asked.join(summed, [*key, "ordinal"], "left")
    # no unit stands before ordinal 0
    at = lambda cut: F.coalesce(F.max(F.when(F.col("cut") == cut, F.col("end"))), F.lit(0)).cast("bigint")
    return met.groupBy(*key).agg(F.max("n").alias("n"), F.max("chars").alias("chars"), at(1).alias("first"), at(2).alias("second"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, read from output and form alone."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    k = len(PREFIX)
    part = lambda a, b: F.substr(output, a + k, b - a - k)
    tail = F.substr(output, m + k, F.length(output))
    return F.when(form == "psm", F.concat(part(F.lit(1), s), tail, part(s, m))).when(form == "spm", F.concat(part(p, m), tail, part(F.lit(1), p))).otherwise(output)


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars and the ``output`` text.

    ``fim_percent`` of the documents are rearranged, ``spm_percent`` of these with the suffix first.
    """
    # a null id is an empty string from here on, so that keys are never null
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("hash"), "text")
    cut = docs.join(offsets(docs, unit, seed), ["id", "hash"], "left")
    _, _, h3, h4 = draws(F.col("id"), seed)
    odd = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (h3 % 100 >= fim_percent)
    cut = cut.select(F.expr("try_cast(id AS bigint)").alias("doc"), "text", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.col("chars").cast("int").alias("chars"), "first", "second", F.when(odd, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    text, first, second = F.col("text"), F.col("first").cast("int"), F.col("second").cast("int")
    a, b, c = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first), F.substr(text, second + 1, F.col("chars") - second)
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), a, F.lit(SUFFIX), c, F.lit(MIDDLE), b)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), c, F.lit(PREFIX), a, F.lit(MIDDLE), b)).otherwise(text)
    moved = F.col("form") != "plain"
    return cut.select(F.col("doc").alias(id_col), "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"), F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS tail FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
