"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text.  The ledger keeps the measurements and one bit per failed
rule; policies (versioned sets of rules) and ablations are then bit operations on the ledger and
never touch a text again.  Everything is DataFrame functions: no Python runs on the executors.

Defined results: a null or empty text measures 0 everywhere and fails ``few_words`` alone; rows
repeat as they come; an empty table gives an empty ledger; only the two named columns are read, so
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Bit by position. Each expression is true where the rule fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
]
#: Versions of the policy: the rules that reject a text.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols"],
    "v2": ["few_words", "repeated_words", "many_symbols", "short_words", "long_words", "duplicate_lines"],
}


def mask(rules: list[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows found at least twice in the text.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window (the distinct
    windows are fewer) pay for the sort that finds the places.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(windows)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words covered by the windows whose hash occurs at least twice."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        return F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1))

    places = F.array_sort(F.transform(_let(placed, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("bigint").alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the measurements that the rules read."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    split = base.select("_id", "_t", words.alias("_w"), lines.alias("_l"))
    counted = split.select(
        "_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("_h"),
    )
    repeats = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("bigint")).otherwise(_covered(F.col("_h")))
    return counted.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed_bits``: bit i is set where rule i of RULES fails."""
    bits = F.lit(0).cast("bigint")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measure(df, id_col, text_col).withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """One row per rule of the policy: texts it fails, texts that it alone rejects, kept without it.

    One bitwise aggregation over the ledger: no rule runs again.
    """
    policy = mask(POLICIES[version])
    seen = F.col("failed_bits").bitwiseAND(F.lit(policy))
    bit = lambda r: 1 << [n for n, _ in RULES].index(r)
    sums = [F.count_if(seen == 0).alias("kept_all")]
    for r in POLICIES[version]:
        sums += [F.count_if(seen.bitwiseAND(F.lit(bit(r))) != 0).alias(f"f_{r}"), F.count_if(seen == bit(r)).alias(f"o_{r}")]
    one = rows.agg(*sums)
    each = [F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept_all") + F.col(f"o_{r}")).alias("n_kept_without")) for r in POLICIES[version]]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v2")
    return rows.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
s AS (SELECT doc_id, CAST(sum(least(8, i - coalesce(b, i - 8))) AS BIGINT) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN s USING (doc_id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
      + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT
      + 32 * (100 * n_dup_lines > 50 * n_lines)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM f
"""
