"""Documents with every odd case: nulls, empty and long texts, repeats, extra columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today\nshort\nThe quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today\nshort\nThe quick brown fox jumps over the lazy dog near the river bank today"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank todaz\nother line with some more words in it"),
    (4, ""),
    (5, None),
    (6, " \n\t "),
    (7, "one two"),
    (8, LONG),
    (9, "Ünïcode wörter überall, ça va? Ñandú 数 字"),
    (None, "a row without id and a few words"),
    (7, "one two"),
]


def edge(spark: SparkSession, extra: bool = True) -> DataFrame:
    names = ["score", "n_words", "text_", "key", "hash", "node", "token", "__score", "labels", "probability"]
    schema = "doc_id bigint, text string" + "".join(f", `{n}` string" for n in names) * extra
    return spark.createDataFrame([(i, t, *["x"] * len(names) * extra) for i, t in TEXTS], schema)
