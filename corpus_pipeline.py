"""From raw documents to packed windows: five stages over the tables of ``clausework.llm``.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, and its
decision takes effect: toxic documents go; lines that repeat an earlier line (or nearly) are cut,
and a document of which no line stays goes; one document of each near-duplicate group (five-word
shingles, similarity 0.8 or more) stays, the one with the smallest id; contaminated documents go;
the rest is packed.

Rows with the same id are one document to the near duplicate stage, and to line dedup if their texts
are equal too. Rows without id pass the near duplicate stage. Null and empty texts are clean, have no
lines and no shingles, and stay; each packs as one end mark. Columns beyond those used, of any name,
come back as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from clausework.llm.shared import drop, fresh, written

SHINGLE, NUM, DEN = 5, 80, 100


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    # the model learns from the documents as they came in, whatever of them is left
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("__score", docs.columns)
    return model.score(docs, "text", docs.columns, score).where(F.col(score) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing stays go."""
    removed = fresh("__removed", docs.columns)
    out = line_dedup.deduplicated(docs, count_col=removed)
    words = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", ""))
    return out.where((F.col(removed) == 0) | (words > 0)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    groups = ngram_join.components(docs, k=SHINGLE, num=NUM, den=DEN)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__other")).distinct()
    return docs.join(others, docs["doc_id"] == others["__other"], "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    found = fresh("__found", docs.columns)
    spans = decontaminate.removal_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns, found_col=found)
    return spans.where(~decontaminate.contaminated(found)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned scores and similarity components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)
        docs = out
    return docs
