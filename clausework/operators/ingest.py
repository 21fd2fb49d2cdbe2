"""From blocks of documents to labelled clauses in one plan: languages, type, law and parties, layout, clauses, labels.

Each document is read once for what its whole text tells; that decides its way: two languages are parted,
one is left as it is, and both meet again before segmentation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import answers, bilingual, clauses, parties
from clausework.sources.tables import kept

#: The language that other versions are measured by, and the one beside it.
FIRST, SECOND = "vi", "en"


def described(blocks: DataFrame, types: dict[str, list[str]], laws: dict[str, list[str]]) -> DataFrame:
    """(doc_id, languages, contract_type, law, law_confidence, parties, primary, other, output): what a document's text tells.

    Findings come out in both languages of a bilingual document, else in Vietnamese or English.
    """
    whole = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))
    t, languages = F.col("t"), F.col("languages")
    law = parties.governing_law(t, laws)
    rows = whole.select("doc_id", T.contract_languages(t).alias("languages"), clauses.contract_type(t, types).alias("contract_type"), law.alias("g"), parties.parties(t).alias("parties"))
    first = F.array_contains(languages, FIRST)
    other = F.when(first & F.array_contains(languages, SECOND), SECOND)
    primary = F.when(first, FIRST).otherwise(F.coalesce(F.get(languages, F.lit(0)), F.lit(SECOND)))
    output = F.when(other.isNotNull(), "both").when(first, FIRST).otherwise(SECOND)
    return rows.select("doc_id", "languages", "contract_type", F.col("g.law").alias("law"), F.col("g.confidence").alias("law_confidence"), "parties", primary.alias("primary"), other.alias("other"), output.alias("output"))


def reviewed(blocks: DataFrame, types: dict[str, list[str]], laws: dict[str, list[str]], hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, clauses) of ``blocks(doc_id, pos, text, is_heading, cells)``.

    Clauses carry both versions, the key of the taxonomy and its confidence; documents the layout too: halves if the
    other version was one block that went back to its clauses.
    """
    told = kept(described(blocks, types, laws), "described")
    two = blocks.join(told.where("other IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    one = blocks.join(told.where("other IS NULL").select("doc_id"), "doc_id", "left_semi")
    parted = bilingual.separated(two, FIRST, SECOND).select("doc_id", "pos", "text", "is_heading", "alt", "layout")
    plain = one.select("doc_id", "pos", "text", "is_heading", F.lit("").alias("alt"), F.lit("single").alias("layout"))
    ready = kept(parted.union(plain), "parted")
    whole = kept(bilingual.redistributed(clauses.segmented(ready.drop("layout"))), "clauses")
    # hints look at both versions
    shown = answers.label_texts(whole)
    labels = clauses.labelled(shown, hints).select("doc_id", "idx", "clause_key", "confidence")
    layout = ready.groupBy("doc_id").agg(F.first("layout").alias("layout")).join(whole.groupBy("doc_id").agg(F.bool_or("halves").alias("halves")), "doc_id")
    documents = told.join(layout.select("doc_id", F.when(F.col("halves"), "halves").otherwise(F.col("layout")).alias("layout")), "doc_id", "left")
    return documents, whole.drop("halves").join(labels, ["doc_id", "idx"])


def comparable(labelled: DataFrame) -> DataFrame:
    """Clauses whose versions can be compared: all but the preamble."""
    return labelled.where("heading <> 'Preamble'")
