"""Who contracts under which law, and which playbook applies."""

from __future__ import annotations
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions import text as T

# Headings of clauses on the governing law, and forms of companies.
LAW_HEADING = r"governing law|applicable law|luật áp dụng|luật điều chỉnh|hukum yang berlaku|undang-undang yang mentadbir"
FORMS = ["Pte Ltd", "Sdn Bhd", "Berhad", "JSC", "Co Ltd", "Co, Ltd", "Limited", "LLC", "Inc"]
#: A form behind a name; each word of it may end with a point.
BEHIND = r"\b(?:" + "|".join(r"\s+".join(w.replace(",", "") + r"\.?" + "," * w.endswith(",") for w in form.split()) for form in FORMS) + r")(?![\p{L}\p{N}])"
BEFORE, WORDS, WORDS_BEHIND = "PT", 6, 5


def parties(text: Column, chars: int = 4000, most: int = 4) -> Column:
    """The first different companies named at the start of a contract.

    A company is a form of company with the capitalised words right before it, or PT with those behind it.
    """
    head = F.substring(F.coalesce(text, F.lit("")), 1, chars)
    # each name before a form ends the text in front of it
    marked = F.regexp_replace(head, f"({BEHIND})", "$1\u0001")
    marked = F.regexp_replace(marked, rf"\b({BEFORE}(?:\s+[A-Z][\p{{L}}\p{{N}}_&.-]*){{1,{WORDS_BEHIND}}})", "\u0001$1\u0001")
    word = r"[A-Z][\p{L}\p{N}_&.,'-]*\s+"
    name = lambda piece: F.when(piece.rlike(rf"^{BEFORE}\s"), piece).otherwise(F.regexp_extract(piece, rf"(?:^|[^\p{{L}}\p{{N}}_])((?:{word}){{1,{WORDS}}}{BEHIND})$", 1))
    names = F.filter(F.transform(F.split(marked, "\u0001"), name), lambda x: x != "")
    return F.slice(F.array_distinct(F.transform(names, lambda x: F.regexp_replace(x, "^[ ,]+|[ ,]+$", ""))), 1, most)


def governing_law(text: Column, laws: dict[str, list[str]], reach: int = 400) -> Column:
    """(law, confidence): the first law in order with a hint near a heading on the governing law (0.85), else anywhere (0.75), else null (0)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    first = lambda where: F.coalesce(*[F.when(F.lit(False) if not hints else F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(where, h)), law) for law, hints in laws.items()])
    windows = F.regexp_extract_all(low, F.lit(rf"(?s)(?=((?:{LAW_HEADING}).{{0,{reach}}}))"), F.lit(1))
    near = F.get(F.filter(F.transform(windows, lambda w: first(F.substring(w, 1, reach))), lambda x: x.isNotNull()), F.lit(0))
    law = lambda code, confidence: F.struct(code.alias("law"), F.lit(confidence).alias("confidence"))
    return T.bound(near, lambda n: F.when(n.isNotNull(), law(n, 0.85)).when(first(low).isNotNull(), law(first(low), 0.75)).otherwise(law(F.lit(None).cast("string"), 0.0)))


def chosen_playbooks(documents: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, book_key, origin) from ``documents(doc_id, contract_type, law)`` and ``books(book_key, origin, ord, contract_types, laws)``.

    Books of the tenant go before starter books, then the smaller ``ord``; an empty list fits all,
    documents without a fitting book have none.  Types and laws are exploded into an equi-join.
    """
    any_of = lambda c: F.explode(F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("*"))))
    keyed = books.select("book_key", "origin", "ord", "laws", any_of("contract_types").alias("kind")).select("book_key", "origin", "ord", "kind", any_of("laws").alias("rule")).distinct()
    known = lambda c: F.filter(F.array(F.col(c), F.lit("*")), lambda x: x.isNotNull())
    asked = documents.select("doc_id", F.explode(known("contract_type")).alias("kind"), "law").select("doc_id", "kind", F.explode(known("law")).alias("rule"))
    order = F.struct((F.col("origin") != "tenant").cast("int"), "ord", "book_key")
    best = asked.join(keyed, ["kind", "rule"]).groupBy("doc_id").agg(F.min_by(F.struct("book_key", "origin"), order).alias("b"))
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("b.book_key").alias("book_key"), F.col("b.origin").alias("origin"))
