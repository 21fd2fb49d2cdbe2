"""Lexical and vector search, fusion, quote and citation checks.

Search terms meet the documents' tokens in equi-joins; nothing is compared pair by pair.  Ranks are
``row_number() <= k`` filters, which Spark applies before the shuffle as well (window group limit).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import vectors as V
from clausework.operators.findings import in_force
from clausework.sources.tables import dealt, kept

MAX_TERMS, MAX_QUERIES = 24, 1000
#: Units of a partition in which they are scored.
UNITS = 4000


def ranked(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def _scores(units: DataFrame, queries: DataFrame, form) -> DataFrame:
    terms = queries.select("qid", F.explode(F.slice(T.search_terms(form(F.col("text"))), 1, MAX_TERMS)).alias("term"))
    words = units.select("id", F.explode(T.tokens(form(F.col("text")))).alias("term"))
    met = words.join(terms.select("term").distinct(), "term", "left_semi")
    # scores of a unit are made where its words lie; a unit meets many queries, so that a partition takes few units
    wanted = dealt(met, "id", rows=units.count(), part=UNITS).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return wanted.join(F.broadcast(terms) if queries.count() <= MAX_QUERIES else terms, "term").groupBy("qid", "id").agg(F.round(F.sum("tf") * 0.1, 6).alias("score"))


def lexical(units: DataFrame, queries: DataFrame, k: int = 20, form=lambda c: c) -> DataFrame:
    """(qid, id, score, rank): a tenth of the summed frequencies of up to 24 query terms in each unit.

    ``form`` is applied to texts and queries first (``unaccented`` for the second index).
    """
    return ranked(_scores(units, queries, form), "qid", [F.desc("score"), F.col("id")], k)


def searched(units: DataFrame, queries: DataFrame, jurisdictions: list[str], asof: str, require_verified: bool = False, k: int = 20) -> DataFrame:
    """(qid, id, score, rank) over two indexes, as written and without accents; the better score counts.

    Only units of the jurisdictions, in force at ``asof`` and, if required, verified are searched:
    ``units(id, text, jurisdiction, status, effective_from, effective_to, review_status)``.
    """
    held = units.where(F.col("jurisdiction").isin(jurisdictions) & in_force(F.lit(asof).cast("date")))
    if require_verified:
        held = held.where("review_status = 'verified'")
    both = _scores(held, queries, lambda c: c).union(_scores(held, queries, T.unaccented))
    return ranked(both.groupBy("qid", "id").agg(F.max("score").alias("score")), "qid", [F.desc("score"), F.col("id")], k)


def reranked(hits: DataFrame, units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits by the overlap of the context's terms with the unit's, plus the lexical score."""
    hits = kept(hits, "hits")  # read twice
    c = queries.select("qid", T.search_terms(F.col("text")).alias("c"))
    u = units.join(hits.select("id").distinct(), "id", "left_semi").select("id", T.search_terms(F.col("text")).alias("u"))
    both = hits.join(c, "qid").join(u, "id")
    overlap = F.size(F.array_intersect("c", "u")) / (F.sqrt(F.size("c")) * F.sqrt(F.greatest(F.size("u"), F.lit(1))))
    new = F.when(F.size("c") == 0, F.col("score")).otherwise(overlap + F.col("score"))
    scored = both.select("qid", "id", F.col("rank").alias("before"), F.round(new, 6).alias("score"))
    return ranked(scored, "qid", [F.desc("score"), F.col("before")], k)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by cosine: all queries against all vectors.

    More than MAX_QUERIES queries go in hash blocks of about half of that, each with its own top k.
    """
    n = queries.count()
    if n > MAX_QUERIES:
        blocks = -(-2 * n // MAX_QUERIES)
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks).cast("bigint"))
        out = [V.all_pairs(vectors, queries.where(block == i), k) for i in range(blocks)]
        return functools.reduce(DataFrame.union, out)
    return V.all_pairs(vectors, queries, k)


def indexed(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``dense``, over a partitioned index that opens a list only where its bound allows."""
    index = V.build(vectors)
    n = queries.count()
    blocks = 1 if n <= MAX_QUERIES else -(-2 * n // MAX_QUERIES)
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks).cast("bigint"))
    return functools.reduce(DataFrame.union, [V.nearest(index, queries.where(block == i), k)[0] for i in range(blocks)])


def fused(lexical_hits: DataFrame, dense_hits: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion, ranks from 0."""
    a = lexical_hits.select("qid", "id", F.col("rank").alias("a"))
    b = dense_hits.select("qid", "id", F.col("rank").alias("b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(59) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "id"], "full_outer").select("qid", "id", "a", "b", F.round(part("a") + part("b"), 8).alias("score"))
    out = ranked(both, "qid", [F.desc("score"), F.coalesce("a", F.lit(1 << 30)), F.coalesce("b", F.lit(1 << 30)), F.col("id")], k)
    return out.select("qid", "id", "score", "rank")


def quoted(units: DataFrame, passages: DataFrame, lead: int = 6, chars: int = 6) -> DataFrame:
    """(id, pid) where the passage is a part of the unit's text (both in canonical form).

    The first and the last word of a passage may be parts of longer ones, those between are whole:
    candidates share the first ``lead`` of these, an equi-join on hashes.  Passages without such
    words join on their first ``chars`` characters.  Only candidates are compared.
    """
    words = lambda c: F.split(c, " ")
    p = passages.select("pid", T.canonical(F.coalesce("text", F.lit(""))).alias("p")).where("p <> ''").withColumn("w", words(F.col("p")))
    inner = F.slice("w", 2, F.least(F.size("w") - 2, F.lit(lead)))
    long = p.where(F.size("w") > 2).select("pid", "p", F.size(inner).alias("n"), F.xxhash64(F.array_join(inner, " ")).alias("h"))
    short = p.where(F.size("w") <= 2).select("pid", "p", F.least(F.length("p"), F.lit(chars)).alias("n")).withColumn("h", F.xxhash64(F.expr("substring(p, 1, n)")))
    u = units.select("id", T.canonical(F.coalesce("text", F.lit(""))).alias("t"))
    runs = lambda size, n, part: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), part)).otherwise(F.array().cast("array<bigint>"))

    def keyed(found: DataFrame, grams) -> DataFrame:
        sizes = [r.n for r in found.select("n").distinct().collect()]  # at most ``lead`` or ``chars`` values
        if not sizes:
            return u.select("id").limit(0).join(found.select("pid"), F.lit(False))
        hashes = u.select("id", F.explode(F.array_distinct(F.concat(*[grams(n) for n in sizes]))).alias("h"))
        return hashes.join(found.select("h", "pid"), "h").select("id", "pid").distinct()

    by_words = keyed(long, lambda n: T.bound(words(F.col("t")), lambda w: runs(F.size(w), n, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))))
    by_chars = keyed(short, lambda n: runs(F.length("t"), n, lambda i: F.xxhash64(F.substring("t", i, n))))
    met = by_words.union(by_chars)
    return met.join(u, "id").join(p.select("pid", "p"), "pid").where(F.contains("t", "p")).select("id", "pid")


def support(claim: Column, unit: Column, quotes: Column | None = None) -> Column:
    """(status, score): all quotes present, else the share of the claim's terms in the unit."""
    terms = T.search_terms(claim)
    score = F.size(F.array_intersect(terms, T.search_terms(unit))) / F.size(terms)
    status = F.when(score >= 0.6, "supported").when(score >= 0.3, "partial").otherwise("not_found")
    by_terms = F.when(F.size(terms) == 0, F.struct(F.lit("not_found").alias("status"), F.lit(0.0).alias("score"))).otherwise(F.struct(status.alias("status"), F.round(score, 3).alias("score")))
    if quotes is None:
        return by_terms
    exact = (F.size(quotes) > 0) & F.forall(quotes, lambda q: F.contains(T.canonical(unit), T.canonical(q)))
    return F.when(exact, F.struct(F.lit("supported").alias("status"), F.lit(0.9).alias("score"))).otherwise(by_terms)


def validated(notes: DataFrame, units: DataFrame, asof: str, require_cites: bool = True) -> DataFrame:
    """One row per claim and cited unit of ``notes(note_id, text)``: status and score.

    A claim without citation is ``uncited``; a citation fails as ``invalid_source``, ``not_in_force``
    or ``misquoted`` before its support is judged.
    """
    claims = notes.select("note_id", F.posexplode(T.sentences(F.col("text"))).alias("claim_no", "s"))
    claims = claims.select("note_id", "claim_no", T.unmarked(F.col("s")).alias("claim"), T.cited(F.col("s")).alias("cites"), T.quotes(F.col("s")).alias("quotes"))
    each = claims.select("note_id", "claim_no", "claim", "quotes", F.explode_outer("cites").alias("unit_id"))
    if not require_cites:
        each = each.where("unit_id IS NOT NULL")
    u = units.select(F.col("unit_id").alias("uid"), F.col("text").alias("unit"), "effective_from", "effective_to", "status")
    joined = each.join(u, F.col("unit_id") == F.col("uid"), "left")
    misquoted = F.exists("quotes", lambda q: ~F.contains(T.canonical(F.col("unit")), T.canonical(q)))
    judged = support(F.col("claim"), F.col("unit"), F.col("quotes"))
    fixed = lambda s: F.struct(F.lit(s).alias("status"), F.lit(0.0).alias("score"))
    holds = in_force(F.lit(asof).cast("date"))
    result = F.when(F.col("unit_id").isNull(), fixed("uncited")).when(F.col("uid").isNull(), fixed("invalid_source")).when(~holds, fixed("not_in_force")).when(misquoted, fixed("misquoted")).otherwise(judged)
    return joined.withColumn("r", result).select("note_id", F.col("claim_no").cast("bigint").alias("claim_no"), F.coalesce("unit_id", F.lit("")).alias("unit_id"), F.col("r.status").alias("result"), F.col("r.score").alias("score"))
