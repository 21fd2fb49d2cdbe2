"""From blocks to clauses, labels, rule findings and language comparison.

Segmentation is gaps and islands: a running count of starts per document gives each block its
clause.  All windows are partitioned by document.  Blocks are dealt once, in as many partitions as their
number asks for; labels and findings stay in these, so what a task holds does not grow with the input.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from clausework.functions import text as T
from clausework.functions import values as V
from clausework.sources.tables import dealt


def segmented(blocks: DataFrame, together: bool = False) -> DataFrame:
    """(doc_id, idx, number, heading, text) from ``blocks(doc_id, pos, text, is_heading)``.

    With two keyword numbers or more ("Article 5") only these start clauses; else top-level numbers
    do.  Headings always start one.  What stands before the first is the preamble.  With a column
    ``alt``, the text of each block in the other language, clauses also get heading_alt and text_alt.
    ``together`` says that documents were dealt by doc_id before they were cut into blocks.
    """
    doc = Window.partitionBy("doc_id")
    run = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    two = "alt" in blocks.columns
    rows = (blocks if together else dealt(blocks, "doc_id")).select("doc_id", "pos", "text", "is_heading", T.clause_number(F.col("text")).alias("m"), (F.coalesce("alt", F.lit("")) if two else F.lit("")).alias("alt"))
    keyword = F.coalesce(F.col("m.keyword") != "", F.lit(False))
    many = F.count_if(keyword).over(doc) >= 2
    top = F.coalesce(~F.col("m.number").contains("."), F.lit(False))
    numbered = F.col("m").isNotNull() & (F.when(many, keyword).otherwise(top) | F.col("is_heading"))
    starts = numbered | (F.col("is_heading") & F.col("m").isNull())
    marked = rows.withColumn("numbered", numbered).withColumn("starts", starts)
    marked = marked.withColumn("clause", F.count_if("starts").over(run)).withColumn("split", T.heading_split(F.col("m.rest")))
    body = F.when(~F.col("starts"), F.col("text")).when(F.col("numbered"), F.col("split.body")).otherwise("")
    first = lambda c: F.max(F.when(F.col("starts"), c))
    joined = lambda c: F.trim(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), lambda t: t != ""), "\n"))
    other = T.alternate_heading(F.col("alt"))
    # the first other text of a clause carries its heading if it stands beside the start, or alone behind it
    leads = (F.col("clause") > 0) & (F.col("alt") != "") & (F.col("pos") == F.min(F.when(F.col("alt") != "", F.col("pos"))).over(Window.partitionBy("doc_id", "clause")))
    if two:
        marked = marked.withColumn("leads", leads & (F.col("starts") | (F.coalesce("text", F.lit("")) == "")))
    first_other = lambda c: F.max(F.when(F.col("leads"), c))
    per = marked.groupBy("doc_id", "clause").agg(
        first(F.when(F.col("numbered"), F.col("m.number"))).alias("number"),
        first(F.when(F.col("numbered"), F.col("split.heading")).otherwise(F.col("text"))).alias("heading"),
        joined(body).alias("text"),
        *([F.coalesce(first_other(other["heading"]), F.lit("")).alias("heading_alt"), joined(F.when(F.col("leads"), other["body"]).otherwise(F.col("alt"))).alias("text_alt")] if two else []),
    )
    place = F.row_number().over(doc.orderBy("clause")) - 1
    return per.select("doc_id", place.cast("bigint").alias("idx"), "number", F.when(F.col("clause") == 0, "Preamble").otherwise(F.col("heading")).alias("heading"), "text", *["heading_alt", "text_alt"] * two)


def labelled(clauses: DataFrame, hints: DataFrame) -> DataFrame:
    """The best taxonomy key of each clause from ``hints(key, ord, hint)``; ties go to the smaller ord.

    Hints of up to four letters are whole words, longer ones substrings; the taxonomy is small and goes
    to all clauses.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 600)))
    where = lambda c: F.struct(c.alias("s"), T.tokens(c).alias("w"))
    lists = hints.groupBy("key").agg(F.min("ord").alias("ord"), F.collect_set(F.lower("hint")).alias("hints"))
    lists = lists.agg(F.collect_list(F.struct("key", "ord", "hints")).alias("lists"))  # one row, so that clauses stay where they are
    whole = lambda x, hint: F.when(F.length(hint) <= 4, F.array_contains(x["w"], hint)).otherwise(F.contains(x["s"], hint))
    length = lambda hint: F.least(F.length(hint), F.lit(30)) / 1000.0

    def scored(x: Column) -> Column:
        head = lambda hints: F.transform(F.filter(hints, lambda h: whole(x["h"], h)), lambda h: F.when(F.length(h) > 4, 0.9).otherwise(0.6) + length(h))
        body = lambda hints: F.transform(F.filter(hints, lambda h: whole(x["t"], h)), lambda h: F.when(F.length(h) > 6, 0.45).otherwise(0.25) + length(h))
        score = lambda hints: F.coalesce(F.array_max(head(hints)), F.array_max(body(hints)), F.lit(0.0))
        every = F.transform("lists", lambda l: F.struct(score(l["hints"]).alias("score"), (-l["ord"]).alias("order"), l["key"].alias("key")))  # noqa: E741
        return F.array_max(F.filter(every, lambda e: e["score"] > 0))

    out = clauses.join(F.broadcast(lists), F.lit(True)).withColumn("b", T.bound(F.struct(where(F.lower(F.coalesce("heading", F.lit("")))).alias("h"), where(text).alias("t")), scored))
    preamble = F.col("heading") == "Preamble"
    return out.select(*clauses.columns, F.when(preamble, "parties").otherwise(F.coalesce("b.key", F.lit("other"))).alias("clause_key"), F.round(F.when(preamble, 0.7).otherwise(F.coalesce("b.score", F.lit(0.0))), 2).alias("confidence"))


#: Rules that may be broadcast.
MAX_RULES = 10_000
#: Documents of a partition in which they meet their first clauses.
DOCUMENT_ROWS = 100_000


def _known(rules: DataFrame) -> DataFrame:
    """Rules, to be broadcast while they are few."""
    return rules if rules.count() > MAX_RULES else F.broadcast(rules)


def _ruled(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses with a key that some rule names: no other clause meets a rule, so none of the rest need be sorted or read."""
    keys = rules.select("clause_key").distinct()
    return clauses if keys.count() > MAX_RULES else clauses.join(F.broadcast(keys), "clause_key", "left_semi")


def evaluated(rules: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document and rule that applies: classification and confidence.

    Only the first clause of a key counts, its first duration and first amount; the order of the
    tests decides.
    """
    first = _ruled(rules, clauses).groupBy("doc_id", "clause_key").agg(F.min_by(F.struct("idx", "heading", "text"), "idx").alias("c"))
    # values are read once for each first clause, whatever the number of rules on it
    body = F.concat_ws(" ", F.coalesce("c.heading", F.lit("")), F.coalesce("c.text", F.lit("")))
    read = first.select("doc_id", "clause_key", "c", body.alias("body"), V.values(body).alias("v")).select("doc_id", "clause_key", "c", "body", F.get(F.filter("v.periods", lambda x: x["unit"] == "mo"), F.lit(0))["value"].alias("months"), F.get("v.amounts", F.lit(0))["value"].alias("amount"), F.col("v.percents").alias("pct"))
    known = _known(rules)
    # a rule on a clause that a document lacks matters only if it is required; all rules meet their clause in an equi-join
    one = F.struct("clause_key", "c", "body", "months", "amount", "pct")
    kind = read.select(one.alias("x")).schema["x"].dataType
    docs = documents.select("doc_id")
    n = docs.count()
    per = dealt(read.where("clause_key IS NOT NULL"), "doc_id", rows=n, part=DOCUMENT_ROWS).groupBy("doc_id").agg(F.collect_list(one).alias("held"))
    required = F.broadcast(rules.where("required").agg(F.collect_set("clause_key").alias("keys"), F.bool_or(F.col("clause_key").isNull()).alias("keyless")))
    held = F.coalesce("held", F.array().cast(ArrayType(kind)))
    lacking = lambda key: F.struct(key.alias("clause_key"), *[F.lit(None).cast(kind[c].dataType).alias(c) for c in kind.names[1:]])
    wanted = F.when(F.col("keyless"), F.concat("keys", F.array(F.lit(None).cast("string")))).otherwise(F.col("keys"))
    absent = F.transform(F.array_except(wanted, F.transform(held, lambda x: x["clause_key"])), lacking)
    every = dealt(docs, "doc_id", rows=n, part=DOCUMENT_ROWS).join(per, "doc_id", "left").join(required, F.lit(True)).select("doc_id", F.explode(F.concat(held, absent)).alias("x"))
    rows = every.select("doc_id", "x.*").join(known.withColumnRenamed("clause_key", "on"), F.col("clause_key").eqNullSafe(F.col("on")))
    low = F.lower("body")
    has = lambda c: F.exists(F.coalesce(F.col(c), F.expr("array()").cast("array<string>")), lambda w: F.contains(low, F.lower(w)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    r = lambda name, confidence: F.struct(F.lit(name).alias("classification"), F.lit(confidence).alias("confidence"))
    m, a = F.col("months"), F.col("amount")
    bounded = (F.coalesce("min_months", F.lit(0)) != 0) | (F.coalesce("max_months", F.lit(0)) != 0)
    short = m.isNotNull() & (F.coalesce("min_months", F.lit(0)) != 0) & (m < F.col("min_months"))
    verdict = (
        F.when(F.col("c").isNull(), F.when(F.col("required"), r("missing", 0.85)))
        .when(has("must_not_include"), r("non_standard", 0.8))
        .when(some("must_include") & ~has("must_include"), r("non_standard", 0.7))
        .when(F.col("max_percent").isNotNull() & F.exists("pct", lambda p: p > F.col("max_percent")), r("non_standard", 0.9))
        .when(m.isNotNull() & bounded & (F.coalesce("max_months", F.lit(0)) != 0) & (m > F.col("max_months")), r("non_standard", 0.9))
        .when(short & (F.coalesce("fallback_months", F.lit(0)) != 0) & (m >= F.col("fallback_months")), r("fallback", 0.9))
        .when(short, r("non_standard", 0.9))
        .when(m.isNull() & (F.coalesce("min_months", F.lit(0)) != 0), r("non_standard", 0.6))
        .when(a > F.col("max_amount"), r("non_standard", 0.9))
        .when(a < F.col("min_amount"), r("non_standard", 0.9))
        .otherwise(r("standard", 0.8))
    )
    return rows.withColumn("v", verdict).where("v IS NOT NULL").select("doc_id", "rule_key", F.col("v.classification").alias("classification"), F.col("v.confidence").alias("confidence"))


def law_pairs(law_rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """(doc_id, idx, law_rule): keys are exploded into an equi-join, triggers filter what it finds."""
    keyed = law_rules.select("law_rule", "triggers", F.explode("clause_keys").alias("clause_key")).distinct()
    met = clauses.join(_known(keyed), "clause_key")
    low = F.lower(F.concat_ws(" ", "heading", "text"))
    return met.where((F.size("triggers") == 0) | F.exists("triggers", lambda t: F.contains(low, F.lower(t)))).select("doc_id", "idx", "law_rule")


#: Pairs of a partition in which versions are compared.
PAIR_ROWS = 50_000

#: Kinds of differences: how severe and how certain they are.
KINDS = {"amount": ("high", 0.9), "percent": ("high", 0.9), "duration": ("high", 0.9), "date": ("high", 0.9), "tax_code": ("high", 0.9), "number": ("medium", 0.75), "negation": ("medium", 0.6), "figure_words": ("high", 0.95), "missing_counterpart": ("medium", 0.7)}


def differences(pairs: DataFrame, languages: tuple[str, str] = ("vi", "en"), graded: bool = False) -> DataFrame:
    """Values that one language version of a clause has and the other lacks: (pair_id, kind, side, value[, severity, confidence]).

    Values become (pair, kind, value) rows with a signed count; one aggregate gives both directions.
    A figure that contradicts its words within one version, and a negation in one version alone,
    are differences too.  ``pairs`` has pair_id, primary, other and, if known, clause_key: parties
    and signatures need no counterpart.
    """
    # pairs are many and narrow: they are dealt to all cores, and in bounded parts, before Python reads them
    dealt_out = dealt(pairs, "pair_id", part=PAIR_ROWS)
    text = lambda x: x.cast("string")
    period = lambda x: F.when(x["unit"] == "mo", text(x["value"])).otherwise(F.concat_ws(" ", text(x["value"]), x["unit"]))
    # each version is read once, and all rows of a pair come from one list
    normal = dealt_out.withColumns({"p": V.normal_values(F.col("primary")), "o": V.normal_values(F.col("other"))})
    read = normal.withColumns({"primary": F.col("p.text"), "other": F.col("o.text"), "vp": F.col("p.v"), "vo": F.col("o.v")})
    row = lambda kind, value, sign, own=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(sign).alias("n"), (F.lit(None).cast("string") if own is None else own).alias("own"))
    none = F.array().cast("array<struct<kind:string,value:string,n:int,own:string>>")

    def rows(side: str, v: Column, sign: int) -> tuple[Column, Column]:
        kinds = {
            "amount": F.transform(v["amounts"], lambda a: F.format_number(a["value"], 2)), "percent": F.transform(v["percents"], text), "duration": F.transform(v["periods"], period),
            "date": F.transform(v["dates"], lambda x: text(x["value"])), "tax_code": v["tax_codes"], "number": F.transform(v["numbers"], text),
            "negation": F.when(V.negated(F.col(side), languages[sign < 0]), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        }
        named = lambda kind: lambda x: row(kind, x, sign)
        # amounts that contradict their words stand for themselves: they never cancel out
        unequal = F.filter(v["spelled"], lambda x: F.coalesce(x["words_value"] != F.floor(x["figure"]), F.lit(False)))
        return F.concat(*[F.transform(x, named(k)) for k, x in kinds.items()]), F.transform(unequal, lambda x, i: row("figure_words", x["span"], sign, i.cast("string")))

    (one, one_words), (two, two_words) = rows("primary", F.col("vp"), 1), rows("other", F.col("vo"), -1)
    here, there = F.trim("primary") != "", F.trim("other") != ""
    needed = F.coalesce(~F.col("clause_key").isin("parties", "signatures"), F.lit(True)) if "clause_key" in pairs.columns else F.lit(True)
    absent = F.when((here != there) & needed, F.array(row("missing_counterpart", F.lit(""), F.when(here, 1).otherwise(-1)))).otherwise(none)
    every = F.concat(F.when(here & there, F.concat(one, two)).otherwise(none), F.when(there, F.concat(one_words, two_words)).otherwise(none), absent)
    each = read.select("pair_id", F.explode(every).alias("x")).select("pair_id", "x.*").withColumn("own", F.when(F.col("own").isNotNull(), F.concat_ws(" ", text(F.col("n")), "own")))
    uneven = each.groupBy("pair_id", "kind", "value", "own").agg(F.sum("n").alias("n")).where("n <> 0")
    found = uneven.select("pair_id", "kind", F.when(F.col("n") > 0, "primary").otherwise("other").alias("side"), "value")
    if not graded:
        return found
    grade = F.create_map(*[x for k, (s, c) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence")))])
    return found.withColumn("g", F.element_at(grade, F.col("kind"))).select(*found.columns, "g.severity", "g.confidence")


def contract_type(text: Column, types: dict[str, list[str]]) -> Column:
    """First type in order with a hint among the first 3000 characters, else OTHER."""
    head, out = F.lower(F.substring(text, 1, 3000)), F.lit("OTHER")
    for name, hints in reversed(types.items()):
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(head, F.lit(h.lower()))
        out = F.when(hit, name).otherwise(out)
    return out


def chrome(lines: DataFrame, longest: int = 80) -> DataFrame:
    """Line shapes on many pages of a document: (doc_id, shape, n_pages), at least 3 and 30 % of pages."""
    shaped = lines.select("doc_id", "page", T.line_shape(F.col("text")).alias("shape")).where(F.length("shape") <= longest)
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    per = shaped.distinct().groupBy("doc_id", "shape").agg(F.count("*").alias("n_pages"))
    return per.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.3))).select("doc_id", "shape", "n_pages")


def micro_scores(predicted: Column, gold: Column) -> list[Column]:
    """TP, FP, FN and micro precision, recall and F1 as aggregates; 0 where nothing was found."""
    tp, fp, fn = F.count_if(predicted & gold), F.count_if(predicted & ~gold), F.count_if(~predicted & gold)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def word_changes(old: str, new: str, cells: int = 400_000) -> list[tuple[str, str]]:
    """(op, text) runs of a word diff along a longest common subsequence; words and the blanks between them are tokens.

    Where there is a choice the old text's token goes first.  A common blank between two changes
    belongs to both, so a replaced phrase is one deletion and one insertion.  Texts of more than
    ``cells`` pairs of tokens are one replacement.
    """
    a, b = (re.findall(r"\s+|\S+", x) for x in (old, new))
    if len(a) * len(b) > cells:
        return [run for run in (("delete", old), ("insert", new)) if run[1]]
    words = np.array(b, object)
    # ahead[i][j]: tokens that a[i:] and b[j:] have in common in this order
    ahead = [np.zeros(len(b) + 1, int)]
    for token in reversed(a):
        below = ahead[-1]
        best = np.maximum(below[:-1], (words == token) * (below[1:] + 1))
        ahead.append(np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(int))
    ahead.reverse()
    i = j = 0
    steps: list[tuple[str, str]] = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("equal", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or ahead[i + 1][j] == ahead[i][j]):
            steps.append(("delete", a[i]))
            i += 1
        else:
            steps.append(("insert", b[j]))
            j += 1
    change = [op != "equal" for op, _ in steps]
    for k in range(1, len(steps) - 1):
        change[k] |= steps[k][1].isspace() and steps[k - 1][0] != "equal" != steps[k + 1][0]
    runs = []
    for changed, group in itertools.groupby(range(len(steps)), key=change.__getitem__):
        part = [steps[k] for k in group]
        sides = (("delete", "insert"), ("insert", "delete")) if changed else (("equal", ""),)
        texts = [(op, "".join(t for o, t in part if o != other)) for op, other in sides]
        runs += [run for run in texts if run[1]]
    return runs


@F.pandas_udf(ArrayType(StructType().add("op", StringType()).add("text", StringType())))
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": op, "text": t} for op, t in word_changes(a or "", b or "")] for a, b in zip(old, new, strict=True)])
