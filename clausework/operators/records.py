"""Records of a review: state changes as new rows, checks of input, and rows for memos and listings.

Tables are never changed in place: each function gives the rows that hold afterwards, or what is wrong with a
request, so a run that is repeated gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators.findings import severity_rank

# Reasons for rejecting a finding, actions and what they lead to, who may override a check.
REASONS = ["wrong_clause_type", "playbook_misapplied", "law_incorrect", "law_outdated", "too_aggressive", "too_lenient", "drafting_style", "missing_issue", "not_relevant_to_client", "other"]
ACTIONS = {"accept": "accepted", "edit": "edited", "reject": "rejected", "defer": "deferred"}
# What findings on two versions say, in both languages.
LANGUAGES = {"en": {"vi": "Vietnamese", "en": "English"}, "vi": {"vi": "tiếng Việt", "en": "tiếng Anh"}}
KINDS = {"en": {"amount": "Amounts", "percent": "Percentages", "duration": "Durations", "date": "Dates", "tax_code": "Tax codes", "number": "Numbers"}, "vi": {"amount": "Số tiền", "percent": "Tỷ lệ", "duration": "Thời hạn", "date": "Ngày", "tax_code": "Mã số thuế", "number": "Con số"}}
SAYINGS = {
    "en": {"differ": "%s differ between versions (%s).", "only": "%s only: %s", "prevails": "The %s version prevails under the contract's language clause; the other version should be aligned to it.", "open": "The contract does not say which language version prevails."},
    "vi": {"differ": "%s khác nhau giữa hai bản (%s).", "only": "chỉ bản %s: %s", "prevails": "Theo điều khoản ngôn ngữ, bản %s được ưu tiên áp dụng; bản còn lại cần được chỉnh cho thống nhất.", "open": "Hợp đồng không quy định bản ngôn ngữ nào được ưu tiên."},
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), key)


def replaced(old: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """``old`` with all rows of the keys in ``touched`` (by default those of ``new``) replaced by ``new``.

    ``touched`` may name keys that have no rows any more.
    """
    gone = (new if touched is None else touched).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def members_after(members: DataFrame, requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, refused) after ``requests(matter_id, user_id, access)`` replaced the members of their matters.

    A request with an unknown user is refused as a whole: (matter_id, unknown users).
    """
    unknown = requests.join(users.select("user_id").distinct(), "user_id", "left_anti").groupBy("matter_id").agg(F.array_sort(F.collect_set("user_id")).alias("unknown"))
    good = requests.join(unknown.select("matter_id"), "matter_id", "left_anti")
    return replaced(members, good, ["matter_id"]), unknown


def marked_verified(sources: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, found): sources with the reviewer and time of ``marks(id, by, at)``, and whether each mark met a source."""
    last = marks.groupBy("id").agg(F.max_by(F.struct("by", "at"), F.struct("at", "by")).alias("m"))
    met = sources.join(last, "id", "left")
    hit = F.col("m").isNotNull()
    after = met.select("id", *[c for c in sources.columns if c not in ("id", "review_status", "verified_by", "verified_at")], F.when(hit, "verified").otherwise(F.col("review_status")).alias("review_status"), F.when(hit, F.col("m.by")).otherwise(F.col("verified_by")).alias("verified_by"), F.when(hit, F.col("m.at")).otherwise(F.col("verified_at")).alias("verified_at"))
    known = sources.select("id", F.lit(True).alias("found")).distinct()
    return after, marks.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def activated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Versions after new ones came in: (key, version, body, active). A new one gets the next number and is the active one."""
    fresh = Window.partitionBy(key).orderBy("created_at", "body")
    most = old.groupBy(key).agg(F.max("version").alias("_v"))
    added = new.withColumn("_n", F.row_number().over(fresh)).join(most, key, "left").select(key, (F.coalesce("_v", F.lit(0)) + F.col("_n")).cast("bigint").alias("version"), "body")
    rows = old.select(key, F.col("version").cast("bigint").alias("version"), "body", "active", F.lit(False).alias("_new")).union(added.select(key, "version", "body", F.lit(True), F.lit(True)))
    mine = Window.partitionBy(key)
    some = F.max("_new").over(mine)
    newest = F.col("version") == F.max("version").over(mine)
    return rows.select(key, "version", "body", F.when(some, newest).otherwise(F.col("active")).alias("active"))


def disposition_problem(action: Column, edited_text: Column, reason_code: Column) -> Column:
    """Why a decision on a finding is refused, or null: an edit needs a text, a rejection a known reason."""
    return (
        F.when(~F.coalesce(action.isin(list(ACTIONS)), F.lit(False)), "unknown_action")
        .when((action == "edit") & (T.squeezed_line(F.coalesce(edited_text, F.lit(""))) == ""), "edited_text_required")
        .when((action == "reject") & reason_code.isNull(), "reason_code_required")
        .when(reason_code.isNotNull() & ~reason_code.isin(REASONS), "unknown_reason_code")
    )


def dispositioned(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``findings(id, disposition)`` after ``decisions(id, at, action, edited_text, reason_code)``: the last good one counts."""
    good = decisions.where(disposition_problem(F.col("action"), F.col("edited_text"), F.col("reason_code")).isNull())
    last = good.groupBy("id").agg(F.max_by(F.struct("action", "edited_text"), F.struct("at", "action")).alias("d"))
    now = _lookup(ACTIONS, F.col("d.action"))
    return findings.join(last, "id", "left").select("id", F.col("disposition").alias("previous"), F.when(F.col("d").isNotNull(), now).otherwise(F.col("disposition")).alias("disposition"), F.when(F.col("d.action") == "edit", F.col("d.edited_text")).alias("edited_text"))


def memo_rows(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """(run_id, position, clause, severity, text, disposition, sources) of a memo's table of issues.

    Rejected findings and information stay out; a law finding that was edited shows the edited text. Sources read
    'pinpoint (status)' or 'pinpoint (status, overridden)'.
    """
    shown = findings.where((F.col("severity") != "info") & ~F.coalesce(F.col("disposition") == "rejected", F.lit(False)))
    note = F.concat(F.coalesce("pinpoint", "source_unit_id"), F.lit(" ("), "status", F.when(F.coalesce("override_reason", F.lit("")) != "", ", overridden").otherwise(""), F.lit(")"))
    told = citations.groupBy("finding_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", note.alias("n")))), lambda x: x["n"]), "; ").alias("sources"))
    rows = shown.join(told, shown.id == told.finding_id, "left")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(severity_rank(), "clause_key", "id"))
    text = F.when((F.col("disposition") == "edited") & (F.col("kind") == "law"), F.col("edited_text")).otherwise(F.col("summary"))
    return rows.select("run_id", place.cast("bigint").alias("position"), F.replace("clause_key", F.lit("_"), F.lit(" ")).alias("clause"), "severity", text.alias("text"), F.coalesce("disposition", F.lit("")).alias("disposition"), F.coalesce("sources", F.lit("")).alias("sources"))


def export_rows(files: DataFrame) -> DataFrame:
    """(run_id, format, bytes, sha256) of ``files(run_id, format, content)``."""
    return files.select("run_id", "format", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))


def grounded(differences: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Reported differences (pair_id, summary, primary_span, other_span) whose spans both stand in their clause's versions and that are not among ``known(pair_id, summary)``."""
    both = differences.join(pairs.select("pair_id", F.col("primary").alias("p"), F.col("other").alias("o")), "pair_id")
    stands = lambda text, span: F.contains(T.canonical(F.coalesce(text, F.lit(""))), T.canonical(F.coalesce(span, F.lit(""))))
    held = both.where(stands(F.col("p"), F.col("primary_span")) & stands(F.col("o"), F.col("other_span"))).drop("p", "o")
    return held.join(known.select("pair_id", "summary").distinct(), ["pair_id", "summary"], "left_anti")


def version_findings(differences: DataFrame, prevailing: DataFrame, pairs: DataFrame, language: str = "en", versions: tuple[str, str] = ("vi", "en")) -> DataFrame:
    """(pair_id, kind, summary, rationale, primary_span, other_span, severity, confidence) of graded differences.

    Values of one kind in one clause are one finding that names what each version alone has; the rationale says
    which version prevails. ``prevailing(doc_id, by_primary, by_other)``, ``pairs(pair_id, doc_id)``.
    """
    say, names = SAYINGS[language], LANGUAGES[language]
    held = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("value")))), ", ").alias(side)
    per = differences.where(F.col("kind").isin(list(KINDS["en"]))).groupBy("pair_id", "kind").agg(held("primary"), held("other"), F.first("severity").alias("severity"), F.first("confidence").alias("confidence"))
    only = lambda side, version: F.when(F.col(side) != "", F.format_string(say["only"], F.lit(names[version]), F.col(side)))
    parts = F.array_join(F.array_compact(F.array(only("primary", versions[0]), only("other", versions[1]))), "; ")
    met = per.join(pairs.select("pair_id", "doc_id"), "pair_id").join(prevailing.select("doc_id", F.coalesce("by_primary", "by_other").alias("p")), "doc_id", "left")
    why = F.when(F.col("p").isNotNull(), F.format_string(say["prevails"], _lookup(names, F.col("p")))).otherwise(say["open"])
    return met.select("pair_id", "kind", F.format_string(say["differ"], _lookup(KINDS[language], F.col("kind")), parts).alias("summary"), why.alias("rationale"), F.col("primary").alias("primary_span"), F.col("other").alias("other_span"), "severity", "confidence")


def labelled_spend(spend: DataFrame, visible: DataFrame, label: str = "walled") -> DataFrame:
    """Spend by matter with the matter's number where it may be seen, else a label; unseen ones are one row."""
    met = spend.join(visible.select("matter", "number"), "matter", "left")
    return met.groupBy(F.coalesce("number", F.lit(label)).alias("number")).agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))


def pinpointed(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, found, pinpoint, text) of the units asked for."""
    held = units.select("unit_id", "path", "title", "text").dropDuplicates(["unit_id"])
    met = wanted.select("unit_id").distinct().join(held, "unit_id", "left")
    return met.select("unit_id", F.col("path").isNotNull().alias("found"), F.when(F.col("path").isNotNull(), T.pinpoint(F.col("path"), F.col("title"))).alias("pinpoint"), "text")


def idp_of(emails: DataFrame, domains: DataFrame, idps: DataFrame) -> DataFrame:
    """(email, idp_id): the enabled identity provider of an address's domain, ignoring case."""
    asked = emails.select("email", F.lower(F.substring_index("email", "@", -1)).alias("domain"))
    held = domains.select(F.lower("domain").alias("domain"), "idp_id").join(idps.where("enabled").select("idp_id"), "idp_id")
    first = held.groupBy("domain").agg(F.min("idp_id").alias("idp_id"))
    return asked.join(first, "domain").where(F.contains("email", F.lit("@"))).select("email", "idp_id")


def outcomes(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """(request_id, outcome, endpoint_id, tried) of planned requests.

    ``requests(request_id, endpoint_id, reason, rank)`` is a plan, ``calls(request_id, endpoint_id, ok)`` what the
    endpoints said. The first that answers in order of rank is taken: ok; none left in the plan is no_candidate, or
    budget_exceeded if that alone kept one out; all failed is all_failed.
    """
    left = F.col("reason").isNull()
    # only endpoints left in the plan that answered are joined
    answered = requests.where(left).select("request_id", "endpoint_id", "rank").join(calls.where("ok").select("request_id", "endpoint_id"), ["request_id", "endpoint_id"])
    taken = answered.groupBy("request_id").agg(F.min(F.struct("rank", "endpoint_id")).alias("t"))
    per = requests.groupBy("request_id").agg(F.count_if(left).alias("n"), F.count_if(F.col("reason") == "budget_exceeded").alias("dear")).join(taken, "request_id", "left")
    outcome = F.when(F.col("t").isNotNull(), "ok").when(F.col("n") > 0, "all_failed").when(F.col("dear") > 0, "budget_exceeded").otherwise("no_candidate")
    return per.select("request_id", outcome.alias("outcome"), F.col("t.endpoint_id").alias("endpoint_id"), F.when(F.col("t").isNotNull(), F.col("t.rank")).otherwise(F.col("n")).cast("bigint").alias("tried"))


def changed_choices(before: DataFrame, after: DataFrame) -> DataFrame:
    """(request_id, before, after) where two plans would take different endpoints first: a dry run of a policy."""
    first = lambda plan, name: plan.groupBy("request_id").agg(F.min_by("endpoint_id", F.when(F.col("reason").isNull(), F.col("rank"))).alias(name))
    both = first(before, "before").join(first(after, "after"), "request_id", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
