"""Values, languages, layouts and routing reasons on small rows; whole tables are in test_catalog."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.functions import values as V
from clausework.operators import bilingual as B
from clausework.operators import clauses as C
from clausework.operators import objects, routing, statutes
from clausework.operators import search as S
from clausework.plans import texts
from clausework.sources import parsing


def column(spark, rows, use):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", use(F.col("t")).alias("v")).orderBy("i").collect()]


def test_periods(spark):
    want = {
        "lasts for four (4) years": [(48, "mo")], "an option of 21 months": [(21, "mo")], "kéo dài 7 năm": [(84, "mo")], "selama 11 bulan dan 3 tahun": [(11, "mo"), (36, "mo")], "ba (03) năm": [(36, "mo")], "mười lăm tháng": [(15, "mo")], "nothing here": [],
        "ký ngày 5 tháng 6 năm 2021": [], "thirty-one months": [(31, "mo")], "ba mươi hai tháng": [(32, "mo")], "Six YEARS and 8 Months": [(72, "mo"), (8, "mo")], "from 2 May 2023": [], "năm năm": [(60, "mo")], "năm tháng": [(5, "mo")], "hai năm nữa": [(24, "mo")],
        "08 (tám) ngày làm việc": [(8, "bd")], "nine (9) working days": [(9, "bd")], "36 giờ": [(36, "h")], "two weeks, 4 days": [(2, "w"), (4, "d")], "3 hari kerja, 2 minggu, 5 jam": [(3, "bd"), (2, "w"), (5, "h")], "0 days, 20000 days": [], "one hundred and ten days": [(110, "d")],
    }
    assert [[(p.value, p.unit) for p in x] for x in column(spark, list(want), V.periods)] == list(want.values())
    assert column(spark, ["2 years, 3 days and 5 months", None], V.durations) == [[24, 5], []]


@pytest.mark.parametrize("written, code", [("VNĐ", "VND"), ("vnd", "VND"), ("đồng", "VND"), ("USD", "USD"), ("us$", "USD"), ("EUR", "EUR"), ("€", "EUR"), ("SGD", "SGD"), ("s$", "SGD"), ("myr", "MYR"), ("RM", "MYR"), ("IDR", "IDR"), ("Rp", "IDR"), ("rp.", "IDR"), ("$", "")])
def test_amounts_read_back(spark, written, code):
    rng = random.Random(written)
    numbers = [rng.randrange(10**k) + rng.choice([0, 0.25, 0.5]) for k in range(1, 10)]
    plain = [f"{n:,.2f}" if n % 1 else f"{n:,.0f}" for n in numbers]
    swapped = [x.translate(str.maketrans(",.", ".,")) for x in plain]
    rows = [form for x in plain for form in (f"pay {written} {x} now", f"pay {written}{x}", f"pay {x} {written}")] + [f"pay {written} {x}; then" for x in swapped]
    got = column(spark, rows, V.amounts)
    assert [[(a.currency, a.value) for a in x] for x in got] == [[(code, float(n))] for n in numbers for _ in range(3)] + [[(code, float(n))] for n in numbers]


def test_percents_dates_and_words(spark):
    assert column(spark, ["15 PER CENT, 6% and 2,75 phần trăm, 3 percent"], V.percents) == [[15.0, 6.0, 2.75, 3.0]]
    days = column(spark, ["ngày 09 tháng 11 năm 2022", "Aug 4, 2021 or 22nd December 2020", "30/02/2023 and 28.02.2023", "7 Bar 2023", "1-9-2019, Sept. 2nd 2018"], V.dates)
    d = datetime.date
    assert [[x.value for x in r] for r in days] == [[d(2022, 11, 9)], [d(2021, 8, 4), d(2020, 12, 22)], [d(2023, 2, 28)], [], [d(2019, 9, 1), d(2018, 9, 2)]]
    words = {"ba trăm bốn mươi mốt triệu": 341_000_000, "two hundred and six thousand": 206_000, "bốn tỉ": 4 * 10**9, "ba mươi nhăm": 35, "bảy trăm lẻ hai": 702, "trăm": 100, "không trăm linh một": 1, "one năm": None, "": None, None: None, "one " * 50: None}
    assert column(spark, list(words), V.words_to_int) == list(words.values())
    spelled = column(spark, ["thưởng 300.000.000 đồng (Bằng chữ: Ba trăm triệu đồng)", "EUR 9 (in words: eight euros), 4 (as above)", "12 (twelve and a bit)"], V.figures_with_words)
    assert [[(x.figure, x.words_value, x.words) for x in r] for r in spelled] == [[(3e8, 3 * 10**8, "Ba trăm triệu đồng")], [(9.0, 8, "eight euros")], [(12.0, None, "twelve and a bit")]]
    assert column(spark, ["gồm 06 trang", "2) signed in 5 copies (b) of 20 %", "Khoản 3\n9 items", "ends 3. 1,500 1.2.3 4.", "code 0123456789-004"], V.standalone_numbers) == [[6], [5], [9], [1], []]
    assert column(spark, ["MST 0312345678-002, 0312345679; 12345678901"], V.tax_codes) == [["0312345678-002", "0312345679"]]


def test_long_texts_are_read_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        found = V.Walk("pay 5 copies, one two three (see below 7 hai mươi USD 3 " * n).found()
        assert len(found["amounts"]) == n
        return time.perf_counter() - began

    seconds(50)
    assert seconds(4000) < 12 * max(seconds(1000), 0.01)


def english(n):
    units = [w for w, _ in sorted(V.EN_UNITS.items(), key=lambda x: x[1])]
    if n < 20:
        return units[n]
    if n < 100:
        return units[18 + n // 10] + ("-" + units[n % 10] if n % 10 else "")
    if n < 1000:
        return units[n // 100] + " hundred" + (" and " + english(n % 100) if n % 100 else "")
    scale, word = (10**6, "million") if n >= 10**6 else (1000, "thousand")
    return english(n // scale) + f" {word}" + (" " + english(n % scale) if n % scale else "")


def test_english_numbers_read_back(spark):
    random.seed(1)
    numbers = list(range(1, 1300, 7)) + [random.randrange(10**9) for _ in range(50)]
    assert column(spark, [english(n) for n in numbers], V.words_to_int) == numbers


KINDS = [
    ("kéo dài ba (03) năm", "lasts four (4) years", {"duration"}), ("thưởng 50.000.000 đồng (Bằng chữ: Sáu mươi triệu đồng)", "a bonus of VND 50,000,000", {"figure_words"}), ("giá 7.000.000 VND", "price VND 8,000,000", {"amount"}),
    ("lãi 3% mỗi tháng", "interest of 4% a month", {"percent"}), ("từ ngày 05 tháng 06 năm 2023", "from 6 June 2023", {"date"}), ("sau 10 ngày", "after 11 days", {"duration"}), ("trong 12 giờ", "within 13 hours", {"duration"}),
    ("07 ngày làm việc", "7 days", {"duration"}), ("sau 08 (tám) ngày làm việc", "after eight (8) working days", set()), ("gồm 06 trang", "of 5 pages", {"number"}), ("Bên A không chịu trách nhiệm.", "Party A is liable.", {"negation"}),
    ("Mã số thuế: 0312345678", "Tax code: 0312345679", {"tax_code"}), ("Bên A giữ bản gốc.", "", {"missing_counterpart"}), ("Hai bên cùng ký", None, {"missing_counterpart"}), ("", "", set()),
]


def test_each_kind_of_difference(spark):
    pairs = spark.createDataFrame([(i, p, o, "other") for i, (p, o, _) in enumerate(KINDS)] + [(90, "Bên A", "", "parties")], "pair_id int, primary string, other string, clause_key string")
    rows = C.differences(pairs, graded=True).collect()
    got = {i: {r.kind for r in rows if r.pair_id == i} for i in [*range(len(KINDS)), 90]}
    assert got == {i: k for i, (_, _, k) in enumerate(KINDS)} | {90: set()}
    assert {(r.kind, r.severity, r.confidence) for r in rows} == {(k, *C.KINDS[k]) for _, _, ks in KINDS for k in ks}


def test_languages_of_pieces_and_blocks(spark):
    assert column(spark, ["Bên Nhận phải giữ bí mật thông tin.", "The Recipient shall keep it confidential.", "Definitions", "12", ""], T.short_language) == ["vi", "en", "en", None, None]
    got = column(spark, ["Điều 1. Định nghĩa / Definitions", "Bên nhận phải giữ bí mật. The Recipient shall keep it confidential.", "Giao hàng 30/06"], lambda c: B.split_block(c, "vi", "en"))
    assert [tuple(r) for r in got] == [("Điều 1. Định nghĩa", "Definitions"), ("Bên nhận phải giữ bí mật.", "The Recipient shall keep it confidential."), ("Giao hàng 30/06", "")]
    mixed = "Hợp đồng này được lập giữa các bên. This agreement and the party shall agree to the terms of the agreement"
    assert column(spark, [mixed, "Perjanjian ini dan pihak yang", "Fasal ini hendaklah", ""], T.contract_languages) == [["en", "vi"], ["id"], ["ms"], []]


def test_clauses_carry_their_counterpart(spark):
    blocks = [("Lời mở đầu", "Preface", False), ("Điều 1. Bảo mật: giữ kín", "Article 1. Secrecy: keep it", False), ("thêm", "more", False), ("Điều 2. Thời hạn", "Article 2. Term", False)]
    df = spark.createDataFrame([(1, i, t, h, a) for i, (t, a, h) in enumerate(blocks)], "doc_id bigint, pos int, text string, is_heading boolean, alt string")
    got = [(r.number, r.heading, r.heading_alt, r.text_alt) for r in C.segmented(df).orderBy("idx").collect()]
    assert got == [(None, "Preamble", "", "Preface"), ("1", "Bảo mật", "Secrecy", "keep it\nmore"), ("2", "Thời hạn", "Term", "")]


def test_headings_start_in_upper_case(spark):
    assert [r[0] for r in column(spark, ["(1) Foo. bar.", "Foo. bar."], T.heading_split)] == ["", "Foo"]


def test_accents_of_all_letters(spark):
    assert column(spark, ["Điều khoản bảo mật, thế và ở Ý", "Ünïcødé"], T.unaccented) == ["dieu khoan bao mat, the va o y", "unicøde"]


def test_quotes_may_cut_words(spark):
    units = spark.createDataFrame([(1, "He repays all amounts due  today"), (2, "pays all amounts"), (3, "nothing")], "id int, text string")
    passages = {1: "pays all amoun", 2: "amounts DUE", 3: "ay", 4: "all amounts due tomorrow", 5: "", 6: None}
    got = {tuple(r) for r in S.quoted(units, spark.createDataFrame(list(passages.items()), "pid int, text string")).collect()}
    assert got == {(1, 1), (2, 1), (1, 2), (1, 3), (2, 3)}


def test_small_text_functions(spark):
    assert column(spark, ["min_duration_months", ""], T.humanised) == ["Min duration months", ""]
    assert column(spark, ["Short. A \"long\" sentence ends here; the rest", " x. ", None], T.first_sentence) == ["Short. A 'long' sentence ends here", "x", ""]
    assert column(spark, ["1234.0", "1234.5"], lambda c: T.grouped_thousands(c.cast("double"))) == ["1,234", "1,234.50"]
    assert column(spark, ["Điều 301", "s 75"], lambda c: T.pinpoint(c, F.lit("Act"))) == ["Điều 301 Act", "Act, s 75"]
    assert column(spark, ["SG/ACT-1", "sg/act", "SGP/X"], parsing.is_instrument_id) == [True, False, False]


def test_sealed_objects(spark):
    df = spark.createDataFrame([("same text", "a"), ("same text", "a")], "t string, place string")
    key = F.lit("0123456789abcdef").cast("binary")
    both = df.select(objects.sealed(F.col("t").cast("binary"), key, F.col("place")).alias("c"), "place").persist()
    assert both.select("c").distinct().count() == 2  # each with its own nonce
    opened = both.select(objects.opened(F.col("c"), key, F.col("place")).cast("string").alias("a"), objects.opened(F.col("c"), key, F.lit("b")).alias("b")).collect()
    assert [tuple(r) for r in opened] == [("same text", None)] * 2
    both.unpersist()


def test_legacy_fonts(spark):
    assert column(spark, ["Lu©t sè 99 §iÒu 1. Ph¹m vi ®iÒu chØnh vµ ®èi t\u00ad­îng", "Điều 1. Phạm vi điều chỉnh", "plain"], statutes.legacy_encoded) == [True, False, False]


@pytest.mark.parametrize("change, reason", [
    ({"tenant_deny": ["a"]}, "tenant_provider_denied"), ({"tenant_allow": ["b"]}, "tenant_provider_not_allowed"), ({"home_region": "SG", "offshore_allowed": False}, "offshore_processing_denied"), ({"billing": "byo", "byo_allowed": False}, "byo_disabled"), ({"billing": "proxy", "proxy_allowed": False}, "proxy_not_enabled"), ({"home_region": "SG", "offshore_allowed": True}, None),
])
def test_tenant_reasons(spark, change, reason):
    endpoint = spark.createDataFrame(texts.ENDPOINTS[1:2], texts.ENDPOINT_SCHEMA)
    if billing := change.pop("billing", None):
        endpoint = endpoint.withColumn("billing", F.lit(billing))
    request = spark.createDataFrame(texts.REQUESTS[:1], texts.REQUEST_SCHEMA)
    for name, value in change.items():
        request = request.withColumn(name, F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value))
    assert [r.reason for r in routing.plan(request, endpoint).collect()] == [reason]


def test_policy_of_a_matter_under_an_override(spark):
    schema = "matter_id int, deny array<string>, allow array<string>, residency string"
    matters = spark.createDataFrame([(1, ["b"], None, "SG"), (2, None, ["x"], None), (3, ["c"], ["y"], None)], schema)
    overrides = spark.createDataFrame([(1, ["a", "b"], ["z"], "US"), (2, None, None, "VN")], schema)
    got = {r.matter_id: (r.deny, r.allow, r.residency) for r in routing.merged_policy(matters, overrides).collect()}
    assert got == {1: (["a", "b"], ["z"], "SG"), 2: ([], ["x"], "VN"), 3: (["c"], ["y"], None)}


def test_lower_tiers_go_before_higher_ones(spark):
    rows = [(f"e{t}", "self", ["self"], t, "plan", ["*"], ["json"], langs, 10000, price, price, True, i) for i, (t, langs, price) in enumerate([("T2", ["en"], 0.0), ("T0", ["en"], 0.0), ("T1", ["fr"], 0.0)])]
    rows.append(("e1b", "self", ["self"], "T1", "plan", ["*"], ["json"], [], 10000, 5.0, 5.0, True, 9))
    got = routing.plan(spark.createDataFrame(texts.REQUESTS[:1], texts.REQUEST_SCHEMA), spark.createDataFrame(rows, texts.ENDPOINT_SCHEMA)).orderBy("rank").collect()
    assert [r.endpoint_id for r in got] == ["e1b", "eT1", "eT0", "eT2"]


def test_clauses_stay_in_partitions_of_bounded_size(spark, monkeypatch):
    """Labels, rules and law pairs of ten times the blocks take ten times the partitions, not larger ones."""
    from clausework.sources import tables

    monkeypatch.setattr(tables, "PART_ROWS", 500)
    blocks = spark.range(500).selectExpr("id AS doc_id", "explode(array(struct(0 AS pos, '1. Term. Ten months.' AS text), struct(1 AS pos, '2. Liability: none' AS text))) AS b").selectExpr("doc_id", "b.*", "false AS is_heading")
    hints = spark.createDataFrame([("term", 0, "term"), ("liability", 1, "liability")], "key string, ord int, hint string")

    def most(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    clauses = C.segmented(blocks.union(blocks.selectExpr("doc_id + 500", "pos", "text", "is_heading")))
    assert clauses.count() == 2000 and most(clauses) <= 1000
    labels = C.labelled(clauses, hints)
    assert most(labels) <= 1000
    assert {(r.clause_key, r.confidence, r["count"]) for r in labels.groupBy("clause_key", "confidence").count().collect()} == {("term", 0.6, 1000), ("liability", 0.91, 1000)}


def test_rules_on_absent_clauses_keyless_rules_and_repeated_documents(spark):
    rules = spark.createDataFrame([("a", "term", True, None, None, None, None, None, None, None, None), ("b", "law", True, None, None, None, None, None, None, None, None), ("c", "law", False, None, None, None, None, None, None, None, None), ("d", None, True, None, None, None, None, None, None, None, None)], texts.RULE_SCHEMA)
    clauses = spark.createDataFrame([(1, 0, "Term", "x", "term"), (1, 1, "Term", "y", "term"), (1, 2, "None", "z", None)], "doc_id bigint, idx bigint, heading string, text string, clause_key string")
    docs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id bigint")
    got = sorted((str(r.doc_id), r.rule_key, r.classification) for r in C.evaluated(rules, clauses, docs).collect())
    lacks = [("a", "missing"), ("b", "missing"), ("d", "missing")]
    assert got == sorted([("1", "a", "standard"), ("1", "b", "missing"), ("1", "d", "missing"), *[("2", k, v) for k, v in lacks * 2], *[("None", k, v) for k, v in lacks]])


def test_versions_are_compared_on_all_cores(spark, tmp_path):
    """One small file of many narrow pairs is no single Python task, and texts are read in normal form."""
    path = str(tmp_path / "pairs")
    spark.range(20_000).selectExpr("id AS pair_id", "'Price VND 5' AS primary", "'Giá 5 VND' AS other").coalesce(1).write.parquet(path)
    read = C.differences(spark.read.parquet(path))
    assert read.count() == 0
    spark.sparkContext.setJobGroup("pairs", "")
    read.count()
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("pairs") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4
    found = C.differences(spark.createDataFrame([(1, "không áp dụng 5%", "5%")], "pair_id bigint, primary string, other string")).collect()
    assert [(r.kind, r.side) for r in found] == [("negation", "primary")]
    assert [r.v for r in spark.createDataFrame([("é",), (None,)], "t string").select(V.normal_values("t")["text"].alias("v")).collect()] == ["é", ""]


def test_scores_lie_in_partitions_of_few_units(spark, monkeypatch):
    monkeypatch.setattr(S, "UNITS", 100)
    units = spark.range(1000).selectExpr("id", "'payment payment within days' AS text")
    scores = S._scores(units, spark.createDataFrame([(1, "payment days"), (2, "days")], "qid bigint, text string"), lambda c: c)
    assert {(r.qid, r.score, r["count"]) for r in scores.groupBy("qid", "score").count().collect()} == {(1, 0.3, 1000), (2, 0.1, 1000)}
    assert scores.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 400
