"""Every catalogued query against its SQL twin, and what SQL cannot express against small fixtures."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clausework.functions import text as T
from clausework.operators import clauses as C
from clausework.operators import findings as R
from clausework.plans import answers, catalog, contracts, records, reprints, texts, written  # noqa: F401  (they add to the catalogue)
from clausework.sources import parsing
from clausework.streaming import limits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    out = [tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, oracle, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_page_lines():
    html = "<html><head><title>An  Act</title><style>x</style></head><body><nav>menu</nav><div class='breadcrumb'>home <p>in</p></div><h1>Part 1</h1><p>One&amp;two <b>bold</b><br>next</p><script>no()</script><footer>f</footer></body></html>"
    assert parsing.page_lines(html) == ("An Act", ["Part 1", "One&two bold", "next"])
    assert parsing.page_lines(None) == ("", [])
    # what is left open inside chrome ends with it; a stray end tag closes nothing
    assert parsing.page_lines("<nav><p>menu<p>more</nav></b><p>text</i> on<td>cell") == ("", ["text on", "cell"])


def test_pages_keep_their_lines(spark, sf):
    rows = parsing.html_blocks(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html").collect()
    assert rows and all(r.text and r.text == " ".join(r.text.split()) for r in rows)


def test_docx_blocks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    merge = lambda v: f'<w:tcPr><w:vMerge w:val="{v}"/></w:tcPr>'
    wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = f"<w:document {w}><w:body>{p('Title', head)}{p('Text')}<w:tbl><w:tr><w:tc>{merge('restart')}{p('a')}</w:tc><w:tc>{p('b')}</w:tc><w:tc>{p('a')}</w:tc></w:tr><w:tr><w:tc>{merge('continue')}{p('')}</w:tc><w:tc>{wide}{p('c')}{p('d')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.createDataFrame([("x.docx", bytearray(raw.getvalue())), ("y.docx", bytearray(b"no"))], "path string, content binary")
    got = [(r.pos, r.text, r.is_heading, r.cells) for r in parsing.docx_blocks(files).orderBy("pos").collect()]
    assert got == [(0, "Title", True, []), (1, "Text", False, []), (2, "a | b | a", False, ["a", "b", "a"]), (3, "a | c\nd", False, ["a", "c\nd"])]
    kinds = files.select(parsing.sniffed(F.col("path"), F.lit("x/y"), F.col("content")).alias("k")).collect()
    assert [r.k for r in kinds] == [parsing.DOCX, None]


def test_headings(spark):
    rows = spark.createDataFrame([("Confidentiality. The party shall",), ("Short heading",), ("a lower start. then text",), ("ends with a dot.",)], "t string")
    got = [tuple(r.s) for r in rows.select(T.heading_split(F.col("t")).alias("s")).collect()]
    assert got == [("Confidentiality", "The party shall"), ("Short heading", ""), ("a lower start. then text", ""), ("", "ends with a dot.")]


def test_keyword_numbers_rule(spark):
    lines = ["Điều 1. Phạm vi", "1. khoản", "ĐIỀU 2. Thời hạn", "Article 3 Term"]
    got = C.segmented(spark.createDataFrame([(1, i, t, False) for i, t in enumerate(lines)], "doc_id bigint, pos int, text string, is_heading boolean")).orderBy("idx").collect()
    assert [(r.number, r.heading, r.text) for r in got] == [("1", "Phạm vi", "1. khoản"), ("2", "Thời hạn", ""), ("3", "Term", "")]


def test_word_changes():
    assert C.word_changes("a b c", "a x c") == [("equal", "a "), ("delete", "b"), ("insert", "x"), ("equal", " c")]
    # a blank between two changes belongs to both
    assert C.word_changes("a b c d", "a x y d") == [("equal", "a "), ("delete", "b c"), ("insert", "x y"), ("equal", " d")]
    assert C.word_changes("for 2 years", "for five (5) years") == [("equal", "for "), ("delete", "2 "), ("insert", "five (5) "), ("equal", "years")]
    assert C.word_changes("", "New clause") == [("insert", "New clause")] and C.word_changes("Old", "") == [("delete", "Old")]
    assert C.word_changes("a b", "c", cells=1) == [("delete", "a b"), ("insert", "c")]
    assert C.word_changes("", "") == []


HITS = [(1, t, i) for i, t in enumerate([0.0, 10.0, 20.0, 61.0, 62.0, 200.0])]
ALLOWED = [True, True, False, True, False, True]


def test_limiter_does_not_count_denied_hits(spark):
    got = limits.limited(spark.createDataFrame(HITS, "key bigint, at double, hit_id bigint"), limit=2).orderBy("hit_id").collect()
    assert [r.allowed for r in got] == ALLOWED


def test_limiter_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(HITS, "key bigint, at double, hit_id bigint").coalesce(1).write.parquet(folder)
    stream = limits.limited_stream(spark.readStream.schema("key bigint, at double, hit_id bigint").parquet(folder), limit=2)
    run = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r.allowed for r in spark.table("limited").orderBy("hit_id").collect()] == ALLOWED


def test_rollup_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    run = limits.rollup(spark.readStream.schema(events.schema).parquet(folder)).writeStream.format("memory").queryName("rolled").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    total = spark.table("rolled").groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert total == events.count()


def test_no_tenant_sees_nothing(spark):
    m = spark.createDataFrame([(1, 7)], "matter_id bigint, tenant_id bigint")
    members = spark.createDataFrame([(1, "screened")], "matter_id bigint, access string")
    assert R.visible(m, members, None).count() == 0 and R.visible(m, members, 7).count() == 0


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructType

    (tmp_path / "u.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n')
    rows = parsing.read_jsonl(spark, str(tmp_path / "u.jsonl"), StructType().add("id", StringType()).add("n", IntegerType())).collect()
    assert sorted(((r.id, r._corrupt) for r in rows), key=repr) == [("a", None), (None, "not json")]


def test_json_lines_name_what_they_cannot_read(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructType

    lines = [f'{{"id": "r{i}", "n": {i}}}' for i in range(400)]
    lines[7], lines[300], lines[301], lines[12] = "not json", '{"id": "x", "n": "word"}', "", '{"id": "half"'
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("[\n" + lines[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many blocks a file
    try:
        rows, errors = parsing.read_jsonl_checked(spark, str(tmp_path), StructType().add("id", StringType()).add("n", IntegerType()))
        got = {(r.path.rsplit("/", 1)[1], r.line): r.n for r in rows.collect()}
        assert got == {("a.jsonl", i + 1): i for i in range(400) if i not in (7, 12, 300, 301)} | {("b.jsonl", 2): 0}
        assert sorted((r.path.rsplit("/", 1)[1], r.line, r.error) for r in errors.collect()) == [("a.jsonl", 8, "no JSON"), ("a.jsonl", 13, "no JSON"), ("a.jsonl", 301, "a field of another type"), ("b.jsonl", 1, "no JSON")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
