"""Named queries on texts, search, clauses, rules and routing; small fixtures stand in for contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.functions import values as V
from clausework.operators import clauses as C
from clausework.operators import objects, routing
from clausework.operators import search as S
from clausework.plans.catalog import query, table
from clausework.sources import parsing
from clausework.sources.tables import PART_ROWS, dealt
from clausework.streaming import limits

SP = r"[\x09-\x0D\x{85}\p{Z}]+"
BREAK = r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
LINES = f"SELECT doc_id, i AS pos, l AS text FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda x: regexp_replace(x, '^{SP}|{SP}$', '', 'g')) AS ls FROM documents)) WHERE l <> '')"
STOP_WORDS = "the,and,for,that,this,with,shall,any,are,not,under,such,all,may,its,which,from,been,has,have,each,other,into,of,to,in,on,or,by,be,an,as,at,is,it,if,no,và,của,các,có,được,cho,là,với,theo,trong,này,những,một,khi,thì,để,đã,sẽ,tại,về,do,từ,đến,hoặc,nếu,mà,như,trên,bị,vào,ra,phải,không"
STOP = f"string_split('{STOP_WORDS}', ',')"
TOKENS = r"[\p{L}\p{N}]{2,}"
TERMS = lambda source, key, text="text": f"(SELECT {key}, w, row_number() OVER (PARTITION BY {key} ORDER BY min(p)) AS r FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '{TOKENS}') AS ws FROM {source})) WHERE NOT list_contains({STOP}, w) GROUP BY {key}, w)"
LEXICAL = f"""q AS (SELECT item_id AS qid, w FROM {TERMS("benchmark", "item_id")} WHERE r <= 24),
tf AS (SELECT doc_id AS id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKENS}')) AS w FROM documents) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
sc AS (SELECT qid, id, round(sum(tf) * 0.1, 6) AS score FROM tf JOIN q USING (w) GROUP BY 1, 2),
lex AS (SELECT qid, id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 20)"""
DENSE = """den AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 20)"""


def units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(LINES)
def doc_lines_nonblank(spark, sf_dir):
    return parsing.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT doc_id, sha256(lower(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{SP}', ' ', 'g')))) AS version_hash FROM documents")
def norm_text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.canonical(T.nfc(F.coalesce("text", F.lit("")))), 256).alias("version_hash"))


@query(rf"WITH l AS ({LINES}) SELECT doc_id, CAST(sum(length(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS BIGINT) AS placed, CAST(max(b) AS BIGINT) AS body FROM l JOIN (SELECT doc_id, length(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS b FROM documents) USING (doc_id) GROUP BY doc_id")
def comparison_key_accounting(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    size = lambda c: F.length(T.comparison_key(c)).cast("bigint")
    placed = F.aggregate(T.lines(F.col("text")), F.lit(0).cast("bigint"), lambda n, x: n + size(x))
    return d.where(F.size(T.lines(F.col("text"))) > 0).select("doc_id", placed.alias("placed"), size(F.col("text")).alias("body"))


@query(f"""WITH l AS (SELECT conv_id AS doc_id, turn AS page, regexp_replace(lower(trim(regexp_replace(x, '{SP}', ' ', 'g'))), '[0-9]', '#', 'g') AS shape FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.] ')) AS x FROM conversations)),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1), s AS (SELECT doc_id, shape, count(DISTINCT page) AS n_pages FROM l WHERE length(shape) <= 80 GROUP BY 1, 2)
SELECT doc_id, shape, n_pages FROM s JOIN n USING (doc_id) WHERE n_pages >= greatest(3, ceil(pages * 0.3))""")
def line_shape_chrome(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.explode(F.split("text", "[.] ")).alias("text"))
    return C.chrome(lines)


@query(f"SELECT doc_id, count(*) AS n_terms, string_agg(w, ' ' ORDER BY r) FILTER (r <= 24) AS terms FROM {TERMS('documents', 'doc_id')} GROUP BY doc_id")
def search_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.search_terms(F.col("text")).alias("t"))
    return d.where(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join(F.slice("t", 1, 24), " ").alias("terms"))


_WORDS = {"en": "the and of to in on that with it re", "fr": "le la les et de que un en dans qui", "de": "der die und ich nicht ein das mit für den", "es": "el los las y que una con por para del"}
_SHARES = ", ".join(f"len(list_filter(w, lambda x: list_contains({own.split()!r}, x))) / greatest(len(w), 1) AS s{i}" for i, own in enumerate(_WORDS.values()))
_BEST = "CASE " + " ".join(f"WHEN {' AND '.join(f's{i} >= s{j}' for j in range(4) if j != i)} THEN '{lang}'" for i, lang in enumerate(_WORDS)) + " END"


@query(rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS w FROM documents), s AS (SELECT doc_id, {_SHARES} FROM w) SELECT doc_id, CASE WHEN greatest(s0, s1, s2, s3) >= 0.02 THEN {_BEST} END AS language FROM s")
def document_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_max(T.language_scores(F.col("text"))).alias("b"))
    return d.select("doc_id", F.when(F.col("b.share") >= 0.02, F.col("b.language")).alias("language"))


@query(rf"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x09-\x0D ]+([\p{{Lu}}"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^{SP}|{SP}$', '', 'g')), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, CAST(len(s) AS BIGINT) AS n_claims, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM s""")
def sentence_claims(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("s"))
    return c.select("conv_id", "turn", F.size("s").cast("bigint").alias("n_claims"), F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("n_chars"))


@query(f"WITH {LEXICAL} SELECT qid, id, score, rank FROM lex")
def lexical_search(spark, sf_dir):
    return S.lexical(units(spark, sf_dir), passages(spark, sf_dir))


@query(f"""WITH {LEXICAL}, ct AS (SELECT item_id AS qid, w FROM {TERMS("benchmark", "item_id")}), ut AS (SELECT doc_id AS id, w FROM {TERMS("(SELECT * FROM documents WHERE doc_id IN (SELECT id FROM lex))", "doc_id")}),
nc AS (SELECT qid, count(*) AS c FROM ct GROUP BY 1), nu AS (SELECT id, count(*) AS u FROM ut GROUP BY 1), o AS (SELECT qid, id, count(*) AS o FROM ct JOIN ut USING (w) GROUP BY 1, 2),
r AS (SELECT qid, id, rank AS before, round(coalesce(o, 0) / (sqrt(c) * sqrt(greatest(u, 1))) + score, 6) AS score FROM lex JOIN nc USING (qid) JOIN nu USING (id) LEFT JOIN o USING (qid, id))
SELECT * FROM (SELECT qid, id, before, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM r) WHERE rank <= 5""")
def rerank_overlap(spark, sf_dir):
    u, q = units(spark, sf_dir), passages(spark, sf_dir)
    return S.reranked(S.lexical(u, q), u, q, 5)


def _dense(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.dense(v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), 20)


@query(f"WITH {DENSE} SELECT * FROM den")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


@query(f"WITH {DENSE} SELECT * FROM den")
def dense_index(spark, sf_dir):
    """The same by the partitioned index."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.indexed(v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), 20)


@query(f"""WITH {LEXICAL}, {DENSE}, f AS (SELECT qid, id, lex.rank AS a, den.rank AS b, round(coalesce(1.0::DOUBLE / (59 + lex.rank), 0) + coalesce(1.0::DOUBLE / (59 + den.rank), 0), 8) AS score FROM (SELECT * FROM lex WHERE qid % 20 = 0) lex FULL JOIN den USING (qid, id))
SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(a, 1073741824), coalesce(b, 1073741824), id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    return S.fused(S.lexical(units(spark, sf_dir), passages(spark, sf_dir)).where("qid % 20 = 0"), _dense(spark, sf_dir), 10)


@query("SELECT doc_id, contains(replace(strip_accents(lower(text)), 'đ', 'd'), 'etr') AS hit FROM documents WHERE text IS NOT NULL")
def accent_insensitive_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.contains(T.unaccented(F.col("text")), F.lit("etr")).alias("hit"))


@query(f"WITH d AS (SELECT doc_id AS id, lower(trim(regexp_replace(coalesce(text, ''), '{SP}', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id AS pid, lower(trim(regexp_replace(coalesce(text, ''), '{SP}', ' ', 'g'))) AS p FROM benchmark) SELECT id, pid FROM d JOIN b ON p <> '' AND contains(t, p)")
def quote_fidelity(spark, sf_dir):
    return S.quoted(units(spark, sf_dir), passages(spark, sf_dir).withColumnRenamed("qid", "pid"))


@query(f"""WITH t AS (SELECT conv_id, turn, w FROM {TERMS("conversations", "conv_id, turn")}),
n AS (SELECT a.conv_id, a.turn, count(*) AS n, count(b.w) AS o FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CASE WHEN n IS NULL THEN 'not_found' WHEN o / n >= 0.6 THEN 'supported' WHEN o / n >= 0.3 THEN 'partial' ELSE 'not_found' END AS status, CAST(round(coalesce(o / n, 0), 3) AS DOUBLE) AS score
FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn""")
def lexical_support_turns(spark, sf_dir):
    """Each turn judged against the next one; ``lexical_support`` has the first of each conversation alone, as its SQL."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("unit"))
    both = c.select("conv_id", "turn", F.col("text").alias("claim")).join(after, ["conv_id", "turn"])
    return both.select("conv_id", "turn", S.support(F.col("claim"), F.col("unit")).alias("r")).select("conv_id", "turn", "r.status", "r.score")


@query("""WITH j AS (SELECT n_chars > 1500 AS p, quality = 1 AS g, lang FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM n""")
def micro_prf(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return j.groupBy("lang").agg(*C.micro_scores(F.col("n_chars") > 1500, F.col("quality") == 1))


@query("SELECT source, round(avg(CAST((n_chars > 1500) = (quality = 1) AS INT)), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source")
def accuracy_report(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(F.avg(((F.col("n_chars") > 1500) == (F.col("quality") == 1)).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) + 28 AS BIGINT) AS stored FROM documents")
def aes_roundtrip(spark, sf_dir):
    key, bound = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.concat(F.lit("tenant/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    sealed = d.select("doc_id", objects.sealed(F.col("t"), key, bound).alias("c"), bound.alias("place"))
    return sealed.select("doc_id", F.sha2(objects.opened(F.col("c"), key, F.col("place")), 256).alias("digest"), F.octet_length("c").cast("bigint").alias("stored"))


@query()
def html_lines(spark, sf_dir):
    return parsing.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def rate_limiter_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return limits.limited(e.select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("hit_id")), limit=2, window=3600.0)


@query()
def word_diff_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.to_json(C.word_diff("text", "next")).alias("changes"))


HINTS = [("term", 0, "term"), ("term", 0, "renewal"), ("liability", 1, "liability"), ("definitions", 2, "definitions")]


RULES = [
    ("r1", "term", True, None, None, 60, 24, None, None, None, None), ("r2", "liability", True, None, None, None, None, None, 1000.0, None, None), ("r3", "privacy", True, None, None, None, None, None, None, None, None),
    ("r4", "privacy", False, None, None, None, None, None, None, None, None), ("r5", "definitions", True, ["meanings"], None, None, None, None, None, None, None), ("r6", "definitions", True, None, ["Terms"], None, None, None, None, None, None),
]
RULE_SCHEMA = "rule_key string, clause_key string, required boolean, must_include array<string>, must_not_include array<string>, min_months int, fallback_months int, max_months int, max_amount double, min_amount double, max_percent double"


TYPES = {"NDA": ["non-disclosure", "confidentiality agreement"], "SERVICES": ["services agreement"], "DPA": ["data processing"]}


ENDPOINTS = [("rules", "self", ["self"], "T0", "plan", ["*"], ["json"], ["en", "vi"], 10000, 0.0, 0.0, True, 0), ("far", "a", ["a"], "T1", "plan", ["US"], ["json"], ["en"], 10000, 1.0, 1.0, True, 1), ("near", "b", ["b"], "T1", "plan", ["SG"], ["json"], ["en"], 10000, 2.0, 2.0, True, 2), ("byo", "c", ["c"], "T2", "byo", ["US"], ["json"], ["en"], 10000, 2.0, 8.0, True, 3), ("off", "d", ["d"], "T1", "plan", ["US"], ["json"], ["en"], 10000, 1.0, 1.0, False, 4)]
ENDPOINT_SCHEMA = "endpoint_id string, provider string, parties array<string>, tier string, billing string, regions array<string>, capabilities array<string>, speaks array<string>, max_context int, price_in double, price_out double, enabled boolean, registry_pos int"
REQUESTS = [(1, [], None, None, ["json"], "normal", "low", ["en"], 1000, 1000, "T2", "T1", False, [], 10.0), (2, ["b"], ["a"], None, ["json"], "normal", "low", ["en"], 1000, 1000, "T1", "T1", False, ["c"], 10.0), (3, [], None, "SG", ["vision"], "normal", "high", ["vi"], 1000, 1000, "T1", "T1", False, [], 10.0)]
REQUEST_SCHEMA = "request_id bigint, deny array<string>, allow array<string>, residency string, requires array<string>, sensitivity string, quality_floor string, languages array<string>, est_in int, est_out int, max_tier string, preferred_tier string, escalated boolean, byo_providers array<string>, budget double"


# Hints, rules, types and endpoints are parameters. The queries below run on the texts as they are and have no SQL
# twin; ``plans.written`` runs the same operators on contracts written from columns, with SQL.
HEADING = r"^\p{Lu}[^.!?:;,]{0,40}$"


def _document_clauses(spark, sf_dir):
    """Clauses of all documents: lines as blocks, short lines without punctuation as headings."""
    documents = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", part=PART_ROWS // 20)
    blocks = parsing.text_blocks(documents, "doc_id", "text")
    return C.segmented(blocks.withColumn("is_heading", F.col("text").rlike(HEADING)), together=True)


def _document_labels(spark, sf_dir):
    return C.labelled(_document_clauses(spark, sf_dir), spark.createDataFrame(HINTS, "key string, ord int, hint string"))


@query()
def clause_segmentation_documents(spark, sf_dir):
    return _document_clauses(spark, sf_dir).withColumn("number", F.coalesce("number", F.lit("")))


@query()
def clause_labels_documents(spark, sf_dir):
    return _document_labels(spark, sf_dir).select("doc_id", "idx", "clause_key", "confidence")


@query()
def rule_evaluation_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return C.evaluated(spark.createDataFrame(RULES, RULE_SCHEMA), _document_labels(spark, sf_dir), docs)


@query()
def law_rule_pairs_documents(spark, sf_dir):
    rules = spark.createDataFrame([("t1", ["term"], []), ("t2", ["liability", "term"], ["CAPPED"]), ("t3", ["definitions"], ["penalty"])], "law_rule string, clause_keys array<string>, triggers array<string>")
    return C.law_pairs(rules, _document_labels(spark, sf_dir))


@query()
def parse_values_documents(spark, sf_dir):
    c, joined = F.col("text"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    money = F.array_join(F.transform(V.amounts(c), lambda a: F.concat_ws(" ", a["currency"], a["value"].cast("string"))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", joined(V.durations(c)).alias("months"), money.alias("amounts"), joined(V.percents(c)).alias("percents"), joined(F.transform(V.dates(c), lambda d: d["value"])).alias("dates"), joined(V.tax_codes(c)).alias("tax_codes"))


@query()
def words_to_int_documents(spark, sf_dir):
    """The number that each line of a document spells, or null."""
    lines = parsing.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "pos", V.words_to_int(F.col("text")).alias("value"))


@query()
def bilingual_diffs_conversations(spark, sf_dir):
    """Typed values in which each turn and the next one differ."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("other"))
    pairs = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("primary")).join(after, ["conv_id", "turn"])
    d = C.differences(pairs.select(F.struct("conv_id", "turn").alias("pair_id"), "primary", "other"))
    return d.select("pair_id.conv_id", "pair_id.turn", "kind", "side", "value")


@query()
def citation_validation_conversations(spark, sf_dir):
    """Each sentence of each turn as a claim that cites the next turn; the last turn's claims cite what is not there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    unit_id = lambda turn: F.concat_ws("-", "conv_id", turn)
    cited = F.array_join(F.transform(T.sentences(F.col("text")), lambda s: F.concat(F.regexp_replace(s, "[.!?]+$", ""), F.lit(" [[src:"), unit_id(F.col("turn") + 1), F.lit("]]."))), " ")
    units_ = c.select(unit_id(F.col("turn")).alias("unit_id"), "text", F.lit("2000-01-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("in_force").alias("status"))
    v = S.validated(c.select(F.struct("conv_id", "turn").alias("note_id"), cited.alias("text")), units_, "2024-06-01")
    return v.select("note_id.conv_id", "note_id.turn", "claim_no", "unit_id", "result", "score")


@query()
def contract_type_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.contract_type(F.coalesce("text", F.lit("")), TYPES).alias("kind"))


@query()
def routing_plan_documents(spark, sf_dir):
    """A request for each document in its language and size; the rest of the policy is the fixture's first."""
    fixed = spark.createDataFrame(REQUESTS[:1], REQUEST_SCHEMA).drop("request_id", "languages", "est_in")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.array("lang").alias("languages"), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("est_in"))
    p = routing.plan(d.join(F.broadcast(fixed), F.lit(True)), spark.createDataFrame(ENDPOINTS, ENDPOINT_SCHEMA))  # one row
    return p.select("request_id", "endpoint_id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("rank", F.lit(0)).alias("rank"))
