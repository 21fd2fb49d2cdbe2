"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (see FEATURES) are densities of lexicon words, nearness of such words to the
second person, capitals, punctuation and obfuscation.  Part of the lexicon is fixed (INSULTS), the
rest is learned: stems (the first 4 to 8 bytes of a word, or the whole word) that are far more
frequent in toxic than in clean labelled texts.  Stems and trees learn on one part of the training
labels, the isotonic map on another, which has both classes (else on the same).  Score and features never see id, language, source or labels.

Learning reads at most ``max_train`` labelled rows (a documented bound; the rows with the smallest
hashes of their id), which also bounds the learned lexicon; held-out rows, ``crc32(id) mod 5 = 0``, are never among them.  Scoring reads
every whole text in one pass without a shuffle.

Defined results: null and empty texts are scored like any other (all features 0); repeated rows
come as often as they are; several labels of one id count as toxic if one is; rows without id are
scored and count as held out; without two classes among the labels every score is the share of
toxic labels (0 without labels); only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from clausework.llm import textnp
from clausework.llm.shared import small_batches, written

MAX_TRAIN = 20_000
#: Bytes of text that a worker looks at together; its arrays take some hundred times as much.
SLICE_BYTES = 1 << 19
FOLDS = 5

#: Common insults in four languages.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool garbage jerk bastard bitch asshole shit fuck fucking "
    "dumm idiotin trottel abschaum arschloch schwachkopf versager widerlich imbécile connard salope abruti crétin ordure débile nul minable "
    "imbécil estúpido estúpida basura escoria asqueroso payaso inútil tonto"
).split()
#: Words of the second person in four languages.
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos ti tus tuyo usted ustedes vosotros".split()
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
STEMS = (4, 5, 6, 8)
NEAR = 5

FEATURES = [
    "lexicon_density", "learned_density", "learned_weight", "learned_most", "log_learned", "log_lexicon",
    "near_second_person", "second_person_density", "capitals_rate", "shouted_words_rate", "exclaim_rate", "punctuation_rate", "obfuscated_rate", "disguised_hits", "log_words",
]


def word_hashes(words: list[str]) -> np.ndarray:
    data, offs = textnp.buffer(pa.array(words, pa.string()))
    return np.unique(textnp.Words(textnp.LOWER[data], offs, textnp.ALNUM).hashes)


def _stems(low: np.ndarray, words: textnp.Words) -> list[np.ndarray]:
    """Hashes of each word's stems; the last is the whole word. 0 where the word is too short."""
    sizes = words.ends - words.starts
    total, out = np.zeros(len(sizes), np.uint64), []
    powers = textnp._powers(max(STEMS))
    for k in range(max(STEMS)):
        has = sizes > k
        total[has] += (low[words.starts[has] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
        if k + 1 in STEMS:
            out.append(np.where(has, textnp.mix(total + np.uint64((k + 1) << 56)), np.uint64(0)))
    return [*out, words.hashes]


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


_MAP = np.arange(256, dtype=np.uint8)
for _a, _b in DISGUISE.items():
    _MAP[ord(_a)] = ord(_b)
_DROPPED = np.zeros(256, bool)
_DROPPED[[*b"*!.-_'^~#%&+=,;:?()\"/\\|<>[]{}`"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD = np.zeros(256, bool)
_ODD[[*b"0134570@$!*"]] = True


#: What is counted of a text; all but the largest weight add up over its parts.
COUNTED = ["insults", "learned", "weight", "most", "hits", "you", "upper", "letters", "shouted", "exclaim", "punctuation", "obfuscated", "clear", "words", "tokens", "bytes"]
_EXCLAIM = np.isin(np.arange(256), [33, 63])


def _counted(data: np.ndarray, offs: np.ndarray, stems: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts x COUNTED, hits, second persons, first words): what each text has, and which of its words are lexicon words and second persons."""
    n = len(offs) - 1
    low = textnp.LOWER[data]
    words = textnp.Words(low, offs, textnp.ALNUM)
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(n), counts)
    per = lambda x: np.bincount(owner, x, n)
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offs]) if len(data) else np.zeros(n)

    insults, second = word_hashes(INSULTS), word_hashes(SECOND_PERSON)
    insult, _ = _member(insults, words.hashes)
    weight = np.zeros(len(words.hashes))
    for h in _stems(low, words):
        here, at = _member(stems, h)
        weight = np.maximum(weight, np.where(here, weights[at] if len(weights) else 0.0, 0.0))
    hit = insult | (weight > 0)
    you, _ = _member(second, words.hashes)

    # tokens with disguises undone: symbols inside are dropped, look-alikes become letters
    kept = ~_DROPPED[data]
    plain = textnp.LOWER[_MAP[data[kept]]]
    moved = np.concatenate([[0], np.cumsum(kept)])[offs]
    tokens = textnp.Words(plain, moved, textnp.ALNUM)
    clear, _ = _member(insults, tokens.hashes)
    for h in _stems(plain, tokens):
        clear |= _member(stems, h)[0]
    t_owner = np.repeat(np.arange(n), np.diff(tokens.first))

    raw = textnp.Words(data, offs, textnp.NON_SPACE, hashed=False)
    size = raw.ends - raw.starts
    total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[np.stack([raw.starts, raw.ends])], axis=0)[0] if len(size) else np.zeros(0)
    letters, odd, caps = total(_LETTER), total(_ODD), total(_UPPER)
    inner = odd - (_ODD[data[raw.ends - 1]] if len(size) else 0)
    r_owner = np.repeat(np.arange(n), np.diff(raw.first))
    most = np.zeros(n)
    np.maximum.at(most, owner, weight)
    found = np.stack([
        per(insult), per(weight > 0), per(weight), most, per(hit), per(you), share(_UPPER), share(_LETTER), np.bincount(r_owner, (caps == letters) & (letters > 1), n), share(_EXCLAIM), share(_PUNCT),
        np.bincount(r_owner, (letters > 1) & (inner > 0), n), np.bincount(t_owner, clear, n), counts, np.diff(raw.first), np.diff(offs),
    ], axis=1)
    return found, hit, you, words.first


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text in runs of about ``most`` bytes that end at white space; every kind of word ends there too."""
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        while to < len(data) and textnp.NON_SPACE[data[to - 1]]:
            gap = np.flatnonzero(~textnp.NON_SPACE[data[to : to + most]])
            to = to + int(gap[0]) + 1 if len(gap) else min(len(data), to + most)
        yield data[at:to]
        at = to


def features(data: np.ndarray, offs: np.ndarray, stems: np.ndarray, weights: np.ndarray, most_bytes: int = SLICE_BYTES) -> np.ndarray:
    """The feature matrix (texts x FEATURES) of a batch; ``stems`` are sorted hashes. A long text alone is counted run by run."""
    n = len(offs) - 1
    if n == 1 and len(data) > 2 * most_bytes:
        parts = [_counted(x, np.array([0, len(x)]), stems, weights) for x in _pieces(data, most_bytes)]
        found = np.sum([x[0] for x in parts], axis=0)
        found[:, COUNTED.index("most")] = np.max([x[0][:, COUNTED.index("most")] for x in parts], axis=0)
        hit, you = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        first = np.array([0, len(hit)])
    else:
        found, hit, you, first = _counted(data, offs, stems, weights)
    c = dict(zip(COUNTED, found.T, strict=True))
    # lexicon words with a second person within NEAR words of the same text
    number = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    near = np.zeros(len(hit), bool)
    for d in range(NEAR + 1):
        same = number[d:] == number[: len(number) - d]
        near[d:] |= you[: len(you) - d] & same
        near[: len(near) - d] |= you[d:] & same
    near = np.bincount(number, hit & near, n)
    many, chars, tokens = np.maximum(c["words"], 1), np.maximum(c["bytes"], 1), np.maximum(c["tokens"], 1)
    disguised = np.maximum(0, c["clear"] - c["hits"])
    return np.stack([
        100 * c["insults"] / many, 100 * c["learned"] / many, 100 * c["weight"] / many, c["most"], np.log1p(c["learned"]), np.log1p(c["insults"]), 100 * near / many, 100 * c["you"] / many,
        c["upper"] / np.maximum(c["letters"], 1), c["shouted"] / tokens, c["exclaim"] / chars, c["punctuation"] / chars, c["obfuscated"] / tokens, np.where(c["hits"] + disguised > 0, disguised, 0), np.log1p(c["words"]),
    ], axis=1)


def _featured(df: DataFrame, stems: np.ndarray, weights: np.ndarray, extra: list[str]) -> DataFrame:
    """Rows (``extra`` columns kept) with their features as a vector; ``df`` holds ``__text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, "__text", SLICE_BYTES):
            x = features(*textnp.buffer(batch.column("__text")), stems, weights)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), values], names=[*extra, "__f"])

    def kind(t: DataType) -> str:
        return "struct<" + ",".join(f"`{f.name}`:{kind(f.dataType)}" for f in t) + ">" if isinstance(t, StructType) else t.simpleString()

    schema = ", ".join([*(f"`{c}` {kind(df.schema[c].dataType)}" for c in extra), "`__f` array<double>"])
    return df.mapInArrow(run, schema).withColumn("__x", array_to_vector("__f")).drop("__f")


def _stemmed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All stems of all words and the texts they are in."""
    low = textnp.LOWER[data]
    words = textnp.Words(low, offs, textnp.ALNUM)
    return np.concatenate(_stems(low, words)), np.tile(np.repeat(np.arange(len(offs) - 1), np.diff(words.first)), len(STEMS) + 1)


def _stem_counts(df: DataFrame) -> DataFrame:
    """(stem, toxic texts, clean texts) of ``df(__text, __y)``; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, "__text", SLICE_BYTES):
            data, offs = textnp.buffer(batch.column("__text"))
            toxic = np.asarray(batch.column("__y")).astype(bool)
            if batch.num_rows == 1:  # perhaps a long text
                stem = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(_stemmed(x, np.array([0, len(x)]))[0]) for x in _pieces(data, SLICE_BYTES)]]))
                bad = np.repeat(toxic, len(stem))
            else:
                stem, doc = _stemmed(data, offs)
                order = np.lexsort((doc, stem))
                stem, doc = stem[order], doc[order]
                fresh = np.ones(len(stem), bool)
                fresh[1:] = (stem[1:] != stem[:-1]) | (doc[1:] != doc[:-1])
                stem, bad = stem[fresh], toxic[doc[fresh]]
            if not len(stem):
                continue
            value, first = np.unique(stem, return_index=True)
            n_bad = np.add.reduceat(bad.astype(np.int64), first)
            n_all = np.diff(np.append(first, len(stem)))
            some = (n_bad > 0) & (value != 0)
            yield pa.RecordBatch.from_arrays([pa.array(value[some].view(np.int64)), pa.array(n_bad[some]), pa.array((n_all - n_bad)[some])], names=["stem", "n_toxic", "n_clean"])

    return df.mapInArrow(run, "stem bigint, n_toxic bigint, n_clean bigint").groupBy("stem").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


class Model:
    """Learned stems, trees and the isotonic map; ``constant`` stands for them without two classes."""

    def __init__(self, constant: float | None = None, stems=None, weights=None, trees=None, isotonic=None):
        self.constant, self.stems, self.weights, self.trees, self.isotonic = constant, stems, weights, trees, isotonic

    def score(self, df: DataFrame, text_col: str, keep: list[str], score_col: str = "__score") -> DataFrame:
        """``keep`` columns of every row and the score between 0 and 1."""
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.col(text_col).cast("string").alias("__text"))
        if self.constant is not None:
            return rows.select("__keep.*", F.lit(self.constant).alias(score_col))
        x = _featured(rows, self.stems, self.weights, ["__keep"])
        margin = self.trees.transform(x).select("__keep", vector_to_array("probability")[1].alias("__raw"))
        out = self.isotonic.transform(margin)
        return out.select("__keep.*", F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)).alias(score_col))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from at most ``max_train`` labelled rows that are not held out."""
    spark = documents.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).where(fold("__id") != 0)
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    texts = documents.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = written(texts.join(F.broadcast(chosen), "__id"), "toxicity-train").withColumn("__part", fold("__id"))
    sizes = {(r.held, r.y): r.n for r in rows.groupBy((F.col("__part") == 1).alias("held"), (F.col("__y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = (sizes.get((True, y), 0) + sizes.get((False, y), 0) for y in (0, 1))
    if not n_toxic or not n_clean:
        return Model(constant=float(n_toxic > 0))
    if apart := len(sizes) == 4:  # the rows that fit the isotonic map take no part in stems and trees
        n_clean, n_toxic = sizes[False, 0], sizes[False, 1]
    grown = F.col("__part") != 1 if apart else F.lit(True)
    odds = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1))
    learned = _stem_counts(rows.where(grown).select("__text", (F.col("__y") > 0).cast("int").alias("__y"))).withColumn("w", odds)
    least = max(6, n_toxic // 100)
    learned = learned.where((F.col("n_toxic") >= least) & (F.col("w") > 3.0)).collect()
    stems = np.array([r.stem for r in learned], np.int64).view(np.uint64)
    order = np.argsort(stems)
    stems, weights = stems[order], np.array([r.w for r in learned])[order]
    x = written(_featured(rows.coalesce(4).withColumn("__y", (F.col("__y") > 0).cast("double")), stems, weights, ["__id", "__y", "__part"]), "toxicity-features")
    trees = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(x.where(grown))
    held = x.where("__part = 1") if apart else x
    held = trees.transform(held).withColumn("__raw", vector_to_array("probability")[1]).select("__raw", "__y")
    isotonic = IsotonicRegression(featuresCol="__raw", labelCol="__y", predictionCol="__score").fit(held)
    return Model(None, stems, weights, trees, isotonic)


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(documents, labels, id_col, text_col, label_col, max_train)
    rows = model.score(documents.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__t")), "__t", ["__key"])
    return rows.select(F.col("__key").alias(id_col), F.coalesce(fold("__key") == 0, F.lit(True)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
