"""Text functions as Column expressions: they stay inside whole-stage code generation.

Character classes are spelled out where Java's shorthand is narrower than Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[\x09-\x0D\x{85}\p{Z}]+"
TOKENS = r"[\p{L}\p{N}]{2,}"
#: Lower-case Latin letters with marks and their plain forms, for accent-insensitive matching.
_MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz"]
ACCENTS = ("".join(_MARKED) + "đ", "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED) + "d")
#: Words that are no search terms, English and Vietnamese.
STOP = (
    "the and for that this with shall any are not under such all may its which from been has have each other into of to in on or by be an as at is it if no "
    "và của các có được cho là với theo trong này những một khi thì để đã sẽ tại về do từ đến hoặc nếu mà như trên bị vào ra phải không"
).split()
#: Letters that only Vietnamese has, tones it shares, and frequent words of short Vietnamese and English texts.
VIETNAMESE = "[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"
TONES = "[àáãèéìíòóõùúý]"
VI_COMMON = "và của các cho được theo trong với là có không khi này thanh toán giá bên hợp đồng điều khoản tin thông".split()
EN_COMMON = "the and of to in shall is be by or for with any this that on as party parties agreement article clause which under from not all such will may means its at an a".split()
#: Shares of words from which a short text is Vietnamese or English, and words of a text too short to tell.
VI_SHARE, EN_SHARE, FEW_WORDS = 0.2, 0.08, 6
#: Words that tell the languages of a whole contract.
EN_MARKS = ["the", "and", "of", "agreement", "shall", "party", "to", "in"]
ID_MARKS = ["yang", "dan", "dengan", "perjanjian", "pihak", "untuk", "dalam", "tersebut", "pasal"]
MS_MARKS = ["hendaklah", "perjanjian", "pihak", "yang", "dan", "adalah", "fasal", "boleh"]
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "on", "that", "with", "it", "re"],
    "fr": ["le", "la", "les", "et", "de", "que", "un", "en", "dans", "qui"],
    "de": ["der", "die", "und", "ich", "nicht", "ein", "das", "mit", "für", "den"],
    "es": ["el", "los", "las", "y", "que", "una", "con", "por", "para", "del"],
}


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it."""
    return texts.str.normalize("NFC")


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def canonical(text: Column) -> Column:
    """Quote-matching form: collapsed, trimmed, lower case."""
    return F.lower(squeezed(text))


def comparison_key(text: Column) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def line_shape(text: Column) -> Column:
    """Lower case with digits as '#': what running headers have in common."""
    return F.regexp_replace(F.lower(squeezed(text)), "[0-9]", "#")


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank, in order."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(parts, squeezed_line), lambda x: x != "")


def squeezed_line(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x09-\x0D\x{85}\p{Z}]+|[\x09-\x0D\x{85}\p{Z}]+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(0))


def search_terms(text: Column, stop: list[str] = STOP) -> Column:
    """Distinct tokens without stop words, in order of first use."""
    return F.array_distinct(F.filter(tokens(text), lambda w: ~w.isin(stop)))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? and white space where a capital, a quote or a bracket follows."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r'([.!?])[\x09-\x0D ]+([\p{Lu}"“(])', "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), squeezed_line), lambda x: x != "")


def cited(sentence: Column) -> Column:
    """Ids of ``[[src:ID]]`` markers."""
    return F.regexp_extract_all(sentence, F.lit(r"\[\[src:([^\]]+)\]\]"), F.lit(1))


def quotes(sentence: Column) -> Column:
    """Quoted spans of at least eight characters."""
    return F.regexp_extract_all(sentence, F.lit(r'["“]([^"“”]{8,})["”]'), F.lit(1))


def unmarked(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, r"\s*\[\[src:[^\]]+\]\]", ""))


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(text), *ACCENTS)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def letters(text: Column) -> Column:
    """Lower-case words of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _share(words: Column, test) -> Column:
    return F.size(F.filter(words, test)) / F.greatest(F.size(words), F.lit(1))


def language_scores(text: Column, words: dict[str, list[str]] = LANGUAGE_WORDS) -> Column:
    """Array of (share, -order, language) structs; the largest is the best language. The text's words are counted once."""
    known = sorted({w for own in words.values() for w in own})
    # only listed words are kept, with the number of all words in front
    counted = bound(letters(text), lambda all_words: F.struct(F.size(all_words).alias("n"), F.filter(all_words, lambda w: w.isin(known)).alias("w")))
    among = lambda own: lambda w: w.isin(own)
    return bound(counted, lambda x: F.array(*[F.struct((F.size(F.filter(x["w"], among(own))) / F.greatest(x["n"], F.lit(1))).alias("share"), F.lit(-i).alias("order"), F.lit(lang).alias("language")) for i, (lang, own) in enumerate(words.items())]))


def short_language(text: Column) -> Column:
    """'vi' or 'en' for a short piece of contract text; null if undecided."""
    def judged(words: Column) -> Column:
        vi = _share(words, lambda w: w.rlike(VIETNAMESE) | w.isin(VI_COMMON) | w.rlike(TONES))
        en = _share(words, lambda w: w.isin(EN_COMMON))
        return F.when(F.size(words) == 0, None).when(vi >= VI_SHARE, "vi").when((en >= EN_SHARE) | (vi == 0) & (F.size(words) <= FEW_WORDS), "en")

    return bound(letters(text), judged)


def contract_languages(text: Column, least: float = 0.15) -> Column:
    """Languages of a whole contract among vi, en, id and ms, best first; Latin ones are measured against the words that are not Vietnamese."""
    def judged(words: Column) -> Column:
        vi = F.size(F.filter(words, lambda w: w.rlike(VIETNAMESE)))
        rest = F.greatest(F.size(words) - vi, F.lit(1))
        of = lambda marks: F.size(F.filter(words, lambda w: w.isin(marks))) / rest * 3
        malay, either = F.exists(words, lambda w: w.isin("hendaklah", "fasal")), (of(ID_MARKS) > 0) | (of(MS_MARKS) > 0)
        one = lambda share, order, language: F.struct(share.cast("double").alias("share"), F.lit(-order).alias("order"), F.lit(language).alias("language"))
        third = F.when(malay, one(of(MS_MARKS), 2, "ms")).otherwise(one(of(ID_MARKS), 2, "id"))
        scores = F.concat(F.array(one(vi / F.greatest(F.size(words), F.lit(1)), 0, "vi"), one(of(EN_MARKS), 1, "en")), F.when(either, F.array(third)).otherwise(F.slice(F.array(third), 1, 0)))
        ranked = F.reverse(F.array_sort(scores))
        good = F.filter(ranked, lambda x: x["share"] >= least)
        return F.when(F.size(words) == 0, F.slice(ranked, 1, 0)).when(F.size(good) > 0, good).otherwise(F.slice(ranked, 1, 1))

    return F.transform(bound(letters(text), judged), lambda x: x["language"])


def humanised(key: Column) -> Column:
    """A rule key as words: 'min_duration' becomes 'Min duration'."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def first_sentence(text: Column, limit: int = 300) -> Column:
    """The first sentence of at least twenty characters without its end mark, double quotes as single ones."""
    clean = squeezed_line(F.coalesce(text, F.lit("")))
    head = F.regexp_extract(clean, r"(?s)^(.{20,}?[.;])(?:\s|$)", 1)
    return F.replace(F.rtrim(F.substring(F.when(head == "", clean).otherwise(head), 1, limit), F.lit(".;")), F.lit('"'), F.lit("'"))


def grouped_thousands(value: Column) -> Column:
    """1,234 for whole numbers, else two decimals."""
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def heading_split(text: Column) -> Column:
    """(heading, body): a capitalised start up to . or : heads the rest; a short line is all heading."""
    pattern = r"(?s)^([^.:\n]{2,90})[.:]\s+(.+)$"
    head, body = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    split = (head != "") & head.rlike(r"^\p{Lu}")
    alone = (F.length(text) <= 90) & ~text.rlike(r"[.;,]$") & ~text.contains("\n")
    none = F.lit("")
    return F.struct(F.when(split, head).when(alone, text).otherwise(none).alias("heading"), F.when(split, body).when(alone, none).otherwise(text).alias("body"))


def alternate_heading(text: Column) -> Column:
    """(heading, body) of a block in the other language; a clause number before it is dropped."""
    first, more = F.substring_index(text, "\n", 1), F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    head = heading_split(F.coalesce(clause_number(F.trim(first))["rest"], F.trim(first)))
    return F.struct(head["heading"].alias("heading"), F.array_join(F.filter(F.array(head["body"], F.trim(more)), lambda x: x != ""), "\n").alias("body"))


#: Fixed value: numbers of clauses ("1.", "1.2)", "Article 5", "Điều 7") and what follows them.
NUMBERED = r"(?iu)^(?:(article|clause|section|điều|pasal|fasal)\s+(\d{1,3})[.:]?|(\d{1,3}(?:\.\d{1,3})*)[.)]?)\s+(\S.*)$"


def clause_number(text: Column) -> Column:
    """(keyword, number, rest) of a numbered line, or null."""
    part = lambda i: F.regexp_extract(text, NUMBERED, i)
    return F.when(text.rlike(NUMBERED), F.struct(part(1).alias("keyword"), F.concat(part(2), part(3)).alias("number"), part(4).alias("rest")))


def pinpoint(path: Column, title: Column) -> Column:
    """How a unit is cited: Vietnamese paths come before the title, others behind it."""
    return F.when(path.rlike("^(Điều|Khoản|Điểm)"), F.concat_ws(" ", path, title)).otherwise(F.concat_ws(", ", title, path))
