"""Typed values in contract texts: figures, amounts, percentages, tax codes, periods, dates, numbers in words.

A text is scanned once into tokens (numbers, words, marks), and one walk over the tokens finds all kinds
of values.  What a word means is looked up in tables of English and Vietnamese words; case is ignored.
Spark has no built-in for this and chains of backtracking patterns took 0.9 ms a text, so the walk is
Python on Arrow batches: ``values(text)`` is a struct with all kinds, and the functions named after a kind
read one field of it (Spark runs equal calls of one projection once).  Texts are expected in Unicode normal
form C (``functions.text.nfc``).  A null text has no values.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, LongType, StringType, StructField, StructType

# Number words and their values.
VI_DIGITS = {"không": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "nhăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9}
VI_SCALES = {"nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000}
EN_UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
EN_SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
# Currencies and their codes, months, units of time, words around spelled-out amounts, heads of articles.
CURRENCIES = {"VNĐ": "VND", "VND": "VND", "ĐỒNG": "VND", "USD": "USD", "US$": "USD", "EUR": "EUR", "€": "EUR", "SGD": "SGD", "S$": "SGD", "MYR": "MYR", "RM": "MYR", "IDR": "IDR", "RP": "IDR", "$": ""}
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "sept": 9}
LONG_UNITS = {"year": 12, "years": 12, "năm": 12, "tahun": 12, "month": 1, "months": 1, "tháng": 1, "bulan": 1}
SHORT_UNITS = {
    "hour": "h", "hours": "h", "giờ": "h", "jam": "h", "day": "d", "days": "d", "ngày": "d", "hari": "d", "week": "w", "weeks": "w", "tuần": "w", "minggu": "w",
    "ngày làm việc": "bd", "business day": "bd", "business days": "bd", "working day": "bd", "working days": "bd", "hari kerja": "bd",
}
PERCENTS = ["%", "percent", "per cent", "phần trăm"]
IN_WORDS = ["viết bằng chữ", "bằng chữ", "in words"]
MONEY_WORDS = {"đồng", "việt", "nam", "vietnam", "dong", "vnd", "us", "dollar", "dollars", "euro", "euros"}
ARTICLE_HEADS = {"điều", "article", "khoản", "clause"}
ORDINALS = {"st", "nd", "rd", "th"}
# Words of negation.
NEGATIONS = {"vi": r"(?iU)\b(?:không|chưa|cấm|nghiêm cấm)\b(?!\s+(?:trăm|gian))", "en": r"(?iU)\b(?:not|no|never|neither|nor|without|prohibited)\b"}

# What a number word does: add its value, or multiply what is smaller than itself before it.
_VI = {w: ("add", n) for w, n in VI_DIGITS.items()} | {w: ("times", n) for w, n in VI_SCALES.items()} | {"mười": ("add", 10), "mươi": ("times", 10), "trăm": ("times", 100), "linh": ("add", 0), "lẻ": ("add", 0)}
_EN = {w: ("add", n) for w, n in EN_UNITS.items()} | {w: ("times", n) for w, n in EN_SCALES.items()} | {"hundred": ("times", 100), "and": ("add", 0)}
_MONTH = MONTHS | {m[:3]: n for m, n in MONTHS.items()}
_PHRASES = sorted([*SHORT_UNITS, *PERCENTS], key=lambda p: -len(p.split()))
_BY_FIRST = {first: [tuple(p.split()) for p in _PHRASES if p.split()[0] == first] for first in {p.split()[0] for p in _PHRASES}}

KIND = pa.struct([
    ("amounts", pa.list_(pa.struct([("currency", pa.string()), ("value", pa.float64()), ("span", pa.string())]))), ("percents", pa.list_(pa.float64())), ("tax_codes", pa.list_(pa.string())),
    ("dates", pa.list_(pa.struct([("value", pa.date32()), ("span", pa.string())]))), ("periods", pa.list_(pa.struct([("value", pa.int64()), ("unit", pa.string()), ("span", pa.string())]))),
    ("spelled", pa.list_(pa.struct([("figure", pa.float64()), ("words_value", pa.int64()), ("words", pa.string()), ("span", pa.string())]))), ("numbers", pa.list_(pa.int64())),
])
_LISTS = {
    "amounts": {"currency": StringType(), "value": DoubleType(), "span": StringType()}, "percents": DoubleType(), "tax_codes": StringType(), "dates": {"value": DateType(), "span": StringType()},
    "periods": {"value": LongType(), "unit": StringType(), "span": StringType()}, "spelled": {"figure": DoubleType(), "words_value": LongType(), "words": StringType(), "span": StringType()}, "numbers": LongType(),
}
_struct = lambda fields: StructType([StructField(n, t) for n, t in fields.items()])
RESULT = _struct({n: ArrayType(_struct(t) if isinstance(t, dict) else t) for n, t in _LISTS.items()})
#: Words that a value can begin with, and words and marks that a currency can.
_STARTS = {"ngày", *_MONTH, *_VI, *_EN}
_MONEY = {c.lower() for c in CURRENCIES} | {"us", "s"}
#: What may stand between the day and the month.
_BEHIND_DAY = {*_MONTH, *ORDINALS}
#: Texts whose values are Python objects at one time.
SLICE = 500
_TOKEN = re.compile(r"(\d+(?:[.,]\d+)*)|([^\W\d_]+)|(\S)")
_BIGGEST = 1 << 63
#: Words of the longest number that is read.
LONGEST_NUMBER = 40


def spoken(words: list[str]) -> int | None:
    """The number that words of one language say. Parts add up; a multiplier takes the smaller parts before it."""
    for table in (_VI, _EN):
        if 0 < len(words) <= LONGEST_NUMBER and all(w in table for w in words):
            parts: list[int] = []
            for w in words:
                what, n = table[w]
                if what == "times":
                    below = [p for p in parts if p < n]
                    parts = [p for p in parts if p >= n]
                    n *= sum(below) if below else 1
                parts.append(n)
            total = sum(parts)
            return total if total < _BIGGEST else None
    return None


def _monetary(word: str) -> bool:
    """Whether a word or mark in lower case can begin a currency; upper case tells of letters beyond ASCII."""
    return word in _MONEY or not word.isascii()


def figure(raw: str) -> tuple[float, int]:
    """(value, length) of the figure that a run of digits, points and commas begins with.

    Groups of three digits belong together; one or two digits behind the last mark are decimals.
    """
    if raw.isdigit():
        return float(raw), len(raw)
    groups = raw.replace(",", ".").split(".")
    n = 1
    while n < len(groups) and len(groups[0]) <= 3 and len(groups[n]) == 3:
        n += 1
    whole, length = "".join(groups[:n]), sum(map(len, groups[:n])) + n - 1
    if n < len(groups):
        decimals = groups[n][:2]
        return float(f"{whole}.{decimals}"), length + 1 + len(decimals)
    return float(whole), length


class Walk:
    """The tokens of one text and what is found among them."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastindex, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        low = text.lower()
        # a letter may become two in lower case
        self.low = [low[t[2] : t[3]] for t in self.tokens] if len(low) == len(text) else [t[1].lower() for t in self.tokens]
        self.used: list[tuple[int, int]] = []  # characters of values that are no standalone numbers

    def leads(self, i: int) -> bool:
        """Whether nothing but white space precedes token i on its line."""
        return not i or "\n" in self.text[self.tokens[i - 1][3] : self.tokens[i][2]]

    def is_number(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == 1

    def is_mark(self, i: int, marks: str) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == 3 and self.tokens[i][1] in marks

    def whole(self, i: int, most: int) -> bool:
        """Whether token i is a whole number of so many digits at most."""
        return i < len(self.tokens) and len(self.tokens[i][1]) <= most and self.tokens[i][1].isdigit()

    def full(self, i: int) -> bool:
        """Whether token i is a year of four digits."""
        return i < len(self.tokens) and len(self.tokens[i][1]) == 4 and self.tokens[i][1].isdigit()

    def gap(self, i: int) -> int:
        """Characters between token i and the one before."""
        return self.tokens[i][2] - self.tokens[i - 1][3]

    def span(self, i: int, j: int) -> str:
        """Text of the tokens from i up to j, which is left out."""
        return self.text[self.tokens[i][2] : self.tokens[j - 1][3]]

    def use(self, i: int, j: int, end: int | None = None) -> None:
        self.used.append((self.tokens[i][2], end or self.tokens[j - 1][3]))

    def phrase(self, i: int) -> tuple[str, int]:
        """(phrase, tokens) of a unit or percent sign at token i, the longest one, else ('', 0)."""
        if i < len(self.low):
            for p in _BY_FIRST.get(self.low[i], ()):
                if tuple(self.low[i : i + len(p)]) == p:
                    return " ".join(p), len(p)
        return "", 0

    def currency(self, i: int) -> tuple[str, int]:
        """(code, tokens) of a currency at token i; 'US$' and 'S$' are two tokens, 'Rp.' may be."""
        if not 0 <= i < len(self.tokens) or not _monetary(self.low[i]):
            return "", 0
        raw = self.tokens[i][1].upper()
        if raw in ("US", "S") and self.is_mark(i + 1, "$") and not self.gap(i + 1):
            return CURRENCIES[raw + "$"], 2
        if raw in CURRENCIES:
            return CURRENCIES[raw], 2 if raw == "RP" and self.is_mark(i + 1, ".") and not self.gap(i + 1) else 1
        return "", 0

    def unit(self, i: int) -> tuple[str, int, int]:
        """(unit, factor, tokens) of a unit of time at token i."""
        p, n = self.phrase(i)
        if p in SHORT_UNITS:
            return SHORT_UNITS[p], 1, n
        if i < len(self.low) and self.low[i] in LONG_UNITS:
            return "mo", LONG_UNITS[self.low[i]], 1
        return "", 0, 0

    def bracket(self, i: int) -> int:
        """The token behind a bracket that opens at token i, or i."""
        if not self.is_mark(i, "("):
            return i
        for j in range(i + 1, len(self.tokens)):
            if self.is_mark(j, ")"):
                return j + 1
            if self.is_mark(j, "("):
                break
        return i

    def date(self, i: int) -> tuple[datetime.date | None, int]:
        """(day, tokens) of a date that begins at token i."""
        low, t, whole, full = self.low, self.tokens, self.whole, self.full
        day = month = year = None
        n = 0
        if low[i] == "ngày" and whole(i + 1, 2) and low[i + 2 : i + 3] == ["tháng"] and whole(i + 3, 2) and low[i + 4 : i + 5] == ["năm"] and full(i + 5):
            day, month, year, n = int(low[i + 1]), int(low[i + 3]), int(low[i + 5]), 6
        elif t[i][0] == 1:
            behind = low[i + 1] if i + 1 < len(low) else ""
            if t[i][1].isdigit() and behind not in "/-" and behind not in _BEHIND_DAY or not behind and t[i][1].isdigit():
                return None, 0
            # day, month and year in figures: points stay within one token
            parts, j = re.split(r"[.,]", t[i][1]), i + 1
            while len(parts) < 3 and self.is_mark(j, "/-") and not self.gap(j) and self.is_number(j + 1) and not self.gap(j + 1):
                parts, j = parts + re.split(r"[.,]", t[j + 1][1]), j + 2
            if len(parts) == 3 and "," not in t[i][1] and len(parts[0]) <= 2 and len(parts[1]) <= 2 and len(parts[2]) == 4:
                day, month, year, n = *map(int, parts), j - i
            elif whole(i, 2):
                j = i + 1
                j += j < len(low) and low[j] in ORDINALS and not self.gap(j)
                if j < len(low) and low[j] in _MONTH:
                    end = j + 1
                    end += self.is_mark(end, ".")
                    end += self.is_mark(end, ",")
                    if full(end):
                        day, month, year, n = int(low[i]), _MONTH[low[j]], int(low[end]), end + 1 - i
        elif low[i] in _MONTH:
            j = i + 1
            j += self.is_mark(j, ".")
            if whole(j, 2):
                end = j + 1
                end += end < len(low) and low[end] in ORDINALS and not self.gap(end)
                end += self.is_mark(end, ",")
                if full(end):
                    day, month, year, n = int(low[j]), _MONTH[low[i]], int(low[end]), end + 1 - i
        try:
            return (datetime.date(year, month, day), n) if n else (None, 0)
        except ValueError:
            return None, 0

    def counted(self, i: int) -> tuple[int | None, int]:
        """(number, token behind it) of a number at token i, in digits or words, with a bracket that repeats it; digits win."""
        if self.is_number(i):
            raw = self.tokens[i][1]
            after = self.bracket(i + 1)
            if after > i + 1 and len(self.span(i + 1, after)) > 42:
                after = i + 1
            return (int(raw), after) if raw.isdigit() and len(raw) <= 4 else (None, i)
        table = _VI if self.low[i] in _VI else _EN if self.low[i] in _EN else None
        if table is None:
            return None, i
        j = i
        while j < len(self.low) and (self.low[j] in table or self.is_mark(j, "-") and table is _EN and j + 1 < len(self.low) and self.low[j + 1] in table):
            j += 1
        words = [w for w in self.low[i:j] if w != "-"]
        if self.is_mark(j, "(") and self.is_number(j + 1) and self.is_mark(j + 2, ")"):
            raw = self.tokens[j + 1][1]
            return (int(raw) if raw.isdigit() and len(raw) <= 4 else None), j + 3
        # 'năm' is five and year: behind other words, and before no unit, it is the year
        if table is _VI and self.low[j - 1] == "năm" and j - i > 1 and not self.unit(j)[2]:
            return spoken(words[:-1]), j - 1
        return spoken(words), j

    def spelled(self, i: int) -> dict | None:
        """A figure at token i, perhaps with a currency, followed by words in brackets."""
        j = i + 1
        if j >= len(self.tokens) or self.low[j] != "(" and not _monetary(self.low[j]):
            return None
        code = self.currency(j)[1] if j < len(self.tokens) and self.gap(j) <= 1 else 0
        j += code
        after = self.bracket(j)
        if after - j < 3 or any(self.is_number(k) for k in range(j, after)):
            return None
        inner = self.text[self.tokens[j][3] : self.tokens[after - 1][2]].strip()
        if not 3 <= len(inner) <= 200:
            return None
        for mark in IN_WORDS:
            if inner.lower().startswith(mark):
                inner = inner[len(mark) :].strip()
                break
        inner = inner.removeprefix(":").strip()
        words = [m.group(2).lower() for m in _TOKEN.finditer(inner) if m.group(2)]
        own = [w for w in words if w not in MONEY_WORDS]
        value = spoken(own)
        if value is None and not any(w in _VI or w in _EN for w in own):
            return None
        return {"figure": figure(self.tokens[i][1])[0], "words_value": value, "words": inner, "span": self.span(i, after), "_end": after}

    def money(self, i: int) -> bool:
        """Whether a currency can stand beside the number at token i."""
        low = self.low
        return _monetary(low[i - 1]) or low[i - 1] == "." or i + 1 < len(low) and _monetary(low[i + 1])

    def amount(self, i: int) -> tuple[dict, int, int] | None:
        """(amount, first token, token behind) for a number at token i with its currency before or behind it."""
        value, length = figure(self.tokens[i][1])
        start, end = self.tokens[i][2], self.tokens[i][2] + length
        for back in (2, 1):
            code, n = self.currency(i - back)
            if n == back and self.gap(i) <= 1 and start == self.tokens[i][2] and self.tokens[i - back][2] not in self.taken:
                return {"currency": code, "value": value, "span": self.text[self.tokens[i - back][2] : end]}, i - back, i + 1
        if length == len(self.tokens[i][1]) and i + 1 < len(self.tokens) and self.gap(i + 1) <= 1:
            code, n = self.currency(i + 1)
            if n:
                self.taken.add(self.tokens[i + 1][2])
                return {"currency": code, "value": value, "span": self.span(i, i + 1 + n)}, i, i + 1 + n
        return None

    def found(self) -> dict:
        out: dict = {"amounts": [], "percents": [], "tax_codes": [], "dates": [], "spelled": [], "numbers": []}
        long, short, rest = [], [], []
        self.taken: set[int] = set()  # currencies that belong to the number before them
        skip = timed = 0  # tokens up to here belong to a date, or to a period
        for i, (kind, raw, start, end) in enumerate(self.tokens):
            if i < skip:
                continue
            word = self.low[i]
            if kind != 1 and word not in _STARTS:
                continue
            if kind == 1 or word == "ngày" or word in _MONTH:
                day, n = self.date(i)
                if n:
                    out["dates"].append({"value": day, "span": self.span(i, i + n)})
                    self.use(i, i + n)
                    skip = i + n
                    continue
            if kind == 1:
                rest.append(i)
                if self.money(i) and (amount := self.amount(i)):
                    out["amounts"].append(amount[0])
                    self.use(amount[1], amount[2])
                if spelled := self.spelled(i):
                    self.use(i, spelled.pop("_end"))
                    out["spelled"].append(spelled)
                if self.phrase(i + 1)[0] in PERCENTS:
                    out["percents"].append(figure(raw)[0])
                    self.use(i, i + 2)
                if raw.isdigit() and len(raw) == 10:
                    tail = self.is_mark(i + 1, "-") and not self.gap(i + 1) and self.is_number(i + 2) and not self.gap(i + 2) and len(self.tokens[i + 2][1]) == 3 and self.tokens[i + 2][1].isdigit()
                    out["tax_codes"].append(self.span(i, i + 3) if tail else raw)
                    self.use(i, i + 3 if tail else i + 1)
            if i >= timed and (kind == 1 or word in _VI or word in _EN):
                n, j = self.counted(i)
                unit, factor, size = self.unit(j) if j > i else ("", 0, 0)
                if size and n and (unit != "mo" or n < 1000):
                    (long if unit == "mo" else short).append({"value": n * factor, "unit": unit, "span": self.span(i, j + size)})
                    self.use(i, j + size)
                timed = j + size if size and n else max(j, i + 1) if kind == 2 else timed
        out["periods"] = long + short
        taken = []
        for a, b in sorted(self.used):
            if taken and a <= taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        starts, ends = [a for a, _ in taken], [b for _, b in taken]
        for i in rest:
            k = bisect_right(starts, self.tokens[i][2])
            if (not k or ends[k - 1] <= self.tokens[i][2]) and (n := self.standalone(i)) is not None:
                out["numbers"].append(n)
        return out

    def standalone(self, i: int) -> int | None:
        """The number at token i, which is part of no other value, if it is whole and neither an article's number nor a list mark."""
        _, raw, start, end = self.tokens[i]
        if not re.fullmatch(r"\d{1,9}(?:[.,]\d+)?", raw) or self.text[end : end + 1] in (".", ",") or start and self.text[start - 1] in ".,":
            return None
        if self.leads(i) and len(raw) <= 2 and self.text[end : end + 1] == ")" and self.text[end + 1 : end + 2].isspace():
            return None
        if i and self.low[i - 1] in ARTICLE_HEADS and self.leads(i - 1) and not self.leads(i) and (not self.tokens[i - 1][2] or self.text[self.tokens[i - 1][2] - 1] == "\n"):
            return None
        return int(float(raw.replace(",", ".")))


def _read(text: str | None) -> dict:
    return Walk(text or "").found()


@F.arrow_udf(RESULT)
def values(texts: pa.Array) -> pa.Array:
    """All values of a text: (amounts, percents, tax_codes, dates, periods, spelled, numbers), each in order of the text; periods in months first."""
    parts = [pa.array([_read(t) for t in texts.slice(i, SLICE).to_pylist()], KIND) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], KIND)


@F.arrow_udf(_struct({"text": StringType(), "v": RESULT}))
def normal_values(texts: pa.Array) -> pa.Array:
    """(text, v): a text in normal form C and its values, in one pass through Python."""
    kind, parts = pa.struct([("text", pa.string()), ("v", KIND)]), []
    for i in range(0, len(texts), SLICE):
        normal = [unicodedata.normalize("NFC", t or "") for t in texts.slice(i, SLICE).to_pylist()]
        parts.append(pa.array([{"text": t, "v": _read(t)} for t in normal], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(LongType())
def words_to_int(texts: pa.Array) -> pa.Array:
    """A number in Vietnamese or English words; null if a word is none."""
    own = [[w for w in re.split(r"[\s,-]+", (t or "").lower()) if w and w not in ("đồng", "dong", "vnd")] for t in texts.to_pylist()]
    return pa.array([spoken(w) for w in own], pa.int64())


def amounts(text: Column) -> Column:
    """(currency, value, span) of every amount whose currency stands before or behind it."""
    return values(text)["amounts"]


def percents(text: Column) -> Column:
    return values(text)["percents"]


def tax_codes(text: Column) -> Column:
    return values(text)["tax_codes"]


def dates(text: Column) -> Column:
    """(value, span) of every valid date: day first in figures, or with an English month or in Vietnamese."""
    return values(text)["dates"]


def periods(text: Column) -> Column:
    """(value, unit, span) of durations in months (mo) and of shorter periods: hours (h), days (d), working days (bd), weeks (w)."""
    return values(text)["periods"]


def durations(text: Column) -> Column:
    """Durations in months; a year has twelve. Dates are no durations."""
    return F.transform(F.filter(periods(text), lambda x: x["unit"] == "mo"), lambda x: x["value"].cast("int"))


def figures_with_words(text: Column) -> Column:
    """(figure, words_value, words, span) of figures followed by the same amount in words, in brackets; words_value is null if they can't be read."""
    return values(text)["spelled"]


def standalone_numbers(text: Column) -> Column:
    """Whole numbers outside of all other values, article numbers and list marks."""
    return values(text)["numbers"]


def negated(text: Column, language: str) -> Column:
    return F.coalesce(text.rlike(NEGATIONS.get(language, NEGATIONS["en"])), F.lit(False))
