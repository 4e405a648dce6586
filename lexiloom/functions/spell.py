"""Numbers, dates, times, addresses and money as words: small pure functions, and one Arrow UDF around them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from lexiloom.functions.text import DIGITS

_SCALES = ["", " nghìn", " triệu", " tỷ"]


def digits_vi(number: str) -> str:
    """Each digit on its own."""
    return " ".join(DIGITS[c] for c in number if c in DIGITS)


def _group_vi(n: int, inner: bool) -> str:
    """A number below 1000; ``inner`` groups say their empty hundreds."""
    hundreds, tens, ones = n // 100, n // 10 % 10, n % 10
    out = [f"{DIGITS[str(hundreds)]} trăm"] if hundreds or inner else []
    if tens > 1:
        out.append(f"{DIGITS[str(tens)]} mươi")
    elif tens == 1:
        out.append("mười")
    elif ones and out:
        out.append("lẻ")
    if ones == 1 and tens > 1:
        out.append("mốt")
    elif ones == 5 and tens:
        out.append("lăm")
    elif ones:
        out.append(DIGITS[str(ones)])
    return " ".join(out)


def number_vi(number: str) -> str:
    """A whole number below 10^12 in words; longer ones digit by digit."""
    if len(number) > 12:
        return digits_vi(number)
    n = int(number)
    if n == 0:
        return DIGITS["0"]
    groups = []
    while n:
        n, rest = divmod(n, 1000)
        groups.append(rest)
    out = []
    for k in range(len(groups) - 1, -1, -1):
        if groups[k]:
            out.append(_group_vi(groups[k], k < len(groups) - 1) + _SCALES[k])
    return " ".join(out)


def date_vi(day: str | None, month: str, year: str | None) -> str:
    parts = ([f"ngày {number_vi(day)}"] if day else []) + [f"tháng {number_vi(month)}"] + ([f"năm {number_vi(year)}"] if year else [])
    return " ".join(parts)


def time_vi(hours: str, minutes: str, seconds: str | None = None) -> str:
    """Full hours say no minutes."""
    out = f"{number_vi(hours)} giờ"
    if int(minutes) or seconds:
        out += f" {number_vi(minutes)} phút"
    return out + (f" {number_vi(seconds)} giây" if seconds else "")


_SIGNS = {".": "chấm", "-": "gạch ngang", "@": "a còng", "_": "gạch dưới", "+": "cộng", "%": "phần trăm", "/": "xuyệt", ":": "hai chấm"}


def address_vi(address: str) -> str:
    """An e-mail or web address: words as they are, digits one by one, signs by name, others dropped."""
    parts = re.findall(r"[^\W\d_]+|\d|\S", address)
    return " ".join(p if p.isalpha() else DIGITS.get(p) or _SIGNS.get(p, "") for p in parts if p.isalpha() or p in DIGITS or p in _SIGNS)


def dollars_en(amount: str) -> str:
    """Digits after the point are cents as they stand: 5.5 is 5 cents."""
    parts = amount.replace(",", "").split(".")
    if len(parts) > 2:
        return f" {amount} dollars "
    whole, cents = (int(p) if p else 0 for p in (*parts, "")[:2])
    said = [f"{n} {unit}{'' if n == 1 else 's'}" for n, unit in ((whole, "dollar"), (cents, "cent")) if n]
    return f" {', '.join(said) or 'zero dollars'} "


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_BIG = [(10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")]


def number_en(n: int, link: str = " ") -> str:
    """A whole number in words; ordinals and fractions have " and " as the ``link`` behind hundreds."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    size, name = next(x for x in _BIG if n >= x[0])
    rest = n % size
    return f"{number_en(n // size, link)} {name}" + (f"{link if size == 100 else ' '}{number_en(rest, link)}" if rest else "")


def year_en(n: int) -> str:
    """1001 to 2999 as years are said."""
    if n == 2000:
        return "two thousand"
    if 2000 < n < 2010:
        return f"two thousand {number_en(n % 100)}"
    if n % 100 == 0:
        return f"{number_en(n // 100)} hundred"
    low = n % 100
    return f"{number_en(n // 100)} {'oh ' if low < 10 else ''}{number_en(low)}"


_IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def ordinal_en(n: int) -> str:
    """The last word of the number in its ordinal form."""
    head, sep, last = re.match(r"^(.*?)([ -]?)([a-z]+)$", number_en(n, " and ")).groups()
    if last in _IRREGULAR:
        last = _IRREGULAR[last]
    else:
        last = f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th"
    return f"{head}{sep}{last}"


def fraction_en(above: int, below: int) -> str:
    """Halves and quarters by name, others by the ordinal of what stands below."""
    named = {2: ("half", "halves"), 4: ("quarter", "quarters")}
    if below in named:
        return f"{number_en(above, " and ")} {named[below][above != 1]}"
    return f"{number_en(above, " and ")} {ordinal_en(below)}"


_ROMAN = {"I": 1, "V": 5, "X": 10}
#: Words after which I, V and X are a number.
_BEFORE_ROMAN = ["thế kỷ", "thế kỉ", "chương", "phần", "kỳ", "khóa", "khoá", "quý", "hạng", "mục", "đại hội"]


def roman(text: str) -> int:
    """Value of a numeral of I, V and X; 0 where it is none that is written so."""
    values = [_ROMAN[c] for c in text.upper()]
    n = sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))
    tens, ones = divmod(n, 10)
    return n if 0 < n < 40 and text.upper() == "X" * tens + ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][ones] else 0


# In this order: what an earlier pattern takes, a later one does not see as it was.
_VI_RULES = [
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), lambda m: f" {address_vi(m[0])} "),
    (re.compile(r"(?:https?://|www\.)[^\s,;]+[^\s,;.!?]"), lambda m: f" {address_vi(m[0])} "),
    (re.compile(r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)"), lambda m: f" {date_vi(m[1], m[2], m[3])} "),
    (re.compile(r"(?<!\d)(\d{4})\s?[-–]\s?(\d{4})(?!\d)"), lambda m: f" {number_vi(m[1])} đến {number_vi(m[2])} "),
    (re.compile(r"(?<=\s)U[-.]?(\d\d)(?=[\s.,)])"), lambda m: f"U {m[1]}"),
    (re.compile(r"(?<!\w)(\d+)\s*[x×]\s*(?=\d)"), lambda m: f"{m[1]} nhân "),
    (re.compile(rf"(?i)\b({'|'.join(_BEFORE_ROMAN)})\s+([IVX]+)\b"), lambda m: f"{m[1]} {number_vi(str(n)) if (n := roman(m[2])) else m[2]}"),
    (re.compile(r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?(?!\d)"), lambda m: f" {time_vi(m[1], m[2], m[3])} "),
    (re.compile(r"(?<!\d)(\d{1,2})[hg](\d{2})(?!\d)"), lambda m: f" {time_vi(m[1], m[2])} "),
    (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{3})+(?![\d.])"), lambda m: f" {number_vi(m[0].replace('.', ''))} "),
    (re.compile(r"(?<!\d)(\d+),(\d+)(?!\d)"), lambda m: f" {number_vi(m[1])} phảy {digits_vi(m[2])} "),
    (re.compile(r"(?<!\d)(\d+)\.(\d+)(?!\d)"), lambda m: f" {number_vi(m[1])} chấm {digits_vi(m[2])} "),
    (re.compile(r"\d+"), lambda m: f" {number_vi(m[0])} "),
]


def _ascii_digits(text: str) -> str:
    return re.sub(r"\d", lambda m: str(int(m[0])), text)


def speak_vi(text: str) -> str:
    text = _ascii_digits(text)
    for pattern, said in _VI_RULES:
        text = pattern.sub(said, text)
    return re.sub(r"\s+", " ", text).strip()


_EN_RULES = [
    (re.compile(r"[0-9][0-9,]+[0-9]"), lambda m: m[0].replace(",", "")),
    (re.compile(r"£([0-9,]*[0-9]+)"), lambda m: f"{m[1]} pounds"),
    (re.compile(r"\$([0-9.,]*[0-9]+)"), lambda m: dollars_en(m[1])),
    (re.compile(r"([0-9]+)/([0-9]+)"), lambda m: f" {fraction_en(int(m[1]), int(m[2]))} " if max(len(m[1]), len(m[2])) < 16 else m[0]),
    (re.compile(r"([0-9]+)\.([0-9]+)"), lambda m: f"{m[1]} point {m[2]}"),
    (re.compile(r"([0-9.,]*[0-9]+)%"), lambda m: f"{m[1]} percent "),
    (re.compile(r"([0-9]{1,15})(?:st|nd|rd|th)\b"), lambda m: f" {ordinal_en(int(m[1]))} "),
    (re.compile(r"[0-9]+"), lambda m: f" {year_en(int(m[0])) if 1000 < int(m[0]) < 3000 else number_en(int(m[0])) if len(m[0]) < 16 else ' '.join(_ONES[int(c)] for c in m[0])} "),
]


def speak_en(text: str) -> str:
    for pattern, said in _EN_RULES:
        text = pattern.sub(said, text)
    return re.sub(r"\s+", " ", text).strip()


SPEAKERS = {"vi": speak_vi, "en": speak_en}


def speak(text: Column, language: str) -> Column:
    """All callback rules of a language in one crossing of Arrow; null stays null."""
    said = SPEAKERS[language]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else said(t))

    return run(text)


def replace_words(text: Column, words: list[tuple[str, str]]) -> Column:
    """Whole words by a dictionary, longest key first, whatever their case; one pass."""
    table = {k.lower(): v for k, v in words}
    keys = sorted(table, key=len, reverse=True)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not keys:
            return texts
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, keys)) + r")\b", re.I)
        return texts.map(lambda t: None if t is None else pattern.sub(lambda m: table.get(m[0].lower(), m[0]), t))

    return run(text)
