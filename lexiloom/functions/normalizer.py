"""Spoken forms by span claims.

A text is read by the rules in their order. A rule claims spans and says what they become;
a claimed span is closed to all later rules, which see blanks and a letter in its place. The
text is rebuilt once from its claims, where they are made: finding each place anew in a long
text would cost its square. Claims also come out as an array column with offsets, so
they can be counted, joined and checked; the signs and blanks after it
are Spark's own expressions. A rule speaks only at its own match; equal strings elsewhere in
the text are not touched.

Between rules the reading may change, place by place: line ends are read as blanks, brackets
as commas. What is written changes only by claims and by the steps after them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions import text as X
from lexiloom.functions.spell import digits_vi, number_vi
from lexiloom.operators.relational import settled

# Word lists, units and signs whose content must be as it is for right results.
LENGTHS = {
    "nm": "na nô mét", "µm": "mi cờ rô mét", "mm": "mi li mét", "cm": "xen ti mét", "dm": "đề xi mét", "dam": "đề ca mét", "hm": "héc tô mét", "km": "ki lô mét", "m": "mét",
}
PER_TIME = {"s": "giây", "giây": "giây", "h": "giờ", "giờ": "giờ"}
RATES = {
    "kWh/ngày": "ki lô goát giờ trên ngày", "/tấn": "trên tấn", "/thùng": "trên thùng", "/căn": "trên căn", "/cái": "trên cái", "/con": "trên con", "/lần": "trên lần", "/năm": "trên năm",
    "/tháng": "trên tháng", "/ngày": "trên ngày", "/giờ": "trên giờ", "/phút": "trên phút", "đ/CP": "đồng trên cổ phiếu", "đ/lít": "đồng trên lít", "đ/lượt": "đồng trên lượt",
    "người/": "người trên", "giờ/": "giờ trên", " lít/": "lít trên", "./": "", "mmol/l": "mi li mon trên lít", "mg/": "mi li gam trên", "kg/": "ki lô gam trên", "cái/": "cái trên",
    "triệu/": "triệu trên", "g/km": "gam trên ki lô mét", "m3/h": "mét khối trên giờ", "m3/s": "mét khối trên giây", "Mb/s": "mê ga bít trên giây", "đồng/": "đồng trên", "USD/": "u ét đê trên",
    "/kg": "trên một ki lô gam",
}
# Units whose case tells them apart, and those that are read in any case.
CASED_UNITS = {
    "mAh": "mi li am pe", "Nm": "Niu tơn mét", "KB": "ki lô bai", "Mb": "mê ga bai", "MB": "mê ga bai", "Gb": "ghi ga bai", "GB": "ghi ga bai", "gb": "ghi ga bai", "TB": "tê ra bai",
    "kHz": "ki lô héc", "GHz": "ghi ga héc", "MHz": "mê ga héc", "Hz": "héc", "hPa": "héc tô pa xcan", "GPa": "ghi ga pa xcan", "MPa": "mê ga pa xcan", "kPa": "ki lô pa xcan",
    "mPa": "mi li pa xcan", "Pa": "pa xcan", "Mbps": "mê ga bít trên giây", "USD": "u ét đê", "VNĐ": "việt nam đồng", "vnđ": "việt nam đồng", "Km2": "ki lô mét vuông", "Kg": "ki lô gam",
    "kWh": "ki lô goát giờ", "kWp": "ki lô goát pi", "kW": "ki lô goát", "kV": "ki lô vôn",
}
UNITS = {
    "bpm": "nhịp trên phút", "kmh": "ki lô mét trên giờ", "%": "phần trăm", "º": "độ", "ounce": "ao", "byte": "bai", "dm3": "đề xi mét khối", "cm3": "xen ti mét khối", "m3": "mét khối",
    "atm": "át mốt phia", "bar": "ba", "$": "đô la", "Euro": "ơ rô", "km2": "ki lô mét vuông", "cm2": "xen ti mét vuông", "mm2": "mi li mét vuông", "m2": "mét vuông", "hecta": "héc ta",
    "km": "ki lô mét", "cm": "xen ti mét", "mm": "mi li mét", "nm": "na nô mét", "inch": "inh", "m": "mét", "ml": "mi li lít", "gr": "gam", "cc": "xê xê", "kg": "ki lô gam",
    "grams": "gờ ram", "mg": "mi li gam", "oC": "độ xê", "°C": "độ xê", "ºC": "độ xê", "ºF": "độ ép", "oF": "độ ép",
}
MULTIPLIERS = "chục|trăm|nghìn|ngàn|triệu|tỷ"
MATH = {
    "²": "bình phương", "³": "lập phương", "π": "pi", "√": "căn bậc hai", "∞": "vô cùng", "∑": "tổng", "≤": "nhỏ hơn hoặc bằng", "≥": "lớn hơn hoặc bằng", "≠": "khác", "≈": "xấp xỉ",
    "±": "cộng trừ", "×": "nhân", "÷": "chia", "−": "trừ", "→": "suy ra", "←": "ngược lại", "↔": "tương đương", "Δ": "đen ta", "α": "an pha", "β": "bê ta", "γ": "gam ma", "δ": "đen ta",
    "θ": "tê ta", "λ": "lam đa", "μ": "mu", "σ": "xích ma", "φ": "phi", "ω": "ô mê ga",
}
ALPHABET = {
    "a": "a", "b": "bê", "c": "xê", "d": "đê", "e": "e", "f": "ép", "j": "di", "g": "gờ", "h": "hát", "i": "i", "k": "ca", "l": "lờ", "m": "mờ", "n": "nờ", "o": "o", "p": "pê", "q": "quy",
    "r": "rờ", "s": "ét", "t": "tê", "u": "u", "v": "vê", "x": "ích", "y": "i", "w": "vê kép", "z": "dét",
}
PLATE = r"\b(?:\d{2}[A-Z]{1,2}\d?-?\d{3}\.\d{2}|\d{2}-\d{3}-[A-Z]{2}-\d{2}|[A-Z]{2}-\d{2}-\d{2}|\d{2}-[A-Z]{2}-\d{3}-\d{2})\b"
PLATE_WORDS = "[Bb]iển [Kk]iểm [Ss]oát|[Bb]iển [Ss]ố xe|[Bb]iển [Ss]ố"
LANES = "[Nn]gõ|[Nn]gách|[Hh]ẻm"
SHARE_WORDS = "thứ|hơn|gần|:|hạng|được|tới|góp|là|có|còn|lên|bằng|[Cc]hiếm|giảm|tỷ lệ|tỉ lệ|[Kk]hoảng|online"
MEASURES = "muỗng|thìa|ly|cốc|chén|chai|lọ"
DECREES = "[Nn]ghị [Đđ]ịnh|[Nn]ghị [Qq]uyết|[Tt]hông [Tt]ư liên tịch|[Tt]hông [Tt]ư"
PHONE_WORDS = (
    "[hH]otline|[Tt]ổng đài|[Đđ]iện thoại|[Ss]ố điện thoại|SDT|SĐT|[zZ]alo|đường dây nóng|[Ll]iên hệ|gọi|call|chi tiết|hỗ trợ|tư vấn|liên lạc|công ty|[bB]án [hH]àng|[đĐ]ặt hàng"
)
PHONE = r"\+?\d{8,12}|\d{3,5}\s\d{3,4}\s\d{3,4}|\d{4}\.\d{3}\.\d{3}|\d{3}\.\d{3}\.\d{4}|\d{3}\.\d{4}\.\d{3}|\d{4}\s\d{2}\s\d{2}\s\d{2}"
SPORT_WORDS = (
    "tỷ số|chiến thắng|trận đấu|tỉ số|bàn thắng|trên sân|đội bóng|thi đấu|cầu thủ|vô địch|mùa giải|đánh bại|đối thủ|bóng đá|gỡ hòa|chung kết|bán kết|ghi bàn|chủ nhà|tiền đạo|dứt điểm|tiền vệ|thua|bị dẫn"
)
DATE_WORDS = (
    "sau ,|mai ,|qua ,|nay ,|sớm|đến hết|[đĐ]ợt|[Pp]hiên|[Nn]gày|[Dd]ịp|[Ss]áng|[Tt]rưa|[Cc]hiều|[Tt]ối|[Đđ]êm|[Mm]ùng|[Hh]ôm|nay|[Ss]áng qua|[Tt]ưa qua|[Cc]hiều qua|[Tt]ối qua|[Đđ]êm qua|[Hh]ôm qua"
    "|[Hh]ôm sau|mai|[Vv]ào|[Kk]éo dài tới|[Dd]ự kiến tới|[Đđ]ến|[Tt]ới|[Tt]ừ"
)
PART_OF_DAY = "[Ss]áng|[Tt]rưa|[Cc]hiều|[Tt]ối|[Ll]ễ|[Tt]ết|[Hh]ôm|[Đđ]ợt"
RANGE_WORDS = "hơn|kém|gấp|tăng|tầm|giảm|liệu trình|nhất|tới|có|sau|mức|tuổi|từ|tăng tốc|được|khoảng|trong|vòng|dao động|cấp|tốc độ"
RANGE_UNITS = (
    "lần|cái|khách|túi|ki lô gam|kg|hôm|ngày|muỗng|thìa|phút|gói|tháng|năm|tiếng|mét|ca|tuổi|phần trăm|giờ|giây|xen ti mét|mi li mét|độ|lít|tấn|thùng|con|triệu|gam|hàng|m|ki lô mét|h|phòng"
)
ID_WORDS = (
    "[Cc]hứng minh nhân dân|[Cc]hứng minh thư|[Mm]ã thẻ|[Ss]ố thẻ|[Ss]ố tài khoản|[Cc]ăn cước công dân|[Cc]ăn cước|[Mm]ã số thuế|[Bb]iển số|[Mm]ã số|nhân viên|mã"
)
ROMAN_WORDS = (
    "thế hệ|số|đại hội|giai đoạn|quý|cấp|quận|kỳ|khóa|quy định|vành đai|vùng|thế kỷ|khu vực|khu|đợt|hạng|báo động|tập|lần|lần thứ|trung ương|tw|chương"
)
EMAIL, URL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"(?:https?|ftp)://\S+|www\.\S+"
REDUNDANT = [("ngày", "ngày"), ("mùng", "ngày"), ("tháng", "tháng")]
# End of the fixed values.

#: Stand in a claimed span while later rules read: a letter that no rule names, and a blank at its ends.
CLOSED, EDGE = "ʘ", "\u2003"
SPANS = "array<struct<start:int,end:int,kind:string,said:string>>"
SPAN_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("said", pa.string())]
#: Rows of a batch that are Python objects at a time.
PIECE = 64
#: The claim of a part of a match: its place and what is said.
Part = tuple[int, int, str]


class Rule(NamedTuple):
    """A pattern, what it says of a match, and texts of which one must be there for it to match."""

    kind: str
    pattern: re.Pattern
    say: Callable[[re.Match], Iterable[Part]]
    needs: tuple[str, ...] = ()
    #: Claims only behind the first match of this one.
    after: re.Pattern | None = None
    #: Whether ``needs`` are looked for in lower case.
    fold: bool = False
    #: What every match holds and is found fast; the rule is left out where it is not there.
    holds: re.Pattern | None = None


def whole(said: Callable[[re.Match], str], group: int = 0) -> Callable[[re.Match], Iterator[Part]]:
    def parts(m: re.Match) -> Iterator[Part]:
        yield m.start(group), m.end(group), f" {said(m)} "

    return parts


def signs(sign: str, said: str, group: int = 0) -> Callable[[re.Match], Iterator[Part]]:
    """Only the signs inside the group are claimed; the numbers around them stay open."""
    find = re.compile(sign)

    def parts(m: re.Match) -> Iterator[Part]:
        for x in find.finditer(m[group]):
            yield m.start(group) + x.start(), m.start(group) + x.end(), said

    return parts


def day_month(text: str) -> str:
    day, month = re.split("[/.-]", text)
    return f"ngày {number_vi(day)} tháng {number_vi(month)}"


def full_date(text: str) -> str:
    day, month, year = re.split("[/.-]", text)
    return f"ngày {number_vi(day)} tháng {number_vi(month)} năm {number_vi(year)}"


def month_year(text: str) -> str:
    month, year = re.split("[/.-]", text)
    return f"tháng {number_vi(month)} năm {number_vi(year)}"


def clock(text: str) -> str:
    """Hours, minutes and seconds; no minutes are not said."""
    n = [x for x in re.split("[:hp]", text.rstrip("s")) if x.strip()]
    said = " ".join(f"{number_vi(x)} {unit}" for x, unit in zip(n, ("giờ", "phút", "giây")))
    return said.replace(" không phút", "")


def plain_number(text: str) -> str:
    """Leading zeros one by one, then the number."""
    rest = text.lstrip("0")
    return " ".join(["không"] * (len(text) - len(rest)) + ([number_vi(rest)] if rest else []))


def decimal(whole_part: str, digits: str) -> str:
    said = plain_number(whole_part.replace(".", ""))
    return said if not digits.strip("0") else f"{said} phảy {digits_vi(digits)}"


def comma_number(text: str) -> str:
    """One comma before a number that is no multiple of a thousand parts decimals, others part thousands."""
    joined = text.replace(",", "")
    if text.count(",") == 1 and int(joined) % 1000:
        return decimal(*text.split(","))
    return plain_number(joined)


def spelled_code(text: str) -> str:
    return " ".join(ALPHABET[c.lower()] if c.isalpha() else X.DIGITS[c] for c in text)


def spoken_segments(text: str) -> str:
    """Words as they are, digits one by one, points and hyphens by name, other signs dropped."""
    said = {"_": "gạch dưới", "+": "cộng", "%": "phần trăm"}
    word = lambda w: " ".join(g if g.isalpha() else digits_vi(g) if g.isdigit() else said[g] for g in re.findall(r"[A-Za-z]+|\d+|[^A-Za-z0-9]+", w) if g.isalnum() or g in said)
    return " chấm ".join(" gạch ngang ".join(map(word, part.split("-"))) for part in text.split("."))


def spoken_email(m: re.Match) -> str:
    name, domain = m[0].split("@", 1)
    return f"{spoken_segments(name)} a còng {spoken_segments(domain)}"


def spoken_url(m: re.Match) -> str:
    scheme, _, rest = m[0].rpartition("://")
    said = " ".join(X.LETTERS[c] for c in scheme.upper()) + ", " if scheme else ""
    return said + spoken_segments(re.sub(r"^www\.", "", rest).rstrip("/"))


def roman_value(text: str) -> int:
    """Of a numeral of X, V and I as it is written; 0 for others."""
    x, rest = re.match(r"(X*)(.*)", text.upper()).groups()
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    return 10 * len(x) + ones.index(rest) if len(x) < 4 and rest in ones else 0


def spoken_roman(m: re.Match) -> Iterator[Part]:
    if n := roman_value(m[1]):
        yield m.start(1), m.end(1), f" {number_vi(str(n))} "


def unit_parts(m: re.Match) -> Iterator[Part]:
    """The unit behind a number, by its own case first."""
    said = CASED_UNITS.get(m[1]) or _UNITS_LOWER.get(m[1].lower())
    if said:
        yield m.start(1), m.end(1), f" {said} "


def hours_range(m: re.Match) -> Iterator[Part]:
    left, right = (f"{number_vi(re.search(r'[0-9]+', x)[0])}{' giờ' if 'h' in x else ''}" for x in m[0].split("-"))
    yield m.start(), m.end(), f" {left} đến {right} "


def in_day(m: re.Match, group: int = 0) -> bool:
    """Twenty-four hours and some minutes are no time."""
    return not re.match(r"24.0*[1-9]", m[group])


def time_parts(m: re.Match) -> Iterator[Part]:
    if in_day(m):
        yield m.start(), m.end(), f" {clock(m[0])} "


def time_range(m: re.Match) -> Iterator[Part]:
    if in_day(m, 1) and in_day(m, 2):
        yield m.start(), m.end(), f" {clock(m[1])} đến {clock(m[2])} "


_UNITS_LOWER = {k.lower(): v for k, v in UNITS.items()}
_RATES = {f"{k}/{t}": f"{v} trên {said}" for t, said in PER_TIME.items() for k, v in LENGTHS.items()} | RATES
_DAY, _MONTH, _END = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?=[\s|.,):;])"
_DM = rf"{_DAY}[/.]{_MONTH}"
_SPACED = rf"{_DAY}\s*/\s*{_MONTH}"
_TIME = r"\d+[:h](?:0?[0-9]|[1-5][0-9])[:p](?:[1-5][0-9]|0?[0-9])|\d+[:h](?:[1-5][0-9]|0?[0-9])|\d+h"
_ALTERNATION = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
_TIGHT = lambda text: re.sub(r"\s", "", text)


def rule(kind: str, pattern: str, say: Callable, needs: str | Iterable[str] = (), flags: int = 0, after: str | None = None, holds: str | None = None) -> Rule:
    return Rule(kind, re.compile(pattern, flags), say, tuple(needs), after and re.compile(after), bool(flags & re.I) or kind == "score", holds and re.compile(holds))


def _ends(said: Callable[[str], str], other: Callable[[str], str]) -> Callable[[re.Match], Iterator[Part]]:
    """A range whose two ends are the groups of the match."""
    return whole(lambda m: f"{said(_TIGHT(m[1]))} đến {other(_TIGHT(m[2]))}")


ADDRESSES = [
    rule("email", EMAIL, whole(spoken_email), "@"),
    rule("url", URL, whole(spoken_url), ("://", "www.")),
]

_SYMBOLS = [rule("percent", rf"\d\s*(%\s*/\s*)(?=(?:{'|'.join(X.PER_UNITS)})(?:[\s.,;:!?)\]}}]|$))", lambda m: [(m.start(1), m.end(1), " phần trăm trên ")], "%", re.I)] + [
    rule("symbol", rf"(?<!\w){re.escape(key)}(?=[\s,.:;!?)\]}}\w]|$)", whole(lambda m, said=said: said), key) for key, said in X.VERBATIM
]
_PLATES_AND_UNITS = [
    rule("plate", PLATE, whole(lambda m: " ".join(X.DIGITS.get(c, c) for c in m[0] if c.isalnum())), "-."),
    rule("plate", rf"(?:{PLATE_WORDS})\s*.{{0,40}}?[0-9]+[a-zA-Z]+[0-9]*(?:\s|-)+([0-9]+\.[0-9]+)", whole(lambda m: digits_vi(m[1]), 1), ("iển",)),
    rule("plate", rf"(?:{PLATE_WORDS})\s*.{{0,40}}?[0-9]+[a-zA-Z]+[0-9]*\s*[-.\s]\s*([0-9]+)", whole(lambda m: digits_vi(m[1]), 1), ("iển",)),
    rule("ratio", r"\b\d+:\d+\b", signs(":", " "), ("tỉ lệ",), re.I),
    rule("rate", _ALTERNATION(_RATES), whole(lambda m: _RATES[m[0]]), "/"),
    rule("unit", rf"[+-]?\d+(?:[.,]\d+)*\s*(?:(?:{MULTIPLIERS})\s*)?({_ALTERNATION({**UNITS, **CASED_UNITS})})(?=\s|[.,;:)\]}}!?\-\"'…/]|$)", unit_parts, flags=re.I),
    rule("star", r"(?:đánh giá|rate)\s+[0-9]+([*|⭐★])", whole(lambda m: "sao", 1), "*|⭐★"),
    rule("address", rf"(?:{LANES})\s([0-9]+\s*/\s*[0-9]+(?:/[0-9]+)?)", signs(r"\s*/\s*", " trên ", 1), "/"),
]
_SHARES = [
    rule("share", rf"(?:{SHARE_WORDS})\s([0-9]+)\s*/\s*([0-9]+)(?=[\s|.,);])", lambda m: [(m.start(1), m.end(2), f" {plain_number(m[1])} phần {plain_number(m[2])} ")], "/"),
    rule("share", rf"(?<=\s)([0-9]+)\s*/\s*([0-9]+)(?=\s*(?:{MEASURES}))", whole(lambda m: f"{plain_number(m[1])} phần {plain_number(m[2])}"), "/"),
    rule("decree", rf"(?:{DECREES})\s*([0-9]+\s*/\s*[0-9]+(?:/[0-9]+)?)", signs(r"\s*/\s*", ", năm ", 1), "/"),
    rule("per", r"(?<=\s)[^\W\d_]+(/)", signs("/", " trên ", 1), "/"),
]
_FRACTION = rule("fraction", r"(?<![a-zA-ZÀ-ỹ])(\d{1,3})\s*/\s*(\d{1,3})(?=[\s.,;:!?)\]}]|$)", whole(lambda m: f"{plain_number(m[1])} trên {plain_number(m[2])}"), "/")
_CALLS = [
    rule("phone", rf"(?:{PHONE_WORDS})[\s:.]+({PHONE})", whole(lambda m: digits_vi(m[1]), 1), holds=r"\d\d\d"),
    rule("times", r"[0-9](\s*x\s*)(?=[0-9]|[.,]+[0-9])", signs(r"\s*x\s*", " nhân ", 1), "x"),
    rule("score", r"(?<=\s)[0-9]+[-:][0-9]+", signs("[-:]", " "), after=None, needs=tuple(SPORT_WORDS.split("|"))),
]
_DATES = [
    rule("date_range", rf"(?<=\s)(\d{{4}})\s*-\s*(\d{{4}})(?=[\s|.,)])", _ends(lambda y: f"năm {number_vi(y)}", lambda y: f"năm {number_vi(y)}"), "-"),
    rule("date_range", rf"(?<=\s)({_DM}[/.]\d{{4}})\s*-\s*({_DM}[/.]\d{{4}})(?=[\s|.,)])", _ends(full_date, full_date), "-"),
    rule("date_range", rf"(?<=\s)({_DAY})\s*-\s*({_DM}[/.]\d{{4}})(?=[\s|.,)])", _ends(lambda d: f"ngày {number_vi(d)}", full_date), "-"),
    rule("date_range", rf"(?<=\s)({_DM})\s*-\s*({_DM}[/.]\d{{4}})(?=[\s|.,)])", _ends(day_month, full_date), "-"),
    rule("date_range", rf"(?<=\s)({_DM})\s*-\s*({_DM})(?=[\s|.,)])", _ends(day_month, day_month), "-"),
    rule("date_range", rf"(?<=\s)({_DAY})\s*-\s*({_DM})(?=[\s|.,)])", _ends(lambda d: f"ngày {number_vi(d)}", day_month), "-"),
    rule("date", rf"[Nn]gày\s({_DAY}\s*([/.])\s*{_MONTH}\s*[/.]\s*\d{{4}}|{_DAY}\s*-\s*{_MONTH}\s*-\s*\d{{4}}){_END}", whole(lambda m: full_date(_TIGHT(m[1])), 1), ("gày",)),
    rule("date", rf"(?<!\d)(?<!\(){_DAY}([/.\-]){_MONTH}\1(?:\d{{2}}|\d{{4}})(?![\d.])", whole(lambda m: full_date(m[0])), "/.-", holds=r"\d[/.\-]\d+[/.\-]\d"),
    rule("date", rf"(?:{DATE_WORDS})\(*\s*({_DAY}[/\-.]{_MONTH}){_END}", whole(lambda m: day_month(m[1]), 1), "/-.", holds=r"\d[/\-.]\d"),
    rule("date", rf"(?<=\s)\(*\s*({_SPACED}){_END}", whole(lambda m: day_month(_TIGHT(m[1])), 1), "/", after="[Nn]gày"),
    rule("date", rf"(?<=\s)({_MONTH}[/\-.]\d{{4}}){_END}", whole(lambda m: month_year(m[1]), 1), "/-.", holds=r"\d[/\-.]\d"),
    rule("date", rf"(?:{PART_OF_DAY})\s*\(*\s*({_SPACED}){_END}", whole(lambda m: day_month(_TIGHT(m[1])), 1), "/"),
    rule("date", rf"(?<=\s)({_SPACED})(?!\d)", whole(lambda m: day_month(_TIGHT(m[1])), 1), "/", after=PART_OF_DAY),
]
_REST = [
    rule("time_range", r"\d+\s*h?\s*-\s*\d+\s*h", hours_range, "-"),
    rule("time_range", rf"({_TIME})\s*-\s*({_TIME})", time_range, "-"),
    rule("time", rf"{_TIME}", time_parts, ":h", holds=r"\d[:h]"),
    rule("range", r"(?<=\s)[0-9]*[,.]*[0-9]+(\s*-\s*)[0-9]*[,.]*[0-9]+(?=[\s|.,)])", signs(r"\s*-\s*", " đến ", 1), "-", after=RANGE_WORDS),
    rule("range", rf"(?<=\s)[0-9]*,*[0-9]+(\s*-\s*)[0-9]*,*[0-9]+\s*(?={RANGE_UNITS}|{CLOSED})", signs(r"\s*-\s*", " đến ", 1), "-"),
    rule("id", rf"(?:{ID_WORDS})\s+.{{1,20}}?(\d{{2,20}})\b", whole(lambda m: digits_vi(m[1]), 1), ("hứng", "ã", "ố", "ước", "nhân viên")),
    rule("soccer", r"(?<=\s)(U[-.]*)(?=[0-9][0-9][\s|.,)])", whole(lambda m: "U", 1), "U"),
    rule("roman", rf"\b(?:{ROMAN_WORDS})\s+((?=[XVI])X{{0,3}}(?:IX|IV|V?I{{0,3}}))(?=[\s.,)/:;!?]|$)", spoken_roman, tuple(dict.fromkeys(w for w in ROMAN_WORDS.split("|"))), re.I),
    rule(
        "code",
        r"(?=[a-zA-Z]{0,10}\d)(?:[a-zA-Z]{1,10}\d{1,10}[a-zA-Z]{1,10}\d{1,10}|\d{1,10}[a-zA-Z]{1,10}\d{1,10}[a-zA-Z]{1,10}|[a-zA-Z]{1,10}\d{1,10}[a-zA-Z]{1,10}|\d{1,10}[a-zA-Z]{1,10}\d{1,10}|[a-zA-Z]{1,10}\d{1,10}|\d{1,10}[a-zA-Z]{1,10})",
        whole(lambda m: spelled_code(m[0])),
        holds=r"\d[a-zA-Z]|[a-zA-Z]\d",
    ),
    rule("math", f"[{''.join(MATH)}]", whole(lambda m: MATH[m[0]]), "".join(MATH)),
    rule("minus", r"(?<=\s)(-)(?=[0-9]*,*[0-9]+\s)", whole(lambda m: "âm", 1), "-"),
    rule("dash", r"\d(\s?[-–—]\s?)\d", whole(lambda m: "đến", 1), "-–—"),
    rule("dash", r"(?<=[a-zA-ZÀ-ỹ])\s*-\s*(?=[a-zA-ZÀ-ỹ])|(?<!\w)-(?!\w)|(?<=\s)-(?=\s)", lambda m: [(m.start(), m.end(), " ")], "-"),
    rule("number", r"\b\d{1,3}(?:\.\d{3})*,\d+\b", whole(lambda m: decimal(*m[0].split(","))), ","),
    rule("number", r"(?<=[\s|(])\d{1,3}(?:\.\d{3})+(?!\d)", whole(lambda m: plain_number(m[0].replace(".", ""))), "."),
    rule("number", r"(?<=[\s|(])\d+,\d+(?:,\d+)*", whole(lambda m: comma_number(m[0])), ","),
    rule("number", r"(?<=\s)(\d+)\.(\d+)(?=[\s.,;:!?)\]}]|$)", whole(lambda m: f"{plain_number(m[1])} chấm {digits_vi(m[2])}"), "."),
    rule("number", r"\d+", whole(lambda m: plain_number(m[0]))),
]
#: Rules that find something in texts without digits.
_NO_DIGITS = {"abbreviation", "email", "url", "symbol", "rate", "per", "roman", "math", "dash"}


def one_line(seen: str) -> str:
    """Line ends are read as blanks."""
    return seen.translate({10: " ", 13: " "})


_PAUSES = str.maketrans({c: " " for c in X.BLANKED if c != "*"} | {"(": " ", ")": ",", "…": "."})


def pauses(seen: str) -> str:
    """Brackets and quotes are read as blanks and commas, long dashes as hyphens between digits and commas elsewhere."""
    seen = seen.translate(_PAUSES)
    if "—" in seen or "–" in seen:
        seen = re.sub(r"(?<=\d)\s*[—–]\s*(?=\d)", lambda m: re.sub("[—–]", "-", m[0]), seen).translate({0x2014: ",", 0x2013: ","})
    return seen


def steps(table: dict[str, str] | None = None, strict: bool = False) -> list[Rule | Callable[[str], str]]:
    """All rules in their order, and between them the changes of reading.

    ``table`` has abbreviations and what they are said as. ``strict`` reads dates before
    fractions of two bare numbers; else ``21/11`` is a fraction wherever a sign follows.
    """
    fraction = [_FRACTION]
    early, late = ([], fraction) if strict else (fraction, [])
    return abbreviations(table or {}) + ADDRESSES + [one_line] + _SYMBOLS + [pauses] + _PLATES_AND_UNITS + _SHARES + early + _CALLS + _DATES + late + _REST


def abbreviations(table: dict[str, str]) -> list[Rule]:
    """Whole words of ``table``: with one closing sign left out in lower case, and between signs as they are said."""
    if not table:
        return []
    edge = r"[,.)}\]!?/\-:;]"
    low, plain = (lambda m: [(m.start(), m.end(), table[m[0]].strip().lower())], lambda m: [(m.start(), m.end(), table[m[0]].strip())])
    first = rule("abbreviation", rf"(?<!\S)(?:{_ALTERNATION(table)})(?={edge}?(?:\s|$))", low)
    return [first, rule("abbreviation", rf"(?<![^\s,.)}}\]!?/\-])(?:{_ALTERNATION(table)})(?=[\s,.)}}\]!?/\-]|$)", plain)]


def ascii_digits(text: str) -> str:
    """Digits of any script as 0-9, place by place."""
    return text if text.isascii() else re.sub(r"[^\x00-\x7F]", lambda m: str(int(m[0])) if m[0].isdecimal() else m[0], text)


def closed(n: int) -> str:
    """What later rules see in the place of a claimed span: blanks at its ends, letters between."""
    return f"{EDGE}{CLOSED * (n - 2)}{EDGE}" if n > 2 else f"{CLOSED}{EDGE}"[2 - n :]


def open_part(seen: str, a: int, b: int) -> tuple[int, int]:
    """The span without closed places: what surrounds its first sign that is not blank."""
    part = seen[a:b]
    if EDGE not in part:
        return a, b
    core = a + len(part) - len(part.lstrip())
    left, right = seen.rfind(EDGE, a, core) + 1, seen.find(EDGE, core, b)
    return max(a, left), b if right < 0 else right


def claims(text: str, rules: list[Rule | Callable[[str], str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, said) of all claims, in order of their places; they do not overlap."""
    seen = f" {ascii_digits(text)} "
    digits = re.search(r"\d", seen) is not None
    found: list[tuple[int, int, str, str]] = []
    low = None
    for r in rules:
        if not isinstance(r, Rule):
            seen = r(seen)
            continue
        if not digits and r.kind not in _NO_DIGITS:
            continue
        if r.fold and low is None:
            low = seen.lower()
        if r.needs and not any(n in (low if r.fold else seen) for n in r.needs):
            continue
        if r.holds is not None and not r.holds.search(seen):
            continue
        begin = 0
        if r.after is not None:
            first = r.after.search(seen)
            if first is None:
                continue
            begin = first.end()
        out, at = [], 0
        for m in r.pattern.finditer(seen, begin):
            for a, b, said in r.say(m):
                a, b = open_part(seen, a, b)
                out += [seen[at:a], closed(b - a) if said.strip() else EDGE * (b - a)]
                at = b
                # the blanks around the text are not its own
                found.append((max(a - 1, 0), min(b - 1, len(text)), r.kind, said))
        if out:
            seen = "".join(out) + seen[at:]
    return sorted(found)


def pieces(*columns: pa.Array) -> Iterator[tuple[list, ...]]:
    """The columns' values, a few rows at a time."""
    for at in range(0, len(columns[0]), PIECE):
        yield tuple(c.slice(at, PIECE).to_pylist() for c in columns)


def arrays_of(rows: list[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Rows of tuples as an Arrow array of arrays of structs; None is null."""
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row or ()))
    flat = list(zip(*(t for row in rows if row for t in row))) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(flat, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([row is None for row in rows]))


def claim_spans(text: Column, rules: list[Rule | Callable[[str], str]]) -> Column:
    """Array of (start, end, kind, said), offsets in characters from 0; null gives null."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([arrays_of([None if t is None else claims(t, rules) for t in own], SPAN_FIELDS) for (own,) in pieces(texts)] or [arrays_of([], SPAN_FIELDS)])

    return run(text)


def rebuilt(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with each span (start, end, said) replaced by what is said; spans are in order and do not overlap."""
    out, at = [], 0
    for start, end, said in spans:
        out += text[at:start], said
        at = end
    return "".join([*out, text[at:]])


def rewritten(use: Callable[..., str | None], *columns: Column) -> Column:
    """A text made of each row's values by ``use``, a few rows at a time."""

    @F.arrow_udf("string")
    def run(*own: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(list(map(use, *part)), pa.string()) for part in pieces(*own)] or [pa.array([], pa.string())])

    return run(*columns)


def spoken_text(text: Column, rules: list[Rule | Callable[[str], str]]) -> Column:
    """``text`` with all claims said; null gives null."""
    return rewritten(lambda t: None if t is None else rebuilt(t, [(a, b, said) for a, b, _, said in claims(t, rules)]), text)


def spaced(text: Column) -> Column:
    """A blank behind points, question marks and commas, and never more than one."""
    s = X.sub(X.single_spaces(text), r"(?U)([.?,])(?=\S)", "$1 ")
    return X.sub(s, r"(?U)([.?!,])\s{2,}", "$1 ")


def without_repeats(text: Column) -> Column:
    """Single blanks, and no second word of a pair that says the same twice."""
    s = X.strip(X.single_blanks(text))
    for first, second in REDUNDANT:
        s = X.sub(s, rf"{first}(?<![^ ]{first})(?: {second})+(?![^ ])", first)
    return s


def normalized(df: DataFrame, text_col: str = "text", out: str = "said", table: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """``df`` with the column ``out``: ``text_col`` as it is spoken.

    Claims first, then line ends, pictographs, pauses, colons and whatever cannot be spoken.
    Null stays null, an empty text empty.
    """
    made = "_made"
    written = settled(df.withColumn(made, spoken_text(F.col(text_col), steps(table, strict))), made)
    said = F.col(made)
    for step in (X.end_marks, X.remove_emoji, X.pause_signs, X.colons_to_points, X.speakable, spaced, without_repeats):
        said = step(said)
    return settled(written.withColumn(out, said), out).drop(made)
