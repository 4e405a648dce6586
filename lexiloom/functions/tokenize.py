"""Texts of several languages as tokens: typed segments, a tokenizer for each type, ids.

Tokens are built of Spark's own expressions. Libraries that are not here (phonemes,
word segmentation, pinyin of characters) are stood in for by a function of the segment's text that
users bring along; the ones given here take characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions import text as X
from lexiloom.functions.normalizer import arrays_of, pieces
from lexiloom.operators.relational import lookup_ids, settled

# The two alphabets that tell a segment's language, and the initials of a syllable.
CHINESE, LETTERS = "一-龥", "A-Za-z"
INITIALS = "zh|ch|sh|b|p|m|f|d|t|n|l|g|k|h|j|q|x|r|z|c|s|y|w"
SPEAKERS = ("[S1]", "[S2]")
# End of the fixed values.

#: Something in <> or [], one of both that never closes, and one that is no syllable.
_ENCLOSED, _LONE, _MIXED = r"[<\[][^>\]]*[>\]]", r"[<\[](?![^>\]]*[>\]])", r"<[^>\]]*\]|\[[^>\]]*[>\]]"
_SYLLABLE = r"<[^>\]]*>"
_NEITHER = rf"(?:[^{CHINESE}{LETTERS}<\[]++|{_MIXED}|{_LONE})"
#: A run of one language with what belongs to neither; only the first run may begin with that.
RUN = (
    rf"{_NEITHER}*+(?:(?:[{CHINESE}]|{_SYLLABLE})(?:[^{LETTERS}<\[]++|{_SYLLABLE}|{_MIXED}|{_LONE})*+"
    rf"|[{LETTERS}](?:[^{CHINESE}<\[]++|{_MIXED}|{_LONE})*+)|{_NEITHER}++"
)
_PART = rf"{_ENCLOSED}|(?:[^<\[]++|{_LONE})++"

Tokenizer = Callable[[Column], Column]


def typed_segments(text: Column) -> Column:
    """Array of (text, lang): lang is zh, en, pinyin (``<...>``), tag (``[...]``) or other.

    Signs and digits belong to the language before them, or at the beginning to the one
    behind. Line ends go. Null gives null, an empty text an empty array.
    """
    runs = F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit("")), F.lit(RUN), F.lit(0))

    def typed(run: Column) -> Column:
        # of what is enclosed only a syllable tells a language
        bare = F.regexp_replace(run, rf"(<)[^>\]]*(>)|{_MIXED}", "$1$2")
        lang = F.when(bare.rlike(f"[{CHINESE}]|<>"), "zh").when(bare.rlike(f"[{LETTERS}]"), "en").otherwise("other")
        kind = lambda p, own: F.when(p.rlike(rf"^{_SYLLABLE}$"), "pinyin").when(p.rlike(r"^\[[^>\]]*\]$"), "tag").otherwise(own)
        parts = F.regexp_extract_all(run, F.lit(_PART), F.lit(0))
        # a run's language is found once, not for each of its parts
        return X.once(lang, lambda own: F.transform(parts, lambda p: F.struct(p.alias("text"), kind(p, own).alias("lang"))))

    return F.flatten(F.transform(runs, typed))


def characters(text: Column) -> Column:
    """An empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def character_counts(text: Column) -> Column:
    """Array of (token, n): a text's characters and how often each occurs; null gives null."""

    @F.arrow_udf("array<struct<token:string,n:long>>")
    def run(texts: pa.Array) -> pa.Array:
        fields = [("token", pa.string()), ("n", pa.int64())]
        return pa.concat_arrays([arrays_of([None if t is None else list(Counter(t).items()) for t in own], fields) for (own,) in pieces(texts)] or [arrays_of([], fields)])

    return run(text)


def word_counts(text: Column, pattern: str) -> Column:
    """Array of (token, n): what a pattern (Python's) finds in a text and how often; null gives null."""
    found = re.compile(pattern).findall

    @F.arrow_udf("array<struct<token:string,n:long>>")
    def run(texts: pa.Array) -> pa.Array:
        fields = [("token", pa.string()), ("n", pa.int64())]
        return pa.concat_arrays([arrays_of([None if t is None else list(Counter(found(t)).items()) for t in own], fields) for (own,) in pieces(texts)] or [arrays_of([], fields)])

    return run(text)


def syllable_parts(text: Column) -> Column:
    """``<zhong1>`` as its initial, marked by a 0, and its final with the tone; what is no syllable gives nothing."""
    inner = F.regexp_replace(text, r"^<+|>+$", "")
    initial = F.regexp_extract(inner, f"^({INITIALS})?", 0)
    final = F.substring(inner, F.char_length(initial) + 1, F.char_length(inner))
    parts = F.filter(F.array(F.when(initial != "", F.concat(initial, F.lit("0"))), F.when(final != "", final)), lambda p: p.isNotNull())
    return F.when(inner.rlike(r"^(?U)\p{Alpha}+[1-5]$"), parts).otherwise(F.array().cast("array<string>"))


#: What each type of segment is tokenized by, unless a user brings other functions.
BY_TYPE: dict[str, Tokenizer] = {"zh": characters, "en": characters, "pinyin": syllable_parts, "tag": lambda t: F.array(t)}


def dispatched(segments: Column, by_type: dict[str, Tokenizer]) -> Column:
    """The tokens of all segments in order; types without a tokenizer give none."""

    def tokens(s: Column) -> Column:
        out = F.array().cast("array<string>")
        for lang, tokenizer in by_type.items():
            out = F.when(s["lang"] == lang, tokenizer(s["text"])).otherwise(out)
        return out

    return F.flatten(F.transform(segments, tokens))


def add_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "tokens", by_type: dict[str, Tokenizer] | None = None) -> DataFrame:
    """``df`` with ``out``, the tokens of ``text_col`` by a tokenizer's name: simple, emilia or dialog.

    simple takes characters; emilia maps wide signs and goes by segments; dialog also drops
    blanks around speakers' tags. Null texts have null tokens.
    """
    prepared = {"simple": lambda t: t, "emilia": X.map_wide_marks, "dialog": lambda t: X.map_wide_marks(X.trim_speaker_tags(t))}
    if tokenizer not in prepared:
        raise ValueError(f"no such tokenizer: {tokenizer}")
    made = settled(df.withColumn(out, prepared[tokenizer](F.col(text_col))), out)
    if tokenizer == "simple":
        return made.withColumn(out, characters(F.col(out)))
    made = settled(made.withColumn(out, typed_segments(F.col(out))), out)
    return made.withColumn(out, dispatched(F.col(out), BY_TYPE | (by_type or {})))


def token_ids(df: DataFrame, tokens: str, vocabulary: DataFrame, dialog: bool = False) -> DataFrame:
    """``df`` with ``ids`` for ``tokens``; unknown tokens are left out. A dialogue's vocabulary must have both speakers' tags."""
    if dialog and vocabulary.where(F.col("token").isin(*SPEAKERS)).select("token").distinct().count() < len(SPEAKERS):
        raise ValueError(f"the vocabulary lacks one of {', '.join(SPEAKERS)}")
    return lookup_ids(df, tokens, vocabulary)
