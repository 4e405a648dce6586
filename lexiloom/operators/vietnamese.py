"""From written to spoken Vietnamese: rules, dictionaries, what a model found in a text, spelling, signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions import lexicon, normalizer, text as X
from lexiloom.operators.relational import settled


def own_entries(pairs: Column, acronyms: Column, comma: str = ",") -> Column:
    """A row's pairs (word, said), met in any case, and acronyms, met as they stand and spelled in brackets."""
    words = F.transform(F.coalesce(pairs, F.array()), lambda p: F.struct(p["word"].alias("key"), p["said"].alias("said"), F.lit(False).alias("cased")))
    spelled = F.transform(F.coalesce(acronyms, F.array()), lambda a: F.struct(a.alias("key"), F.concat(F.lit("【"), X.spell_letters(a), F.lit(f"】{comma}")).alias("said"), F.lit(True).alias("cased")))
    return F.concat(F.filter(words, lambda e: (e["key"] != "") & (e["said"] != "")), F.filter(spelled, lambda e: e["key"] != ""))


def spoken(
    df: DataFrame,
    words: DataFrame,
    learned: DataFrame,
    spelled: DataFrame,
    text_col: str = "text",
    out: str = "said",
    pairs_col: str | None = None,
    acronyms_col: str | None = None,
    abbreviations: dict[str, str] | None = None,
    strict: bool = False,
    double: bool = False,
) -> DataFrame:
    """``df`` with ``out``, the text as it is read aloud.

    Rules first, then the dictionaries ``words`` and ``learned`` (key, said), then what the
    columns ``pairs_col`` and ``acronyms_col`` hold for the row, then words of ``spelled``
    (key) and spelling markers, then doubled marks if asked for, spacing and sentence case. Each dictionary is one pass,
    longest entry first. Null texts stay null; null pairs and acronyms are none.
    """
    at = "_said"
    made = normalizer.normalized(df, text_col, at, abbreviations, strict)
    made = settled(made.withColumn(at, X.collapse(F.col(at))), at)
    for table in (words, learned):
        made = lexicon.replaced(made, table.select("key", "said", F.lit(False).alias("cased")), at, at)
    if pairs_col or acronyms_col:
        pairs = F.col(pairs_col) if pairs_col else F.lit(None).cast("array<struct<word:string,said:string>>")
        acronyms = F.col(acronyms_col) if acronyms_col else F.lit(None).cast("array<string>")
        made = made.withColumn("_own", own_entries(pairs, acronyms, ",," if double else ","))
        made = settled(made.withColumn(at, lexicon.replaced_by_row(F.col(at), F.col("_own"))), at).drop("_own")
    made = settled(made.withColumn(at, X.spelled_markers(F.col(at))), at)
    entries = spelled.select(F.upper("key").alias("key"), F.concat(F.lit("【"), X.spell_letters(F.col("key")), F.lit("】")).alias("said"), F.lit(True).alias("cased"))
    made = lexicon.replaced(made, entries.where(F.col("key").rlike("^[A-Z]{2,}$")), at, at)
    if double:
        made = made.withColumn(at, X.double_marks(F.col(at)))
    made = settled(made.withColumn(at, X.punctuation_spacing(F.col(at), double)), at)
    return made.withColumn(out, X.sentence_case(F.col(at))).drop(at)
