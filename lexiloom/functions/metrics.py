"""Error rates of transcripts and similarity scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a shortest alignment; ties prefer a substitution, then a deletion.

    A row of the table of costs is one vector step: insertions are a running minimum of what
    stands before them. The alignment is read back from the end.
    """
    codes: dict[str, int] = {}
    r, h = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (reference, hypothesis))
    places = np.arange(len(h) + 1)
    cost = np.empty((len(r) + 1, len(h) + 1), np.int32)
    cost[0] = places
    for i in range(1, len(r) + 1):
        above = cost[i - 1] + 1
        above[1:] = np.minimum(above[1:], cost[i - 1, :-1] + (h != r[i - 1]))
        cost[i] = np.minimum.accumulate(above - places) + places
    i, j, substitutions, deletions, insertions = len(r), len(h), 0, 0, 0
    while i or j:
        if i and j and r[i - 1] == h[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
            i, j, substitutions = i - 1, j - 1, substitutions + 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i, deletions = i - 1, deletions + 1
        else:
            j, insertions = j - 1, insertions + 1
    return substitutions, deletions, insertions


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Struct of the three counts, of texts whose words are parted by white space; null is empty."""

    @F.pandas_udf("substitutions int, deletions int, insertions int")
    def count(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        counts = [edit_counts((a or "").split(), (b or "").split()) for a, b in zip(r, h)]
        return pd.DataFrame(counts, columns=["substitutions", "deletions", "insertions"], dtype="int32")

    return count(reference, hypothesis)


def word_count(reference: Column) -> Column:
    """As many as splitting at single spaces gives, so an empty text counts one."""
    return F.size(F.split(reference, " "))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.try_divide(F.levenshtein(reference, hypothesis), F.char_length(reference))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Fewest word edits between two texts, without Python: each distinct word of a row becomes one code point.

    Null is empty. Code points above the first 65,536 are used, so a row may have 1,048,576
    distinct words.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    point = lambda w, every: F.decode(F.unhex(F.lpad(F.hex(F.array_position(every, w) + 0xFFFF), 8, "0")), "UTF-32")
    coded = lambda c, every: F.array_join(F.transform(c, lambda w: point(w, every)), "")
    parts = F.struct(words(reference).alias("r"), words(hypothesis).alias("h"))
    return _once(parts, lambda p: _once(F.array_distinct(F.concat(p["r"], p["h"])), lambda every: F.levenshtein(coded(p["r"], every), coded(p["h"], every))))


def speakers(dialogue: Column) -> Column:
    """What each of two speakers says, as an array of two texts: the segments between marks ``[S1]`` to ``[S9]`` in turn."""
    parts = F.transform(F.split(F.coalesce(dialogue, F.lit("")), r"\[S[1-9]\]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    of = lambda bit: F.array_join(F.filter(parts, lambda _, k: k % 2 == bit), " ")
    return F.array(of(0), of(1))


def cp_word_errors(reference: Column, hypothesis: Column, clean: Callable[[Column], Column] | None = None) -> Column:
    """Of two dialogues of two speakers: struct of errors, words, swapped, reference and hypothesis.

    The hypothesis' speakers are taken in the order with fewer word errors, a tie as
    swapped. ``words`` counts as the marked reference is split at single spaces; the two
    texts are joined speaker after speaker, for ``word_errors`` to tell the kinds of errors.
    ``clean`` is done to what each speaker says, before the orders are compared.
    """
    of = lambda d: F.transform(speakers(d), clean) if clean else speakers(d)

    def counted(said: Column) -> Column:
        r = said["r"]
        marked = F.regexp_replace(F.concat(F.lit("[S1] "), r[0], F.lit(" [S2] "), r[1]), r"\s+", " ")
        whole, straight, crossed = F.concat_ws(" ", r[0], r[1]), F.concat_ws(" ", said["h"][0], said["h"][1]), F.concat_ws(" ", said["h"][1], said["h"][0])

        def better(d: Column) -> Column:
            swapped = chosen_order(d[0], d[1]) == "crossed"
            return F.struct(
                F.least(d[0], d[1]).alias("errors"),
                (F.size(F.split(marked, " ")) - 2).alias("words"),
                swapped.alias("swapped"),
                whole.alias("reference"),
                F.when(swapped, crossed).otherwise(straight).alias("hypothesis"),
            )

        return _once(F.array(word_distance(whole, straight), word_distance(whole, crossed)), better)

    return _once(F.struct(of(reference).alias("r"), of(hypothesis).alias("h")), counted)


def best_permutation(straight: Column, crossed: Column) -> Column:
    """Mean of two speakers' scores under the better pairing."""
    return F.greatest(straight, crossed) / 2


def chosen_order(straight: Column, crossed: Column) -> Column:
    """A tie counts as crossed."""
    return F.when(straight < crossed, "straight").otherwise("crossed")


def mos(raw: Column) -> Column:
    """A model's output in [-1, 1] as an opinion score in [1, 5]."""
    return raw * 2 + 3
