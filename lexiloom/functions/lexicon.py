"""Dictionary replacement in one pass, leftmost and longest, by an automaton.

A dictionary is cut into blocks of a bounded size. Each block becomes an automaton that
workers build once from a broadcast; a text is read once for each block, whatever the number of
entries. Blocks hand on, for each place where an entry begins, their longest one; the longest
of all blocks is taken from left to right.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions.normalizer import arrays_of, pieces, rebuilt, rewritten
from lexiloom.operators.relational import settled

#: Characters of keys and values in a block, and automata that a worker keeps.
BLOCK_CHARS, KEPT = 1 << 24, 4
MATCHES = "array<struct<start:int,end:int,said:string,cased:boolean>>"
_NAMES = ("start", "end", "said", "cased")
_FIELDS = list(zip(_NAMES, (pa.int32(), pa.int32(), pa.string(), pa.bool_())))

Entry = tuple[str, str, bool]
Match = tuple[int, int, str, bool]


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Lexicon:
    """Entries (key, said, cased): cased keys are met as they stand, others in any case; whole words only."""

    def __init__(self, entries: list[Entry]) -> None:
        self.plain, self.cased = ahocorasick.Automaton(), ahocorasick.Automaton()
        for key, said, cased in entries:
            if key:
                (self.cased if cased else self.plain).add_word(key if cased else folded(key), (len(key), said))
        for automaton in (self.plain, self.cased):
            if len(automaton):
                automaton.make_automaton()

    def matches(self, text: str) -> list[Match]:
        """(start, end, said, cased): for each start, in order, the longest entry; of equal length the cased one."""
        found: dict[int, tuple[int, str, bool]] = {}
        # a blank on each side, so that every place has neighbours
        seen, word = f" {text} ", lambda c: c.isalnum() or c == "_"
        for automaton, own in ((self.cased, text), (self.plain, folded(text))):
            if not len(automaton):
                continue
            cased = automaton is self.cased
            for last, (size, said) in automaton.iter(own):
                stop = last + 1
                start = stop - size
                if word(seen[start]) != word(seen[start + 1]) and word(seen[stop]) != word(seen[stop + 1]) and stop > found.get(start, (0,))[0]:
                    found[start] = (stop, said, cased)
        return [(start, *found[start]) for start in sorted(found)]


def leftmost(matches: list[Match]) -> list[Match]:
    """From left to right, the longest match at each place that is still free."""
    out, at = [], 0
    for m in sorted(matches, key=lambda m: (m[0], -m[1], not m[3], m[2])):
        if m[0] >= at:
            out.append(m)
            at = m[1]
    return out


_BUILT: OrderedDict[str, Lexicon] = OrderedDict()


def _lexicon(block: Broadcast) -> Lexicon:
    """The block's automaton, built once in a worker."""
    key = str(getattr(block, "_path", None) or id(block))
    if key not in _BUILT:
        _BUILT[key] = Lexicon(block.value)
        while len(_BUILT) > KEPT:
            _BUILT.popitem(last=False)
    return _BUILT[key]


def blocks(entries: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Broadcast]:
    """``entries`` (key, said, cased) as broadcasts of at most about ``block_chars`` characters each.

    Null and empty keys are left out, null values say nothing; of entries with one key and
    the same case rule the smallest value counts.
    """
    spark = entries.sparkSession
    own = F.when(F.col("cased"), F.col("key")).otherwise(F.lower("key"))
    one = entries.where("key <> ''").groupBy(F.coalesce("cased", F.lit(False)).alias("cased"), own.alias("key")).agg(F.min(F.coalesce("said", F.lit(""))).alias("said"))
    chars = one.agg(F.sum(F.char_length("key") + F.char_length("said"))).first()[0] or 0
    n = ceil(chars / block_chars)
    for k in range(n):
        part = one.where(F.pmod(F.xxhash64("key", "cased"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast([(r.key, r.said, r.cased) for r in part.toLocalIterator()])


def lexicon_matches(text: Column, block: Broadcast) -> Column:
    """For each place where an entry of the block begins, the longest one."""

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        of = _lexicon(block)
        return pa.concat_arrays([arrays_of([[] if t is None else of.matches(t) for t in own], _FIELDS) for (own,) in pieces(texts)] or [arrays_of([], _FIELDS)])

    return run(text)


def said_by(text: str, matches: list[Match]) -> str:
    """``text`` with those of the matches replaced that are taken."""
    return rebuilt(text, [m[:3] for m in leftmost(matches)])


def replaced(df: DataFrame, entries: DataFrame, text_col: str = "text", out: str = "said", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``out``: ``text_col`` with the entries (key, said, cased) replaced in one pass.

    What is said is not read again. Null stays null; without entries the text stays.
    """
    own = list(blocks(entries, block_chars))
    if not own:
        return df.withColumn(out, F.col(text_col))
    if len(own) == 1:
        block = own[0]
        made = rewritten(lambda t: None if t is None else said_by(t, _lexicon(block).matches(t)), F.col(text_col))
        return settled(df.withColumn(out, made), out)
    names = [f"_matches_{k}" for k in range(len(own))]
    found = df.withColumns({n: lexicon_matches(F.col(text_col), b) for n, b in zip(names, own)})
    made = rewritten(lambda t, *of: None if t is None else said_by(t, [tuple(m[n] for n in _NAMES) for part in of for m in part]), F.col(text_col), *names)
    return settled(found.withColumn(out, made), out).drop(*names)


def replaced_by_row(text: Column, entries: Column) -> Column:
    """``text`` with the row's own entries (array of key, said, cased) replaced; null entries are none."""

    def said(t: str | None, own: list[dict] | None) -> str | None:
        if t is None or not own:
            return t
        return said_by(t, Lexicon([(e["key"] or "", e["said"] or "", bool(e["cased"])) for e in own]).matches(t))

    return rewritten(said, text, entries)
