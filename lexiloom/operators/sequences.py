"""Operators that depend on order: runs, merges, decays, greedy batches.

Sequences belong to a group (a conversation, a user, a shard of an index), never to the
whole table, so they stay distributed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Character classes of the two languages that are told apart.
CHINESE, ENGLISH = "一-鿿", "A-Za-z"


def turn_parity(df: DataFrame, group: str, order: str, is_turn: Column) -> DataFrame:
    """Adds ``parity``: the number of turns up to and with this row, modulo two."""
    over = Window.partitionBy(group).orderBy(order)
    return df.withColumn("parity", F.sum(is_turn.cast("int")).over(over) % 2)


def runs_pattern(first: str = CHINESE, second: str = ENGLISH) -> str:
    """Regex of a run: one language with what belongs to neither; only the first run may begin with that."""
    return f"[^{first}{second}]*(?:[{first}][^{second}]*|[{second}][^{first}]*)|[^{first}{second}]+"


def split_tags(text: Column) -> Column:
    """Parts of a text: ``<...>`` and ``[...]`` on their own, and what lies between."""
    return F.regexp_extract_all(text, F.lit(r"<[^>]*>|\[[^\]]*\]|[^<\[]+|[<\[]"), F.lit(0))


def language_runs(text: Column, first: str = CHINESE, second: str = ENGLISH) -> Column:
    """Array of runs whose concatenation is the text without its line feeds."""
    return F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit("")), F.lit(runs_pattern(first, second)), F.lit(0))


def drop_second(words: Column, first: str, second: str) -> Column:
    """Without the words equal to ``second`` that follow one equal to ``first``."""
    return F.filter(words, lambda w, i: ~((i > 0) & (w == second) & (F.get(words, i - 1) == first)))


def merge_spans(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end, n): spans that overlap or touch made one."""
    order = Window.partitionBy(group).orderBy(start, F.desc(end))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``k`` (from 1) and ``n``: place in the group and size of the group."""
    over = Window.partitionBy(group)
    return df.withColumns({"k": F.row_number().over(over.orderBy(*order)), "n": F.count("*").over(over)})


def decayed_total(x: Column, k: Column, n: Column, rate: float) -> Column:
    """Last value of y = rate * y + x, as one sum."""
    return F.sum(x * F.pow(F.lit(rate), n - k))


def moving_average(x: Column, k: Column, n: Column, keep: float) -> Column:
    """Last value of e = keep * e + (1 - keep) * x, begun at the first x, as one sum over numbered rows."""
    return F.sum(x * F.pow(F.lit(keep), n - k) * F.when(k == 1, 1.0).otherwise(1 - keep))


def moving_average_end(values: Column, keep: float) -> Column:
    """Last value of e = keep * e + (1 - keep) * x over an array, begun at its first element."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda e, x: e * keep + x * (1 - keep))


def range_average(a_start: Column, a_end: Column, start: Column, end: Column) -> Column:
    """Mean of what lies between two points, from the means up to them."""
    return (end * a_end - start * a_start) / (end - start)


def rolling_rank(value: str, group: str, order: list[str], width: int) -> Column:
    """The element of rank n // 2 among the last ``width`` values."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(1 - width, 0)
    kept = F.array_sort(F.collect_list(value).over(window))
    return F.element_at(kept, F.floor(F.size(kept) / 2).cast("int") + 1)


def _next_fit(sizes: list[int], cap: int, blank: list[bool] | None = None) -> list[int]:
    out, group, filled, some = [], 0, 0, False
    for k, s in enumerate(sizes):
        if some and filled + s > cap:
            group, filled, some = group + 1, 0, False
        filled += s
        some = some or blank is None or not blank[k]
        out.append(group)
    return out


def next_fit(sizes: Column, cap: int, blank: Column | None = None) -> Column:
    """Group numbers of a sequence of sizes: a group is closed when the next would overflow it.

    An item larger than ``cap`` stands alone. Where ``blank`` tells items without content, a
    group that has only those stays open. The running sum starts again at each overflow,
    which no window frame expresses.
    """
    if blank is None:

        @F.pandas_udf("array<int>")
        def fold(arrays: pd.Series) -> pd.Series:
            return arrays.map(lambda a: None if a is None else _next_fit(list(a), cap))

        return fold(sizes)

    @F.pandas_udf("array<int>")
    def fold_some(arrays: pd.Series, blanks: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else _next_fit(list(a), cap, list(b)) for a, b in zip(arrays, blanks)])

    return fold_some(sizes, blank)


def batchify(sizes: Column, cap: float, token_cost: float, row_cost: float) -> Column:
    """Batch numbers of sequences in order: what a batch holds costs by token and by row, and the next one's tokens must fit beside it."""

    def fold(own: list[int]) -> list[int]:
        out, batch, tokens, rows = [], 0, 0, 0
        for n in own:
            if rows and tokens * token_cost + rows * row_cost + n * token_cost > cap:
                batch, tokens, rows = batch + 1, 0, 0
            tokens, rows = tokens + n, rows + 1
            out.append(batch)
        return out

    @F.pandas_udf("array<int>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else fold(list(a)))

    return run(sizes)


def merged_rows(parts: DataFrame, group: str, place: str, text: str, is_run: str, taken_in: int) -> DataFrame:
    """(group, place, text, is_run): rows of a group in order, with a text of at most ``taken_in`` words between two runs taken in by them, and neighbouring texts made one.

    The windows hold one group's rows (a document's segments).
    """
    by = Window.partitionBy(group).orderBy(place)
    run, words = F.col(is_run), F.size(F.split(F.trim(F.col(text)), r"\s+"))
    seen = parts.withColumns({"_before": F.coalesce(F.lag(is_run).over(by), F.lit(False)), "_after": F.coalesce(F.lead(is_run).over(by), F.lit(False)), "_first": F.lag(is_run).over(by).isNull()})
    short = seen.withColumn("_short", ~run & F.col("_before") & F.col("_after") & (words <= taken_in))
    joined = F.col("_short") | (run & F.coalesce(F.lag("_short").over(by), F.lit(False))) | (~run & ~F.col("_before") & ~F.col("_first"))
    grouped = short.withColumn("_joined", joined).withColumn("_n", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t"))))
    made = grouped.groupBy(group, "_n").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias(text), F.min_by(is_run, place).alias(is_run))
    return made.select(group, (F.col("_n") - 1).cast("int").alias(place), text, is_run)


def sentences(text: Column) -> Column:
    """Parts that end after sentence punctuation and the white space behind it."""
    return F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]+\s*|[^.!?]+$"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_pieces(text: Column, cap: int) -> Column:
    """Pieces that a chunk is filled with: paragraphs, or their sentences, or those sentences' words, where longer than ``cap``.

    What lies between two of them (line ends, a mark with blanks, blanks) is a piece of its own.
    """
    finer = lambda parts, cut: F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= cap, F.array(p)).otherwise(cut(p))))
    paragraphs = F.regexp_extract_all(text, F.lit(r"\n+|[^\n]+"), F.lit(0))
    by_sentence = finer(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(r"(?sU)[.?!;:]\s+|(?:(?![.?!;:]\s).)+"), F.lit(0)))
    return finer(by_sentence, lambda p: F.regexp_extract_all(p, F.lit(r"(?U)\s+|\S+"), F.lit(0)))


def buckets(x: Column, bounds: list[float]) -> Column:
    """How many bounds are below ``x``."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < x))


def cross_fade(a: Column, b: Column, overlap: int) -> Column:
    """``a`` then ``b``, with a linear mix over the last and first ``overlap`` elements."""
    k = F.least(F.lit(overlap), F.size(a), F.size(b))
    down = F.transform(F.slice(a, F.size(a) - k + 1, k), lambda v, i: v * (1 - F.when(k > 1, i / (k - 1)).otherwise(0.0)))
    up = F.transform(F.slice(b, F.lit(1), k), lambda v, i: v * F.when(k > 1, i / (k - 1)).otherwise(0.0))
    middle = F.zip_with(down, up, lambda x, y: x + y)
    return F.concat(F.slice(a, F.lit(1), F.size(a) - k), middle, F.slice(b, k + 1, F.size(b) - k))
