"""Algebra of piecewise linear functions, each a set of rows (key, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _between(p: Column, n: Column, x: Column) -> Column:
    """Value at ``x`` on the line from point ``p`` to point ``n``; where one is missing, the other's."""
    line = p["y"] + (n["y"] - p["y"]) * (x - p["x"]) / (n["x"] - p["x"])
    return F.when(p.isNull(), n["y"]).when(n.isNull() | (p["x"] == n["x"]), p["y"]).otherwise(line)


def common_basis(f: DataFrame, g: DataFrame, key: str = "key", crossings: bool = False) -> DataFrame:
    """(key, x, f, g) at every breakpoint of either function, and where they cross if asked for.

    Both sides of a key are interpolated between their own breakpoints and constant beyond
    them. A merge of sorted breakpoints: windows of a key in the order of x, whose breakpoints meet
    in one task (a schedule has few).

    Defined cases: a key that only one side has gives no rows; null keys, places and values
    are left out; of equal places of one function the smallest value counts; NaN values
    spread as in arithmetic; empty inputs give no rows. Further columns are ignored.
    """
    point = lambda df, side: df.where(f"`{key}` is not null and x is not null and y is not null").groupBy(F.col(key).alias("key"), F.col("x").cast("double").alias("x")).agg(F.min(F.col("y").cast("double")).alias("y")).select("key", "x", F.struct("x", "y").alias(side))
    both = point(f, "pf").join(point(g, "pg"), ["key", "x"], "full_outer")
    order = Window.partitionBy("key").orderBy("x")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ends = both.select("key", "x", *(e for s in "fg" for e in (F.last(f"p{s}", True).over(before).alias(f"{s}0"), F.first(f"p{s}", True).over(after).alias(f"{s}1"))))
    some = ends.where("(f0 is not null or f1 is not null) and (g0 is not null or g1 is not null)")
    at = lambda x, s, n="": _between(F.col(f"{s}0"), F.col(f"{n}{s}1"), x)
    basis = some.withColumns({"f": at(F.col("x"), "f"), "g": at(F.col("x"), "g")})
    out = basis.select("key", "x", "f", "g")
    if not crossings:
        return out
    nexts = {c: F.lead(c).over(order) for c in ("x", "f", "g", "f1", "g1")}
    pairs = basis.withColumns({f"n_{c}": e for c, e in nexts.items()}).where("n_x is not null and (f > g) <> (n_f > n_g)")
    share = F.abs(F.col("f") - F.col("g")) / (F.abs(F.col("f") - F.col("g")) + F.abs(F.col("n_f") - F.col("n_g")))
    extra = pairs.withColumn("cx", F.col("x") + share * (F.col("n_x") - F.col("x"))).where("cx > x and cx < n_x")
    crossed = extra.select("key", F.col("cx").alias("x"), at(F.col("cx"), "f", "n_").alias("f"), at(F.col("cx"), "g", "n_").alias("g"))
    return out.unionByName(crossed)


def combined(f: DataFrame, g: DataFrame, how: str, key: str = "key") -> DataFrame:
    """(key, x, y) of the sum, maximum or minimum of two functions, or of their product at the common breakpoints.

    Maxima and minima have the crossings among their breakpoints, so they are exact; a
    product is no longer linear between its breakpoints. Cases as in ``common_basis``.
    """
    made = {"sum": F.col("f") + F.col("g"), "product": F.col("f") * F.col("g"), "max": F.greatest("f", "g"), "min": F.least("f", "g")}[how]
    return common_basis(f, g, key, how in ("max", "min")).select("key", "x", made.alias("y"))


def scaled(f: DataFrame, by: float = 1.0, plus: float = 0.0) -> DataFrame:
    """``f`` times a number plus a number; the order of rows and further columns stay."""
    return f.withColumn("y", F.col("y") * by + plus)


def evaluated(f: DataFrame, at: DataFrame, key: str = "key", default: float | None = None) -> DataFrame:
    """``at`` (key, x, ...) with ``y``, the function's value there.

    Where x is null (no step is known) or the key has no function, ``default``.
    """
    points = f.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_points"))
    joined = at.join(points, at[key] == points["_key"], "left")
    below = F.filter("_points", lambda p: p["x"] <= F.col("x"))
    above = F.filter("_points", lambda p: p["x"] >= F.col("x"))
    value = _between(F.element_at(F.when(F.size(below) > 0, below), -1), F.element_at(F.when(F.size(above) > 0, above), 1), F.col("x"))
    return joined.withColumn("y", F.when(F.col("x").isNull() | F.col("_points").isNull(), F.lit(default)).otherwise(value)).drop("_key", "_points")
