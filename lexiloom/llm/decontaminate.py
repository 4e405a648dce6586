"""Benchmark items inside documents: MinHash containment search by size, then exact verification.

An item's sketch is its smallest shingle hashes: one more than the share of its shingles
that may be missing, so a document that contains enough of the item has at least one hash
of the sketch, and no item is lost to chance. Items are partitioned by size. A partition
has its own sketch length, its own bound on sketch hashes and the least number of shingles
that a document needs; a document sends only the hashes below the bounds of the partitions
that it is large enough for, and is not shortened to a signature of its own, which could
not see a short item. Candidates are verified by the shingles' words. All of it is DataFrame
operations.

An item of fewer words than a shingle is one shingle of its own length, and documents are
searched for runs of that length too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import cut, free_names

WORDS, LEVEL = 5, 0.8
#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Sketch hashes (eight bytes each) up to which they are broadcast by themselves, to filter
#: the documents' shingles before these are shuffled.
FILTER_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def starts_of(words: Column, n: int = WORDS) -> Column:
    """First places of an item's shingles; a text shorter than a shingle has one, an empty one none."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))))


def runs_of(texts: DataFrame, lengths: list[int], make: Callable[[Column, Column, int], Column], name: str) -> DataFrame:
    """``texts`` (with words w) once for each run of so many words, with ``make`` of the run instead of w."""
    parts = []
    for n in lengths:
        own = texts.where(F.size("w") >= n)
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
        parts.append(own.withColumn(name, make(F.col("w"), F.col("at"), n)).drop("w", "at"))
    return reduce(DataFrame.unionByName, parts)


def shingle_hash(words: Column, at: Column, n: int = WORDS) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def shingle_text(words: Column, at: Column, n: int = WORDS) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)])


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(item_id, shingle, h, n_item): the distinct shingles of each item."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
    each = w.select("item_id", "w", F.explode(starts_of(F.col("w"), n)).alias("at"))
    each = each.select("item_id", shingle_text(F.col("w"), F.col("at"), n).alias("shingle"), shingle_hash(F.col("w"), F.col("at"), n).alias("h")).distinct()
    return each.withColumn("n_item", F.count("*").over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame, level: float = LEVEL) -> DataFrame:
    """(h, item_id, class, need): each item's smallest hashes, enough that one must be met.

    ``class`` is the size partition (powers of two) and ``need`` its least document size.
    """
    hashes = shingles.select("item_id", "n_item", "h").distinct()
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    # an item whose shingles' hashes collide has fewer hashes; all of them then stand in the sketch
    enough = F.col("n_item") - F.ceil(F.col("n_item") * level - 1e-9) + 1
    kept = hashes.withColumn("place", place).where(F.col("place") <= enough)
    size_class = F.floor(F.log2("n_item")).cast("int")
    return kept.select("h", "item_id", size_class.alias("class"), F.ceil(F.pow(F.lit(2.0), size_class) * level - 1e-9).cast("long").alias("need"))


def contaminated(docs: DataFrame, items: DataFrame, level: float = LEVEL, n: int = WORDS, broadcast_rows: int = BROADCAST_ROWS, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of the pairs with containment >= ``level``.

    Containment is the share of an item's distinct shingles of ``n`` words that a document has.

    Defined cases: null and empty texts have no shingle and are in no pair; an item shorter than
    a shingle is one shingle, met wherever its words follow one another in a document; rows with a null id are in no pair, since a pair names both;
    rows with the same id count as one text's shingles; empty tables give no rows; other
    columns are ignored.
    """
    shingles = cut(item_shingles(items, n))
    sketch = cut(sketches(shingles, level))
    parts = sketch.groupBy("class").agg(F.count("*").alias("n"), F.max("h").alias("bound"), F.min("need").alias("need")).orderBy("class").collect()
    # words hold no blanks, so a shingle tells its own length
    sizes = shingles.groupBy(F.size(F.split("shingle", " ")).alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect()
    lengths, n_shingles = [r.n for r in sizes], sum(r.rows for r in sizes)
    n_sketch = sum(p.n for p in parts)
    side = lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = texts.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("size", F.greatest(F.size("w") - n, F.lit(0)) + 1)
    # the greatest hash that any partition asks of a document of this size
    asked = F.greatest(F.lit(-(1 << 63)), F.lit(None).cast("long"), *[F.when(F.col("size") >= p.need, F.lit(p.bound)) for p in parts])
    sent = runs_of(sized, lengths or [n], shingle_hash, "h").where(F.col("h") <= asked)
    if broadcast_rows < n_sketch and (hashes := sketch.select("h").distinct()).count() <= filter_rows:
        sent = sent.join(F.broadcast(hashes), "h", "left_semi")
    found = sent.join(side(sketch, n_sketch), (sent.h == sketch.h) & (sent["size"] >= sketch.need))
    candidates = cut(found.select("doc_id", "item_id").distinct())

    asked_for = texts.join(side(candidates, candidates.count()), "doc_id").select("doc_id", "item_id", words_of(F.col("text")).alias("w"))
    each = runs_of(asked_for, lengths or [n], shingle_text, "shingle")
    met = each.join(side(shingles, n_shingles), ["item_id", "shingle"]).select("doc_id", "item_id", "n_item", "h", "shingle").distinct()
    counted = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.ceil(F.col("n_item") * level - 1e-9))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that contain an item.

    Rows are decided one by one, whatever their ids (null and repeated ones too), by a hash of
    their text. Columns keep their names, whatever they are; an empty table stays empty, and
    without items all rows stay.
    """
    (key,) = free_names(docs, "content")
    own = F.xxhash64("text")
    gone = contaminated(docs.select(own.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, own).join(gone, key, "left_anti").drop(key)
