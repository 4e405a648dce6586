"""Ranked lexical search over K2-treaps.

Documents are dealt, as they lie, into shards of a bounded size. A shard's grid has a row for
each query term and a column for each document, in order of their ids; a cell holds the
impact of the term in the document. The grid is a compressed quadtree: a level keeps only the
cells that hold something, each with the largest impact below it, a mask of its four children
and the place of the first of them.

A query starts with the whole range of documents and one path for each of its terms. A range
is split into its halves and each path follows the quadrant of its row, so a range always has
one cell for each path, and the sum of the cells' maxima bounds the scores in it. Ranges are
taken best first, a batch of them at a time, until no bound can enter the best documents
known so far; these carry over from shard to shard within a task, and Spark merges the tasks'
best.

Queries are read in blocks of a bounded size; every block is searched against all documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from lexiloom.llm.common import kept

#: What is no part of a term, and the letters that are lower-cased.
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
TOP = 10
#: Documents of a shard, ranges split at a time, and the characters and items of a block of queries.
SHARD, BEAM = 1 << 14, 256
BLOCK_CHARS, BLOCK_ITEMS = 1 << 22, 4096


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Integer impacts of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Level:
    """Cells of one level in Morton order: largest impact, children's mask, place of the first child."""

    best: np.ndarray
    mask: np.ndarray
    first: np.ndarray


def interleaved(row: np.ndarray, col: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for b in range(bits):
        code |= ((row >> b & 1) << (2 * b + 1)) | ((col >> b & 1) << (2 * b))
    return code


class Treap:
    """A K2-treap over (row, col, impact); levels from the root down to the single cells."""

    #: Children before a quadrant, by mask and quadrant.
    RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray, rows: int, cols: int) -> None:
        self.bits = max(1, (max(rows, cols) - 1).bit_length())
        code = interleaved(row, col, self.bits)
        order = np.argsort(code, kind="stable")
        code, best = code[order], impact[order]
        self.levels = [Level(best, np.zeros(len(best), np.int64), np.zeros(len(best), np.int64))]
        for _ in range(self.bits):
            above = code >> 2
            first = np.flatnonzero(np.r_[True, above[1:] != above[:-1]]) if len(code) else np.empty(0, np.int64)
            mask = np.bitwise_or.reduceat(1 << (code & 3), first) if len(code) else first
            best = np.maximum.reduceat(best, first) if len(code) else first
            self.levels.append(Level(best, mask, first))
            code = above[first]
        self.levels.reverse()

    def child(self, level: int, cell: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Places, on the next level, of the quadrants of cells; -1 where there is none."""
        at = self.levels[level]
        mask = at.mask[cell]
        there = (cell >= 0) & (mask >> quadrant & 1 == 1)
        return np.where(there, at.first[cell] + self.RANK[mask, quadrant], -1)

    def bound(self, level: int, cells: np.ndarray) -> np.ndarray:
        """Sums of the maxima of each range's cells (ranges, paths)."""
        return np.where(cells >= 0, self.levels[level].best[cells], 0).sum(1)


@dataclass
class Best:
    """The best documents of one query so far, as (-score, order of the id)."""

    top: int
    found: list[tuple[int, tuple]] = field(default_factory=list)

    @property
    def least(self) -> int:
        """The score below which nothing enters."""
        return -self.found[-1][0] if len(self.found) == self.top else 1

    def enters(self, bounds: np.ndarray, columns: np.ndarray, ids: list[tuple]) -> np.ndarray:
        """Whether ranges that begin at ``columns`` of a shard may hold a document that enters; equal scores need a smaller id."""
        if len(self.found) < self.top:
            return bounds >= 1
        before = bisect_left(ids, self.found[-1][1])
        return (bounds > self.least) | (bounds == self.least) & (columns < before)

    def add(self, scores: np.ndarray, ids: list[tuple]) -> None:
        self.found = sorted([*self.found, *((-int(s), k) for s, k in zip(scores, ids))])[: self.top]


def search(treap: Treap, query: np.ndarray, ids: list[tuple], best: Best, beam: int = BEAM) -> None:
    """Adds to ``best`` what ``treap`` (columns ``ids``, in order) holds for the rows ``query``."""
    if not len(treap.levels[0].best) or not len(query):
        return
    # open ranges by level: first column >> level's shift, cells, bounds
    root = np.zeros((1, len(query)), np.int64)
    open_ = [(np.zeros(1, np.int64), root, treap.bound(0, root))] + [None] * treap.bits
    while True:
        tops = [-1 if o is None else int(o[2].max()) for o in open_[:-1]]
        level = int(np.argmax(tops))
        if tops[level] < best.least:
            return
        shift = treap.bits - level - 1
        at, cells, bounds = open_[level]
        near = best.enters(bounds, at << (shift + 1), ids)
        at, cells, bounds = at[near], cells[near], bounds[near]
        open_[level] = None
        if len(at) > beam:
            taken = np.zeros(len(at), bool)
            taken[np.argpartition(-bounds, beam - 1)[:beam]] = True
            open_[level] = (at[~taken], cells[~taken], bounds[~taken])
            at, cells = at[taken], cells[taken]
        low = (query >> shift & 1) << 1
        halves = [treap.child(level, cells, np.broadcast_to(low + half, cells.shape)) for half in (0, 1)]
        at, cells = np.concatenate([2 * at, 2 * at + 1]), np.concatenate(halves)
        bounds = treap.bound(level + 1, cells)
        near = best.enters(bounds, at << shift, ids)
        at, cells, bounds = at[near], cells[near], bounds[near]
        if not len(at):
            continue
        if level + 1 == treap.bits:
            if len(at) > best.top:
                # only what can be among the best of this batch
                floor = np.partition(bounds, -best.top)[-best.top]
                at, bounds = at[bounds >= floor], bounds[bounds >= floor]
            best.add(bounds, [ids[k] for k in at.tolist()])
        elif open_[level + 1] is None:
            open_[level + 1] = (at, cells, bounds)
        else:
            was = open_[level + 1]
            open_[level + 1] = (np.concatenate([was[0], at]), np.concatenate([was[1], cells]), np.concatenate([was[2], bounds]))


def term_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each text: all its terms counted, those of ``vocabulary`` listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, rows, tfs = [], [], []
            for text in batch["text"].to_pylist():
                words = terms(text)
                own = Counter(k for k in map(vocabulary.get, words) if k is not None)
                ns.append(len(words))
                rows.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ns, pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def search_shards(counted: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, top: int, shard: int = SHARD) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each query (rows of the grid)."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= shard:
                table = pa.Table.from_batches(held)
                whole = table.num_rows // shard * shard
                for at in range(0, whole, shard):
                    yield table.slice(at, shard)
                held = table.slice(whole).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        for table in shards(batches):
            table = table.combine_chunks()
            ids = [(k is None, k or 0) for k in table["doc_id"].to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            ids = [ids[k] for k in order]
            column = table["terms"].combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            row, tf = column.flatten().to_numpy().astype(np.int64), table["tfs"].combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            score = impacts(weights[row], tf, table["n"].to_numpy()[doc], n_docs, length)
            some = score > 0
            treap = Treap(row[some], place[doc[some]], score[some], len(weights), len(ids))
            for query, own in zip(queries, best):
                search(treap, query, ids, own)
        rows = [(k, None if none else doc, -score) for k, own in enumerate(best) for score, (none, doc) in own.found]
        item, doc, score = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(each, "item int, doc_id bigint, score bigint")


def blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Items (item_id, text) in blocks of a bounded size; one long item may be a block."""
    held, chars = [], 0
    for r in items.toLocalIterator():
        held.append(r)
        chars += len(r.text or "")
        if len(held) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score.

    A document's score is the sum, over the item's different terms, of integer impacts that
    grow with a term's rarity and its frequency in the document and fall with the document's
    length. Every row of ``docs`` is scored by its whole text; only scores above zero rank.

    Defined cases: null and term-less texts have no terms, count in neither average nor number
    of documents, and never rank; a null id ranks behind equal scores with an id; rows that
    repeat an id are documents of their own; items that repeat an id are items of their own,
    and an item without terms, or whose terms no document holds, gives no rows; without
    documents or items there are no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in blocks(asked):
        own = [list(dict.fromkeys(terms(r.text))) for r in block]
        vocabulary = {t: k for k, t in enumerate(sorted({t for q in own for t in q}))}
        if not vocabulary:
            continue
        counted = kept(term_frequencies(texts, vocabulary), "terms")
        n_docs, length = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return out
        # as many rows as the block has terms
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([term_weight(n_docs, df.get(k, 0)) for k in range(len(vocabulary))], np.int64)
        queries = [np.array(sorted(vocabulary[t] for t in q), np.int64) for q in own]
        found = search_shards(counted.where(F.size("terms") > 0), queries, weights, n_docs, length, top)
        by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], "item int, item_id bigint")
        best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
