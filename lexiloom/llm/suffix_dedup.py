"""Repeated passages by distributed prefix doubling.

A rank names the string of a given length that starts at a position: equal strings have
equal ranks. The rank of twice the length is made of the pair (rank at the position, rank
one length further), as in building a suffix array; here only strings up to the threshold
of 100 bytes matter, and only positions whose rank is not unique go on. Spark sorts
(rank, position) pairs and drops unique ranks between the rounds:

1. Rank 50, doubled inside each task from single bytes. Of the 51 positions whose 50 bytes lie
   inside a string of 100 bytes, the one with the smallest rank stands for it (equal strings
   choose alike), so one pair in about 25 positions is sorted. A stretch of neighbouring strings
   that share their representative goes as one row, with a code of all its bytes. A
   representative whose rank is unique ends here, and with it all strings that it stands
   for. Where a whole stretch occurs earlier, all its strings are repeats.
2. Rank 100 = (rank 50 here, rank 50 at 50 bytes further), for what is left: the strings of
   stretches that agree in their representative's rank and differ elsewhere. The first string
   of each rank stays, later ones are repeats.

Copies inside a block of texts fold before they are sent, so that a passage that very many
texts share sends one row from each block. A representative that stands in very many different
stretches (a licence line in ever new surroundings) would still meet in one task: such ranks
are looked for in a bounded sample, and their stretches are dealt by a code of the whole
stretch instead. Whether a rank is in the sample moves rows between tasks and changes no result.

Ranks are 64-bit codes under a number drawn for each run, so nobody can write texts that
collide. Stretches are told apart by two of them (rank and code of all bytes; among the
stretches of one rank, fewer than about one text in 500 has it, by the second alone), strings
of 100 bytes by two as well.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiloom.llm.common import cut, kept

LENGTH = 100
#: Bytes of text that a task ranks at once, and windows of one piece of a long text.
BLOCK, PIECE = 2 << 20, 1 << 20
COVERED, OPEN = 0, 1
#: Multipliers of the codes (odd 64-bit constants).
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Texts of the sample that looks for hot ranks, and different stretches there that make one.
SAMPLE, HOT = 4000, 8


def byte_codes(seed: int) -> np.ndarray:
    """The rank of each single byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The code that stands for the rank of a pair of ranks."""
    x = a * _M[0]
    x ^= x >> np.uint64(29)
    x += b * _M[1]
    x ^= x >> np.uint64(32)
    x *= _M[2]
    return x ^ x >> np.uint64(31)


def prefix_codes(data: np.ndarray, length: int, codes: np.ndarray) -> np.ndarray:
    """Ranks of all strings of ``length`` bytes, by doubling from single bytes."""
    code, h = codes[data], 1
    while h < length:
        step = min(h, length - h)
        code = pair_code(code[:-step], code[step:])
        h += step
    return code


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, from a mask of their first places."""
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(first)))


class Block:
    """Pieces of texts side by side. Windows are the starts of whole strings of ``length`` bytes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int, codes: np.ndarray) -> None:
        self.half = -(-length // 2)
        sizes = np.array([len(b) for _, _, b in pieces])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(b for _, _, b in pieces), np.uint8)
        whole = np.maximum(0, sizes - length + 1)
        #: position in the block, text, and position in the text of each window
        self.at = np.repeat(starts, whole) + np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        self.doc = np.repeat(np.array([d for d, _, _ in pieces], np.int64), whole)
        self.pos = self.at - np.repeat(starts, whole) + np.repeat(np.array([p for _, p, _ in pieces], np.int64), whole)
        self.rank = prefix_codes(data, self.half, codes) if len(data) >= length else np.empty(0, np.uint64)

    def windows(self, length: int) -> np.ndarray:
        """Ranks of the strings of full length: pairs of half ranks."""
        return pair_code(self.rank[self.at], self.rank[self.at + length - self.half])

    def representatives(self, length: int) -> np.ndarray:
        """For each window the place of its smallest half rank, the leftmost of equal ones."""
        low = np.uint64((1 << 24) - 1)
        key = (self.rank & ~low) | np.arange(len(self.rank), dtype=np.uint64)
        h, width = 1, length - self.half + 1
        while h < width:
            step = min(h, width - h)
            key = np.minimum(key[:-step], key[step:])
            h += step
        return (key[self.at] & low).astype(np.int64)


def blocks(docs: list, starts: list, texts: list, length: int, piece: int = PIECE, block: int = BLOCK) -> Iterator[tuple[list[tuple[int, int, bytes]], list]]:
    """(pieces, what goes with each); texts longer than a piece are cut with an overlap of one string."""
    now, size = [], 0
    for d, s, t in zip(docs, starts, texts):
        for a in range(0, max(1, len(t) - length + 1), piece):
            part = t[a : a + piece + length - 1]
            now.append(((d, a, part), s))
            size += len(part)
            if size >= block:
                yield [x for x, _ in now], [x for _, x in now]
                now, size = [], 0
    if now:
        yield [x for x, _ in now], [x for _, x in now]


def _fold(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of keys, text and position, and a mask of those that repeat the one before."""
    order = np.lexsort((pos, doc, *reversed(keys)))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    return order, same


def _merged(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered stretches of windows, those that touch made one."""
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at, size = _runs(first)
    last = at + size - 1
    return doc[at], pos[at], pos[last] + n[last] - pos[at]


_COLUMNS = ["k", "f", "doc", "pos", "n"]
_ROWS = "k bigint, f bigint, doc bigint, pos bigint, n int"
#: ``f`` of rows that are known to be covered and only pass through; codes never take it.
_THROUGH = np.int64(-(1 << 63))


def _signed(x: np.ndarray) -> np.ndarray:
    """All 64 bits: among stretches of one representative ``f`` alone decides."""
    return np.maximum(x.view(np.int64), _THROUGH + 1)


def _send(k: np.ndarray, f: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The first row of each (k, f), and what the others cover, under keys of their own.

    Rows of a ``hot`` k go to a key of k and f and have ``n`` negative.
    """
    if not len(k):
        return
    order, same = _fold([k, f], doc, pos)
    first, gone = order[~same], order[same]
    d, p, m = _merged(doc[gone], pos[gone], n[gone])
    key, size = k[first], n[first]
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[at] == key
        key = np.where(is_hot, pair_code(key, f[first].view(np.uint64)), key)
        size = np.where(is_hot, -size, size)
    own = pair_code(d.view(np.uint64), p.view(np.uint64))
    cols = [np.concatenate(x) for x in ((key, own), (f[first], np.full(len(d), _THROUGH)), (doc[first], d), (pos[first], p), (size, m))]
    cols = [cols[0].view(np.int64), cols[1], cols[2], cols[3], cols[4].astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_COLUMNS)


def send_stretches(length: int, seed: int, hot: np.ndarray | None = None) -> Callable:
    """Round 1: stretches of windows by their representative's rank."""
    codes = byte_codes(seed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["doc"].to_pylist()
            for pieces, _ in blocks(docs, docs, batch["bytes"].to_pylist(), length):
                b = Block(pieces, length, codes)
                if not len(b.at):
                    continue
                rep = b.representatives(length)
                first = np.ones(len(rep), bool)
                first[1:] = (np.diff(rep) != 0) | (np.diff(b.at) != 1)
                at, n = _runs(first)
                lo = b.at[at]
                # a code of all the stretch's bytes: its half ranks as digits
                base = _M[3]
                power = np.cumprod(np.full(len(b.rank) + 1, base))
                inverse = np.cumprod(np.full(len(b.rank) + 1, np.uint64(pow(int(base), -1, 1 << 64))))
                total = np.concatenate([[np.uint64(0)], np.cumsum(b.rank * power[: len(b.rank)])])
                digits = (total[lo + n + length - b.half] - total[lo]) * inverse[lo]
                shape = (rep[at] - lo).astype(np.uint64) * np.uint64(length) + n.astype(np.uint64)
                yield from _send(b.rank[rep[at]], _signed(pair_code(digits, shape)), b.doc[at], b.pos[at], n, hot)

    return each


def settle(more: bool) -> Callable:
    """Of rows sorted by (k, f, doc, pos): later rows of a (k, f) are covered.

    With ``more``, the first rows of a k with several f, and of those that were dealt as hot,
    are handed on as open. Between batches only the key of the last row stays in memory, and
    the first row of its k while no second f has come.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        #: rows of the last k that are first of their f, and the only one of them
        firsts, single = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f, doc, pos, n = (batch[c].to_numpy() for c in _COLUMNS)
            hot, n = n < 0, np.abs(n).astype(np.int64)
            new_k, new_f = np.ones(len(k), bool), np.ones(len(k), bool)
            new_k[1:] = k[1:] != k[:-1]
            new_f[1:] = new_k[1:] | (f[1:] != f[:-1])
            if last is not None:
                new_k[0] = k[0] != last[0]
                new_f[0] = new_k[0] or f[0] != last[1]
            through = f == _THROUGH
            covered, first = ~new_f | through, new_f & ~through
            # group 0 is the k that the last batch ended with
            group = np.cumsum(new_k)
            counts = np.bincount(group, first, group[-1] + 1).astype(np.int64)
            open_ = first & ((counts + np.where(np.arange(len(counts)) == 0, firsts, 0) > 1)[group] | hot)
            rows = []
            if covered.any():
                d, p, m = _merged(doc[covered], pos[covered], n[covered])
                rows.append((d, p, m, np.full(len(d), COVERED)))
            if more:
                if single is not None and counts[0]:
                    rows.append((*single, np.full(1, OPEN)))
                    single = None
                if open_.any():
                    rows.append((doc[open_], pos[open_], n[open_], np.full(int(open_.sum()), OPEN)))
                if len(counts) > 1:
                    firsts, single = 0, None
                firsts += int(counts[-1])
                if firsts == 1 and counts[-1]:
                    k1 = int(np.flatnonzero(first)[-1])
                    single = None if hot[k1] else (doc[k1 : k1 + 1], pos[k1 : k1 + 1], n[k1 : k1 + 1])
            last = int(k[-1]), int(f[-1])
            if rows:
                d, p, m, kind = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(kind, pa.int32())], names=["doc", "pos", "n", "kind"])

    return each


def send_windows(length: int, seed: int) -> Callable:
    """Round 2: the windows of open stretches by their full rank; f is their representative's."""
    codes = byte_codes(seed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, spans in blocks(batch["doc"].to_pylist(), batch["spans"].to_pylist(), batch["bytes"].to_pylist(), length):
                b = Block(pieces, length, codes)
                if not len(b.at):
                    continue
                size = np.array([max(0, len(t) - length + 1) for _, _, t in pieces])
                begin = np.cumsum(size) - size
                step = np.zeros(len(b.at) + 1, np.int32)
                for (_, a, _), s, at, n in zip(pieces, spans, begin, size):
                    lo = np.array([x["pos"] for x in s]) - a
                    hi = lo + np.array([x["n"] for x in s])
                    near = (lo < n) & (hi > 0)
                    np.add.at(step, at + np.maximum(lo[near], 0), 1)
                    np.add.at(step, at + np.minimum(hi[near], n), -1)
                take = np.cumsum(step[:-1]) > 0
                rep = b.rank[b.representatives(length)[take]]
                yield from _send(b.windows(length)[take], _signed(rep), b.doc[take], b.pos[take], np.ones(int(take.sum()), np.int64))

    return each


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k", "f", "doc", "pos")


def with_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, bytes): ``doc`` is unique and in the order of the ids, null last.

    Ids that are unique and not null are their own order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("bytes"))
    odd = docs.select(F.col(id_col).cast("long").alias("i")).groupBy("i").count().where("i is null or count > 1")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "bytes")
    order = F.col("doc_id").asc_nulls_last()
    return cut(rows.repartitionByRange(order, F.xxhash64("bytes")).sortWithinPartitions(order).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "bytes"))


def hot_ranks(texts: DataFrame, length: int, seed: int) -> np.ndarray:
    """Sorted ranks that stand for ``HOT`` or more different stretches in a sample of about ``SAMPLE`` texts."""
    rows = texts.count()
    sample = texts.select("doc", "bytes").sample(min(1.0, SAMPLE / max(rows, 1)), seed=seed & 0x7FFFFFFF)
    sent = sample.mapInArrow(send_stretches(length, seed), _ROWS).where(F.col("f") != int(_THROUGH))
    found = sent.groupBy("k").agg(F.count_distinct("f").alias("n")).where(F.col("n") >= HOT).select("k")
    return np.sort(np.array([r.k for r in found.collect()], np.int64).view(np.uint64))


def covered_windows(texts: DataFrame, length: int = LENGTH, seed: int | None = None) -> DataFrame:
    """(doc, spans array<struct<pos, n>>) of the windows of ``texts`` (doc, bytes) that start earlier too."""
    seed = secrets.randbits(63) if seed is None else seed
    table = "doc bigint, pos bigint, n bigint, kind int"
    hot = hot_ranks(texts, length, seed)
    first = kept(_sorted(texts.select("doc", "bytes").mapInArrow(send_stretches(length, seed, hot), _ROWS)).mapInArrow(settle(True), table), "stretches")
    by_doc = lambda rows: rows.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    open_ = texts.select("doc", "bytes").join(by_doc(first.where(F.col("kind") == OPEN)), "doc")
    second = kept(_sorted(open_.mapInArrow(send_windows(length, seed), _ROWS)).mapInArrow(settle(False), table), "windows")
    return by_doc(first.where(F.col("kind") == COVERED).unionByName(second))


def removed_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from stretches of covered windows."""
    if not spans:
        return []
    lo = np.array([s["pos"] for s in spans], np.int64)
    hi = lo + np.array([s["n"] for s in spans], np.int64) + length - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at, n = _runs(new)
    return list(zip(lo[at].tolist(), hi[at + n - 1].tolist()))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Removes each byte covered by a string of ``length`` bytes that also starts earlier: in a
    text with a smaller id, or earlier in the same text. Strings do not cross texts.

    Defined cases: null text is empty; texts shorter than ``length`` stay whole; rows with the
    same id count as separate texts in an order of their own, after smaller ids; null ids come
    last; an empty table gives no rows; other columns are ignored.
    """
    texts = with_order(docs, id_col, text_col)
    spans = covered_windows(texts, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, own in zip(batch["bytes"].to_pylist(), batch["spans"].to_pylist()):
                cuts = removed_spans(own, length)
                edges = [0, *(x for c in cuts for x in c), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else data
                rows.append((len(data), len(data) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left))
            n, gone, runs, digest, left = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = texts.join(spans, "doc", "left").select("doc_id", "bytes", "spans")
    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
