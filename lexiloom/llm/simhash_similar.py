"""SimHash near-dedup at a Jaccard similarity: texts that share 0.8 of their five-word shingles.

The fingerprint is wider than the contract's of ``simhash``: 256 bits over the set of
shingles. Two sets of Jaccard similarity s have vectors with cosine 2 s / (1 + s), so each
bit differs with the chance angle / pi, 0.15 at 0.8: 39 of 256 bits, give or take 6. No choice of equal
blocks holds for every pair within so wide a radius, so candidates share all bits of one of
many random bit samples ("bands"), as many as leave at most ``MISS`` of the pairs at the level
itself unfound (fewer above it). A band samples about as many bits as the number of texts has,
so unrelated texts seldom meet, however many there are.

Inside a band the ring filter prunes: over the ring of segments some chain of consecutive ones
must keep its cumulative difference within its share of the radius at every length. Then
comes the full count. A bound that no link breaks follows: sets alike at level s differ in at
most (1 - s) / (1 + s) of their two sizes, and the parities of their hashes, counted in
``PARITIES`` buckets, differ in no more buckets than the sets differ in elements. At last the shingles
themselves decide on each link.

In each band every set is first compared with one of it, and of the many that a set meets so
in its bands it is checked against the ``NEAREST`` closest ones: a set of a large group of copies
is checked a few times, not once a band. What that joins needs no further check: the last
round compares all pairs of a band that are not joined yet, and proposes a pair once only, in
the first band that it shares. A key with more sets than ``KEY_SETS`` is cut into blocks, and
each pair of blocks is a task's of its own: no task holds more than two blocks, whatever
stands behind a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import components, kept, without

WORDS, LEVEL, SEED = 5, 0.8, 42
BITS, RADIUS, SEGMENTS = 256, 44, 16
#: Buckets (a power of two) whose parities bound how many elements two sets differ in.
PARITIES = 256
#: Share of the pairs at the level itself that no band may find; fewest bits of a band, and
#: bits fewer than the number of texts has (64 unrelated texts a band).
MISS, LEAST_BITS, FEWER = 0.005, 16, 6
#: Sets that each set is checked against in a round before the last, and such rounds.
NEAREST, ROUNDS = 4, 1
#: Shingles counted at a time, and pairs compared and sent at a time.
BATCH, PAIRS = 1 << 13, 1 << 16
#: Sets of a block of a key, and such keys up to which their counts are broadcast.
KEY_SETS, LARGE_KEYS = 2048, 100_000
#: Hashes that a task which checks links remembers.
REMEMBERED = 1 << 22
_MASK = (1 << 64) - 1
#: The fingerprint's words.
_FP = [f"w{k}" for k in range(BITS // 64)]
_ODD = [f"odd{k}" for k in range(PARITIES // 64)]
_TWINS = [(2 * k + 1) * 0x9E3779B97F4A7C15 & _MASK for k in range(1, len(_FP))]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; white space is ASCII's, and only A-Z are lower-cased."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return np.empty(0, np.uint64)
    n = max(1, len(toks) - words + 1)
    flat = b" ".join(toks)
    sizes = np.fromiter(map(len, toks), np.int64, len(toks)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(words, len(toks)) - 1 :].tolist()
    shingles = (flat[i:j] for i, j in zip(starts, stops))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The bits as signed 64-bit numbers: each set in more than half of the hashes and of their scrambled twins."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), BATCH):
        h = hashes[a : a + BATCH]
        every = [h]
        for factor in _TWINS:
            twin = h * np.uint64(factor)
            twin = (twin ^ twin >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            every.append(twin ^ twin >> np.uint64(32))
        ones += np.unpackbits(np.stack(every, 1).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """A bit for each bucket, as signed 64-bit numbers: set where it holds an odd number of the hashes."""
    counts = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def may_be_alike(odd: list[np.ndarray], sizes: np.ndarray, level: float = LEVEL) -> np.ndarray:
    """Of XORs of the parities of pairs and the sums of their sizes, a mask that holds all pairs of ``level`` or more."""
    apart = sum(np.bitwise_count(w).astype(np.int32) for w in odd)
    return (1 + level) * apart <= (1 - level) * sizes + 1e-6


def band_plan(rows: int, level: float = LEVEL) -> tuple[int, int]:
    """(bits of a band, number of bands) for so many sets."""
    bits = max(LEAST_BITS, math.ceil(math.log2(rows + 1)) - FEWER)
    same = 1 - math.acos(2 * level / (1 + level)) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


def band_masks(bits: int, bands: int) -> np.ndarray:
    """A row for each band: its sampled bits, as a mask of each word of a fingerprint."""
    rng = np.random.default_rng(SEED)
    sampled = np.zeros((bands, BITS), np.uint8)
    for row in sampled:
        row[rng.choice(BITS, bits, replace=False)] = 1
    return np.packbits(sampled, axis=1, bitorder="little").view("<u8")


def band_keys(words: list[Column], masks: np.ndarray) -> Column:
    """The keys of a fingerprint: for each band a hash of its sampled bits."""
    parts = masks.view(np.int64).tolist()
    return F.array(*(F.xxhash64(F.lit(k), *(w.bitwiseAND(F.lit(m)) for w, m in zip(words, part) if m)) for k, part in enumerate(parts)))


def first_shared(x: list[np.ndarray], masks: np.ndarray) -> np.ndarray:
    """Of XORs of pairs, the first band whose sampled bits all agree; the number of bands where there is none."""
    found = []
    for a in range(0, len(x[0]), BATCH):
        differ = np.zeros((len(x[0][a : a + BATCH]), len(masks)), bool)
        for w, m in zip(x, masks.T):
            differ |= (w[a : a + BATCH, None] & m) != 0
        found.append(np.where(differ.all(1), len(masks), differ.argmin(1)))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def ring_close(x: list[np.ndarray], radius: int = RADIUS) -> np.ndarray:
    """Of XORs of pairs (word by word), a mask of those within ``radius`` bits; the ring filter comes before the count."""
    width = 64 * len(x) // SEGMENTS
    counts = [np.bitwise_count(w >> np.uint64(s) & np.uint64((1 << width) - 1)).astype(np.int16) for w in x for s in range(0, 64, width)]
    passed = np.zeros(len(x[0]), bool)
    for start in range(SEGMENTS):
        left = np.flatnonzero(~passed)
        total = np.zeros(len(left), np.int16)
        for length in range(1, SEGMENTS):
            total = total + counts[(start + length - 1) % SEGMENTS][left]
            ok = total * SEGMENTS <= length * radius
            left, total = left[ok], total[ok]
        passed[left] = True
    at = np.flatnonzero(passed)
    passed[at] = sum(np.bitwise_count(w[at]).astype(np.int16) for w in x) <= radius
    return passed


def alike(a: np.ndarray, b: np.ndarray, level: float = LEVEL) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= level * (len(a) + len(b) - both)


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, node, n) of each row, hash of the text, code and size of its set, and the words of its fingerprint and parities."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                s = shingle_hashes(text)
                rows.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), *wide_fingerprint(s), *parities(s)))
            node, *rest = zip(*rows) if rows else ((),) * (2 + len(_FP + _ODD))
            cols = [batch["doc_id"], batch["t"], pa.array(np.array(node, np.uint64).view(np.int64)), *(pa.array(c, pa.int64()) for c in rest)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "node", "n", *_FP, *_ODD])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(each, ", ".join(f"{c} bigint" for c in ("doc_id", "t", "node", "n", *_FP, *_ODD)))


_COLUMNS = ["key", "band", "node", "n", "part", "block", *_FP, *_ODD]


def near(a: list[np.ndarray], b: list[np.ndarray], level: float, masks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows in ``_COLUMNS``: sizes and parities that allow the level, different parts, fingerprints within the radius.

    Blocks below zero are compared with each other, others only with another block. With
    ``masks`` only those pairs whose first shared band this is.
    """
    _, band, node_a, n_a, part_a, block_a, *words_a = a
    _, _, node_b, n_b, part_b, block_b, *words_b = b
    ok = (np.minimum(n_a, n_b) >= level * np.maximum(n_a, n_b)) & (part_a != part_b) & ((block_a < 0) | (block_a != block_b))
    at = np.flatnonzero(ok)
    x = [(p[at] ^ q[at]).view(np.uint64) for p, q in zip(words_a[: len(_FP)], words_b)]
    close = np.flatnonzero(ring_close(x))
    left = at[close]
    odd = [(p[left] ^ q[left]).view(np.uint64) for p, q in zip(words_a[len(_FP) :], words_b[len(_FP) :])]
    close = close[may_be_alike(odd, n_a[left] + n_b[left], level)]
    if masks is not None and len(close):
        close = close[first_shared([w[close] for w in x], masks) == band[at[close]]]
    if len(close):
        at, x = at[close], [w[close] for w in x]
        ends = node_a[at], node_b[at]
        bits = sum(np.bitwise_count(w).astype(np.int32) for w in x)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*ends)), pa.array(np.minimum(*ends)), pa.array(bits)], names=["a", "b", "bits"])


def star(level: float, size: int | None = None) -> Callable:
    """Each set of a band with the band's first, which alone stays in memory.

    Keys of more than ``size`` sets are told beside the pairs: as (key, sets, -1).
    """
    size = KEY_SETS if size is None else size

    def large(keys: list[int], counts: list[int]) -> Iterator[pa.RecordBatch]:
        told = [(k, n) for k, n in zip(keys, counts) if n > size]
        if told:
            k, n = zip(*told)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array([-1] * len(told), pa.int32())], names=["a", "b", "bits"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[np.ndarray] | None = None
        open_: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch[c].to_numpy() for c in _COLUMNS]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
            keys, counts = rows[0][starts].tolist(), np.diff(np.append(starts, len(rows[0]))).tolist()
            if open_ is not None:
                if open_[0] == keys[0]:
                    counts[0] += open_[1]
                else:
                    keys, counts = [open_[0], *keys], [open_[1], *counts]
            yield from large(keys[:-1], counts[:-1])
            open_ = keys[-1], counts[-1]
            if first is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(first, rows)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = rows[0][1:] != rows[0][:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            first = [x[lead[-1] : lead[-1] + 1] for x in rows]
            at = np.flatnonzero(~new)
            yield from near([x[at] for x in rows], [x[lead[at]] for x in rows], level)
        if open_ is not None:
            yield from large([open_[0]], [open_[1]])

    return each


def crossing(level: float, masks: np.ndarray) -> Callable:
    """All pairs of a band that lie in different parts, each in the first band that it shares."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch[c].to_numpy() for c in _COLUMNS]
            ends = np.flatnonzero(np.diff(rows[0])) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if waiting and (cut or waiting[0][0][0] != rows[0][0]):
                whole = waiting if waiting[0][0][0] != rows[0][0] else [*waiting, [x[: int(ends[0])] for x in rows]]
                done = len(whole[-1][0]) if len(whole) > len(waiting) else 0
                yield from pairs([np.concatenate(x) for x in zip(*whole)])
                rows, cut, waiting = [x[done:] for x in rows], cut - done, []
            if cut:
                yield from pairs([x[:cut] for x in rows])
            waiting.append([x[cut:] for x in rows])
        if waiting:
            yield from pairs([np.concatenate(x) for x in zip(*waiting)])

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; those of keys with one part are left out first."""
        key, part = rows[0], rows[_COLUMNS.index("part")]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        several = np.zeros(group[-1] + 1, bool)
        several[group[1:][~new[1:] & (part[1:] != part[:-1])]] = True
        rows = [x[several[group]] for x in rows]
        if not len(rows[0]):
            return
        new = np.ones(len(rows[0]), bool)
        new[1:] = rows[0][1:] != rows[0][:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(new)) - 1  # rows of the key behind each
        for a in range(0, len(new), PAIRS):
            own, step = np.arange(a, min(a + PAIRS, len(new))), 1
            while len(own := own[left[own] >= step]):
                yield from near([x[own] for x in rows], [x[own + step] for x in rows], level, masks)
                step += 1

    return each


def in_blocks(sent: DataFrame, large: DataFrame, size: int | None = None) -> DataFrame:
    """``sent`` with ``block``; the keys of ``large`` (large, sets) are cut: a row for each pair of blocks that its own is in.

    A pair of blocks gets a key of its own. Block -1 stands for whole keys and for a block met with itself.
    """
    n = large.count()
    if not n:
        return sent.withColumn("block", F.lit(-1).cast("long"))
    cut = large.select("large", F.ceil(F.col("sets") / (size or KEY_SETS)).cast("int").alias("blocks"))
    rows = sent.join(F.broadcast(cut) if n <= LARGE_KEYS else cut, F.col("key") == F.col("large"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    met = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    block = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long")
    return met.withColumns({"key": F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair), "block": block}).drop("large", "blocks", "own", "other")


def candidates(sent: DataFrame, pairs_of: Callable) -> DataFrame:
    """(a, b, bits) that ``pairs_of`` makes of the sets of each band of ``sent``; bits is how many differ."""
    rows = sent.repartition("key").sortWithinPartitions("key", "node").select(_COLUMNS)
    return rows.mapInArrow(pairs_of, "a bigint, b bigint, bits int")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, level: float) -> DataFrame:
    """Of ``pairs`` those that are alike, by the texts of ``docs`` that stand for the ``nodes``."""
    pairs = kept(pairs, "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t"), "node")
    texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).join(asked, "t")
    texts = kept(texts.dropDuplicates(["node"]).select("node", "text"), "asked")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in "abxy")):
                for node, text in ((a, x), (b, y)):
                    if node not in known:
                        known[node] = shingle_hashes(text)
                        size += len(known[node])
                good.append(alike(known[a], known[b], level))
                if size > REMEMBERED:
                    known, size = {}, 0
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return kept(rows.mapInArrow(check, "a bigint, b bigint"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """Per row of ``docs``: doc_id, t (hash of its text), component_id, first (it stands for its component).

    ``component_id`` is the smallest id reachable over links of similarity ``level`` or more;
    the component's ``first`` rows are those of one text with that id.

    Defined cases: null text is empty, and texts without words are alike; fewer words than a
    shingle are one shingle; a null id is never a component's id unless the component has no
    other, and never ``first`` else; repeated rows give a row each; an empty table gives no
    rows; other columns are ignored.
    """
    of = kept(shingled(docs, id_col, text_col), "shingled")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("least")
    nodes = kept(of.groupBy("node").agg(least, F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("n", *_FP, *_ODD))), "nodes")
    masks = band_masks(*band_plan(nodes.count(), level))
    keys = band_keys([F.col(c) for c in _FP], masks)
    edges, parts = None, None
    for turn in range(ROUNDS + 1):
        now = nodes.withColumn("part", F.col("node"))
        if parts is not None:
            now = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        sent = now.select(F.posexplode(keys).alias("band", "key"), "node", "n", "part", *_FP, *_ODD)
        if turn < ROUNDS:
            place = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
            told = kept(candidates(sent.withColumn("block", F.lit(-1).cast("long")), star(level)), "told")
            large = told.where("bits < 0").select(F.col("a").alias("large"), F.col("b").alias("sets"))
            pairs = told.where("bits >= 0").distinct().withColumn("place", place).where(F.col("place") <= NEAREST)
        else:
            pairs = candidates(in_blocks(sent, large), crossing(level, masks))
        more = verified(pairs.select("a", "b"), nodes, docs, text_col, level)
        edges = more if edges is None else edges.unionByName(more)
        if parts is None or not more.isEmpty():
            parts = components(edges).withColumnRenamed("component", "part")
    label = nodes.join(parts, "node", "left").select("node", "least", F.coalesce("part", "node").alias("part"))
    ids = label.groupBy("part").agg(F.min("least").alias("of"))
    known = label.join(ids, "part").select("node", "of")
    first = F.coalesce((F.col("doc_id") == F.col("of.doc_id")) & (F.col("t") == F.col("of.t")), F.col("of").isNull())
    return of.join(known, "node").select("doc_id", "t", F.col("of.doc_id").alias("component_id"), first.alias("first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """The document with the smallest id of each group stays; rows with a null id stay.

    Each row is decided by its id and text: of rows that share an id those go whose own text
    is not the one that stands for its group; rows that repeat both id and text stay together
    or go together. Columns keep their names, whatever they are.
    """
    gone = similar_groups(docs, id_col, text_col, level).where(~F.col("first") & F.col("doc_id").isNotNull())
    return without(docs, gone.select("doc_id", "t"), id_col, text_col)
