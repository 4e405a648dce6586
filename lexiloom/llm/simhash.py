"""SimHash near-duplicates with a pigeonring filter.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. Among any six blocks
of the bits three are equal in such a pair, so each distinct fingerprint is sent to twenty
keys of three blocks. Inside a key the ring filter prunes: over the ring of four segments
some chain of consecutive segments must keep its cumulative difference within its share of
the radius at every length. What is left is compared in full.

A key may hold very many fingerprints of one group of near copies. Its task never compares
more than a bounded number at once: a larger key is parted again by the equality of
further blocks of the bits that are still free, which again loses no pair, and each part
hands on no more links than join its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.common import components, cut

BITS, RADIUS, SEED, WORDS = 64, 3, 42, 3
BLOCKS, SEGMENTS = 6, 4
#: Fingerprints compared all with all, and shingles hashed at a time.
DENSE, BATCH = 512, 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the shingles; white space is ASCII's, and only A-Z are lower-cased."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    n = max(1, len(toks) - words + 1)
    flat = b" ".join(toks)
    sizes = np.fromiter(map(len, toks), np.int64, len(toks)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(words, len(toks)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, BATCH):
        shingles = [flat[i:j] for i, j in zip(starts[a : a + BATCH], stops[a : a + BATCH])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of each row; null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(t, words) for t in batch["text"].to_pylist()], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id bigint, fp bigint")


def spread(bits: int, parts: int) -> list[int]:
    """Masks of ``parts`` even runs of the set bits of ``bits``."""
    at = [k for k in range(BITS) if bits >> k & 1]
    return [sum(1 << k for k in run) for run in np.array_split(np.array(at, object), parts) if len(run)]


def ring_close(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of XORs of pairs, the places of those within ``radius`` bits; the ring filter comes before the count."""
    masks = [np.uint64(m) for m in spread((1 << BITS) - 1, SEGMENTS)]
    found = []
    for start in range(SEGMENTS):
        left, chain = np.arange(x.size), np.uint64(0)
        for length in range(1, SEGMENTS):
            chain |= masks[(start + length - 1) % SEGMENTS]
            left = left[np.bitwise_count(x[left] & chain) <= length * radius // SEGMENTS]
        found.append(left)
    left = np.unique(np.concatenate(found))
    return left[np.bitwise_count(x[left]) <= radius]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the graph with edges i-j that are not their component's smallest."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def linked(fps: np.ndarray, free: int, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever is within ``radius`` among distinct ``fps`` that agree outside the ``free`` bits."""
    if len(fps) < 2:
        return []
    if len(fps) <= DENSE or free.bit_count() <= radius + 1:
        i, j = np.triu_indices(len(fps), 1)
        close = ring_close(fps[i] ^ fps[j], radius)
        node, root = forest(len(fps), i[close], j[close])
        return [(fps[node], fps[root])]
    out = []
    for mask in spread(free, radius + 1):
        part = fps & np.uint64(mask)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(fps[order], edges):
            out += linked(group, free & ~mask, radius)
    return out


def _plans(blocks: int, radius: int) -> list[int]:
    """Masks of the keys: all choices of blocks that leave ``radius`` of them out."""
    masks = spread((1 << BITS) - 1, blocks)
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints (fp) so that each is reachable from all within ``radius``."""
    plans = _plans(blocks, radius)
    keys = F.array(*[F.struct(F.lit(k).alias("plan"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(plans)])
    sent = distinct.select("fp", F.explode(keys).alias("k")).select("k.plan", "k.key", "fp")
    n = sent.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sent = sent.repartition(int(n), "plan", "key").sortWithinPartitions("plan", "key")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([a, batch[c].to_numpy()]) for a, c in zip(kept, ("plan", "key", "fp"))]
            if len(now[0]) == 0:
                continue
            ends = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            # the last key may go on in the next batch
            at = int(ends[-1]) if len(ends) else 0
            kept = [a[at:] for a in now]
            yield from emit(now[0][:at], now[2][:at], ends[:-1])
        yield from emit(kept[0], kept[2], np.empty(0, np.int64))

    def emit(plan: np.ndarray, fp: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], ends])
        stops = np.concatenate([ends, [len(fp)]])
        out = []
        for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
            out += linked(fp[a:b].view(np.uint64), (1 << BITS) - 1 & ~plans[plan[a]], radius)
        if out:
            ab = [np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ab], names=["a", "b"])

    return sent.mapInArrow(pair, "a bigint, b bigint")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of at most 3 differing bits.

    Defined cases: null text is empty, and texts without words have fingerprint zero, linked
    like any other; fewer words than a shingle are one shingle; a null id is never a
    component's id unless the component has no other; repeated rows give a row each; an
    empty table gives no rows; other columns are ignored.
    """
    of = cut(fingerprints(docs, id_col, text_col, words))
    least = cut(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    label = least.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = label.groupBy("component").agg(F.min("least").alias("component_id"))
    known = label.join(ids, "component").select("fp", "component_id")
    return of.join(known, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
