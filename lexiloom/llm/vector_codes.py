"""Vector codes by integer product quantisation.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. A part's nearest entry is found in the Walsh-Hadamard domain: the transform of a
zero-padded part of length m multiplies squared distances by m, so sums of squared
differences of coefficients, taken in sequency order, are lower bounds of m times the
distance. An entry goes as soon as its sum is above m times a distance already known in
full. All of it is integer arithmetic, so codes and errors are exact.

A round of training is one pass over the table: each task adds up its parts by entry, Spark
adds the tasks' sums, and only the codebooks' own size reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.common import kept

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows coded at a time inside a task.
BATCH = 4096


@lru_cache(None)
def sequency(m: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of order ``m`` (a power of two), rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Coefficients (sequency order) of the last axis, zero-padded to a power of two."""
    size = parts.shape[-1]
    m = 1 << max(0, size - 1).bit_length()
    return parts @ sequency(m)[:, :size].T


def steps(m: int) -> list[tuple[int, int]]:
    """Runs of coefficients taken together: 1, 1, 2, 4, ..."""
    edges = [0, 1]
    while edges[-1] < m:
        edges.append(2 * edges[-1])
    return list(zip(edges, edges[1:]))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part ``x`` (n, size) in ``book`` (k, size); ties to the lower entry.

    The smallest sum over the first coefficients names a guess, whose distance bounds the
    rest from above. Entries whose sum exceeds the bound cannot be nearest; those equal to
    it stay, so ties are seen.
    """
    tx, tb = transformed(x), transformed(book)
    n, m = tx.shape
    runs = steps(m)
    sums = np.zeros((n, len(book)), np.int64)
    for begin, stop in runs[:2]:
        for k in range(begin, min(stop, m)):
            sums += (tx[:, k, None] - tb[None, :, k]) ** 2
    guess = sums.argmin(1)
    bound = ((tx - tb[guess]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for begin, stop in runs[2:]:
        sums += ((tx[row, begin:stop] - tb[entry, begin:stop]) ** 2).sum(1)
        left = sums <= bound[row]
        row, entry, sums = row[left], entry[left], sums[left]
    # what is left has its full sum; rows are in order, entries ascend within a row
    first = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(sums, first) if n else sums
    hit = np.flatnonzero(sums == best[row])
    at = hit[np.searchsorted(row[hit], np.arange(n))]
    return entry[at], best // m


def usable(v: Column) -> Column:
    """Whether a vector is coded: not null, and no component null or non-finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integer_parts(column: pa.Array, size: int, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """(rows, parts, size) of floor(scale * component), shorter vectors padded with zeros."""
    width = size * parts
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    m = 1 << max(0, size - 1).bit_length()
    if len(flat) and np.abs(flat).max() * 2 * m >= 2**31:
        raise ValueError("a component is too large to be coded exactly in 64 bits")
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat.astype(np.int64)
    return out.reshape(-1, parts, size)


class Codebooks:
    """The entries of each part position: (parts, entries, size) integers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.parts, _, self.size = entries.shape

    def assign(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows: their parts, the entries and the squared distances, each (rows, parts)."""
        for at in range(0, len(column), BATCH):
            x = integer_parts(column.slice(at, BATCH), self.size, self.parts)
            found = [nearest(x[:, p], self.entries[p]) for p in range(self.parts)]
            yield x, np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)

    def refined(self, rows: DataFrame) -> Codebooks:
        """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
        parts, k, size = self.entries.shape

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, k, size), np.int64), np.zeros((parts, k), np.int64)
            for batch in batches:
                for x, entry, _ in self.assign(batch["v"]):
                    for p in range(parts):
                        np.add.at(total[p], entry[:, p], x[:, p])
                        np.add.at(count[p], entry[:, p], 1)
            used = np.argwhere(count)
            p, e = used[:, 0], used[:, 1]
            sums = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], names=["p", "e", "n", "sums"])

        each = rows.mapInArrow(add, "p int, e int, n bigint, sums array<bigint>").select("p", "e", "n", F.posexplode("sums").alias("d", "s"))
        found = each.groupBy("p", "e", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        entries = self.entries.copy()
        # at most parts x entries x size rows
        for r in found.collect():
            entries[r.p, r.e, r.d] = int(r.s) // r.n
        return Codebooks(entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids, ascending; equal ids by their vectors, null ids last."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = -(-longest // parts)
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    x = np.concatenate([integer_parts(c, size, parts) for c in least["v"].chunks])
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)))


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per usable row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    ``code`` has two hex digits for each part, ``error`` is the squared distance to the coded
    vector, ``label_error`` the sum of errors over equal labels.

    Defined cases: vectors that are null or hold null or non-finite components are dropped;
    vectors of different lengths, or of a length that the parts do not divide, are padded
    with zeros at the end, and an empty vector is all zeros; with fewer rows than entries the
    codebooks have as many entries as rows; rows that repeat an id are coded each; null ids
    come last among the first entries; null labels are one label; an empty table gives no
    rows; other columns, whatever their names, are ignored. Components so large that 64 bits
    could overflow raise an error.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v")).where(usable(F.col("v")))
    label = vectors.schema[label_col].dataType.simpleString()
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = first_codebooks(rows)
    for _ in range(rounds):
        books = books.refined(rows.select("v"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, entry, far in books.assign(batch["v"]):
                codes += [bytes(e).hex() for e in entry.astype(np.uint8)]
                errors.append(far.sum(1))
            error = np.concatenate(errors) if errors else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = kept(rows.mapInArrow(code, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
