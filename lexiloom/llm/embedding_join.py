"""Near-duplicate embeddings by a PCA-ordered, tiled comparison.

Vectors are scaled to length one and turned into the axes of their second moments, largest
first. Dots are accumulated over the leading axes; what the other axes can add is at most the
product of the two suffix norms, and a pair is given up as soon as that cannot reach the
threshold. The bound of the first axes comes out of one matrix product, as the suffix norm
is one more axis there.

A tree of median cuts, fitted on a bounded sample, deals the vectors into leaves. Each leaf
has a ball around it (over all its vectors), so two leaves are known to be too far apart, or
so close that all their pairs are links; neither are compared. Leaves are cut into tiles of
a bounded size, and a task compares one tile with another. A tile pair hands on, for each
vector, the number of links and one edge of a forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.common import components, kept, new_folder, scoped
from lexiloom.llm.simhash import forest

THRESHOLD = 0.9
#: Vectors of a tile, and the leading axes whose bound is taken first.
TILE, LEAD = 2048, 16
#: Numbers (rows x length) of the sample that the tree is fitted on, and of the leaves' centres.
SAMPLE_NUMBERS, CENTRE_NUMBERS = 1 << 22, 1 << 20
#: Pairs whose further axes are looked up at a time; above this share of a tile all are multiplied.
GATHER, DENSE = 1 << 18, 0.05
#: Rounding of bounds and of distances; pairs nearer to the threshold are decided by the plain formula.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that squares stay in range."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def plain_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in the order of their components."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Axes (columns) of the unit vectors' second moments, the largest first.

    Each task adds up its own matrix; groups of them are added before the driver adds the rest.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = unit(matrix(batch["v"], width))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for m in batch["m"].to_pylist():
                total += np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    each = nodes.select("v").mapInArrow(moments, "m binary")
    groups = isqrt(max(1, nodes.rdd.getNumPartitions()))
    total = sum(np.frombuffer(r.m) for r in each.repartition(groups).mapInArrow(add, "m binary").collect())
    values, axes = np.linalg.eigh(total.reshape(width, width))
    return axes[:, np.argsort(-values, kind="stable")]


@dataclass
class Tree:
    """Median cuts by axis, breadth first, and the mean of the sample in each leaf."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int
    centres: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Tree:
        axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [np.arange(len(sample))]
        for level in range(depth):
            after = []
            for k, rows in enumerate(parts):
                at = 2**level - 1 + k
                if len(rows):
                    axis[at] = sample[rows].var(0).argmax()
                    cut[at] = np.median(sample[rows, axis[at]])
                high = sample[rows, axis[at]] > cut[at]
                after += [rows[~high], rows[high]]
            parts = after
        centres = np.array([sample[rows].mean(0) if len(rows) else np.zeros(sample.shape[1]) for rows in parts])
        return cls(axis, cut, depth, centres)

    def leaf(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def linked_cells(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, dot) of rows of unit ``x`` and ``y``, in principal axes, whose dot may reach ``threshold``.

    With ``same`` the two are one tile and each pair comes once, without the row itself.
    """
    width = x.shape[1]
    stops = [s for s in (lead, 2 * lead) if s < width] + [width]
    tail = lambda z, k: np.sqrt((z[:, k:] ** 2).sum(1))
    first = stops[0]
    tx, ty = tail(x, first), tail(y, first)
    bound = np.hstack([x[:, :first], tx[:, None]]) @ np.hstack([y[:, :first], ty[:, None]]).T
    alive = bound >= threshold - SLACK
    if same:
        alive &= np.tri(len(x), dtype=bool).T
        np.fill_diagonal(alive, False)
    i, j = np.nonzero(alive)
    if len(stops) == 1:
        return i, j, bound[i, j]
    if len(i) > DENSE * alive.size:
        dots = x @ y.T
        close = dots[i, j] >= threshold - SLACK
        return i[close], j[close], dots[i[close], j[close]]
    part = bound[i, j] - tx[i] * ty[j]
    del bound, alive
    for begin, stop in zip(stops, stops[1:]):
        tx, ty = tail(x, stop), tail(y, stop)
        for a in range(0, len(i), GATHER):
            s = slice(a, a + GATHER)
            part[s] += np.einsum("nd,nd->n", x[i[s], begin:stop], y[j[s], begin:stop])
        close = part + tx[i] * ty[j] >= threshold - SLACK
        i, j, part = i[close], j[close], part[close]
    return i, j, part


def compare_tiles(a: dict, b: dict, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, number of linked vectors, root) of the vectors of two tiles that have links; root is -1 for a root."""
    same = a["tile"] == b["tile"]
    raw_a, raw_b = a["vectors"], b["vectors"]
    x = unit(raw_a) @ axes
    y = x if same else unit(raw_b) @ axes
    i, j, dot = linked_cells(x, y, same, threshold)
    unsure = np.flatnonzero(np.abs(dot - threshold) <= SLACK)
    drop = unsure[plain_cosine(raw_a[i[unsure]], raw_b[j[unsure]]) < threshold]
    i, j = np.delete(i, drop), np.delete(j, drop)
    if same:
        nodes, copies = a["nodes"], a["copies"]
    else:
        nodes, copies = np.concatenate([a["nodes"], b["nodes"]]), np.concatenate([a["copies"], b["copies"]])
        j = j + len(a["nodes"])
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    node, top = forest(len(nodes), i, j)
    root = np.full(len(nodes), -1, np.int64)
    root[node] = nodes[top]
    linked = np.flatnonzero(n)
    return nodes[linked], n[linked], root[linked]


_FOUND = "node bigint, n bigint, root bigint"


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "root"])


def _tiles(dealt: DataFrame, width: int) -> DataFrame:
    """(leaf, block, nodes, copies, vectors): a row for each tile of ``dealt`` (leaf, block, node, copies, v)."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        # the vectors keep the precision of their column
        kind = np.float32 if pa.types.is_float32(group.schema.field("v").type.value_type) else np.float64
        vectors = np.concatenate([matrix(c, width) for c in group["v"].chunks]).astype(kind)
        blobs = [group["node"].to_numpy().astype(np.int64), group["copies"].to_numpy().astype(np.int64), vectors]
        return pa.table([[key[0].as_py()], [key[1].as_py()], *([b.tobytes()] for b in blobs)], schema=pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]))

    return dealt.groupBy("leaf", "block").applyInArrow(pack, "leaf int, block int, nodes binary, copies binary, vectors binary")


def _compared(pairs: DataFrame, tiles: DataFrame, spread: int, axes: np.ndarray, kind: type, threshold: float) -> DataFrame:
    """``_FOUND`` of tile pairs (a, i, b, j). Tiles go to ``spread`` salted copies, so no tile's pairs meet in one task."""
    width = len(axes)
    sides = []
    for side in "xy":
        sent = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        leaf, block = ("a", "i") if side == "x" else ("b", "j")
        sides.append(sent.select(F.col("leaf").alias(leaf), F.col("block").alias(block), F.col("salt").alias(f"salt_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("nodes", "copies", "vectors"))))
    salted = pairs.withColumns({"salt_x": F.pmod(F.xxhash64("b", "j"), F.lit(spread)).cast("int"), "salt_y": F.pmod(F.xxhash64("a", "i"), F.lit(spread)).cast("int")})
    joined = salted.join(sides[0], ["a", "i", "salt_x"]).join(sides[1], ["b", "j", "salt_y"])

    def tile(row: dict, side: str) -> dict:
        vectors = np.frombuffer(row[f"vectors_{side}"], kind).reshape(-1, width).astype(np.float64)
        at = (row["a"], row["i"]) if side == "x" else (row["b"], row["j"])
        return {"tile": at, "vectors": vectors} | {c: np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("nodes", "copies")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                yield _found([compare_tiles(tile(row, "x"), tile(row, "y"), axes, threshold)])

    return joined.mapInArrow(each, _FOUND)


def _leaf_pairs(leaves: list, centres: np.ndarray, threshold: float, spark) -> DataFrame:
    """(a, b, whole) of leaves that may hold links; whole: all pairs are links. Each pair comes once, a <= b."""
    ids = np.array([r.leaf for r in leaves])
    at, radius = centres[ids], np.array([r.radius for r in leaves])
    reach = sqrt(2 - 2 * threshold)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_numpy():
                apart = np.sqrt(((at[k:] - at[k]) ** 2).sum(1))
                reached = radius[k:] + radius[k]
                near = np.flatnonzero(apart - reached <= reach + SLACK)
                whole = (apart + reached)[near] <= reach - SLACK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[k]), pa.int32()), pa.array(ids[k:][near], pa.int32()), pa.array(whole)], names=["a", "b", "whole"])

    return spark.range(len(leaves)).mapInArrow(each, "a int, b int, whole boolean")


def links(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``_FOUND`` for distinct usable vectors ``nodes`` (node, copies, v).

    For each node n adds up, over its rows, to the copies of the vectors linked to it; edges
    (node, root) join whatever is linked.
    """
    spark = nodes.sparkSession
    count, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if count < 2:
        return spark.createDataFrame([], _FOUND)
    kind = np.float32 if nodes.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    axes = principal_axes(nodes, width)
    rows = min(count, max(2, SAMPLE_NUMBERS // width))
    depth = max(0, min(ceil(np.log2(count / tile)), int(np.log2(max(1, CENTRE_NUMBERS // width))), int(np.log2(rows / 4)) if rows >= 4 else 0))
    sample = nodes.orderBy(F.xxhash64("node")).limit(rows).select("v").toArrow().combine_chunks()
    tree = Tree.fit(np.concatenate([unit(matrix(c, width)) for c in sample["v"].chunks]) @ axes, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unit(matrix(batch["v"], width)) @ axes
            leaf = tree.leaf(y)
            far = np.sqrt(((y - tree.centres[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["copies"], batch["v"], pa.array(leaf, pa.int32()), pa.array(far)], names=["node", "copies", "v", "leaf", "far"])

    shape = f"node bigint, copies bigint, v {nodes.schema['v'].dataType.simpleString()}, leaf int, far double"
    dealt = kept(nodes.select("node", "copies", "v").mapInArrow(deal, shape), "dealt")
    leaves = dealt.groupBy("leaf").agg(F.max("far").alias("radius"), F.count("*").alias("size"), F.sum("copies").alias("total"), F.min("node").alias("rep")).orderBy("leaf").collect()
    pairs = kept(_leaf_pairs(leaves, tree.centres, threshold, spark), "leaf-pairs")
    blocks = {r.leaf: ceil(r.size / tile) for r in leaves}
    of_leaf = spark.createDataFrame([(r.leaf, blocks[r.leaf], r.total, r.rep) for r in leaves], "leaf int, blocks int, total bigint, rep bigint")

    # leaves whose pairs are not all links: tile by tile
    sized = pairs.where("not whole").join(F.broadcast(of_leaf.select(F.col("leaf").alias("a"), F.col("blocks").alias("na"))), "a").join(F.broadcast(of_leaf.select(F.col("leaf").alias("b"), F.col("blocks").alias("nb"))), "b")
    tile_pairs = sized.withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("j", F.explode(F.expr("sequence(if(a = b, i, 0), nb - 1)"))).select("a", "i", "b", "j")
    blocked = dealt.join(F.broadcast(of_leaf.select("leaf", "blocks")), "leaf").select("leaf", F.pmod("node", "blocks").cast("int").alias("block"), "node", "copies", "v")
    tiles = kept(_tiles(blocked, width), "tiles")
    spread = ceil(sum(blocks.values()) / 64)
    compared = _compared(tile_pairs, tiles, spread, axes, kind, threshold)

    # leaves whose pairs are all links: counted by their totals, joined through one vector of each
    whole = pairs.where("whole")
    ends = whole.select("a", "b").union(whole.where("a <> b").select("b", "a")).toDF("leaf", "other")
    met = ends.join(F.broadcast(of_leaf.select(F.col("leaf").alias("other"), "total", "rep")), "other")
    sums = met.groupBy("leaf").agg(F.sum("total").alias("total"), F.min("rep").alias("rep"), F.max(F.col("leaf") == F.col("other")).alias("own"))
    of_all = dealt.join(F.broadcast(sums), "leaf").select("node", (F.col("total") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"), F.when(F.col("rep") == F.col("node"), -1).otherwise(F.col("rep")).alias("root"))
    reps = of_leaf.select("leaf", "rep")
    between = whole.where("a <> b").join(F.broadcast(reps.toDF("a", "node")), "a").join(F.broadcast(reps.toDF("b", "root")), "b").select("node", F.lit(0).cast("long").alias("n"), "root")
    return compared.unionByName(of_all).unionByName(between)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose cosine is ``threshold`` or more, ``component_id`` is
    the smallest id reachable over links, ``kept`` whether that is the row's own. Every pair
    is compared or bounded; nothing is searched approximately. Equal vectors are compared once.

    Defined cases: a vector that is null, empty, all zero, or holds a null or a non-finite
    component has no links and is its own component; vectors of different lengths are
    compared as if padded with zeros; a null id is never a component's id unless the
    component has no other, and is not kept; rows that repeat an id are rows of their own
    (copies, if their vectors are equal); an empty table gives no rows; other columns,
    whatever their names, are ignored. Leaves' centres and the tree's sample are bounded
    (``CENTRE_NUMBERS``, ``SAMPLE_NUMBERS``); leaves that outgrow a tile are cut into blocks.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    fit = rows.where(usable(F.col("v")))
    # -0.0 and 0.0 are one key here, as in any grouping
    nodes = kept(fit.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    folder = new_folder(vectors.sparkSession, "links")
    with scoped(vectors.sparkSession):
        found = kept(links(nodes, threshold), "links", folder)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where("root >= 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(counts, "node", "left").join(joined, "node", "left").select("v", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    ids = nodes.join(joined, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    info = known.join(ids, "component", "left").select("v", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    lone = rows.where(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = fit.join(info, "v").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
