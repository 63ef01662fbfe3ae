"""Sharding by k-d tree partitioning under the law `bytes`.

A node of the tree is split at the weighted median (weight: bytes) of its widest metadata dimension, the one whose distinct values in the node span most of all
distinct values, until leaves reach the target: `fineness` leaves a shard. A node whose rows agree in every dimension is a leaf of any size. The leaves stand in the
tree's order, and a shard is a stretch of them.

The medians come from one mergeable summary of all rows: the bytes of each cell, that is of each combination of the dimensions' values. Values are whole, of any atomic
type, and are ranked among all of the table. A node of more than `cells_at_once` cells is split by histograms of ranks that narrow down to the median; all such nodes of a level go together. Each smaller
one is finished by a task of its own. Nothing is sampled: the tree is that of all rows, wherever this border lies. The bytes of leaves are counted
over all rows, and where a shard ends within a leaf, the cut is found there by histograms of the rows' places: 31 bits of a hash of id and text, then 32 bits by which
equal rows differ. So shards differ from the mean by about a row, and equal rows are cut apart like others.

Passes over the rows: two writes, the total, the cells, the leaves' bytes, one histogram for 11 bits of the places around a cut (two in most cases), the slots' buckets and the result. Cells are
read and written again for each level of nodes above the border.

Defined cases: null text: size 16; null dimension: before all values, NaN after them; repeated rows are placed each; an empty table gives
no rows. Equal texts are rows like others: they share a shard only by chance.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, only

PLACE_BITS, BIN_BITS = 63, 11
DIMENSIONS = ("lang", "source", "n_chars")
FINENESS, CELLS_AT_ONCE = 64, 1 << 15


def _plain(value):
    return float("inf") if isinstance(value, float) and value != value else value


@dataclass
class Tree:
    """Nodes as arrays: dim (-1: leaf), cut (index of a value of the dimension's `cuts`, -1: null), left and right (of leaves, left is the number in order)."""

    cuts: list[list]
    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, columns: list[pa.Array]) -> np.ndarray:
        """The leaf of each row."""
        codes = []
        for cuts, column in zip(self.cuts, columns, strict=True):
            names = column.dictionary_encode()
            known = np.array([bisect_left(cuts, _plain(v)) for v in names.dictionary.to_pylist()] + [-1], np.int64)
            codes.append(known[names.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)])
        code = np.stack(codes)
        dim, cut, left, right = (np.array(x, np.int64) for x in (self.dim, self.cut, self.left, self.right))
        at = np.zeros(code.shape[1], np.int64)
        while True:
            rows = np.flatnonzero(dim[at] >= 0)
            if not len(rows):
                return left[at]
            node = at[rows]
            at[rows] = np.where(code[dim[node], rows] <= cut[node], left[node], right[node])


def grow(values: list[list], weights: np.ndarray, leaf_weight: float) -> Tree:
    """The tree of rows. values: a list of row values per dimension."""
    distinct = [sorted({_plain(v) for v in column if v is not None}) for column in values]
    codes = np.array([[-1 if v is None else bisect_left(d, _plain(v)) for v in column] for d, column in zip(distinct, values, strict=True)], np.int64).reshape(len(values), -1)
    return split(Tree(distinct), codes, [max(1, len(d)) for d in distinct], weights, leaf_weight)


def split(tree: Tree, codes: np.ndarray, whole: list[int], weights: np.ndarray, leaf_weight: float) -> Tree:
    """The empty `tree`, grown over cells. codes: ranks by dimension and cell; whole: how many values a dimension has in all."""
    work: list[tuple[np.ndarray, int, bool]] = [(np.arange(codes.shape[1]), -1, False)]
    while work:  # depth first, left before right, so that leaves are numbered in order
        rows, parent, is_right = work.pop()
        me = len(tree.dim)
        if parent >= 0:
            (tree.right if is_right else tree.left)[parent] = me
        dim = widest([int(c[rows].max() - c[rows].min()) if len(rows) else 0 for c in codes], whole)
        if dim < 0 or weights[rows].sum() <= leaf_weight:
            for column, value in ((tree.dim, -1), (tree.cut, 0), (tree.left, tree.leaves), (tree.right, 0)):
                column.append(value)
            tree.leaves += 1
            continue
        mine = codes[dim][rows]
        order = np.argsort(mine, kind="stable")
        upto = np.cumsum(weights[rows][order])
        ends = np.flatnonzero(np.diff(mine[order]))  # a cut is after one of these
        cut = int(mine[order][ends[np.argmin(np.abs(upto[ends] - upto[-1] / 2))]])
        for column, value in ((tree.dim, dim), (tree.cut, cut), (tree.left, 0), (tree.right, 0)):
            column.append(value)
        work += [(rows[mine > cut], me, True), (rows[mine <= cut], me, False)]
    return tree


def widest(ranges: list[int], whole: list[int]) -> int:
    """The dimension that is split, -1 for none: of the greatest range of ranks as a share of all its values, the first of equal ones."""
    share = [r / w for r, w in zip(ranges, whole, strict=True)]
    dim = max(range(len(share)), key=lambda i: (share[i], -i))
    return dim if share[dim] else -1


def rank_values(cells: DataFrame, name: str, parts: int) -> tuple[DataFrame, DataFrame, int]:
    """value, code (rank from 0 among all values of the dimension that are not null); what it is made of, written; and how many there are. Sorted in `parts` ranges of values, not by one task."""
    values = cells.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct()
    ranges = materialise(values.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "kd-values")
    n, starts = 0, []
    for r in sorted(ranges.groupBy("part").count().collect()):
        starts.append((r["part"], n))
        n += r["count"]
    before = F.broadcast(ranges.sparkSession.createDataFrame(starts, "part int, start long"))
    row = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return ranges.withColumn("row", row).join(before, "part").select("value", (F.col("start") + F.col("row")).alias("code")), ranges, n


def rank_cells(rows: DataFrame, dims: list[str], rows_per_part: int = 50_000) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]], list[int]]:
    """The cells of all rows (node: 0, c0, c1, ...: ranks, null -1, weight: bytes), written; the values' ranks by dimension and what they are made of; how many values each has."""
    cells = materialise(rows.groupBy(*dims).agg(F.sum("size").alias("weight")), "kd-cells")
    parts = max(1, -(-cells.count() // rows_per_part))
    coded, ranks, whole = cells, [], []
    for i, name in enumerate(dims):
        codes, ranges, n = rank_values(cells, name, parts)
        mine = codes.select(F.col("value").alias(f"v{i}"), F.col("code").alias(f"c{i}"))
        coded = coded.join(mine, F.col(name) == F.col(f"v{i}"), "left")
        ranks.append((codes, ranges))
        whole.append(max(1, n))
    out = materialise(coded.select(F.lit(0).alias("node"), *[F.coalesce(f"c{i}", F.lit(-1).cast("long")).alias(f"c{i}") for i in range(len(dims))], "weight"), "kd-coded")
    discard(cells)
    return out, ranks, whole


def find_medians(cells: DataFrame, nodes: dict[int, dict]) -> None:
    """Sets `cut` of each of `nodes` (by number; dim, low and high: its ranks, weight): the rank after which its weight is parted most evenly, the lower of two. All are narrowed together."""
    axis = F.element_at(F.array(*[F.col(c) for c in cells.columns if c not in ("node", "weight")]), F.col("dim") + 1)
    for x in nodes.values():
        x |= {"from": x["low"], "bits": (x["high"] - x["low"]).bit_length(), "upto": 0, "last": None}
    todo = dict(nodes)
    while todo:
        frame = cells.sparkSession.createDataFrame([(k, x["dim"], x["from"], x["from"] + (1 << x["bits"]) - 1, max(0, x["bits"] - BIN_BITS)) for k, x in todo.items()], "at int, dim int, low long, high long, narrow int")
        near = cells.join(F.broadcast(frame), F.col("node") == F.col("at")).withColumn("code", axis).where("code between low and high")
        bins = near.groupBy("node", F.expr("shiftright(code - low, narrow)").alias("bin")).agg(F.sum("weight").alias("weight"), F.max("code").alias("last")).collect()
        mine: dict[int, list] = {k: [] for k in todo}
        for r in bins:
            mine[r["node"]].append((r["bin"], int(r["weight"]), r["last"]))
        for k, x in list(todo.items()):
            x["bits"] = max(0, x["bits"] - BIN_BITS)
            for bin_, weight, last in sorted(mine[k]):
                if 2 * (x["upto"] + weight) < x["weight"]:
                    x["upto"], x["last"] = x["upto"] + weight, last
                    continue
                x["from"] += bin_ << x["bits"]
                if not x["bits"]:  # the cut is after this rank or after the one before it; not after a node's last
                    over, under = 2 * (x["upto"] + weight) - x["weight"], x["weight"] - 2 * x["upto"]
                    x["cut"] = x["last"] if x["last"] is not None and (last == x["high"] or under <= over) else last
                    del todo[k]
                break


def grow_over(rows: DataFrame, dims: list[str], leaf_weight: float, cells_at_once: int = CELLS_AT_ONCE) -> Tree:
    """The tree of all `rows` (size and `dims`), the same as `grow` gives."""
    cells, ranks, whole = rank_cells(rows, dims)
    columns = [f"c{i}" for i in range(len(dims))]
    top: dict[int, tuple[int, int, int, int]] = {}  # dim, cut, left, right
    small, fresh, count = [], [0], 1
    while fresh:
        stats = cells.where(F.col("node").isin(fresh)) if len(top) else cells
        seen = stats.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).collect()
        cut: dict[int, dict] = {}
        for r in seen:
            dim = widest([r[f"max_{c}"] - r[f"min_{c}"] for c in columns], whole)
            if dim < 0 or r["weight"] <= leaf_weight:
                continue  # a leaf
            if r["n"] <= cells_at_once:
                small.append(r["node"])
            else:
                cut[r["node"]] = {"dim": dim, "low": r[f"min_c{dim}"], "high": r[f"max_c{dim}"], "weight": int(r["weight"])}
        fresh = []
        if cut:
            find_medians(cells, cut)
            for k, x in sorted(cut.items()):
                top[k] = (x["dim"], x["cut"], count, count + 1)
                fresh += [count, count + 1]
                count += 2
            frame = F.broadcast(cells.sparkSession.createDataFrame([(k, *top[k]) for k in cut], "at int, dim int, cut long, left int, right int"))
            side = F.when(F.element_at(F.array(*columns), F.col("dim") + 1) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
            before, cells = cells, materialise(cells.join(frame, F.col("node") == F.col("at"), "left").select(F.coalesce(side, "node").alias("node"), *columns, "weight"), "kd-level")
            discard(before)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        tree = split(Tree([]), part[columns].to_numpy(np.int64).T, whole, part["weight"].to_numpy(np.int64), leaf_weight)
        return pd.DataFrame({"node": part["node"].iloc[0], "i": np.arange(len(tree.dim)), "dim": tree.dim, "cut": tree.cut, "left": tree.left, "right": tree.right})

    below: dict[int, dict[int, tuple]] = {k: {} for k in small}
    for r in cells.where(F.col("node").isin(small)).groupBy("node").applyInPandas(finish, "node int, i int, dim int, cut long, left int, right int").collect():
        below[r["node"]][r["i"]] = (r["dim"], r["cut"], r["left"], r["right"])
    discard(cells)
    tree = _joined(top, below, len(dims))
    for d, (codes, ranges) in enumerate(ranks):
        mine = [i for i, x in enumerate(tree.dim) if x == d]
        used = codes.join(F.broadcast(codes.sparkSession.createDataFrame([(c,) for c in sorted({tree.cut[i] for i in mine})], "code long")), "code").orderBy("code").collect()
        at = {r["code"]: i for i, r in enumerate(used)}
        tree.cuts[d] = [_plain(r["value"]) for r in used]
        for i in mine:
            tree.cut[i] = at.get(tree.cut[i], -1)
        discard(ranges)
    return tree


def _joined(top: dict[int, tuple], below: dict[int, dict[int, tuple]], dims: int) -> Tree:
    """One tree of the nodes of `top` and the trees of `below`, depth first; what is in neither is a leaf. Cuts are ranks still."""
    tree = Tree([[] for _ in range(dims)])
    work = [(0, 0, -1, False)]
    while work:
        k, i, parent, is_right = work.pop()
        me = len(tree.dim)
        if parent >= 0:
            (tree.right if is_right else tree.left)[parent] = me
        dim, cut, left, right = top[k] if k in top else below.get(k, {}).get(i, (-1, 0, 0, 0))
        leaf = dim < 0
        for column, value in ((tree.dim, dim), (tree.cut, cut), (tree.left, tree.leaves if leaf else 0), (tree.right, 0)):
            column.append(value)
        if leaf:
            tree.leaves += 1
        elif k in top:
            work += [(right, 0, me, True), (left, 0, me, False)]
        else:
            work += [(k, right, me, True), (k, left, me, False)]
    return tree


def find_cuts(leafed: DataFrame, sizes: list[int], shards: int) -> list[tuple[int, int]]:
    """(leaf, place) of the first row of each shard but the first, in the order of leaf and place; `sizes` are the leaves' bytes. All cuts are narrowed together."""
    upto = np.cumsum(sizes)
    open_cuts = []
    for k in range(1, shards):
        target = int(upto[-1]) * k / shards
        leaf = int(np.searchsorted(upto, target))
        open_cuts.append({"leaf": leaf, "low": 0, "bits": PLACE_BITS, "room": target - (int(upto[leaf - 1]) if leaf else 0)})
    todo = dict(enumerate(open_cuts))
    while todo:
        frame = leafed.sparkSession.createDataFrame([(k, c["leaf"], c["low"], c["low"] + (1 << c["bits"]) - 1, max(0, c["bits"] - BIN_BITS)) for k, c in todo.items()], "k int, at int, low long, high long, narrow int")
        near = leafed.select("leaf", "place", "size").join(F.broadcast(frame), (F.col("leaf") == F.col("at")) & F.col("place").between(F.col("low"), F.col("high")))
        bins = near.groupBy("k", F.expr("shiftright(place - low, narrow)").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place").alias("first")).collect()
        for k, c in list(todo.items()):
            c["bits"] = max(0, c["bits"] - BIN_BITS)
            mine = sorted((r["bin"], int(r["size"]), r["n"], r["first"]) for r in bins if r["k"] == k)
            for i, (bin_, size, n, first) in enumerate(mine):
                if size <= c["room"] and i < len(mine) - 1:
                    c["room"] -= size
                    continue
                if n == 1 or not c["bits"]:
                    # One row, or rows that agree in all bits: they go to the nearer side.
                    c["place"] = first + (size / 2 <= c["room"])
                    del todo[k]
                else:
                    c["low"] += bin_ << c["bits"]
                break
    return [(c["leaf"], c["place"]) for c in open_cuts]


def number_slots(df: DataFrame, n_rows: int, rows_per_bucket: int = 50_000) -> DataFrame:
    """`df` (shard, place, ...) with slot: gapless from 0 in each shard, in buckets of a hash of the place so that no shard is sorted by one task."""
    n = max(1, -(-n_rows // rows_per_bucket))
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(n)))
    sizes = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    row = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32")) - 1
    ranked = bucketed.withColumn("row", row)
    return ranked.join(starts, (ranked["shard"] == starts["s"]) & (ranked["bucket"] == starts["b"])).withColumn("slot", (F.col("start") + F.col("row")).cast("long")).drop("s", "b", "bucket", "start", "row")


def _shard_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of cuts that are not after the row."""
    first = F.array(*[F.struct(F.lit(leaf).cast("int").alias("leaf"), F.lit(place).cast("long").alias("place")) for leaf, place in cuts])
    row = F.struct(F.col("leaf").alias("leaf"), F.col("place").alias("place"))
    return F.size(F.filter(first, lambda c: c <= row)) if cuts else F.lit(0)


def _number(df: DataFrame, name: str) -> Column:
    """The column, NaN as infinity."""
    return F.nanvl(name, F.lit(float("inf")).cast(df.schema[name].dataType)).alias(name) if df.schema[name].dataType.simpleString() in ("float", "double") else F.col(name)


def shard(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = DIMENSIONS, fineness: int = FINENESS, cells_at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot per row of `docs`."""
    names = [f"d_{d}" for d in dims]
    src = only(docs, doc_id="doc_id", text="text", **dict(zip(names, dims, strict=True)))
    text = F.coalesce("text", F.lit(""))
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), text), 33)
    apart = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << 32) - 1)
    sized = src.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.shiftleft(key, 32).bitwiseOR(apart).alias("place"), *[_number(src, d) for d in names])
    rows = materialise(sized, "kd-rows")
    seen = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).collect()[0]
    tree = grow_over(rows, names, seen["size"] / (shards * fineness), cells_at_once)

    def place_in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of([batch.column(i) for i in range(4, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(leaf.astype(np.int32))], names=[*batch.schema.names[:4], "leaf"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    leafed = materialise(rows.mapInArrow(place_in_leaves, f"doc_id {kind}, size long, text_crc32 long, place long, leaf int"), "kd-leaves")
    discard(rows)
    sizes = [0] * max(1, tree.leaves)
    for r in leafed.groupBy("leaf").agg(F.sum("size").alias("size")).collect():
        sizes[r["leaf"]] = int(r["size"])
    cuts = find_cuts(leafed, sizes, shards) if seen["n"] else []
    placed = leafed.withColumn("shard", _shard_of(cuts))
    return number_slots(placed, seen["n"]).select("doc_id", "size", "text_crc32", "shard", "slot")
