"""Random forests of Spark ML's kind, grown from the sums of rows that share all bins.

Features are binned once. Rows lie ranged by their bins (a cell), so that a task sums the draws of a cell's rows for
every tree and sends one small row a cell and tree, not one a row. A node that holds few cells is grown to its leaves
in one task, level by level over all its nodes; while a node holds more, as on many continuous features, its
split is found from histograms that tasks sum over all cells, a job a level for all trees at once. Trees reach
the driver as arrays, at most 2^(depth + 1) nodes each, and rows never do.

Draws are Poisson counts by row and tree, from a hash of the place that a row has in the partitions given. It is
written with the row, so a task that is run again draws the same. Node rules count drawn rows. A split sends values up to an edge to the left.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import DataFrame, GroupedData, functions as F, types as T

from gridloom.operators.trees import bin_edges
from gridloom.session import settle

# Ship these functions with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Rows that a task sums at once, and cells that one task grows a node from.
PIECE_ROWS = 1 << 18
NODE_CELLS = 1 << 20
#: Cells of all trees that are sent at once.
SENT_CELLS = 1 << 26
#: Gains below this share of the target's sum of squares come from rounding, as do deviations below this share of its mean.
LEAST_SHARE = 1e-12
NO_CUT = 0xFFFF


@dataclass
class Tree:
    """Nodes as arrays; the right child follows the left, a leaf is its own left child. Bins above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    KINDS = (np.uint16, np.uint16, np.int32, np.float64)

    def to_bytes(self) -> bytes:
        return b"".join(a.astype(k).tobytes() for a, k in zip(vars(self).values(), self.KINDS))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Tree:
        n, at, out = len(blob) // 16, 0, []
        for kind in cls.KINDS:
            out.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*out)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        rows, wide = np.arange(len(bins)) * bins.shape[1], bins.ravel()
        node = np.zeros(len(bins), np.int64)
        while len(bins):
            following = self.left[node] + (wide[rows + self.feature[node]] > self.cut[node])
            if np.array_equal(following, node):
                break
            node = following
        return node


@dataclass(frozen=True)
class Rules:
    depth: int
    least_rows: int
    features_per_node: int
    seed: int
    least_gain: float
    widest: int  # bins of a feature, the missing one included


def split_edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Values that may end a left side: all but the largest of few distinct values, else quantiles."""
    far = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if far[c] <= 2 * bins]
    found = {}
    if few:
        values = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first()
        found = {c: sorted(v for v in values[c] if not math.isnan(v)) for c in few}
        found = {c: v[:-1] for c, v in found.items() if len(v) <= bins}
    many = [c for c in columns if c not in found]
    if many:
        found |= bin_edges(rows, many, bins)
    return [np.array(found[c], np.float64) for c in columns]


def bins_of(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """By row the bin of each feature: 0 where it is missing, else one more than the number of edges below it."""
    wide = np.uint8 if all(len(e) < 255 for e in edges) else np.uint16
    out = np.empty((len(values[0]) if values else 0, len(edges)), wide)
    for i, (x, e) in enumerate(zip(values, edges)):
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(e, x) + 1)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """How often each row is drawn for a tree: Poisson counts from a hash of the row's key."""

    def __init__(self, mean: float, seed: int):
        self.seed = seed
        term = total = math.exp(-mean)
        ends = []
        while total < 1 - 1e-15 and term:
            ends.append(total)
            term *= mean / len(ends)
            total += term
        self.ends = (np.array(ends) * 2.0**64).astype(np.uint64)
        first = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
        low = np.searchsorted(self.ends, first, "right")
        high = np.searchsorted(self.ends, first | np.uint64((1 << 48) - 1), "right")
        self.table = np.where(low == high, low, -1).astype(np.int32)

    def of(self, keys: np.ndarray, tree: int) -> np.ndarray:
        salt = _mix(np.array([(self.seed << 32) + tree + 1], np.uint64))
        hashed = _mix(keys ^ salt)
        drawn = self.table[(hashed >> np.uint64(48)).astype(np.int64)]
        unsure = np.flatnonzero(drawn < 0)
        drawn[unsure] = np.searchsorted(self.ends, hashed[unsure], "right")
        return drawn


def _best(weight: np.ndarray, total: np.ndarray, allowed: np.ndarray, rules: Rules):
    """The best split of each node from its sums by (node, feature, bin): gain, feature, cut, sums of the left."""
    left_w, left_s = np.cumsum(weight, 2), np.cumsum(total, 2)
    w, s = left_w[:, :1, -1:], left_s[:, :1, -1:]
    left_w, left_s = left_w[:, :, :-1], left_s[:, :, :-1]
    right_w, right_s = w - left_w, s - left_s
    fits = (left_w >= rules.least_rows) & (right_w >= rules.least_rows) & allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_s * left_s / left_w + right_s * right_s / right_w - s * s / w, -1.0)
    n, k, b = gain.shape
    at = gain.reshape(n, k * b).argmax(1)
    each = np.arange(n)
    feature, cut = at // b, at % b
    return gain.reshape(n, k * b)[each, at], feature, cut, left_w[each, feature, cut], left_s[each, feature, cut]


def _allowed(nodes: int, features: int, rules: Rules, *where: int) -> np.ndarray:
    """Which features each node may split by."""
    if rules.features_per_node >= features:
        return np.ones((nodes, features), bool)
    order = np.random.default_rng([rules.seed, *where]).random((nodes, features)).argsort(1)
    return order.argsort(1) < rules.features_per_node


def _histogram(bins: np.ndarray, node: np.ndarray, nodes: int, widest: int, facts: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of each fact by (node, feature, bin)."""
    start = node.astype(np.int64) * widest
    out = [np.empty((nodes, bins.shape[1], widest)) for _ in facts]
    for f in range(bins.shape[1]):
        place = start + bins[:, f]
        for held, fact in zip(out, facts):
            held[:, f] = np.bincount(place, fact, nodes * widest).reshape(nodes, widest)
    return out


def grow_node(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, level: int, rules: Rules, *where: int) -> tuple[Tree, np.ndarray]:
    """The tree below a node at ``level``, and what each feature gains in it. ``where`` seeds the choice of features."""
    features = bins.shape[1]
    gains = np.zeros(features)
    whole = float(weight.sum())
    parts = [[np.zeros(1, np.int64)], [np.full(1, NO_CUT)], [np.zeros(1, np.int64)], [np.array([total.sum() / whole if whole else 0.0])]]
    open_at, node, made = np.zeros(1, np.int64), np.zeros(len(bins), np.int64), 1
    while level < rules.depth and len(open_at) and len(bins):
        # Nodes are judged some at a time, so that sums stay within a few MB.
        some = max(1, (1 << 18) // (features * rules.widest))
        order = np.argsort(node, kind="stable")
        bins, weight, total, node = bins[order], weight[order], total[order], node[order]
        cuts = np.searchsorted(node, np.arange(0, len(open_at) + some, some))
        allowed = _allowed(len(open_at), features, rules, *where, level)
        found = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            first, count = i * some, min(some, len(open_at) - i * some)
            sums = _histogram(bins[a:b], node[a:b] - first, count, rules.widest, [weight[a:b], total[a:b]])
            w, s = sums[0][:, 0].sum(1), sums[1][:, 0].sum(1)
            found.append((*_best(*sums, allowed[first : first + count], rules), w, s))
        gain, feature, cut, left_w, left_s, w, s = (np.concatenate(x) for x in zip(*found))
        split = np.flatnonzero(gain > rules.least_gain)
        if not len(split):
            break
        np.add.at(gains, feature[split], gain[split])
        at = open_at[split]
        child = made + 2 * np.arange(len(split))
        for held, new in zip(parts, (feature[split], cut[split], child)):
            flat = np.concatenate(held)
            flat[at] = new
            held[:] = [flat]
        below = made + np.arange(2 * len(split))
        value = np.empty(2 * len(split))
        value[::2] = left_s[split] / left_w[split]
        value[1::2] = (s[split] - left_s[split]) / (w[split] - left_w[split])
        for held, new in zip(parts, (np.zeros(len(below), np.int64), np.full(len(below), NO_CUT), below, value)):
            held.append(new)
        place = np.full(len(open_at), -1)
        place[split] = 2 * np.arange(len(split))
        kept = np.flatnonzero(place[node] >= 0)
        own = node[kept]
        bins, weight, total = bins[kept], weight[kept], total[kept]
        node = place[own] + (bins[np.arange(len(own)), feature[own]] > cut[own])
        open_at, made, level = below, made + len(below), level + 1
    return Tree(*map(np.concatenate, parts)), gains


def _cells(rows: pa.RecordBatch, width: int, kind: np.dtype) -> tuple[np.ndarray, ...]:
    """(bins of each cell, first row of each cell, y and key of the rows, which lie by cell)."""
    flat = np.frombuffer(rows.column("cell").buffers()[-1], np.uint8)
    offset = rows.column("cell").offset
    size = width * kind.itemsize
    raw = flat[offset * size : (offset + len(rows)) * size].view(f"V{size}") if width else np.zeros(len(rows), "V1")
    order = np.argsort(_as_number(raw, size) if size <= 8 else raw, kind="stable")
    raw = raw[order]
    new = np.ones(len(raw), bool)
    new[1:] = raw[1:] != raw[:-1]
    first = np.flatnonzero(new)
    bins = np.frombuffer(raw[first].tobytes(), kind).reshape(len(first), width)
    y, key = (rows.column(c).to_numpy()[order] for c in ("y", "key"))
    return bins, first, y, key.view(np.uint64)


def _as_number(raw: np.ndarray, size: int) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :size] = raw.view(np.uint8).reshape(len(raw), size)
    return wide.view(np.uint64).ravel()


def _merged(bins: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells once each; a cell of many rows comes from several pieces."""
    raw = np.ascontiguousarray(bins).view(f"V{bins.shape[1] * bins.itemsize}").ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    return bins[first], np.bincount(of, weight), np.bincount(of, total)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PIECE_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass
class _Top:
    """The upper part of a tree while nodes below hold too many cells."""

    tree: Tree
    level: np.ndarray
    open: list[int]  # to be grown in one task each

    def split(self, node: int, feature: int, cut: int, values: list[float]) -> list[int]:
        made, t = len(self.level), self.tree
        t.feature[node], t.cut[node], t.left[node] = feature, cut, made
        below = Tree(np.zeros(2, np.int64), np.full(2, NO_CUT), made + np.arange(2), np.array(values))
        self.tree = Tree(*(np.concatenate(x) for x in zip(vars(t).values(), vars(below).values())))
        self.level = np.append(self.level, [self.level[node] + 1] * 2)
        return [made, made + 1]


def _root() -> _Top:
    return _Top(Tree(np.zeros(1, np.int64), np.full(1, NO_CUT), np.zeros(1, np.int64), np.zeros(1)), np.zeros(1, np.int64), [0])


def _grafted(top: Tree, below: dict[int, Tree]) -> Tree:
    """One tree, with the roots of ``below`` in place of leaves of ``top``."""
    parts = [[a] for a in (x.astype(k).copy() for x, k in zip(vars(top).values(), Tree.KINDS))]
    made = len(top.left)
    for node, tree in sorted(below.items()):
        shift = made - 1  # its root takes the place of the node
        left = tree.left + shift
        if tree.left[0] == 0:
            left[0] = node
        for held, x, k in zip(parts, (tree.feature, tree.cut, left, tree.value), Tree.KINDS):
            held[0][node] = x[0]
            held.append(x[1:].astype(k))
        made += len(tree.left) - 1
    return Tree(*map(np.concatenate, parts))


class ForestRegressor(Estimator):
    """ML5, ML8: the mean of trees on rows drawn with repetition, each split from a random choice of features.

    ``features_per_node`` is "all" or "sqrt"; ``row_share`` draws so many times the rows for each tree.
    """

    def __init__(
        self, features_col: str, label_col: str, prediction_col: str, trees: int = 100, depth: int = 15, least_rows: int = 1,
        features_per_node: str = "all", row_share: float = 1.0, bins: int = BINS, seed: int = 42,
    ):
        super().__init__()
        if features_per_node not in ("all", "sqrt"):
            raise ValueError(f"features_per_node: {features_per_node}")
        self.features_col, self.label_col, self.prediction_col = features_col, label_col, prediction_col
        self.trees, self.depth, self.least_rows, self.features_per_node = trees, depth, least_rows, features_per_node
        self.row_share, self.bins, self.seed = row_share, bins, seed

    def _fit(self, dataset: DataFrame) -> ForestModel:
        held = dataset.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y"))
        y = F.col("y")
        usable = F.coalesce(F.abs(y) < math.inf, F.lit(False)) & ~F.isnan(y)
        width, n, good, base, spread = held.agg(
            F.max(F.size("x")), F.count(F.lit(1)), F.count_if(usable), F.avg("y"), F.var_pop("y")
        ).first()
        if not n:
            raise ValueError("a forest needs rows to learn from")
        if good < n:
            raise ValueError(f"{n - good} labels are missing, NaN or infinite")
        columns = [f"x{i}" for i in range(width)]
        flat = [F.col("x")[i].alias(c) for i, c in enumerate(columns)]
        rows = settle(held.select(*flat, (y - F.lit(base)).alias("y"), F.monotonically_increasing_id().alias("key")))
        edges = split_edges(rows, columns, self.bins)
        chosen = width if self.features_per_node == "all" else ceil(math.sqrt(width))
        noise = n * max(LEAST_SHARE * spread, (LEAST_SHARE * base) ** 2)
        rules = Rules(self.depth, max(1, self.least_rows), chosen, self.seed, noise, max(len(e) for e in edges) + 2)
        cells = settle(self._ranged(rows, columns, edges, n))
        made, gains = self._grow(cells, edges, rules, n)
        return ForestModel(self.features_col, self.prediction_col, edges, base, made, gains)

    def _ranged(self, rows: DataFrame, columns: list[str], edges: list[np.ndarray], n: int) -> DataFrame:
        """(cell, y, key) of every row, by range of cell and key, so that a frequent cell is in several tasks."""
        schema = pa.schema([("cell", pa.binary(), False), ("y", pa.float64(), False), ("key", pa.int64(), False)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                bins = bins_of([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], edges)
                cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins.shape[1] * bins.itemsize), len(bins), [None, pa.py_buffer(bins.tobytes())])
                key = _mix(batch.column("key").to_numpy().astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([cell.cast(pa.binary()), batch.column("y"), pa.array(key)], schema=schema)

        binned = rows.mapInArrow(run, "cell binary, y double, key long")
        return binned.repartitionByRange(max(1, ceil(n / PIECE_ROWS)), "cell", "key")

    def _grow(self, cells: DataFrame, edges: list[np.ndarray], rules: Rules, n: int) -> tuple[list[Tree], np.ndarray]:
        width, kind = len(edges), np.dtype(np.uint8 if all(len(e) < 255 for e in edges) else np.uint16)
        distinct = cells.groupBy("cell").count().count()
        most = distinct + ceil(n / PIECE_ROWS) * 2
        made, gains = [], np.zeros((self.trees, width))
        at_once = max(1, SENT_CELLS // most)
        for first in range(0, self.trees, at_once):
            own = range(first, min(first + at_once, self.trees))
            tops = {t: _root() for t in own}
            if most > NODE_CELLS:
                self._split_large(cells, tops, gains, width, kind, rules)
            below = self._grow_small(cells, tops, gains, width, kind, rules)
            made += [_grafted(tops[t].tree, below[t]) for t in own]
        return made, gains

    def _split_large(self, cells, tops: dict[int, _Top], gains: np.ndarray, width: int, kind: np.dtype, rules: Rules) -> None:
        """Split nodes of more than ``NODE_CELLS`` cells, a job a level for all trees."""
        draws, schema = Draws(self.row_share, self.seed), pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("blob", pa.binary())])
        large = {t: [0] for t in tops}
        for level in range(rules.depth):
            asked = {t: (top.tree, large[t]) for t, top in tops.items() if large[t]}
            if not asked:
                return

            def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
                for piece in _pieces(batches):
                    bins, begin, y, key = _cells(piece, width, kind)
                    for t, (tree, nodes) in asked.items():
                        drawn = draws.of(key, t).astype(np.float64)
                        weight, total = np.add.reduceat(drawn, begin), np.add.reduceat(drawn * y, begin)
                        place = np.full(len(tree.left), -1)
                        place[nodes] = np.arange(len(nodes))
                        node = place[tree.leaves(bins)]
                        inside = (node >= 0) & (weight > 0)
                        one = np.ones(int(inside.sum()))
                        sums = _histogram(bins[inside], node[inside], len(nodes), rules.widest, [weight[inside], total[inside], one])
                        blobs = [_blob(*(s[i] for s in sums)) for i in range(len(nodes))]
                        yield _batch(schema, [[t] * len(nodes), nodes, blobs])

            out = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("best", pa.list_(pa.float64()))])

            def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                t, node = (k.as_py() for k in key)
                sums = np.zeros((3, 1, width, rules.widest))
                for blob in table.column("blob").to_pylist():
                    sums += np.frombuffer(blob).reshape(sums.shape)
                allowed = _allowed(1, width, rules, t, node, 1 << 20)
                gain, feature, cut, w, s = (float(x[0]) for x in _best(sums[0], sums[1], allowed, rules))
                count = sums[2][0, int(feature)]
                whole = [sums[0][0, 0].sum(), sums[1][0, 0].sum()]
                left = count[: int(cut) + 1].sum()
                return _table(out, [[t], [node], [[gain, feature, cut, w, s, *map(float, whole), float(left), float(count.sum() - left)]]])

            found = _by_node(cells.mapInArrow(run, "tree int, node int, blob binary"), sum(len(x) for _, x in asked.values()))
            found = found.applyInArrow(judge, "tree int, node int, best array<double>").collect()
            large = {t: [] for t in tops}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                gain, feature, cut, w, s, all_w, all_s, left, right = r["best"]
                top, node = tops[r["tree"]], r["node"]
                top.tree.value[node] = all_s / all_w if all_w else 0.0
                top.open.remove(node)
                if gain > rules.least_gain:
                    gains[r["tree"], int(feature)] += gain
                    children = top.split(node, int(feature), int(cut), [s / w, (all_s - s) / (all_w - w)])
                    if level + 1 < rules.depth:
                        top.open += children
                    large[r["tree"]] += [c for c, size in zip(children, (left, right)) if size > NODE_CELLS and level + 1 < rules.depth]

    def _grow_small(self, cells, tops: dict[int, _Top], gains: np.ndarray, width: int, kind: np.dtype, rules: Rules) -> dict[int, dict[int, Tree]]:
        """Grow each open node in one task."""
        draws, schema = Draws(self.row_share, self.seed), pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("blob", pa.binary())])
        asked = {t: (top.tree, top.level, np.array(top.open, np.int64)) for t, top in tops.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches):
                bins, begin, y, key = _cells(piece, width, kind)
                for t, (tree, _, nodes) in asked.items():
                    drawn = draws.of(key, t).astype(np.float64)
                    weight, total = np.add.reduceat(drawn, begin), np.add.reduceat(drawn * y, begin)
                    inside = weight > 0
                    of = tree.leaves(bins) if len(tree.left) > 1 else np.zeros(len(bins), np.int64)
                    of = np.where(inside, of, -1)
                    for node in nodes.tolist():
                        own = np.flatnonzero(of == node)
                        if len(own):
                            yield _batch(schema, [[t], [node], [_blob(weight[own], total[own], bins[own])]])

        out = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("nodes", pa.binary()), ("gains", pa.list_(pa.float64()))])

        def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            t, node = (k.as_py() for k in key)
            parts = []
            for blob in table.column("blob").to_pylist():
                n = len(blob) // (16 + width * kind.itemsize)
                parts.append((np.frombuffer(blob, kind, n * width, 16 * n).reshape(n, width), np.frombuffer(blob, np.float64, n), np.frombuffer(blob, np.float64, n, 8 * n)))
            bins, weight, total = _merged(*(np.concatenate(x) for x in zip(*parts)))
            tree, gained = grow_node(bins, weight, total, int(asked[t][1][node]), rules, t, node)
            return _table(out, [[t], [node], [tree.to_bytes()], [gained.tolist()]])

        sent = _by_node(cells.mapInArrow(run, "tree int, node int, blob binary"), sum(len(x) for *_, x in asked.values()))
        found = sent.applyInArrow(grow, "tree int, node int, nodes binary, gains array<double>").collect()
        below: dict[int, dict[int, Tree]] = {t: {} for t in tops}
        for r in found:
            below[r["tree"]][r["node"]] = Tree.from_bytes(bytes(r["nodes"]))
            gains[r["tree"]] += r["gains"]
        return below


def _by_node(sent: DataFrame, nodes: int) -> GroupedData:
    """In enough partitions for nodes to be worked on side by side, however small they are."""
    return sent.repartition(min(2 * nodes, 1000), "tree", "node").groupBy("tree", "node")


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, columns)])


class ForestModel(Model):
    def __init__(self, features_col: str, prediction_col: str, edges: list[np.ndarray], base: float, trees: list[Tree], gains: np.ndarray):
        super().__init__()
        self.features_col, self.prediction_col = features_col, prediction_col
        self.edges, self.base, self.trees, self.gains = edges, base, trees, gains
        self._sent = None

    @property
    def featureImportances(self) -> DenseVector:  # the name that Spark ML's models have
        """Shares of the features: each tree's gains as shares, averaged over the trees that split at all."""
        whole = self.gains.sum(1, keepdims=True)
        total = np.divide(self.gains, whole, out=np.zeros_like(self.gains), where=whole > 0).sum(0)
        return DenseVector(total / total.sum() if total.sum() else total)

    def predict(self, values: list[np.ndarray]) -> np.ndarray:
        return _predicted(values, self.edges, self.base, self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._sent is None:
            blobs = [t.to_bytes() for t in self.trees]
            self._sent = dataset.sparkSession.sparkContext.broadcast((self.edges, self.base, blobs))
        sent = self._sent

        # Vectors travel as arrays, the other columns as they are, all under plain names.
        kept = {f.name: isinstance(f.dataType, VectorUDT) for f in dataset.schema if f.name != self.prediction_col}
        given = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
        sent_rows = dataset.select(*[(vector_to_array(c) if v else c).alias(f"c{i}") for i, (c, v) in enumerate(zip(given, kept.values()))])
        names, features = [*sent_rows.columns, "y_hat"], list(kept).index(self.features_col)
        fields = [T.StructField(f.name, f.dataType) for f in sent_rows.schema]

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, base, blobs = sent.value
            trees = [Tree.from_bytes(b) for b in blobs]
            for batch in batches:
                wide = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(edges))
                found = _predicted([wide[:, i] for i in range(len(edges))], edges, base, trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

        scored = sent_rows.mapInArrow(predicted, T.StructType([*fields, T.StructField("y_hat", T.DoubleType())]))
        back = [(array_to_vector(f"c{i}") if v else F.col(f"c{i}")).alias(c) for i, (c, v) in enumerate(kept.items())]
        return scored.select(*back, F.col("y_hat").alias(self.prediction_col))


def _predicted(values, edges, base, trees) -> np.ndarray:
    bins = bins_of(values, edges)
    total, n = np.zeros(len(bins)), 0
    for tree in trees:
        total += tree.value[tree.leaves(bins)]
        n += 1
    return base + total / n
