"""Trees and forests of bounded depth, grown level by level by all tasks at once.

Rows are kept as bin codes in blocks. In each pass a task sums up the bins of every open node
of every tree over its blocks, tree by tree, so that the sums it adds to stay in the cache of
its core. The sums meet by tree, where the best splits are chosen by the rules of Spark ML's
trees. A task holds one block and the sums of a bounded group of trees, however many rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.plans.subtrees import PURE, Bins, SubtreeRule, grown, variance
from courierflow.session import work_path, written

BLOCK_ROWS = 1 << 17
SUM_BYTES = 1 << 27
MOST_BINS = 256
MOST_DEPTH = 10

# Poisson numbers of mean 1 by equally likely 16-bit draws.
_CHANCES = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
POISSON = np.searchsorted(_CHANCES, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class TreeRule:
    """When a tree's nodes may split; with a ``draw`` each row counts a Poisson number of times."""

    depth: int
    min_rows: int
    min_gain: float
    draw: tuple[int, int] | None = None


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf leads to itself, children are neighbours."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, MOST_BINS - 1, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    level: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.full(1, -1.0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))

    def inner(self) -> np.ndarray:
        return self.left != np.arange(len(self.left))

    def descend(self, node: np.ndarray, codes: np.ndarray, base: np.ndarray, levels: int) -> np.ndarray:
        """The nodes that rows reach; ``base`` is where a row's codes start."""
        for _ in range(levels):
            node = self.left.take(node) + (codes.take(base + self.feature.take(node)) > self.cut.take(node))
        return node

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Give the nodes two children each; returns the children."""
        at, new = len(self.left), 2 * len(nodes)
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature, cut, gain
        self.left[nodes] = at + 2 * np.arange(len(nodes))
        children = np.arange(at, at + new)
        self.feature = np.concatenate([self.feature, np.zeros(new, np.int64)])
        self.cut = np.concatenate([self.cut, np.full(new, MOST_BINS - 1, np.uint8)])
        self.left = np.concatenate([self.left, children])
        self.level = np.concatenate([self.level, np.repeat(self.level[nodes] + 1, 2)])
        self.gain = np.concatenate([self.gain, np.full(new, -1.0)])
        self.sums = np.concatenate([self.sums, np.zeros((new, 3))])
        return children

    def cut_to(self, depth: int) -> Tree:
        """The tree grown to a smaller depth: nodes of deeper levels come last."""
        kept = int(np.searchsorted(self.level, depth, side="right"))
        short = Tree(*(a[:kept].copy() for a in (self.feature, self.cut, self.left, self.level, self.gain, self.sums)))
        ends = np.flatnonzero(short.level == depth)
        short.feature[ends], short.cut[ends], short.left[ends], short.gain[ends] = 0, MOST_BINS - 1, ends, -1.0
        return short


def binned(matrix: DataFrame, target: str, bins: Bins, label: str = "binned") -> DataFrame:
    """The rows of a matrix as a written table of blocks: bin codes by row, and targets."""
    slim = matrix.select(vector_to_array("features").alias("x"), F.col(target).cast("double").alias("y"))
    width = len(bins.bounds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        codes, ys, size = [], [], 0

        def block() -> pa.RecordBatch:
            cells = {"block": [(part << 32) + number], "codes": [np.concatenate(codes).tobytes()], "y": [np.concatenate(ys).tobytes()]}
            return pa.RecordBatch.from_pydict(cells, pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("y", pa.binary())]))

        for batch in batches:
            x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column("y")
            if y.null_count:
                raise ValueError("targets must not be null")
            codes.append(np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(bins.bounds)], axis=1).astype(np.uint8))
            ys.append(y.to_numpy())
            size += len(y)
            if size >= BLOCK_ROWS:
                yield block()
                codes, ys, size, number = [], [], 0, number + 1
        if size:
            yield block()

    return written(slim.mapInArrow(pack, "block long, codes binary, y binary"), label)


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8).reshape(-1, width)
            yield batch.column("block")[i].as_py(), codes, np.frombuffer(batch.column("y")[i].as_buffer())


def drawn(draw: tuple[int, int], block: int, size: int) -> np.ndarray:
    """How often each row of a block counts for a tree, the same in every pass."""
    source = np.random.Generator(np.random.SFC64([*(abs(d) for d in draw), block]))
    return POISSON.take(source.integers(0, 1 << 16, size, dtype=np.uint16))


def grow(blocks: DataFrame, bins: Bins, rules: list[TreeRule]) -> list[Tree]:
    """All trees grown together, one pass over the rows for each level of a group of trees.

    The pass of a tree's last level only sums up its leaves.
    """
    trees = [Tree() for _ in rules]
    open_nodes = {k: np.zeros(1, np.int64) for k in range(len(rules))}
    level = 0
    while open_nodes:
        following = {}
        for group in _groups(open_nodes, bins.cells):
            for k, picked, gain, sums in _best_splits(blocks, bins, rules, trees, group, level):
                nodes = open_nodes[k]
                trees[k].sums[nodes] = sums
                going = picked >= 0
                if going.any():
                    cell = picked[going]
                    cut = cell - bins.starts[bins.feature[cell]]
                    following[k] = trees[k].split(nodes[going], bins.feature[cell], cut, gain[going])
        open_nodes, level = following, level + 1
    return trees


def _groups(open_nodes: dict[int, np.ndarray], cells: int) -> Iterator[dict[int, np.ndarray]]:
    """Trees in groups whose sums fit into ``SUM_BYTES``, one tree at least."""
    group, size = {}, 0
    for k, nodes in sorted(open_nodes.items()):
        own = len(nodes) * (2 * cells + 3) * 8
        if group and size + own > SUM_BYTES:
            yield group
            group, size = {}, 0
        group[k], size = nodes, size + own
    yield group


def _best_splits(blocks, bins, rules, trees, group, level) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tree, picked cells, their gains and the sums of the open nodes of every tree of a group."""
    width = len(bins.bounds)
    grown = {k: trees[k] for k in group}
    rule_of = {k: rules[k] for k in group}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for block, codes, y in blocks_of(batches, width):
            joint = bins.joint_codes(codes)
            flat = codes.ravel()
            for k, nodes in group.items():
                sums = node_sums(grown[k], rule_of[k], nodes, level, bins, block, flat, joint, y)
                if k in found:
                    found[k] += sums
                else:
                    found[k] = sums
        for k, sums in found.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        k, sums = int(key[0]), None
        for part in parts["sums"]:
            sums = np.frombuffer(part).copy() if sums is None else np.add(sums, np.frombuffer(part), out=sums)
        sums = sums.reshape(len(group[k]), -1)
        if level == rule_of[k].depth:
            picked, gain = np.full(len(sums), -1), np.full(len(sums), -1.0)
        else:
            picked, gain = best_cells(sums, bins, rule_of[k])
        return pd.DataFrame({
            "tree": [k], "picked": [picked.astype(np.int64).tobytes()], "gain": [gain.tobytes()],
            "sums": [np.ascontiguousarray(sums[:, :3]).tobytes()],
        })

    summed = blocks.mapInArrow(add, "tree int, sums binary")
    chosen = summed.groupBy("tree").applyInPandas(choose, "tree int, picked binary, gain binary, sums binary")
    return [
        (r["tree"], np.frombuffer(r["picked"], np.int64), np.frombuffer(r["gain"]), np.frombuffer(r["sums"]).reshape(-1, 3))
        for r in chosen.collect()
    ]


def node_sums(
    tree: Tree, rule: TreeRule, nodes: np.ndarray, level: int, bins: Bins, block: int,
    flat: np.ndarray, joint: list[np.ndarray], y: np.ndarray,
) -> np.ndarray:
    """Rows, targets and squared targets of every open node, then rows and targets by cell."""
    width = len(bins.bounds)
    if rule.draw is None:
        times, rows = None, np.arange(len(y))
    else:
        times = drawn(rule.draw, block, len(y))
        rows = np.flatnonzero(times)
    node = tree.descend(np.zeros(len(rows), np.int64), flat, rows * width, level)
    size = len(nodes)
    if size < len(tree.left):
        place = np.full(len(tree.left), -1)
        place[nodes] = np.arange(size)
        node = place.take(node)
        inside = np.flatnonzero(node >= 0)
        if len(inside) < len(node):
            rows, node = rows.take(inside), node.take(inside)
    value = y.take(rows)
    weight = None if times is None else times.take(rows).astype(float)
    weighted = value if weight is None else value * weight
    leaves = level == rule.depth
    out = np.zeros((size, 3 if leaves else 3 + 2 * bins.cells))
    out[:, 0] = np.bincount(node, weight, size)
    out[:, 1] = np.bincount(node, weighted, size)
    out[:, 2] = np.bincount(node, weighted * value, size)
    if not leaves:
        for code, (cells, own, held) in zip(joint, bins.parts):
            cell = node * cells + code.take(rows)
            count = np.bincount(cell, weight, size * cells).reshape(size, cells)
            total = np.bincount(cell, weighted, size * cells).reshape(size, cells)
            out[:, 3 + own] = count @ held
            out[:, 3 + bins.cells + own] = total @ held
    return out


def best_cells(sums: np.ndarray, bins: Bins, rule: TreeRule) -> tuple[np.ndarray, np.ndarray]:
    """The last cell that goes left in each node's best split, or -1, and the gain: the first of equal ones."""
    count, total, square = (sums[:, i, None] for i in range(3))

    def left(of: np.ndarray) -> np.ndarray:
        running = np.cumsum(of, axis=1)
        return running - (running - of)[:, bins.starts][:, bins.feature]

    n, s = left(sums[:, 3 : 3 + bins.cells]), left(sums[:, 3 + bins.cells :])
    n_right, s_right = count - n, total - s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (s * s / n + s_right * s_right / n_right - total * total / count) / count
    barred = bins.last[None, :] | (n < rule.min_rows) | (n_right < rule.min_rows) | ~(gain >= rule.min_gain)
    gain[barred] = -np.inf
    best = gain.argmax(axis=1)
    most = gain[np.arange(len(best)), best]
    mixed = np.abs(variance(*sums[:, :3].T)) >= PURE
    going = mixed & (most > 0)
    return np.where(going, best, -1), np.where(going, most, -1.0)


class GrownTrees(Model):
    """The mean of grown trees as a stage that adds predictions; ``spark_model`` gives Spark ML's own."""

    def __init__(self, regressor, trees: list[Tree], bins: Bins):
        super().__init__()
        self.regressor, self.trees, self.bins = regressor, trees, bins

    def _transform(self, dataset: DataFrame) -> DataFrame:
        guess = F.arrow_udf(predictor(self.trees, self.bins), "double")
        asked = vector_to_array(self.regressor.getFeaturesCol())
        return dataset.withColumn(self.regressor.getPredictionCol(), guess(asked))

    def node_rows(self) -> Iterator[tuple]:
        for k, tree in enumerate(self.trees):
            inner, spread = tree.inner(), variance(*tree.sums.T)
            for i, (n, s, q) in enumerate(tree.sums.tolist()):
                left, f = int(tree.left[i]), int(tree.feature[i])
                split = (f, [float(self.bins.bounds[f][tree.cut[i]])], -1) if inner[i] else (-1, [], -1)
                children = (left, left + 1) if inner[i] else (-1, -1)
                yield k, (i, s / n if n else 0.0, float(spread[i]), [n, s, q], int(n), float(tree.gain[i]), *children, split)

    def spark_model(self, spark: SparkSession) -> DecisionTreeRegressionModel | RandomForestRegressionModel:
        """Spark ML's model with these nodes: one fitted to two rows is saved and gets them as its data."""
        zeros = Vectors.dense([0.0] * len(self.bins.bounds))
        names = [self.regressor.getFeaturesCol(), self.regressor.getLabelCol()]
        empty = self.regressor.fit(spark.createDataFrame([(zeros, 0.0), (zeros, 0.0)], names))
        path = work_path(spark, "trees")
        empty.write().save(path)
        node = (
            "struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
            "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
        )
        rows = spark.createDataFrame(list(self.node_rows()), f"treeID int, nodeData {node}")
        if isinstance(self.regressor, DecisionTreeRegressor):
            rows = rows.select("nodeData.*")
        rows.write.mode("overwrite").parquet(f"{path}/data")
        return type(empty).load(path)


def predictor(trees: list[Tree], bins: Bins):
    """A function of arrays of feature arrays that gives the mean of the trees' leaves."""
    tables = []
    for tree in trees:
        inner = tree.inner()
        limit = np.full(len(inner), np.inf)
        limit[inner] = [bins.bounds[f][c] for f, c in zip(tree.feature[inner], tree.cut[inner])]
        leaf = tree.sums[:, 1] / np.maximum(tree.sums[:, 0], 1)
        tables.append((tree.feature, limit, tree.left, leaf, int(tree.level.max())))
    width = len(bins.bounds)

    def predict(features: pa.Array) -> pa.Array:
        flat = features.flatten().to_numpy(zero_copy_only=False)
        base = np.arange(len(features)) * width
        total = np.zeros(len(features))
        for feature, limit, left, leaf, depth in tables:
            node = np.zeros(len(features), np.int64)
            for _ in range(depth):
                node = left.take(node) + (flat.take(base + feature.take(node)) > limit.take(node))
            total += leaf.take(node)
        return pa.array(total / len(tables))

    predict.__annotations__ = {"features": pa.Array, "return": pa.Array}
    return predict


def rules_of(regressor) -> list[TreeRule] | None:
    """The rules of a regressor's trees, or None if it has settings that only Spark ML follows."""
    if not isinstance(regressor, (DecisionTreeRegressor, RandomForestRegressor)):
        return None
    if regressor.isDefined("weightCol") or regressor.getMinWeightFractionPerNode() or regressor.getLeafCol():
        return None
    if regressor.getMaxDepth() > MOST_DEPTH or regressor.getMaxBins() > MOST_BINS:
        return None
    limits = (regressor.getMaxDepth(), regressor.getMinInstancesPerNode(), regressor.getMinInfoGain())
    if isinstance(regressor, DecisionTreeRegressor):
        return [TreeRule(*limits)]
    whole = regressor.getSubsamplingRate() == 1.0 and regressor.getBootstrap()
    if not whole or regressor.getFeatureSubsetStrategy() != "all" or regressor.getNumTrees() == 1:
        return None
    return [TreeRule(*limits, (regressor.getSeed(), k)) for k in range(regressor.getNumTrees())]


def shared_rules(wanted: dict[int, list[TreeRule]]) -> dict[TreeRule, TreeRule]:
    """One rule for all that differ by depth only: the smaller tree is the top of the larger."""
    deepest: dict[TreeRule, TreeRule] = {}
    for rules in wanted.values():
        for rule in rules:
            alike = replace(rule, depth=0)
            if alike not in deepest or deepest[alike].depth < rule.depth:
                deepest[alike] = rule
    return deepest


def held_errors(held: DataFrame, bins: Bins, forests: dict[int, list[Tree]]) -> DataFrame:
    """i, rows and absolute error of the held blocks, in parts: a forest predicts the mean of its trees."""
    width = len(bins.bounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, y in blocks_of(batches, width):
            flat, base, lost = codes.ravel(), np.arange(len(y)) * width, []
            for trees in forests.values():
                total = np.zeros(len(y))
                for tree in trees:
                    node = tree.descend(np.zeros(len(y), np.int64), flat, base, int(tree.level.max()))
                    total += (tree.sums[:, 1] / np.maximum(tree.sums[:, 0], 1)).take(node)
                lost.append(float(np.abs(y - total / len(trees)).sum()))
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array([*forests], pa.int32()), "n": pa.array([len(y)] * len(lost), pa.int64()), "lost": lost}
            )

    return held.mapInArrow(score, "i int, n long, lost double")


def deep_errors(
    fit: DataFrame, held: DataFrame, bins: Bins, tops: dict[int, Tree], rules: dict[int, SubtreeRule]
) -> DataFrame:
    """i, rows and absolute error of the held blocks by deep trees, a part for each leaf of a top.

    The rows of a leaf go to one task, in pieces of one block, and once for all trees with the same top.
    """
    width = len(bins.bounds)
    firsts: dict[tuple, int] = {}
    same = {i: firsts.setdefault((t.feature.tobytes(), t.cut.tobytes(), t.left.tobytes()), i) for i, t in tops.items()}
    apart = {i: tops[i] for i in firsts.values()}

    def pieces_of(is_held: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, codes, y in blocks_of(batches, width):
                flat, base = codes.ravel(), np.arange(len(y)) * width
                for i, tree in apart.items():
                    node = tree.descend(np.zeros(len(y), np.int64), flat, base, int(tree.level.max()))
                    order = np.argsort(node, kind="stable")
                    leaves, firsts = np.unique(node[order], return_index=True)
                    ends = np.append(firsts, len(y))
                    yield pa.RecordBatch.from_pydict({
                        "top": pa.array([i] * len(leaves), pa.int32()), "leaf": pa.array(leaves, pa.int32()),
                        "held": [is_held] * len(leaves),
                        "codes": _cells(codes[order].tobytes(), ends * width), "y": _cells(y[order].tobytes(), ends * 8),
                    })

        return deal

    schema = "top int, leaf int, held boolean, codes binary, y binary"
    pieces = fit.mapInArrow(pieces_of(False), schema).unionByName(held.mapInArrow(pieces_of(True), schema))

    def grow_leaf(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(parts["codes"]), np.uint8).reshape(-1, width)
        y = np.frombuffer(b"".join(parts["y"]))
        own = np.repeat(parts["held"].to_numpy(dtype=bool), parts["y"].str.len() // 8)
        lost = []
        for i in rules:
            if own.any() and same[i] == key[0]:
                lost.append((i, int(own.sum()), float(np.abs(y - grown(codes, y, own, bins, rules[i]))[own].sum())))
        return pd.DataFrame(lost, columns=["i", "n", "lost"])

    return pieces.groupBy("top", "leaf").applyInPandas(grow_leaf, "i int, n long, lost double")


def _cells(data: bytes, ends: np.ndarray) -> pa.Array:
    """Pieces of one buffer as binary cells."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
