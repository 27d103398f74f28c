"""Bins of features, and the lower levels of a regression tree, grown by one task from the rows of one leaf."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np
import pandas as pd

NODES_AT_ONCE = 256
ROWS_FOR_JOINT = 48
JOINT_BINS = 64
PURE = np.finfo(float).eps


@dataclass(frozen=True)
class Bins:
    """Bounds of every feature's bins, and the features whose bins are counted jointly.

    Features of few bins share one count over the cells of all their bins, from which a
    product with zeros and ones gives the counts of each feature.
    """

    bounds: list[np.ndarray]

    @cached_property
    def widths(self) -> np.ndarray:
        return np.array([len(b) + 1 for b in self.bounds])

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)[:-1]])

    @cached_property
    def cells(self) -> int:
        return int(self.widths.sum())

    @cached_property
    def feature(self) -> np.ndarray:
        """The feature of each cell."""
        return np.repeat(np.arange(len(self.widths)), self.widths)

    @cached_property
    def last(self) -> np.ndarray:
        """Whether a cell is its feature's last bin, after which nothing can be split."""
        marks = np.zeros(self.cells, dtype=bool)
        marks[self.starts + self.widths - 1] = True
        return marks

    @cached_property
    def cuts(self) -> np.ndarray:
        """The cells after which a node can be split."""
        return np.flatnonzero(~self.last)

    @cached_property
    def joint(self) -> list[list[int]]:
        groups: list[list[int]] = []
        for f in np.argsort(-self.widths, kind="stable").tolist():
            fits = (g for g in groups if prod(int(self.widths[o]) for o in g) * self.widths[f] <= JOINT_BINS)
            home = next(fits, None)
            if home is None:
                groups.append(home := [])
            home.append(f)
        return groups

    def joint_codes(self, codes: np.ndarray) -> list[np.ndarray]:
        """One code a row for each group of features."""
        found = []
        for group in self.joint:
            code = codes[:, group[0]].astype(np.int64)
            for f in group[1:]:
                code = code * self.widths[f] + codes[:, f]
            found.append(code)
        return found

    @cached_property
    def parts(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of each group: joint cells, the features' own cells, and which joint cells they hold."""
        found = []
        for group in self.joint:
            shape = [int(self.widths[f]) for f in group]
            of = np.unravel_index(np.arange(prod(shape)), shape)
            held = np.concatenate([np.eye(w)[o] for w, o in zip(shape, of)], axis=1)
            own = np.concatenate([self.starts[f] + np.arange(self.widths[f]) for f in group])
            found.append((prod(shape), own, held))
        return found


@dataclass(frozen=True)
class SubtreeRule:
    """The levels left and when a node may split."""

    depth: int
    min_rows: int
    min_gain: float


def thresholds(sample: list[np.ndarray], bins: int) -> list[np.ndarray]:
    """Bounds between the bins of each feature, chosen as by Spark ML's trees.

    Midpoints of neighbouring values: all of them if they are few, else those where
    the rows counted so far come nearest to the next multiple of the stride.
    """
    found = []
    for column in np.asarray(sample).T:
        values, counts = np.unique(column, return_counts=True)
        middles = (values[:-1] + values[1:]) / 2
        if len(middles) > bins - 1:
            stride = target = len(column) / bins
            seen = np.cumsum(counts)
            kept = []
            for before, now, middle in zip(seen[:-1], seen[1:], middles):
                if abs(before - target) < abs(now - target):
                    kept.append(middle)
                    target += stride
            middles = np.array(kept)
        found.append(middles)
    return found


def subtree_predictions(i: int, group: pd.DataFrame, bins: Bins, rule: SubtreeRule) -> pd.DataFrame:
    """i, target and prediction of a leaf's held rows; the other rows grow the subtree."""
    held = group["held"].to_numpy()
    y = group["y"].to_numpy()
    if not held.any():
        return pd.DataFrame({"i": [], "y": [], "p": []}).astype({"i": "int32"})
    x = np.stack(group["x"].to_numpy())
    codes = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(bins.bounds)], axis=1)
    return pd.DataFrame({"i": np.int32(i), "y": y[held], "p": grown(codes, y, held, bins, rule)[held]})


def grown(codes: np.ndarray, y: np.ndarray, held: np.ndarray, bins: Bins, rule: SubtreeRule) -> np.ndarray:
    """The prediction of every row, level by level; rows of finished nodes drop out."""
    flat, joint, square_of = codes + bins.starts, bins.joint_codes(codes), y**2
    out = np.zeros(len(y))
    rows, node, size = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1
    for level in range(rule.depth + 1):
        fit = ~held[rows]
        picked, at = rows[fit], node[fit]
        count = np.bincount(at, minlength=size).astype(float)
        total = np.bincount(at, y[picked], size)
        square = np.bincount(at, square_of[picked], size)
        out[rows] = (total / np.maximum(count, 1))[node]
        impure = np.abs(variance(count, total, square)) >= PURE
        wanted = np.flatnonzero(impure & (count >= 2 * rule.min_rows))
        if level == rule.depth or not len(wanted):
            break
        place = np.full(size, -1)
        place[wanted] = np.arange(len(wanted))
        near = place[at]
        inside = np.flatnonzero(near >= 0)
        picked, near = picked[inside], near[inside]
        if len(wanted) > NODES_AT_ONCE:
            order = np.argsort(near, kind="stable")
            picked, near = picked[order], near[order]
        ends = np.append(np.searchsorted(near, np.arange(0, len(wanted), NODES_AT_ONCE)), len(near))
        if len(wanted) <= NODES_AT_ONCE:
            ends = np.array([0, len(near)])
        choice = np.full(size, -1)
        for k, at in enumerate(range(0, len(wanted), NODES_AT_ONCE)):
            some, mine = wanted[at : at + NODES_AT_ONCE], slice(ends[k], ends[k + 1])
            sums = _sums(near[mine] - at, picked[mine], len(some), flat, joint, y, square_of, bins)
            choice[some] = _best(sums, count[some], total[some], square[some], bins, rule)
        going = choice[node] >= 0
        rows, node = rows[going], node[going]
        if not len(rows):
            break
        split = choice[node]
        right = flat[rows, bins.feature[split]] > split
        kept = np.cumsum(choice >= 0)
        node, size = 2 * (kept[node] - 1) + right, 2 * int(kept[-1])
    return out


def variance(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> np.ndarray:
    safe = np.maximum(count, 1)
    return (square - total * total / safe) / safe


def _sums(near, picked, nodes, flat, joint, y, square_of, bins) -> list[np.ndarray]:
    """Rows, targets and squared targets by node and cell.

    Large nodes count the joint bins of few features together, small ones each bin by itself.
    """
    weights = (None, y[picked], square_of[picked])
    if len(near) >= ROWS_FOR_JOINT * nodes:
        found = [np.empty((nodes, bins.cells)) for _ in weights]
        for code, (cells, own, held) in zip(joint, bins.parts):
            cell = near * cells + code[picked]
            for sums, w in zip(found, weights):
                sums[:, own] = np.bincount(cell, w, nodes * cells).reshape(nodes, cells) @ held
        return found
    cell = ((near * bins.cells)[:, None] + flat[picked]).ravel()
    spread = [None if w is None else np.repeat(w, flat.shape[1]) for w in weights]
    return [np.bincount(cell, w, nodes * bins.cells).reshape(nodes, bins.cells).astype(float, copy=False) for w in spread]


def _best(sums, count, total, square, bins, rule) -> np.ndarray:
    """The last bin that goes left in each node's best split, or -1: the first of equal gains."""

    def left(of: np.ndarray) -> np.ndarray:
        running = of[:, bins.cuts]
        at = 0
        for width in bins.widths.tolist():
            if width > 2:
                part = running[:, at : at + width - 1]
                np.cumsum(part, axis=1, out=part)
            at += width - 1
        return running

    n, s, q = (left(of) for of in sums)
    n_right, s_right, q_right = count[:, None] - n, total[:, None] - s, square[:, None] - q
    parent = variance(count, total, square)[:, None]
    gain = parent - n / count[:, None] * variance(n, s, q) - n_right / count[:, None] * variance(n_right, s_right, q_right)
    barred = (n < rule.min_rows) | (n_right < rule.min_rows) | (gain < rule.min_gain)
    gain[barred] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(best)), best] > 0, bins.cuts[best], -1)
