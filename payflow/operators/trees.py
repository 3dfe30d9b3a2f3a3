"""Boosted trees as lookup tables, to score a row again with one feature changed.

A tree of few splits is a function of the bins its own thresholds cut the features into, so it is one table:
each feature adds its offset, and the sum is the place of the prediction. A row with one feature changed needs
that feature's offsets only, and only in the trees that use it; the other trees keep their prediction.
A tree of n splits has at most 2^n places (depth 4: 32 768), so the tables are for shallow trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

SCALE = 10_000                         # scores are counted with 4 decimals
BATCH = 8192                           # rows scored at once: the work arrays stay in the cache
MOST_PLACES = 2**20


def read_trees(text: str) -> list[tuple[float, tuple]]:
    """(weight, root) of every tree in a Spark ensemble's ``toDebugString``; a node is (feature, threshold, left,
    right), a leaf (prediction,). Doubles are printed so that they read back the same."""
    lines = iter(x.strip() for x in text.splitlines())

    def node() -> tuple:
        line = next(lines)
        if line.startswith("Predict:"):
            return (float(line.removeprefix("Predict:")),)
        split = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if not split:
            raise ValueError(f"not a split at a threshold: {line}")
        left = node()
        next(lines)                    # Else
        return int(split[1]), float(split[2]), left, node()

    return [(float(m[1]), node()) for line in lines if (m := re.fullmatch(r"Tree \d+ \(weight (\S+)\):", line))]


def _splits(node: tuple) -> Iterator[tuple[int, float]]:
    if len(node) > 1:
        yield node[:2]
        yield from _splits(node[2])
        yield from _splits(node[3])


class TreeTables:
    """Tables of the trees: ``grid`` has the thresholds of each feature over all trees, and a tree is its table
    and, per feature it uses, the offset of each bin of the grid."""

    def __init__(self, trees: list[tuple[float, tuple]], features: int):
        cuts = [{x for _, root in trees for i, x in _splits(root) if i == f} for f in range(features)]
        self.grid = [np.array(sorted(c)) for c in cuts]
        self.trees = [self._table(weight, root) for weight, root in trees]

    def _table(self, weight: float, root: tuple) -> tuple[dict[int, np.ndarray], np.ndarray]:
        own: dict[int, list[float]] = {}
        for f, x in sorted(set(_splits(root))):
            own.setdefault(f, []).append(x)
        axis, shape = {f: i for i, f in enumerate(own)}, [len(x) + 1 for x in own.values()]
        if np.prod(shape, dtype=float) > MOST_PLACES:
            raise ValueError("a tree has too many splits for a table")
        table = np.empty(shape)

        def fill(node: tuple, box: list[slice]) -> None:
            if len(node) == 1:
                table[tuple(box)] = weight * node[0]
                return
            f, x, left, right = node
            i, cut = axis[f], own[f].index(x) + 1
            fill(left, [*box[:i], slice(box[i].start, min(box[i].stop, cut)), *box[i + 1:]])
            fill(right, [*box[:i], slice(max(box[i].start, cut), box[i].stop), *box[i + 1:]])

        fill(root, [slice(0, n) for n in shape])
        steps = {f: int(np.prod(shape[i + 1:], dtype=np.intp)) for f, i in axis.items()}
        # bin g of the grid lies above the thresholds grid[:g]
        offsets = {f: steps[f] * np.concatenate([[0], np.cumsum(np.isin(self.grid[f], x))]).astype(np.intp) for f, x in own.items()}
        return offsets, table.ravel()

    def bins(self, f: int, values: np.ndarray) -> np.ndarray:
        """Bins of the grid; a value at a threshold goes left, NaN goes right of all as in Spark's trees."""
        return np.searchsorted(self.grid[f], values, side="left")

    def margins(self, own: list[np.ndarray], new: list[np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Sum of the trees (in their order) for rows of bins ``own``, and per feature that a tree uses with its bin from ``new``."""
        used = [f for f, g in enumerate(self.grid) if len(g)]
        base, swapped = np.zeros(len(own[0])), {f: np.zeros(len(own[0])) for f in used}
        for offsets, table in self.trees:
            mine = {f: step.take(own[f]) for f, step in offsets.items()}
            at = sum(mine.values(), np.zeros(len(own[0]), np.intp))
            old = table.take(at)
            base += old
            for f in used:
                if f in offsets:
                    swapped[f] += table.take(at - mine[f] + offsets[f].take(new[f]))
                else:
                    swapped[f] += old
        return base, swapped


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores in units of 1 / SCALE, halves up by their decimal digits as Spark's ``round``."""
    x = score * SCALE
    out = np.floor(x + 0.5).astype(np.intp)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        out[i] = int((Decimal(repr(float(score[i]))) * SCALE).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def swap_counts(trees: list[tuple[float, tuple]], features: int):
    """Function for ``mapInArrow`` over rows of a label, a repeat ``_r``, own and new values of the features
    (``_own_i``, ``_new_i``): (_f, _r, score, p, n), the positive and negative rows per rounded score with feature ``_f``
    new, and with none (-1, counted in repeat 0). The score is a binary GBT's probability of class 1."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = TreeTables(trees, features)
        counts: dict[tuple[int, int], np.ndarray] = {}

        def count(f: int, r: np.ndarray, margin: np.ndarray, label: np.ndarray, repeats: Iterable[int]) -> None:
            with np.errstate(over="ignore"):
                at = rounded(1 - 1 / (1 + np.exp(2 * margin))) * 2 + label
            for k in repeats:
                got = np.bincount(at[r == k], minlength=2 * SCALE + 2)
                counts[f, k] = counts[f, k] + got if (f, k) in counts else got

        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                values = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
                own, new = ([tables.bins(f, values[f"_{kind}_{f}"]) for f in range(features)] for kind in ("own", "new"))
                base, swapped = tables.margins(own, new)
                r, label = values["_r"], values["label"].astype(np.intp)
                repeats = [int(k) for k in np.unique(r)]
                count(-1, r, base, label, [k for k in repeats if k == 0])
                for f in range(features):          # one that no tree uses changes nothing
                    count(f, r, swapped.get(f, base), label, repeats)
        for (f, k), c in counts.items():
            n, p = c.reshape(-1, 2).T
            seen = np.flatnonzero(n + p)
            yield pa.RecordBatch.from_pydict({
                "_f": pa.array(np.full(len(seen), f, np.int32)), "_r": pa.array(np.full(len(seen), k, np.int32)),
                "score": pa.array(seen / SCALE), "p": pa.array(p[seen].astype(np.int64)), "n": pa.array(n[seen].astype(np.int64))})
    return run
