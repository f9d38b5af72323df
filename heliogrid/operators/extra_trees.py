"""Extremely randomised trees: every node tries random thresholds of some random features, all trees grow together.

A level takes two passes over the rows, for all trees at once: one finds the range of the drawn features in every node, the other
adds up the rows on both sides of a threshold drawn in that range. Draws are functions of seed, tree and node. Rows aren't
shuffled; ranges and sums of a node meet in one task, and the driver sees a few numbers for each node and drawn feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.operators.boosting import Tree, _known
from heliogrid.operators.interpolate import _matrix
from heliogrid.session import settled

SCHEMA = "tree long, node long, v binary"


@dataclass(frozen=True)
class TreesModel:
    trees: tuple[Tree, ...]
    gains: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.value[t.leaf_of_values(x)] for t in self.trees], axis=0)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred``, the mean of the trees; a missing feature goes right, a row without features has no prediction."""
        model = self

        @F.arrow_udf("double")
        def predicted(features: pa.Array) -> pa.Array:
            known = features.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(features))
            if known.any():
                out[known] = model.predict(_matrix(features.filter(pa.array(known))))
            return pa.array(out, mask=~known)

        return df.withColumn("pred", predicted("features"))

    def importances(self, names: list[str]) -> DataFrame:
        """Share of the features in the trees' gains, averaged over the trees."""
        rows = [(n, float(v)) for n, v in zip(names, self.gains)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")


@dataclass(frozen=True)
class ExtraTrees:
    """``max_features`` are drawn for every node (None: all). Rows without a label or without features take no part."""

    trees: int = 500
    depth: int = 8
    min_leaf: int = 1
    max_features: int | None = 1
    seed: int = 1

    def fit(self, df: DataFrame) -> TreesModel:
        rows = settled(_known(df).select("features", F.col("y").cast("double").alias("y")))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit on")
        width = len(first["features"])
        trees = [Tree(self.depth) for _ in range(self.trees)]
        gains = np.zeros((self.trees, width))
        active = [(t, 0) for t in range(self.trees)]
        for _ in range(self.depth):
            if not active:
                break
            drawn = {(t, n): self._drawn(t, n, width) for t, n in active}
            ranges = _met(rows, trees, drawn, _range_of, np.maximum)
            cuts = {key: self._cut(key, r) for key, r in ranges.items()}
            sums = _met(rows, trees, drawn, lambda x, y, key: _sides(x, y, cuts[key]), np.add)
            active = [c for key, s in sorted(sums.items()) for c in self._split(trees, gains, key, drawn[key], cuts[key], s)]
        share = gains.sum(axis=1, keepdims=True)
        grown = np.divide(gains, share, out=np.zeros_like(gains), where=share > 0)
        return TreesModel(tuple(trees), grown.mean(axis=0))

    def _drawn(self, tree: int, node: int, width: int) -> np.ndarray:
        if self.max_features is None or self.max_features >= width:
            return np.arange(width)
        return np.random.default_rng([self.seed, tree, node]).choice(width, self.max_features, replace=False)

    def _cut(self, key: tuple[int, int], ranges: np.ndarray) -> np.ndarray:
        """A threshold in the range of each drawn feature; NaN where it doesn't vary or is always missing."""
        high, low = ranges[0], -ranges[1]
        place = np.random.default_rng([self.seed, *key, 1]).random(len(high))
        with np.errstate(invalid="ignore"):
            cut = low + place * (high - low)
        return np.where(np.isfinite(cut) & (high > low), np.where(cut >= high, low, cut), np.nan)

    def _split(self, trees: list[Tree], gains: np.ndarray, key: tuple[int, int], drawn: np.ndarray, cuts: np.ndarray, sums: np.ndarray) -> list[tuple[int, int]]:
        (t, node), tree = key, trees[key[0]]
        left, left_sum, (n, s, q) = sums[0, : len(cuts)], sums[1, : len(cuts)], sums[2, :3]
        tree.value[node] = s / n
        right, right_sum = n - left, s - left_sum
        able = ~np.isnan(cuts) & (left >= self.min_leaf) & (right >= self.min_leaf) & (left > 0) & (right > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(able, left_sum**2 / left + right_sum**2 / right - s**2 / n, -np.inf)
        best = int(np.argmax(gain))
        if not gain[best] > 1e-12 * max(1.0, q - s * s / n):
            return []
        tree.feature[node], tree.threshold[node] = drawn[best], cuts[best]
        gains[t, drawn[best]] += gain[best]
        children = ((2 * node + 1, left[best], left_sum[best]), (2 * node + 2, right[best], right_sum[best]))
        for child, m, total in children:
            tree.value[child] = total / m
        return [(t, child) for child, m, _ in children if m >= 2 * self.min_leaf and m > 1]


def _range_of(x: np.ndarray, y: np.ndarray, key) -> np.ndarray:
    """Largest values, and largest negated values."""
    x = np.where(np.isnan(x), -np.inf, x), np.where(np.isnan(x), -np.inf, -x)
    return np.array([x[0].max(axis=0), x[1].max(axis=0)])


def _sides(x: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows and label sum left of each threshold; rows, label sum and squares of the node."""
    left = x <= cuts
    out = np.zeros((3, max(3, x.shape[1])))
    out[0, : x.shape[1]], out[1, : x.shape[1]] = left.sum(axis=0), y @ left
    out[2, :3] = len(y), y.sum(), y @ y
    return out


def _met(rows: DataFrame, trees: list[Tree], drawn: dict, of, join) -> dict[tuple[int, int], np.ndarray]:
    """What ``of`` tells of the rows and drawn features of every wanted node, joined over all tasks."""
    nodes: dict[int, list[int]] = {}
    for t, n in drawn:
        nodes.setdefault(t, []).append(n)

    def send(totals: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in totals], pa.int64()), pa.array([k[1] for k in totals], pa.int64()), pa.array([v.tobytes() for v in totals.values()], pa.binary())],
            names=["tree", "node", "v"],
        )

    def part(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("features")), batch.column("y").to_numpy()
            for t, wanted in nodes.items():
                leaf = trees[t].leaf_of_values(x)
                order = np.argsort(leaf, kind="stable")
                for n, b, e in zip(wanted, np.searchsorted(leaf[order], wanted, "left"), np.searchsorted(leaf[order], wanted, "right")):
                    if e > b:
                        at = order[b:e]
                        one = of(x[np.ix_(at, drawn[t, n])], y[at], (t, n))
                        totals[t, n] = join(totals[t, n], one) if (t, n) in totals else one
        yield send(totals)

    def whole(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, n, v in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "v"))):
                one = np.frombuffer(v)
                totals[t, n] = join(totals[t, n], one) if (t, n) in totals else one
        yield send(totals)

    table = rows.mapInArrow(part, SCHEMA).repartition("tree", "node").mapInArrow(whole, SCHEMA)
    out = {(r["tree"], r["node"]): np.frombuffer(bytes(r["v"])) for r in table.collect()}  # bounded by nodes and drawn features
    rows_of = {k: len(v) // max(3, len(drawn[k])) if of is not _range_of else 2 for k, v in out.items()}
    return {k: v.reshape(rows_of[k], -1) for k, v in out.items()}
