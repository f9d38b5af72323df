"""Codebooks of whole maps: mini-batch k-means with missing cells, and Gaussian mixtures with full covariances.

Maps are one array a row, written once. Cells are standardised in the tasks by moments from one pass; no map is taken apart. A pass
sends sums for (centre, cell) or (component, cell, cell), which are bounded by the grid, whatever the number of maps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.operators.encode import map_keys
from heliogrid.operators.grid import GridSpec, map_vectors
from heliogrid.operators.interpolate import _matrix
from heliogrid.session import settled

#: Parts in which the sums of the tasks meet before they are one.
PARTS = 16


def vectors_of(maps: DataFrame, spec: GridSpec) -> DataFrame:
    """(keys, cells) of every map, NULL where a cell is missing, written once."""
    return settled(map_vectors(maps, map_keys(maps), spec))


def summed(rows: DataFrame, sums) -> dict[int, np.ndarray]:
    """Arrays by number, added up over all batches; ``sums`` gives {number: array} of a batch."""

    def add(totals: dict, number: int, array: np.ndarray) -> None:
        totals[number] = totals[number] + array if number in totals else np.asarray(array, float)

    def send(totals: dict) -> pa.RecordBatch:
        shapes = [",".join(map(str, a.shape)) for a in totals.values()]
        columns = [pa.array(list(totals), pa.int64()), pa.array(shapes, pa.string()), pa.array([np.ascontiguousarray(a).tobytes() for a in totals.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["number", "shape", "v"])

    def part(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for number, array in sums(batch).items():
                    add(totals, number, array)
        yield send(totals)

    def whole(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, shape, v in zip(*(batch.column(c).to_pylist() for c in ("number", "shape", "v"))):
                add(totals, number, np.frombuffer(v).reshape([int(n) for n in shape.split(",") if n]))
        yield send(totals)

    schema = "number long, shape string, v binary"
    table = rows.mapInArrow(part, schema)
    table = table.repartition(PARTS, "number", F.pmod(F.xxhash64("v"), F.lit(PARTS))).mapInArrow(whole, schema).repartition("number").mapInArrow(whole, schema)
    out = {}
    for r in table.collect():  # bounded by the arrays' shapes
        out[r["number"]] = np.frombuffer(bytes(r["v"])).reshape([int(n) for n in r["shape"].split(",") if n])
    return out


@dataclass(frozen=True)
class Scale:
    """Mean and population std of every cell over the maps that have it; cells that don't vary or are never there get std 1."""

    mean: np.ndarray
    std: np.ndarray

    def __call__(self, column: pa.Array) -> np.ndarray:
        return (_matrix(column) - self.mean) / self.std


def cell_scale(vectors: DataFrame) -> Scale:
    """From the sums of one pass around a first guess of the means, so that little is lost to large means."""
    first = vectors.select("cells").first()
    if first is None:
        raise ValueError("no maps to fit on")
    guess = np.nan_to_num(np.array([np.nan if v is None else v for v in first["cells"]], float))

    def sums(batch):
        x = _matrix(batch.column("cells")) - guess
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        return {0: np.array([known.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])}

    n, s, q = summed(vectors.select("cells"), sums)[0]
    n = np.maximum(n, 1)
    std = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
    return Scale(guess + s / n, np.where(std > 1e-12 * np.maximum(1.0, np.abs(guess)), std, 1.0))


# ---------------------------------------------------------------- mini-batch k-means


def known_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (maps x centres) on the known cells, scaled up to all cells; 0 for maps without any."""
    known = ~np.isnan(x)
    z = np.where(known, x, 0.0)
    share = known.sum(axis=1)
    squared = (z * z).sum(axis=1)[:, None] - 2 * z @ centres.T + known.astype(float) @ (centres * centres).T
    return np.maximum(squared, 0.0) * (x.shape[1] / np.maximum(share, 1))[:, None] * (share > 0)[:, None]


def spread_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a chance in proportion to its squared distance from the ones before (k-means++)."""
    full = np.nan_to_num(x)
    chosen = [int(rng.integers(len(x)))]
    nearest = known_distances(x, full[chosen])[:, 0]
    while len(chosen) < k:
        total = nearest.sum()
        pick = int(rng.choice(len(x), p=nearest / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(pick)
        nearest = np.minimum(nearest, known_distances(x, full[[pick]])[:, 0])
    return full[chosen]


@dataclass(frozen=True)
class MiniBatchKMeans:
    """``restarts`` codebooks grow side by side; each batch holds about ``batch_rows`` maps, cut by a digest of their values.

    A centre's step in a cell is one over the maps it has seen there, so it is the mean of all it was given. The first centres are
    spread over ``init_rows`` maps, those with the smallest digests. There are at most ``max_batches`` batches a round; more
    maps make larger ones.
    """

    k: int = 10
    restarts: int = 3
    rounds: int = 3
    batch_rows: int = 1_000
    max_batches: int = 16
    init_rows: int = 2_000
    seed: int = 1

    def fit(self, vectors: DataFrame, scale: Scale) -> tuple[np.ndarray, float]:
        """Centres of the codebook with the least inertia, and that inertia: the sum of squared distances to the nearest centre."""
        rows = vectors.select("cells", F.xxhash64("cells").alias("digest"))
        first = rows.orderBy("digest").limit(self.init_rows).toArrow()  # init_rows maps
        x = scale(first["cells"].combine_chunks())
        centres = np.array([spread_centres(x, self.k, np.random.default_rng([self.seed, i])) for i in range(self.restarts)])
        seen = np.zeros((self.restarts, self.k, x.shape[1]))
        batches = max(1, min(self.max_batches, -(-vectors.count() // self.batch_rows)))
        for step in range(self.rounds * batches):
            of_batch = F.pmod(F.xxhash64("digest", F.lit(step // batches)), F.lit(batches)) == step % batches
            got = summed(rows.where(of_batch).select("cells"), self._assigned(scale, centres))
            for i in range(self.restarts):
                if i in got:
                    n, s = got[i]
                    seen[i] += n
                    centres[i] += (s - n * centres[i]) / np.maximum(seen[i], 1)
        inertia = summed(rows.select("cells"), lambda b: {0: [known_distances(scale(b.column("cells")), c).min(axis=1).sum() for c in centres]})[0]
        best = int(np.argmin(inertia))
        return centres[best], float(inertia[best])

    def _assigned(self, scale: Scale, centres: np.ndarray):
        k = self.k

        def sums(batch):
            x = scale(batch.column("cells"))
            known, out = ~np.isnan(x), {}
            x, z = x[known.any(axis=1)], np.where(known, x, 0.0)[known.any(axis=1)]
            known = known[known.any(axis=1)].astype(float)
            for i, c in enumerate(centres):
                member = np.zeros((k, len(x)))
                if len(x):
                    member[known_distances(x, c).argmin(axis=1), np.arange(len(x))] = 1.0
                out[i] = np.array([member @ known, member @ z])
            return out

        return sums


def encode_minibatch(maps: DataFrame, spec: GridSpec, rule: MiniBatchKMeans = MiniBatchKMeans()) -> DataFrame:
    """(keys, code, distance) of every map to every centre, on its known cells; a map without any has no distance."""
    vectors = vectors_of(maps, spec)
    scale = cell_scale(vectors)
    centres, _ = rule.fit(vectors, scale)

    def score(x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x).all(axis=1)[:, None], np.nan, np.sqrt(known_distances(x, centres)))

    return _coded(vectors, map_keys(maps), scale, score, rule.k, "distance")


def _coded(vectors: DataFrame, keys: list[str], scale: Scale, score, k: int, name: str) -> DataFrame:
    """One row for each map and code."""
    from pyspark.sql import types as T

    schema = T.StructType([*[vectors.schema[c] for c in keys], T.StructField("code", T.IntegerType()), T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = score(scale(batch.column("cells"))).ravel()
                at = pa.array(np.repeat(np.arange(batch.num_rows), k))
                columns = [batch.column(c).take(at) for c in keys]
                columns += [pa.array(np.tile(np.arange(k, dtype=np.int32), batch.num_rows)), pa.array(values, mask=np.isnan(values))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "code", name])

    return vectors.mapInArrow(run, schema)


# ---------------------------------------------------------------- mixture


@dataclass(frozen=True)
class Mixture:
    """Gaussian components with full covariances over all cells."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density (maps x components) on the known cells of every map."""
        out = np.empty((len(x), len(self.weights)))
        known = ~np.isnan(x)
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        for p, some in enumerate(patterns):
            at = np.flatnonzero(which.ravel() == p)
            for k in range(len(self.weights)):
                low = np.linalg.cholesky(self.covariances[k][np.ix_(some, some)])
                z = np.linalg.solve(low, (x[at][:, some] - self.means[k, some]).T)
                out[at, k] = np.log(self.weights[k]) - np.log(np.diag(low)).sum() - some.sum() / 2 * np.log(2 * np.pi) - (z * z).sum(axis=0) / 2
        return out

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        parts = self.log_parts(x)
        parts = np.exp(parts - parts.max(axis=1, keepdims=True))
        return parts / parts.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class GaussianMixture:
    """Expectation maximisation on whole maps from spread centres and the common covariance.

    ``floor`` is added to all variances. Maps with a missing cell take no part in the fit and are scored on their known cells.
    """

    k: int = 10
    iterations: int = 200
    floor: float = 1e-9
    tolerance: float = 1e-3
    init_rows: int = 2_000
    seed: int = 1

    def fit(self, vectors: DataFrame, scale: Scale) -> tuple[Mixture, list[float]]:
        """The mixture, and the mean log likelihood before every step."""
        rows = vectors.where(~F.exists("cells", lambda v: v.isNull() | F.isnan(v))).select("cells")
        first = rows.withColumn("d", F.xxhash64("cells")).orderBy("d").limit(self.init_rows).toArrow()  # init_rows maps
        if not first.num_rows:
            raise ValueError("no map without a missing cell to fit on")
        means = spread_centres(scale(first["cells"].combine_chunks()), self.k, np.random.default_rng(self.seed))
        n, s, q = self._moments(rows, scale)
        common = q / n - np.outer(s / n, s / n) + self.floor * np.eye(len(s))
        mixture = Mixture(np.full(self.k, 1 / self.k), means, np.repeat(common[None], self.k, axis=0))
        seen: list[float] = []
        for _ in range(self.iterations):
            sums = summed(rows, self._expected(scale, mixture))
            seen.append(float(sums[self.k][0] / sums[self.k][1]))
            mixture = self.maximised(mixture, sums)
            if len(seen) > 1 and abs(seen[-1] - seen[-2]) < self.tolerance:
                break
        return mixture, seen

    def _moments(self, rows: DataFrame, scale: Scale):
        def sums(batch):
            x = scale(batch.column("cells"))
            return {0: np.array(float(len(x))), 1: x.sum(axis=0), 2: x.T @ x}

        got = summed(rows, sums)
        return float(got[0]), got[1], got[2]

    def _expected(self, scale: Scale, mixture: Mixture):
        k = self.k

        def sums(batch):
            x = scale(batch.column("cells"))
            parts = mixture.log_parts(x)
            top = parts.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(parts - top).sum(axis=1))
            share = np.exp(parts - total[:, None])
            out = {i: np.vstack([np.append(share[:, i].sum(), share[:, i] @ x), np.column_stack([share[:, i] @ x, (x * share[:, [i]]).T @ x])]) for i in range(k)}
            return {**out, k: np.array([total.sum(), len(x)])}

        return sums

    def maximised(self, before: Mixture, sums: dict[int, np.ndarray]) -> Mixture:
        total = sum(sums[i][0, 0] for i in range(self.k))
        weights, means, covariances = [], [], []
        for i in range(self.k):
            n = sums[i][0, 0]
            if n <= 1e-10 * total:  # nothing is left of it
                weights.append(1e-10)
                means.append(before.means[i])
                covariances.append(before.covariances[i])
                continue
            mean = sums[i][0, 1:] / n
            spread = sums[i][1:, 1:] / n - np.outer(mean, mean)
            weights.append(n / total)
            means.append(mean)
            covariances.append((spread + spread.T) / 2 + self.floor * np.eye(len(mean)))
        weights = np.array(weights)
        return Mixture(weights / weights.sum(), np.array(means), np.array(covariances))


def encode_whole_mixture(maps: DataFrame, spec: GridSpec, rule: GaussianMixture = GaussianMixture()) -> DataFrame:
    """(keys, code, probability): the components' shares in every map, which add up to 1."""
    vectors = vectors_of(maps, spec)
    scale = cell_scale(vectors)
    mixture, _ = rule.fit(vectors, scale)
    return _coded(vectors, map_keys(maps), scale, mixture.posteriors, rule.k, "probability")
