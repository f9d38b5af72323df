"""Ridge regression from distributed Gram matrices.

A task turns its batches into one cross-product matrix of (1, features, targets) per
key; matrices are added up in levels and solved in the task where they end, so the
driver sees coefficients only. Rows never leave their partition for a global fit, and
a hot key is cut by a salt for a keyed fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliogrid.operators.interpolate import _matrix
from heliogrid.operators.joins import lookup_join
from heliogrid.session import settled

KEY_SALTS = 8
FIRST_LEVEL = 16
MODEL_ROWS = 10_000


# ---------------------------------------------------------------- sums


def _add(totals: dict, key, matrix) -> None:
    if key in totals:
        totals[key] += matrix
    else:
        totals[key] = matrix


def _batch_keys(batch, by):
    """Row numbers of a batch per distinct key."""
    if not by:
        return [((), slice(None))]
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for name in by:
        encoded = batch.column(name).dictionary_encode()
        codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.fill_null(-1).to_numpy() + 1
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    groups = np.split(order, starts[1:]) if len(order) else []
    return [(tuple(batch.column(k)[int(g[0])].as_py() for k in by), g) for g in groups]


def _rows_out(totals: dict, by, schema, part):
    if not totals:
        return
    keys = list(totals)
    arrays = [pa.array([k[i] for k in keys], type=schema.field(c).type) for i, c in enumerate(by)]
    arrays.append(pa.array([part] * len(keys), type=pa.int32()))
    arrays.append(pa.array([totals[k].tobytes() for k in keys], type=pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def gram_table(df: DataFrame, by: list[str] = (), target: str = "y", features: str = "features", few_keys: bool = False) -> DataFrame:
    """(by..., gram): the cross-product matrix of (1, features, target) per key.

    The target is a number, or an array of several. Rows with a missing feature or
    target take no part. With ``few_keys`` (folds, sample sizes) the tasks that read the
    rows hold one matrix per key and only matrices are shuffled, in two levels; otherwise
    rows are dealt by key and salt first, so that a task holds few keys at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    by = list(by)
    out = T.StructType(
        [df.schema[k] for k in by] + [T.StructField("part", T.IntegerType()), T.StructField("gram", T.BinaryType())]
    )
    arrow = to_arrow_schema(out)
    several = isinstance(df.schema[target].dataType, T.ArrayType)
    # the square root of the tasks, about: as many matrices meet in the first level as in the second
    first_level = max(FIRST_LEVEL, int(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    goal = F.col(target) if several else F.array(F.col(target).cast("double"))
    rows = df.select(*by, goal.alias("_y"), F.col(features).alias("_x"))
    if by and not few_keys:
        salted = rows.withColumn("_salt", F.xxhash64("_y", "_x").bitwiseAND(F.lit(KEY_SALTS - 1)))
        rows = salted.repartition(*by, "_salt").sortWithinPartitions(*by).drop("_salt")

    def partial(batches):
        totals: dict = {}
        part = TaskContext.get().partitionId() % first_level
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("_x")), _matrix(batch.column("_y"))])
            known = ~np.isnan(z).any(axis=1)
            for key, at in _batch_keys(batch, by):
                chosen = z[at][known[at]]
                if len(chosen):
                    _add(totals, key, chosen.T @ chosen)
            if len(totals) > 64 and not few_keys:  # keys arrive sorted: finished ones are passed on
                yield from _rows_out(totals, by, arrow, part)
                totals = {}
        yield from _rows_out(totals, by, arrow, part)

    def summed(batches):
        totals: dict = {}
        part = 0
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for key, at in _batch_keys(batch, by):
                numbers = range(batch.num_rows) if isinstance(at, slice) else at
                for i in numbers:
                    _add(totals, key, _square(batch.column("gram")[i].as_py()))
            part = int(parts[-1]) if len(parts) else part
            if by and len(totals) > 64:
                last = max(totals, key=lambda k: k)
                done = {k: v for k, v in totals.items() if k != last}
                yield from _rows_out(done, by, arrow, part)
                totals = {last: totals[last]}
        yield from _rows_out(totals, by, arrow, part)

    partials = rows.mapInArrow(partial, out)
    if by and few_keys:
        partials = partials.repartition(*by, "part").sortWithinPartitions(*by).mapInArrow(summed, out)
    if by:
        merged = partials.repartition(*by).sortWithinPartitions(*by)
        return merged.mapInArrow(summed, out).drop("part")
    # at most first_level matrices reach the last task
    halfway = partials.repartition(first_level, "part").mapInArrow(summed, out)
    return halfway.repartition(1).mapInArrow(summed, out).drop("part")


def _square(value) -> np.ndarray:
    flat = np.frombuffer(value)
    side = int(round(flat.size**0.5))
    return flat.reshape(side, side).copy()


# ---------------------------------------------------------------- solutions


@dataclass(frozen=True)
class Centred:
    """Moments of a Gram matrix after centring and, if asked, scaling to unit L2 norm."""

    mean: np.ndarray
    scale: np.ndarray
    y_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray


def centred(gram: np.ndarray, normalise: bool, targets: int = 1) -> Centred:
    n, end = gram[0, 0], len(gram) - targets
    mean, y_mean = gram[0, 1:end] / n, gram[0, end:] / n
    xx = gram[1:end, 1:end] - n * np.outer(mean, mean)
    xy = gram[1:end, end:] - n * np.outer(mean, y_mean)
    spread = np.diag(xx).copy()
    constant = spread <= 1e-12 * np.diag(gram)[1:end]
    xx[constant, :], xx[:, constant], xy[constant] = 0.0, 0.0, 0.0
    scale = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, spread))) if normalise else np.ones_like(spread)
    return Centred(mean, scale, y_mean, xx / np.outer(scale, scale), xy / scale[:, None])


def solve_ridges(gram: np.ndarray, alpha: float, normalise: bool, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients (features x targets); the penalty applies to centred features."""
    c = centred(gram, normalise, targets)
    system = c.xx + alpha * np.eye(len(c.mean))
    try:
        coef = np.linalg.solve(system, c.xy)
    except np.linalg.LinAlgError:
        coef = np.linalg.lstsq(system, c.xy, rcond=None)[0]
    coef = coef / c.scale[:, None]
    return c.y_mean - c.mean @ coef, coef


def solve_ridge(gram: np.ndarray, alpha: float, normalise: bool = True) -> tuple[float, np.ndarray]:
    intercepts, coefs = solve_ridges(gram, alpha, normalise, 1)
    return float(intercepts[0]), coefs[:, 0]


def _model_schema(key_fields) -> T.StructType:
    return T.StructType(
        [*key_fields, T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
    )


def _model_batch(keys, solved, schema):
    coefs = pa.array([w.tolist() for _, w in solved], type=pa.list_(pa.float64()))
    arrays = [*keys, pa.array([float(b) for b, _ in solved]), coefs]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def solve_table(grams: DataFrame, by: list[str], alpha: float, normalise: bool = True) -> DataFrame:
    """(by..., intercept, coef): one ridge per key, solved where the matrix is."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _model_schema([grams.schema[k] for k in by])
    arrow = to_arrow_schema(out)

    def solve(batches):
        for batch in batches:
            solved = [solve_ridge(_square(v.as_py()), alpha, normalise) for v in batch.column("gram")]
            yield _model_batch([batch.column(k) for k in by], solved, arrow)

    return grams.mapInArrow(solve, out)


def solve_left_out(grams: DataFrame, by: list[str], alpha: float, normalise: bool = True) -> DataFrame:
    """One ridge per key, fitted on all other keys: the total matrix less the key's own.

    For few keys (folds): their matrices meet in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _model_schema([grams.schema[k] for k in by])
    arrow = to_arrow_schema(out)

    def solve(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        matrices = [_square(v.as_py()) for v in table.column("gram")]
        total = sum(matrices)
        solved = [solve_ridge(total - m, alpha, normalise) for m in matrices]
        yield _model_batch([table.column(k).combine_chunks() for k in by], solved, arrow)

    return grams.repartition(1).mapInArrow(solve, out)


def dot(features, coef):
    """Dot product of two arrays; NULL when a feature is missing."""
    return F.aggregate(F.zip_with(features, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def predict_keyed(df: DataFrame, models: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Adds ``pred`` by the model of each row's key.

    Few models are broadcast after a count; more of them are salted, since a few keys
    (folds, a hot station) may hold most rows.
    """
    joined = lookup_join(df, models, by, max_rows=MODEL_ROWS)
    value = dot(F.col(features), F.col("coef")) + F.col("intercept")
    return joined.withColumn("pred", value).drop("coef", "intercept")


def decomposition(grams: DataFrame, normalise: bool):
    """Centring, scaling and eigendecomposition of one Gram matrix, made in a task."""

    def decompose(batches):
        for batch in batches:
            for value in batch.column("gram"):
                c = centred(_square(value.as_py()), normalise)
                values, vectors = np.linalg.eigh(c.xx)
                parts = [c.mean, c.scale, c.y_mean, np.maximum(values, 0.0), vectors, vectors.T @ c.xy[:, 0]]
                yield pa.RecordBatch.from_pydict({"part": list(range(6)), "v": [p.tobytes() for p in parts]})

    rows = {r["part"]: np.frombuffer(bytes(r["v"])) for r in grams.mapInArrow(decompose, "part bigint, v binary").collect()}
    size = rows[0].size
    return rows[0], rows[1], float(rows[2][0]), rows[3], rows[4].reshape(size, size), rows[5]


# ---------------------------------------------------------------- estimators


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coef: np.ndarray
    alpha: float

    def score(self, features):
        """The prediction from a column of features."""
        weights = F.array(*[F.lit(float(v)) for v in self.coef])
        return dot(features, weights) + self.intercept

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", self.score(F.col("features")))


def linear_model(models: DataFrame, alpha: float) -> LinearModel:
    row = models.first()
    if row is None:
        raise ValueError("no complete rows to fit on")
    return LinearModel(row["intercept"], np.array(row["coef"]), alpha)


@dataclass(frozen=True)
class KeyedLinearModel:
    models: DataFrame
    by: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return predict_keyed(df, self.models, list(self.by))


@dataclass(frozen=True)
class Ridge:
    """Ridge over rows (features, y); with ``by``, one independent model per key."""

    alpha: float = 1e-5
    normalise: bool = True
    by: tuple[str, ...] = ()

    def fit(self, df: DataFrame):
        models = solve_table(gram_table(df, self.by), list(self.by), self.alpha, self.normalise)
        if self.by:
            return KeyedLinearModel(settled(models), self.by)
        return linear_model(models, self.alpha)


# The penalty grid of the cross-validated ridge.
ALPHAS = tuple(10.0**e for e in range(-4, 3))


@dataclass(frozen=True)
class RidgeCV:
    """Ridge with the penalty of least leave-one-out error.

    One Gram pass, one eigendecomposition, and one more pass that scores every penalty.
    """

    alphas: tuple[float, ...] = ALPHAS
    normalise: bool = True

    def scores(self, df: DataFrame, grams: DataFrame) -> dict[float, float]:
        mean, scale, y_mean, values, vectors, projected = decomposition(grams, self.normalise)
        alphas = np.array(self.alphas)

        def score(batches):
            totals = np.zeros(len(alphas))
            count = 0
            for batch in batches:
                x = _matrix(batch.column("_x"))
                y = batch.column("_y").to_numpy(zero_copy_only=False)
                known = ~(np.isnan(x).any(axis=1) | np.isnan(y))
                z = ((x[known] - mean) / scale) @ vectors
                gap = y[known] - y_mean
                for i, a in enumerate(alphas):
                    shrunk = 1.0 / (values + a)
                    leverage = np.minimum((z * z) @ shrunk, 1.0 - 1e-12)
                    totals[i] += (((gap - z @ (projected * shrunk)) / (1.0 - leverage)) ** 2).sum()
                count += int(known.sum())
            yield pa.RecordBatch.from_pydict(
                {"alpha_no": list(range(len(alphas))), "sse": totals.tolist(), "n": [count] * len(alphas)}
            )

        rows = df.select(F.col("features").alias("_x"), F.col("y").cast("double").alias("_y"))
        partial = rows.mapInArrow(score, "alpha_no bigint, sse double, n bigint")
        summed = partial.groupBy("alpha_no").agg((F.sum("sse") / F.sum("n")).alias("mse"))
        return {float(alphas[r["alpha_no"]]): r["mse"] for r in summed.collect()}

    def fit(self, df: DataFrame) -> LinearModel:
        grams = settled(gram_table(df))
        scores = self.scores(df, grams)
        best = min(sorted(scores), key=lambda a: scores[a])
        return linear_model(solve_table(grams, [], best, self.normalise), best)
