"""Codebooks over forecast maps: k-means distances, mixture posteriors, random projections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.functions.hashing import normal
from heliogrid.operators.grid import GridSpec, map_vectors
from heliogrid.operators.interpolate import LinearKernel, at_points
from heliogrid.operators.joins import lookup_join
from heliogrid.operators.reduce import reduce_axis, spread
from heliogrid.session import settled


def one_feature(cube: DataFrame, fx: str, hour_mean: bool = False, ens_mean: bool = False) -> DataFrame:
    """Maps of one feature, optionally averaged over hours or, failing that, over members."""
    chosen = cube.where(F.col("fx") == fx).drop("fx")
    if hour_mean:
        return reduce_axis(chosen, "hour", "mean")
    return reduce_axis(chosen, "ens", "mean") if ens_mean else chosen


def map_keys(maps: DataFrame) -> list[str]:
    return [c for c in maps.columns if c not in ("lat_i", "lon_i", "value")]


def standardise_cells(maps: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Each cell scaled by its own mean and population std over all maps."""
    sd = spread("value")
    moments = (maps if fitted_on is None else fitted_on).groupBy("lat_i", "lon_i").agg(
        F.avg("value").alias("_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("_std")
    )
    joined = lookup_join(maps, moments, ["lat_i", "lon_i"])
    return joined.select(*map_keys(maps), "lat_i", "lon_i", ((F.col("value") - F.col("_mean")) / F.col("_std")).alias("value"))


def complete_vectors(maps: DataFrame, spec: GridSpec) -> DataFrame:
    """Map vectors without a missing cell."""
    return map_vectors(maps, map_keys(maps), spec).where(~F.exists("cells", lambda v: v.isNull()))


class DistanceKernel:
    """Euclidean distance of a map to every centre."""

    outputs = ("distance",)

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def prepare(self, points):
        return self.centres

    def run(self, centres, maps):
        (values,) = maps
        squared = (values**2).sum(1)[:, None] - 2.0 * values @ centres.T + (centres**2).sum(1)[None, :]
        return (np.sqrt(np.maximum(squared, 0.0)),)


def fit_centres(vectors: DataFrame, column: str, k: int, seed: int = 1, iterations: int = 20) -> np.ndarray:
    """k-means codebook; the vectors are written once and re-read in every iteration."""
    ready = settled(vectors.select(array_to_vector(column).alias("features")))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(ready)
    return np.array(model.clusterCenters())


def centre_distances(vectors: DataFrame, keys: list[str], centres: np.ndarray, column: str = "cells") -> DataFrame:
    """(keys, code, distance) of every vector to every centre."""
    codes = {"code": np.arange(len(centres))}
    return at_points(vectors, keys, codes, ["code"], DistanceKernel(centres), (column,))


def encode_kmeans(maps: DataFrame, spec: GridSpec, k: int = 10, seed: int = 1) -> DataFrame:
    vectors = complete_vectors(standardise_cells(maps), spec)
    return centre_distances(vectors, map_keys(maps), fit_centres(vectors, "cells", k, seed))


def projection_matrix(spark: SparkSession, k: int, size: int, seed: int = 0) -> np.ndarray:
    """k x size matrix of N(0, 1/k) draws, a function of (component, cell, seed) only."""
    at = spark.range(k * size).select(F.floor(F.col("id") / size).alias("comp"), (F.col("id") % size).alias("cell"))
    draws = at.select("comp", "cell", (normal(F.col("comp"), F.col("cell"), seed) / float(np.sqrt(k))).alias("w")).collect()
    matrix = np.zeros((k, size))
    for d in draws:
        matrix[d["comp"], d["cell"]] = d["w"]
    return matrix


def encode_projection(maps: DataFrame, spec: GridSpec, k: int = 10, seed: int = 0) -> DataFrame:
    """(keys, code, value): Gaussian random projection of the standardised maps."""
    matrix = projection_matrix(maps.sparkSession, k, spec.n_cells, seed)
    vectors = map_vectors(standardise_cells(maps), map_keys(maps), spec)
    return at_points(vectors, map_keys(maps), {"code": np.arange(k)}, ["code"], LinearKernel(matrix))


def encode_mixture(maps: DataFrame, spec: GridSpec, k: int = 10, dims: int = 4, seed: int = 1, iterations: int = 50) -> DataFrame:
    """(keys, code, probability): Gaussian mixture posteriors.

    Maps are projected to a few dimensions first: the covariance over all cells is
    singular with fewer maps than parameters.
    """
    projected = encode_projection(maps, spec, dims, seed)
    keys = map_keys(maps)
    entry = F.sort_array(F.collect_list(F.struct("code", "value")))
    vectors = projected.groupBy(*keys).agg(entry.alias("_v"))
    ready = settled(vectors.select(*keys, array_to_vector(F.col("_v.value")).alias("features")))
    model = GaussianMixture(k=k, seed=seed, maxIter=iterations).fit(ready)
    scored = model.transform(ready).withColumn("_p", vector_to_array("probability"))
    return scored.select(*keys, F.posexplode("_p").alias("code", "probability"))


def daily_codes(codes: DataFrame, labels: list[str], names: list[str], value: str) -> DataFrame:
    """All codes of a day in one row, one column per (member, hour, code)."""
    return (
        codes.withColumn("_k", F.concat_ws("_", *labels))
        .groupBy("day")
        .pivot("_k", names)
        .agg(F.first(value, ignorenulls=True))
    )


def cluster_features(rows: DataFrame, keys: list[str], k: int, seed: int = 1) -> DataFrame:
    """Replaces a feature array by its distances to k centres fitted on all given rows."""
    centres = fit_centres(rows, "features", k, seed)
    distances = centre_distances(rows, keys, centres, "features")
    gathered = distances.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "distance"))).alias("_d"))
    return gathered.select(*keys, F.col("_d.distance").alias("features"))
