"""Time splits, folds and seeded samples.

Day positions are ranked on the distinct-day table only (one row per calendar day).
Samples of rows are exact yet need no global sort: hash buckets are counted, whole
buckets below the cut are kept and only the bucket at the cut is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions.hashing import key_digest
from heliogrid.operators.blocks import numbered_days
from heliogrid.operators.draws import Draw, draw_numbers, with_digest, with_limits
from heliogrid.session import settled

BUCKET_DIGITS = 4


def cutoff_day(df: DataFrame, fraction: float = 0.5, day: str = "day") -> Column:
    """First test day: the day after the first ``fraction`` of distinct days (a scalar)."""
    days = numbered_days(df, day)
    with_total = days.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    chosen = with_total.where(F.col("pos") == F.floor(F.col("n") * fraction))
    return chosen.agg(F.min(day).alias("cut")).scalar()


def time_split(df: DataFrame, fraction: float = 0.5, cut=None, day: str = "day") -> DataFrame:
    """Adds ``split`` = train / test; past days train, later days test."""
    bound = cutoff_day(df, fraction, day) if cut is None else F.lit(cut).cast("date")
    return df.withColumn("split", F.when(F.col(day) >= bound, "test").otherwise("train"))


def assign_folds(days: DataFrame, folds: int = 5, seed: int = 0, day: str = "day") -> DataFrame:
    """Each distinct day with its test fold; fold sizes differ by at most one."""
    distinct = days.select(day).distinct()
    order = Window.orderBy(key_digest(F.col(day), seed), day)
    return distinct.select(day, ((F.row_number().over(order) - 1) % folds).cast("int").alias("fold"))


def take_by_digest(df: DataFrame, keys: list[str], size: Column | str, group: list[str] = (), seed=0, digits: int = BUCKET_DIGITS) -> DataFrame:
    """The ``size`` rows per group that come first in a seeded shuffle of the keys.

    ``size`` is a column constant within a group. ``keys`` must identify a row.
    """
    group = list(group)
    size = F.col(size) if isinstance(size, str) else size
    digest = key_digest(*[F.col(k) for k in keys], seed if isinstance(seed, Column) else F.lit(str(seed)))
    drawn = df.withColumn("_h", digest).withColumn("_size", size)
    drawn = drawn.withColumn("_b", F.substring("_h", 1, digits))
    counted = drawn.groupBy(*group, "_b").agg(F.count("*").alias("_c"), F.first("_size").alias("_size"))
    running = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
    reached = placed.where(F.col("_before") < F.col("_size")).drop("_size")
    inside = drawn.join(reached, [*group, "_b"])
    whole = inside.where(F.col("_before") + F.col("_c") <= F.col("_size"))
    edge = inside.where(F.col("_before") + F.col("_c") > F.col("_size"))
    order = Window.partitionBy(*group, "_b").orderBy("_h", *keys)
    ranked = edge.withColumn("_n", F.row_number().over(order))
    taken = ranked.where(F.col("_before") + F.col("_n") <= F.col("_size")).drop("_n")
    extra = ["_h", "_b", "_c", "_before", "_size"]
    return whole.unionByName(taken).drop(*extra)


def subsample(df: DataFrame, keys: list[str], n: int = 100_000, seed: int = 1) -> DataFrame:
    return take_by_digest(df, keys, F.lit(n), seed=seed)


def learning_curve_draws(n: int, bins: int = 10, repetitions: int = 10) -> list[Draw]:
    """Subsets of ``bins`` equally growing sizes, each drawn ``repetitions`` times, every one in an order of its own."""
    return [Draw(1000 * i + j, n * (i + 1) // bins) for i in range(bins) for j in range(repetitions)]


def learning_curve_samples(df: DataFrame, keys: list[str], bins: int = 10, repetitions: int = 10) -> DataFrame:
    """Rows tagged (size_no, rep, n_samples): growing random subsets, each drawn anew.

    ``df`` is written once with its digests; the subsets are not written and nothing is shuffled for them.
    """
    ready = settled(with_digest(df, keys))
    draws = with_limits(ready, learning_curve_draws(ready.count(), bins, repetitions))
    tags = F.array(*[F.struct(F.lit(k // repetitions).alias("i"), F.lit(k % repetitions).alias("j"), F.lit(d.size).cast("bigint").alias("n")) for k, d in enumerate(draws)])
    numbered = ready.withColumn("_k", draw_numbers(draws)).withColumn("_k", F.explode("_k"))
    tagged = numbered.withColumn("_t", tags[F.col("_k")])
    return tagged.select(*df.columns, F.col("_t.i").alias("size_no"), F.col("_t.j").alias("rep"), F.col("_t.n").alias("n_samples"))
