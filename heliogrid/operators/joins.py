"""Join shapes shared by the operators.

Facts grow with the data; lookup tables usually do not, but nothing here relies
on that: a side is broadcast only after a bounded count proved it small, and
otherwise both sides are spread by a salt, so one hot key never lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
SALTS = 32


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_rows(df: DataFrame, max_rows: int):
    """The rows of a small table, or None when it has more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def _key_columns(df: DataFrame) -> list[str]:
    """Columns of key types; measured values and arrays take no part in salts."""
    values = (T.DoubleType, T.FloatType, T.ArrayType, T.StructType, T.MapType)
    keys = [f.name for f in df.schema if not isinstance(f.dataType, values)]
    return keys or df.columns


def _salt_of(df: DataFrame, salts: int) -> Column:
    """Hash of the keys, masked to a power of two.

    The mask is never NULL, so no IS NOT NULL test on it is pushed down to the scan,
    where it would repeat the work that made the columns.
    """
    if salts & (salts - 1):
        raise ValueError("the number of salts must be a power of two")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in _key_columns(df)])
    return hashed.bitwiseAND(F.lit(salts - 1)).cast("int")


def _every_salt(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of a fact table with a narrow lookup on few distinct keys.

    A proven-small lookup is broadcast, so facts are not shuffled. A larger one is
    repeated once per salt and joined on (key, salt): every key of the facts is then
    spread over ``salts`` tasks.
    """
    if is_bounded(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on, how)
    salted = facts.withColumn("_salt", _salt_of(facts, salts))
    # estimates don't see that the copies multiply the lookup, and would broadcast it
    spread = lookup.withColumn("_salt", _every_salt(salts)).hint("merge")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Few rows that will make many, dealt to a given number of tasks.

    By a hash of the keys: a distribution by the keys themselves would be taken as the one a grouping left, whose small partitions are merged.
    """
    return df.repartition(shuffle_width(df), F.xxhash64(*keys))


def pair_up(left: DataFrame, right: DataFrame, left_parts: int = 8, right_parts: int = 8, spread_left: bool = False, waves: int = 1) -> DataFrame:
    """Every left row with every right row, where the pairs are the wanted result.

    Rows get a block number on their own side and are repeated over the blocks of
    the other side; the equi-join on (left block, right block) then spreads the
    pairs evenly over left_parts * right_parts groups, however large either side is.
    Spark broadcasts a side only if it measures it small enough.

    The right side (points, stations, blocks) is distributed by block first: read from
    one small file it would otherwise make all pairs in one task when it is the
    streamed side. ``spread_left`` does the same for a left side of few rows, such as
    calendar days or their maps, which are merged into one task after a grouping. ``waves``
    deals the groups to that many tasks for each shuffle partition, so that uneven ones level out.
    """
    lhs = left.withColumn("_lb", _salt_of(left, left_parts)).withColumn("_rb", _every_salt(right_parts))
    rhs = right.withColumn("_rb", _salt_of(right, right_parts)).withColumn("_lb", _every_salt(left_parts))
    tasks = waves * shuffle_width(right)
    rhs = rhs.repartition(tasks, "_lb", "_rb")
    if spread_left:
        lhs = lhs.repartition(tasks, "_lb", "_rb")
    return lhs.join(rhs, ["_lb", "_rb"]).drop("_lb", "_rb")


# Rows of one key in a block, about.
BLOCK_ROWS = 1_024


def key_blocks(df: DataFrame, keys: list[str], name: str, most: int = BLOCK_ROWS) -> DataFrame:
    """(keys, _part, name): rows of one key as an array of structs, in order; a key with many of them in several parts. Keys are few, as the grid bounds them."""
    parts = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.ceil(F.count("*") / most).alias("_parts"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    dealt_out = df.join(F.broadcast(parts), same).withColumn("_part", F.pmod(F.xxhash64("stid"), "_parts"))
    entry = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    return dealt_out.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(entry)).alias(name))


def meet(days: DataFrame, stations: DataFrame, pairs: DataFrame | None = None, spread_left: bool = False) -> DataFrame:
    """Every day with every station or, where ``pairs`` (day, stid, y) are given, those only, with y.

    Narrow pairs find their station first and their day last, so wide rows are made where they are used and never shuffled.
    """
    if pairs is None:
        return pair_up(days, stations, spread_left=spread_left)
    return pairs.select("day", "stid", "y").join(stations, "stid").join(days, "day")


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    """True when both tables hold the same set of keys."""
    a, b = left.select(*on), right.select(*on)
    return a.join(b, on, "left_anti").isEmpty() and b.join(a, on, "left_anti").isEmpty()


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
