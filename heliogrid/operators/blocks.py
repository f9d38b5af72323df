"""Feature blocks: DataFrames sharing key columns, combined by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions.expressions import derived_columns, quoted
from heliogrid.operators.joins import same_keys


class BlockError(ValueError):
    """Blocks that do not cover the same keys."""


class Blocks:
    """Named blocks over common keys, with free metadata attributes.

    ``blocks['name']`` and ``blocks.name`` give one block, ``rows(a, b)`` restricts
    all of them to a range of days, ``values()`` puts their columns side by side.
    """

    def __init__(self, keys: list[str], blocks: dict[str, DataFrame], meta: dict | None = None, check: bool = True):
        first = None
        for name, block in blocks.items():
            missing = [k for k in keys if k not in block.columns]
            if missing:
                raise BlockError(f"block {name} lacks key columns {missing}")
            if check and first is not None and not same_keys(first, block, keys):
                raise BlockError("all blocks must agree on their keys")
            first = block if first is None else first
        self.__dict__.update(keys=list(keys), blocks=dict(blocks), meta=dict(meta or {}))

    def __getitem__(self, name: str) -> DataFrame:
        return self.blocks[name]

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("blocks", "meta", "keys"):
            raise AttributeError(name)
        if name in self.blocks:
            return self.blocks[name]
        if name in self.meta:
            return self.meta[name]
        raise AttributeError(f"{name} not found")

    def __setattr__(self, name: str, value) -> None:
        if name in self.blocks:
            self[name] = value
        else:
            self.meta[name] = value

    def __setitem__(self, name: str, block: DataFrame) -> None:
        others = [b for n, b in self.blocks.items() if n != name]
        if others and not same_keys(others[0], block, self.keys):
            raise BlockError(f"keys of block {name} do not agree")
        self.blocks[name] = block

    def rows(self, start: int, stop: int | None = None, day: str = "day") -> Blocks:
        """Days ``start`` to ``stop`` (one day when ``stop`` is omitted) of every block."""
        stop = start + 1 if stop is None else stop
        reference = next(iter(self.blocks.values()))
        days = reference.select(day)
        cut = {n: row_slice(b, start, stop, day, days) for n, b in self.blocks.items()}
        return Blocks(self.keys, cut, self.meta, check=False)

    def drop(self, *names: str) -> Blocks:
        unknown = [n for n in names if n not in self.blocks]
        if unknown:
            raise KeyError(unknown[0])
        left = {n: b for n, b in self.blocks.items() if n not in names}
        return Blocks(self.keys, left, self.meta, check=False)

    def values(self) -> DataFrame:
        return hstack(list(self.blocks.values()), self.keys)


def numbered_days(df: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days with their 0-based position; one row per calendar day."""
    distinct = df.select(day).distinct()
    return distinct.select(day, (F.row_number().over(Window.orderBy(day)) - 1).alias("pos"))


def row_slice(df: DataFrame, start: int, stop: int, day: str = "day", days: DataFrame | None = None) -> DataFrame:
    """Rows whose day is among the distinct days start <= position < stop.

    The bounds come from the distinct-day table as one scalar, so the data itself is
    only filtered, never ranked.
    """
    numbered = numbered_days(df if days is None else days, day)
    wanted = numbered.where((F.col("pos") >= start) & (F.col("pos") < stop))
    bounds = wanted.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("b")).scalar()
    return df.where(F.col(day).between(bounds.getField("lo"), bounds.getField("hi")))


def assign_block(base: DataFrame, block: DataFrame, on: list[str]) -> DataFrame:
    """Adds the columns of ``block``; its keys must be exactly those of ``base``."""
    if not same_keys(base, block, on):
        raise BlockError("block keys do not agree with the table")
    return base.join(block, on, "left")


def hstack(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Columns of all blocks side by side."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.join(frame, on)
    return result


def select_features(df: DataFrame, names, column: str = "fx") -> DataFrame:
    """Keeps the named features of a long table."""
    return df.where(F.col(column).isin(list(names)))


def add_features(df: DataFrame, keys: list[str], ops, source=quoted) -> DataFrame:
    """Keys plus one derived column per operation."""
    return df.select(*keys, *derived_columns(ops, source))


def clip_to(pred: DataFrame, labels: DataFrame, column: str = "pred", label: str = "y") -> DataFrame:
    """Clips a column to the range of the training labels."""
    span = labels.agg(F.struct(F.min(label).alias("lo"), F.max(label).alias("hi")).alias("s")).scalar()
    clipped = F.least(F.greatest(F.col(column), span.getField("lo")), span.getField("hi"))
    return pred.withColumn(column, F.when(F.col(column).isNotNull(), clipped))


def features_array(df: DataFrame, columns: list[str], keep: list[str], name: str = "features") -> DataFrame:
    """Packs numeric columns into one ARRAY<DOUBLE> feature column."""
    packed = F.array(*[quoted(c).cast("double") for c in columns])
    return df.select(*keep, packed.alias(name))
