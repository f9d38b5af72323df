"""Interleaving of sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows, in a fixed order, form blocks of ``block_rows`` rows. With weight w (a fraction of the slots), block i
is released at slot floor(i / w) and has to be placed by slot ceil((i + 1) / w). Every slot takes the released block with the
earliest deadline (ties: the first source by name). Deadlines are always met, for any number of sources and any weights: between
two slots x and y there are at most floor(w y) - ceil(w x) whole windows of a source, y - x of all. So after t slots every source
has floor(w t) or ceil(w t) blocks, less than one block from its weight. Weights are whole numbers of 1e-12, those below a
millionth count as one, and all arithmetic is on whole numbers.

Slots aren't filled one after the other by one task. What is placed by a slot m is known without the slots before: floor(w m)
blocks of every source, and some of the blocks whose window contains m, at most one a source. Those are the ones of earliest deadline
that fit: for every slot x before m, those released at x or later share the m - x slots with the blocks that must be placed there.
Going back from m, a block is taken in at its release, and whenever more are held than fit the latest deadline goes. Between
two known slots the middle follows in the same way, so halves are cut in parallel, level by level, until a row is a period of
slots, which a fold fills. The result is that of filling slot by slot. A cut looks back as far as the release of the oldest open block,
one block of the lightest source, so periods are at least about as long (up to a bound) and cost more than cuts.
Numbers within a source come from counts of (source, digest prefix) cells and windows inside the cells, so no task holds
a source. A row holds a few numbers for every source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.llm.common import shuffle_partitions, written

NO_SOURCE = "(none)"


@dataclass(frozen=True)
class Mix:
    block_rows: int = 8
    period: int = 1000  # slots filled by one row at least
    flatten: float = 0.5  # weights without targets: rows of the source to this power
    max_sources: int | None = None  # more are an error
    cell_rows: int = 1_000  # rows numbered by one window, about


def weights(counts: DataFrame, spec: Mix, targets: DataFrame | None = None) -> DataFrame:
    """(source, slots): slots a period, whole or not; sources without a weight share one."""
    if targets is None:
        asked = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(spec.flatten)))
    else:
        least = targets.groupBy("source").agg(F.sum("weight").alias("weight"))
        asked = counts.join(least, "source", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = asked.agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") > 0).alias("some"), F.count_if(F.col("weight") <= 0).alias("none"))
    left = spec.period - F.when(F.col("none") > 0, 1).otherwise(0)
    share = F.when(F.col("some") == 0, spec.period / F.col("none")).when(F.col("weight") > 0, F.col("weight") / F.col("total") * left)
    return asked.crossJoin(F.broadcast(sums)).select("source", F.coalesce(share, 1 / F.col("none")).cast("double").alias("slots"))  # one row of sums


#: Weights are whole numbers, this many together, about; and the least of them.
UNIT, LEAST = 10**12, 10**6
#: A row fills at most this many times ``period`` slots, unless there are more sources.
LONGEST = 128


def _cut(rows: DataFrame, at: str, begin: str, done: str, limit: str | None, name: str) -> DataFrame:
    """Adds the array ``name``: blocks of every source that are placed before slot ``at``, given those (``done``) before ``begin``.

    ``limit`` names the blocks placed before a later slot, if that is known.
    """
    q, rest, open_ = f"element_at({name}_q, i + 1)", f"element_at({name}_r, i + 1)", f"element_at({done}, i + 1)"
    out = rows.withColumn(f"{name}_q", F.expr(f"transform(w, x -> cast(x as decimal(20,0)) * cast({at} as decimal(18,0)) div d)"))
    out = out.withColumn(f"{name}_r", F.expr(f"transform(w, x -> cast(cast(x as decimal(20,0)) * cast({at} as decimal(18,0)) % d as bigint))"))
    # blocks whose window contains the slot, with slots since the release and to the deadline
    free = f"{rest} > 0 and {q} >= {open_}" + (f" and {q} < element_at({limit}, i + 1)" if limit else "")
    window = f"named_struct('due', (d - {rest} + x - 1) div x, 'i', i, 'age', least({at} - {begin}, ({rest} + x - 1) div x))"
    out = out.withColumn(f"{name}_c", F.expr(f"filter(transform(w, (x, i) -> case when {free} then {window} end), c -> c is not null)"))
    # y slots before: blocks that must be placed in these, of each source the whole windows after y that aren't done
    must = f"""aggregate(transform(w, (x, i) -> greatest(0L, least({q} - {open_}, if(x * y < {rest}, 0L, (x * y - {rest}) div d)))), 0L, (t, n) -> t + n)"""
    held = f"array_sort(concat(u, filter({name}_c, c -> c.age = y)))"
    fold = f"""aggregate(sequence(1L, array_max(transform({name}_c, c -> c.age)) - 1), cast(array() as array<struct<due:bigint,i:int,age:bigint>>),
        (u, y) -> if(size(u) = 0 and not exists({name}_c, c -> c.age = y), u, slice({held}, 1, cast(greatest(0L, least(100000000L, y - {must})) as int))))"""
    older = f"filter({name}_c, c -> c.age = array_max(transform({name}_c, z -> z.age)))"
    none = "cast(array() as array<struct<due:bigint,i:int,age:bigint>>)"
    out = out.withColumn(f"{name}_u", F.expr(f"case when size({name}_c) = 0 then {none} when array_max(transform({name}_c, c -> c.age)) > 1 then {fold} else {none} end"))
    out = out.withColumn(f"{name}_u", F.expr(f"case when size({name}_c) = 0 then {none} else array_sort(concat({name}_u, {older})) end"))
    out = out.withColumn(f"{name}_b", F.expr(f"transform({name}_q, (q, i) -> greatest({open_}, q))"))
    count = f"cast({at} - {begin} - aggregate(zip_with({name}_b, {done}, (b, n) -> b - n), 0L, (t, n) -> t + n) as int)"
    out = out.withColumn(f"{name}_u", F.expr(f"transform(slice({name}_u, 1, {count}), u -> u.i)"))
    out = out.withColumn(name, F.expr(f"transform({name}_b, (b, i) -> b + if(array_contains({name}_u, i), 1L, 0L))"))
    return out.drop(*[f"{name}_{x}" for x in "qrcbu"])


def _halved(rows: DataFrame) -> DataFrame:
    """Every row of slots from ``lo`` to ``hi`` as two."""
    cut = _cut(rows.withColumn("mid", F.expr("(lo + hi) div 2")), "mid", "lo", "a", "b", "m")
    halves = F.expr("explode(array(named_struct('lo', lo, 'hi', mid, 'a', a, 'b', m), named_struct('lo', mid, 'hi', hi, 'a', m, 'b', b))) as h")
    return cut.select("w", "d", halves).select("w", "d", "h.lo", "h.hi", "h.a", "h.b")


def schedule(sources: DataFrame, spec: Mix) -> DataFrame:
    """(source, nth, slot) of the first ``need`` blocks of all sources (source, slots, need); slots are relative to each other."""
    total = sources.agg(F.sum("slots")).first()[0] or 1.0
    whole = F.greatest(F.round(F.col("slots") / total * UNIT), F.lit(float(LEAST))).cast("bigint")
    table = written(sources.select("source", F.col("need").cast("long").alias("need"), whole.alias("w")), "weights")
    one = table.agg(F.array_sort(F.collect_list(F.struct("source", "w", "need"))).alias("s")).where("size(s) > 0")
    one = one.selectExpr("s", "s.w as w", "aggregate(s.w, 0L, (t, x) -> t + x) as d")
    names = one.select(F.posexplode("s").alias("i", "x")).select("i", "x.source", "x.need")
    # the last deadline of a wanted block, and slots for one block of the lightest source
    last = "array_max(transform(s, x -> (cast(x.need as decimal(18,0)) * d + x.w - 1) div x.w))"
    span = one.selectExpr("size(s) as n", f"{last} as last", "d div array_min(w) as light").first()
    if span is None:
        return table.select("source", F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("slot"))
    chunks, levels = 1, 0
    while chunks * spec.period < max(span["n"], min(span["light"], LONGEST * spec.period)):
        chunks *= 2
    while spec.period * chunks << levels < span["last"]:
        levels += 1
    rows = one.selectExpr("w", "d", "0L as lo", f"{spec.period * chunks << levels}L as hi", "transform(w, x -> 0L) as a")
    rows = _cut(rows, "hi", "lo", "a", None, "b").select("w", "d", "lo", "hi", "a", "b")
    tasks, dealt = shuffle_partitions(sources.sparkSession), False
    for level in range(levels):
        if not dealt and 1 << level >= 2 * tasks:
            rows, dealt = rows.repartition(tasks, "lo"), True
        rows = _halved(rows)
    rows = rows if dealt else rows.repartition(tasks, "lo")
    return _filled(rows, spec.period, chunks).join(names, "i").where("nth < need").select("source", "nth", "slot")


def _filled(rows: DataFrame, period: int, chunks: int) -> DataFrame:
    """(i, nth, slot) of the slots of every row, filled in order; places are relative to the row's first slot."""
    first = "cast(x as decimal(20,0)) * cast(lo as decimal(18,0))"
    rows = rows.selectExpr("lo", "b", "a", "d", "w", f"transform(w, x -> {first} div d) as q", f"transform(w, x -> cast({first} % d as bigint)) as r")
    number = "element_at(s.done, i + 1)"
    ahead = f"({number} - element_at(q, i + 1)) * d - element_at(r, i + 1)"  # release times weight
    ready = f"{number} < element_at(b, i + 1) and {ahead} < (t + 1) * x"
    best = f"array_min(filter(transform(w, (x, i) -> case when {ready} then named_struct('due', ({ahead} + d + x - 1) div x, 'i', i, 'n', {number}) end), c -> c is not null))"
    place = f"""transform(array({best}), c -> named_struct(
        'done', transform(s.done, (n, i) -> if(i = c.i, n + 1, n)), 'order', concat(s.order, array(named_struct('i', c.i, 'n', c.n)))))[0]"""
    none = "cast(array() as array<struct<i:int,n:bigint>>)"
    chunk = f"aggregate(sequence(k * {period}, (k + 1) * {period} - 1), named_struct('done', o.done, 'order', {none}), (s, t) -> {place})"
    every = f"""aggregate(sequence(0L, {chunks - 1}L), named_struct('done', a, 'order', {none}), (o, k) ->
        transform(array({chunk}), z -> named_struct('done', z.done, 'order', concat(o.order, z.order)))[0], o -> o.order)"""
    return rows.select("lo", F.posexplode(F.expr(every)).alias("at", "x")).select("x.i", F.col("x.n").alias("nth"), (F.col("lo") + F.col("at")).alias("slot"))


def numbered(rows: DataFrame, cells: DataFrame, cell: Column) -> DataFrame:
    """Adds ``__number``: the row's place (from 0) in its source by the digest of its key."""
    before = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("__source", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__source", "__cell").orderBy("__digest")) - 1
    # the row number first: its shuffle by (source, cell) serves the join as well
    own = rows.withColumn("__cell", cell).withColumn("__inside", inside)
    return own.join(starts, ["__source", "__cell"]).withColumn("__number", F.col("__start") + F.col("__inside"))


def mix(docs: DataFrame, spec: Mix = Mix(), targets: DataFrame | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """All columns of ``docs`` with block, slot and position (columns of these names are replaced), one row for each row.

    Read in the order of position, sources are mixed. Rows without a source form one of their own, rows without a key
    and repeated rows come in any order among each other and keep a place each. A source that has run out leaves its
    slots empty: position has gaps there, and the others keep their order and rates among each other. ``targets`` holds
    (source, weight); the sources it doesn't name, or names with no weight, share one slot a period, so nothing is dropped.
    An empty table gives no rows. More sources than ``max_sources`` are an error, if that is set.
    """
    named = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NO_SOURCE))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    rows = docs.withColumn("__source", named).withColumn("__digest", digest)
    fine = F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int")
    counts = written(rows.groupBy("__source", fine.alias("fine")).agg(F.count("*").alias("n")), "cells")
    size = counts.groupBy(F.col("__source").alias("source")).agg(F.sum("n").alias("n_rows"))
    total = size.agg(F.count("*"), F.max("n_rows")).first()
    if spec.max_sources is not None and total[0] > spec.max_sources:
        raise ValueError(f"{total[0]} sources; at most {spec.max_sources} are wanted")
    width = max(1, min(65536, 65536 * spec.cell_rows // max(1, total[1] or 1)))  # digest prefixes in a cell
    cells = counts.groupBy("__source", F.floor(F.col("fine") / width).cast("int").alias("__cell")).agg(F.sum("n").alias("n"))
    sources = weights(size, spec, targets).join(size, "source").select("source", "slots", F.ceil(F.col("n_rows") / spec.block_rows).cast("long").alias("need"))
    places = written(schedule(written(sources, "sources"), spec), "schedule").toDF("__source", "__block", "__slot")
    out = numbered(rows, cells, F.floor(fine / width).cast("int"))
    out = out.withColumn("__block", F.floor(F.col("__number") / spec.block_rows).cast("long"))
    out = out.join(places, ["__source", "__block"])
    slot = F.col("__slot")
    position = slot * F.lit(spec.block_rows).cast("long") + F.col("__number") % F.lit(spec.block_rows)
    new = [F.col("__block").alias("block"), slot.alias("slot"), position.cast("long").alias("position")]
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("block", "slot", "position")], *new)
