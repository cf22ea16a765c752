"""Interval operators: binned joins, nearest and as-of lookups, merging, coverage, complement and gaps.

Intervals are half-open [start, end) unless a name says otherwise. Nothing here
explodes positions: joins meet in bins, coverage is a sweep over ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int, how: str = "inner", pad: int = 0) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed ranges [start, end] overlap when the left one is widened by ``pad``.

    Each row is copied to the bins of ``width`` that its range touches and rows meet by (keys, bin), so work
    follows the overlaps instead of the product. A pair that shares several bins is kept in the first of them
    only. ``how``: inner, left, left_semi or left_anti. Choose ``width`` near the typical range. Columns of the
    right side must not clash with the left's, keys apart.
    """
    extra = [c for c in right.columns if c not in keys]
    if how != "inner":
        # what a row meets depends on its keys and range alone, so those are matched once each and joined back by value
        whole = list(dict.fromkeys([*keys, *left_range]))
        asked = left.select(*whole).distinct()
        found = range_join(asked, right, keys, left_range, right_range, width, "inner", pad)
        found = found.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(whole)], *(extra if how == "left" else []))
        found = found if how == "left" else found.distinct()
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(whole)])
        joined = left.join(found, same, how)
        return joined.select(*left.columns, *extra) if how == "left" else joined.select(*left.columns)
    ls, le = F.col(left_range[0]) - pad, F.col(left_range[1]) + pad
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long")))
    r = right.filter(F.col(right_range[0]) <= F.col(right_range[1])).select(*[F.col(k).alias(f"__r_{k}") for k in keys], *extra)
    r = r.withColumn("__rb", bins(F.col(right_range[0]), F.col(right_range[1])))
    l = left.filter(ls <= le).withColumn("__lb", bins(ls, le))
    first = F.greatest(F.floor(ls / width), F.floor(F.col(right_range[0]) / width)).cast("long")
    condition = (F.col("__lb") == F.col("__rb")) & (F.col(right_range[0]) <= le) & (F.col(right_range[1]) >= ls)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__r_{k}"))
    return l.join(r, condition).filter(F.col("__lb") == first).select(*left.columns, *extra)


def band_anti_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, distance: int) -> DataFrame:
    """Rows of the left with no right position within ``distance``: each right position blocks the bins it reaches, two at most."""
    width = max(1, 2 * distance + 1)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(right_pos).alias("__rp")).distinct()
    r = r.withColumn("__rb", F.explode(F.array_distinct(F.array(*[F.floor((F.col("__rp") + d) / width) for d in (-distance, distance)]))))
    condition = (F.floor(F.col(left_pos) / width) == F.col("__rb")) & (F.abs(F.col(left_pos) - F.col("__rp")) <= distance)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__r_{k}"))
    return left.join(r, condition, "left_anti")


def band_count(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, distance: int, out: str = "n") -> DataFrame:
    """The left with the number of right positions within ``distance``, from ranks in one ordered pass: no pairs are made."""
    events = left.select(*keys, F.col(left_pos).alias("__p"), F.lit(None).cast("int").alias("__w")).distinct()
    marks = right.select(*keys, F.col(right_pos).alias("__p")).groupBy(*keys, "__p").agg(F.count("*").cast("int").alias("__w"))
    window = Window.partitionBy(*keys).orderBy("__p").rangeBetween(-distance, distance)
    counted = events.unionByName(marks).withColumn(out, F.coalesce(F.sum("__w").over(window), F.lit(0)).cast("long")).filter("__w is null").drop("__w")
    return left.join(counted.withColumnRenamed("__p", left_pos), [*keys, left_pos])


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """The left with the ``values`` of the last right row at or before (or the first at or after) each row, prefixed with ``direction``.

    One sort of both sides by (keys, position) and a running last value; of right rows at one position
    the one with the greatest values wins. ``strict`` leaves out equal positions.
    """
    back = direction == "backward"
    r = right.groupBy(*keys, right_on).agg(F.max(F.struct(*values)).alias("__v"))
    r = r.select(*keys, F.col(right_on).alias("__p"), F.lit((0 if back else 2) if not strict else (2 if back else 0)).alias("__o"), F.struct(F.col(right_on).alias("__at"), F.col("__v")).alias("__m"))
    l = left.withColumn("__p", F.col(left_on)).withColumn("__o", F.lit(1)).withColumn("__row", F.struct(*left.columns)).select(*keys, "__p", "__o", "__row")
    r = r.withColumn("__row", F.lit(None).cast(l.schema["__row"].dataType))
    l = l.withColumn("__m", F.lit(None).cast(r.schema["__m"].dataType))
    order = [F.col("__p").asc(), F.col("__o").asc()] if back else [F.col("__p").desc(), F.col("__o").desc()]
    window = _ordered(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("__f", F.last("__m", ignorenulls=True).over(window)).filter(F.col("__row").isNotNull())
    return both.select("__row.*", F.col("__f.__at").alias(f"{direction}_{right_on}"), *[F.col(f"__f.__v.{v}").alias(f"{direction}_{v}") for v in values])


def merge(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of half-open intervals; touching ones merge. Returns keys, start, end and the number merged."""
    before = _ordered(keys, start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = _ordered(keys, start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(end).over(before)
    marked = df.filter(F.col(start) < F.col(end)).withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    grouped = marked.withColumn("__island", F.sum("__new").over(upto))
    return grouped.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def depth_segments(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal stretches of constant depth, from a sweep over ends that are first summed by position."""
    ends = df.filter(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.p").alias(start)).agg(F.sum("e.d").alias("__d")).filter("__d <> 0")
    window = _ordered(keys, start)
    return steps.withColumn("depth", F.sum("__d").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(end, F.lead(start).over(window)).filter(F.col(end).isNotNull()).select(*keys, start, end, "depth")


def covered(df: DataFrame, keys: list[str], start: str, end: str, least: int = 2) -> DataFrame:
    """Stretches covered at least ``least`` times; bookended intervals do not overlap."""
    deep = depth_segments(df, keys, start, end).filter(F.col("depth") >= least)
    return merge(deep.select(*keys, start, end), keys, start, end).drop("n_merged")


def complement(df: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column, least: int = 1, universe: DataFrame | None = None) -> DataFrame:
    """Stretches of [low, high) that no interval covers and that are at least ``least`` long, head and tail included; keys of ``universe`` without intervals are one gap."""
    merged = merge(df, keys, start, end).drop("n_merged")
    if universe is not None:
        merged = universe.select(*keys).distinct().join(merged, keys, "left")
    window = _ordered(keys, start)
    gaps = merged.withColumn("__from", F.greatest(low, F.coalesce(F.lag(end).over(window), low))).withColumn("__to", F.least(high, F.coalesce(F.col(start), high)))
    tail = merged.groupBy(*keys).agg(F.max(end).alias("__m")).filter(F.col("__m").isNotNull()).select(*keys, F.greatest(low, F.col("__m")).alias("__from"), high.alias("__to"))
    both = gaps.select(*keys, "__from", "__to").unionByName(tail)
    return both.filter(F.col("__to") - F.col("__from") >= least).select(*keys, F.col("__from").alias(start), F.col("__to").alias(end))


def depth_histogram(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Positions at each depth from 1."""
    return depth_segments(df, keys, start, end).filter("depth > 0").groupBy(*keys, "depth").agg(F.sum(F.col(end) - F.col(start)).alias("positions"))


def translate(df: DataFrame, blocks: DataFrame, keys: list[str], pos: str, start: str, end: str, target: str, width: int, keep: bool = False) -> DataFrame:
    """Positions moved into the block that holds them, (target, 1 + pos - start); of several blocks the first by (start, end, target).

    A position in no block is dropped, or passed through with ``keep``.
    """
    asked = df.select(*keys, F.col(pos).alias("__p")).distinct()
    hits = range_join(asked, blocks.select(*keys, start, end, target), keys, ("__p", "__p"), (start, end), width)
    first = hits.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__p").agg(F.min(F.struct(start, end, target)).alias("__b"))
    same = reduce(lambda x, y: x & y, [F.col(pos) == F.col("__p"), *[F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]])
    out = df.join(first, same, "left" if keep else "inner")
    return out.select(*df.columns, F.col(f"__b.{target}").alias("target"), (F.col(pos) - F.col(f"__b.{start}") + 1).alias("target_pos"))


def islands(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Runs of consecutive positions: first, last and length; repeated positions count once."""
    rows = df.select(*keys, pos).distinct().withColumn("__g", F.col(pos) - F.row_number().over(_ordered(keys, pos)))
    return rows.groupBy(*keys, "__g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).drop("__g")


def value_islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of an equal value in order, null-safe."""
    window = _ordered(keys, order)
    new = F.when(F.row_number().over(window) == 1, 1).otherwise(F.when(F.col(value).eqNullSafe(F.lag(value).over(window)), 0).otherwise(1))
    marked = df.withColumn("__n", new).withColumn("__g", F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "__g").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__g")
