"""Ordered and positional window operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.relational import kept


def _w(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def cumulative(df: DataFrame, keys: list[str], order: list, weight: str) -> DataFrame:
    """Grouped counts with their running share (``cumulative``) and the reverse running sum from the far end (``at_least``)."""
    whole = Window.partitionBy(*keys)
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = _w(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(weight).over(whole)
    return df.withColumn("cumulative", F.try_divide(F.sum(weight).over(upto).cast("double"), total.cast("double"))).withColumn("at_least", F.sum(weight).over(on))


def bucketed(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """``df`` with ``__b``, the range of ``order`` that a row falls in; equal values share one, null comes before all. Cuts are approximate quantiles, at most ``parts`` numbers on the driver."""
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.002)))
    over = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    return df.withColumn("__b", F.when(F.col(order).isNull(), -1).otherwise(over).cast("int"))


def running_sums(df: DataFrame, keys: list[str], order: str, value: Column, ties: list | None = None, out: str = "running", parts: int = 64) -> DataFrame:
    """Running sum of ``value`` in order of a numeric column, for keys of which one may hold a large share of all rows (or none at all).

    A window over such a key is one task's work. Here it is cut into ranges: sums of whole ranges come first, from one
    row a key and range, and only the rows of one range are ordered in a task. With ``ties`` rows are summed one by one, else equal values together.
    """
    cut = bucketed(df, order, parts).withColumn("__v", value)
    sums = cut.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    same = F.col("__b") == F.col("__ob")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__b")
    inside = inside.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow) if ties is not None else inside.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(offsets, same).withColumn(out, F.sum("__v").over(inside) + F.col("__o")).select(*df.columns, out)


def average_rank(df: DataFrame, keys: list[str], order: str, out: str = "rank") -> DataFrame:
    """Ranks in which ties share their mean: values are counted first, so the running sum is over distinct ones."""
    counts = df.groupBy(*keys, order).agg(F.count("*").alias("__n"))
    ranked = running_sums(counts, keys, order, F.col("__n"), out="__upto").withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2.0)
    same = F.col(order).eqNullSafe(F.col("__ro"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return df.join(ranked.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.col(order).alias("__ro"), out), same).select(*df.columns, out)


def prefix_offsets(df: DataFrame, keys: list[str], order: list, length: str, spacer: int = 0, out: str = "offset") -> DataFrame:
    """Where each row begins when all before it are laid end to end, with a spacer after each."""
    before = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(F.col(length) + spacer).over(before), F.lit(0)))


def phases(df: DataFrame, keys: list[str], order: list, length: str, out: str = "phase") -> DataFrame:
    """Reading-frame phase: f(0) = 0 and f(i) = (3 - (len - f(i-1)) mod 3) mod 3, whose closed form is the negative sum of lengths before, modulo 3."""
    before = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.pmod(-F.coalesce(F.sum(length).over(before), F.lit(0)), F.lit(3)).cast("int"))


def take_until(df: DataFrame, keys: list[str], order: list, amount: str, budget) -> DataFrame:
    """Rows in order until the sum before a row reaches the budget."""
    before = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__b", F.coalesce(F.sum(amount).over(before), F.lit(0))).filter(F.col("__b") < budget).drop("__b")


def moving_average(df: DataFrame, keys: list[str], order: list, value: str, last: int = 10, out: str = "moving") -> DataFrame:
    """Mean of the last ``last`` values that are not null, on the rows that have one."""
    return df.filter(F.col(value).isNotNull()).withColumn(out, F.avg(value).over(_w(keys, order).rowsBetween(-(last - 1), 0)))


def forward_fill(df: DataFrame, keys: list[str], order: list, value: str, out: str = "filled") -> DataFrame:
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def tumbling(df: DataFrame, keys: list[str], pos: str, width: int, aggregates: list[Column], full: int | None = None, first: int = 1) -> DataFrame:
    """Windows of ``width`` positions from ``first``; with ``full`` only those that have that many rows."""
    out = df.groupBy(*keys, F.floor((F.col(pos) - first) / width).cast("long").alias("bin")).agg(*aggregates, F.count("*").alias("__n"))
    return (out if full is None else out.filter(F.col("__n") == full)).drop("__n")


def with_zero_bins(counts: DataFrame, keys: list[str], spans: DataFrame, bins: str, bin_col: str, value: str) -> DataFrame:
    """Counts with a row for every bin from 0 up to the number in ``spans``; absent ones are 0."""
    every = spans.filter(F.col(bins) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(bins).cast("long") - 1)).alias(bin_col))
    return every.join(counts, [*keys, bin_col], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def sliding(df: DataFrame, keys: list[str], pos: str, length: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the positions (pos - length, pos], by distance and not by row count."""
    frame = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-(length - 1), 0)
    return df.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()])


def sliding_class(df: DataFrame, keys: list[str], pos: str, good: Column, middle: Column, length: int, limits: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Class 0 to 3 of the last ``length`` rows: +1 if the share of good ones reaches the first limit, +2 if that of middle ones reaches the second."""
    frame = _w(keys, [pos]).rowsBetween(-(length - 1), 0)
    share = lambda c: F.avg(c.cast("int").cast("double")).over(frame)
    return df.withColumn("klass", F.when(share(good) >= limits[0], 1).otherwise(0) + F.when(share(middle) >= limits[1], 2).otherwise(0))


def zones(df: DataFrame, keys: list[str], pos: str, left: str, right: str, value: str, n: int = 50) -> DataFrame:
    """Mean of ``value`` in up to ``n`` equal zones of [left, right], ends included."""
    step = F.greatest(F.lit(1), F.ceil((F.col(right) - F.col(left) + 1) / n))
    inside = df.filter((F.col(pos) >= F.col(left)) & (F.col(pos) <= F.col(right)))
    return inside.groupBy(*keys, F.floor((F.col(pos) - F.col(left)) / step).cast("long").alias("zone")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def equal_zones(df: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """The rows dealt in order into ``n`` zones of floor(count / n), the rest in the last."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("__t"))
    numbered = running_sums(df, keys, order, F.lit(1), ties=[], out="__number").join(totals, keys)
    size = F.greatest(F.lit(1), F.floor(F.col("__t") / n))
    return numbered.withColumn("zone", F.least(F.floor((F.col("__number") - 1) / size), F.lit(n - 1)).cast("int")).select(*df.columns, "zone")


def regimes(df: DataFrame, keys: list[str], order: str, state: str, least: int) -> DataFrame:
    """Changes of state that last: runs shorter than ``least`` rows are passed over, and a change joins the end of one lasting run to the start of the next."""
    from helixframe.operators.intervals import value_islands

    runs = value_islands(df.filter(F.col(state).isNotNull()), keys, order, state).filter(F.col("length") >= least)
    window = _w(keys, ["first"])
    marked = runs.withColumn("previous", F.lag(state).over(window)).withColumn("left", F.lag("last").over(window))
    changed = marked.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))
    return changed.select(*keys, "previous", F.col(state).alias("now"), "left", F.col("first").alias("right"), ((F.col("left") + F.col("first")) / 2.0).alias("middle"), (F.col("first") - F.col("left")).alias("gap"))


def exclusive_share(df: DataFrame, keys: list[str], order: list, value: str, out: str = "share") -> DataFrame:
    """Share of the total that comes before each row."""
    before = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.coalesce(F.sum(value).over(before), F.lit(0)).cast("double"), total.cast("double")))


def nx(df: DataFrame, keys: list[str], length: str, share: float = 0.5, out: str = "n50") -> DataFrame:
    """Largest length at which the sum of that and all longer ones reaches ``share`` of the total; lengths are summed first."""
    sums = df.groupBy(*keys, length).agg((F.count("*") * F.col(length)).alias("__s"))
    upto = Window.partitionBy(*keys).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = sums.withColumn("__c", F.sum("__s").over(upto)).withColumn("__t", F.sum("__s").over(Window.partitionBy(*keys)))
    return marked.groupBy(*keys).agg(F.max(F.when(F.col("__c") >= share * F.col("__t"), F.col(length))).alias(out), F.max("__t").alias("total"))


def _grown(holes: DataFrame, full: DataFrame, least: int, most: int) -> DataFrame:
    """``__b`` (sum, count, radius) of the smallest square with ``least`` full cells around each hole that has one up to radius ``most``: a hole meets the nine tiles of side ``most`` + 1 around it."""
    side = most + 1
    near = holes.withColumn("__i", F.explode(F.array(*[F.floor(F.col("__x") / side) + d for d in (-1, 0, 1)]))).withColumn("__j", F.explode(F.array(*[F.floor(F.col("__y") / side) + d for d in (-1, 0, 1)])))
    tiled = full.withColumn("__i", F.floor(F.col("__a") / side)).withColumn("__j", F.floor(F.col("__b") / side))
    met = near.join(tiled, ["__i", "__j"]).withColumn("__r", F.greatest(F.abs(F.col("__x") - F.col("__a")), F.abs(F.col("__y") - F.col("__b")))).filter(F.col("__r") <= most)
    rings = met.groupBy("__x", "__y", "__r").agg(F.sum("__v").alias("__s"), F.count("*").alias("__n"))
    upto = Window.partitionBy("__x", "__y").orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = rings.select("__x", "__y", "__r", F.sum("__s").over(upto).alias("__s"), F.sum("__n").over(upto).alias("__n")).filter(F.col("__n") >= least)
    return grown.groupBy("__x", "__y").agg(F.min_by(F.struct(F.col("__s"), F.col("__n"), F.col("__r")), "__r").alias("__b"))


def neighbourhood_fill(df: DataFrame, x: str, y: str, value: str, least: int = 2, most: int | None = None) -> DataFrame:
    """Zero or null cells of a grid get the mean of the non-zero ones in the smallest square around them that has at least ``least``, up to radius ``most`` where that is given.

    Without ``most``, cells that radius 8 leaves empty are tried again at twice the radius until all are filled;
    all stay null only where the grid has fewer than ``least`` non-zero cells.
    """
    cells = df.select(F.col(x).cast("long").alias("__x"), F.col(y).cast("long").alias("__y"), F.col(value).cast("double").alias("__v"))
    holes = cells.filter("__v is null or __v = 0").select("__x", "__y").distinct()
    full = cells.filter("__v <> 0").select(F.col("__x").alias("__a"), F.col("__y").alias("__b"), "__v")
    best = _grown(holes, full, least, most or 8)
    if most is None:
        best = kept(best)
        left, reach = kept(holes.join(best, ["__x", "__y"], "left_anti")), 8
        enough = full.limit(least).count() >= least
        while enough and left.take(1):
            reach *= 2
            more = kept(_grown(left, full, least, reach))
            best, left = best.unionByName(more), kept(left.join(more, ["__x", "__y"], "left_anti"))
    joined = cells.join(best, ["__x", "__y"], "left")
    empty = F.col("__v").isNull() | (F.col("__v") == 0)
    return joined.select(F.col("__x").alias(x), F.col("__y").alias(y), F.when(empty, F.col("__b.__s") / F.col("__b.__n")).otherwise(F.col("__v")).alias(value), F.when(empty, F.col("__b.__r")).otherwise(F.lit(0)).alias("radius"))


def fewest_switches(df: DataFrame, keys: list[str], order: str, options: str, schema: str | None = None) -> DataFrame:
    """For each ordered series of allowed states (an array a row), the path of fewest changes; ties go to the lesser state.

    Sequential by nature: a series is read in one task. A task passes over its sorted series in whole batches, forward and back,
    in time that follows the states given. No state costs over one change more than the cheapest, so the set of cheapest states
    is all that a row needs: those of the row before that are still allowed, or all allowed ones where none is.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    n = len(keys)

    def paths(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of whole series with their states."""
        lists = pa.concat_arrays([x.column(n + 1) for x in parts])
        starts = np.concatenate([x.column(n + 2).to_numpy(zero_copy_only=False) for x in parts]).tolist()
        values, ends = lists.flatten().to_pylist(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        sets: dict[tuple, frozenset] = {}
        shared: dict[frozenset, frozenset] = {}
        allowed, cheapest, at, now = [], [], 0, frozenset()
        for end, start in zip(ends, starts, strict=True):
            own = tuple(values[at:end])
            a = sets.get(own)
            if a is None:
                a = sets[own] = shared.setdefault(frozenset(own), frozenset(own))
            now = a if start else (now & a or a)
            now = shared.setdefault(now, now)
            allowed.append(a)
            cheapest.append(now)
            at = end
        states, last = [None] * len(starts), True
        for i in range(len(starts) - 1, -1, -1):
            if last:
                state = min(cheapest[i])
            elif state not in cheapest[i]:
                least = min(cheapest[i])
                state = state if state in allowed[i] and state < least else least
            states[i], last = state, starts[i]
        at = 0
        for x in parts:
            yield pa.RecordBatch.from_arrays([*x.columns[: n + 1], pa.array(states[at : at + x.num_rows], lists.type.value_type)], names=[*keys, order, "state"])
            at += x.num_rows

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(n + 2).to_numpy(zero_copy_only=False))
            if len(starts):
                held.append(batch.slice(0, int(starts[-1])))
                yield from paths(held)
                held, batch = [], batch.slice(int(starts[-1]))
            held.append(batch)
        if held:
            yield from paths(held)

    series = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    marked = df.select(*keys, order, options, (F.row_number().over(series) == 1).alias("__start"))
    kept_types = [StructField(c, df.schema[c].dataType) for c in [*keys, order]]
    out = marked.mapInArrow(solve, StructType([*kept_types, StructField("state", df.schema[options].dataType.elementType)]))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)]) if schema else out


def hmm(df: DataFrame, keys: list[str], order: str, symbol: str, start: list[float], move: list[list[float]], emit: list[dict]) -> DataFrame:
    """Viterbi state and posterior of each row of an ordered series under a hidden Markov model; unseen symbols have probability 1e-12."""
    import numpy as np

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, n = np.log(np.array(move)), len(start)
        e = np.log(np.array([[emit[s].get(x, 1e-12) for s in range(n)] for x in pdf[symbol]]))
        best, back = np.log(np.array(start)) + e[0], []
        fwd = [best.copy()]
        for row in e[1:]:
            total = best[:, None] + a
            back.append(total.argmax(0))
            best = total.max(0) + row
            fwd.append(np.logaddexp.reduce(fwd[-1][:, None] + a, 0) + row)
        path = [int(best.argmax())]
        for row in reversed(back):
            path.append(int(row[path[-1]]))
        bwd = [np.zeros(n)]
        for row in e[:0:-1]:
            bwd.append(np.logaddexp.reduce(a + (row + bwd[-1])[None, :], 1))
        post = np.array(fwd) + np.array(bwd[::-1])
        post = np.exp(post - np.logaddexp.reduce(post, 1)[:, None])
        states = path[::-1]
        return pdf[[*keys, order]].assign(state=states, posterior=post[np.arange(len(states)), states])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + ", state int, posterior double")


def per_partition(df: DataFrame, f, schema: str) -> DataFrame:
    """A task over each partition's batches; ``f`` maps a pandas frame to one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(run, schema)
