"""Streaming forms of the windowed, joined, deduplicating and stateful operators.

Each takes a streaming (or batch) table and returns one. Event time is cast to
a zoned timestamp, which watermarks need, and results carry it without a zone
again, so a stream's result equals its batch twin's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a temporary one only where none is set, as in tests."""
    return shared_folder(spark, "stream")


def source(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of Parquet with the schema of ``like``. A file is taken once, when its name is complete: writers rename into place, so none is seen while it grows."""
    reader = spark.readStream.schema(like.schema)
    folder_, _, name = path.rstrip("/").rpartition("/")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder_ if name.endswith(".parquet") else path)


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *[c for c in df.columns if c != "window"])


def tumbling(df: DataFrame, column: str, width: str, keys: list[str], aggregates: list[Column], delay: str = "1 day") -> DataFrame:
    return _bounds(timed(df, column, delay).groupBy(F.window(column, width), *keys).agg(*aggregates))


def sliding(df: DataFrame, column: str, width: str, step: str, keys: list[str], aggregates: list[Column], delay: str = "1 day") -> DataFrame:
    return _bounds(timed(df, column, delay).groupBy(F.window(column, width, step), *keys).agg(*aggregates))


def sessions(df: DataFrame, column: str, gap: str, keys: list[str], aggregates: list[Column], delay: str = "1 day") -> DataFrame:
    """Rows of a key whose gaps stay under ``gap`` are one session, which ends that long after its last row."""
    grouped = timed(df, column, delay).groupBy(F.session_window(column, gap).alias("window"), *keys).agg(*aggregates)
    return _bounds(grouped)


def deduplicated(df: DataFrame, column: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key that arrives within the watermark; state is dropped behind it."""
    return timed(df, column, delay).dropDuplicatesWithinWatermark(keys).withColumn(column, F.col(column).cast("timestamp_ntz"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, delay: str = "1 day") -> DataFrame:
    """Pairs of two streams with equal keys whose right time is at most ``within`` after the left time; both sides' state is bounded by that."""
    l, r = timed(left, left_time, delay), timed(right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]), right_time, delay)
    condition = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {within}"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    out = l.join(r, condition)
    return out.select(*left.columns, *[c for c in right.columns if c not in keys]).withColumn(left_time, F.col(left_time).cast("timestamp_ntz")).withColumn(right_time, F.col(right_time).cast("timestamp_ntz"))


def enriched(stream: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A stream joined to a static table."""
    return stream.join(dimension, keys, how)


def mapped(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A stateless map over batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(run, schema)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and sum of each key, one row a key and batch, from state that holds two numbers."""

    def update(k, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def adjacent_groups(df: DataFrame, column: str, key: str, value: str, delay: str = "1 day") -> DataFrame:
    """Groups that are complete once the watermark has passed them: the state of a key is what has come of it so far."""
    return timed(df, column, delay).groupBy(F.window(column, "1 day"), key).agg(F.count("*").alias("n"), F.max(value).alias("most")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), key, "n", "most")


def run(spark: SparkSession, stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into Parquet in the shared folder, and reads the result: exactly once, by the sink's log."""
    out = path or folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_latest(spark: SparkSession, stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream of updates and keeps each key's last: every batch is written under its number, so a repeated batch overwrites itself."""
    out = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    rest = [c for c in stream.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__row"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__row.{k}").alias(k) for k in stream.columns])


def run_complete(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs an aggregate without a watermark and returns its whole result table."""
    out = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def wait_for(spark: SparkSession, path: str, marker: str = "_SUCCESS", timeout: float = 60.0, pause: float = 0.5) -> bool:
    """Whether a folder's done-mark is there before the time is up; any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{marker}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    end = time.time() + timeout
    while time.time() < end:
        if system.exists(target):
            return True
        time.sleep(pause)
    return bool(system.exists(target))


def wait_until_stable(spark: SparkSession, path: str, matches: int = 3, pause: float = 0.5, timeout: float = 60.0, allow_empty: bool = False) -> bool:
    """Whether a file's size stays the same ``matches`` times in a row before the time is up; an empty file waits unless allowed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    end, last, same = time.time() + timeout, -1, 0
    while time.time() < end:
        size = system.getFileStatus(target).getLen() if system.exists(target) else -1
        same = same + 1 if size == last and (size > 0 or (allow_empty and size == 0)) else 0
        if same >= matches:
            return True
        last = size
        time.sleep(pause)
    return False
