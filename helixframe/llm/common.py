"""What the operators of this subpackage share: written intermediate tables, and lookups that a hot key cannot unbalance."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many groups are broadcast by ``lookup``: 50,000 rows of under 200 bytes are 10 MB.
MAX_HEAVY = 50_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000
#: A group smaller than this is never treated as heavy.
MIN_HEAVY = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where that is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later stages neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python at most BATCH_ROWS rows at once: rows hold whole texts, so Spark's ten thousand can be gigabytes."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key, "10000")) > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, min_heavy: int = MIN_HEAVY) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row for each value of ``key``, with its row count in ``size``).

    A group is heavy when it holds over 1/MAX_HEAVY of all rows and at least
    ``min_heavy`` of them, so at most MAX_HEAVY groups are heavy whatever the
    input: those are broadcast, and their rows stay where they are. The others
    meet in an ordinary join on ``key``, where no key has more rows than that.
    ``groups`` is read three times and should be a written table; ``key`` must not be null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(min_heavy, total // MAX_HEAVY)
    values = [c for c in groups.columns if c != key]
    heavy = groups.filter(F.col(size) > bound).select(key, *[F.col(c).alias(f"__h_{c}") for c in values])
    if not heavy.take(1):
        return rows.join(groups, key, "left")
    marked = rows.join(F.broadcast(heavy), key, "left")
    is_heavy = F.col(f"__h_{size}").isNotNull()
    # rows of heavy groups get a key of their own kind, spread over all partitions, that matches nothing
    spread = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    light = groups.filter(F.col(size) <= bound).withColumnRenamed(key, "__light").withColumn("__light", F.col("__light").cast("string"))
    out = marked.withColumn("__probe", F.when(is_heavy, spread).otherwise(F.col(key).cast("string")))
    out = out.join(light, F.col("__probe") == F.col("__light"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(c)).alias(c) for c in values])
