"""Tables and day numbers that the query families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import table


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.select(*columns) if columns else df


def day(column: str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(column)).cast("long")


DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT)"


def sql_day(column: str) -> str:
    return DAY.format(column)


def r(column: Column, places: int = 6) -> Column:
    return F.round(column, places)


def sql_draw(seed: int, *columns: str) -> str:
    """The SQL of ``text.draw``."""
    return f"CAST('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 12) AS BIGINT)"
