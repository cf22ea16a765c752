"""Writers of record formats; each task writes its own part, so output scales with the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, header: bool = True, compression: str | None = None, missing: str = "") -> None:
    writer = df.write.option("sep", "\t").option("header", header).option("nullValue", missing).option("emptyValue", "")
    (writer.option("compression", compression) if compression else writer).csv(path)


def partitioned(df: DataFrame, path: str, *keys: str, sort: tuple[str, ...] = (), files: int | None = None) -> None:
    """A folder for each value of the keys. Rows are dealt by key and, where ``files`` is given, by that many ranges of ``sort`` too, so a hot key becomes several files."""
    dealt = df.repartitionByRange(files, *keys, *sort) if files else df.repartition(*keys)
    dealt.sortWithinPartitions(*keys, *sort).write.partitionBy(*keys).parquet(path)


def several(outputs: dict[str, DataFrame], root: str) -> None:
    """Matched, left-only and right-only tables, or any others, each in its folder."""
    for name, df in outputs.items():
        df.write.parquet(f"{root}/{name}")


def table(df: DataFrame, name: str, bucket: str, buckets: int, sort: str | None = None) -> None:
    """A managed table bucketed by a key, so that later joins on it need no shuffle of this side."""
    writer = df.write.bucketBy(buckets, bucket)
    (writer.sortBy(sort) if sort else writer).mode("overwrite").saveAsTable(name)


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(F.col(seq), width))).write.text(path)


def fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def json_column(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def nexus(distances: DataFrame, a: str, b: str, value: str) -> str:
    """A lower-triangle matrix as text; the number of samples, not of rows, bounds it."""
    cells = {(r[a], r[b]): r[value] for r in distances.collect()}
    names = sorted({n for pair in cells for n in pair})
    rows = ["#NEXUS", "BEGIN TAXA;", f"DIMENSIONS NTAX={len(names)};", "TAXLABELS " + " ".join(map(str, names)) + ";", "END;", "BEGIN DISTANCES;", "FORMAT TRIANGLE=LOWER;", "MATRIX"]
    for i, n in enumerate(names):
        rows.append(" ".join([str(n), *[f"{cells.get((m, n), cells.get((n, m), 0)):.6f}" for m in names[:i]], "0"]))
    return "\n".join([*rows, ";", "END;"])


def edges(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """A graph as a table of weighted edges."""
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(weight).alias("weight"))
