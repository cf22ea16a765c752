"""Exact deduplication by Grace hashing.

Records are dealt to tasks by a hash of their whole text. A task keeps an
open-addressing table of complete texts; when the table outgrows its memory,
what it holds and all that follows go to spill files by further bits of the
hash, and each file is processed the same way, recursively.

Before the shuffle every input partition is reduced by the same table, so a
group of copies of any size sends one record a task.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import lookup, small_batches, text_of, written

#: Bytes of text that one table holds before it spills.
TABLE_BYTES = 48 << 20
#: Spill files of one level.
FANOUT = 16
#: Records in an emitted batch, and its bytes.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, an entry its digest, complete text, best row and count."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, text: bytes, key: int | None, row: object, count: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (n := self.slots[at]) >= 0:
            entry = self.entries[n]
            if entry[0] == digest and entry[1] == text:
                entry[4] += count
                if key is not None and (entry[2] is None or key > entry[2]):
                    entry[2], entry[3] = key, row
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, text, key, row, count])
        self.bytes += len(text) + 200
        if len(self.entries) * 10 > len(self.slots) * 6:
            self._grow()

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (len(self.slots) * 4)
        mask = len(self.slots) - 1
        for n, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def scratch_dir() -> str:
    """A folder among Spark's own scratch folders, where this task's spill files live until it ends."""
    local = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
    return tempfile.mkdtemp(prefix="grace-", dir=local if local and os.path.isdir(local) else None)


def grace(records: Iterable[tuple], table_bytes: int = TABLE_BYTES, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """Entries [digest, text, key, row, count], one for each distinct text of ``records`` (same five fields)."""
    table, own, files = ContentTable(), None, None
    try:
        for record in records:
            if files is None:
                table.add(*record)
                if table.bytes > table_bytes and len(table.entries) > 1 and depth < 24:
                    own = tempfile.mkdtemp(dir=folder) if folder else scratch_dir()
                    files = [open(os.path.join(own, str(n)), "wb") for n in range(FANOUT)]
                    for entry in table.entries:
                        pickle.dump(tuple(entry), files[entry[0][8 + depth] % FANOUT], -1)
                    table = ContentTable()
            else:
                pickle.dump(tuple(record), files[record[0][8 + depth] % FANOUT], -1)
        if files is None:
            yield from table.entries
            return
        for f in files:
            f.close()
        for n in range(FANOUT):
            path = os.path.join(own, str(n))
            yield from grace(_read(path), table_bytes, depth + 1, own)
            os.remove(path)
    finally:
        for f in files or ():
            f.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _batches(entries: Iterable[list], schema: pa.Schema, with_text: bool, with_row: bool) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    size = 0

    def made() -> pa.RecordBatch:
        columns = [[e[0] for e in rows], [e[2] for e in rows], [e[4] for e in rows]]
        if with_text:
            columns.append([e[1] for e in rows])
        if with_row:
            columns.append([e[3] for e in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for e in entries:
        rows.append(e)
        size += len(e[1]) if with_text else 0
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


def _schema(with_text: bool, row: pa.DataType | None) -> pa.Schema:
    fields = [("digest", pa.binary()), ("key", pa.int64()), ("size", pa.int64())]
    fields += [("content", pa.binary())] if with_text else []
    return pa.schema(fields + ([("row", row)] if row is not None else []))


def _combiner(row: pa.DataType | None, table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, table = _schema(True, row), ContentTable()
        for batch in batches:
            rows = batch.column(2).to_pylist() if row is not None else None
            keys = batch.column(0).to_pylist()
            for n, text in enumerate(batch.column(1)):
                content = text.as_py()
                table.add(hashlib.sha256(content).digest(), content, keys[n], rows[n] if rows else None, 1)
                if table.bytes > table_bytes:
                    yield from _batches(table.entries, schema, True, row is not None)
                    table = ContentTable()
        yield from _batches(table.entries, schema, True, row is not None)

    return run


def _reducer(row: pa.DataType | None, table_bytes: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                digests, keys, sizes, contents = columns[:4]
                rows = columns[4] if row is not None else [None] * len(keys)
                yield from zip(digests, contents, keys, rows, sizes, strict=True)

        yield from _batches(grace(records(), table_bytes), _schema(with_text, row), with_text, row is not None)

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct text: ``digest`` (SHA-256), ``key`` (largest id) and ``size`` (rows).

    With ``carry`` also ``content`` (the text as UTF-8) and ``row`` (the kept row's other columns).
    A null text is the empty text; a null id is smaller than any other. Texts whose
    digests agree are the same only if their complete contents do.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    others = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    row_type = T.StructType([docs.schema[c] for c in others]) if others else None
    row = to_arrow_type(row_type) if row_type is not None else None
    selected = [F.col(id_col).cast("long").alias("key"), text_of(text_col).cast("binary").alias("content")]
    if others:
        selected.append(F.struct(*[F.col(c) for c in others]).alias("row"))
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("size", T.LongType())]
    content = [T.StructField("content", T.BinaryType())]
    payload = [T.StructField("row", row_type)] if row_type is not None else []
    combined = small_batches(docs).select(*selected).mapInArrow(_combiner(row, table_bytes), T.StructType(fields + content + payload))
    dealt = combined.repartition("digest")
    return dealt.mapInArrow(_reducer(row, table_bytes, carry), T.StructType(fields + (content if carry else []) + payload))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the largest id stays. Nulls: a null text is empty; a null id
    never stays beside another id, and where a group has only null ids ``keep_id`` is
    null and ``kept`` true. Rows repeated with the same id and text are one
    document listed more than once: each listing has the same values. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    found = written(groups(docs, id_col, text_col).select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("key").alias("keep_id"), F.col("size").alias("group_size")), "exact-groups")
    rows = docs.select(F.col(id_col).alias("__id"), F.sha2(text_of(text_col), 256).alias("text_sha256"))
    joined = lookup(rows, found, "text_sha256", "group_size")
    return joined.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``; a repeated row stays once, a null text comes back empty."""
    found = groups(docs, id_col, text_col, carry=True)
    named = {id_col: F.col("key").cast(docs.schema[id_col].dataType), text_col: F.col("content").cast("string")}
    return found.select(*[named.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
