"""Functions for SQL text: session functions that the planner inlines, and Python ones by registration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.seq import CODES, COMPLEMENTS

#: Name -> (parameters, type, body). A body is inlined, so it is optimised and compiled like any expression.
SQL_FUNCTIONS = {
    "hx_revcomp": ("s STRING", "STRING", f"reverse(translate(s, '{CODES}', '{COMPLEMENTS}'))"),
    "hx_gc": ("s STRING", "DOUBLE", "try_divide(CAST(regexp_count(s, '[GCgc]') AS DOUBLE), regexp_count(s, '[ACGTacgt]'))"),
    "hx_and": ("a BIGINT, b BIGINT", "BIGINT", "a & b"),
    "hx_or": ("a BIGINT, b BIGINT", "BIGINT", "a | b"),
    "hx_xor": ("a BIGINT, b BIGINT", "BIGINT", "a ^ b"),
    "hx_compl": ("a BIGINT", "BIGINT", "~a"),
    "hx_lshift": ("a BIGINT, n INT", "BIGINT", "shiftleft(a, n)"),
    "hx_rshift": ("a BIGINT, n INT", "BIGINT", "shiftright(a, n)"),
    "hx_meanqual": ("q STRING", "DOUBLE", "aggregate(filter(split(q, ''), c -> c <> ''), 0D, (a, c) -> a + ascii(c) - 33) / nullif(length(q), 0)"),
    "hx_qualcount": ("q STRING, least INT", "INT", "size(filter(split(q, ''), c -> c <> '' AND ascii(c) - 33 >= least))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; again is harmless."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("hx_murmur128", murmur128())
    return [*SQL_FUNCTIONS, "hx_murmur128"]


def add(spark: SparkSession, name: str, f, kind: T.DataType):
    """A user's function of one or two series under a name for SQL and for ``calc``'s custom()."""
    return spark.udf.register(name, F.pandas_udf(f, kind, F.PandasUDFType.SCALAR))


def murmur3_128(data: bytes, seed: int = 0) -> str:
    """The 128-bit hash of the x64 form, as hex of its two halves."""
    mask = 2**64 - 1
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    turn = lambda x, n: (x << n | x >> 64 - n) & mask

    def mix(k: int, a: int, n: int, b: int) -> int:
        return turn(k * a & mask, n) * b & mask

    def finish(k: int) -> int:
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ k >> 33) * c & mask
        return k ^ k >> 33

    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 = ((turn(h1 ^ mix(k1, c1, 31, c2), 27) + h2) * 5 + 0x52DCE729) & mask
        h2 = ((turn(h2 ^ mix(k2, c2, 33, c1), 31) + h1) * 5 + 0x38495AB5) & mask
    rest = data[whole:]
    if len(rest) > 8:
        h2 ^= mix(int.from_bytes(rest[8:], "little"), c2, 33, c1)
    if rest:
        h1 ^= mix(int.from_bytes(rest[:8], "little"), c1, 31, c2)
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    h1, h2 = finish(h1), finish(h2)
    h1 = (h1 + h2) & mask
    return f"{h1:016x}{(h2 + h1) & mask:016x}"


def murmur128():
    return F.pandas_udf(lambda s: pd.Series([None if x is None else murmur3_128(x.encode()) for x in s]), T.StringType(), F.PandasUDFType.SCALAR)
