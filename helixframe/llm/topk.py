"""Exact top-k inner products by norm-sorted blocks.

Vectors are turned into integers, rotated onto the eigenvectors of their
second-moment matrix (the right singular vectors of the table), and sorted by
descending length into blocks. A candidate block is placed in a task once and
query blocks stream past it. There the inner product is summed over the leading rotated coordinates
first; by Cauchy-Schwarz the rest adds at most the product of the residual
lengths, so a candidate whose partial sum plus that bound stays under the
query's k-th score so far is dropped. What is left is scored in integers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import written

#: Vectors in a candidate block and in a query block; a task holds one of each. Fewer where vectors are so long that a block would have more bytes.
CANDIDATES, QUERIES, BLOCK_BYTES = 8192, 1024, 16 << 20
#: Tasks that candidate blocks are spread over at least, by repeating them for shares of the query blocks.
TASKS = 48
#: Shares of the rotated coordinates after which partial sums are held against the floors, and candidates at a time.
STAGES, CHUNK = (0.375, 0.75), 2048
#: Rotated sums are floats; bounds are widened by this share of the two lengths.
SLACK = 1e-9


def integers(column: str, scale: int) -> Column:
    """Each component x as floor(scale * x), in double; null where the vector is null or a component null or not finite."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _moments(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"moments": [total.ravel().tolist()]})

    return run


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, largest singular value first; one width x width sum from each partition, added elementwise on the executors."""
    sums = vectors.select("v").mapInPandas(_moments(width), "moments array<double>").select(F.posexplode("moments").alias("i", "x"))
    cells = sums.groupBy("i").agg(F.sum("x").alias("x")).collect()  # width * width numbers, whatever the number of rows
    total = np.zeros(width * width)
    for i, x in cells:
        total[i] = x
    values, turned = np.linalg.eigh(total.reshape(width, width))
    return turned[:, np.argsort(-values)]


def _block(kind: str):
    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True])
        vectors = np.stack(pdf["v"].to_numpy()).astype(kind)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "longest": [float(pdf["norm"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    return made


BLOCK = "block long, longest double, ids binary, vectors binary"


def blocks(vectors: DataFrame, size: int, total: int, kind: str = "<i8") -> tuple[DataFrame, int]:
    """Rows of packed vectors and one more than the largest block number; numbered by descending length: ranges of the norm, and within each range parts of at most about ``size``."""
    parts = max(1, -(-total // size))
    numbers = 1
    if parts == 1:
        ranged = vectors.withColumn("block", F.lit(0).cast("long"))
    else:
        cuts = vectors.stat.approxQuantile("norm", [i / parts for i in range(1, min(parts, 1000))] if parts <= 1000 else [i / 1000 for i in range(1, 1000)], 0.001)
        at = F.lit(0)
        levels = sorted(set(cuts), reverse=True)
        level = F.size(F.filter(F.array(*[F.lit(float(c)) for c in levels]), lambda c: c > F.col("norm"))) if levels else at
        # equal lengths can fill a range on their own: ranges are split by id into as many parts as their count asks for
        counts = {r[0]: r[1] for r in vectors.groupBy(level.alias("l")).count().collect()}
        splits = F.create_map(*[x for l, n in counts.items() for x in (F.lit(l), F.lit(max(1, -(-n // size))))])
        widest = max(max(1, -(-n // size)) for n in counts.values())
        numbers = (max(counts) + 1) * widest
        ranged = vectors.withColumn("l", level).withColumn("block", (F.col("l") * widest + F.pmod(F.xxhash64("vec_id"), splits[F.col("l")])).cast("long")).drop("l")
    return ranged.groupBy("block").applyInPandas(_block(kind), BLOCK), numbers


def score_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best ``k`` of the candidates (ids, scores) that can still beat ``floors``; candidates come by descending length.

    Partial sums grow over the rotated coordinates in stages; after each, pairs whose bound is under the floor are dropped,
    and the last stage's survivors are scored in integers.
    """
    width = q.shape[1]
    cuts = sorted({max(1, round(share * width)) for share in STAGES} | {width})
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    exact_in_double = float(np.abs(qf).max(initial=0)) * float(np.abs(cf).max(initial=0)) * width < 2.0**52
    lengths, q_lengths = np.sqrt((cf**2).sum(1)), np.sqrt((qf**2).sum(1))
    rq, rc = qf @ turn, cf @ turn
    q_rest, c_rest = ([np.sqrt((x[:, d:] ** 2).sum(1)) for d in cuts] for x in (rq, rc))
    floors = floors.astype(np.float64).copy()
    none = np.empty(0, np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * len(q_ids)
    for start in range(0, len(c), CHUNK):
        slack = SLACK * q_lengths * lengths[start] + SLACK
        rows = np.nonzero(q_lengths * lengths[start] + slack >= floors)[0]
        cols = np.arange(start, min(start + CHUNK, len(c)))
        if not len(rows):
            break
        total, done = np.zeros((len(rows), len(cols))), 0
        for stage, d in enumerate(cuts):
            total += rq[rows, done:d] @ rc[cols, done:d].T
            done = d
            keep = total >= (floors - slack)[rows][:, None] - np.outer(q_rest[stage][rows], c_rest[stage][cols])
            some, these = keep.any(1), keep.any(0)
            if not some.all() or not these.all():
                rows, cols, total, keep = rows[some], cols[these], total[np.ix_(some, these)], keep[np.ix_(some, these)]
            if not len(rows):
                break
        if not len(rows):
            continue
        keep &= q_ids[rows][:, None] != c_ids[cols][None, :]
        exact = np.rint(qf[rows] @ cf[cols].T).astype(np.int64) if exact_in_double else q[rows] @ c[cols].T
        for r in np.nonzero(keep.any(1))[0]:
            n, at = rows[r], np.nonzero(keep[r])[0]
            scores, ids = exact[r, at], c_ids[cols[at]]
            if len(at) > 4 * k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, ids = scores[scores >= least], ids[scores >= least]
            ids, scores = np.concatenate([best[n][0], ids]), np.concatenate([best[n][1], scores])
            order = np.lexsort((ids, -scores))[:k]
            best[n] = ids[order], scores[order]
            if len(order) == k:
                floors[n] = max(floors[n], float(scores[order[-1]]))
    for n, (ids, scores) in enumerate(best):
        if len(ids):
            yield n, ids, scores


def _vectors(raw: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)


def _pairs(turn: np.ndarray, k: int, width: int, kind: str):
    """Rows come by block, the candidates of a block first; each query block after them is scored and let go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, c_ids, c = None, np.empty(0, np.int64), np.empty((0, width), np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if not row.asks:
                    now, c_ids, c = (row.block, row.part), np.frombuffer(row.ids, np.int64), _vectors(row.vectors, width, kind)
                    continue
                if now != (row.block, row.part):
                    raise RuntimeError("a query block came before its candidates")
                q_ids = np.frombuffer(row.ids, np.int64)
                out: tuple[list, list, list] = ([], [], [])
                for n, ids, scores in score_block(q_ids, _vectors(row.vectors, width, kind), c_ids, c, turn, k, np.frombuffer(row.floors, np.float64)):
                    out[0].append(np.full(len(ids), q_ids[n]))
                    out[1].append(ids)
                    out[2].append(scores)
                if out[0]:
                    yield pd.DataFrame({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return run


def _first(head, turn: np.ndarray, k: int, width: int, kind: str):
    """Floors of each query block: the k-th scores within the block of the longest vectors, and the least score over length, under which a shorter block cannot matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c_ids, c = np.frombuffer(head.value[0], np.int64), _vectors(head.value[1], width, kind)
        for frame in frames:
            floors, reach = [], []
            for row in frame.itertuples(index=False):
                q_ids, q = np.frombuffer(row.q_ids, np.int64), _vectors(row.q_vectors, width, kind)
                found = np.full(len(q_ids), -np.inf)
                for n, ids, scores in score_block(q_ids, q, c_ids, c, turn, k, found):
                    if len(ids) >= k:
                        found[n] = scores[k - 1]
                floors.append(found.tobytes())
                lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                reach.append(float((found / np.maximum(lengths, 1e-300)).min()))
            yield frame.assign(floors=floors, reach=reach)

    return run


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller id. Vectors that are null or hold null, NaN or infinite
    components take no part, nor do rows with a null id. A query's own rows are those
    with its id; a repeated candidate row counts once for each time it stands there, a
    query id that repeats is one query if its vectors agree. A query meets the vectors of its own
    length (number of components); each length is a search of its own. Vectors without components take no part. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    wanted = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col, scale).alias("v"), is_query.alias("is_query"))
    wanted = wanted.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    most = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    widths = wanted.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked"), most.alias("most")).orderBy("w").collect()  # a row for each length
    found = [_search(wanted.filter(F.size("v") == w["w"]), w["w"], w["n"], "<i4" if w["most"] < 1 << 31 else "<i8", k, candidates, queries) for w in widths if w["asked"]]
    if not found:
        return spark.createDataFrame([], result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(wanted: DataFrame, width: int, total: int, kind: str, k: int, candidates: int, queries: int) -> DataFrame:
    """query_id, vec_id and score of what may be among the best, for vectors of one length."""
    spark, bytes_each = wanted.sparkSession, width * np.dtype(kind).itemsize
    candidates, queries = (max(1, min(n, BLOCK_BYTES // bytes_each)) for n in (candidates, queries))
    vectors = wanted.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    turn = rotation(vectors, width)
    packed, numbers = blocks(vectors.select("vec_id", "v", "norm"), candidates, total, kind)
    packed = written(packed, "topk-blocks")
    asked = vectors.filter("is_query").select("vec_id", "v", "norm").dropDuplicates(["vec_id", "v"])
    made, _ = blocks(asked, queries, asked.count(), kind)
    renamed = made.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # every query block first meets the block of the longest vectors (one block of bounded bytes, whatever the table's size), which sets its floors
    longest = packed.orderBy(F.desc("longest"), "block").select("ids", "vectors").first()
    head = spark.sparkContext.broadcast((bytes(longest[0]), bytes(longest[1])))
    floored = written(renamed.mapInPandas(_first(head, turn, k, width, kind), "q_block long, q_ids binary, q_vectors binary, floors binary, reach double"), "topk-queries")
    # pairs of block numbers that lengths allow
    pairs = floored.select("q_block", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))).alias("block"))
    pairs = pairs.join(packed.select("block", "longest"), "block").filter(F.col("longest") * (1 + 1e-6) >= F.col("reach")).select("q_block", "block")
    parts = max(1, -(-TASKS // -(-total // candidates)))
    placed = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
    streamed = pairs.join(floored, "q_block").select("block", F.pmod("q_block", F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), "floors")
    work = placed.unionByName(streamed).repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    return work.mapInPandas(_pairs(turn, k, width, kind), "query_id long, vec_id long, score long")
