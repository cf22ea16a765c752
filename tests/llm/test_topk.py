import math

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm.topk import search

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, scale=64):
    good = [(i, np.array([math.floor(scale * float(x)) for x in v], object)) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 4 == 0:
            found = sorted(((-int((v * w).sum()), i) for i, w in good if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(0, s, (60, 8)) for s in (0.01, 0.2, 1.0)] + [np.tile(rng.normal(0, 1, (1, 8)), (30, 1)), np.zeros((5, 8))])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (904, [None] * 8), (908, [float("nan")] * 8), (912, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 4 == 0, k=5, candidates=25, queries=9).collect())
    assert got == brute(rows, 5)


def test_fewer_candidates_than_asked_for_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.5, 1.0], "b"), (4, [0.25, 0.0], "c")], SCHEMA)
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 4 == 0, k=20).collect())
    assert got == brute([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (4, [0.25, 0.0])], 20)
    empty = search(df.limit(0), F.col("vec_id") % 4 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert empty.count() == 0
    assert search(df, F.col("vec_id") > 100).count() == 0


def test_each_length_is_searched_and_repeated_rows_count(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, (3, 8, 1)[i % 3])]) for i in range(90)]
    rows += [(200, []), (4, rows[4][1]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 4 == 0, k=6, candidates=7, queries=4).collect())
    want = []
    for n in (1, 3, 8):
        some = [r for r in rows if len(r[1]) == n]
        want += {tuple(r) for r in brute(some, 6)} if n != 8 else brute(some, 6)
    assert set(got) == set(want) and len(got) == len({(q, r) for q, r, _, _ in got})


def test_large_components_are_held_whole(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e9, -1.0]), (4, [-5.0, 7.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    assert sorted(tuple(r) for r in search(df, F.col("vec_id") % 4 == 0, scale=1).collect()) == brute(rows, 20, 1)
