"""Models, minimisers and sketches."""

import lzma
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import models as M


def test_minimisers():
    best = M.hooke_jeeves(lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, [-1.0, 1.0])
    assert best == pytest.approx([1, 1], abs=1e-3)
    assert M.golden_section(lambda x: (x - 2.5) ** 2, 0, 10) == pytest.approx(2.5, abs=1e-6)


def test_fit_by_group(spark):
    df = spark.createDataFrame([(k, float(x), k * 2.0 * x + 1) for k in (1, 2) for x in range(10)], "k int, x double, y double")
    got = {r["k"]: (r["a"], r["b"]) for r in M.fitted(df, ["k"], ["a", "b"], lambda p, v: float(((p["y"] - v[0] * p["x"] - v[1]) ** 2).sum()), [0.0, 0.0]).collect()}
    assert got[1] == pytest.approx((2, 1), abs=1e-4) and got[2] == pytest.approx((4, 1), abs=1e-4)


def test_support_vector_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, 120)
    df = spark.createDataFrame([(1, float(a), float(np.sin(a))) for a in x], "k int, x double, y double")
    rows = M.support_vector_regression(df, ["k"], ["x"], "y", c=10.0, epsilon=0.05).collect()
    assert max(abs(r["fitted"] - r["y"]) for r in rows) < 0.15


def test_pairs_lower_the_spread(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(1, i, rnd.uniform(0, 100)) for i in range(20)], "k int, i int, v double")
    totals = [r["total"] for r in M.improved_pairs(df, ["k"], "i", "v").collect()]
    values = [r["v"] for r in df.collect()]
    assert len(totals) == 10 and np.std(totals) < np.std(values)


def test_marker_scan_finds_the_marker(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        a, b = rnd.randrange(3), rnd.randrange(3)
        y = 2.0 * a + rnd.gauss(0, 1)
        rows += [("hit", a, y), ("miss", b, y)]
    got = {r["m"]: r["lod"] for r in M.marker_scan(spark.createDataFrame(rows, "m string, g int, y double"), "m", "g", "y").collect()}
    assert got["hit"] > 20 > 3 > got["miss"] >= 0


def test_count_min_is_never_too_low(spark):
    df = spark.range(20_000).select((F.col("id") % 700).alias("k"))
    exact = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r["k"]: r["n"] for r in M.count_min_query(df, "k", M.count_min(df, "k", 1 << 11), 1 << 11).collect()}
    assert all(got[k] >= n for k, n in exact.items())
    assert sum(got[k] == n for k, n in exact.items()) > 600
    absent = spark.createDataFrame([(10**9,)], "k long")
    assert M.count_min_query(absent, "k", M.count_min(df, "k")).first()["n"] < 100


def test_empirical_p(spark):
    null = spark.createDataFrame([("a", float(i)) for i in range(99)], "g string, s double")
    got = {r["s"]: r["p"] for r in M.empirical_p(spark.createDataFrame([("a", 50.0), ("a", 200.0), ("a", -1.0)], "g string, s double"), ["g"], "s", null, "s").collect()}
    assert got == {50.0: 0.5, 200.0: 0.01, -1.0: 1.0}


def test_xz_lines(spark, tmp_path):
    from helixframe.sources.records import xz_lines

    for i in range(2):
        (tmp_path / f"{i}.xz").write_bytes(lzma.compress(f"a{i}\nb\n".encode()))
    assert sorted(r["value"] for r in xz_lines(spark, str(tmp_path / "*.xz")).collect()) == ["a0", "a1", "b", "b"]
