"""Operators against brute force, and the properties that they must keep."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import intervals as I
from helixframe.operators import relational as R
from helixframe.operators import stats as S
from helixframe.operators import windows as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    spans = [(rnd.choice("ab"), i, s, s + rnd.randrange(0, 40)) for i, s in enumerate(rnd.randrange(200) for _ in range(80))]
    points = [(rnd.choice("abc"), 1000 + i, rnd.randrange(-5, 260)) for i in range(80)]
    return spans, points


@pytest.fixture(scope="module")
def tables(spark, data):
    spans, points = data
    return spark.createDataFrame(spans, "c string, o long, s long, e long"), spark.createDataFrame(points, "c string, q long, p long")


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("pad", [0, 5])
def test_range_join_equals_all_pairs(data, tables, width, pad):
    spans, points = data
    s, p = tables
    want = sorted((q, o) for c, q, x in points for d, o, a, b in spans if c == d and a <= x + pad and b >= x - pad)
    got = sorted((r["q"], r["o"]) for r in I.range_join(p, s, ["c"], ("p", "p"), ("s", "e"), width, "inner", pad).collect())
    assert got == want
    hit = {q for q, _ in want}
    assert sorted(r["q"] for r in I.range_join(p, s, ["c"], ("p", "p"), ("s", "e"), width, "left_semi", pad).collect()) == sorted(hit)
    anti = sorted(r["q"] for r in I.range_join(p, s, ["c"], ("p", "p"), ("s", "e"), width, "left_anti", pad).collect())
    assert anti == sorted({q for _, q, _ in points} - hit)
    left = [(r["q"], r["o"]) for r in I.range_join(p, s, ["c"], ("p", "p"), ("s", "e"), width, "left", pad).collect()]
    assert sorted(left, key=str) == sorted([*want, *[(q, None) for q in anti]], key=str)


def test_no_position_is_exploded(tables):
    s, p = tables
    plan = I.range_join(p, s, ["c"], ("p", "p"), ("s", "e"), 30)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_band_joins(spark, data, tables):
    spans, points = data
    marks = spark.createDataFrame([(c, a) for c, _, a, _ in spans], "c string, m long")
    _, p = tables
    want = sorted(q for c, q, x in points if not any(c == d and abs(a - x) <= 4 for d, _, a, _ in spans))
    assert sorted(r["q"] for r in I.band_anti_join(p, marks, ["c"], "p", "m", 4).collect()) == want
    counts = {r["q"]: r["n"] for r in I.band_count(p, marks, ["c"], "p", "m", 4).collect()}
    assert counts == {q: sum(c == d and abs(a - x) <= 4 for d, _, a, _ in spans) for c, q, x in points}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_search(spark, data, tables, direction, strict):
    spans, points = data
    right = spark.createDataFrame([(c, a, o) for c, o, a, _ in spans], "c string, a long, v long")
    got = {r["q"]: (r[f"{direction}_a"], r[f"{direction}_v"]) for r in I.asof(tables[1], right, ["c"], "p", "a", ["v"], direction, strict).collect()}
    for c, q, x in points:
        ok = (lambda a, x=x: a < x if strict else a <= x) if direction == "backward" else (lambda a, x=x: a > x if strict else a >= x)
        near = [(a, o) for d, o, a, _ in spans if c == d and ok(a)]
        best = (max if direction == "backward" else min)((a for a, _ in near), default=None)
        assert got[q] == (best, max((o for a, o in near if a == best), default=None))


def covered(spans, c, least=1):
    return {x for x in range(-10, 300) if sum(d == c and a <= x < b for d, _, a, b in spans) >= least}


def test_merge_coverage_and_complement(spark, data, tables):
    spans, _ = data
    s = tables[0]
    merged = I.merge(s, ["c"], "s", "e")
    deep = I.covered(s, ["c"], "s", "e", 2)
    gaps = I.complement(s, ["c"], "s", "e", F.lit(-10).cast("long"), F.lit(300).cast("long"))
    for c in "ab":
        sets = [{x for r in df.filter(F.col("c") == c).collect() for x in range(r["s"], r["e"])} for df in (merged, deep, gaps)]
        assert sets[0] == covered(spans, c)
        assert sets[1] == covered(spans, c, 2)
        assert sets[2] == set(range(-10, 300)) - covered(spans, c)
    again = I.merge(merged.drop("n_merged"), ["c"], "s", "e")
    assert rows(again.select("c", "s", "e")) == rows(merged.select("c", "s", "e"))
    hist = {(r["c"], r["depth"]): r["positions"] for r in I.depth_histogram(s, ["c"], "s", "e").collect()}
    assert sum(k[1] * n for k, n in hist.items()) == sum(b - a for _, _, a, b in spans)


def test_bookended_intervals(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20)], "c string, s long, e long")
    assert rows(I.merge(df, ["c"], "s", "e")) == [("c", 0, 20, 2)]
    assert I.covered(df, ["c"], "s", "e", 2).count() == 0
    assert rows(I.complement(df.limit(0), ["c"], "s", "e", F.lit(0).cast("long"), F.lit(5).cast("long"), universe=df)) == [("c", 0, 5)]


def test_translate_and_islands(spark):
    blocks = spark.createDataFrame([("c1", 101, 200, "s1"), ("c1", 150, 260, "s2")], "c string, a long, b long, name string")
    pts = spark.createDataFrame([("c1", 121), ("c1", 160), ("c1", 5)], "c string, p long")
    assert rows(I.translate(pts, blocks, ["c"], "p", "a", "b", "name", 50)) == [("c1", 121, "s1", 21), ("c1", 160, "s1", 60)]
    assert rows(I.translate(pts, blocks, ["c"], "p", "a", "b", "name", 50, keep=True))[-1] == ("c1", 5, None, None)
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7, 9, 10)], "c string, p long")
    assert rows(I.islands(df, ["c"], "p")) == [("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2)]
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, None, None, 1])], "c string, i long, v int")
    assert rows(I.value_islands(v, ["c"], "i", "v")) == [("a", 1, 0, 1, 2), ("a", 1, 4, 4, 1), ("a", None, 2, 3, 2)]


def test_modes_of_one_row_per_key(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 9, "z"), (2, 1, "w")], "k int, v int, n string")
    order = [F.asc("v")]
    assert [len(rows(R.one_per_key(df, ["k"], order, m))) for m in ("first", "all", "unique")] == [2, 3, 1]
    assert rows(R.one_per_key(df, ["k"], order, "last")) == [(1, 9, "z"), (2, 1, "w")]


def test_joins_with_rests_partition_the_left(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 7, "x"), (1, 8, "y"), (3, 1, "z")], "k int, t int, r string")
    parts = R.matched_and_rest(left, right, ["k"], [F.asc("t")])
    assert rows(parts["matched"]) == [(1, "a", 8, "y"), (1, "b", 8, "y")]
    assert rows(parts["left_only"]) == [(2, "c")] and rows(parts["right_only"]) == [(3, 1, "z")]


def test_venn_masks_partition_the_universe(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k int") for s in ([1, 2, 2], [2, 3]))
    assert rows(R.venn({"A": a, "B": b}, ["k"])) == [(1, 1), (2, 3), (3, 2)]
    counts = R.venn_counts({"A": a, "B": b}, ["k"])
    assert rows(counts) == [(1, "01", "A", 1, 1), (2, "10", "B", 1, 1), (3, "11", "A&B", 2, 1)]


def test_hamming_and_upsert(spark):
    codes = spark.createDataFrame([("ACGT",), ("ACGA",)], "code string")
    seen = spark.createDataFrame([("ACGT",), ("ACGC",), ("TTTT",), ("ACGN",)], "seen string")
    assert rows(R.hamming_join(seen, codes, "seen", "code")) == [("ACGC", "ACGA", 1, 2), ("ACGN", "ACGA", 1, 2), ("ACGT", "ACGT", 0, 2), ("TTTT", None, None, None)]
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int"), spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, n int")
    assert rows(R.upsert([old, new], ["k"])) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]


def test_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10, 20, 30])], "k string, i int, v int")
    assert [r["phase"] for r in W.phases(df, ["k"], ["i"], "v").orderBy("i").collect()] == [0, 2, 0]
    c = W.cumulative(spark.createDataFrame([(0, 1), (30, 2), (60, 3)], "v int, n int"), [], ["v"], "n")
    assert [(r["v"], r["at_least"], round(r["cumulative"], 6)) for r in c.orderBy("v").collect()] == [(0, 6, round(1 / 6, 6)), (30, 5, 0.5), (60, 3, 1.0)]
    lengths = spark.createDataFrame([(x,) for x in (2, 3, 5, 10)], "l int")
    assert rows(W.nx(lengths, [], "l")) == [(10, 20)]
    ties = W.average_rank(spark.createDataFrame([("a", x) for x in (1, 2, 2, 4)], "k string, v int"), ["k"], "v")
    assert sorted(r["rank"] for r in ties.collect()) == [1.0, 2.5, 2.5, 4.0]
    kept = W.take_until(df, ["k"], ["i"], "v", 30)
    assert [r["i"] for r in kept.orderBy("i").collect()] == [0, 1]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums_over_ranges_equal_a_plain_scan(spark, keys):
    rnd = random.Random(6)
    data = [(rnd.choice([1, 1, 1, None]), i, rnd.choice([None, rnd.randrange(50) / 2]), rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, i int, x double, v int")
    by_row = {r["i"]: r["running"] for r in W.running_sums(df, keys, "x", F.col("v"), ties=["i"], parts=7).collect()}
    together = {r["i"]: r["running"] for r in W.running_sums(df, keys, "x", F.col("v"), parts=7).collect()}
    at = lambda x: -1.0 if x is None else x
    for k, i, x, _ in data:
        own = [r for r in data if not keys or r[0] == k]
        assert by_row[i] == sum(r[3] for r in own if (at(r[2]), r[1]) <= (at(x), i))
        assert together[i] == sum(r[3] for r in own if at(r[2]) <= at(x))


def test_fewest_switches_equals_exhaustive_search(spark):
    rnd = random.Random(2)
    series = [[sorted(rnd.sample("abc", rnd.randrange(1, 4))) for _ in range(6)] for _ in range(10)]
    df = spark.createDataFrame([(k, i, o) for k, s in enumerate(series) for i, o in enumerate(s)], "k int, i int, o array<string>")
    got = {}
    for r in W.fewest_switches(df, ["k"], "i", "o").collect():
        got.setdefault(r["k"], {})[r["i"]] = r["state"]
    changes = lambda p: sum(a != b for a, b in itertools.pairwise(p))
    for k, s in enumerate(series):
        path = [got[k][i] for i in range(6)]
        assert all(x in o for x, o in zip(path, s, strict=True))
        assert changes(path) == min(map(changes, itertools.product(*s)))


def test_fewest_switches_reads_many_series_a_batch(spark, sf_dir):
    from helixframe import catalog

    plan = catalog.queries()["fewest_switches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize(("kind", "states"), [("string", "abcd"), ("int", range(12))])
def test_fewest_switches_keeps_ties_of_the_dynamic_program(spark, kind, states):
    rnd = random.Random(7)
    series = {k: [rnd.sample(list(states), rnd.choice([1, 1, 2, 3])) for _ in range(rnd.choice([1, 2, 5, 40]))] for k in [None, *range(150)]}
    series[150] = [rnd.sample(list(states), 2) for _ in range(25_000)]  # longer than two batches
    df = spark.createDataFrame([(k, i, o) for k, s in series.items() for i, o in enumerate(s)], f"k int, i int, o array<{kind}>").repartition(5)
    got = {}
    for r in W.fewest_switches(df, ["k"], "i", "o").collect():
        got.setdefault(r["k"], {})[r["i"]] = r["state"]
    assert got.keys() == series.keys()
    for k, s in series.items():
        costs = [{x: (0, None) for x in s[0]}]
        for allowed in s[1:]:
            costs.append({x: min((c + (p != x), p) for p, (c, _) in costs[-1].items()) for x in allowed})
        path = [min(costs[-1], key=lambda x: (costs[-1][x][0], x))]  # noqa: B023
        for row in costs[:0:-1]:
            path.append(row[path[-1]][1])
        assert got[k] == dict(enumerate(path[::-1]))


def test_fewest_switches_puts_null_positions_last(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (None, ["b"])], "i int, o array<string>")
    got = {r["i"]: r["state"] for r in W.fewest_switches(df, [], "i", "o").collect()}
    assert got == {1: "a", 2: "a", None: "b"}
    assert W.fewest_switches(df.limit(0), [], "i", "o").collect() == []


def test_hmm_equals_exhaustive_search(spark):
    start, move = [0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]]
    emit = [{"x": 0.9, "y": 0.1}, {"x": 0.2, "y": 0.8}]
    seen = "xxyyx"
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(seen)], "k string, i int, s string")
    got = W.hmm(df, ["k"], "i", "s", start, move, emit).orderBy("i").collect()
    p = {path: start[path[0]] * math.prod(move[a][b] for a, b in itertools.pairwise(path)) * math.prod(emit[s][c] for s, c in zip(path, seen, strict=True)) for path in itertools.product((0, 1), repeat=5)}
    best = max(p, key=p.get)
    assert tuple(r["state"] for r in got) == best
    for i, r in enumerate(got):
        assert r["posterior"] == pytest.approx(sum(v for path, v in p.items() if path[i] == best[i]) / sum(p.values()))


def test_neighbourhood_fill_equals_growing_squares(spark):
    rnd = random.Random(1)
    grid = {(x, y): float(rnd.choice([0, 0, 0, 5, 9])) for x in range(12) for y in range(12)}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in grid.items()], "x long, y long, v double")
    got = {(r["x"], r["y"]): (r["v"], r["radius"]) for r in W.neighbourhood_fill(df, "x", "y", "v", 2, 3).collect()}
    for (x, y), v in grid.items():
        want = (v, 0)
        if not v:
            want = (None, None)
            for radius in range(1, 4):
                near = [w for (a, b), w in grid.items() if w and max(abs(a - x), abs(b - y)) <= radius]
                if len(near) >= 2:
                    want = (pytest.approx(sum(near) / len(near)), radius)
                    break
        assert got[x, y] == want


def test_statistics(spark):
    h = S.hardy_weinberg(spark.createDataFrame([(5, 0, 5)], "a int, b int, c int"), "a", "b", "c").first()
    assert (h["p"], h["expected_aa"], h["expected_ab"], h["chi2"]) == (0.5, 2.5, 5.0, 10.0)
    r = spark.range(1).select(S.t_p_value(F.lit(2.0), F.lit(10.0)).alias("t"), S.chi2_p_value(F.lit(3.841458820694124), 1).alias("c"), S.log_gamma(F.lit(5.0)).alias("g"), S.erfc(F.lit(0.5)).alias("e"), S.incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("b"), S.incomplete_gamma(F.lit(2.0), F.lit(1.5)).alias("i")).first()
    assert r["t"] == pytest.approx(0.07338803477074, abs=1e-10)
    assert r["c"] == pytest.approx(0.05, abs=1e-10)
    assert (r["g"], r["e"]) == (pytest.approx(math.log(24)), pytest.approx(math.erfc(0.5)))
    assert r["b"] == pytest.approx(0.5248) and r["i"] == pytest.approx(1 - math.exp(-1.5) * 2.5)
    j = S.ratio_jackknife(spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 1)], "b int, x int, y int"), [], "b", "x", "y").first()
    assert j["theta"] == 0.5
    assert j["jackknife"] == pytest.approx(3 * 0.5 - ((1 - 1 / 6) * 2 / 5 + (1 - 2 / 6) * 2 / 4 + (1 - 3 / 6) * 2 / 3))
    k = S.ka_ks(spark.createDataFrame([("GCC" * 10, "GCA" + "GCC" * 9)], "a string, b string"), "a", "b").first()
    assert k["ka"] == pytest.approx(0.0) and k["ks"] == pytest.approx(-0.75 * math.log(1 - 4 / 3 * 0.1))


def test_bootstrap_centres_on_the_ratio(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 3, 2.0 + i % 5) for i in range(200)], "b int, x double, y double")
    got = [r["theta"] for r in S.bootstrap(df, "b", "x", "y", 200).collect()]
    want = sum(2.0 + i % 5 for i in range(200)) / sum(1.0 + i % 3 for i in range(200))
    assert abs(sum(got) / 200 - want) < 0.02 and 0 < max(got) - min(got) < 0.6


def test_approximate_counter_is_near(spark, sf_dir):
    from helixframe.plans.aggregates import approximate_counter

    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for w in r["text"].split()}
    assert approximate_counter(spark, sf_dir).first()["tokens"] == pytest.approx(len(words), rel=0.06)


def test_waiting(spark, tmp_path):
    from helixframe.streaming import operators as O

    (tmp_path / "f").write_text("x")
    (tmp_path / "_SUCCESS").write_text("")
    assert O.wait_until_stable(spark, str(tmp_path / "f"), pause=0.02)
    assert not O.wait_until_stable(spark, str(tmp_path / "_SUCCESS"), pause=0.02, timeout=0.3)
    assert O.wait_for(spark, str(tmp_path), timeout=1) and not O.wait_for(spark, str(tmp_path), "none", timeout=0.1)
