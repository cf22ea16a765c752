import math
import re

import pytest

from helixframe.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, tokens string, n_docs int, weight double"


def docs(spark, sizes):
    rows = [(s * 1000 + i, " w" * (3 + i % 5) + "\n", None if s == 2 else f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    return rows, spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


def entropy(p):
    return -sum(x * math.log(x) for x in p if x)


def weights(tokens, e):
    total = sum(tokens)
    z = [(t / total) ** e for t in tokens]
    return [x / sum(z) for x in z]


def brute_exponent(tokens, target):
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(tokens, mid)) >= target else (low, mid)
    return low


def count(text):
    return len(re.findall(r"[^ \t\n\r\f\x0b]+", text or ""))


def test_exponent_meets_the_entropy(spark):
    totals = spark.createDataFrame([("a", 700, 1), ("b", 200, 1), ("c", 90, 1), ("d", 10, 1)], "__src string, tokens long, n_docs long")
    found = M.solve(totals, target_entropy=1.2)
    assert found.exponent == pytest.approx(brute_exponent([700, 200, 90, 10], 1.2), abs=1e-9)
    assert found.entropy == pytest.approx(1.2, abs=1e-8)
    assert M.solve(totals, target_entropy=0.1).exponent == 1.0
    assert M.solve(totals, target_entropy=9.0).exponent == pytest.approx(0.0, abs=1e-9)


def test_repetition_limit(spark):
    tokens = [700, 200, 90, 10]
    totals = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(tokens)], "__src string, tokens long, n_docs long")
    found = M.solve(totals, target_entropy=9.0, max_epochs=3.0)
    most = max(w * 1000 / t for w, t in zip(weights(tokens, found.exponent), tokens, strict=True))
    assert most <= 3.0 and most == pytest.approx(3.0, abs=1e-6)


def test_streams_keep_their_budgets_and_whole_epochs(spark):
    rows, df = docs(spark, [300, 60, 25, 8])
    out = M.mix(df, entropy_share=0.8, block_tokens=40)
    assert out.columns == [*df.columns, "__epoch", "__block_key", "__key"]
    got = out.select("doc_id", "source", "__epoch", "__block_key", "__key").collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + count(t)
    names = sorted(tokens, key=str)
    e = brute_exponent([tokens[s] for s in names], entropy(weights([tokens[s] for s in names], 1)) + 0.8 * (math.log(4) - entropy(weights([tokens[s] for s in names], 1))))
    size = {i: count(t) for i, t, _ in rows}
    for s, w in zip(names, weights([tokens[s] for s in names], e), strict=True):
        own = [r for r in got if r["source"] == s]
        budget = w * sum(tokens.values())
        drawn = sum(size[r["doc_id"]] for r in own)
        assert budget - 8 <= drawn <= budget + 1e-3
        whole = int(budget // tokens[s])
        every = {i for i, _, x in rows if x == s}
        for epoch in range(whole):
            assert {r["doc_id"] for r in own if r["__epoch"] == epoch} == every
        assert all(r["__epoch"] <= whole for r in own)
    orders = [[r["doc_id"] for r in sorted((r for r in got if r["source"] == "s3" and r["__epoch"] == e), key=lambda r: (r["__block_key"], r["__key"]))] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1])


def test_the_last_epoch_is_the_longest_run_that_fits(spark):
    rows, df = docs(spark, [200, 40])
    got = M.mix(df, entropy_share=0.5, block_tokens=60).filter("source = 's0'").collect()
    every = M.measured(df, "doc_id", "text", "source", M.SEED).filter("source = 's0'").collect()
    assert 0 < len(got) < len(every)
    blocks = math.ceil(sum(count(r["text"]) for r in every) / 60)
    by_block = {r["__key"] % blocks: r["__block_key"] for r in got}
    drawn = {r["doc_id"] for r in got}
    inside = [b for b in by_block if all(r["doc_id"] in drawn for r in every if r["__key"] % blocks == b)]
    partial = [b for b in by_block if b not in inside]
    assert len(partial) <= 1
    if partial:
        assert all(by_block[b] < by_block[partial[0]] for b in inside)
        keys = sorted(r["__key"] for r in every if r["__key"] % blocks == partial[0])
        taken = sorted(r["__key"] for r in got if r["__key"] % blocks == partial[0])
        assert keys[: len(taken)] == taken


def test_nulls_one_source_no_tokens_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", "b")], "doc_id long, text string, source string")
    got = M.mix(df, entropy_share=0.5)
    assert {r["doc_id"] for r in got.collect()} >= {1, 2}
    assert M.mix(df.filter("source = 'a'")).count() == 2
    assert M.mix(df.filter("source = 'b'"), entropy_share=0.5).count() == 1
    assert M.mix(df.limit(0), entropy_share=0.5).count() == 0


def test_main_path_runs_no_python(spark):
    _, df = docs(spark, [30, 5])
    plan = M.mix(df, entropy_share=0.5)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_source_is_drawn_more_often_than_allowed(spark):
    """A budget beyond that is cut: at most ``max_epochs`` times all tokens are drawn."""
    _, df = docs(spark, [60, 6])
    got = M.mix(df, entropy_share=0.5, max_epochs=2.0, budget=10**7).collect()
    times = {}
    for r in got:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    assert sum(count(r["text"]) for r in got) <= 2 * sum(count(r["text"]) for r in df.collect())


def test_clashing_names_repeated_rows_and_long_texts(spark):
    rows = [(1, "a b c", "s", 7, 8, "x", 2.5), (1, "a b c", "s", 7, 8, "x", 2.5), (2, "w " * 200_000, "t", 1, 2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __src long, __key long, c0 string, n_docs double")
    got = M.mix(df, entropy_share=0.5)
    assert got.columns == [*df.columns, "__epoch", "__block_key", "__key_"]
    found = got.collect()
    assert {tuple(r)[:7] for r in found} <= {tuple(r) for r in df.collect()}
    ones = [r for r in found if r["doc_id"] == 1]
    assert len(ones) % 2 == 0 and M.mix(df, entropy_share=0.5, places=False).columns == df.columns
