import hashlib
import os
import random

from helixframe.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, lang string, group_size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SCHEMA)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        out.append((i, best, len(ids), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_with_nulls_ties_and_clashing_columns(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(40), rnd.choice([None, "", "a", "a ", "é", "x" * 100_000])) for _ in range(200)] + [(None, "a"), (None, "only null")]
    got = [tuple(r) for r in X.deduplicate(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table(spark):
    assert X.deduplicate(frame(spark, [])).count() == 0
    assert X.keep_one(frame(spark, [])).count() == 0


def test_kept_rows_have_all_columns(spark):
    kept = X.keep_one(frame(spark, [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)]))
    assert kept.columns == ["doc_id", "text", "lang", "group_size"]
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", "en", "clash"), (3, "b", "en", "clash"), (4, "", "en", "clash")]


def test_spills_recursively_and_leaves_no_files(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    texts = [f"text {i % 700}".encode() * 20 for i in range(2000)]
    records = [(hashlib.sha256(t).digest(), t, i, None, 1) for i, t in enumerate(texts)]
    found = {e[1]: (e[2], e[4]) for e in X.grace(records, table_bytes=3_000)}
    assert found == {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert os.listdir(tmp_path) == []


def test_equal_digests_with_other_content_stay_apart():
    same = b"\0" * 32
    found = list(X.grace([(same, b"a", 1, None, 1), (same, b"b", 2, None, 1), (same, b"a", 3, None, 1)]))
    assert sorted((e[1], e[2], e[4]) for e in found) == [(b"a", 3, 2), (b"b", 2, 1)]


def test_heavy_groups_are_looked_up_by_broadcast(spark):
    from pyspark.sql import functions as F

    from helixframe.llm.common import lookup

    rows = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lookup(rows, groups, "k", "n", min_heavy=50).collect()
    assert len(got) == 500
    assert all((r["n"], r["top"]) == ((300, 299) if r["id"] < 300 else (1, r["id"])) for r in got)
