"""The registered queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from helixframe.llm import queries as Q


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = Q.queries()[name](spark, sf_dir)
    want = duck.sql(Q.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


def test_one_row_for_each_document(spark, sf_dir):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    for name in ("op2_pii", "op4_toxicity", "op5_ngram_join", "op6_quality", "op7_exact_dedup"):
        assert sorted(r["doc_id"] for r in Q.queries()[name](spark, sf_dir).collect()) == ids
