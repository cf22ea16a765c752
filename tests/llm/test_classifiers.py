import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import quality as Q
from helixframe.llm import toxicity as T

DOCS = "doc_id long, text string, toxic string, score string"


@pytest.fixture(scope="module")
def toxic(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        a, b = rnd.random() < 0.15, rnd.random() < 0.1
        if a:
            text.insert(rnd.randrange(len(text)), rnd.choice(["Grok!", "blarg", "(snarf)"]))
        if b:
            text.insert(rnd.randrange(len(text)), rnd.choice(["zonk.", "quux"]))
        rows.append((i, " ".join(text), "x", "y"))
        labels.append((i, int(a), int(a or b)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, insult int, toxic int")


def test_chain_finds_held_out_toxic_documents(spark, toxic):
    docs, labels = toxic
    chain = T.fit(docs, labels.filter("doc_id < 600"), ["insult", "toxic"])
    out = T.score(docs, chain)
    assert out.columns == ["doc_id", "p_insult", "p_toxic", "toxic"]
    got = {r["doc_id"]: r for r in out.collect()}
    held = labels.filter("doc_id >= 600").collect()
    assert np.mean([got[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in held]) > 0.97
    clean = T.keep_clean(docs, chain)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_later_models_see_earlier_probabilities(toxic):
    docs, labels = toxic
    chain = T.fit(docs, labels, ["insult", "toxic"])
    n = len(chain.vocabulary)
    assert [len(w) for w in chain.weights] == [n + 1, n + 2]
    assert chain.weights[1][n] > 0.5  # an insult makes the last category likelier


def test_out_of_fold_probabilities_differ_from_fitted_ones():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2, (60, 20)).astype(float), rng.integers(0, 2, (60, 2)).astype(float)
    a = T.fit_chain(x, y, np.arange(60) % 5, ["a", "b"], {str(i): i for i in range(20)})
    first = T._sigmoid(np.column_stack([x, np.ones(60)]) @ a.weights[0])
    naive = T._logistic(np.column_stack([x, first, np.ones(60)]), y[:, 1], np.ones(60))
    assert not np.allclose(naive, a.weights[1])


def test_equal_rows_count_as_often_as_they_stand():
    rng = np.random.default_rng(4)
    x, y = np.repeat(rng.integers(0, 2, (15, 4)).astype(float), 6, axis=0), np.tile(rng.integers(0, 2, 10), 9).astype(float)
    whole = T._logistic(np.column_stack([x, np.ones(90)]), y, np.ones(90))
    assert np.allclose(T.fit_chain(x, y[:, None], np.zeros(90), ["a"], {str(i): i for i in range(4)}).weights[0], whole, atol=1e-3)


def test_kinds_follow_shared_features():
    x = np.zeros((30, 9))
    for i in range(30):
        group = 0 if i < 15 else 1 if i < 25 else 2
        x[i, group * 3 + i % 3] = x[i, group * 3 + (i + 1) % 3] = 1
    kinds = T.kinds_of(np.vstack([x, np.zeros(9)]), 3)
    assert kinds.tolist() == [0] * 15 + [1] * 10 + [2] * 5 + [-1]
    assert T.kinds_of(np.zeros((0, 4)), 3).tolist() == [] and set(T.kinds_of(np.ones((2, 4)), 3)) <= {0, 1}


@pytest.fixture(scope="module")
def halves(spark):
    """Labelled documents of sf0.1: an even id trains, an odd one is held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = docs.join(labels.filter("doc_id % 2 = 0").select("doc_id"), "doc_id").select("text")
    held = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").join(seen.distinct(), "text", "left_anti")  # no copies of training texts
    return docs, labels.filter("doc_id % 2 = 0"), held.cache()


def tally(out, held):
    rows = out.select("doc_id", "toxic").join(held.select("doc_id", F.col("toxic").alias("y"), "quality", "lang"), "doc_id").collect()
    told = lambda some: (sum(r["toxic"] for r in some if r["y"]), sum(1 for r in some if r["y"]))
    return told([r for r in rows if r["quality"] and r["lang"] == "en"]), told([r for r in rows if r["quality"] and r["lang"] != "en"]), sum(r["toxic"] for r in rows if not r["y"]), sum(1 for r in rows if not r["y"])


def test_chain_on_held_out_documents_of_all_languages(spark, halves):
    """No word of the corpus is in the code. Documents of low quality are left out of recall: their words are replaced by junk, and labels stay."""
    docs, labels, held = halves
    chain = T.fit(docs, labels, ["toxic"], kinds=3)
    assert chain.categories == ("kind_1", "kind_2", "kind_3", "toxic")
    english, others, wrong, clean = tally(T.score(held, chain), held)
    assert english[0] >= 0.97 * english[1] and others[0] >= 0.7 * others[1], (english, others)
    assert wrong <= 0.01 * clean
    lone = T.fit(docs, labels, ["toxic"])
    assert len(lone.weights) == 1
    english_1, others_1, wrong_1, _ = tally(T.score(held, lone), held)
    assert english[0] + others[0] - wrong >= english_1[0] + others_1[0] - wrong_1 - 2  # earlier categories cost nothing
    print("chain", english, others, wrong, clean, "lone", english_1, others_1, wrong_1)
    assert np.abs(chain.weights[-1][len(chain.vocabulary) : -1]).max() > 0.1  # and the last model uses them


def test_toxicity_without_usable_labels_rejects_nothing(spark, toxic):
    docs, labels = toxic
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert T.score(docs.limit(5), T.fit(docs, some, ["insult", "toxic"])).filter("toxic").count() == 0
    chain = T.fit(docs, labels, ["insult", "toxic"])
    odd = spark.createDataFrame([(None, None, "", ""), (1, "", "", ""), (1, "blarg " * 50_000, "", "")], DOCS)
    assert T.score(odd, chain).count() == 3
    assert T.keep_clean(odd, chain).count() == 2
    assert T.score(odd.limit(0), chain).count() == 0


def good(rnd):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randrange(10, 120)))


def junk(rnd):
    return rnd.choice([lambda: "spam " * rnd.randrange(5, 90), lambda: " ".join(rnd.choice(["$$$", "###", "%%%"]) for _ in range(rnd.randrange(5, 80))), lambda: good(rnd).upper().replace(" ", "!! ")])()


def test_quality_from_positives_and_unlabelled_text(spark):
    rnd = random.Random(7)
    kind = [int(rnd.random() < 0.7) for _ in range(1500)]
    rows = [(i, good(rnd) if k else junk(rnd), "x", "y") for i, k in enumerate(kind)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kind) if i % 2], "doc_id long, quality int")
    network = Q.fit(docs, labels)
    assert 0.55 < network.prior < 0.85
    out = Q.score(docs, network)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    held = [r for r in out.collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == kind[r["doc_id"]] for r in held]) > 0.95
    other = labels.withColumn("quality", F.when(Q.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(Q.fit(docs, other).w1, network.w1)  # held-out labels are not read


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "", ""), (1, "", "", ""), (2, "x " * 100_000, "", ""), (2, "x", "", "")], DOCS)
    empty = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["score"] == 0.5 for r in Q.score(docs, empty).collect())
    assert Q.score(docs.limit(0), empty).count() == 0
    assert Q.features("").tolist() == [0.0] * len(Q.FEATURES)


def test_non_negative_risk_beats_treating_unlabelled_as_negative():
    rng = np.random.default_rng(2)
    p, n = rng.normal(1, 1, (400, 3)), rng.normal(-1.5, 1, (300, 3))
    u = np.concatenate([rng.normal(1, 1, (700, 3)), n])
    network = Q.fit_network(p, u)
    assert 0.55 < network.prior < 0.85
    assert (network.score(rng.normal(1, 1, (500, 3))) > 0.5).mean() > 0.9
    assert (network.score(rng.normal(-1.5, 1, (500, 3))) > 0.5).mean() < 0.1
