import random

import pytest

from helixframe.llm import graph
from helixframe.llm import ngram_join as N


def brute(rows, t=0.8, n=5):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= t * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((rows[i][0], min(ids[find(i)]), len(ids[find(i)]), links[i]) for i in range(len(rows)))


def corpus(seed=5, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.7:
            base = (rnd.choice(rows)[1] or "").split() or ["x"]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                at = rnd.randrange(len(base))
                base[at : at + rnd.choice([0, 1])] = [rnd.choice(words)]
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 5, 20, 60, 150])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Two Words"), (n + 4, "two  words")]


@pytest.mark.parametrize("cell", [256, 6])
def test_classes_and_links_equal_brute_force(spark, cell):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(tuple(r) for r in N.join(df, cell_docs=cell).collect())
    assert got == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = corpus(9, 80)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, grams string")
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _, _ in brute(rows)})


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "other words here now then"), (5, "b")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in N.join(df).collect()), key=str)
    assert got == sorted([(None, 3, 2), (None, 3, 2), (3, 3, 2), (3, 3, 0), (5, 5, 0)], key=str)
    assert N.join(df.limit(0)).count() == 0
    assert N.keep_one(df.limit(0)).count() == 0


def test_one_row_stays_whatever_the_ids(spark):
    same, other = "a b c d e f g", "h i j k l m n"
    rows = [(None, same, "p"), (None, same, "q"), (4, same, "r"), (4, same, "s"), (9, same, "t"), (None, other, "u"), (None, other, "v"), (7, "alone here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = sorted(((r["doc_id"], r["text"]) for r in N.keep_one(df).collect()), key=str)
    assert kept == sorted([(4, same), (None, other), (7, "alone here")], key=str)


def chain(n, size=60):
    """Texts of which each shares nine tenths of its words with the next, and little with those further on."""
    words = [f"c{i}" for i in range(n * 5 + size)]
    return [(i, " ".join(words[i * 5 : i * 5 + size])) for i in range(n)]


def test_a_long_chain_costs_what_its_links_cost(spark):
    """Members of one connected chain meet in few cells each, so rows for verification grow with the chain's length."""
    rows_a_member = []
    for n in (300, 1200):
        docs = spark.createDataFrame(chain(n), "doc_id long, text string").repartition(8)
        bands, rows = N.band_shape(0.8, N.RECALL)
        signed = docs.selectExpr("doc_id id", "xxhash64(text) th", "text").mapInArrow(N._sign(5, bands, rows, 7), "id long, th long, fp string, grams long, bands array<long>")
        reps = signed.selectExpr("fp", "xxhash64(fp) fh", "1L copies", "struct(false unnamed, id, th) pick", "grams", "bands").cache()
        keys = reps.selectExpr("fh", "explode(bands) key")
        bucketed = keys.join(keys.groupBy("key").agg(N.F.min("fh").alias("least"), N.F.count("*").alias("n")).filter("n > 1").drop("n"), "key").select("fh", "key", "least")
        tasks = N._tasks(N._cells(reps.drop("fh"), bucketed, 16, N.CELL_GRAMS), bucketed)
        rows_a_member.append(tasks.selectExpr("sum(size(tasks))").first()[0] / n)
    assert rows_a_member[1] < 1.3 * rows_a_member[0] and rows_a_member[1] < 8, rows_a_member
    rows = chain(300)
    assert sorted(tuple(r) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string"), cell_docs=16).collect()) == brute(rows)


def test_many_null_ids_take_time_in_proportion(spark):
    import time

    took = []
    for n in (200, 2000):
        df = spark.createDataFrame([(None, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(n)], "doc_id long, text string")
        start = time.perf_counter()
        assert N.join(df).filter("n_links = 1").count() == n
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 2, took


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"v{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "short one")]
    got = sorted(tuple(r) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 3, 2), (2, 1, 3, 2), (2, 1, 3, 2), (3, 3, 1, 0)]


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = N.band_shape(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999
        assert bands * rows <= N.MAX_HASHES


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    names = list(range(400))
    rnd.shuffle(names)
    named = [(f"{names[a]:03}", f"{names[b]:03}") for a, b in edges]
    got = dict(graph.components(spark.createDataFrame(named, "u string, v string")).collect())
    for part in (range(41), range(100, 130), range(200, 209)):
        group = sorted(f"{names[i]:03}" for i in part)
        assert {got.get(x, x) for x in group} == {group[0]}
    assert f"{names[300]:03}" not in got
