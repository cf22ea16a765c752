"""The pipeline's stages on a small corpus, each against what its definition gives."""

import random

import pytest

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        roll = rnd.random()
        if rows and roll < 0.15:
            text = rnd.choice(rows)[1]
        elif rows and roll < 0.3:
            parts = rnd.choice(rows)[1].split()
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
            text = " ".join(parts)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(60, 140)))
        toxic = rnd.random() < 0.25
        if toxic:
            text += " " + rnd.choice(["idiot", "scum"])
        rows.append((i, text, "en", rnd.choice(["a", "a", "a", "b", None]), len(text)))
        labels.append((i, 1, int("idiot" in text or "scum" in text)))
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


@pytest.fixture(scope="module")
def stages(spark, folder):
    root, _ = folder
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, root).write.parquet(f"{root}/out{i}")
        docs = spark.read.parquet(f"{root}/out{i}")
        out[name] = docs
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages_are_the_ones_asked_for_and_keep_the_columns(stages, folder):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert [f"{n} {t}" for n, t in stages[name].dtypes] == [c.strip().replace("long", "bigint") for c in DOCUMENTS.split(",")]


def test_toxic_documents_go_and_clean_ones_stay(stages, folder):
    want = sorted(r[0] for r in folder[1] if "idiot" not in r[1] and "scum" not in r[1])
    assert ids(stages["toxicity"]) == want


def test_copies_go(stages):
    before = stages["toxicity"].collect()
    last = {r["text"]: max(x["doc_id"] for x in before if x["text"] == r["text"]) for r in before}
    assert ids(stages["exact_dedup"]) == sorted(last.values())


def test_near_copies_go(stages):
    from tests.llm.test_ngram_join import brute

    before = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect()]
    assert ids(stages["near_dedup"]) == sorted({c for _, c, _, _ in brute(before)})


def test_mixing_draws_from_what_is_there_within_its_budget(stages):
    before = {r["doc_id"]: r for r in stages["near_dedup"].collect()}
    after = stages["mixing"].collect()
    assert all(before[r["doc_id"]] == r for r in after)
    size = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert 0.9 * size(before.values()) <= size(after) <= size(before.values())
    drawn = lambda s, rows: size([r for r in rows if r["source"] == s]) / size(rows)
    assert drawn("a", after) < drawn("a", list(before.values())) and drawn("b", after) > drawn("b", list(before.values()))


def test_every_drawn_document_is_packed(stages):
    drawn, packed = stages["mixing"].collect(), stages["packing"].collect()
    assert sorted(r["doc_id"] for r in drawn) == sorted(r["doc_id"] for r in packed if r["piece"] == 0)
    room = {}
    for r in packed:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 1024 and len(room) <= -(-sum(room.values()) // 1024) + 2


def test_run_applies_all_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder[0])
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["packing"].collect())
