import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing as P
from helixframe.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encode = P.byte_encoder(tokenizer_file())
    rnd = random.Random(2)
    texts = ["", "  ", "it's we'll  they'd\n\n x", "<|endoftext|>a <|endoftext|>", "日本語 テスト", "x\x1cy\x85z", "é́ ٣٤ 😀"]
    texts += ["".join(rnd.choice(" ab\n\t.,'1é日 -") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, lengths, capacity):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == lengths
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(spark, tokenizer):
    rnd = random.Random(3)
    docs = [(i, rnd.choice([None, "", "a b c", " word" * rnd.randrange(1, 90), " t" * 200])) for i in range(150)] + [(7, "again"), (None, "x y")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, length int").repartition(5)
    rows = P.pack(df, tokenizer_file(), capacity=64).collect()
    want = []
    crc = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0] + ([len(ids)] if len(ids) <= 64 else list(range(len(ids) % 64 or 64, len(ids) + 1, 64)))
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, n, a, b - a))
            crc.setdefault((i, n), set()).add(zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = [r.asDict() | {"doc_id": -1 if r["doc_id"] is None else r["doc_id"]} for r in rows]
    sequences = check_packing(got, sorted(key(w) for w in want), 64)
    assert all(r["ids_crc32"] in crc[r["doc_id"], r["piece"]] for r in rows)
    assert sequences <= -(-sum(w[3] for w in want) // 64) + 3
    assert P.pack(df.limit(0), tokenizer_file()).count() == 0


def filled(patterns):
    out = {}
    for items, times in patterns:
        for n in items:
            out[n] = out.get(n, 0) + times
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8))
def test_reduction_and_best_fit_place_everything(counts):
    fixed, rest = P.reduce_dominated(dict(counts), 30)
    patterns = fixed + P.best_fit(rest, 30)
    assert filled(patterns) == counts
    assert all(sum(items) <= 30 and times > 0 for items, times in patterns)


def optimum(items, capacity):
    """Fewest sequences, by exhaustive search."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for n in sorted(set(rooms)):
            if n >= items[i]:
                rooms.remove(n)
                rooms.append(n - items[i])
                go(i + 1, rooms)
                rooms.remove(n - items[i])
                rooms.append(n)
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.remove(capacity - items[i])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fixed_sets_cost_no_sequence(items):
    """What dominance fixes, with the best packing of the rest, is as good as the best packing of all."""
    counts = {n: items.count(n) for n in items}
    fixed, rest = P.reduce_dominated(counts, 20)
    left = sorted((n for n, c in rest.items() for _ in range(c)), reverse=True)
    assert sum(t for _, t in fixed) + (optimum(left, 20) if left else 0) == optimum(sorted(items, reverse=True), 20)
