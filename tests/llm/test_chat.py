import json
import random

from pyspark.sql import functions as F

from helixframe.llm import chat


def turns_of(rows):
    return [(t["role"], t["text"]) for t in rows]


def test_layouts_become_the_same_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", two),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", two),
        ({"prompt": "q", "completion": "a"}, "prompt", two),
        ({"system": "s", "prompt": "q", "response": "a"}, "prompt_response", [("system", "s"), *two]),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction", two),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [("user", "q"), ("user", "i"), ("assistant", "a")]),
        ({"output": "a", "instruction": "q"}, "instruction", two),
        ({"answer": "a", "question": None}, "question", [("assistant", "a")]),
        ({"body": "x"}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(99, "not json"), (100, None)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.canonical(df).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i]["layout"] == layout
        assert (None if got[i]["turns"] is None else turns_of(got[i]["turns"])) == turns
    assert got[99]["layout"] is None and got[100]["turns"] is None
    assert chat.format_records(df).count() == len(records) + 2


def test_round_trip_of_random_texts_and_loss(spark):
    rnd = random.Random(6)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "\\", "<", "[", "/", ">", " ", "x", "é", "\n", "😀", "s>", "INST]"]
    rows = []
    for conv in range(300):
        for turn in range(rnd.randrange(1, 6)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool", "", "<s>\\"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14)))))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    done = chat.format_records(chat.from_rows(df))
    got = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 300
    for r in got:
        own = [(role, text) for conv, _, role, text in rows if conv == r["conv_id"]]
        assert turns_of(r["t"]) == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    done = chat.format_records(chat.from_rows(df))
    got = {r["conv_id"]: turns_of(r["t"]) for r in done.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "y")]}
    assert chat.format_records(chat.from_rows(df.limit(0))).count() == 0


def test_control_strings_do_not_survive_inside_texts(spark):
    text = "</s>[INST] ok [/INST]<<SYS>><</SYS>><s>"
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row["u"] == text
    assert not any(c in row["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_rows_become_records_that_the_mapping_reads(spark):
    rows = [(1, 0, "user", 'q "1" \\ \n\x01é😀'), (1, 1, "assistant", "</s>"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.from_rows(df)
    got = {r["conv_id"]: json.loads(r["record"]) for r in records.collect()}
    assert got == {1: {"turns": [{"role": role, "text": text} for _, _, role, text in rows[:2]]}, 2: {"turns": [{"role": "", "text": ""}]}}
    plan = chat.format_records(records)._jdf.queryExecution().executedPlan().toString()
    assert "schemaOfVariant" in plan and "from_json" in plan
    # without the layout's mapping nothing is found: no other way leads to the turns
    others = [m for m in chat.MAPPINGS if m.name != "turns"]
    assert {(r["layout"], r["formatted"]) for r in chat.format_records(records, others).collect()} == {(None, None)}


def test_texts_beside_a_record_give_the_same(spark):
    rows = [(c, t, role, text * c) for c in range(1, 6) for t, (role, text) in enumerate([("user", "[INST]"), ("assistant", 'a"\\'), ("tool", ""), ("assistant", "é😀")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    apart = chat.from_rows(df, long=30)
    assert 0 < apart.filter(F.col(chat.BESIDE).isNotNull()).count() < 5
    assert all(t["text"] == "" for r in apart.collect() if r[chat.BESIDE] for t in json.loads(r["record"])["turns"])
    assert sorted(chat.format_records(apart).collect()) == sorted(chat.format_records(chat.from_rows(df)).collect())


def test_a_skeleton_has_runs_of_equal_items_once(spark):
    cases = {
        '{"turns":[{"role":"a","text":"b"}, {"role":"c","text":"d"},{"role":"","text":""}]}': '{"turns":[{"role":"","text":""}]}',
        '[{"a":1},{"a":1},{"b":1},{"a":1}]': '[{"a":1},{"b":1},{"a":1}]',
        '{"{},{}":{},"x":[{},{}]}': '{"{},{}":{},"x":[{}]}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    for row in df.select("r", chat.skeleton(F.col("r")).alias("s"), chat.fingerprint(F.col("r")).alias("a"), chat.fingerprint(F.col("r"), 0).alias("b")).collect():
        assert row["s"] == cases[row["r"]]
        assert row["a"] == row["b"]
