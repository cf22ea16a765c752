import json

from pyspark.sql import functions as F

from helixframe.llm import chat

BIG = 20_500_000


def test_a_text_over_the_parsers_limit_keeps_its_conversation(spark):
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), F.lit(BIG)).alias("text"))
    got = chat.format_records(chat.from_rows(df)).select("layout", F.length("formatted").alias("n"), "loss_spans").first()
    assert got["layout"] == "turns" and got["n"] == BIG + len("<s></s>") and got["loss_spans"][0]["length"] == BIG


def test_a_json_record_with_a_long_text_keeps_its_layout(spark):
    text = F.repeat(F.lit("x"), F.lit(BIG))
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.concat(F.lit('{"prompt":"q\\"}:","completion":"'), text, F.lit('"}')).alias("record"))
    got = chat.canonical(df).select("layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n")).first()
    assert got["layout"] == "prompt" and got["n"] == [4, BIG]


def test_a_skeleton_has_the_fingerprint_of_its_record(spark):
    records = [{"a": 'x"y\\', "b": {"c": ["t:", "", 1, None, True], "d:\"": "e"}}, {"turns": [{"role": "u", "text": '":'}]}, [], "only", {"k": [{"z": "1"}, {"z": 2}]}]
    df = spark.createDataFrame([(json.dumps(r, indent=i),) for r in records for i in (None, 1)] + [("not json",)], "r string")
    for row in df.select("r", chat.fingerprint(F.col("r")).alias("a"), chat.fingerprint(F.col("r"), 0).alias("b"), chat.skeleton(F.col("r")).alias("s")).collect():
        assert row["a"] == row["b"], row
