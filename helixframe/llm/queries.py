"""Registered queries of the operators in this subpackage, over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file: HELIXFRAME_TOKENIZERS names its folder, else the installed package does."""
    if folder := os.environ.get("HELIXFRAME_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.pii import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.exact_dedup import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{probe}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{probe}'")
    done = chat.format_records(chat.from_rows(rows.unionByName(extra)))
    read = done.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\[/?INST\]'))
    + len(regexp_extract_all(text, '<</?(?:SYS|ROLE)>>')) + len(regexp_extract_all(text, '<<TEXT>>')) AS escaped,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 0 ELSE 29 + length(role) END AS around
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + around + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.topk import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_file())


#: Kinds of toxic text that the chain predicts before toxicity itself: clusters of the toxic training rows.
KINDS = 3


def _toxicity_chain(spark: SparkSession, sf_dir: str):
    from helixframe.llm.toxicity import fit

    return fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["toxic"], KINDS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _toxicity_chain(spark, sf_dir))


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without what the chain, fitted on the labelled documents of ``sf_dir``, rejects."""
    from helixframe.llm.toxicity import keep_clean

    return keep_clean(docs, _toxicity_chain(spark, sf_dir))


#: Mixing in production: half way from the entropy as found to the uniform one, and no source over four times.
MIXTURE = {"entropy_share": 0.5, "max_epochs": 4.0}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, **MIXTURE).select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block_key").alias("block_key"), F.col("__key").alias("place_key"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    from helixframe.llm.mixing import mix

    return mix(docs, places=False, **MIXTURE)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.ngram_join import join

    return join(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_topk": op9_topk,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_topk": OP9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
