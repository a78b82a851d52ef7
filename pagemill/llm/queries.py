"""The operators as queries with their contracts' columns, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.oracles import ORACLES

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: `labels` of the same number as the page; low quality or toxic counts as bad."""
    from pagemill.llm.url_reputation import filter_urls

    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(_read(spark, sf_dir, "pages"), outcomes, RULES)


def op3_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.decontaminate import contamination

    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.chat import digests, format_conversations, load_tokenizer

    tricky = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    tokenizer = load_tokenizer(spark)
    return digests(format_conversations(rows, tokenizer), tokenizer)


def op5_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.language import held_out
    from pagemill.llm.toxicity import learn, score

    documents = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    net = learn(documents, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(documents, net).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.permutation import nearest

    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.language import classify, held_out, learn

    documents = _read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = learn(documents.where(~out))
    return classify(documents, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.simhash import fingerprint_hex, near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.suffix import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
