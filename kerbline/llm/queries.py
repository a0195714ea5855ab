"""One query for each operator, over its whole table, and what DuckDB can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import ann, chat, line_dedup, lm, mixing, packing, quality, secrets, simhash, substring

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(_docs(spark, sf_dir))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes.select("doc_id", shown.alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(own)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_docs(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_docs(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_substring": op8_substring,
    "op9_packing": op9_packing,
    "op10_lm": op10_lm,
}
