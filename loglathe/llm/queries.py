"""The registered query of each operator: reads whole tables, with the parameters that the result is defined by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import (
    byte_bpe,
    chunk_dedup,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    pseudonyms,
    quality,
    repeats,
    retrieval,
    secrets,
    toxicity,
    whitening,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Stands for the secret that a deployment supplies.
PSEUDONYM_KEY = "example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def scored_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 3 = 1"), F.lit(False))
    scores = toxicity.toxicity(docs, toxicity.learn(docs, labels, ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _removal(done: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    return done.select(
        "doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        "kept",
    )


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removal(repeats.without_repeats(_table(spark, sf_dir, "documents"))).drop("kept")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removal(chunk_dedup.without_repeats(_table(spark, sf_dir, "documents"))).withColumnRenamed("kept", "text")


def with_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymized(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return done.select("doc_id", "text", *(f"n_{k}" for k in pseudonyms.KINDS))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    done = quality.scored(docs, labels.where("quality = 1"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = retrieval.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return retrieval.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in secrets.KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))),
        ",",
    )


def found_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.secret_spans(_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [_count(k, name) for k, name in enumerate(secrets.KINDS[:3])]
    return done.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def _count(kind: int, name: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{name}")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.recode(docs, BYTE_TOKENIZER, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return done.withColumn("deviation", F.col("deviation").cast("long")).withColumnRenamed("id", "vec_id")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_duplicates,
    "op2_toxicity": scored_toxicity,
    "op3_mixing": mixed,
    "op4_suffix_dedup": without_repeats,
    "op5_packing": packed,
    "op6_chunk_dedup": without_chunks,
    "op7_pseudonyms": with_pseudonyms,
    "op8_quality": judged,
    "op9_top_k": top_five,
    "op10_secrets": found_secrets,
    "op11_byte_bpe": coded,
    "op12_prefix_trie": conversation_nodes,
    "op13_whitening": whitened,
}
