"""A training corpus from ``documents``: rules, near duplicates, secrets, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.mixing import mixed_documents
from loglathe.llm.near_dedup import near_duplicates
from loglathe.llm.packing import pack_documents
from loglathe.llm.quality import scored
from loglathe.llm.queries import TOKENIZER
from loglathe.llm.secrets import redacted
from loglathe.llm.tables import Tables, set_apart


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed, back = set_apart(docs, ("doc_id", "text"))
    return back(scored(packed, labels.where("quality = 1")).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with the smallest id, equal texts of one id once.

    Rows that share an id but not a text are one document: they stay or go together.  Rows without an id all stay.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    packed, back = set_apart(docs, ("doc_id", "text"))
    named = packed.join(kept, "doc_id", "left_semi").withColumn("text_key", F.xxhash64("text"))
    return back(named.dropDuplicates(["doc_id", "text_key"]).drop("text_key").unionByName(packed.where("doc_id IS NULL")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each pass over a document, what the pass takes of it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts and their places in sequences."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Signatures, keyed permutations and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's result written and read again; the last one's is returned."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
