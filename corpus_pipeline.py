"""The corpus pipeline: stages applied to documents in order, each written and read again.

Language ID rejects what is in no known language, exact and near dedup keep one document of each group, mixing drops or
repeats documents towards target shares of tokens, and packing lays the rest out in sequences. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import exact_dedup as exact
from framelake.llm import language_id as language
from framelake.llm import mixing, packing
from framelake.llm import near_dedup as near
from framelake.llm.common import materialize, table, without_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no known language go; the source serves as host. lang teaches the model and is no evidence."""
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), none.alias("declared"), none.alias("named"))
    found = language.identify(rows, language.fit(docs), ["doc_id"])
    return without_ids(docs, "doc_id", found.filter(~F.col("kept")).select("doc_id"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8) the one with the smallest doc_id stays."""
    found = near.near_duplicates(docs, shingle_words=5, percent=80)
    return without_ids(docs, "doc_id", found.filter(~F.col("kept")).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their fitted rate says."""
    return mixing.take(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact), ("near dedup", drop_near), ("source mixing", mix_sources), ("best-fit packing", pack_sequences)]

#: Several stages learn, estimate or pack; SQL can't express them. tests/llm/test_models.py holds its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
