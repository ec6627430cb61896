"""A training-corpus pipeline over the table ``documents``.

Stages, each over all that the one before kept: toxic documents go; one document of
each group of near copies stays; documents that hold benchmark items go; the rest is
packed into sequences (pieces hold their token ids).

Decisions name documents by their texts, or by id and text, so rows with a null or
repeated doc_id are judged like others, each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.llm import decontaminate, jaccard_join, packing, toxicity
from lumenshelf.llm.common import cut, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.near_duplicates(docs)).select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # whether a text holds an item depends on the text alone
    keyed = docs.withColumn("_text", F.md5("text"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_text")
    bad = cut(found.select(F.col("doc_id").alias("_text")).distinct(), "contaminated-texts")
    return keyed.join(bad, "_text", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("decontaminate", remove_benchmark),
    ("packing", pack),
]
#: Learned scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
