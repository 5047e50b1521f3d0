"""A corpus pipeline of four of the library's operators: toxicity, n-gram Jaccard join, suffix-array dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), and its result, written as
Parquet and read again, is the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import jaccard, packing, store, suffix, toxicity

#: A document with this score or more is rejected.
TOXIC = 0.5


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, by models of all labels, is under ``TOXIC``.

    Null texts count as empty, repeated rows and rows with a null doc_id are judged each, all columns stay as they are; an empty table, or
    one without labels, loses none: all scores are 0.5 then, and such rows stay.
    """
    models = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    kept = toxicity.scored(docs, models, name)
    return kept.where((F.col(name) < TOXIC) | F.lit(not models.curve.any())).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by 5-word shingles at 0.8.

    Rows that repeat one doc_id and text count as one; rows with a null doc_id stay.
    """
    return jaccard.first_of_each(docs, k=5, percent=80)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 50-byte strings of smaller doc_ids cover; n_chars follows the text. None is dropped."""
    return suffix.dedup_text(docs, length=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows and null doc_ids are documents like others; other columns are ignored; an empty
    table gives no rows.
    """
    return packing.pack(docs, capacity=1024)


STAGES = [("toxicity", ordinary), ("n-gram Jaccard join", distinct), ("suffix-array dedup", unrepeated), ("packing", packed)]

#: SQL can express neither the models' training, nor suffix arrays, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = store.saved(stage(spark, docs, sf_dir), folder, f"stage{i}")
    return docs
