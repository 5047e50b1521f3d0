"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ivfpq import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import score

    return score(table(spark, sf_dir, "documents"), order=3, folds=7, held_out=2)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"), length=50)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_windows, read_back

    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(rows, budget=1024, history=256))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
