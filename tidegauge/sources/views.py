"""Views that present generic tables as the engine's data model: frames, streams, series, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 8 blocks of 8 channels; the label is the regime."""
    return cells(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "embedding", 8)


def burst_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame has 0.5 added on one block, which is its truth."""
    truth = (F.col("vec_id") % 3 == 0) & (F.col("block") == F.col("vec_id") % 8)
    return frame_cells(spark, sf_dir).withColumn("truth", truth).withColumn("x", F.col("x") + F.when(F.col("truth"), 0.5).otherwise(0.0))


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the cells is missing, by a fixed rule."""
    return frame_cells(spark, sf_dir).withColumn("x", F.when((F.col("vec_id") * 31 + F.col("channel") * 17) % 10 != 0, F.col("x")))


def user_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a stream of one block."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", step.cast("long").alias("step"), F.col("value").alias("x"))


def type_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten streams of daily sums with a block for each event type, up to the last day; days without events are missing. ``observed`` is the number of events, 4 at most."""
    e = table(spark, sf_dir, "events")
    got = e.groupBy((F.col("user_id") % 10).alias("stream"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step"), F.col("event_type").alias("block")).agg(F.sum("value").alias("x"), F.least(F.count("*"), F.lit(4)).alias("observed"))
    last = got.agg(F.max("step").alias("last"))
    grid = got.select("stream").distinct().join(got.select("block").distinct()).join(F.broadcast(last)).select("stream", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("step"))  # ten streams by five types
    return grid.join(got, ["stream", "step", "block"], "left").na.fill(0, ["observed"])


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals of each priority as univariate series; the years before 1999 are the training split."""
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("channel"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    t = F.row_number().over(Window.partitionBy("channel").orderBy("day")) - 1
    return day.select("channel", t.cast("long").alias("t"), "x", F.when(F.col("day") < F.lit("1999-01-01").cast("date"), "train").otherwise("test").alias("split"))


def truth_windows(series: DataFrame) -> DataFrame:
    """Labelled windows [100 k + 50, 100 k + 69] inside each channel."""
    last = series.groupBy("channel").agg(F.max("t").alias("last")).where("last >= 69")
    return last.select("channel", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 69) / 100).cast("int"))).alias("k")).select("channel", (F.col("k") * 100 + 50).cast("long").alias("start"), (F.col("k") * 100 + 69).cast("long").alias("end"), F.when(F.col("k") % 2 == 0, "point").otherwise("contextual").alias("class"))


def scored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series standardised by their training split, 3 added inside truth windows; the score is abs(z)."""
    s = daily_series(spark, sf_dir)
    base = s.where("split = 'train'").groupBy("channel").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_samp("x"), F.lit(1e-9)).alias("sd"))
    inside = (F.col("t") >= 50) & ((F.col("t") - 50) % 100 <= 19)
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    return s.join(F.broadcast(base), "channel").withColumn("z", z).withColumn("score", F.abs(z + F.when(inside, 3.0).otherwise(0.0)))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one recording, a frame each: the regime is the day's parity, the errors of six hours are one event, its block follows from the user."""
    from ..functions.lineage import cut
    from .files import numbered

    e = numbered(cut(table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value", "user_id").orderBy("ts", "event_id")), "line")  # in order, but over many partitions
    error, hours = F.col("event_type") == "error", F.concat(F.date_format("ts", "yyyy-MM-dd-"), F.floor(F.hour("ts") / 6).cast("string"))
    blocks = F.when(error, F.array(F.col("user_id") % 8)).otherwise(F.array().cast("array<bigint>"))
    return e.select("line", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("x"), "user_id", F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd").alias("regime"), F.when(error, hours).alias("event_id"), blocks.alias("affected_blocks"))
