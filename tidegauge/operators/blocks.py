"""Cross-sectional scoring: frames to cells, cells to block statistics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BLEND, huber, median
from ..functions.quantiles import quantile


def cells(frames: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """One row (keys, channel, block, x) per channel of an array column; NaN becomes null, blocks hold ``size`` channels."""
    out = frames.select(*keys, F.posexplode(vector).alias("channel", "x"))
    return out.select(*keys, F.col("channel").cast("long").alias("channel"), F.expr(f"cast(channel div {size} as long)").alias("block"), F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")).alias("x"))


def block_range(start, stop, size: int):
    """Blocks that the channels [start, stop) touch, as an array column."""
    return F.sequence(F.floor(start / size).cast("long"), F.floor((stop - 1) / size).cast("long"))


def block_stats(cell: DataFrame, keys: list[str]) -> DataFrame:
    """Count, peak, RMS, mean absolute value and mean of the observed channels of each block; 0 where none is."""
    x, zero = F.col("x"), F.lit(0.0)
    return cell.groupBy(*keys, "block").agg(
        F.count(x).alias("observed"),
        F.coalesce(F.max(F.abs(x)), zero).alias("peak"),
        F.coalesce(F.sqrt(F.avg(x * x)), zero).alias("rms"),
        F.coalesce(F.avg(F.abs(x)), zero).alias("mean_abs"),
        F.coalesce(F.avg(x), zero).alias("mean"),
    )


def array_stats(rows: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """As ``block_stats`` of an array column, a row per block, without exploding channels or shuffling: each block is folded where its row lies.

    NaN and null channels are missing. Sums run in the order of the channels.
    """

    def fold(b):
        part = F.filter(F.transform(F.slice(vector, b * size + 1, size), lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))), lambda x: x.isNotNull())
        n = F.size(part)
        mean = lambda f: F.when(n > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + f(x)) / n).otherwise(0.0)
        return F.struct(b.cast("long").alias("block"), n.cast("long").alias("observed"), F.coalesce(F.array_max(F.transform(part, F.abs)), F.lit(0.0)).alias("peak"), F.sqrt(mean(lambda x: x * x)).alias("rms"), mean(F.abs).alias("mean_abs"), mean(lambda x: x).alias("mean"))

    blocks = F.sequence(F.lit(0), F.floor(F.size(vector) / size).cast("int") - 1)
    return rows.select(*keys, F.explode(F.transform(blocks, fold)).alias("_b")).select(*keys, "_b.*")


def blended(stats: DataFrame) -> DataFrame:
    """Block score: weighted peak, RMS and mean absolute value."""
    return stats.withColumn("score", BLEND[0] * F.col("peak") + BLEND[1] * F.col("rms") + BLEND[2] * F.col("mean_abs"))


def centre_and_scale(rows: DataFrame, by: list[str], value: str, floor: float = 1e-9) -> DataFrame:
    """Exact median and 1.4826 * MAD of each group."""
    rows = rows.select(*by, value)
    centre = quantile(rows, by, value, 0.5, "centre")
    far = quantile(rows.join(centre, by).select(*by, F.abs(F.col(value) - F.col("centre")).alias("_far")), by, "_far", 0.5, "scale")
    return centre.join(far, by).select(*by, "centre", F.greatest(1.4826 * F.col("scale"), F.lit(floor)).alias("scale"))


def robust_z(stats: DataFrame, fit: DataFrame, statistic: str = "rms") -> DataFrame:
    """Distance of a block statistic from its baseline over ``fit``, in scaled MADs."""
    base = centre_and_scale(fit, ["block"], statistic)
    return stats.join(F.broadcast(base), "block").withColumn("score", F.abs(F.col(statistic) - F.col("centre")) / F.col("scale"))


def robust_blocks(cell: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Blend of the 4 largest, the Huber mean and the median of channel residuals; null channels are left out, an empty block scores 0."""
    base = centre_and_scale(fit.where("x is not null"), ["channel"], "x")
    r = cell.join(F.broadcast(base), "channel").withColumn("r", F.abs(F.col("x") - F.col("centre")) / F.col("scale"))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(F.desc_nulls_last("r"), "channel")))
    agg = r.groupBy(*keys, "block").agg(F.sum(F.when(F.col("place") <= 4, F.col("r"))).alias("top"), F.count("r").alias("n"), F.avg(huber(F.col("r"))).alias("h"), median(F.col("r")).alias("m"))
    return agg.withColumn("score", F.coalesce(BLEND[0] * F.col("top") / F.least("n", F.lit(4)) + BLEND[1] * F.sqrt("h") + BLEND[2] * F.col("m"), F.lit(0.0))).select(*keys, "block", "score")


def distance_to_truth(marks: DataFrame, unit: str) -> DataFrame:
    """Per unit the smallest distance, in blocks, of a detected block to a true one; null without either."""
    before = Window.partitionBy(unit).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(unit).orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    true = F.when(F.col("truth"), F.col("block"))
    near = F.least(F.col("block") - F.last(true, True).over(before), F.first(true, True).over(after) - F.col("block"))
    return marks.withColumn("near", near).groupBy(unit).agg(F.min(F.when(F.col("detected"), F.col("near"))).alias("distance"))


def frame_eval(marks: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit: hits, union, IoU (1 where both sets are empty), counts, exact match, extra blocks."""
    d, t = F.col("detected"), F.col("truth")
    out = marks.groupBy(*unit).agg(F.count_if(d & t).alias("hits"), F.count_if(d | t).alias("union"), F.count_if(d).alias("n_detected"), F.count_if(t).alias("n_true"), F.count_if(d & ~t).alias("extra"), F.max("score").alias("top"))
    return out.withColumns({"iou": F.when(F.col("union") == 0, 1.0).otherwise(F.col("hits").cast("double") / F.greatest("union", F.lit(1))), "exact": (F.col("hits") == F.col("union"))})
