"""Exact quantiles and ranks of large groups, without a buffer or a sort of a whole group in one task.

A sketch bounds where the ranks asked for lie; only values between the bounds are ordered, and those below counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a plan's rows, by Spark's estimate, up to which a quantile is simply aggregated; the sketch's accuracy.
PLAIN, ACCURACY = 256 << 20, 2000


def small(rows: DataFrame) -> bool:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= PLAIN


def quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """Rows (by, name): the exact quantile of each group's values, linear between ranks; null values are left out."""
    if small(rows):
        return rows.groupBy(*by).agg(F.percentile(value, q).alias(name))
    known = rows.where(F.col(value).isNotNull())
    e = 4 / ACCURACY
    near = known.groupBy(*by).agg(F.percentile_approx(value, F.array(F.lit(max(0.0, q - e)), F.lit(min(1.0, q + e))), ACCURACY).alias("_b"), F.count("*").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    few = F.col("_n") <= ACCURACY  # the sketch's error is a rank or more there
    low = F.when(few | F.lit(q - e <= 0), F.col("_min")).otherwise(F.col("_b")[0])
    high = F.when(few | F.lit(q + e >= 1), F.col("_max")).otherwise(F.col("_b")[1])
    both = known.join(near.withColumns({"_low": low, "_high": high}).drop("_b", "_min", "_max"), by)
    below = both.groupBy(*by).agg(F.count_if(F.col(value) < F.col("_low")).alias("_below"))
    inside = both.where(F.col(value).between(F.col("_low"), F.col("_high"))).join(below, by)
    at = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1 + F.col("_below")).withColumn("_p", (F.col("_n") - 1) * F.lit(float(q)))
    a, b = F.floor("_p"), F.ceil("_p")
    pick = at.where((F.col("_r") == a) | (F.col("_r") == b)).groupBy(*by).agg(F.min(value).alias("_x"), F.max(value).alias("_y"), F.first(F.col("_p") - a).alias("_f"))
    return pick.select(*by, (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_f")).alias(name))


def top(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """``rows`` with ``_n``, the size of their group, and ``_place``, their rank from the largest (1); at least those of the largest ``share`` of a group are there."""
    if small(rows):
        w = Window.partitionBy(*by)
        return rows.withColumn("_n", F.count("*").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc(value))))
    q = 1 - share - 4 / ACCURACY
    near = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.when(F.count("*") <= ACCURACY, F.min(value)).otherwise(F.percentile_approx(value, q, ACCURACY) if q > 0 else F.min(value)).alias("_low"))
    some = rows.join(near, by).where(F.col(value) >= F.col("_low")).drop("_low")
    return some.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value))))
