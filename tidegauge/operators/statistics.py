"""Paired statistics: average ranks, the signed-rank test, step-down adjustment, resampled intervals, verdicts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import cut
from ..sources import scenarios

#: Bytes of counts that are sent to every task that resamples; beyond, resamples are joined.
SENT = 64 << 20


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with the rank of each magnitude in its group, ties (within 1e-9, or 1e-12 in all) sharing their mean rank, and how many share it."""
    w = Window.partitionBy(*by).orderBy("_size", value)
    sized = rows.withColumn("_size", F.abs(F.col(value))).withColumn("_place", F.row_number().over(w)).withColumn("_last", F.lag("_size").over(w))
    apart = F.col("_last").isNull() | (F.col("_size") - F.col("_last") > F.greatest(1e-9 * F.col("_size"), F.lit(1e-12)))
    tied = sized.withColumn("_tie", F.sum(apart.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy(*by, "_tie")
    return tied.withColumn("rank", F.avg("_place").over(same)).withColumn("ties", F.count("*").over(same)).drop("_size", "_place", "_last", "_tie")


def signed_rank_p(n: int, low: float, ties: float) -> tuple[float, str]:
    """Two-sided p of the smaller rank sum: exact for up to 50 untied differences, else normal with corrections for ties and continuity."""
    if not n:
        return 1.0, "no_nonzero_differences"
    if not ties and n <= 50:
        step = lambda p, r: np.convolve(p, np.r_[0.5, np.zeros(r - 1), 0.5])
        chances = reduce(step, range(1, n + 1), np.ones(1))  # each rank is on either side with even chance
        return float(min(1.0, 2 * chances[: int(low) + 1].sum())), "exact"
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    far = max(0.0, n * (n + 1) / 4 - low - 0.5) / spread if spread else 0.0
    return min(1.0, math.erfc(far / math.sqrt(2))), "normal_approximation"


def signed_rank(rows: DataFrame, by: list[str], difference: str = "d") -> DataFrame:
    """A row per group: differences that are not 0, the rank sum of positive ones, p and how it was found."""
    some = rows.where(F.abs(F.col(difference)) > 1e-12)
    ranked = average_ranks(some, by, difference).groupBy(*by).agg(F.count("*").alias("wilcoxon_n_nonzero"), F.sum(F.when(F.col(difference) > 0, F.col("rank")).otherwise(0.0)).alias("wilcoxon_w_plus"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("_ties"))  # each of t tied rows adds t * t - 1
    full = rows.select(*by).distinct().join(ranked, by, "left").na.fill(0)

    @F.pandas_udf("p double, how string")
    def test(n: pd.Series, plus: pd.Series, ties: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signed_rank_p(int(a), min(b, a * (a + 1) / 2 - b), c) for a, b, c in zip(n, plus, ties)], columns=["p", "how"])

    return full.withColumn("_t", test("wilcoxon_n_nonzero", "wilcoxon_w_plus", "_ties")).select(*by, "wilcoxon_n_nonzero", "wilcoxon_w_plus", F.col("_t.p").alias("wilcoxon_p"), F.col("_t.how").alias("wilcoxon_method"))


def f1_of(tp, events, fp):
    """2 TP / (TP + FP + events), 0 without hits; for arrays."""
    return np.where(tp > 0, 2 * tp / np.maximum(tp + fp + events, 1), 0.0)


def resampled_f1(rows: DataFrame, groups: list[str], unit: str, resamples: int, seed: int, *key: int) -> DataFrame:
    """Rows (groups, rep, f1): pooled F1 of units drawn with replacement, the same draws for all groups. Rows are (groups, unit, tp, events, fp), each group holding all units."""
    spark, rows = rows.sparkSession, cut(rows.select(*groups, unit, "tp", "events", "fp"))
    size = rows.agg(F.count_distinct(unit).alias("n"), F.count_distinct(*groups).alias("many")).first()  # one row
    n, many = size["n"], size["many"]
    drawn = scenarios.draws(spark, n, resamples, seed, *key)
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    if n * many * 24 <= SENT:
        table = rows.select(*groups, unit, "tp", "events", "fp").toPandas().sort_values([*groups, unit])  # under SENT bytes
        names = table[groups].drop_duplicates().reset_index(drop=True)
        counts = table[["tp", "events", "fp"]].to_numpy(float).reshape(len(names), n, 3)

        def run(batches):
            for pdf in batches:
                times = np.stack([np.bincount(p, minlength=n) for p in pdf["places"]])
                sums = np.einsum("ru,guc->grc", times, counts)
                f1 = f1_of(sums[:, :, 0], sums[:, :, 1], sums[:, :, 2])
                yield pd.concat([names.loc[np.repeat(np.arange(len(names)), len(pdf))].reset_index(drop=True), pd.DataFrame({"rep": np.tile(pdf["rep"], len(names)), "f1": f1.ravel()})], axis=1)

        return drawn.mapInPandas(run, f"{kinds}, rep long, f1 double")
    place = rows.select(unit).distinct().withColumn("place", (F.row_number().over(Window.orderBy(unit)) - 1).cast("long"))
    each = drawn.select("rep", F.explode("places").alias("place")).groupBy("rep", "place").count()
    sums = each.join(place, "place").join(rows, unit).groupBy(*groups, "rep").agg(*(F.sum(F.col(c) * F.col("count")).alias(c) for c in ("tp", "events", "fp")))
    return sums.select(*groups, "rep", event_f1(F.col("tp"), F.col("events"), F.col("fp")).alias("f1"))


def event_f1(tp: Column, events: Column, fp: Column) -> Column:
    return F.when(tp > 0, ratio(2 * tp, tp + fp + events, 0.0)).otherwise(0.0)


def interval(rows: DataFrame, by: list[str], value: str, level: float, name: str) -> DataFrame:
    """The percentile interval of a value, in columns ``name``_low and ``name``_high."""
    tail = (1 - level) / 2
    return rows.groupBy(*by).agg(F.percentile(value, tail).alias(f"{name}_low"), F.percentile(value, 1 - tail).alias(f"{name}_high"))


def paired(f1: DataFrame, by: list[str], method: str, candidate: str, level: float) -> DataFrame:
    """Rows (by, baseline): the interval of the candidate's F1 less a baseline's over resamples, and the paired p."""
    own = f1.where(F.col(method) == candidate).select(*by, "rep", F.col("f1").alias("_own"))
    d = f1.where(F.col(method) != candidate).join(own, [*by, "rep"]).withColumn("d", F.col("_own") - F.col("f1")).withColumnRenamed(method, "baseline")
    share = lambda c: F.avg(c.cast("double"))
    p = d.groupBy(*by, "baseline").agg(F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("paired_bootstrap_p"))
    return interval(d, [*by, "baseline"], "d", level, "delta_ci").join(p, [*by, "baseline"])


def verdict(adjusted: Column, low: Column, high: Column, level: float) -> Column:
    sure = adjusted < level
    return F.when(sure & (low > 0), "better").when(sure & (high < 0), "worse").otherwise("no significant difference")
