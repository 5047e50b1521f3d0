"""Calibration to equal false-positive rates, matching of alarms to events, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import prf, rate, ratio, wilson
from ..functions.quantiles import top


def cuts(maxima: DataFrame, by: list[str], target: float, score: str = "top") -> DataFrame:
    """Per group the value that alarms must exceed: the (floor(target * n + 1e-9) + 1)-th largest, the last at most."""
    at = F.least(F.floor(target * F.col("_n") + 1e-9), F.col("_n") - 1) + 1
    return top(maxima.select(*by, score), by, score, target).where(F.col("_place") == at).select(*by, F.col(score).alias("cut"))


def regime_summary(units: DataFrame, by: list[str]) -> DataFrame:
    """Alarm rate with its Wilson interval, exact rate, mean IoU, and mean, least and largest top score."""
    hit = F.col("n_detected") > 0
    low, high = wilson(F.col("alarms"), F.col("n"))
    out = units.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("alarms"), rate(hit).alias("alarm_rate"), rate(F.col("exact")).alias("exact_rate"), F.avg("iou").alias("mean_iou"), F.avg("top").alias("mean_top"), F.min("top").alias("min_top"), F.max("top").alias("max_top"))
    return out.withColumns({"alarm_low": low, "alarm_high": high})


def matches(spans: DataFrame, events: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """Runs and events that overlap, joined by the buckets of ``width`` steps that they touch; a pair is taken in the first bucket that both touch."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("_bucket")
    r = spans.withColumnRenamed("start", "run_start").withColumnRenamed("end", "run_end")
    both = r.select("*", bucket("run_start", "run_end")).join(events.select("*", bucket("start", "end")), [*by, "_bucket"])
    first = F.floor(F.greatest("run_start", "start") / width)
    return both.where((F.col("run_start") <= F.col("end")) & (F.col("run_end") >= F.col("start")) & (F.col("_bucket") == first)).drop("_bucket")


def channel_metrics(spans: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Per channel: events, events hit, false runs, duplicate hits, summed latency of the first hit."""
    pairs = matches(spans, events, by).select(*by, "start", "run_start")
    late = F.greatest(F.col("run_start") - F.col("start"), F.lit(0))
    # Pairs, events and runs in one table, so that a channel's sums are one shuffle: an event's rows first add up, as a run's do.
    event = pairs.select(*by, "start", F.lit(1).alias("n"), late.alias("latency"), F.lit(0).alias("e")).unionByName(events.select(*by, "start", F.lit(0).alias("n"), F.lit(None).cast("long").alias("latency"), F.lit(1).alias("e")))
    event = event.groupBy(*by, "start").agg(F.sum("n").alias("n"), F.min("latency").alias("latency"), F.sum("e").alias("e")).select(*by, "n", "latency", "e", F.lit(0).alias("f"))
    run = pairs.select(*by, F.col("run_start").alias("start"), F.lit(1).alias("n")).unionByName(spans.select(*by, "start", F.lit(0).alias("n"))).groupBy(*by, "start").agg(F.sum("n").alias("n"))
    run = run.select(*by, F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("latency"), F.lit(0).cast("long").alias("e"), (F.col("n") == 0).cast("int").alias("f"))
    hit = F.col("n") > 0
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    out = event.unionByName(run).groupBy(*by).agg(F.sum("e").alias("events"), F.count_if(hit).alias("tp"), zero(F.sum(F.when(hit, F.col("n") - 1))).alias("duplicates"), zero(F.sum("latency")).alias("latency"), F.sum("f").alias("fp"))
    return out.where("events > 0").withColumn("fn", F.col("events") - F.col("tp"))


def pooled(channels: DataFrame, sets: list[str]) -> DataFrame:
    """Counts summed first, then precision, recall and F1, for each of ``sets`` and over all."""
    out = channels.groupingSets([[F.col(c) for c in sets], []], *sets).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1})


def robustness(rows: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    """Change of a rate against its clean reference; worse or better only if the intervals are disjoint."""
    r, c = rows, clean.select(*by, *(F.col(x).alias(f"ref_{x}") for x in ("alarm_rate", "alarm_low", "alarm_high")))
    change = F.when(F.col("alarm_low") > F.col("ref_alarm_high"), "higher").when(F.col("alarm_high") < F.col("ref_alarm_low"), "lower").otherwise("n.s.")
    return r.join(c, by, "left").withColumns({"inflation": F.col("alarm_rate") - F.col("ref_alarm_rate"), "retention": ratio(F.col("alarm_rate"), F.col("ref_alarm_rate")), "change": change})


def holm(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Step-down adjusted p-values."""
    w = Window.partitionBy(*by).orderBy(p, "name")
    m = F.count("*").over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return rows.withColumn("raw", raw).withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def pot_threshold(scores: DataFrame, by: list[str], initial: float = 0.98, risk: float = 1e-3, least: int = 10) -> DataFrame:
    """Peaks-over-threshold by moments of the excesses; the empirical quantile where they are too few or flat.

    Shape .5 (1 - mean^2 / variance), within .45 of 0; scale mean (1 - shape); a negative shape caps the threshold at its end point.
    """
    base = scores.groupBy(*by).agg(F.percentile("score", initial).alias("u"), F.percentile("score", 1 - risk).alias("empirical"), F.count("*").alias("n"))
    over = scores.join(base, by).where(F.col("score") > F.col("u")).groupBy(*by).agg(F.count("*").alias("k"), F.avg(F.col("score") - F.col("u")).alias("mean"), F.var_pop(F.col("score") - F.col("u")).alias("var"))
    out = base.join(over, by, "left")
    shape = F.when(F.col("var") <= 1e-18, 0.0).otherwise(F.greatest(F.lit(-0.45), F.least(F.lit(0.45), 0.5 * (1 - F.col("mean") * F.col("mean") / F.col("var")))))
    out = out.withColumn("shape", shape).withColumn("scale", F.col("mean") * (1 - F.col("shape")))
    log = F.ln(F.col("k") / F.col("n") / risk)
    t = F.col("u") + F.when(F.abs("shape") < 1e-6, F.col("scale") * log).otherwise(F.col("scale") * F.expm1(F.col("shape") * log) / F.col("shape"))
    t = F.when(F.col("shape") < 0, F.least(t, F.col("u") - F.col("scale") / F.col("shape"))).otherwise(t)
    return out.withColumn("threshold", F.greatest(F.col("u"), F.when(F.coalesce(F.col("k"), F.lit(0)) < least, F.col("empirical")).otherwise(t)))
