"""Outcomes per stream, per sample and per event; ranking of configurations; paired statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import prf


def stream_outcomes(marks: DataFrame, stream: str, warmup: int) -> DataFrame:
    """Rows per stream from (stream, step, block, alarm, truth, onset): any and early alarms, hit, latency, exactness and IoU.

    Latency counts alarms on true blocks from the onset on; exactness and IoU use the first step from the onset with any
    alarm. A null onset marks a clean stream, of which every step counts as after it.
    """
    a = F.col("alarm") & (F.col("step") >= warmup)
    after = F.coalesce(F.col("step") >= F.col("onset"), F.lit(True))
    step = marks.groupBy(stream, "step").agg(F.first("onset").alias("onset"), F.bool_or(a).alias("any"), F.bool_or(a & F.col("truth")).alias("true"), F.count_if(a & F.col("truth")).alias("both"), F.count_if(a | F.col("truth")).alias("either"))
    first = F.struct("step", "both", "either")
    out = step.groupBy(stream).agg(
        F.first("onset").alias("onset"),
        F.bool_or("any").alias("any_alarm"),
        F.bool_or(F.col("any") & (F.col("step") < F.col("onset"))).alias("pre_alarm"),
        F.min(F.when(F.col("true") & after, F.col("step"))).alias("true_step"),
        F.min(F.when(F.col("any") & after, first)).alias("f"),
    )
    return out.select(stream, "any_alarm", F.coalesce("pre_alarm", F.lit(False)).alias("pre_alarm"), F.col("true_step").isNotNull().alias("hit"), (F.col("true_step") - F.col("onset")).alias("latency"), F.coalesce(F.col("f.both") == F.col("f.either"), F.lit(False)).alias("exact"), F.coalesce(F.col("f.both") / F.col("f.either"), F.lit(0.0)).alias("iou"))


def point_metrics(rows: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Counts of samples, and point-adjusted ones, where a touched event counts whole; rows (by, t, alarm)."""
    points = events.select(*by, "start", F.explode(F.sequence("start", "end")).alias("t"))
    sums = rows.select(*by, "t", "alarm").join(points, [*by, "t"], "left").groupBy(*by, "start").agg(F.count_if("alarm").alias("a"), F.count("*").alias("n"))  # a row for each event, one for all other samples
    own = F.col("start").isNotNull()
    add = lambda flag, c: F.coalesce(F.sum(F.when(flag, c)), F.lit(0)).alias
    quiet = F.col("n") - F.col("a")
    out = sums.groupBy(*by).agg(F.sum("n").alias("n"), add(own, F.col("a"))("tp"), add(~own, F.col("a"))("fp"), add(own, quiet)("fn"), add(own & (F.col("a") > 0), F.col("n"))("pa_tp"), add(own & (F.col("a") == 0), F.col("n"))("pa_fn"), F.count("start").alias("_events"))
    return out.where("_events > 0").drop("_events")


def ranked(trials: DataFrame, keep: int) -> DataFrame:
    """Trials by F1 to 3 places, then fewer settings, higher precision, higher macro F1, fewer false runs, id; the first ``keep``. Runtimes, which differ by run, do not count."""
    place = F.row_number().over(Window.orderBy(F.round("f1", 3).desc(), "complexity", F.col("precision").desc(), F.col("macro_f1").desc(), "fp", "trial"))  # over trials
    return trials.withColumn("place", place.cast("long")).where(F.col("place") <= keep)


def trials(rows: DataFrame, events: DataFrame, grid: list[tuple[int, float, int]]) -> DataFrame:
    """Pooled metrics of each configuration (id, threshold, least run length): one program over scores x grid."""
    from .evaluation import channel_metrics
    from .sequences import runs

    options = F.explode(F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(t).alias("threshold"), F.lit(n).alias("least")) for i, t, n in grid))).alias("o")
    spans = runs(rows.select("channel", "t", "score", options).select("channel", "t", "score", "o.*").withColumn("alarm", F.col("score") >= F.col("threshold")), ["trial", "least", "channel"])
    spans = spans.where(F.col("end") - F.col("start") + 1 >= F.col("least")).select("trial", "channel", "start", "end")
    every = events.select("channel", "start", "end", "class", F.explode(F.array(*(F.lit(i) for i, _, _ in grid))).alias("trial"))
    each = channel_metrics(spans, every, ["trial", "channel"])
    m = each.groupBy("trial").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]).alias("macro_f1"))
    cost = F.create_map(*(F.lit(x) for i, t, n in grid for x in (i, int(t != grid[0][1]) + int(n != grid[0][2]))))
    p, _, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return m.withColumns({"precision": p, "f1": f1, "complexity": cost[F.col("trial")]})


def bootstrap(channels: DataFrame, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile interval of pooled F1 over channels drawn with replacement, by keyed draws that tasks make."""
    from .statistics import resampled_f1

    rows = channels.select(F.lit("all").alias("group"), "channel", "tp", (F.col("tp") + F.col("fn")).alias("events"), "fp")
    return resampled_f1(rows, ["group"], "channel", draws, seed).agg(F.percentile("f1", 0.025).alias("low"), F.percentile("f1", 0.975).alias("high"))


def pca_residuals(rows: DataFrame, lags: int = 16, share: float = 0.9, most: int = 8) -> DataFrame:
    """Distance of each lag window from the leading components of its channel's training windows; rows (channel, t, z, split)."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        z = np.clip(pdf["z"].to_numpy(), -10, 10)
        w = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(lags - 1, z[0]), z], lags)
        train = w[(pdf["split"] == "train").to_numpy()]
        if not len(train):
            return pd.DataFrame({"channel": pdf["channel"], "t": pdf["t"], "score": 0.0})
        centre = train.mean(0)
        _, s, v = np.linalg.svd(train - centre, full_matrices=False)
        part = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        v = v[: min(most, int(np.searchsorted(part, share)) + 1)]
        rest = w - centre
        return pd.DataFrame({"channel": pdf["channel"], "t": pdf["t"], "score": np.linalg.norm(rest - rest @ v.T @ v, axis=1)})

    return rows.groupBy("channel").applyInPandas(fit, "channel string, t long, score double")
