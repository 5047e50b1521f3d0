"""Univariate series judged on labelled windows: methods scored alike, thresholds from training samples alone, pooled metrics and statistics.

Series are rows (dataset, channel, split, t, x), t counting from 0 in each split; events are inclusive windows (dataset,
channel, start, end, class) of the test split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BLEND, prf, ratio
from ..functions.lineage import cut
from ..functions.quantiles import top
from ..settings import Evaluation
from . import evaluation, scorecard, sequences, statistics

KEY = ["dataset", "channel"]


def standard(series: DataFrame) -> DataFrame:
    """Adds z by the training split's mean and deviation (1e-9 at least), and whether that split is constant."""
    base = series.where("split = 'train'").groupBy(*KEY).agg(F.avg("x").alias("_m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-9)).alias("_s"), (F.min("x") == F.max("x")).alias("constant_train"))
    return series.join(base, KEY).withColumn("z", (F.col("x") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def method_scores(rows: DataFrame, e: Evaluation) -> DataFrame:
    """Rows (dataset, channel, split, constant_train, t, method, score); every split starts anew."""
    by = [*KEY, "split"]
    w, z = sequences.trailing(by, e.window), F.col("z")
    peak = F.max(F.abs(z)).over(w)
    out = {"blend": BLEND[0] * peak + BLEND[1] * F.sqrt(F.avg(z * z).over(w)) + BLEND[2] * F.avg(F.abs(z)).over(w), "peak": peak, "zscore": F.abs(z)}
    wide = rows.withColumns({m: out[m] for m in e.methods if m in out})
    if "cusum" in e.methods:
        wide = sequences.cusum(wide.withColumns({"step": F.col("t"), "live": F.lit(True)}), by, e.k).drop("step", "live", "up", "down", "p_up", "p_down")
    if "ewma" in e.methods:
        wide = sequences.ewma(wide.withColumn("step", F.col("t")), by, e.lam).drop("step")
    return wide.select(*by, "constant_train", "t", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in e.methods))).alias("_m")).select(*by, "constant_train", "t", "_m.*")


def thresholds(scores: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """Rows (dataset, channel, method, target_fp, threshold, n_train, train_alarm_rate): for all targets by one ranking of each channel's training scores."""
    by = [*KEY, "method"]
    train = scores.where("split = 'train'")
    ranked = top(train.select(*by, "score"), by, "score", max(targets)).withColumnRenamed("_n", "n_train").withColumn("_place", F.col("_place") - 1)
    asked = F.explode(F.array(*(F.struct(F.lit(t).alias("target_fp"), F.least(F.floor(t * F.col("n_train") + 1e-9), F.col("n_train") - 1).alias("allowed")) for t in targets))).alias("_a")
    limits = ranked.select(*by, "n_train", "score", "_place", asked).where("_place = _a.allowed").select(*by, "n_train", "_a.target_fp", scorecard.next_above(F.col("score")).alias("threshold"))
    reached = train.join(limits, by).groupBy(*by, "target_fp").agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("train_alarm_rate"))
    return limits.join(reached, [*by, "target_fp"])


def points(events: DataFrame, by: list[str] = KEY) -> DataFrame:
    """A row for each sample of each window: what a range join would find, but joined by equality."""
    return events.select(*by, "start", "end", "class", F.explode(F.sequence("start", "end")).alias("t"))


def channel_metrics(alarms: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by) from samples (dataset, channel, by, t, alarm): events hit and missed, runs that touch no window, and counts of samples, adjusted by event too.

    One pass joins the samples to the windows' points; hits, runs and samples are three sums over it.
    """
    rows = alarms.join(points(events).select(*KEY, "t", F.col("start").alias("event"), "class"), [*KEY, "t"], "left")
    hit = rows.where("event is not null").groupBy(*by, "event", "class").agg(F.bool_or("alarm").alias("hit"), F.min(F.when(F.col("alarm"), F.col("t") - F.col("event"))).alias("latency"), F.count("*").alias("_n"))
    per = F.array_sort(F.collect_list(F.struct("event", "class", "hit", "latency")))
    of = hit.groupBy(*by).agg(F.count("*").alias("events"), F.count_if("hit").alias("tp"), F.sum(F.when(F.col("hit"), F.col("_n")).otherwise(0)).alias("pa_tp"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("_n"))).alias("pa_fn"), per.alias("outcomes"))
    on = rows.where("alarm").withColumn("_island", F.col("t") - F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    fp = on.groupBy(*by, "_island").agg(F.count("event").alias("_in")).where("_in = 0").groupBy(*by).agg(F.count("*").alias("fp"))
    normal = F.col("event").isNull()
    sample = rows.groupBy(*by).agg(F.count("*").alias("n_test"), F.count_if("alarm").alias("alarm_samples"), F.count_if(normal).alias("normal_samples"), F.count_if(normal & F.col("alarm")).alias("normal_alarm_samples"))
    out = sample.join(of, by, "left").join(fp, by, "left").na.fill(0, ["events", "tp", "pa_tp", "pa_fn", "fp"])
    return out.withColumns({"fn": F.col("events") - F.col("tp"), "pa_fp": F.col("normal_alarm_samples"), "outcomes": F.coalesce("outcomes", F.array().cast(out.schema["outcomes"].dataType))})


def evaluated(series: DataFrame, events: DataFrame, e: Evaluation) -> DataFrame:
    """A record per dataset, channel, target and method."""
    scores = cut(method_scores(standard(series), e))
    limits = thresholds(scores, e.targets)
    test = scores.where("split = 'test'").join(limits, [*KEY, "method"]).withColumn("alarm", F.col("score") >= F.col("threshold"))
    by = [*KEY, "target_fp", "method"]
    about = limits.join(scores.groupBy(*KEY).agg(F.bool_or("constant_train").alias("constant_train")), KEY)
    return channel_metrics(test.select(*by, "t", "alarm"), events, by).join(about, by)


def diagnostics(series: DataFrame, e: Evaluation) -> DataFrame:
    """Thresholds and alarm rates of the training split, which is all that it reads."""
    return thresholds(method_scores(standard(series.where("split = 'train'")), e), e.targets).select(*KEY, "method", "target_fp", "threshold", "train_alarm_rate")


def pooled(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed first, then ratios; latencies and recall by class over all events; the mean of the channels' F1."""
    total = lambda c: F.sum(c)
    out = records.groupBy(*by).agg(
        F.count("*").alias("channels"), *(total(c).alias(c) for c in ("events", "tp", "fp", "n_test", "pa_tp", "pa_fp", "pa_fn", "normal_samples", "normal_alarm_samples")),
        F.avg("train_alarm_rate").alias("train_alarm_rate_mean"), F.avg(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]).alias("mean_channel_event_f1"),
    )
    event = records.select(*by, F.explode("outcomes").alias("o")).select(*by, "o.*")
    late = event.groupBy(*by).agg(F.avg("latency").alias("latency_mean"), F.percentile("latency", 0.5).alias("latency_median"))
    kind = event.groupBy(*by, "class").agg(F.avg(F.col("hit").cast("double")).alias("r")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "r")))).alias("recall_by_class"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("events") - F.col("tp"))
    pp, pr, pf = prf(F.col("pa_tp"), F.col("pa_fp"), F.col("pa_fn"))
    out = out.join(late, by, "left").join(kind, by, "left").withColumns({"event_precision": p, "event_recall": r, "event_f1": f1, "pa_precision": pp, "pa_recall": pr, "pa_f1": pf, "false_alarms_per_1k": ratio(1000 * F.col("fp"), F.col("n_test")), "test_normal_alarm_rate": F.col("normal_alarm_samples") / F.greatest("normal_samples", F.lit(1)), "recall_point": F.col("recall_by_class")["point"], "recall_contextual": F.col("recall_by_class")["contextual"]})
    return out.select(*by, "channels", "events", F.col("tp").alias("tp_events"), F.col("fp").alias("fp_runs"), "n_test", "event_precision", "event_recall", "event_f1", "pa_precision", "pa_recall", "pa_f1", "latency_mean", "latency_median", "false_alarms_per_1k", "test_normal_alarm_rate", "train_alarm_rate_mean", "mean_channel_event_f1", "recall_by_class", "recall_point", "recall_contextual")


def in_subsets(records: DataFrame) -> DataFrame:
    """Records once for all channels, and once more for those whose training split varies."""
    return records.withColumn("subset", F.explode(F.filter(F.array(F.lit("all_channels"), F.when(~F.col("constant_train"), "excluding_constant_train")), lambda x: x.isNotNull())))


def analysed(records: DataFrame, e: Evaluation) -> tuple[DataFrame, DataFrame]:
    """Summaries with resampled intervals by subset, target, dataset and method; and the candidate against each other method, with verdicts."""
    by = ["subset", "target_fp", "dataset"]
    rows = in_subsets(records)
    units = rows.select(*by, "method", "channel", "tp", "events", "fp")
    f1 = cut(scorecard.unioned([statistics.resampled_f1(units.where((F.col("subset") == r["subset"]) & (F.col("dataset") == r["dataset"])), [*by, "method"], "channel", e.resamples, e.seed, r["at"]) for r in _families(rows)]))
    summary = cut(pooled(rows, [*by, "method"]).join(statistics.interval(f1, [*by, "method"], "f1", e.level, "event_f1_ci"), [*by, "method"]))
    each = units.withColumn("f", statistics.event_f1(F.col("tp"), F.col("events"), F.col("fp")))
    own = each.where(F.col("method") == e.candidate).select(*by, "channel", F.col("f").alias("_own"))
    d = each.where(F.col("method") != e.candidate).join(own, [*by, "channel"]).select(*by, F.col("method").alias("baseline"), (F.col("_own") - F.col("f")).alias("d"))
    pair = [*by, "baseline"]
    tests = statistics.signed_rank(d, pair).join(d.groupBy(*pair).agg(F.count("*").alias("channels"), F.avg("d").alias("mean_channel_f1_delta")), pair)
    total = summary.select(*by, "method", F.round("event_f1", 6).alias("event_f1"))
    both = total.where(F.col("method") != e.candidate).withColumnRenamed("method", "baseline").withColumnRenamed("event_f1", "baseline_event_f1").join(total.where(F.col("method") == e.candidate).select(*by, F.col("event_f1").alias("candidate_event_f1")), by)
    out = both.join(statistics.paired(f1, by, "method", e.candidate, e.level), pair).join(tests, pair).withColumn("delta_event_f1", F.col("candidate_event_f1") - F.col("baseline_event_f1")).withColumn("candidate", F.lit(e.candidate))
    named = out.withColumn("name", F.concat_ws(":", "dataset", "baseline")).withColumn("p", F.round("wilcoxon_p", 6))
    held = evaluation.holm(named, ["subset", "target_fp"]).drop("name", "p").withColumnRenamed("adjusted", "wilcoxon_p_holm")
    return summary, held.withColumn("verdict", statistics.verdict(F.col("wilcoxon_p_holm"), F.col("delta_ci_low"), F.col("delta_ci_high"), e.significance))


def _families(rows: DataFrame) -> list[dict]:
    """Subsets and datasets, each dataset with its place, which keys its draws: few."""
    got = rows.select("subset", "dataset").distinct().orderBy("subset", "dataset").collect()
    at = {d: i for i, d in enumerate(sorted({r["dataset"] for r in got}))}
    return [{"subset": r["subset"], "dataset": r["dataset"], "at": at[r["dataset"]]} for r in got]


def headline(comparisons: DataFrame, e: Evaluation) -> DataFrame:
    """One row: whether the candidate is better than all others on a dataset, and worse than none on any, at the first target over all channels."""
    own = comparisons.where((F.col("subset") == "all_channels") & (F.col("target_fp") == e.targets[0]))
    each = own.groupBy("dataset").agg(F.bool_and(F.col("verdict") == "better").alias("won"), F.array_sort(F.collect_list(F.when(F.col("verdict") == "worse", F.concat_ws(":", "dataset", "baseline")))).alias("lost"))
    out = each.agg(F.array_sort(F.collect_list(F.when(F.col("won"), F.col("dataset")))).alias("datasets_won"), F.array_sort(F.flatten(F.collect_list("lost"))).alias("significant_losses"))
    return out.withColumn("criterion_met", (F.size("datasets_won") > 0) & (F.size("significant_losses") == 0)).withColumn("primary_target_fp", F.lit(e.targets[0]))


def channel_rows(records: DataFrame) -> DataFrame:
    """Records in the columns of the per-channel table."""
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    first = F.filter("outcomes", lambda o: o["hit"])
    return records.select("dataset", "channel", "target_fp", "method", "threshold", F.col("constant_train").cast("int").alias("constant_train"), "n_train", "n_test", F.col("events").alias("n_events"), F.col("tp").alias("tp_events"), F.col("fp").alias("fp_runs"), p.alias("event_precision"), r.alias("event_recall"), f1.alias("event_f1"), F.when(F.size(first) > 0, first[0]["latency"]).alias("latency_first"), ratio(1000 * F.col("fp"), F.col("n_test")).alias("false_alarms_per_1k"), "train_alarm_rate", (F.col("normal_alarm_samples") / F.greatest("normal_samples", F.lit(1))).alias("test_normal_alarm_rate"))


def results(series: DataFrame, events: DataFrame, e: Evaluation, about: dict | None = None) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """The evaluation's head, summaries, comparisons and per-channel rows; records are made once."""
    records = cut(evaluated(series, events, e))
    summary, comparisons = analysed(records, e)
    comparisons = cut(comparisons)
    n = events.groupBy("dataset").agg(F.count("*").alias("n")).orderBy("dataset").collect()
    constant = records.where("constant_train").select(F.concat_ws(":", *KEY).alias("c")).distinct().orderBy("c").collect()
    head = {"headline": headline(comparisons, e).first().asDict(), "events": {r["dataset"]: r["n"] for r in n}, "constant_train_channels": [r["c"] for r in constant]} | (about or {})
    return head, summary, comparisons, channel_rows(records)


def alarm_chain(rows: DataFrame, by: list[str]) -> DataFrame:
    """Alerts (by, start, end) of samples (by, t, score, threshold, ratio, gap, least, rest), in this order: runs over ratio * threshold that hold
    a score over the threshold, runs at most ``gap`` apart joined, those shorter than ``least`` dropped, those that start within ``rest`` of the last kept one's end dropped.

    Settings may differ by group; a null ratio means plain runs over the threshold.
    """
    low = F.coalesce("ratio", F.lit(1.0)) * F.col("threshold")
    keep = [*by, "gap", "least", "rest"]
    on = rows.where(F.col("score") > low).withColumn("_island", F.col("t") - F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    runs = on.groupBy(*keep, "_island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max(F.col("score") > F.col("threshold")).alias("_high")).where("_high")
    w = Window.partitionBy(*by).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) - 1 > F.coalesce("gap", F.lit(0)), 1).otherwise(0)
    joined = runs.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keep, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = joined.where(F.col("end") - F.col("start") + 1 >= F.coalesce("least", F.lit(1)))
    every = long.groupBy(*by, "rest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    kept = F.expr("aggregate(_runs, cast(array() as array<struct<start:bigint,end:bigint>>), (a, r) -> if(size(a) = 0 or coalesce(rest, 0) = 0 or r.start - a[size(a) - 1].end > rest, concat(a, array(r)), a))")
    return every.select(*by, F.explode(kept).alias("_row")).select(*by, "_row.start", "_row.end")


def bounded(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))
