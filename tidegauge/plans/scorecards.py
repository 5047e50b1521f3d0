"""Registered queries of whole programs: calibration, comparison, stress, series evaluation, search and online state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..operators import detectors, replay, scorecard, search, sequences, series, statistics
from ..settings import Compare, Evaluation, Frames, Streams, Stress
from ..sources import scenarios, views
from .catalog import BLEND, BURST, CELLS, HYST, IOU, MISSING, TRUTH, TYPES, WEIGHTED, WILSON, ZUSERS, query, r6, zstream

SMALL_FRAMES = Frames(channels=64, size=8, threshold=0.35)


# Frames: embeddings, scored by three detectors, calibrated on two labels, evaluated with bursts.


def vectors(spark, sf) -> DataFrame:
    e = views.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("channels"))


def with_bursts(rows: DataFrame) -> DataFrame:
    hit = F.col("vec_id") % 3 == 0
    b = F.col("vec_id") % 8
    x = F.transform("channels", lambda v, i: v + F.when(hit & (F.floor(i / 8) == b), 0.5).otherwise(0.0))
    return rows.withColumn("channels", x).withColumn("truth", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: hit & (i == b)))


def three(spark, sf) -> dict[str, detectors.Detector]:
    fit = vectors(spark, sf).where("label < 4")
    return {"blend": detectors.create("blend", SMALL_FRAMES), "peak": detectors.create("peak", SMALL_FRAMES), "zscore": detectors.create("zscore", SMALL_FRAMES).fit(fit, ["vec_id"])}


THREE = "fit as (select block, vec_id, sqrt(avg(x * x)) as rms from cells where label < 4 group by all), fc as (select block, median(rms) as centre from fit group by all), fb as (select block, any_value(centre) as centre, greatest(1.4826::double * median(abs(rms - centre)), 1e-9::double) as scale from fit join fc using (block) group by block)"


def _three(cells: str, name: str) -> str:
    return f"{name}s as (select vec_id, label, block, {BLEND} as blend, max(abs(x)) as peak, sqrt(avg(x * x)) as rms from {cells} group by all), {name} as (select vec_id, label, block, 'blend' as detector, blend as score from {name}s union all select vec_id, label, block, 'peak', peak from {name}s union all select vec_id, label, block, 'zscore', abs(rms - centre) / scale from {name}s join fb using (block))"


CALIBRATED = f"{BURST}, {THREE}, {_three('cells', 'cl')}, mx as (select detector, label, vec_id, max(score) as top from cl where label in (4, 5) group by all), rk as (select *, count(*) over w as n, row_number() over (partition by detector, label order by top desc) - 1 as place from mx window w as (partition by detector, label)), ct as (select detector, label, n, least(floor(0.05::double * n + 1e-9::double), n - 1)::bigint as allowed, top as c from rk where place = least(floor(0.05::double * n + 1e-9::double), n - 1)), th as (select detector, max(c) as t from ct group by all)"


def maxima(spark, sf) -> DataFrame:
    rows = vectors(spark, sf).where("label in (4, 5)")
    return scorecard.scored_by(three(spark, sf), rows, ["vec_id", "label"]).groupBy("detector", "label", "vec_id").agg(F.max("score").alias("top"))


@query(f"with {CALIBRATED}, fp as (select mx.detector, label, avg((top > t)::int::double) as fp from mx join th using (detector) group by all) select ct.detector, ct.label::bigint as label, n, allowed as allowed_exceedances, round(c, 9) + 0.0 as threshold, round(t, 9) + 0.0 as overall, round(fp, 6) + 0.0 as calibration_fp_rate from ct join th using (detector) join fp on fp.detector = ct.detector and fp.label = ct.label")
def q_calibrate_rates(spark, sf):
    best, each = scorecard.calibrated(maxima(spark, sf), ["detector"], 0.05, "label")
    r9 = lambda c, n: (F.round(c, 9) + 0.0).alias(n)
    return each.join(best.withColumnRenamed("threshold", "overall"), "detector").select("detector", F.col("label").cast("long"), "n", "allowed_exceedances", r9("threshold", "threshold"), r9("overall", "overall"), r6("calibration_fp_rate"))


FRAME_UNITS = f"{CALIBRATED}, {_three('burst', 'bu')}, mk as (select bu.*, score > t as d, vec_id % 3 = 0 and block = vec_id % 8 as truth from bu join th using (detector)), un as (select detector, label, vec_id, count(case when d and truth then 1 end) as hits, count(case when d or truth then 1 end) as un, count(case when d then 1 end) as nd from mk group by all), sm as (select detector, label, count(*) as n, count(case when nd > 0 then 1 end) as k, avg((hits > 0)::int::double) as ev, avg((hits = un)::int::double) as exact, avg({IOU}) as iou, avg(nd) as blocks from un group by all)"


@query(f"with {FRAME_UNITS}, w as (select *, {WILSON} from sm) select detector, label::bigint as label, n, case when label % 3 = 0 then round(k::double / n, 6) + 0.0 end as fp_rate, case when label % 3 = 0 then round(alarm_high, 6) + 0.0 end as fp_ci95_high, case label % 3 when 1 then round(ev, 6) + 0.0 when 2 then round(k::double / n, 6) + 0.0 end as recall, round(exact, 6) + 0.0 as exact_match_rate, case when label % 3 <> 0 then round(iou, 6) + 0.0 end as mean_iou, round(blocks, 6) + 0.0 as mean_detected_blocks from w")
def q_compare_frame(spark, sf):
    rows, made = with_bursts(vectors(spark, sf)), three(spark, sf)
    limits = scorecard.calibrated(maxima(spark, sf), ["detector"], 0.05, "label")[0]
    scores = scorecard.scored_by(made, rows, ["vec_id", "label"]).join(scorecard.truth_of(rows, ["vec_id"]), ["vec_id", "block"]).join(F.broadcast(limits), "detector")  # a row per detector
    units = scorecard.unit_eval(scores.withColumn("detected", F.col("score") >= F.col("threshold")), ["detector", "label", "vec_id"], SMALL_FRAMES)
    expectation = F.when(F.col("label") % 3 == 0, "none").when(F.col("label") % 3 == 1, "event_blocks").otherwise("all_blocks")
    s = scorecard.summary(units, ["detector", "label"], expectation, 8)
    recall = F.when(F.col("expectation") == "event_blocks", F.col("event_detection_rate")).when(F.col("expectation") == "all_blocks", F.col("detection_rate"))
    s = s.withColumns({"n": F.col("trials"), "fp_rate": F.col("false_positive_rate"), "fp_ci95_high": F.when(F.col("expectation") == "none", F.col("detection_rate_ci95_high")), "recall": recall, "mean_iou": F.col("mean_overlap")})
    return s.select("detector", F.col("label").cast("long"), "n", *map(r6, ("fp_rate", "fp_ci95_high", "recall", "exact_match_rate", "mean_iou", "mean_detected_blocks")))


@query(f"with {BURST}, s as (select vec_id, label, block, bool_or(truth) as truth, {BLEND} as score from burst group by all), g as (select unnest([0.2::double, 0.3::double, 0.4::double]) as threshold), u as (select label, threshold, vec_id, count(case when score >= threshold then 1 end) as nd, count(case when score >= threshold and truth then 1 end) as hits, count(case when score >= threshold or truth then 1 end) as un from s cross join g group by all), m as (select label, threshold, count(*) as trials, avg((nd > 0)::int::double) as rate, avg((hits > 0)::int::double) as ev, avg((hits = un)::int::double) as exact, avg((nd * 2 > 8)::int::double) as majority from u group by all), p as (select threshold, bool_and(case label % 3 when 0 then rate <= 0.01 when 1 then ev >= 0.99 and exact >= 0.95 else majority >= 0.99 end) as all_passed from m group by all) select m.label::bigint as label, m.threshold, trials, round(rate, 6) + 0.0 as detection_rate, round(exact, 6) + 0.0 as exact_match_rate, round(majority, 6) + 0.0 as majority_blocks_rate, all_passed from m join p using (threshold)")
def q_sweep_summary(spark, sf):
    rows = with_bursts(vectors(spark, sf))
    scores = detectors.create("blend", SMALL_FRAMES).score(rows, ["vec_id", "label"]).join(scorecard.truth_of(rows, ["vec_id"]), ["vec_id", "block"])
    expectation = F.when(F.col("label") % 3 == 0, "none").when(F.col("label") % 3 == 1, "event_blocks").otherwise("all_blocks")
    out = scorecard.swept(scores, [0.2, 0.3, 0.4], ["vec_id"], SMALL_FRAMES, expectation, "label")
    return out.select(F.col("label").cast("long"), "threshold", "trials", r6("detection_rate"), r6("exact_match_rate"), r6("majority_blocks_rate"), "all_passed")


# Streams: types of events by day, with a step of 4 on one block of odd streams.

STEPPED = TYPES + WEIGHTED.removeprefix(TYPES) + ", mz as (select stream, step, block, case when stream % 2 = 1 then 15 + stream % 5 end as onset, stream % 2 = 1 and block = 'error' and step >= 15 + stream % 5 as truth, z + case when stream % 2 = 1 and block = 'error' and step >= 15 + stream % 5 then 4.0::double else 0 end as z from wz), sc as (select stream, step, block, onset, truth, 'level' as detector, abs(z) as score from mz union all select a.stream, a.step, a.block, a.onset, a.truth, 'ewma', abs(sum(0.2::double * pow(0.8::double, a.step - b.step) * b.z)) / sqrt(0.2::double / 1.8::double) from mz a join mz b on a.stream = b.stream and a.block = b.block and b.step <= a.step group by all), mx as (select detector, stream, max(score) as top from sc where step >= 8 and onset is null group by all), rk as (select *, count(*) over (partition by detector) as n, row_number() over (partition by detector order by top desc) - 1 as place from mx), th as (select detector, top as t from rk where place = least(floor(0.2::double * n + 1e-9::double), n - 1))"
OUT = STEPPED + ", mk as (select sc.*, score > t and step >= 8 as alarm from sc join th using (detector)), sp as (select detector, stream, step, any_value(onset) as onset, bool_or(alarm) as hot, bool_or(alarm and truth) as tr, count(case when alarm and truth then 1 end) as bo, count(case when alarm or truth then 1 end) as ei from mk group by all), fs as (select detector, stream, min(step) as fst from sp where hot and (onset is null or step >= onset) group by all), so as (select sp.detector, sp.stream, any_value(onset) as onset, bool_or(hot) as hot, coalesce(bool_or(hot and step < onset), false) as pre, min(case when tr and (onset is null or step >= onset) then step end) - any_value(onset) as late, coalesce(bool_or(step = fst and bo = ei), false) as exact, coalesce(max(case when step = fst then bo::double / ei end), 0) as iou from sp left join fs on sp.stream = fs.stream and sp.detector = fs.detector group by sp.detector, sp.stream)"


@query(f"with {OUT}, c as (select detector, onset is null as clean, count(*) as n, count(case when hot then 1 end) as k, avg(pre::int::double) as early, avg((late is not null)::int::double) as recall, avg(exact::int::double) as ex, avg(iou) as iou, avg(late) as mean, quantile_cont(late::double, 0.5) as med, quantile_cont(late::double, 0.9) as p90, max(late) as most from so group by all), w as (select *, {WILSON} from c) select detector, case when clean then 'clean' else 'stepped' end as regime, n, case when clean then round(k::double / n, 6) + 0.0 end as fp_rate, case when clean then round(alarm_high, 6) + 0.0 end as fp_ci95_high, case when not clean then round(early, 6) + 0.0 end as early_alarm_rate, case when not clean then round(recall, 6) + 0.0 end as recall, case when not clean then round(ex, 6) + 0.0 end as exact_match_rate, case when not clean then round(iou, 6) + 0.0 end as mean_iou, case when not clean then round(mean, 6) + 0.0 end as latency_mean, case when not clean then round(med, 6) + 0.0 end as latency_median, case when not clean then round(p90, 6) + 0.0 end as latency_p90, case when not clean then most + 0.0::double end as latency_max from w")
def q_compare_stream(spark, sf):
    from ..operators.outcomes import stream_outcomes

    z = sequences.weighted(views.type_streams(spark, sf), ["stream"], "block", "x", "observed", 4, 8)
    onset = F.when(F.col("stream") % 2 == 1, 15 + F.col("stream") % 5)
    z = cut(z.withColumn("onset", onset).withColumn("truth", F.coalesce((F.col("block") == "error") & (F.col("step") >= F.col("onset")), F.lit(False))).withColumn("z", F.col("z") + F.when(F.col("truth"), 4.0).otherwise(0.0)))
    e = sequences.ewma(z, ["stream", "block"])
    keep = ["stream", "step", "block", "onset", "truth"]
    scores = z.select(*keep, F.lit("level").alias("detector"), F.abs("z").alias("score")).unionByName(e.select(*keep, F.lit("ewma").alias("detector"), F.col("ewma").alias("score")))
    top = scores.where("step >= 8 and onset is null").groupBy("detector", "stream").agg(F.max("score").alias("top")).withColumn("regime", F.lit("clean"))
    limits = scorecard.calibrated(top, ["detector"], 0.2)[0]
    marks = scores.join(F.broadcast(limits), "detector").withColumn("alarm", F.col("score") >= F.col("threshold")).withColumn("_unit", F.struct("detector", "stream"))  # a row per detector
    out = stream_outcomes(marks, "_unit", 8).select("_unit.*", "*").drop("_unit").withColumn("_clean", F.col("stream") % 2 == 0).withColumn("regime", F.when(F.col("_clean"), "clean").otherwise("stepped"))
    rates = ("fp_rate", "fp_ci95_high", "early_alarm_rate", "recall", "exact_match_rate", "mean_iou", "latency_mean", "latency_median", "latency_p90", "latency_max")
    return scorecard.stream_row(out, ["detector", "regime"]).select("detector", "regime", "n", *map(r6, rates))


# Stress: missing channels against none, quiet frames and bursts.

KINDS = [("clean", "background", None, "cells"), ("missing", "background", "clean", "missing"), ("burst", "event", None, "burst"), ("burst_missing", "event", "burst", "bmiss")]
STRESSED = f"{BURST}, {MISSING.removeprefix(CELLS + ', ')}, bmiss as (select vec_id, label, channel, block, case when (vec_id * 31 + channel * 17) % 10 <> 0 then x end as x, truth from burst), " + ", ".join(f"k_{n} as (select '{n}' as scenario, '{k}' as kind, {'null' if r is None else repr(r)} as reference, vec_id, block, coalesce({BLEND}, 0) >= 0.35::double as d, vec_id % 3 = 0 and block = vec_id % 8 as truth from {t} group by vec_id, block)" for n, k, r, t in KINDS)
STRESSED += ", every as (" + " union all ".join(f"select * from k_{n}" for n, *_ in KINDS) + "), un as (select scenario, kind, reference, vec_id, bool_or(d) as hot, bool_or(d and truth) as hit, count(case when d and truth then 1 end) as bo, count(case when d or truth then 1 end) as ei from every where kind = 'background' or vec_id % 3 = 0 group by all), ag as (select scenario, kind, reference, count(*) as n, count(case when case when kind = 'event' then hit else hot end then 1 end) as k, avg((hot and bo = ei)::int::double) as exact, avg(case when hot then bo::double / ei else 0 end) as iou from un group by all)"


@query(f"with {STRESSED}, w as (select *, k::double / n as r, {WILSON} from ag) select a.scenario, a.kind, a.reference, a.n, case when a.kind = 'background' then round(a.r, 6) + 0.0 end as fp_rate, case when a.kind = 'background' then round(a.r - b.r, 6) + 0.0 end as fp_inflation, case when a.kind = 'event' then round(a.r, 6) + 0.0 end as recall, case when a.kind = 'event' then round(a.exact, 6) + 0.0 end as exact_match_rate, case when a.kind = 'event' then round(a.iou, 6) + 0.0 end as mean_iou, case when a.kind = 'event' and b.r <> 0 then round(a.r / b.r, 6) + 0.0 end as recall_retention, case when b.n is null then null when a.kind = 'background' then case when a.alarm_low > b.alarm_high then 'worse' when a.alarm_high < b.alarm_low then 'better' else 'n.s.' end else case when a.alarm_high < b.alarm_low then 'worse' when a.alarm_low > b.alarm_high then 'better' else 'n.s.' end end as change from w a left join w b on b.scenario = a.reference")
def q_stress_rows(spark, sf):
    from ..operators.outcomes import stream_outcomes

    plain = vectors(spark, sf).withColumn("truth", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lit(False)))
    gone = lambda df: df.withColumn("channels", F.transform("channels", lambda v, i: F.when((F.col("vec_id") * 31 + i * 17) % 10 != 0, v).otherwise(F.lit(float("nan")))))
    hot = with_bursts(vectors(spark, sf)).where("vec_id % 3 = 0")
    made = {"clean": plain, "missing": gone(plain), "burst": hot, "burst_missing": gone(hot)}
    rows = scorecard.unioned([df.select(F.lit(n).alias("scenario"), "vec_id", F.lit(0).cast("long").alias("step"), "channels", "truth", F.lit(0 if n.startswith("burst") else None).cast("long").alias("onset")) for n, df in made.items()])
    keys = ["scenario", "vec_id"]
    scores = detectors.create("blend", SMALL_FRAMES).score(rows, keys).withColumn("detector", F.lit("blend"))
    marks = scorecard.stream_marks(scores, rows, keys, F.lit(0.35))
    out = stream_outcomes(marks.withColumn("_unit", F.struct("detector", *keys)), "_unit", 0).select("_unit.*", "*").drop("_unit").withColumn("_clean", ~F.col("scenario").startswith("burst"))
    s = scorecard.stream_row(out, ["detector", "scenario"])
    low, high = C.wilson(F.round(F.col("recall") * F.col("n")), F.col("n"))
    table = lambda i: F.create_map(*(F.lit(x) for k in KINDS for x in (k[0], k[i])))[F.col("scenario")]
    known = F.col("recall").isNotNull()
    s = s.withColumns({"track": F.lit("frame"), "kind": table(1), "reference": table(2), "supported": F.lit(True), "threshold": F.lit(0.35), "recall_ci95_low": F.when(known, low), "recall_ci95_high": F.when(known, high)})
    return scorecard.robust(scorecard.shaped(s, scorecard.STRESS)).select("scenario", "kind", "reference", "n", *map(r6, ("fp_rate", "fp_inflation", "recall", "exact_match_rate", "mean_iou", "recall_retention")), "change")


# Series.


def labelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Daily series by priority, each split counted from 0, with 3 deviations added in windows of the test split, which are its events; priorities of one first digit's parity are a dataset."""
    s = views.scored_series(spark, sf)
    first = s.where("split = 'test'").groupBy("channel").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    name = F.when(F.substring("channel", 1, 1).cast("int") % 2 == 0, "even").otherwise("odd").alias("dataset")
    both = s.join(first, "channel")
    rows = both.select(name, "channel", "split", (F.col("t") - F.when(F.col("split") == "test", F.col("_first")).otherwise(0)).alias("t"), (F.col("z") + F.when((F.col("split") == "test") & (F.col("t") >= 50) & ((F.col("t") - 50) % 100 <= 19), 3.0).otherwise(0.0)).alias("x"))
    events = views.truth_windows(s).join(first, "channel").where((F.col("end") >= F.col("_first"))).select(name, "channel", (F.greatest("start", "_first") - F.col("_first")).alias("start"), (F.col("end") - F.col("_first")).alias("end"), "class")
    return cut(rows), events


SERIES = TRUTH + ", ft as (select channel, min(t) as f from scored where split = 'test' group by all), sr as (select case when left(channel, 1)::int % 2 = 0 then 'even' else 'odd' end as dataset, channel, split, t - case when split = 'test' then f else 0 end as t, z + case when split = 'test' and t >= 50 and (t - 50) % 100 <= 19 then 3.0::double else 0 end as x from scored join ft using (channel)), ev as (select channel, greatest(s, f) - f as s, e - f as e, class from truth join ft using (channel) where e >= f), sb as (select channel, avg(x) as m, greatest(stddev_samp(x), 1e-9::double) as sd from sr where split = 'train' group by all), sz as (select sr.*, (x - m) / sd as z from sr join sb using (channel)), ms as (select dataset, channel, split, t, 'peak' as method, max(abs(z)) over w as score from sz window w as (partition by channel, split order by t rows between 31 preceding and current row) union all select dataset, channel, split, t, 'blend', 0.45::double * max(abs(z)) over w + 0.35::double * sqrt(avg(z * z) over w) + 0.2::double * avg(abs(z)) over w from sz window w as (partition by channel, split order by t rows between 31 preceding and current row) union all select dataset, channel, split, t, 'zscore', abs(z) from sz), tg as (select unnest([0.01::double, 0.05::double]) as target), rk as (select channel, method, score, count(*) over (partition by channel, method) as n, row_number() over (partition by channel, method order by score desc) - 1 as place from ms where split = 'train'), ct as (select channel, method, target, n as n_train, score as c from rk cross join tg where place = least(floor(target * n + 1e-9::double), n - 1)), tr as (select ct.channel, ct.method, target, avg((score > c)::int::double) as train_rate from ct join ms on ms.channel = ct.channel and ms.method = ct.method and split = 'train' group by all), al as (select ms.dataset, ms.channel, target, ms.method, t, score > c as alarm, ev.s as event, ev.class from ms join ct on ct.channel = ms.channel and ct.method = ms.method left join ev on ev.channel = ms.channel and t between ev.s and ev.e where split = 'test'), eh as (select dataset, channel, target, method, event, class, bool_or(alarm) as hit, min(case when alarm then t - event end) as late, count(*) as np from al where event is not null group by all), rn as (select dataset, channel, target, method, g, count(event) as inside from (select *, t - row_number() over (partition by channel, target, method order by t) as g from al where alarm) group by all), ec as (select channel, target, method, count(*) as events, count(case when hit then 1 end) as tp, sum(case when hit then np else 0 end) as pa_tp, sum(case when hit then 0 else np end) as pa_fn from eh group by all), rc as (select channel, target, method, count(case when inside = 0 then 1 end) as fp from rn group by all), sa as (select dataset, channel, target, method, count(*) as n_test, count(case when alarm then 1 end) as alarms, count(case when event is null then 1 end) as normal, count(case when event is null and alarm then 1 end) as normal_alarms from al group by all), rec as (select sa.*, coalesce(events, 0) as events, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(pa_tp, 0)::bigint as pa_tp, coalesce(pa_fn, 0)::bigint as pa_fn, train_rate from sa left join ec using (channel, target, method) left join rc using (channel, target, method) left join tr using (channel, target, method))"
LOCKED = Evaluation(methods=("blend", "peak", "zscore"), targets=(0.01, 0.05), resamples=500)


@query(f"with {SERIES} select dataset, channel, target as target_fp, method, n_test, alarms as alarm_samples, normal as normal_samples, normal_alarms as normal_alarm_samples, events, tp, fp, events - tp as fn, pa_tp, normal_alarms as pa_fp, pa_fn, round(train_rate, 6) + 0.0 as train_alarm_rate from rec")
def q_series_records(spark, sf):
    r = series.evaluated(*labelled(spark, sf), LOCKED)
    return r.select("dataset", "channel", "target_fp", "method", "n_test", "alarm_samples", "normal_samples", "normal_alarm_samples", "events", "tp", "fp", "fn", "pa_tp", "pa_fp", "pa_fn", r6("train_alarm_rate"))


F1 = "case when {tp} > 0 then 2.0::double * {tp} / (2 * {tp} + {fp} + {fn}) else 0 end"


@query(f"with {SERIES}, lt as (select dataset, target, method, avg(late) as mean, quantile_cont(late::double, 0.5) as med, avg(hit::int::double) filter (class = 'point') as rp, avg(hit::int::double) filter (class = 'contextual') as rc from eh group by all), po as (select dataset, target, method, count(*) as channels, sum(events)::bigint as events, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(n_test)::bigint as n_test, sum(pa_tp) as pa_tp, sum(normal_alarms) as pa_fp, sum(pa_fn) as pa_fn, sum(normal) as normal, avg(train_rate) as tr, avg({F1.format(tp='tp', fp='fp', fn='(events - tp)')}) as cf from rec group by all) select dataset, target as target_fp, method, channels, events, tp as tp_events, fp as fp_runs, n_test, round({F1.format(tp='tp', fp='fp', fn='(events - tp)')}, 6) + 0.0 as event_f1, round({F1.format(tp='pa_tp', fp='pa_fp', fn='pa_fn')}, 6) + 0.0 as pa_f1, round(mean, 6) + 0.0 as latency_mean, round(med, 6) + 0.0 as latency_median, round(1000.0::double * fp / n_test, 6) + 0.0 as false_alarms_per_1k, round(pa_fp::double / greatest(normal, 1), 6) + 0.0 as test_normal_alarm_rate, round(tr, 6) + 0.0 as train_alarm_rate_mean, round(cf, 6) + 0.0 as mean_channel_event_f1, round(rp, 6) + 0.0 as recall_point, round(rc, 6) + 0.0 as recall_contextual from po left join lt using (dataset, target, method)")
def q_series_summary(spark, sf):
    out = series.pooled(cut(series.evaluated(*labelled(spark, sf), LOCKED)), ["dataset", "target_fp", "method"])
    return out.select("dataset", "target_fp", "method", "channels", "events", "tp_events", "fp_runs", "n_test", *map(r6, ("event_f1", "pa_f1", "latency_mean", "latency_median", "false_alarms_per_1k", "test_normal_alarm_rate", "train_alarm_rate_mean", "mean_channel_event_f1", "recall_point", "recall_contextual")))


@query(f"with {SERIES}, f as (select dataset, channel, target, method, {F1.format(tp='tp', fp='fp', fn='(events - tp)')} as f1 from rec), d as (select a.target, b.method as baseline, a.channel, a.f1 - b.f1 as d from f a join f b on a.channel = b.channel and a.target = b.target where a.method = 'blend' and b.method <> 'blend'), nz as (select *, round(abs(d), 9) as size from d where abs(d) > 1e-12::double), rz as (select target, baseline, d, (rank() over w + (count(*) over (partition by target, baseline, size) - 1) / 2.0::double) as rank from nz window w as (partition by target, baseline order by size)) select target as target_fp, baseline, count(rz.d) as n_nonzero, round(coalesce(sum(case when rz.d > 0 then rank else 0 end), 0), 6) + 0.0 as w_plus, round(avg(dd.m), 6) + 0.0 as mean_delta from (select target, baseline, avg(d) as m from d group by all) dd left join rz using (target, baseline) group by all")
def q_signed_rank(spark, sf):
    r = cut(series.evaluated(*labelled(spark, sf), LOCKED).select("channel", "target_fp", "method", statistics.event_f1(F.col("tp"), F.col("events"), F.col("fp")).alias("f")))
    own = r.where("method = 'blend'").select("channel", "target_fp", F.col("f").alias("_own"))
    d = r.where("method != 'blend'").join(own, ["channel", "target_fp"]).select("target_fp", F.col("method").alias("baseline"), (F.col("_own") - F.col("f")).alias("d"))
    t = statistics.signed_rank(d, ["target_fp", "baseline"]).join(d.groupBy("target_fp", "baseline").agg(F.avg("d").alias("mean_delta")), ["target_fp", "baseline"])
    return t.select("target_fp", "baseline", F.col("wilcoxon_n_nonzero").alias("n_nonzero"), (F.round("wilcoxon_w_plus", 6) + 0.0).alias("w_plus"), r6("mean_delta"))


@query()
def q_series_verdicts(spark, sf):
    return series.analysed(cut(series.evaluated(*labelled(spark, sf), LOCKED)), LOCKED)[1]


# Search.


def searched(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The series once more: fit is the training split, clean its samples too, the target is the test split."""
    rows, events = labelled(spark, sf)
    part = lambda split, name: rows.where(F.col("split") == split).select("dataset", "channel", F.lit(name).alias("part"), "t", "x")
    return scorecard.unioned([part("train", "fit"), part("train", "clean"), part("test", "target")]), events


CONFIG = {"normalization": {"scope": "per_channel", "epsilon": 1e-9, "clip": 10}, "window": {"length": 8, "aggregation": "topk_mean", "topk": 2, "smoothing": 3}, "threshold": {"kind": "global_quantile", "value": 0.95}, "postprocess": {"hysteresis_low_high_ratio": 0.6, "min_alert_duration": 2, "max_merge_gap": 4, "cooldown": 4}, "complementary": {"feature": "rolling_mad", "combination": "max"}}
V2 = SERIES + ", pt as (select dataset, channel, 'fit' as part, t, x from sr where split = 'train' union all select dataset, channel, 'clean', t, x from sr where split = 'train' union all select dataset, channel, 'target', t, x from sr where split = 'test'), pm as (select channel, median(x) as c from pt where part = 'fit' group by all), pq as (select channel, any_value(c) as c, greatest(1.4826::double * median(abs(x - c)), 1e-9::double) as s from pt join pm using (channel) where part = 'fit' group by channel), px as (select dataset, pt.channel, part, t, greatest(-10.0::double, least(10.0::double, (x - c) / s)) as x from pt join pq using (channel) where part <> 'fit'), pl as (select *, first_value(x) over p as x0, list(x) over (partition by channel, part order by t rows between 7 preceding and current row) as l, list(x) over (partition by channel, part order by t rows between 63 preceding and current row) as m from px window p as (partition by channel, part order by t)), pw as (select dataset, channel, part, t, x, list_avg(list_reverse_sort(list_transform(list_concat(list_transform(range(0, 8 - len(l)), lambda i: x0), l), lambda v: abs(v)))[1:2]) as a, list_concat(list_transform(range(0, 64 - len(m)), lambda i: x0), m) as m from pl), ps as (select *, list_median(m) as med, first_value(a) over (partition by channel, part order by t) as a0, list(a) over (partition by channel, part order by t rows between 2 preceding and current row) as la from pw), pb as (select dataset, channel, part, t, list_avg(list_concat(list_transform(range(0, 3 - len(la)), lambda i: a0), la)) as a, abs(x - med) / greatest(1.4826::double * list_median(list_transform(m, lambda v: abs(v - med))), 1) as b from ps), pn as (select channel, greatest(quantile_cont(a, 0.99), 1e-12::double) as na, greatest(quantile_cont(b, 0.99), 1e-12::double) as nb from pb where part = 'clean' group by all), v2 as (select dataset, pb.channel, part, t, greatest(a / na, b / nb) as score from pb join pn using (channel))"


@query(f"with {V2} select channel, part, t, round(score, 6) + 0.0 as score from v2")
def q_combined_score(spark, sf):
    return search.combined(searched(spark, sf)[0], CONFIG).select("channel", "part", "t", r6("score"))


RULES = [{"kind": "per_channel_quantile", "value": 0.99}, {"kind": "global_quantile", "value": 0.95}, {"kind": "robust_multiplier", "value": 4.0}]


@query(f"with {V2}, cm as (select channel, median(score) as m from v2 where part = 'clean' group by all) select channel, 0 as rule, round(quantile_cont(score, 0.99), 6) + 0.0 as threshold from v2 where part = 'clean' group by channel union all select c.channel, 1, round(q, 6) + 0.0 from (select distinct dataset, channel from v2) c join (select dataset, quantile_cont(score, 0.95) as q from v2 where part = 'clean' group by dataset) using (dataset) union all select channel, 2, round(any_value(m) + 4.0::double * 1.4826::double * median(abs(score - m)), 6) + 0.0 from v2 join cm using (channel) where part = 'clean' group by channel")
def q_threshold_pooled(spark, sf):
    s = cut(search.combined(searched(spark, sf)[0], CONFIG))
    return search.rule_thresholds(s.where("part = 'clean'"), RULES).select("channel", "rule", r6("threshold"))


CHAIN = V2 + ", tq as (select dataset, quantile_cont(score, 0.95) as t0 from v2 where part = 'clean' group by all), lo as (select channel, t, score, t0, t - row_number() over (partition by channel order by t) as g from v2 join tq using (dataset) where part = 'target' and score > 0.6::double * t0), hr as (select channel, min(t) as s, max(t) as e from lo group by channel, g having bool_or(score > t0)), fl as (select *, case when s - lag(e) over (partition by channel order by s) - 1 > 4 then 1 else 0 end as new from hr), gr as (select *, sum(new) over (partition by channel order by s) as g from fl), mg as (select channel, min(s) as s, max(e) as e from gr group by channel, g having max(e) - min(s) + 1 >= 2), o as (select channel, s, e, row_number() over (partition by channel order by s) as i from mg), kp as (select channel, i, s, e, true as kept, e as last from o where i = 1 union all select o.channel, o.i, o.s, o.e, o.s - kp.last > 4, case when o.s - kp.last > 4 then o.e else kp.last end from kp join o on o.channel = kp.channel and o.i = kp.i + 1), ak as (select channel, s, e from kp where kept)"


@query(f"with recursive {CHAIN} select channel, s as start, e as \"end\" from ak")
def q_alert_chain(spark, sf):
    return search.method_alerts(searched(spark, sf)[0], "configured", CONFIG).select("channel", "start", "end")


@query(f"with recursive {CHAIN}, tgt as (select dataset, channel, t from pt where part = 'target'), pts as (select tgt.dataset, tgt.channel, tgt.t, ak.s as run, ev.s as event from tgt left join ak on ak.channel = tgt.channel and tgt.t between ak.s and ak.e left join ev on ev.channel = tgt.channel and tgt.t between ev.s and ev.e), eh2 as (select channel, event, bool_or(run is not null) as hit, count(distinct run) as k, greatest(min(run) - event, 0) as delay, count(*) as np from pts where event is not null group by channel, event), rh as (select channel, run, bool_or(event is not null) as hit, max(t) - min(t) + 1 as dur from pts where run is not null group by channel, run), cc as (select channel, any_value(dataset) as dataset, count(case when run is not null and event is not null then 1 end) as ptp, count(case when run is not null and event is null then 1 end) as pfp, count(case when run is null and event is not null then 1 end) as pfn from pts group by channel), ce as (select channel, count(*) as events, count(case when hit then 1 end) as tp from eh2 group by all), cr as (select channel, count(*) as pred, count(case when not hit then 1 end) as fp from rh group by all), ca as (select cc.*, coalesce(events, 0) as events, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(pred, 0) as pred from cc left join ce using (channel) left join cr using (channel)), ru as (select coalesce(dataset, 'all') as dataset, count(*) as channels, sum(events)::bigint as events, sum(tp)::bigint as tp, sum(fp)::bigint as fp, (sum(events) - sum(tp))::bigint as fn, sum(pred)::bigint as pred_events, coalesce(avg(case when events > 0 then {F1.format(tp='tp', fp='fp', fn='(events - tp)')} end), 0) as macro, sum(ptp) as ptp, sum(pfp) as pfp, sum(pfn) as pfn from ca group by grouping sets ((dataset), ())), dl as (select coalesce(dataset, 'all') as dataset, avg(k - 1) filter (hit) as dup, quantile_cont(delay::double, 0.5) filter (hit) as d50, quantile_cont(delay::double, 0.9) filter (hit) as d90 from eh2 join (select distinct dataset, channel from cc) using (channel) group by grouping sets ((dataset), ())), du as (select coalesce(dataset, 'all') as dataset, quantile_cont(dur::double, 0.5) as u50, quantile_cont(dur::double, 0.9) as u90 from rh join (select distinct dataset, channel from cc) using (channel) group by grouping sets ((dataset), ())) select ru.dataset, channels, events, tp, fp, fn, pred_events, round({F1.format(tp='tp', fp='fp', fn='fn')}, 6) + 0.0 as event_f1, round(macro, 6) + 0.0 as macro_channel_f1, round({F1.format(tp='ptp', fp='pfp', fn='pfn')}, 6) + 0.0 as point_f1, round(coalesce(dup, 0), 6) + 0.0 as duplicates_per_matched_event, round(d50, 6) + 0.0 as delay_median, round(d90, 6) + 0.0 as delay_p90, round(u50, 6) + 0.0 as pred_duration_median, round(u90, 6) + 0.0 as pred_duration_p90 from ru left join dl using (dataset) left join du using (dataset)")
def q_rollup_dataset(spark, sf):
    rows, events = searched(spark, sf)
    spans = search.method_alerts(rows, "configured", CONFIG)
    out = search.aggregated(search.channel_eval(spans, rows.where("part = 'target'").select("dataset", "channel", "t"), events, ["dataset", "channel"]).withColumn("all", F.lit(0)), ["all"])
    return out.select("dataset", "channels", "events", "tp", "fp", "fn", "pred_events", *map(r6, ("event_f1", "macro_channel_f1", "point_f1", "duplicates_per_matched_event", "delay_median", "delay_p90", "pred_duration_median", "pred_duration_p90")))


@query()
def q_method_table(spark, sf):
    rows, events = searched(spark, sf)
    return search.aggregated(cut(search.compared(rows, events, CONFIG)), ["method"]).select("method", "dataset", "events", "tp", "fp", "fn", r6("event_f1"))


# Online state: the same machines that streams run, over a table.


def online_steps(spark, sf) -> DataFrame:
    return views.user_streams(spark, sf).select("user_id", "step", F.array("x").alias("means"))


def _online(name: str, spark, sf) -> DataFrame:
    from ..streaming import online

    made = {"ewma": online.OnlineEwma, "cusum": online.OnlineCusum, "cusum-cp": online.OnlineChangepoint}[name]
    return online.scores(online_steps(spark, sf), "user_id", made).select("user_id", "step", r6("score"))


@query(f"with {ZUSERS} select a.user_id, a.step, round(abs(sum(0.2::double * pow(0.8::double, a.step - b.step) * b.z)) / sqrt(0.2::double / 1.8::double), 6) + 0.0 as score from z a join z b on a.user_id = b.user_id and b.step <= a.step group by a.user_id, a.step")
def q_online_ewma(spark, sf):
    return _online("ewma", spark, sf)


@query(f"with {ZUSERS}, p as (select user_id, step, sum(case when step >= 16 then z - 0.5::double else 0 end) over w as up, sum(case when step >= 16 then -z - 0.5::double else 0 end) over w as dn from z window w as (partition by user_id order by step)) select a.user_id, a.step, round(greatest(0, max(a.up - b.up), max(a.dn - b.dn), a.up, a.dn), 6) + 0.0 as score from p a join p b on a.user_id = b.user_id and b.step <= a.step group by a.user_id, a.step, a.up, a.dn")
def q_online_cusum(spark, sf):
    return _online("cusum", spark, sf)


@query(f"with {HYST} select channel, s as start, e as \"end\" from mg where e + 3 < (select max(t) from scored c where c.channel = mg.channel)")
def q_online_alerts(spark, sf):
    from ..streaming import online

    rows = views.scored_series(spark, sf).select("channel", F.col("t").alias("step"), "score")
    return online.alerts(rows, "channel", threshold=2.5, ratio=0.6, gap=3, least=2)


@query()
def q_online_threshold(spark, sf):
    from ..streaming import online

    s = zstream(spark, sf).where("live").select("user_id", "step", F.abs("z").alias("score"))
    return online.thresholds(s, "user_id", 20, window=120, initial=0.9, risk=0.01, least=5).select("user_id", "step", r6("threshold"), "flagged")


# Generated data: seeded by numpy, so without SQL; their goldens are in the tests.

GENERATED = Compare(frames=Frames(channels=128, size=16), stream=Streams(), trials=100, fit_trials=100, calibration_trials=100, streams=10, calibration_streams=20, fit_streams=10, detectors=("blend", "zscore", "ewma", "cusum-cp"))


@query()
def q_generate_streams(spark, sf):
    return scenarios.streams(spark, 4, Frames(channels=64, size=8), Streams())


@query()
def q_generate_stress(spark, sf):
    return scenarios.stress(spark, "stream", 2, Frames(channels=64, size=8), Streams(steps=24, warmup=8), Stress(GENERATED).stressors, tuple(scenarios.SCENARIOS))


@query()
def q_generated_scorecard(spark, sf):
    return scorecard.compare(spark, GENERATED)[1]


@query()
def q_generated_stress(spark, sf):
    return scorecard.stress(spark, Stress(GENERATED, scenarios=("heavy_tail", "dropout_burst", "regime_steps")))[1]


@query()
def q_forest(spark, sf):
    rows = vectors(spark, sf)
    d = detectors.create("iforest", SMALL_FRAMES, trees=50).fit(rows.where("label < 4"), ["vec_id"])
    return d.score(rows, ["vec_id"]).select("vec_id", "block", r6("score"))


@query()
def q_replay_report(spark, sf):
    """Detectors calibrated on the quiet half of the vectors, judged on a recording of all, with bursts as events."""
    rows = with_bursts(vectors(spark, sf)).withColumn("line", F.col("vec_id"))
    frames = rows.select("line", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line")).alias("timestamp"), "channels", F.concat(F.lit("r"), (F.col("label") % 2).cast("string")).alias("regime"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("e"), F.col("vec_id").cast("string"))).alias("event_id"), F.when(F.col("vec_id") % 3 == 0, F.array(F.col("vec_id") % 8)).otherwise(F.array().cast("array<bigint>")).alias("affected_blocks"), F.lit(None).cast("array<boolean>").alias("incumbent_flags"), F.lit(None).cast("boolean").alias("incumbent_alarm"))
    clean = vectors(spark, sf).select(F.col("vec_id").alias("line"), "channels", F.concat(F.lit("r"), (F.col("label") % 2).cast("string")).alias("regime"), F.lit(None).cast("string").alias("event_id"))
    protocol = {"detectors": ["blend", "zscore", "ewma"], "warmup": 16, "threshold_policy": {"mode": "calibrated", "target_fp": 0.01, "unit": "frame", "calibration_sha256": "none"}}
    return replay.card(replay.report(frames, protocol, clean, "none", SMALL_FRAMES)[1])
