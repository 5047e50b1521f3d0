"""Registered telemetry queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..operators import blocks, evaluation, sequences
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.35


def r6(name: str):
    return (F.round(name, 6) + 0.0).alias(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Views in SQL.
CELLS = "cells as (select vec_id, label, i as channel, i // 8 as block, embedding[i + 1]::double as x from (select *, unnest(range(0, 64)) as i from embeddings))"
BURST = CELLS + ", burst as (select vec_id, label, channel, block, x + case when t then 0.5::double else 0 end as x, t as truth from (select *, (vec_id % 3 = 0 and block = vec_id % 8) as t from cells))"
MISSING = CELLS + ", missing as (select vec_id, label, channel, block, case when (vec_id * 31 + channel * 17) % 10 <> 0 then x end as x from cells)"
BLEND = "0.45::double * max(abs(x)) + 0.35::double * sqrt(avg(x * x)) + 0.2::double * avg(abs(x))"
MARKS = BURST + f", scores as (select vec_id, label, block, bool_or(truth) as truth, {BLEND} as score from burst group by all), marks as (select *, score >= {THRESHOLD}::double as detected from scores)"
UNITS = MARKS + ", units as (select vec_id, label, count(case when detected and truth then 1 end) as hits, count(case when detected or truth then 1 end) as un, count(case when detected then 1 end) as n_detected, count(case when truth then 1 end) as n_true, count(case when detected and not truth then 1 end) as extra, max(score) as top from marks group by all)"
IOU = "case when un = 0 then 1.0::double else hits::double / un end"
USERS = "us as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, value as x from events)"
ZUSERS = USERS + ", base as (select user_id, avg(x) filter (step < 16) as mu, greatest(stddev_samp(x) filter (step < 16), 1e-9::double) as sigma from us group by all), z as (select us.user_id, step, case when step < 16 then 0.0::double else (x - mu) / sigma end as z from us join base using (user_id))"
DAILY = "daily as (select channel, row_number() over (partition by channel order by day) - 1 as t, x, case when day < date '1999-01-01' then 'train' else 'test' end as split from (select o_orderpriority as channel, o_orderdate::date as day, sum(o_totalprice) as x from orders group by all))"
SCORED = DAILY + ", fit as (select channel, avg(x) as mean, greatest(stddev_samp(x), 1e-9::double) as sd from daily where split = 'train' group by all), scored as (select channel, t, x, split, (x - mean) / sd as z, abs((x - mean) / sd + case when t >= 50 and (t - 50) % 100 <= 19 then 3.0::double else 0 end) as score from daily join fit using (channel))"
TRUTH = SCORED + ", truth as (select channel, k * 100 + 50 as s, k * 100 + 69 as e, case when k % 2 = 0 then 'point' else 'contextual' end as class from (select channel, unnest(range(0, (max(t) - 69) // 100 + 1)) as k from daily group by channel having max(t) >= 69))"
RUNS = TRUTH + ", runs as (select channel, min(t) as s, max(t) as e from (select channel, t, t - row_number() over (partition by channel order by t) as g from scored where score >= 2.5::double) group by channel, g)"
CHANNELS = RUNS + ", pairs as (select r.channel, r.s as rs, r.e as re, v.s, v.e, v.class from runs r join truth v on r.channel = v.channel and r.s <= v.e and r.e >= v.s), hit as (select channel, s, count(*) as n, min(greatest(rs - s, 0)) as latency from pairs group by all), chan as (select t.channel, count(*) as events, count(h.s) as tp, coalesce(sum(h.n - 1), 0)::bigint as duplicates, coalesce(sum(h.latency), 0)::bigint as latency, (select count(*) from runs r where r.channel = t.channel and not exists (select 1 from truth v where v.channel = r.channel and r.s <= v.e and r.e >= v.s)) as fp from truth t left join hit h on t.channel = h.channel and t.s = h.s group by t.channel)"
WILSON = "case when n > 0 then case when k = 0 then 0.0::double else greatest(0.0::double, ({c} - {h}) / {d}) end end as alarm_low, case when n > 0 then case when k = n then 1.0::double else least(1.0::double, ({c} + {h}) / {d}) end end as alarm_high".format(
    c="k::double / n + 3.8414588206941236::double / (2 * n)", h="1.959963984540054::double * sqrt(k::double / n * (1 - k::double / n) / n + 3.8414588206941236::double / (4.0::double * n * n))", d="(1 + 3.8414588206941236::double / n)"
)


def scores(cell: DataFrame, *more) -> DataFrame:
    return blocks.blended(blocks.block_stats(cell, ["vec_id", "label", *more]))


def marks(spark, sf) -> DataFrame:
    return scores(views.burst_cells(spark, sf), "truth").withColumn("detected", F.col("score") >= THRESHOLD)


def units(spark, sf) -> DataFrame:
    return blocks.frame_eval(marks(spark, sf), ["vec_id", "label"])


def alarm_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = cut(views.scored_series(spark, sf))  # read twice
    return sequences.runs(s.withColumn("alarm", F.col("score") >= 2.5), ["channel"]), views.truth_windows(s)


def zstream(spark, sf) -> DataFrame:
    return sequences.standardized(views.user_streams(spark, sf), ["user_id"], None, "x", 16).withColumn("live", F.col("step") >= 16)


@query(f"with {CELLS} select vec_id, label::bigint as label, block, round({BLEND}, 6) + 0.0 as score from cells group by vec_id, label, block")
def q_block_score(spark, sf):
    return scores(views.frame_cells(spark, sf)).select("vec_id", F.col("label").cast("long"), "block", r6("score"))


@query(f"with {CELLS} select vec_id, block, round(max(abs(x)), 6) + 0.0 as score from cells group by all")
def q_maxabs_score(spark, sf):
    return blocks.block_stats(views.frame_cells(spark, sf), ["vec_id"]).select("vec_id", "block", F.col("peak").alias("score")).select("vec_id", "block", r6("score"))


@query(f"with {MISSING} select vec_id, block, count(x) as observed, round(coalesce(max(abs(x)), 0), 6) + 0.0 as peak, round(coalesce(sqrt(avg(x * x)), 0), 6) + 0.0 as rms, round(coalesce(avg(abs(x)), 0), 6) + 0.0 as mean_abs, round(coalesce(avg(x), 0), 6) + 0.0 as mean from missing group by all")
def q_masked_stats(spark, sf):
    return blocks.block_stats(views.missing_cells(spark, sf), ["vec_id"]).select("vec_id", "block", "observed", *map(r6, ("peak", "rms", "mean_abs", "mean")))


@query(f"with {MARKS} select vec_id, count(case when detected then 1 end) as n, case when count(case when detected then 1 end) = 0 then 'STABLE' when count(case when detected then 1 end) = 1 then 'LOCALIZED_ALERT' when count(case when detected then 1 end) >= 4 then 'GLOBAL_SHOCK' else 'DISTRIBUTED_ALERT' end as status, coalesce(string_agg(block::varchar, ',' order by block) filter (detected), '') as blocks from marks group by vec_id")
def q_detect_status(spark, sf):
    out = marks(spark, sf).groupBy("vec_id").agg(F.count_if("detected").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("detected"), F.col("block")))).cast("array<string>"), ",").alias("blocks"))
    return out.withColumn("status", C.status(F.col("n"), 8))


@query(f"with {CELLS}, fit as (select block, vec_id, sqrt(avg(x * x)) as rms from cells where label < 4 group by all), c as (select block, median(rms) as centre from fit group by all) select block, round(any_value(centre), 6) + 0.0 as centre, round(greatest(1.4826::double * median(abs(rms - centre)), 1e-9::double), 6) + 0.0 as scale from fit join c using (block) group by block")
def q_baseline_median_mad(spark, sf):
    fit = blocks.block_stats(views.frame_cells(spark, sf).where("label < 4"), ["vec_id"])
    return blocks.centre_and_scale(fit, ["block"], "rms").select("block", r6("centre"), r6("scale"))


@query(f"with {CELLS}, st as (select label, block, vec_id, sqrt(avg(x * x)) as rms from cells group by all), c as (select block, median(rms) as centre from st where label < 4 group by all), b as (select block, any_value(centre) as centre, greatest(1.4826::double * median(abs(rms - centre)), 1e-9::double) as scale from st join c using (block) where label < 4 group by block) select vec_id, block, round(abs(rms - centre) / scale, 6) + 0.0 as score from st join b using (block)")
def q_zscore(spark, sf):
    stats = blocks.block_stats(views.frame_cells(spark, sf), ["vec_id", "label"])
    return blocks.robust_z(stats, stats.where("label < 4")).select("vec_id", "block", r6("score"))


@query(f"with {MISSING}, c as (select channel, median(x) as centre from missing where label < 4 group by all), b as (select channel, any_value(centre) as centre, greatest(1.4826::double * median(abs(x - centre)), 1e-9::double) as scale from missing join c using (channel) where label < 4 group by channel), r as (select vec_id, block, channel, abs(x - centre) / scale as r from missing join b using (channel)), p as (select *, row_number() over (partition by vec_id, block order by r desc nulls last, channel) as place from r) select vec_id, block, round(coalesce(0.45::double * sum(r) filter (place <= 4) / least(count(r), 4) + 0.35::double * sqrt(avg(case when r <= 1.345::double then 0.5::double * r * r else 1.345::double * (r - 0.6725::double) end)) + 0.2::double * median(r), 0), 6) + 0.0 as score from p group by all")
def q_robust_block(spark, sf):
    c = views.missing_cells(spark, sf)
    return blocks.robust_blocks(c, c.where("label < 4"), ["vec_id"]).select("vec_id", "block", r6("score"))


@query(f"with {CELLS}, s as (select vec_id, label, block, {BLEND} as score from cells where label in (4, 5) group by all), m as (select label, max(score) as top from s group by vec_id, label), p as (select *, row_number() over (partition by label order by top desc) as place, least(floor(0.05::double * count(*) over (partition by label) + 1e-9::double), count(*) over (partition by label) - 1) + 1 as pos from m) select label::bigint as label, round(top, 6) + 0.0 as cut from p where place = pos")
def q_calibrate(spark, sf):
    top = scores(views.frame_cells(spark, sf).where("label in (4, 5)")).groupBy("vec_id", "label").agg(F.max("score").alias("top"))
    return evaluation.cuts(top, ["label"], 0.05).select(F.col("label").cast("long"), r6("cut"))


@query(f"with {UNITS} select vec_id, hits, un as \"union\", n_detected, n_true, extra, round({IOU}, 6) + 0.0 as iou, hits = un as exact from units")
def q_frame_eval(spark, sf):
    return units(spark, sf).select("vec_id", "hits", "union", "n_detected", "n_true", "extra", r6("iou"), "exact")


@query(f"with {MARKS} select d.vec_id, min(abs(d.block - t.block)) as distance from (select distinct vec_id from marks) u join marks d using (vec_id) left join marks t on d.vec_id = t.vec_id and t.truth and d.detected group by d.vec_id")
def q_localization_error(spark, sf):
    return blocks.distance_to_truth(marks(spark, sf), "vec_id").select("vec_id", "distance")


EXPECT = "case label % 3 when 0 then 'none' when 1 then 'event_blocks' else 'all_blocks' end"
NEAR = "near as (select d.vec_id, min(abs(d.block - t.block)) as distance from marks d join marks t on d.vec_id = t.vec_id and t.truth and d.detected group by d.vec_id)"
SUMMARY = UNITS + f", {NEAR}, summary as (select label, {EXPECT} as expectation, count(*) as n, count(case when n_detected > 0 then 1 end) as k, avg((n_detected > 0)::int::double) as rate, avg((hits > 0)::int::double) as event_rate, avg((hits = un)::int::double) as exact, avg({IOU}) as iou, avg(distance) as dist, count(distance) as dists, avg((extra > 0)::int::double) as extra, avg(n_detected) as blocks, avg(n_detected / 8.0::double) as coverage, avg((n_detected * 2 > 8)::int::double) as majority, avg((n_detected = 8)::int::double) as alls, avg(top) as mean_top, min(top) as min_top, max(top) as max_top, count(case when n_detected = 0 then 1 end) as s0, count(case when n_detected = 1 then 1 end) as s1, count(case when n_detected between 2 and 3 then 1 end) as s2, count(case when n_detected >= 4 then 1 end) as s3 from units left join near using (vec_id) group by label)"
R26 = {"detection_rate": "rate", "detection_rate_ci95_low": "alarm_low", "detection_rate_ci95_high": "alarm_high", "false_positive_rate": "case when expectation = 'none' then rate end", "event_detection_rate": "case when expectation = 'event_blocks' then event_rate end", "exact_match_rate": "exact", "mean_overlap": "case when expectation <> 'none' then iou end", "mean_localization_error": "case when expectation = 'event_blocks' then dist end", "extra_block_rate": "extra", "mean_detected_blocks": "blocks", "mean_block_coverage": "coverage", "majority_blocks_rate": "majority", "all_blocks_rate": "alls", "zero_detection_rate": "1 - rate", "mean_maximum_score": "mean_top", "min_maximum_score": "min_top", "max_maximum_score": "max_top"}


def summaries(spark, sf) -> DataFrame:
    from ..operators.scorecard import summary, unit_eval
    from ..settings import Frames

    expectation = F.when(F.col("label") % 3 == 0, "none").when(F.col("label") % 3 == 1, "event_blocks").otherwise("all_blocks")
    return summary(unit_eval(marks(spark, sf), ["label", "vec_id"], Frames(64, 8)), ["label"], expectation, 8)


@query(f"with {SUMMARY}, w as (select *, {WILSON} from summary) select label::bigint as label, n as trials, expectation, {', '.join(f'round({v}, 6) + 0.0 as {k}' for k, v in R26.items())}, case when expectation = 'event_blocks' then dists end as localization_error_trials, s0 as status_stable, s1 as status_localized_alert, s2 as status_distributed_alert, s3 as status_global_shock from w")
def q_regime_summary(spark, sf):
    return summaries(spark, sf).select(F.col("label").cast("long"), "trials", "expectation", *map(r6, R26), "localization_error_trials", "status_stable", "status_localized_alert", "status_distributed_alert", "status_global_shock")


@query(f"with {SUMMARY}, w as (select *, {WILSON} from summary), c as (select label, 'false_positive_rate' as \"check\", rate as value, '<=' as op, 0.01::double as bound from w where expectation = 'none' union all select label, 'event_detection_rate', event_rate, '>=', 0.99 from w where expectation = 'event_blocks' union all select label, 'exact_match_rate', exact, '>=', 0.95 from w where expectation = 'event_blocks' union all select label, 'majority_blocks_rate', majority, '>=', 0.99 from w where expectation = 'all_blocks') select label::bigint as label, \"check\", round(value, 6) + 0.0 as value, op, bound, case when op = '<=' then value <= bound else value >= bound end as passed from c")
def q_expectations(spark, sf):
    from ..operators.scorecard import checks

    return checks(summaries(spark, sf), ["label"]).select(F.col("label").cast("long"), "check", r6("value"), "op", "bound", "passed")


@query(f"with {BURST}, s as (select vec_id, block, bool_or(truth) as truth, {BLEND} as score from burst group by all), g as (select unnest(range(0, 9)) as i), m as (select vec_id, round(0.2::double + i * 0.05::double, 10) as threshold, count(case when score >= round(0.2::double + i * 0.05::double, 10) then 1 end) as n, count(case when (score >= round(0.2::double + i * 0.05::double, 10)) <> truth then 1 end) as wrong from s cross join g group by vec_id, i) select threshold, count(case when n > 0 then 1 end) as alarms, round(avg(n), 6) + 0.0 as mean_blocks, round(avg((wrong = 0)::int::double), 6) + 0.0 as exact_rate from m group by threshold")
def q_threshold_sweep(spark, sf):
    grid = F.explode(F.array(*(F.lit(round(0.2 + i * 0.05, 10)) for i in range(9)))).alias("threshold")
    s = scores(views.burst_cells(spark, sf), "truth").select("vec_id", "truth", "score", grid)
    m = s.groupBy("vec_id", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n"), F.count_if((F.col("score") >= F.col("threshold")) != F.col("truth")).alias("wrong"))
    return m.groupBy("threshold").agg(F.count_if(F.col("n") > 0).alias("alarms"), F.avg("n").alias("mean_blocks"), C.rate(F.col("wrong") == 0).alias("exact_rate")).select("threshold", "alarms", r6("mean_blocks"), r6("exact_rate"))


@query("select vec_id, unnest(range((vec_id % 60) // 8, (vec_id % 60 + vec_id % 5) // 8 + 1)) as block from embeddings")
def q_event_blocks(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 60).alias("start"), (F.col("vec_id") % 60 + F.col("vec_id") % 5 + 1).alias("stop"))
    return e.select("vec_id", F.explode(blocks.block_range(F.col("start"), F.col("stop"), 8)).alias("block"))


@query(f"with {ZUSERS} select user_id, step, round(z, 6) + 0.0 as z from z")
def q_standardize_warmup(spark, sf):
    return zstream(spark, sf).select("user_id", "step", r6("z"))


TYPES = "got as (select user_id % 10 as stream, (ts::date - date '2024-01-01')::bigint as step, event_type as block, sum(value) as x, least(count(*), 4) as n from events group by all), grid as (select a.stream, b.block, unnest(range(0, (select max(step) + 1 from got))) as step from (select distinct stream from got) a cross join (select distinct block from got) b), ty as (select grid.stream, grid.step, grid.block, got.x, coalesce(got.n, 0) as n from grid left join got using (stream, step, block))"
#: Weighted standardisation: residuals by the root of the share of 4 that is observed.
WEIGHTED = TYPES + ", wm as (select stream, block, avg(x) as mu from ty where step < 8 group by all), wr as (select ty.*, mu, (x - mu) * sqrt(n / 4.0::double) as r from ty join wm using (stream, block)), ws as (select stream, greatest(sqrt(coalesce(sum(r * r) filter (step < 8), 0) / greatest(count(r) filter (step < 8) - count(distinct case when mu is not null then block end), 1)), 1e-9::double) as sigma from wr group by stream), wz as (select wr.stream, step, block, case when step < 8 then 0.0::double else coalesce(r / sigma, 0) end as z from wr join ws using (stream))"


@query(f"with {WEIGHTED} select stream, step, block, round(z, 6) + 0.0 as z from wz")
def q_standardize_masked(spark, sf):
    return sequences.weighted(views.type_streams(spark, sf), ["stream"], "block", "x", "observed", 4, 8).select("stream", "step", "block", r6("z"))


@query(f"with {ZUSERS} select a.user_id, a.step, round(abs(sum(0.2::double * pow(0.8::double, a.step - b.step) * b.z)) / sqrt(0.2::double / 1.8::double), 6) + 0.0 as ewma from z a join z b on a.user_id = b.user_id and b.step <= a.step group by a.user_id, a.step")
def q_ewma(spark, sf):
    return sequences.ewma(zstream(spark, sf), ["user_id"]).select("user_id", "step", r6("ewma"))


@query(f"with {ZUSERS}, p as (select user_id, step, sum(case when step >= 16 then z - 0.5::double else 0 end) over w as up, sum(case when step >= 16 then -z - 0.5::double else 0 end) over w as dn from z window w as (partition by user_id order by step)) select a.user_id, a.step, round(greatest(0, max(a.up - b.up), max(a.dn - b.dn), a.up, a.dn), 6) + 0.0 as cusum from p a join p b on a.user_id = b.user_id and b.step <= a.step group by a.user_id, a.step, a.up, a.dn")
def q_cusum(spark, sf):
    return sequences.cusum(zstream(spark, sf), ["user_id"]).select("user_id", "step", r6("cusum"))


CHANGE = ZUSERS + ", zs as (select user_id, step, z from z where step >= 16), k as (select user_id, 15::bigint as step, 0.0::double as off, 0.0::double as up, 0.0::double as dn, []::double[] as h, 0.0::double as score from (select distinct user_id from zs) union all select user_id, step, case when hit then off + list_sum(h) / 3 else off end, case when hit then 0 else up end, case when hit then 0 else dn end, case when hit then [] else h end, greatest(up, dn, p / 0.8::double) from (select *, p >= 0.8::double as hit from (select *, case when len(h) = 3 then 1 / (1 + exp(-greatest(-700.0::double, least(700.0::double, -0.5::double * ln(13.0::double) + 0.5::double * 4 / 13 * list_sum(h) * list_sum(h) + ln(1 / 200.0::double) - ln(1 - 1 / 200.0::double))))) else 0 end as p from (select zs.user_id, zs.step, k.off, greatest(0, k.up + zs.z - k.off - 0.5::double) as up, greatest(0, k.dn - (zs.z - k.off) - 0.5::double) as dn, list_append(case when len(k.h) = 3 then k.h[2:3] else k.h end, zs.z - k.off) as h from k join zs on zs.user_id = k.user_id and zs.step = k.step + 1))))"


@query(f"with recursive {CHANGE} select user_id, step, round(score, 6) + 0.0 as score from k where step > 15")
def q_cusum_changepoint(spark, sf):
    return sequences.changepoint_cusum(zstream(spark, sf).where("live"), ["user_id"]).select("user_id", "step", r6("score"))


@query(f"with {SCORED} select channel, t, round(0.45::double * max(abs(z)) over w + 0.35::double * sqrt(avg(z * z) over w) + 0.2::double * avg(abs(z)) over w, 6) + 0.0 as score from scored window w as (partition by channel, split order by t rows between 31 preceding and current row)")
def q_trailing_window_score(spark, sf):
    w, z = sequences.trailing(["channel", "split"], 32), F.col("z")
    s = views.scored_series(spark, sf).withColumn("score", C.BLEND[0] * F.max(F.abs(z)).over(w) + C.BLEND[1] * F.sqrt(F.avg(z * z).over(w)) + C.BLEND[2] * F.avg(F.abs(z)).over(w))
    return s.select("channel", "t", r6("score"))


@query(f"with {DAILY}, d as (select channel, t, x, first_value(x) over (partition by channel order by t) as x0, list(x) over (partition by channel order by t rows between 15 preceding and current row) as l from daily), p as (select channel, t, list_concat(list_transform(range(0, 16 - len(l)), lambda i: x0), l) as a from d) select channel, t, round(list_avg(a), 6) + 0.0 as mean, round(list_median(a), 6) + 0.0 as median, round(list_max(a), 6) + 0.0 as max, round(list_avg(list_reverse_sort(a)[1:3]), 6) + 0.0 as top3 from p")
def q_window_agg_topk(spark, sf):
    s = views.daily_series(spark, sf).withColumn("a", sequences.padded(["channel"], "x", 16))
    out = {"mean": sequences.array_mean(F.col("a")), "median": sequences.array_median(F.col("a")), "max": F.array_max("a"), "top3": sequences.array_mean(F.slice(F.sort_array("a", False), 1, 3))}
    return s.select("channel", "t", *((F.round(v, 6) + 0.0).alias(k) for k, v in out.items()))


@query(f"with {SCORED}, d as (select channel, t, z, first_value(z) over (partition by channel order by t) as z0, list(z) over (partition by channel order by t rows between 63 preceding and current row) as l from scored), p as (select channel, t, z, list_concat(list_transform(range(0, 64 - len(l)), lambda i: z0), l) as a from d), m as (select *, list_median(a) as med from p) select channel, t, round(abs(z - med) / greatest(1.4826::double * list_median(list_transform(a, lambda v: abs(v - med))), 1), 6) + 0.0 as score from m")
def q_rolling_mad(spark, sf):
    s = views.scored_series(spark, sf).withColumn("a", sequences.padded(["channel"], "z", 64))
    s = s.withColumn("med", sequences.array_median(F.col("a")))
    mad = sequences.array_median(F.transform("a", lambda v: F.abs(v - F.col("med"))))
    return s.withColumn("score", F.abs(F.col("z") - F.col("med")) / F.greatest(1.4826 * mad, F.lit(1.0))).select("channel", "t", r6("score"))


@query(f"with {SCORED} select channel, t, split, round(z, 6) + 0.0 as z from scored")
def q_train_standardize(spark, sf):
    return views.scored_series(spark, sf).select("channel", "t", "split", r6("z"))


@query(f"with {SCORED}, p as (select channel, score, row_number() over (partition by channel order by score desc) as place, least(floor(0.01::double * count(*) over (partition by channel) + 1e-9::double), count(*) over (partition by channel) - 1) + 1 as pos from scored where split = 'train') select channel, round(score, 6) + 0.0 as cut from p where place = pos")
def q_train_threshold(spark, sf):
    return evaluation.cuts(views.scored_series(spark, sf).where("split = 'train'"), ["channel"], 0.01, "score").select("channel", r6("cut"))


@query(f"with {SCORED}, m as (select channel, median(score) as c from scored where split = 'train' group by all) select channel, round(quantile_cont(score, 0.995), 6) + 0.0 as quantile, round(any_value(c) + 3 * 1.4826::double * median(abs(score - c)), 6) + 0.0 as robust from scored join m using (channel) where split = 'train' group by channel")
def q_threshold_rules(spark, sf):
    s = views.scored_series(spark, sf).where("split = 'train'")
    base = blocks.centre_and_scale(s, ["channel"], "score", 0.0)
    return s.groupBy("channel").agg(F.percentile("score", 0.995).alias("quantile")).join(base, "channel").withColumn("robust", F.col("centre") + 3 * F.col("scale")).select("channel", r6("quantile"), r6("robust"))


@query(f"with {RUNS} select channel, s as start, e as \"end\" from runs")
def q_alarm_runs(spark, sf):
    return alarm_runs(spark, sf)[0].select("channel", "start", "end")


HYST = SCORED + ", low as (select channel, t, score, t - row_number() over (partition by channel order by t) as g from scored where score > 0.6::double * 2.5::double), hr as (select channel, min(t) as s, max(t) as e from low group by channel, g having max(score) > 2.5::double), fl as (select *, case when s - lag(e) over (partition by channel order by s) - 1 > 3 then 1 else 0 end as new from hr), gr as (select *, sum(new) over (partition by channel order by s) as g from fl), mg as (select channel, min(s) as s, max(e) as e from gr group by channel, g having max(e) - min(s) + 1 >= 2)"


def hysteresis_runs(spark, sf) -> DataFrame:
    s = views.scored_series(spark, sf).withColumn("threshold", F.lit(2.5))
    return sequences.merged_gaps(sequences.hysteresis(s, ["channel"], 0.6), ["channel"], 3, 2)


@query(f"with {HYST} select channel, s as start, e as \"end\" from mg")
def q_hysteresis_merge(spark, sf):
    return hysteresis_runs(spark, sf).select("channel", "start", "end")


@query(f"with recursive {HYST}, o as (select channel, s, e, row_number() over (partition by channel order by s) as i from mg), k as (select channel, i, s, e, true as kept, e as last from o where i = 1 union all select o.channel, o.i, o.s, o.e, o.s - k.last > 20, case when o.s - k.last > 20 then o.e else k.last end from k join o on o.channel = k.channel and o.i = k.i + 1) select channel, s as start, e as \"end\" from k where kept")
def q_cooldown(spark, sf):
    return sequences.cooled(hysteresis_runs(spark, sf), ["channel"], 20).select("channel", "start", "end")


@query(f"with {TRUTH}, w as (select channel, s, e, class from truth union all select channel, s + (s // 100) % 3 * 10, e + (s // 100) % 4 * 12, 'extra' from truth), f as (select *, case when s <= max(e) over (partition by channel order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as new from w), g as (select *, sum(new) over (partition by channel order by s, e rows unbounded preceding) as g from f) select channel, min(s) as start, max(e) as \"end\", array_to_string(list_sort(list(distinct class)), '+') as class from g group by channel, g")
def q_merge_windows(spark, sf):
    w = alarm_runs(spark, sf)[1]
    k = F.floor(F.col("start") / 100)
    more = w.select("channel", (F.col("start") + k % 3 * 10).alias("start"), (F.col("end") + k % 4 * 12).alias("end"), F.lit("extra").alias("class"))
    return sequences.merged_windows(w.unionByName(more), ["channel"]).select("channel", "start", "end", "class")


@query(f"with {CHANNELS} select channel, rs as run_start, re as run_end, s as start, class from pairs")
def q_event_match(spark, sf):
    return evaluation.matches(*alarm_runs(spark, sf), ["channel"]).select("channel", "run_start", "run_end", "start", "class")


@query(f"with {CHANNELS} select channel, events, tp, duplicates, latency, fp, events - tp as fn from chan")
def q_channel_metrics(spark, sf):
    return evaluation.channel_metrics(*alarm_runs(spark, sf), ["channel"]).select("channel", "events", "tp", "duplicates", "latency", "fp", "fn")


PRF = "round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 6) + 0.0 as \"precision\", round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 6) + 0.0 as recall, round(case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 6) + 0.0 as f1"


@query(f"with {CHANNELS}, g as (select left(channel, 1) as grp, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(events - tp)::bigint as fn from chan group by grouping sets ((left(channel, 1)), ())) select coalesce(grp, 'all') as grp, tp, fp, fn, {PRF} from g")
def q_pooled_metrics(spark, sf):
    m = evaluation.channel_metrics(*alarm_runs(spark, sf), ["channel"]).withColumn("grp", F.substring("channel", 1, 1))
    return evaluation.pooled(m, ["grp"]).select(F.coalesce("grp", F.lit("all")).alias("grp"), "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(f"with {CHANNELS} select t.class, count(*) as events, round(avg((h.s is not null)::int::double), 6) + 0.0 as recall from truth t left join hit h on t.channel = h.channel and t.s = h.s group by t.class")
def q_recall_by_class(spark, sf):
    r, e = alarm_runs(spark, sf)
    hit = evaluation.matches(r, e, ["channel"]).select("channel", "start").distinct().withColumn("hit", F.lit(1.0))
    return e.join(hit, ["channel", "start"], "left").groupBy("class").agg(F.count("*").alias("events"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")).select("class", "events", r6("recall"))


@query(f"with {ZUSERS} , s as (select user_id, abs(z) as score from z where step >= 16), b as (select user_id, quantile_cont(score, 0.8) as u, quantile_cont(score, 0.99) as emp, count(*) as n from s group by all), o as (select user_id, count(*) as k, avg(score - u) as mean, var_pop(score - u) as v from s join b using (user_id) where score > u group by all), f as (select *, case when v <= 1e-18::double then 0 else greatest(-0.45::double, least(0.45::double, 0.5::double * (1 - mean * mean / v))) end as xi from b left join o using (user_id)), g as (select *, mean * (1 - xi) as beta, ln(k::double / n / 0.01::double) as lg from f), t as (select *, u + case when abs(xi) < 1e-6::double then beta * lg else beta * (exp(lg * xi) - 1) / xi end as raw from g) select user_id, round(greatest(u, case when coalesce(k, 0) < 5 then emp when xi < 0 then least(raw, u - beta / xi) else raw end), 5) + 0.0 as threshold from t")
def q_pot_fit(spark, sf):
    s = zstream(spark, sf).where("live").select("user_id", F.abs("z").alias("score"))
    return evaluation.pot_threshold(s, ["user_id"], 0.8, 0.01, 5).select("user_id", (F.round("threshold", 5) + 0.0).alias("threshold"))


MISS = MISSING + f", ms as (select vec_id, label, block, coalesce({BLEND}, 0) as score from missing group by all), mu as (select label, max(score) >= {THRESHOLD}::double as hit from ms group by vec_id, label), c2 as (select label, block, vec_id, {BLEND} as score from cells group by all), cu as (select label, max(score) >= {THRESHOLD}::double as hit from c2 group by vec_id, label), a as (select label, count(*) as n, count(case when hit then 1 end) as k from mu group by label), c as (select label, count(*) as n, count(case when hit then 1 end) as k from cu group by label), aw as (select *, k::double / n as r, {WILSON} from a), cw as (select *, k::double / n as r, {WILSON} from c)"


@query(f"with {MISS} select a.label::bigint as label, round(a.r - c.r, 6) + 0.0 as inflation, case when c.r <> 0 then round(a.r / c.r, 6) + 0.0 end as retention, case when a.alarm_low > c.alarm_high then 'higher' when a.alarm_high < c.alarm_low then 'lower' else 'n.s.' end as change from aw a left join cw c using (label)")
def q_robustness(spark, sf):
    def summary(cell):
        top = scores(cell).groupBy("vec_id", "label").agg(F.max("score").alias("top"))
        k = top.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= THRESHOLD).alias("alarms"))
        low, high = C.wilson(F.col("alarms"), F.col("n"))
        return k.withColumns({"alarm_rate": F.col("alarms") / F.col("n"), "alarm_low": low, "alarm_high": high})

    out = evaluation.robustness(summary(views.missing_cells(spark, sf)), summary(views.frame_cells(spark, sf)), ["label"])
    return out.select(F.col("label").cast("long"), r6("inflation"), r6("retention"), "change")


@query(f"with {CHANNELS}, p as (select channel as name, (fp + 1)::double / (20 * (tp + 3)) as p from chan), o as (select *, row_number() over (order by p, name) as i, count(*) over () as m from p) select name, round(p, 6) + 0.0 as p, round(max(least(1.0::double, (m - i + 1) * p)) over (order by p, name), 6) + 0.0 as adjusted from o")
def q_holm(spark, sf):
    m = evaluation.channel_metrics(*alarm_runs(spark, sf), ["channel"]).select(F.lit("all").alias("family"), F.col("channel").alias("name"), ((F.col("fp") + 1) / (20 * (F.col("tp") + 3))).alias("p"))
    return evaluation.holm(m, ["family"]).select("name", r6("p"), r6("adjusted"))


REPLAY = "rp as (select row_number() over (order by ts, event_id) - 1 as t, ts, case when day(ts) % 2 = 0 then 'even' else 'odd' end as regime, case when event_type = 'error' then strftime(ts, '%Y-%m-%d-') || (hour(ts) // 6)::varchar end as ev, value >= 60 as alarm, user_id % 8 as tb, (user_id + (value >= 80)::int) % 8 as fb from events)"


def replay_outputs(r: DataFrame) -> DataFrame:
    """Alarms from 60 on; the flagged block is the next one from 80 on."""
    alarm = F.col("x") >= 60.0
    return r.select(F.lit("level").alias("detector"), "line", alarm.alias("alarm"), F.when(alarm, F.array((F.col("user_id") + (F.col("x") >= 80.0).cast("int")) % 8)).otherwise(F.array().cast("array<bigint>")).alias("flagged"))


@query(f"with {REPLAY}, st as (select quantile_cont(d, 0.5) as step from (select (epoch_us(ts) - epoch_us(lag(ts) over (order by t))) / 1e6::double as d from rp)), ex as (select regime, sum((epoch_us(b) - epoch_us(a)) / 1e6::double) + count(*) * any_value(step) as exposure from (select regime, g, min(ts) as a, max(ts) as b from (select *, t - row_number() over (partition by regime order by t) as g from rp) group by regime, g) cross join st group by regime), e as (select regime, ev, min(t) as t0, min(ts) as a, min(case when alarm then ts end) as b from rp where ev is not null group by regime, ev), es as (select regime, count(*) as events, count(b) as found, coalesce(string_agg(ev, ';' order by t0) filter (b is null), '') as missed, avg((epoch_us(b) - epoch_us(a)) / 1e3::double) as mean_ms, quantile_cont((epoch_us(b) - epoch_us(a)) / 1e3::double, 0.5) as median_ms from e group by regime), f as (select regime, count(distinct g) as episodes from (select regime, t - row_number() over (partition by regime order by t) as g from rp where ev is null and alarm) group by regime), c as (select regime, count(*) as frames, count(ev) as event_frames, count(case when alarm then 1 end) as alarms, count(case when ev is null and alarm then 1 end) as fpf, count(case when ev is not null and alarm and tb = fb then 1 end) as tp, count(case when alarm and not (ev is not null and tb = fb) then 1 end) as fp, count(case when ev is not null and not (alarm and tb = fb) then 1 end) as fn from rp group by regime) select c.regime, frames as frame_count, event_frames as event_frame_count, alarms as alarm_frame_count, frames - event_frames as no_event_frame_count, fpf as false_positive_frame_count, events as event_count, found as detected_event_count, events - found as missed_event_count, missed as missed_event_ids, round(found::double / events, 6) + 0.0 as event_recall, round(fpf::double / (frames - event_frames), 6) + 0.0 as false_positive_frame_rate, round(fpf * 600.0::double / exposure, 6) + 0.0 as false_positive_frames_per_10min, episodes as false_positive_alarm_episode_count, round(episodes * 600.0::double / exposure, 6) + 0.0 as false_positive_alarm_episodes_per_10min, round(exposure, 3) + 0.0 as observed_exposure_seconds, tp as tp_blocks, fp as fp_blocks, fn as fn_blocks, round(tp::double / (tp + fp), 6) + 0.0 as localization_precision, round(tp::double / (tp + fn), 6) + 0.0 as localization_recall, round(tp::double / (tp + fp + fn), 6) + 0.0 as localization_iou, round(mean_ms, 3) + 0.0 as mean_latency_ms, round(median_ms, 3) + 0.0 as median_latency_ms from c join es using (regime) join f using (regime) join ex using (regime)")
def q_replay_metrics(spark, sf):
    from ..operators.replay import metrics

    r = views.replay(spark, sf)
    whole = ("frame_count", "event_frame_count", "alarm_frame_count", "no_event_frame_count", "false_positive_frame_count", "event_count", "detected_event_count", "missed_event_count", "false_positive_alarm_episode_count", "tp_blocks", "fp_blocks", "fn_blocks")
    out = metrics(r, replay_outputs(r)).withColumn("missed_event_ids", F.array_join("missed_event_ids", ";"))
    r3 = lambda c: (F.round(c, 3) + 0.0).alias(c)
    return out.select("regime", "missed_event_ids", *whole, *map(r6, ("event_recall", "false_positive_frame_rate", "false_positive_frames_per_10min", "false_positive_alarm_episodes_per_10min", "localization_precision", "localization_recall", "localization_iou")), *map(r3, ("observed_exposure_seconds", "mean_latency_ms", "median_latency_ms")))


@query(f"with {DAILY}, n as (select channel, count(*) as n from daily group by all) select channel, t, case when t < n - floor(0.3::double * n) - 128 then 'fit' when t >= n - floor(0.3::double * n) then 'val' else 'gap' end as part from daily join n using (channel)")
def q_chrono_split(spark, sf):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("channel"))
    val = F.floor(0.3 * n)
    return views.daily_series(spark, sf).select("channel", "t", F.when(F.col("t") < n - val - 128, "fit").when(F.col("t") >= n - val, "val").otherwise("gap").alias("part"))


@query("select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by all")
def q_stream_window_alarms(spark, sf):
    from ..streaming.windows import windowed

    return windowed(views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))


@query()
def q_pot_online(spark, sf):
    from ..streaming.pot import replayed

    s = zstream(spark, sf).where("live").select("user_id", "step", F.abs("z").alias("score"))
    return replayed(s, "user_id", "step", window=120, initial=0.9, risk=0.01, least=5).select("user_id", "step", r6("threshold"), "flagged")


@query()
def q_generate_frames(spark, sf):
    from ..sources.scenarios import frames

    return frames(spark, 200, seed=42)


HYBRID = ZUSERS + ", ew as (select a.user_id, a.step, abs(a.z) as frame, abs(sum(0.2::double * pow(0.8::double, a.step - b.step) * b.z)) / sqrt(0.2::double / 1.8::double) as ewma from z a join z b on a.user_id = b.user_id and b.step <= a.step group by a.user_id, a.step, a.z), tops as (select user_id, max(frame) as f, max(ewma) as e from ew where user_id % 2 = 0 group by all), c as (select quantile_cont(f, 0.99) as c1, quantile_cont(e, 0.99) as c2 from tops)"


@query(f"with {HYBRID} select user_id, step, round(greatest(frame / c1, ewma / c2), 6) + 0.0 as score from ew cross join c")
def q_hybrid(spark, sf):
    s = sequences.ewma(zstream(spark, sf), ["user_id"]).withColumn("frame", F.abs("z"))
    scale = s.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("frame").alias("f"), F.max("ewma").alias("e")).agg(F.percentile("f", 0.99).alias("c1"), F.percentile("e", 0.99).alias("c2"))
    return s.join(F.broadcast(scale)).select("user_id", "step", (F.round(F.greatest(F.col("frame") / F.col("c1"), F.col("ewma") / F.col("c2")), 6) + 0.0).alias("score"))


STREAM = TYPES + ", m as (select stream, block, avg(x) as mu from ty where step < 8 group by all), sg as (select stream, sqrt(sum((x - mu) * (x - mu)) / greatest(count(x - mu) - count(distinct case when x is not null then block end), 1)) as sigma from ty join m using (stream, block) where step < 8 group by stream), mk as (select stream, step, block, case when stream % 2 = 1 then 15 + stream % 5 end as onset, coalesce(stream % 2 = 1 and block = 'error' and step >= 15 + stream % 5, false) as truth, abs(case when step < 8 then 0.0::double else coalesce((x - mu) / greatest(sigma, 1e-9::double), 0) end + case when stream % 2 = 1 and block = 'error' and step >= 15 + stream % 5 then 4.0::double else 0 end) >= 2.5::double and step >= 8 as alarm from ty join m using (stream, block) join sg using (stream)), sp as (select stream, step, any_value(onset) as onset, bool_or(alarm) as hot, bool_or(alarm and truth) as tr, count(case when alarm and truth then 1 end) as bo, count(case when alarm or truth then 1 end) as ei from mk group by all), fs as (select stream, min(step) as fst from sp where hot and (onset is null or step >= onset) group by all)"


@query(f"with {STREAM} select sp.stream, bool_or(hot) as any_alarm, coalesce(bool_or(hot and step < onset), false) as pre_alarm, count(case when tr and (onset is null or step >= onset) then 1 end) > 0 as hit, (min(case when tr and (onset is null or step >= onset) then step end) - any_value(onset))::bigint as latency, coalesce(bool_or(step = fst and bo = ei), false) as exact, round(coalesce(max(case when step = fst then bo::double / ei end), 0), 6) + 0.0 as iou from sp left join fs on sp.stream = fs.stream group by sp.stream")
def q_stream_outcomes(spark, sf):
    from ..operators.outcomes import stream_outcomes

    s = sequences.standardized(views.type_streams(spark, sf), ["stream"], "block", "x", 8)
    onset = F.when(F.col("stream") % 2 == 1, 15 + F.col("stream") % 5)
    truth = F.coalesce((F.col("block") == "error") & (F.col("step") >= onset), F.lit(False))
    marks_ = s.withColumn("onset", onset).withColumn("truth", truth).withColumn("alarm", F.abs(F.col("z") + F.when(F.col("truth"), 4.0).otherwise(0.0)) >= 2.5)
    return stream_outcomes(marks_, "stream", 8).select("stream", "any_alarm", "pre_alarm", "hit", "latency", "exact", r6("iou"))


@query(f"with {TRUTH}, ins as (select s.channel, s.t, v.s, s.score >= 2.5::double as alarm from scored s join truth v on s.channel = v.channel and s.t between v.s and v.e), tc as (select *, bool_or(alarm) over (partition by channel, s) as touched from ins), g as (select channel, count(case when alarm then 1 end) as tp, count(case when not alarm then 1 end) as fn, count(case when touched then 1 end) as pa_tp, count(case when not touched then 1 end) as pa_fn from tc group by channel), al as (select channel, count(*) as n, count(case when score >= 2.5::double then 1 end) as a from scored group by channel) select channel, n, tp, a - tp as fp, fn, pa_tp, pa_fn from al join g using (channel)")
def q_channel_eval_v2(spark, sf):
    from ..operators.outcomes import point_metrics

    s = views.scored_series(spark, sf)
    return point_metrics(s.withColumn("alarm", F.col("score") >= 2.5), views.truth_windows(s), ["channel"])


ATLAS = RUNS + ", cases as (select v.channel, 'FN' as kind, v.s, v.e, max(score) as top from scored c join truth v on c.channel = v.channel and c.t between v.s and v.e group by all union all select r.channel, 'FP', r.s, r.e, max(score) from runs r join scored c on c.channel = r.channel and c.t between r.s and r.e where not exists (select 1 from truth v where v.channel = r.channel and r.s <= v.e and r.e >= v.s) group by all), rm as (select channel, median(z) as m from scored where split = 'train' group by all), rs as (select channel, 1.4826::double * median(abs(z - m)) as rsd from scored join rm using (channel) where split = 'train' group by all), nr as (select k.channel, k.kind, k.s, k.e, c.t, c.z, c.t >= k.s as seg, c.t < k.s and c.t >= k.s - 128 as pre from cases k join scored c on c.channel = k.channel and c.t between greatest(k.s - 256, 0) and k.e), ag as (select channel, kind, s, e, max(z) filter (seg) - min(z) filter (seg) as spread, count(*) filter (seg) as n, regr_slope(case when seg then z end, case when seg then t::double end) as slope, avg(z) filter (seg) as mean, stddev_pop(z) filter (seg) as sd, avg(z) filter (pre) as pmean, count(*) filter (pre) as pn, median(z) filter (pre) as pm, list(z order by t) filter (t < s) as past from nr group by all), pd as (select nr.channel, nr.kind, nr.s, 1.4826::double * median(abs(z - pm)) filter (pre) as pmad from nr join ag using (channel, kind, s) group by all), ac as (select *, list_sum(list_transform(c, lambda v: v * v)) as zz from (select *, list_transform(past, lambda v: v - list_avg(past)) as c from ag)), pr as (select *, case when len(c) > 70 and zz > 0 then list_max(list_transform(range(1, 65), lambda k: list_inner_product(c[1:len(c) - k], c[k + 1:len(c)]))) / zz end as periodic from ac), atlas as (select k.channel, k.kind, k.s, k.e, k.top, case when rsd = 0 or spread = 0 then 'data-quality issue' when k.e - k.s + 1 <= 5 then 'isolated spike' when k.kind = 'FN' and k.top >= 3.2::double then 'threshold miss' when n >= 3 and abs(slope) * n >= 2 * rsd then 'drift' when pn > 0 and abs(mean - pmean) >= 2 * rsd then 'regime shift' when pn > 1 and sd >= 2 * greatest(pmad, 1e-12::double) then 'noisy segment' when periodic >= 0.5 then 'periodic mismatch' when k.kind = 'FN' then 'score failure' else 'unknown' end as category from cases k join pr using (channel, kind, s) join pd using (channel, kind, s) join rs using (channel))"


def atlas(spark, sf) -> DataFrame:
    from ..operators import search

    s = cut(views.scored_series(spark, sf))
    spans, events = sequences.runs(s.withColumn("alarm", F.col("score") >= 2.5), ["channel"]), views.truth_windows(s)
    named = lambda df: df.withColumn("dataset", F.lit("orders"))
    every = search.event_matches(named(spans), named(events), named(s))
    cases = every.where("kind = 'event' or not matched").select("dataset", "channel", F.when(F.col("kind") == "event", "FN").otherwise("FP").alias("kind"), "start", "end", "max_score", F.lit(4.0).alias("threshold"))
    rows = named(s.where("split = 'train'").select("channel", F.lit("train").alias("split"), "t", F.col("z").alias("x")).unionByName(s.select("channel", F.lit("test").alias("split"), "t", F.col("z").alias("x"))))
    return search.categories(cases, rows)


@query(f"with {ATLAS} select channel, kind, s as start, round(top, 6) + 0.0 as top, category from atlas")
def q_failure_atlas(spark, sf):
    return atlas(spark, sf).select("channel", "kind", "start", (F.round("max_score", 6) + 0.0).alias("top"), "category")


@query(f"with {ATLAS} select kind, category, count(*) as n from atlas group by all order by n desc, kind, category limit 5")
def q_failure_patterns(spark, sf):
    from ..operators.search import patterns

    return patterns(atlas(spark, sf))


@query(f"with {RUNS} select v.channel, 'event' as kind, v.s as start, v.e as \"end\", (select count(*) from runs r where r.channel = v.channel and r.s <= v.e and r.e >= v.s) as n_matches, round((select max(score) from scored c where c.channel = v.channel and c.t between v.s and v.e), 6) + 0.0 as max_score from truth v union all select r.channel, 'alert', r.s, r.e, (select count(*) from truth v where r.channel = v.channel and r.s <= v.e and r.e >= v.s), round((select max(score) from scored c where c.channel = r.channel and c.t between r.s and r.e), 6) + 0.0 from runs r")
def q_event_listing(spark, sf):
    from ..operators.search import event_matches

    s = views.scored_series(spark, sf).withColumn("dataset", F.lit("orders"))
    spans = sequences.runs(s.withColumn("alarm", F.col("score") >= 2.5), ["dataset", "channel"])
    return event_matches(spans, views.truth_windows(s).withColumn("dataset", F.lit("orders")), s).select("channel", "kind", "start", "end", "n_matches", r6("max_score"))


GRID = [(i, t, n) for i, (t, n) in enumerate((t, n) for t in (2.0, 2.5, 3.0, 3.5) for n in (1, 2, 3))]


@query(f"with {TRUTH}, grid as (select * from (values {', '.join(f'({i}, {t}::double, {n})' for i, t, n in GRID)}) g(trial, threshold, least)), rn as (select trial, channel, min(t) as s, max(t) as e from (select trial, least, channel, t, t - row_number() over (partition by trial, channel order by t) as g from scored cross join grid where score >= threshold) group by trial, channel, g, least having max(t) - min(t) + 1 >= least), ch as (select distinct channel from truth), pc as (select trial, channel, (select count(*) from truth v where v.channel = ch.channel and exists (select 1 from rn r where r.trial = grid.trial and r.channel = v.channel and r.s <= v.e and r.e >= v.s)) as tp, (select count(*) from rn r where r.trial = grid.trial and r.channel = ch.channel and not exists (select 1 from truth v where r.channel = v.channel and r.s <= v.e and r.e >= v.s)) as fp, (select count(*) from truth v where v.channel = ch.channel) as ev, (case when threshold <> 2.0 then 1 else 0 end + case when least <> 1 then 1 else 0 end) as cx from grid cross join ch), f as (select trial, any_value(cx) as cx, sum(tp)::bigint as tp, sum(fp)::bigint as fp, avg(case when tp > 0 then 2.0::double * tp / (tp + fp + ev) else 0 end) as macro, case when sum(tp) > 0 then 2.0::double * sum(tp) / (sum(tp) + sum(fp) + sum(ev)) else 0 end as f1, case when sum(tp) + sum(fp) > 0 then sum(tp)::double / (sum(tp) + sum(fp)) else 0 end as prec from pc group by trial) select trial::bigint as trial, tp, fp, round(f1, 6) + 0.0 as f1, round(prec, 6) + 0.0 as \"precision\", round(macro, 6) + 0.0 as macro_f1, row_number() over (order by round(f1, 3) desc, cx, prec desc, macro desc, fp, trial) as place from f qualify place <= 5")
def q_config_rank(spark, sf):
    from ..operators.outcomes import ranked, trials

    s = views.scored_series(spark, sf)
    return ranked(trials(s, views.truth_windows(s), GRID), 5).select(F.col("trial").cast("long"), "tp", "fp", r6("f1"), r6("precision"), r6("macro_f1"), "place")


@query(f"with {REPLAY}, l as (select t, ts, lag(ts) over (order by t) as before, ev, lag(ev) over (order by t) as last from rp) select count(case when ts <= before then 1 end) as unordered, count(case when ev is not null then 1 end) as event_frames, count(case when ev is not null and ev is distinct from last then 1 end) as runs, (select count(*) from (select ev from l where ev is not null and ev is distinct from last group by ev having count(*) > 1)) as parted from l")
def q_episode_validate(spark, sf):
    from ..sources.files import replay_faults

    r = views.replay(spark, sf).withColumns({"event_label": F.lit("error"), "incumbent_flags": F.lit(None).cast("array<boolean>"), "incumbent_alarm": F.lit(None).cast("boolean")})
    faults = replay_faults(r).groupBy().pivot("fault", ["order", "parted"]).agg(F.first("n"))
    last = r.select((F.col("line") + 1).alias("line"), F.col("event_id").alias("_last"))
    runs = r.join(last, "line", "left").agg(F.count("event_id").alias("event_frames"), F.count_if(F.col("event_id").isNotNull() & ~F.col("event_id").eqNullSafe(F.col("_last"))).alias("runs"))
    return faults.join(F.broadcast(runs)).select(F.col("order").alias("unordered"), "event_frames", "runs", "parted")  # one row each


@query(f"with {DAILY}, f as (select channel, greatest(1.4826::double * median(abs(x - c)), 1e-9::double) as scale from daily join (select channel, median(x) as c from daily where split = 'train' group by all) using (channel) where split = 'train' group by channel), k as (select *, t % 400 as m, case when t % 400 = 200 then 'spike' when t % 400 between 240 and 259 then 'drift' when t % 400 between 300 and 319 then 'level_shift' when t % 400 between 360 and 379 then 'variance_burst' else 'none' end as kind from daily join f using (channel)) select channel, t, kind, round(x + scale * case kind when 'spike' then 8 when 'level_shift' then 3 when 'drift' then 5.0::double * (m - 240) / 19 when 'variance_burst' then case when m % 2 = 0 then 4 else -4 end else 0 end, 4) + 0.0 as x from k")
def q_inject(spark, sf):
    s = views.daily_series(spark, sf)
    base = blocks.centre_and_scale(s.where("split = 'train'"), ["channel"], "x")
    k = F.col("t") % 400
    kind = F.when(k == 200, "spike").when(k.between(240, 259), "drift").when(k.between(300, 319), "level_shift").when(k.between(360, 379), "variance_burst").otherwise("none")
    size = F.when(F.col("kind") == "spike", 8.0).when(F.col("kind") == "level_shift", 3.0).when(F.col("kind") == "drift", 5.0 * (k - 240) / 19).when(F.col("kind") == "variance_burst", F.when(k % 2 == 0, 4.0).otherwise(-4.0)).otherwise(0.0)
    return s.join(F.broadcast(base), "channel").withColumn("kind", kind).select("channel", "t", "kind", (F.round(F.col("x") + F.col("scale") * size, 4) + 0.0).alias("x"))


@query()
def q_inject_seeded(spark, sf):
    from ..operators.search import parts
    from ..sources.files import numbered
    from ..sources.scenarios import inject

    day = views.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    named = numbered(cut(day.orderBy("day")), "t")
    return inject(parts(named.select(F.lit("orders").alias("dataset"), F.lit("all").alias("channel"), "t", "x")).select("channel", "index", "part", "t", "x"))


@query()
def q_bootstrap_ci(spark, sf):
    from ..operators.outcomes import bootstrap

    return bootstrap(evaluation.channel_metrics(*alarm_runs(spark, sf), ["channel"]))


@query()
def q_pca_residual(spark, sf):
    from ..operators.outcomes import pca_residuals

    return pca_residuals(views.scored_series(spark, sf)).select("channel", "t", r6("score"))


from . import scorecards  # noqa: E402, F401  registers its queries here
