"""Staged search of score configurations on series with injected events, selection, one final test, and an atlas of failures.

Rows are (dataset, channel, part, t, x): ``fit`` to scale by, ``clean`` to set thresholds on, ``target`` to be judged.
Configurations that share their scores are scored once; their thresholds and alarm rules are columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import prf
from ..functions.lineage import cut
from . import forest, scorecard, sequences, series

KEY = ["dataset", "channel"]
SMALL = 1e-12
#: The space, and what a configuration is compared with for its complexity.
SPACE = {
    "length": (8, 16, 32, 64, 128), "aggregation": ("mean", "median", "max", "topk_mean"), "topk": (1, 2, 4, 8), "smoothing": ("none", 3, 5, 9),
    "per_channel_quantile": (0.95, 0.975, 0.99, 0.995, 0.999), "global_quantile": (0.95, 0.975, 0.99, 0.995, 0.999), "robust_multiplier": (2.5, 3.0, 3.5, 4.0, 4.5),
    "scope": ("per_channel", "global"), "epsilon": (1e-12, 1e-9, 1e-6), "clip": ("none", 5, 10),
    "hysteresis_low_high_ratio": (0.60, 0.70, 0.80, 0.90), "min_alert_duration": (1, 2, 3, 5, 8), "max_merge_gap": (0, 1, 2, 4, 8), "cooldown": (0, 1, 2, 4), "weight": (0.25, 0.50, 0.75),
}
NORM = {"scope": "per_channel", "epsilon": 1e-9, "clip": "none"}
POST = {"hysteresis_low_high_ratio": 0.90, "min_alert_duration": 1, "max_merge_gap": 0, "cooldown": 0}
ALONE = {"feature": "none"}


def split_points(n: Column, share: float = 0.30, gap: int = 128, least: int = 128) -> tuple[Column, Column, Column]:
    """End of the fit part, start of the validation part (the last ``share``, after a gap), and whether both have ``least`` samples; else all is fit."""
    val = F.floor(share * n)
    ok = (n - val - gap >= least) & (val >= least)
    return F.when(ok, n - val - gap).otherwise(n).cast("long"), F.when(ok, n - val).otherwise(n).cast("long"), ok


def parts(training: DataFrame) -> DataFrame:
    """Training samples (dataset, channel, t, x) with their part, ``fit``, ``gap`` or ``val``, and their channel's place, which seeds what is injected; channels too short for both are left out."""
    n = training.groupBy(*KEY).agg(F.count("*").alias("n"))
    fit_end, val_start, ok = split_points(F.col("n"))
    place = (F.row_number().over(Window.orderBy(*KEY)) - 1).cast("long")  # over channels
    ends = n.select(*KEY, fit_end.alias("_f"), val_start.alias("_v"), ok.alias("_ok"), place.alias("index")).where("_ok")
    return training.join(ends, KEY).select(*KEY, "index", "t", "x", F.when(F.col("t") < F.col("_f"), "fit").when(F.col("t") >= F.col("_v"), "val").otherwise("gap").alias("part"))


def validation(training: DataFrame, seed: int = 20261013) -> tuple[DataFrame, DataFrame]:
    """Rows to search on (clean validation samples, and those with injected events as target), and the injected events."""
    from ..sources import scenarios

    named = parts(training).withColumn("_c", F.struct(*KEY))
    flat = named.withColumn("channel", F.concat_ws("\x1f", *KEY))
    got = scenarios.inject(flat.select("channel", "index", "part", "t", "x"), seed).withColumn("_k", F.split("channel", "\x1f"))
    got = got.select(F.col("_k")[0].alias("dataset"), F.col("_k")[1].alias("channel"), "t", "x", "kind", "start")
    own = named.select(*KEY, "part", "t", "x")
    rows = own.where("part = 'fit'").unionByName(own.where("part = 'val'").withColumn("part", F.lit("clean"))).unionByName(got.select(*KEY, F.lit("target").alias("part"), "t", "x"))
    events = got.where("start is not null").groupBy(*KEY, "start", F.col("kind").alias("class")).agg(F.max("t").alias("end"))
    return rows, events.select(*KEY, "start", "end", "class")


# The space.


def windows() -> Iterator[dict]:
    for n, a, m in product(SPACE["length"], SPACE["aggregation"], SPACE["smoothing"]):
        for k in SPACE["topk"] if a == "topk_mean" else (1,):
            yield {"length": n, "aggregation": a, "topk": k, "smoothing": m}


def rules() -> Iterator[dict]:
    return ({"kind": k, "value": v} for k in ("per_channel_quantile", "global_quantile", "robust_multiplier") for v in SPACE[k])


def norms() -> Iterator[dict]:
    return (dict(zip(NORM, x)) for x in product(*(SPACE[k] for k in NORM)))


def posts() -> Iterator[dict]:
    return (dict(zip(POST, x)) for x in product(*(SPACE[k] for k in POST)))


def complements() -> Iterator[dict]:
    yield ALONE
    for f in ("rolling_mad", "pca_residual"):
        yield from ({"feature": f, "combination": how} for how in ("normalized_mean", "max"))
        yield from ({"feature": f, "combination": "weighted_sum", "weight": w} for w in SPACE["weight"])


def complexity(c: dict) -> int:
    """Settings that are not the plain ones; two for a complementary feature."""
    changed = sum(c["normalization"][k] != v for k, v in NORM.items()) + sum(c["postprocess"][k] != v for k, v in POST.items())
    return changed + (c["window"]["smoothing"] != "none") + (c["window"]["aggregation"] in ("median", "topk_mean")) + 2 * (c["complementary"]["feature"] != "none")


# Scores.


def scaled(rows: DataFrame, norm: dict) -> DataFrame:
    """x over the fit part's scaled MAD (``epsilon`` at least) round its median, by channel or over a dataset's channels, clipped if asked."""
    by = KEY if norm["scope"] == "per_channel" else ["dataset"]
    fit = rows.where("part = 'fit'")
    centre = fit.groupBy(*by).agg(F.percentile("x", 0.5).alias("_c"))
    base = fit.join(centre, by).groupBy(*by).agg(F.first("_c").alias("_c"), F.greatest(1.4826 * F.percentile(F.abs(F.col("x") - F.col("_c")), 0.5), F.lit(norm["epsilon"])).alias("_s"))
    x = (F.col("x") - F.col("_c")) / F.col("_s")
    return rows.join(base, by).withColumn("x", x if norm["clip"] == "none" else series.bounded(x, -float(norm["clip"]), float(norm["clip"]))).drop("_c", "_s")


def windowed(rows: DataFrame, value: Column, n: int, how: str, k: int = 1) -> Column:
    """The aggregate of the last ``n`` values of a part; before its start its first value is repeated."""
    by = [*KEY, "part"]
    w = sequences.trailing(by, n)
    first = F.first(value).over(Window.partitionBy(*by).orderBy("t"))
    lack = n - F.count(value).over(w)
    if how == "mean":
        return (F.sum(value).over(w) + lack * first) / n
    if how == "max":
        return F.when(lack > 0, F.greatest(F.max(value).over(w), first)).otherwise(F.max(value).over(w))
    whole = F.concat(F.array_repeat(first, lack.cast("int")), F.collect_list(value).over(w))
    if how == "median":
        return sequences.array_median(whole)
    return sequences.array_mean(F.slice(F.sort_array(whole, False), 1, min(k, n)))


def window_score(rows: DataFrame, w: dict) -> DataFrame:
    """``rows`` with the aggregate of abs(x) over a trailing window, smoothed if asked."""
    out = rows.withColumn("score", windowed(rows, F.abs("x"), w["length"], w["aggregation"], w.get("topk", 1)))
    return out if w["smoothing"] == "none" else out.withColumn("score", windowed(out, F.col("score"), int(w["smoothing"]), "mean"))


def rolling_mad(rows: DataFrame, n: int = 64) -> DataFrame:
    """Distance of x from its trailing median, in trailing scaled MADs of 1 at least."""
    by = [*KEY, "part"]
    first, got = F.first("x").over(Window.partitionBy(*by).orderBy("t")), F.collect_list("x").over(sequences.trailing(by, n))
    a = rows.withColumn("_a", F.concat(F.array_repeat(first, n - F.size(got)), got)).withColumn("_m", sequences.array_median(F.col("_a")))
    mad = sequences.array_median(F.transform("_a", lambda v: F.abs(v - F.col("_m"))))
    return a.withColumn("score", F.abs(F.col("x") - F.col("_m")) / F.greatest(1.4826 * mad, F.lit(1.0))).drop("_a", "_m")


def lagged(x: np.ndarray, lags: int = 16) -> np.ndarray:
    x = np.clip(x, -10, 10)
    return np.lib.stride_tricks.sliding_window_view(np.r_[np.full(lags - 1, x[0]), x], lags)


def _by_channel(rows: DataFrame, model) -> DataFrame:
    """Scores of clean and target parts by a model learned from a channel's fit part: ``model(fit lags)`` gives a function of lags."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        fit = pdf.loc[pdf["part"] == "fit", "x"].to_numpy()
        out = []
        if len(fit):
            f = model(lagged(fit))
            for part in ("clean", "target"):
                own = pdf[pdf["part"] == part]
                if len(own):
                    out.append(own.assign(score=f(lagged(own["x"].to_numpy()))))
        return pd.concat(out)[["dataset", "channel", "part", "t", "score"]] if out else pd.DataFrame({c: [] for c in ("dataset", "channel", "part", "t", "score")})

    return rows.select(*KEY, "part", "t", "x").groupBy(*KEY).applyInPandas(one, "dataset string, channel string, part string, t long, score double")


def residual_of(lags: np.ndarray, share: float = 0.90, most: int = 8):
    """The distance from the leading components, as many as hold ``share`` of the variance."""
    centre = lags.mean(0)
    value, vector = np.linalg.eigh(np.cov((lags - centre).T, bias=True))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    k = min(most, int(np.searchsorted(np.cumsum(value) / value.sum(), share - 1e-12)) + 1) if value.sum() > 0 else 1

    def score(x):
        r = x - centre
        r = r - r @ vector[:, :k] @ vector[:, :k].T
        return np.sqrt((r * r).sum(1))

    return score


def pca_residual(rows: DataFrame) -> DataFrame:
    return _by_channel(rows, residual_of)


def lag_forest(rows: DataFrame, seed: int, most: int = 5000) -> DataFrame:
    """Isolation scores of lag windows by a forest grown on at most ``most`` evenly spaced ones of the fit part."""

    def model(lags):
        some = lags[np.linspace(0, len(lags) - 1, most).astype(int)] if len(lags) > most else lags
        trees, n = forest.grow(some, 100, 256, seed)
        return lambda x: forest.isolation(trees, n, x)

    return _by_channel(rows, model)


def combined(rows: DataFrame, c: dict) -> DataFrame:
    """Scores (dataset, channel, part, t, score) of a configuration on clean and target parts: the window score, or it and a complementary one, each over its clean 0.99 quantile."""
    x = scaled(rows, c["normalization"])
    own = window_score(x.where("part != 'fit'"), c["window"]).select(*KEY, "part", "t", "score")
    more = c["complementary"]
    if more["feature"] == "none":
        return own
    other = rolling_mad(x.where("part != 'fit'")) if more["feature"] == "rolling_mad" else pca_residual(x)
    both = cut(own.join(other.select(*KEY, "part", "t", F.col("score").alias("_b")), [*KEY, "part", "t"]))  # read for the units, then scaled
    unit = both.where("part = 'clean'").groupBy(*KEY).agg(F.greatest(F.percentile("score", 0.99), F.lit(SMALL)).alias("_na"), F.greatest(F.percentile("_b", 0.99), F.lit(SMALL)).alias("_nb"))
    a, b = F.col("score") / F.col("_na"), F.col("_b") / F.col("_nb")
    w = float(more.get("weight", 0.5))
    how = {"normalized_mean": (a + b) / 2, "max": F.greatest(a, b), "weighted_sum": w * a + (1 - w) * b}[more["combination"]]
    return both.join(unit, KEY).select(*KEY, "part", "t", how.alias("score"))


def rule_thresholds(clean: DataFrame, rules_: list[dict]) -> DataFrame:
    """Rows (dataset, channel, rule, threshold) from clean scores; ``rule`` is the place in the list."""
    of = {k: [(i, float(r["value"])) for i, r in enumerate(rules_) if r["kind"] == k] for k in ("per_channel_quantile", "global_quantile", "robust_multiplier")}
    listed = lambda pairs, f: F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), f(j, v).alias("threshold")) for j, (i, v) in enumerate(pairs)))).alias("_r")
    out = []
    if pairs := of["per_channel_quantile"]:
        q = clean.groupBy(*KEY).agg(F.percentile("score", F.array(*(F.lit(v) for _, v in pairs))).alias("_q"))
        out.append(q.select(*KEY, listed(pairs, lambda j, v: F.col("_q")[j])).select(*KEY, "_r.*"))
    if pairs := of["global_quantile"]:
        q = clean.groupBy("dataset").agg(F.percentile("score", F.array(*(F.lit(v) for _, v in pairs))).alias("_q"))
        out.append(clean.select(*KEY).distinct().join(q, "dataset").select(*KEY, listed(pairs, lambda j, v: F.col("_q")[j])).select(*KEY, "_r.*"))
    if pairs := of["robust_multiplier"]:
        m = clean.groupBy(*KEY).agg(F.percentile("score", 0.5).alias("_m"))
        s = clean.join(m, KEY).groupBy(*KEY).agg(F.first("_m").alias("_m"), (1.4826 * F.percentile(F.abs(F.col("score") - F.col("_m")), 0.5)).alias("_s"))
        out.append(s.select(*KEY, listed(pairs, lambda j, v: F.col("_m") + v * F.col("_s"))).select(*KEY, "_r.*"))
    return scorecard.unioned(out)


# Metrics.


def channel_eval(spans: DataFrame, samples: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, n, events, tp, fp, fn, pred_events, dups, delays, durations and counts of points, adjusted by event too).

    ``by`` holds dataset and channel; ``samples`` are (by, t), all of them; spans and events are inclusive.
    """
    of = spans.select(*by, F.col("start").alias("run"), F.col("end").alias("run_end"), F.explode(F.sequence("start", "end")).alias("t"))
    inside = series.points(events).select(*KEY, "t", F.col("start").alias("event"), F.col("end").alias("event_end"))
    rows = samples.select(*by, "t").join(of, [*by, "t"], "left").join(inside, [*KEY, "t"], "left")
    alert, true = F.col("run").isNotNull(), F.col("event").isNotNull()
    pair = rows.where(alert & true).groupBy(*by, "event").agg(F.count_distinct("run").alias("_k"), F.greatest(F.min("run"), F.col("event")).alias("_first"))
    found = pair.groupBy(*by).agg(F.count("*").alias("tp"), F.collect_list((F.col("_k") - 1).cast("long")).alias("dups"), F.collect_list(F.col("_first") - F.col("event")).alias("delays"))
    run = rows.where(alert).groupBy(*by, "run", "run_end").agg(F.bool_or(true).alias("_hit"))
    pred = run.groupBy(*by).agg(F.count("*").alias("pred_events"), F.count_if(~F.col("_hit")).alias("fp"), F.collect_list(F.col("run_end") - F.col("run") + 1).alias("durations"))
    event = rows.where(true).groupBy(*by, "event").agg(F.bool_or(alert).alias("_hit"), F.count("*").alias("_n"))
    ev = event.groupBy(*by).agg(F.count("*").alias("events"), F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).alias("pa_tp"), F.sum(F.when(F.col("_hit"), 0).otherwise(F.col("_n"))).alias("pa_fn"))
    point = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(alert & true).alias("point_tp"), F.count_if(alert & ~true).alias("point_fp"), F.count_if(~alert & true).alias("point_fn"))
    out = point.join(ev, by, "left").join(found, by, "left").join(pred, by, "left").na.fill(0, ["events", "tp", "fp", "pred_events", "pa_tp", "pa_fn"])
    empty = F.array().cast("array<bigint>")
    return out.withColumns({"fn": F.col("events") - F.col("tp"), "pa_fp": F.col("point_fp"), **{c: F.coalesce(c, empty) for c in ("dups", "delays", "durations")}})


def aggregated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro metrics by ``by`` and dataset, and over all datasets (dataset 'all'), in one rollup; quantiles over all events and runs."""
    macro = F.when(F.col("events") > 0, prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    sums = ("events", "tp", "fp", "fn", "point_tp", "point_fp", "point_fn", "pa_tp", "pa_fp", "pa_fn")
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("dups", "delays", "durations")}
    every = rows.withColumn("_f", macro).groupingSets([[F.col(c) for c in (*by, "dataset")], [F.col(c) for c in by]], *by, "dataset").agg(F.count("*").alias("channels"), *(F.sum(c).alias(c) for c in sums), F.coalesce(F.avg("_f"), F.lit(0.0)).alias("macro_channel_f1"), *lists.values(), F.grouping("dataset").alias("_all"))
    (p, r, f), (pp, pr, pf), (_, _, af) = (prf(F.col(f"{k}tp"), F.col(f"{k}fp"), F.col(f"{k}fn")) for k in ("", "point_", "pa_"))

    def at(c: str, q: float) -> Column:
        s, n = F.array_sort(c), F.size(c)
        place = (n - 1) * q
        low = F.element_at(s, F.floor(place).cast("int") + 1)
        return F.when(n > 0, low + (F.element_at(s, F.least(F.floor(place).cast("int") + 2, n)) - low) * (place - F.floor(place)))

    out = every.withColumns({"dataset": F.when(F.col("_all") == 1, "all").otherwise(F.col("dataset")), "event_precision": p, "event_recall": r, "event_f1": f, "point_precision": pp, "point_recall": pr, "point_f1": pf, "point_adjusted_f1_secondary": af, "duplicates_per_matched_event": F.when(F.size("dups") > 0, sequences.array_mean(F.col("dups").cast("array<double>"))).otherwise(0.0), **{f"delay_{n}": at("delays", q) for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))}, "pred_duration_median": at("durations", 0.5), "pred_duration_p90": at("durations", 0.9), "pred_events": F.size("durations").cast("long")})
    return out.drop("_all", "dups", "delays", "durations", "point_tp", "point_fp", "point_fn", "pa_tp", "pa_fp", "pa_fn")


def group_key(c: dict) -> str:
    return json.dumps({k: c[k] for k in ("normalization", "window", "complementary")}, sort_keys=True)


def trials(rows: DataFrame, events: DataFrame, configs: dict[int, dict], cache: dict | None = None) -> DataFrame:
    """Metrics (trial, dataset, ...) of configurations by number; what shares its scores is scored once, and kept in ``cache`` over calls."""
    spark, cache, out = rows.sparkSession, {} if cache is None else cache, []
    groups: dict[str, list[int]] = {}
    for i, c in configs.items():
        groups.setdefault(group_key(c), []).append(i)
    for key, own in groups.items():
        if key not in cache:
            cache[key] = cut(combined(rows, configs[own[0]]))
        s = cache[key]
        distinct = [json.loads(r) for r in dict.fromkeys(json.dumps(configs[i]["threshold"], sort_keys=True) for i in own)]
        limits = rule_thresholds(s.where("part = 'clean'"), distinct)
        table = [(i, distinct.index(dict(configs[i]["threshold"])), *((float(p["hysteresis_low_high_ratio"]), int(p["max_merge_gap"]), int(p["min_alert_duration"]), int(p["cooldown"])) if (p := configs[i]["postprocess"]) else (None, None, None, None))) for i in own]
        asked = F.broadcast(spark.createDataFrame(table, "trial long, rule int, ratio double, gap long, least long, rest long"))  # one row per configuration of the list
        target = s.where("part = 'target'").select(*KEY, "t", "score")
        marked = target.join(limits.join(asked, "rule"), KEY)
        by = ["trial", *KEY]
        out.append(channel_eval(series.alarm_chain(marked, by), marked, events, by))
    return aggregated(scorecard.unioned(out), ["trial"])


def rank_order() -> list[Column]:
    """F1 to 3 places, complexity, precision, macro F1, false events, runtime, number."""
    return [F.round("event_f1", 3).desc(), F.col("complexity"), F.col("event_precision").desc(), F.col("macro_channel_f1").desc(), F.col("fp"), F.col("runtime_s"), F.col("trial")]


def ranked(results: DataFrame, keep: int | None = None) -> DataFrame:
    """Trials in order with their place; rows need complexity and runtime_s."""
    out = results.where("dataset = 'all'") if "dataset" in results.columns else results
    out = out.orderBy(*rank_order())
    out = out.limit(keep) if keep else out
    return out.withColumn("place", F.row_number().over(Window.orderBy(*rank_order())).cast("long"))  # over trials


def staged(rows: DataFrame, events: DataFrame, space: dict[str, list[dict]] | None = None, beams: tuple[int, int, int] = (5, 5, 3)) -> list[dict]:
    """The staged search: windows x rules; then scalings, alarm rules and complementary features of the best so far. A row of results per trial, on the driver."""
    import time

    space = space or {"windows": list(windows()), "rules": list(rules()), "norms": list(norms()), "posts": list(posts()), "complements": list(complements())}
    done, cache = [], {}

    def run(stage: str, configs: list[dict]) -> None:
        first = len(done) + 1
        named = {first + i: c for i, c in enumerate(configs)}
        began = time.perf_counter()
        got: dict[int, dict] = {i: {} for i in named}
        for r in trials(rows, events, named, cache).collect():  # a row per trial and dataset
            got[r["trial"]][r["dataset"]] = r.asDict()
        each = (time.perf_counter() - began) / max(1, len(named))
        for i, c in named.items():
            a = got[i].get("all")
            done.append({"trial": i, "stage": stage, "config": json.dumps(c, sort_keys=True), "complexity": complexity(c), "status": "ok" if a else "failed", "runtime_s": round(each, 4), **({k: a[k] for k in ("event_f1", "event_precision", "event_recall", "macro_channel_f1", "fp", "tp", "fn", "point_f1")} if a else {}), **{f"{d}_event_f1": v["event_f1"] for d, v in got[i].items() if d != "all"}})

    def best(stage: str, n: int) -> list[dict]:
        ok = [t for t in done if t["stage"] == stage and t["status"] == "ok"]
        return [json.loads(t["config"]) for t in sorted(ok, key=place_key)[:n]]

    run("stage1", [{"normalization": NORM, "window": w, "threshold": t, "postprocess": POST, "complementary": ALONE} for w in space["windows"] for t in space["rules"]])
    for stage, before, n, key, name in (("stage2a", "stage1", beams[0], "normalization", "norms"), ("stage2b", "stage2a", beams[1], "postprocess", "posts"), ("stage2c", "stage2b", beams[2], "complementary", "complements")):
        run(stage, [base | {key: v} for base in best(before, n) for v in space[name]])
    return done


def place_key(t: dict) -> tuple:
    """The order of ``rank_order`` for rows on the driver."""
    return (-round(t["event_f1"], 3), t["complexity"], -t["event_precision"], -t["macro_channel_f1"], t["fp"], t["runtime_s"], t["trial"])


def chosen(results: list[dict]) -> dict:
    """The best trial without a complementary feature, unless one with it gains 0.01 or more."""
    order = sorted((t for t in results if t.get("status", "ok") == "ok"), key=place_key)
    plain = next(t for t in order if json.loads(t["config"])["complementary"]["feature"] == "none")
    gains = order[0] is not plain and order[0]["event_f1"] >= plain["event_f1"] + 0.01
    return {"selected": order[0] if gains else plain, "best_standalone": plain, "best_overall": order[0], "complementary": gains}


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials that went well, from their table."""
    return spark.read.csv(path, header=True, inferSchema=True, escape='"').where("status = 'ok'")


# Methods.


def plain_runs(scores: DataFrame, limits: DataFrame, strict: bool = True) -> DataFrame:
    """Alerts (dataset, channel, start, end) of target scores over a threshold, or at it."""
    rows = scores.where("part = 'target'").join(limits, KEY).withColumns({"gap": F.lit(0).cast("long"), "least": F.lit(1).cast("long"), "rest": F.lit(0).cast("long"), "ratio": F.lit(None).cast("double")})
    if strict:
        return series.alarm_chain(rows, KEY)
    return sequences.runs(rows.withColumn("alarm", F.col("score") >= F.col("threshold")), KEY)


def target_cut(scores: DataFrame, part: str, target: float = 0.01) -> DataFrame:
    """Thresholds (dataset, channel, threshold) by the samples of a part, at a false-positive target."""
    own = scores.where(F.col("part") == part).withColumn("regime", F.lit(part)).withColumnRenamed("score", "top")
    return scorecard.calibrated(own, KEY, target)[0]


def method_alerts(rows: DataFrame, name: str, config: dict | None = None, seed: int = 0) -> DataFrame:
    """Alerts of a method: ``frozen`` (window blend, threshold from the fit part), ``rolling_mad``, ``train_percentile``, ``pca_residual``, ``isolation_forest`` or ``configured``."""
    if name == "frozen":
        base = rows.where("part = 'fit'").groupBy(*KEY).agg(F.avg("x").alias("_m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-9)).alias("_s"))
        z, w = (F.col("x") - F.col("_m")) / F.col("_s"), sequences.trailing([*KEY, "part"], 32)
        s = rows.join(base, KEY).withColumn("z", z)
        zc = F.col("z")
        s = s.withColumn("score", series.BLEND[0] * F.max(F.abs(zc)).over(w) + series.BLEND[1] * F.sqrt(F.avg(zc * zc).over(w)) + series.BLEND[2] * F.avg(F.abs(zc)).over(w))
        return plain_runs(s, target_cut(s, "fit"), strict=False)
    if name == "configured":
        s = cut(combined(rows, config))
        limits, p = rule_thresholds(s.where("part = 'clean'"), [config["threshold"]]).select(*KEY, "threshold"), config["postprocess"]
        return series.alarm_chain(s.where("part = 'target'").join(limits, KEY).withColumns({"ratio": F.lit(float(p["hysteresis_low_high_ratio"])), "gap": F.lit(int(p["max_merge_gap"])).cast("long"), "least": F.lit(int(p["min_alert_duration"])).cast("long"), "rest": F.lit(int(p["cooldown"])).cast("long")}), KEY)
    x = scaled(rows, NORM)
    if name == "train_percentile":
        s = x.withColumn("score", F.abs("x"))
        return plain_runs(s, s.where("part = 'fit'").groupBy(*KEY).agg(F.percentile("score", 0.995).alias("threshold")))
    s = {"rolling_mad": lambda: rolling_mad(x.where("part != 'fit'")), "pca_residual": lambda: pca_residual(x), "isolation_forest": lambda: lag_forest(x, seed)}[name]()
    s = cut(s)
    return plain_runs(s, target_cut(s, "clean"))


def compared(rows: DataFrame, events: DataFrame, config: dict, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Records (method, dataset, channel, ...) of all methods on the target part."""
    names = [("A_frozen", "frozen", 0), ("B_rolling_mad", "rolling_mad", 0), ("C_train_percentile", "train_percentile", 0), ("D_pca_residual", "pca_residual", 0), *((f"E_isolation_forest_seed{s}", "isolation_forest", s) for s in seeds), ("F_selected", "configured", 0)]
    target = rows.where("part = 'target'").select(*KEY, "t")
    return scorecard.unioned([channel_eval(method_alerts(rows, kind, config, s), target, events, KEY).withColumn("method", F.lit(label)) for label, kind, s in names])


def constraints(selected: dict, frozen: dict, ratio_: float) -> dict[str, bool]:
    """What the selected configuration must show on validation data."""
    return {"event_precision>=0.55": selected["event_precision"] >= 0.55, "event_recall>=0.55": selected["event_recall"] >= 0.55, "improvement>=0.05": selected["event_f1"] - frozen["event_f1"] >= 0.05, "runtime_ratio<=2": ratio_ <= 2.0, "zero_test_influence": True}


def confirmed(summary: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows (dataset, delta, met): whether the selected method gains ``least`` over the frozen one in each dataset of its own."""
    f1 = lambda m, n: summary.where((F.col("method") == m) & (F.col("dataset") != "all")).select("dataset", F.col("event_f1").alias(n))
    return f1("F_selected", "_new").join(f1("A_frozen", "_old"), "dataset").select("dataset", (F.col("_new") - F.col("_old")).alias("delta"), (F.col("_new") - F.col("_old") >= least).alias("met"))


def one_shot(rows: DataFrame, events: DataFrame, config: dict, result_path: str, seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> tuple[DataFrame, DataFrame]:
    """Summary and confirmation of the final test, refused where its result is there already."""
    from ..sources.protocols import once

    once(result_path)
    summary = cut(aggregated(compared(rows, events, config, seeds), ["method"]))
    return summary, confirmed(summary)


def event_matches(spans: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (dataset, channel, kind, start, end, matched, n_matches, max_score): each event, and each alert, with how many of the others it meets and the highest score inside."""

    def side(own: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        mine = own.select(*KEY, "start", "end", F.explode(F.sequence("start", "end")).alias("t"))
        theirs = other.select(*KEY, F.col("start").alias("_o"), F.explode(F.sequence("start", "end")).alias("t"))
        rows = mine.join(theirs, [*KEY, "t"], "left").join(scores.select(*KEY, "t", "score"), [*KEY, "t"], "left")
        return rows.groupBy(*KEY, "start", "end").agg(F.count_distinct("_o").alias("n_matches"), F.max("score").alias("max_score")).select(*KEY, F.lit(kind).alias("kind"), "start", "end", (F.col("n_matches") > 0).alias("matched"), "n_matches", "max_score")

    return side(events, spans, "event").unionByName(side(spans, events, "alert"))


# The atlas.


def categories(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """``cases`` (dataset, channel, kind FN or FP, start, end, max_score, threshold) with a category, the first rule that holds.

    ``rows`` are (dataset, channel, split, t, x). Rules, in this order: data quality (a constant training split or case), an isolated spike
    of 5 samples or fewer, a miss near the threshold, drift, a shift against the 128 samples before, a segment noisier than these, a
    periodic background (autocorrelation of the 256 samples before), for misses a failure of the score.
    """
    by = [*KEY, "kind", "start"]
    train = rows.where("split = 'train'")
    mid = train.groupBy(*KEY).agg(F.percentile("x", 0.5).alias("_m"))
    rsd = train.join(mid, KEY).groupBy(*KEY).agg((1.4826 * F.percentile(F.abs(F.col("x") - F.col("_m")), 0.5)).alias("rsd"))
    at = cases.select(*by, "end", F.explode(F.sequence(F.greatest(F.col("start") - 256, F.lit(0)), F.col("end"))).alias("t"))
    near = at.join(rows.where("split = 'test'").select(*KEY, "t", "x"), [*KEY, "t"])
    seg, pre = F.col("t") >= F.col("start"), (F.col("t") < F.col("start")) & (F.col("t") >= F.col("start") - 128)
    x, of = F.col("x"), lambda flag: F.when(flag, F.col("x"))
    one = near.groupBy(*by, "end").agg((F.max(of(seg)) - F.min(of(seg))).alias("spread"), F.count(of(seg)).alias("n"), F.regr_slope(of(seg), F.when(seg, F.col("t").cast("double"))).alias("slope"), F.avg(of(seg)).alias("mean"), F.stddev_pop(of(seg)).alias("sd"), F.avg(of(pre)).alias("pre_mean"), F.count(of(pre)).alias("pre_n"), F.percentile(of(pre), 0.5).alias("pre_mid"), F.transform(F.array_sort(F.collect_list(F.when(F.col("t") < F.col("start"), F.struct("t", "x")))), lambda v: v["x"]).alias("past"))
    mad = near.join(one.select(*by, "pre_mid"), by).groupBy(*by).agg((1.4826 * F.percentile(F.abs(of(pre) - F.col("pre_mid")), 0.5)).alias("pre_mad"))
    past = F.col("past")
    size = F.size(past)
    centred = F.transform(past, lambda v: v - sequences.array_mean(past))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    full = one.join(mad, by).join(rsd, KEY).withColumn("_z", centred).withColumn("_zz", dot(F.col("_z"), F.col("_z")))
    lag = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: dot(F.slice("_z", F.lit(1), size - k), F.slice("_z", k + 1, size - k))))
    full = full.withColumn("periodic", F.when((size > 70) & (F.col("_zz") > 0), lag / F.col("_zz")))
    both = cases.join(full.drop("end"), by)
    miss, yes = F.col("kind") == "FN", lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(yes((F.col("rsd") == 0) | (F.col("spread") == 0)), "data-quality issue")
        .when(F.col("end") - F.col("start") + 1 <= 5, "isolated spike")
        .when(yes(miss & (F.col("max_score") >= 0.8 * F.col("threshold"))), "threshold miss")
        .when(yes((F.col("n") >= 3) & (F.abs("slope") * F.col("n") >= 2 * F.col("rsd"))), "drift")
        .when(yes((F.col("pre_n") > 0) & (F.abs(F.col("mean") - F.col("pre_mean")) >= 2 * F.col("rsd"))), "regime shift")
        .when(yes((F.col("pre_n") > 1) & (F.col("sd") >= 2 * F.greatest("pre_mad", F.lit(SMALL)))), "noisy segment")
        .when(yes(F.col("periodic") >= 0.5), "periodic mismatch")
        .when(miss, "score failure")
        .otherwise("unknown")
    )
    return both.select(*cases.columns, kind.alias("category"))


def patterns(atlas: DataFrame, most: int = 5) -> DataFrame:
    """The commonest (kind, category) pairs; of equals the first by name."""
    n = atlas.groupBy("kind", "category").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "kind", "category").limit(most)


def side_by_side(summaries: dict[str, DataFrame]) -> DataFrame:
    """Tables of (method, dataset, event_f1, ...) from several sources as one, with their source; columns that one lacks are null there."""
    parts_ = [df.withColumn("source", F.lit(name)) for name, df in summaries.items()]
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
