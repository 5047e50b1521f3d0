"""Recorded replays: detectors judged on labelled frames under a locked protocol, by regime.

Frames are numbered rows (line, timestamp, channels, regime, event_id, affected_blocks, ...). A frame meets its
neighbours by a join on the number, so no window holds a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import cut
from ..settings import Frames
from . import detectors, scorecard

NOTE = "thresholds are fixed, not calibrated to one false-positive budget: scores have different scales, so this is no fair comparison"
#: Columns of a report's rows.
FIELDS = ("detector", "threshold", "threshold_source", "regime", "frame_count", "event_count", "detected_event_count", "event_recall", "missed_event_ids", "no_event_frame_count", "false_positive_frame_count", "false_positive_frame_rate", "false_positive_frames_per_10min", "false_positive_alarm_episodes_per_10min", "localization_precision", "localization_recall", "localization_iou", "mean_latency_ms", "median_latency_ms")


def seconds(late: Column, early: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 1e6


def starts(rows: DataFrame, by: list[str], at: str = "line") -> DataFrame:
    """Of rows at whole numbers, those whose number before is not there in the group: one for each run of consecutive numbers."""
    return rows.join(rows.select(*by, (F.col(at) + 1).alias(at)).distinct(), [*by, at], "left_anti")


def interval(frames: DataFrame) -> DataFrame:
    """One row: the median of the seconds between consecutive frames, null with fewer than two."""
    last = frames.select((F.col("line") + 1).alias("line"), F.col("timestamp").alias("_before"))
    return frames.join(last, "line").agg(F.percentile(seconds(F.col("timestamp"), F.col("_before")), 0.5).alias("step"))


def exposure(frames: DataFrame) -> DataFrame:
    """Rows (regime, exposure): over each run of frames of a regime the time from its first to its last, and the median interval once more. Times are summed as decimals: 5,000 runs overflow a long."""
    one = frames.select("line", "regime", "timestamp")
    first, last = starts(one, ["regime"]), one.join(one.select("regime", (F.col("line") - 1).alias("line")), ["regime", "line"], "left_anti")
    micros = lambda rows, name: rows.groupBy("regime").agg(F.count("*").alias(f"n_{name}"), F.sum(F.unix_micros(F.col("timestamp").cast("timestamp")).cast("decimal(19,0)")).alias(name))
    return micros(first, "a").join(micros(last, "b"), "regime").join(F.broadcast(interval(frames))).select("regime", F.coalesce((F.col("b") - F.col("a")).cast("double") / 1e6 + F.col("n_a") * F.col("step"), F.lit(0.0)).alias("exposure"))


def metrics(frames: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rows by detector and regime from what detectors say of frames: (detector, line, alarm, flagged), flagged being an array of blocks or null.

    An event counts as detected if any of its frames alarms; its latency runs from its first frame. False alarms are alarms on frames without an event,
    their episodes runs of consecutive such frames. Blocks are compared on frames whose true and flagged blocks are both known.
    """
    by = ["detector", "regime"]
    rows = outputs.join(frames.select("line", "timestamp", "regime", "event_id", "affected_blocks"), "line")
    quiet, known = F.col("event_id").isNull(), F.col("affected_blocks").isNotNull() & F.col("flagged").isNotNull()
    a, b = F.col("affected_blocks").cast("array<bigint>"), F.col("flagged").cast("array<bigint>")
    size = lambda x: F.coalesce(F.sum(F.when(known, F.size(x))), F.lit(0)).cast("long")
    counts = rows.groupBy(*by).agg(F.count("*").alias("frame_count"), F.count_if(~quiet).alias("event_frame_count"), F.count_if("alarm").alias("alarm_frame_count"), F.count_if(quiet).alias("no_event_frame_count"), F.count_if(quiet & F.col("alarm")).alias("false_positive_frame_count"), F.count_if(known).alias("annotated_frame_count"), size(F.array_intersect(a, b)).alias("tp_blocks"), size(F.array_except(b, a)).alias("fp_blocks"), size(F.array_except(a, b)).alias("fn_blocks"))
    event = rows.where(~quiet).groupBy(*by, "event_id").agg(F.min("line").alias("first"), F.min(F.struct("line", "timestamp")).alias("_a"), F.min(F.when(F.col("alarm"), F.struct("line", "timestamp"))).alias("_b"))
    event = event.withColumn("latency", 1000 * seconds(F.col("_b.timestamp"), F.col("_a.timestamp")))
    missed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_b").isNull(), F.struct("first", "event_id")))), lambda x: x["event_id"])
    latencies = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_id", "latency"))), lambda x: F.struct(x["event_id"], x["latency"])))
    found = event.groupBy(*by).agg(F.count("*").alias("event_count"), F.count("_b").alias("detected_event_count"), missed.alias("missed_event_ids"), F.avg("latency").alias("mean_latency_ms"), F.percentile("latency", 0.5).alias("median_latency_ms"), latencies.alias("latency_by_event_id"))
    false = starts(rows.where(quiet & F.col("alarm")).select(*by, "line"), by).groupBy(*by).agg(F.count("*").alias("false_positive_alarm_episode_count"))
    out = counts.join(found, by, "left").join(false, by, "left").join(exposure(frames), "regime").na.fill(0, ["event_count", "detected_event_count", "false_positive_alarm_episode_count"])
    per = lambda n: F.when(F.col("exposure") > 0, F.col(n) * 600.0 / F.col("exposure"))
    return out.withColumns({
        "missed_event_ids": F.coalesce("missed_event_ids", F.array().cast("array<string>")), "missed_event_count": F.col("event_count") - F.col("detected_event_count"), "event_recall": ratio(F.col("detected_event_count"), F.col("event_count")),
        "false_positive_frame_rate": ratio(F.col("false_positive_frame_count"), F.col("no_event_frame_count")), "false_positive_frames_per_10min": per("false_positive_frame_count"), "false_positive_alarm_episodes_per_10min": per("false_positive_alarm_episode_count"),
        "localization_precision": ratio(F.col("tp_blocks"), F.col("tp_blocks") + F.col("fp_blocks")), "localization_recall": ratio(F.col("tp_blocks"), F.col("tp_blocks") + F.col("fn_blocks")), "localization_iou": ratio(F.col("tp_blocks"), F.col("tp_blocks") + F.col("fp_blocks") + F.col("fn_blocks")),
    }).withColumnRenamed("exposure", "observed_exposure_seconds")


def scores(d: detectors.Detector, frames: DataFrame) -> DataFrame:
    """Rows (line, block, score); a temporal detector sees the whole recording as one stream."""
    rows = frames.select("line", "channels")
    if not d.temporal:
        return d.score(rows, ["line"])
    if rows.where(F.col("line") >= d.warmup).isEmpty():
        raise ValueError(f"{d.name} needs more than {d.warmup} frames")
    return d.score(rows.select(F.lit(0).alias("recording"), F.col("line").alias("step"), "channels"), ["recording"]).select(F.col("step").alias("line"), "block", "score")


def calibrated(d: detectors.Detector, frames: DataFrame, target: float) -> tuple[float, list[dict]]:
    """The threshold of a recording without events, by frames' maxima in each regime; warm-up frames, which score 0, do not count."""
    if frames.where("event_id is not null").head(1):
        raise ValueError("a calibration recording must be free of events")
    top = scores(d, frames).groupBy("line").agg(F.max("score").alias("top")).where(F.col("line") >= (d.warmup if d.temporal else 0))
    _, each = scorecard.calibrated(cut(top.join(frames.select("line", "regime"), "line").withColumn("detector", F.lit(d.name))), ["detector"], target)
    rows = [r.asDict() for r in each.drop("detector").orderBy("regime").collect()]  # a row for each regime
    return max(r["threshold"] for r in rows), rows


def report(frames: DataFrame, protocol: dict, calibration: DataFrame | None = None, calibration_sha256: str | None = None, f: Frames = Frames()) -> tuple[dict, DataFrame]:
    """The report's head and its rows: each detector of the protocol, and the incumbent where the recording has one."""
    policy = protocol["threshold_policy"]
    if policy["mode"] == "calibrated":
        if calibration is None:
            raise ValueError("a calibrated policy needs a calibration recording")
        if calibration_sha256 != policy["calibration_sha256"]:
            raise ValueError("the calibration recording is not the locked one")
    thresholds, parts, about = {}, [], {}
    for name in protocol["detectors"]:
        d = detectors.create(name, f, warmup=protocol["warmup"])
        if d.requires_fit:
            if calibration is None:
                raise ValueError(f"{name} needs a clean calibration recording to learn from")
            rows = calibration.select("line", "channels")
            d = d.fit(rows.select(F.lit(0).alias("recording"), F.col("line").alias("step"), "channels") if d.temporal else rows, ["recording"] if d.temporal else ["line"])
        if policy["mode"] == "calibrated":
            t, how = calibrated(d, calibration, policy["target_fp"])
            thresholds[name] = {"threshold": t, "source": "calibrated", "per_regime": how}
        else:
            t = policy["thresholds"][name]
            thresholds[name] = {"threshold": t, "source": "fixed"}
        about[name] = {"rule": d.rule, "temporal": d.temporal, "params": d.params()}
        flags = scores(d, frames).groupBy("line").agg(F.array_sort(F.collect_list(F.when(F.col("score") >= t, F.col("block")))).alias("flagged"))
        parts.append(flags.select(F.lit(name).alias("detector"), "line", (F.size("flagged") > 0).alias("alarm"), "flagged"))
    own = F.col("incumbent_flags").isNotNull() | F.col("incumbent_alarm").isNotNull()
    if incumbent := bool(frames.where(own).head(1)):
        blocks = F.filter(F.transform("incumbent_flags", lambda x, i: F.when(x, i.cast("long"))), lambda x: x.isNotNull())
        parts.append(frames.select(F.lit("incumbent").alias("detector"), "line", F.coalesce("incumbent_alarm", F.exists("incumbent_flags", lambda x: x), F.lit(False)).alias("alarm"), blocks.alias("flagged")))
        about["incumbent"] = {"rule": "what the recording says", "temporal": None, "params": {}}
    fair = policy["mode"] == "calibrated"
    regimes = [r["regime"] for r in frames.groupBy("regime").agg(F.min("line").alias("at")).orderBy("at").collect()]
    head = {"report_schema_version": 2, "protocol": protocol, "input": {"frame_count": frames.count(), "regimes_in_first_seen_order": regimes, "incumbent_available": incumbent, "calibration_sha256": calibration_sha256}, "thresholds": thresholds, "comparison_is_calibrated": fair, "fairness_note": None if fair else NOTE, "detectors": about}
    m = metrics(frames, cut(scorecard.unioned(parts)))
    table = frames.sparkSession.createDataFrame([(n, thresholds[n]["threshold"], thresholds[n]["source"]) if n in thresholds else (n, None, "supplied") for n in about], "detector string, threshold double, threshold_source string")
    return head, m.join(F.broadcast(table), "detector")


def card(rows: DataFrame) -> DataFrame:
    """The report's rows in the columns of its CSV."""
    return rows.withColumn("missed_event_ids", F.array_join("missed_event_ids", ";")).select(*FIELDS)
