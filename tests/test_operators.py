"""Hand cases, numpy twins and negative tests."""

import itertools
import json
import math
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import __main__ as cli
from tidegauge import settings
from tidegauge.functions import quantiles
from tidegauge.operators import blocks, detectors, evaluation, forest, outcomes, replay, scorecard, search, sequences, statistics
from tidegauge.plans import catalog
from tidegauge.settings import Compare, Evaluation, Frames, Streams, Stress
from tidegauge.sinks import outputs
from tidegauge.sources import files, protocols, scenarios, views
from tidegauge.streaming import online
from tidegauge.streaming.pot import Threshold
from tidegauge.streaming.windows import windowed


def test_cuts(spark):
    rows = spark.createDataFrame([("a", i / 10) for i in range(1, 11)], "g string, top double")
    assert evaluation.cuts(rows, ["g"], 0.1).first()["cut"] == 0.9


def test_channel_metrics(spark):
    rows = spark.createDataFrame([("c", t, t in (2, 3, 12, 13, 14, 25)) for t in range(30)], "channel string, t long, alarm boolean")
    events = spark.createDataFrame([("c", 10, 15, "point"), ("c", 18, 22, "point")], "channel string, start long, end long, class string")
    m = evaluation.channel_metrics(sequences.runs(rows, ["channel"]), events, ["channel"]).first()
    assert (m["tp"], m["fp"], m["fn"], m["latency"]) == (1, 2, 1, 2)
    p = outcomes.point_metrics(rows, events, ["channel"]).first()
    assert (p["pa_tp"], p["fp"], p["pa_fn"]) == (6, 3, 5)


def test_statistics(spark):
    def p(d):
        r = statistics.signed_rank(spark.createDataFrame([("g", float(x)) for x in d], "g string, d double"), ["g"]).first()
        return r["wilcoxon_p"], r["wilcoxon_method"], r["wilcoxon_w_plus"], r["wilcoxon_n_nonzero"]

    assert p([1, 2, 3, 4, 5]) == (pytest.approx(2 / 32), "exact", 15.0, 5)
    assert p([-1, 2, -3, 4, 0]) == (pytest.approx(14 / 16), "exact", 6.0, 4)
    assert p([0.0, 1e-13]) == (1.0, "no_nonzero_differences", 0.0, 0)
    tied = p([1, 1, -1, 2, 3])
    assert tied[1:] == ("normal_approximation", 2 + 2 + 4 + 5, 5) and tied[0] == pytest.approx(math.erfc((7.5 - 2 - 0.5) / math.sqrt((5 * 6 * 11 - 24 / 2) / 24) / math.sqrt(2)))
    rng = np.random.default_rng(4)
    for n in (6, 9):  # the exact distribution against all signs
        sums = np.array([sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)])
        for low in rng.integers(0, n * (n + 1) // 4, 4):
            assert statistics.signed_rank_p(n, float(low), 0)[0] == pytest.approx(min(1, 2 * (sums <= low).mean()))
    rows = spark.createDataFrame([("x", "a", 0.01), ("x", "b", 0.04), ("x", "c", 0.03)], "f string, name string, p double")
    assert [round(r["adjusted"], 9) for r in evaluation.holm(rows, ["f"]).orderBy("name").collect()] == [0.03, 0.06, 0.06]


def changepoint(z):
    m, h, least, tau2, k = 3, 1 / 200, 0.8, 4.0, 0.5
    off = up = dn = 0.0
    hist, out = [], []
    for v in z:
        r = v - off
        up, dn = max(0, up + r - k), max(0, dn - r - k)
        hist = (hist + [r])[-m:]
        p = 0.0
        if len(hist) == m:
            odds = -0.5 * np.log(1 + m * tau2) + 0.5 * tau2 / (1 + m * tau2) * sum(hist) ** 2 + np.log(h) - np.log(1 - h)
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        out.append(max(up, dn, p / least))
        if p >= least:
            off, up, dn, hist = off + sum(hist) / m, 0.0, 0.0, []
    return out


def test_recursions(spark):
    z = np.random.default_rng(3).normal(0, 1, 300)
    z[150:] += 3
    rows = spark.createDataFrame([(1, i, float(v), True) for i, v in enumerate(z)], "s int, step long, z double, live boolean").repartition(4)
    got = [r["score"] for r in sequences.changepoint_cusum(rows, ["s"]).orderBy("step").collect()]
    assert np.allclose(got, changepoint(z))
    up = dn = e = 0.0
    want_c, want_e = [], []
    for v in z:
        up, dn, e = max(0, up + v - 0.5), max(0, dn - v - 0.5), 0.2 * v + 0.8 * e
        want_c.append(max(up, dn)), want_e.append(abs(e) / (0.2 / 1.8) ** 0.5)
    assert np.allclose([r["cusum"] for r in sequences.cusum(rows, ["s"]).orderBy("step").collect()], want_c)
    assert np.allclose([r["ewma"] for r in sequences.ewma(rows, ["s"]).orderBy("step").collect()], want_e)


def test_pot():
    s = np.random.default_rng(81).exponential(1, 1600)
    t = Threshold(window=400, risk=0.01)
    with pytest.raises(ValueError):
        Threshold(risk=0.05)  # not under what lies over the initial quantile
    t.calibrate(s[:400])
    assert np.mean([t.update(x)[0] for x in s[400:]][600:]) <= 0.04
    with pytest.raises(ValueError):
        Threshold().calibrate([1.0])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id") * 7)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="10 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(spark.table("sums").collect()) == sorted(windowed(rows).collect())


def test_generated_frames_do_not_depend_on_partitions(spark):
    one = {(r["regime"], r["trial"]): r["channels"] for r in scenarios.frames(spark, 5, 42).coalesce(1).collect()}
    assert {(r["regime"], r["trial"]): r["channels"] for r in scenarios.frames(spark, 5, 42).repartition(7).collect()} == one
    tops = [max(abs(v) for v in x) for (regime, _), x in one.items() if regime == "stable"]
    assert max(tops) < 0.4


def test_registry(spark):
    assert {"blend", "peak", "zscore", "ewma", "cusum", "cusum-cp", "blend-robust", "blend+ewma", "iforest"} <= set(detectors.available())
    with pytest.raises(ValueError):
        detectors.register(detectors.get("peak"))
    with pytest.raises(KeyError):
        detectors.get("none")
    f = Frames(channels=4, size=2)
    rows = spark.createDataFrame([(1, [0.1, -0.9, 0.2, 0.3]), (2, [0.0, 0.0, float("nan"), float("nan")])], "unit long, channels array<double>")
    r = detectors.create("peak", f).result(rows, ["unit"])
    assert r.to_dict() == {"detector": "peak", "threshold": 0.5, "scores": [[0.9, 0.3], [0.0, 0.0]], "detected_blocks": [[0], []], "status": ["LOCALIZED_ALERT", "STABLE"], "explanation": {"detector": "peak", "rule": detectors.get("peak").rule, "threshold": 0.5, "params": {}, "temporal": False, "detected_count": 1, "top_block_last_frame": 0, "top_score_last_frame": 0.0}}
    with pytest.raises(ValueError):
        detectors.create("zscore", f).score(rows, ["unit"])
    for bad in ([0.0] * 3, [float("inf"), 0.0, 0.0, 0.0]):
        with pytest.raises(Exception, match="telemetry is not"):
            detectors.create("blend", f).score(spark.createDataFrame([(1, bad)], "unit long, channels array<double>"), ["unit"]).collect()
    with pytest.raises(Exception, match="telemetry is not"):
        detectors.create("zscore", f).fit(rows, ["unit"])

    class Sums(detectors.ArrayDetector):
        name = "sums"

        def array_scores(self, x):
            return np.nansum(np.abs(x).reshape(len(x), -1, 2), 2)

    try:
        detectors.register(Sums)
        assert {(x["unit"], x["block"]): x["score"] for x in detectors.create("sums", f).score(rows, ["unit"]).collect()} == {(1, 0): 1.0, (1, 1): 0.5, (2, 0): 0.0, (2, 1): 0.0}
    finally:
        detectors.unregister("sums")


def test_plugins(monkeypatch):
    class Point:
        def __init__(self, name, kind):
            self.name, self.kind = name, kind

        def load(self):
            if self.kind is None:
                raise RuntimeError("broken")
            return self.kind

    class Own(detectors.Peak):
        name = "own"

    monkeypatch.setattr(detectors.metadata, "entry_points", lambda group: [Point("a", None), Point("b", Own)])
    with pytest.warns(UserWarning, match="a of tidegauge.detectors"):
        assert detectors.load_plugins() == {"a": None, "b": "own"}
    detectors.unregister("own")


def test_replay_file(spark, tmp_path):
    ok = {"timestamp": "2024-01-01T00:00:00+00:00", "channels": [0.0] * 4, "regime": "S", "event_label": "none", "event_id": None}
    bad = [ok | {"timestamp": "2024-01-01T00:00:01"}, ok | {"channels": [True] * 4}, ok | {"event_id": "e"}, ok | {"extra": 1}, ok | {"affected_blocks": [9]}]
    lines = [json.dumps(ok), *map(json.dumps, bad), '{"a": 1, "a": 2}', "", json.dumps(ok)[:-1] + ', "incumbent_alarm": NaN}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    rows = files.read_replay(spark, str(tmp_path / "r.jsonl"), 4, 2).orderBy("line").collect()
    assert [bool(r["violations"]) for r in rows] == [False] + [True] * 8
    faults = {r["fault"]: r["n"] for r in files.replay_faults(files.read_replay(spark, str(tmp_path / "r.jsonl"), 4, 2).where("size(violations) = 0")).collect()}
    assert faults == {"order": 0, "parted": 0, "changed": 0, "incumbent": 0}


def test_files(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        np.save(tmp_path / split / "A-1.npy", np.arange(6.0).reshape(3, 2))
    assert [(r["split"], r["t"], r["x"]) for r in files.read_series(spark, str(tmp_path)).orderBy("split", "t").collect()][:2] == [("test", 0, 0.0), ("test", 1, 2.0)]
    own = files.hashes(spark, str(tmp_path), "*.npy")
    text = "# files\n" + "".join(f"{r['sha256']}  {r['path']}\n" for r in own.collect()) + "0" * 64 + "  test/gone.npy\n"
    (tmp_path / "manifest").write_text(text)
    assert tuple(files.verified(files.read_manifest(spark, str(tmp_path / "manifest")), own).first()) == (1, 0)
    (tmp_path / "labels.csv").write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\nA-2,one,"[[200, 260], [255, 270]]","[point, contextual]",350\n')
    got = sequences.merged_windows(files.read_labels(spark, str(tmp_path / "labels.csv")), ["channel"]).first()
    assert (got["start"], got["end"], got["class"]) == (200, 270, "contextual+point")


def test_replay_holds_all_events(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    r = views.replay(spark, sf)
    assert r.count() == n and r.agg(F.count_distinct("line"), F.min("line"), F.max("line")).first()[:] == (n, 0, n - 1)
    assert sum(x["frame_count"] for x in catalog.QUERIES["q_replay_metrics"](spark, sf).collect()) == n


def test_bootstrap_draws(spark):
    channels = spark.createDataFrame([("a", 3, 1, 0), ("b", 1, 2, 2), ("c", 2, 0, 1)], "channel string, tp long, fp long, fn long")
    got = outcomes.bootstrap(channels).first()
    idx = np.random.default_rng(np.random.SeedSequence(0)).integers(0, 3, (10_000, 3))
    tp, fp, fn = (np.array(x)[idx].sum(1) for x in ([3, 1, 2], [1, 2, 0], [0, 2, 1]))
    want = np.quantile(2 * tp / (2 * tp + fp + fn), [0.025, 0.975])
    assert (got["low"], got["high"]) == pytest.approx(tuple(want))


def test_resamples_beyond_the_sent_size(spark, monkeypatch):
    rows = spark.createDataFrame([(g, c, t, 5, f) for g in "xy" for c, t, f in (("a", 3, 1), ("b", 1, 2), ("c", 5, 0))], "g string, c string, tp long, events long, fp long")
    one = {(r["g"], r["rep"]): r["f1"] for r in statistics.resampled_f1(rows, ["g"], "c", 40, 7).collect()}
    monkeypatch.setattr(statistics, "SENT", 0)
    assert {(r["g"], r["rep"]): pytest.approx(r["f1"]) for r in statistics.resampled_f1(rows, ["g"], "c", 40, 7).collect()} == one


def test_long_streams(spark):
    """Recursions over 3,000 steps, far beyond what a window of steps holds."""
    z = np.random.default_rng(1).normal(size=3000)
    z[5] = 1e12  # its trace must last
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)], "s int, step long, z double").repartition(4)
    e, want = 0.0, []
    for v in z:
        e = 0.2 * v + 0.8 * e
        want.append(abs(e) / (0.2 / 1.8) ** 0.5)
    assert np.allclose([r["ewma"] for r in sequences.ewma(rows, ["s"]).orderBy("step").collect()], want, rtol=1e-9, atol=1e-12)


def test_stream_of_types_follows_the_data(spark, tmp_path):
    rows = [(i, i % 20, "abc"[i % 3], 1.0 + i, f"2024-0{1 + i % 3}-1{i % 9} 00:00:00") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = views.type_streams(spark, str(tmp_path)).agg(F.sum("x"), F.max("step")).first()
    assert got[0] == sum(r[3] for r in rows) and got[1] > 60


def hand_replay(spark, tmp_path):
    """Nine frames: two quiet, a burst that starts late, a shock, a noisy peak and a quiet one."""
    quiet, late, peak = [0.0] * 512, [0.0] * 512, [0.0] * 512
    late[96:128], peak[160] = [0.8] * 32, 0.6
    kinds = [(quiet, "Stable", None, [])] * 2 + [(quiet, "Burst", "b1", [3]), (late, "Burst", "b1", [3]), (late, "Burst", "b1", [3])] + [([0.8] * 512, "Shock", "s1", list(range(16)))] * 2 + [(peak, "Noisy", None, []), (quiet, "Noisy", None, [])]
    lines = [{"timestamp": f"2026-01-01T00:00:0{i}+00:00", "channels": x, "regime": r, "event_label": "none" if e is None else "event", "event_id": e, "affected_blocks": b} for i, (x, r, e, b) in enumerate(kinds)]
    (tmp_path / "hand.jsonl").write_bytes(outputs.jsonl_bytes(lines))
    return files.sound_replay(spark, str(tmp_path / "hand.jsonl"))


def test_replay_by_hand(spark, tmp_path):
    frames = hand_replay(spark, tmp_path)
    protocol = {"detectors": ["blend", "peak"], "warmup": 16, "threshold_policy": {"mode": "fixed", "thresholds": {"blend": 0.5, "peak": 0.5}}}
    head, rows = replay.report(frames, protocol)
    got = {(r["detector"], r["regime"]): r for r in rows.collect()}
    assert head["comparison_is_calibrated"] is False and head["fairness_note"] and head["input"]["regimes_in_first_seen_order"] == ["Stable", "Burst", "Shock", "Noisy"]
    b = got["blend", "Burst"]
    assert (b["event_recall"], b["mean_latency_ms"], b["tp_blocks"], b["fn_blocks"], b["localization_recall"]) == (1.0, 1000.0, 2, 1, pytest.approx(2 / 3))
    assert got["blend", "Noisy"]["false_positive_frame_count"] == 0 and got["peak", "Noisy"]["false_positive_frame_count"] == 1
    n = got["peak", "Noisy"]
    assert (n["observed_exposure_seconds"], n["false_positive_frames_per_10min"], n["event_recall"], n["localization_precision"]) == (2.0, 300.0, None, 0.0)
    assert got["blend", "Shock"]["localization_iou"] == 1.0 and got["blend", "Stable"]["latency_by_event_id"] is None
    with pytest.raises(ValueError, match="free of events"):
        replay.calibrated(detectors.create("blend"), frames, 0.01)
    with pytest.raises(ValueError, match="not the locked one"):
        replay.report(frames, protocol | {"threshold_policy": {"mode": "calibrated", "target_fp": 0.01, "calibration_sha256": "a" * 64}}, frames, "b" * 64)


def test_replay_goldens(spark, tmp_path):
    paths = outputs.write_replay_inputs(tmp_path)
    assert outputs.file_sha256(paths["calibration"]) == "1293face1007a9dee9e25d951dd9942ae1da4e0f75822a5cad781948e04453dd"
    clean = files.sound_replay(spark, str(paths["calibration"]))
    t, per = replay.calibrated(detectors.create("blend"), clean, 0.01)
    assert t == pytest.approx(0.449978486531, abs=1e-12) and [r["allowed_exceedances"] for r in per] == [3, 3]
    frames = files.sound_replay(spark, str(paths["replay"]))
    _, rows = replay.report(frames, {"detectors": ["blend"], "warmup": 16, "threshold_policy": {"mode": "fixed", "thresholds": {"blend": t}}})
    got = {r["regime"]: r for r in replay.card(rows).collect()}
    assert got["Noisy"]["false_positive_frame_count"] == 1 and got["Noisy"]["false_positive_frames_per_10min"] == 10.0
    assert got["Localized Burst"]["event_recall"] == got["Global Shock"]["localization_iou"] == 1.0 and got["Localized Burst"]["event_count"] == 2


def test_faulty_replays(spark, tmp_path):
    ok = {"timestamp": "2024-01-01T00:00:00+00:00", "channels": [0.0] * 4, "regime": "S", "event_label": "none", "event_id": None}
    at = lambda i, **more: ok | {"timestamp": f"2024-01-01T00:00:{i:02d}+00:00"} | more
    event = {"event_label": "e", "event_id": "e1"}
    cases = {"order": [at(1), at(1)], "parted": [at(0, **event), at(1), at(2, **event)], "changed": [at(0, **event), at(1, **event | {"event_label": "f"})], "incumbent": [at(0, incumbent_alarm=True), at(1)], "line 2": [at(0), at(1, extra=1)], "no frames": []}
    for name, lines in cases.items():
        path = tmp_path / f"{name.replace(' ', '')}.jsonl"
        path.write_bytes(outputs.jsonl_bytes(lines))
        with pytest.raises(ValueError, match=name):
            files.sound_replay(spark, str(path), 4, 2)


def test_compare_goldens(spark):
    """Thresholds of a thousand generated clean frames at a budget of 1 %."""
    c = Compare(tracks=("frame",), detectors=("blend", "zscore", "blend-robust"))
    thresholds, records = scorecard.calibration(spark, c, "frame", scorecard.fitted(spark, c))
    assert {k: round(v, 5) for k, v in thresholds.items()} == {"blend": 0.45431, "zscore": 1.22580, "blend-robust": 1.75019}
    assert all(0 < r["per_regime"]["noisy"]["calibration_fp_rate"] <= 0.01 for r in records)


def test_next_above(spark):
    x = [0.0, 0.45431, 1.0, 2.0, -1.0, -2.0, 1e-300, 3.9999999999999996, 1e300, 0.1, *(np.random.default_rng(0).normal(size=200) * 10.0 ** np.random.default_rng(1).integers(-20, 20, 200))]
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", scorecard.next_above(F.col("x")).alias("y")).collect()
    assert all(r["y"] == np.nextafter(r["x"], np.inf) for r in rows)


def test_settings():
    assert (Streams().onset_min, Streams().onset_max, Frames().many) == (24, 48, 8)
    assert settings.grid(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]
    assert Stress(scenarios=("drift", "dropout_burst")).scenarios == ("clean_burst", "dropout_burst", "drift")
    for bad in (lambda: Frames(channels=10), lambda: Frames(weights=(0.5, 0.5, 0.5)), lambda: Frames(fraction=0.0), lambda: Streams(steps=10, warmup=9), lambda: Compare(detectors=("blend", "blend")), lambda: Compare(target_fp=1.0), lambda: Stress(scenarios=("none",)), lambda: settings.grid(1, 0, 0.1), lambda: Evaluation(candidate="none"), lambda: settings.threshold(float("nan"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        settings.whole("trials", True)


def test_online_equals_batch(spark, tmp_path):
    """A stream in many micro-batches gives what the batch detectors give; late rows are left out."""
    f, s = Frames(channels=32, size=8), Streams(steps=40)
    rows = scenarios.streams(spark, 1, f, s, regimes=("stream_shift", "stream_burst")).cache()
    steps = blocks.array_stats(rows, ["regime", "step"], "channels", 8).groupBy("regime", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "mean"))), lambda x: x["mean"]).alias("means")).cache()
    for i in range(4):
        steps.where((F.col("step") >= 10 * i) & (F.col("step") < 10 * i + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    steps.where("step = 3").withColumn("means", F.transform("means", lambda x: x + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # late
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.scores(stream, "regime", online.OnlineCusum).writeStream.outputMode("append").format("memory").queryName("online").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(240)
    got = {(r["regime"], r["step"], r["block"]): r["score"] for r in spark.table("online").collect()}
    want = {(r["regime"], r["step"], r["block"]): r["score"] for r in detectors.create("cusum", f).score(rows.select("regime", "step", "channels"), ["regime"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_online_machines():
    a = online.OnlineAlerts(2.0, ratio=0.5, gap=1, least=2, rest=3)
    x = [0, 3, 1.5, 0, 1.5, 3, 0, 0, 0, 3, 3, 0, 0, 0, 1.5, 1.5, 0, 0, 0, 0, 3, 3]
    got = [g for g in (a.step(i, v) for i, v in enumerate(x)) if g] + [a.close()]
    assert got == [(1, 5), (9, 10), (20, 21)]
    t = online.OnlineThreshold(20, window=40, initial=0.8, risk=0.05, least=3)
    scores = np.random.default_rng(2).exponential(size=80)
    seen = [t.step(s) for s in scores]
    batch = Threshold(window=40, initial=0.8, risk=0.05, least=3).calibrated(scores[:20])
    assert seen[:20] == [(None, False)] * 20 and [u for u, _ in seen[20:]] == [batch.update(s)[1] for s in scores[20:]]
    assert t.step(1.0, reset=True) == (None, False) and len(t.s["waiting"]) == 1


def test_late_data(spark, tmp_path):
    """With a watermark of an hour, a row five hours late changes no window."""
    rows = lambda mins, kind="a": spark.createDataFrame([(m, kind, 1.0) for m in mins], "m int, event_type string, value double").select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("m"))).alias("ts"), "event_type", "value")
    for part in (range(0, 600, 10), range(600, 1300, 10), [5, 6, 7]):
        rows(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = windowed(spark.readStream.schema(rows([1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table("late").orderBy("start").collect()
    assert got and got[0]["n"] == 36


def test_outputs(tmp_path, spark):
    assert outputs.json_bytes({"b": 1, "a": None}) == b'{\n  "a": null,\n  "b": 1\n}\n'
    with pytest.raises(ValueError):
        outputs.json_bytes({"a": float("nan")})
    assert outputs.csv_bytes([{"a": None, "b": "x,y"}], ["a", "b"]) == b'a,b\n,"x,y"\n'
    with pytest.raises(ValueError):
        outputs.csv_bytes([{"c": 1}], ["a"])
    hashes = outputs.write_set(tmp_path, {"x.json": b"{}\n"}, {"meta.json": outputs.json_bytes(outputs.metadata(["a"], 1.0))})
    assert (tmp_path / "SHA256SUMS").read_text() == f"{hashes['x.json']}  x.json\n" and outputs.file_sha256(tmp_path / "x.json") == hashes["x.json"]
    rows = [{"track": "frame", "detector": "blend", "fp_rate": 0.01, "recall": None}, {"track": "stream", "detector": "ewma", "fp_rate": None, "recall": 1.0}]
    assert "| blend | 0.01 |" in outputs.scorecard_markdown("card", rows)
    summary = [{"subset": "all_channels", "target_fp": 0.01, "dataset": "A", "method": m, "event_f1": f, "event_f1_ci_low": f / 2, "event_f1_ci_high": 1.0} for m, f in (("blend", 0.5), ("peak", 0.25))]
    assert outputs.bar_chart(summary, 0.01).count("<rect") == 2 and outputs.bar_chart([], 0.01).startswith("<svg")
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "i long, g string, x double")
    for kind in ("parquet", "jsonl", "csv"):
        outputs.write_table(df, str(tmp_path / kind), ["g"] if kind == "parquet" else (), kind)
    assert sorted(spark.read.parquet(str(tmp_path / "parquet")).select("i", "g", "x").collect()) == sorted(df.collect())
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "jsonl")).collect()) == ['{"i":1,"g":"a","x":null}', '{"i":2,"g":"b","x":0.5}']
    assert spark.read.csv(str(tmp_path / "csv"), header=True, schema="i long, g string, x double").orderBy("i").collect() == df.orderBy("i").collect()


def prereg(**more):
    return {"schema_version": 2, "protocol_id": "p", "locked_at": "2026-01-01T00:00:00Z", "score_spec": {"channel_count": 512, "block_size": 32, "weights": {"peak_abs": 0.45, "rms": 0.35, "mean_abs": 0.20}, "comparison": ">="}, **protocols.RULES, "detectors": ["theirs", "peak"], "threshold_policy": {"mode": "fixed", "thresholds": {"theirs": 0.5, "peak": 0.6}}} | more


def test_protocols(tmp_path):
    def read(obj, **given):
        (tmp_path / "p.json").write_bytes(outputs.json_bytes(obj))
        return protocols.preregistration(tmp_path / "p.json", **given)

    got, sha = read(prereg(), aliases={"theirs": "blend"})
    assert got["detectors"] == ["blend", "peak"] and got["threshold_policy"]["thresholds"] == {"blend": 0.5, "peak": 0.6} and sha == outputs.file_sha256(tmp_path / "p.json")
    first = {k: v for k, v in prereg(schema_version=1, candidate_threshold=0.5, baseline_max_abs_threshold=0.4).items() if k not in ("detectors", "threshold_policy")}
    assert read(first)[0]["threshold_policy"] == {"mode": "fixed", "thresholds": {"blend": 0.5, "peak": 0.4}}
    own = {"detectors": ["blend", "peak"], "threshold_policy": {"mode": "fixed", "thresholds": {"blend": 0.5, "peak": 0.6}}}
    for bad in ({"extra": 1}, {"schema_version": True}, {"detectors": ["blend", "blend"]}, {"locked_at": "2026-01-01"}, {"latency_rule": "other"}, {"warmup": 1}, {"threshold_policy": {"mode": "calibrated", "target_fp": 1.5, "unit": "frame", "calibration_sha256": "a" * 64}}, {"detectors": ["nothing", "peak"], "threshold_policy": {"mode": "fixed", "thresholds": {"nothing": 1, "peak": 1}}}):
        with pytest.raises(protocols.Refused):
            read(prereg(**own) | bad)
    locked = {"methods": {"blend": {"window": 16}, "zscore": {}}, "candidate": "blend", "calibration": {"primary_target_fp": 0.01, "secondary_target_fp": [0.05]}, "uncertainty": {"bootstrap_resamples": 100, "seed": 1}}
    (tmp_path / "l.json").write_bytes(outputs.json_bytes(locked))
    e, _, sha = protocols.locked(tmp_path / "l.json")
    assert (e.methods, e.targets, e.window, e.resamples) == (("blend", "zscore"), (0.01, 0.05), 16, 100)
    with pytest.raises(protocols.Refused):
        protocols.locked(tmp_path / "l.json", "0" * 64)
    with pytest.raises(protocols.Refused):
        protocols.once(tmp_path / "l.json")


def test_fetch(spark, tmp_path):
    data, made = tmp_path / "data", tmp_path / "made"
    for split in ("train", "test"):
        (made / split).mkdir(parents=True)
        np.save(made / split / "A-1.npy", np.arange(6.0).reshape(3, 2))
    (made / "labeled_anomalies.csv").write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\nA-1,one,"[[1, 2]]","[point]",3\n')
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for p in sorted(made.rglob("*.*")):
            z.write(p, f"deep/data/{p.relative_to(made)}" if p.suffix == ".npy" else f"deep/{p.name}")
        z.writestr("../../evil.npy", b"x")
    (tmp_path / "manifest").write_text(outputs.dataset_manifest(files.hashes(spark, str(made))))
    got = protocols.fetch(spark, data, tmp_path / "manifest", [f"file://{tmp_path}/none.zip", f"file://{tmp_path}/a.zip"], keep=False)
    assert got["files"] == got["extracted"] == 3 and len(got["errors"]) == 1 and not (data / "download.zip").exists() and not (tmp_path / "evil.npy").exists()
    (data / "train" / "A-1.npy").write_bytes(b"other")
    with pytest.raises(ValueError, match="1 differ"):
        protocols.fetch(spark, tmp_path / "two", tmp_path / "manifest", archive=tmp_path / "a.zip") and files.require_verified(files.read_manifest(spark, str(tmp_path / "manifest")), files.hashes(spark, str(data)))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    assert cli.main(["nothing"]) == cli.USAGE
    assert cli.main(["run", "--trials", "30", "--out", str(tmp_path)]) == cli.DONE
    rows = json.loads((tmp_path / "run_results.json").read_text())
    assert {c["check"]: c["passed"] for c in rows["checks"]} and (tmp_path / "run.sha256").exists()
    assert cli.main(["run", "--trials", "20", "--threshold", "5", "--out", str(tmp_path)]) == cli.UNMET
    assert cli.main(["replay", "--replay", str(tmp_path / "none"), "--protocol", str(tmp_path / "none"), "--out", str(tmp_path)]) == cli.REFUSED
    assert cli.main(["sweep", "--trials", "10", "--first", "0.4", "--last", "0.5", "--step", "0.1", "--out", str(tmp_path)]) == cli.DONE
    assert json.loads((tmp_path / "sweep.json").read_text())["rows"][0]["threshold"] == 0.4
    assert cli.verified(lambda: {"a": str(time.perf_counter()).encode()}, True)[1] == cli.DIFFERS


def test_search_space():
    assert [len(list(f())) for f in (search.windows, search.rules, search.norms, search.posts, search.complements)] == [140, 15, 18, 400, 11]
    c = {"normalization": search.NORM, "window": {"length": 8, "aggregation": "median", "topk": 1, "smoothing": 3}, "threshold": {}, "postprocess": search.POST | {"cooldown": 2}, "complementary": {"feature": "rolling_mad", "combination": "max"}}
    assert search.complexity(c) == 5
    t = lambda i, f1, feature, **more: {"trial": i, "event_f1": f1, "complexity": 0, "event_precision": 0.5, "macro_channel_f1": 0.5, "fp": 1, "runtime_s": 0.1, "config": json.dumps({"complementary": {"feature": feature}})} | more
    assert search.chosen([t(1, 0.5, "none"), t(2, 0.505, "rolling_mad")])["selected"]["trial"] == 1
    assert search.chosen([t(1, 0.5, "none"), t(2, 0.52, "rolling_mad")])["selected"]["trial"] == 2
    assert search.constraints({"event_precision": 0.6, "event_recall": 0.6, "event_f1": 0.6}, {"event_f1": 0.5}, 1.5) == dict.fromkeys(("event_precision>=0.55", "event_recall>=0.55", "improvement>=0.05", "runtime_ratio<=2", "zero_test_influence"), True)


def test_recovered():
    flags = np.zeros(20, bool)
    values = np.full(20, 2.0)
    values[8:12] = 3.0
    flags[13] = True
    assert scorecard.recovered(flags, values, 2.0, 0.2, 8, 20) == 9 and scorecard.recovered(flags, values, 2.0, 0.2, 8, 15) is None


def test_forest(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(300, 2)), [[6.0, 6.0]]]
    trees, n = forest.grow(x, 60, 128, 1)
    s = forest.isolation(trees, n, x)
    assert n == 128 and s.argmax() == 300 and s[300] > 0.6 > np.median(s) and forest.mean_path(256) == pytest.approx(10.24, abs=0.01)


def test_exact_ranks_of_large_groups(spark, monkeypatch):
    """The way for large groups against numpy: ties, few values, nulls."""
    monkeypatch.setattr(quantiles, "PLAIN", -1)
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=5000), "b": np.round(rng.normal(size=4000), 1), "c": np.array([3.0]), "d": np.array([1.0, 2.0]), "e": np.full(700, 5.0)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None)], "g string, x double").repartition(5)
    for q in (0.0, 0.01, 0.5, 0.77, 1.0):
        got = {r["g"]: r["v"] for r in quantiles.quantile(rows, ["g"], "x", q, "v").collect()}
        assert got == {g: pytest.approx(np.quantile(x, q)) for g, x in groups.items()}
    some = rows.where("x is not null")
    cut = {r["g"]: r["cut"] for r in evaluation.cuts(some, ["g"], 0.03, "x").collect()}
    assert cut == {g: sorted(x, reverse=True)[min(int(0.03 * len(x) + 1e-9), len(x) - 1)] for g, x in groups.items()}
    base = {r["g"]: (r["centre"], r["scale"]) for r in blocks.centre_and_scale(some, ["g"], "x").collect()}
    assert base["a"] == (pytest.approx(np.median(groups["a"])), pytest.approx(1.4826 * np.median(np.abs(groups["a"] - np.median(groups["a"])))))


def test_matches_in_buckets(spark):
    rng = np.random.default_rng(8)
    spans, events = ([("c", int(a), int(a + n)) for a, n in zip(rng.integers(0, 500, 40), rng.integers(0, 90, 40))] for _ in range(2))
    made = [spark.createDataFrame(x, "c string, start long, end long") for x in (spans, events)]
    got = sorted((r["run_start"], r["run_end"], r["start"], r["end"]) for r in evaluation.matches(*made, ["c"], 16).collect())
    assert got == sorted((a, b, s, e) for _, a, b in spans for _, s, e in events if a <= e and b >= s)


def test_series_lengths_and_tables(spark, tmp_path):
    series = spark.createDataFrame([("A", "test", t, 0.0) for t in range(3)], "channel string, split string, t long, x double")
    labels = lambda n: spark.createDataFrame([("A", n)], "channel string, num_values long")
    assert files.require_lengths(series, labels(3)).count() == 3
    with pytest.raises(Exception, match="another length"):
        files.require_lengths(series, labels(4)).count()
    long = spark.createDataFrame([("A", "train", t, 0.0) for t in range(1000)] + [("A", "test", 0, 0.0)], "channel string, split string, t long, x double")
    r = files.series_manifest(long, spark.createDataFrame([("A", 5, 9)], "channel string, start long, end long")).first()
    assert (r["train"], r["test"], r["fit_end"], r["val_start"], r["has_validation"], r["events"]) == (1000, 1, 572, 700, True, [[5, 9]])
    a, b = spark.createDataFrame([("m", 0.5)], "method string, event_f1 double"), spark.createDataFrame([("n", 0.4, 1)], "method string, event_f1 double, tp int")
    assert {(r["source"], r["method"], r["tp"]) for r in search.side_by_side({"one": a, "two": b}).collect()} == {("one", "m", None), ("two", "n", 1)}
    outputs.atomic_write(tmp_path / "t.csv", outputs.csv_bytes([{"trial": 1, "status": "ok", "config": '{"a": 1}'}, {"trial": 2, "status": "failed", "config": "{}"}], ["trial", "status", "config"]))
    assert [(r["trial"], r["config"]) for r in search.read_trials(spark, str(tmp_path / "t.csv")).collect()] == [(1, '{"a": 1}')]


def test_series_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    rng = np.random.default_rng(3)
    for split in ("train", "test"):
        (tmp_path / "data" / split).mkdir(parents=True)
        for c in "AB":
            x = rng.normal(size=(300, 2))
            x[100:120, 0] += 9 if split == "test" else 0
            np.save(tmp_path / "data" / split / f"{c}-1.npy", x)
    (tmp_path / "data" / "labeled_anomalies.csv").write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\n' + "".join(f'{c}-1,{d},"[[100, 119]]","[point]",300\n' for c, d in ("A1", "B2")).replace("A-1,1", "A-1,one").replace("B-1,2", "B-1,two"))
    (tmp_path / "manifest").write_text(outputs.dataset_manifest(files.hashes(spark, str(tmp_path / "data"))))
    (tmp_path / "p.json").write_bytes(outputs.json_bytes({"methods": {"theirs": {"window": 8}, "zscore": {}}, "candidate": "theirs", "calibration": {"primary_target_fp": 0.01}, "uncertainty": {"bootstrap_resamples": 50, "seed": 1}}))
    common = ["series", "--data", str(tmp_path / "data"), "--protocol", str(tmp_path / "p.json"), "--manifest", str(tmp_path / "manifest"), "--alias", "theirs=blend", "--out", str(tmp_path / "out")]
    assert cli.main(common) == cli.DONE
    got = json.loads((tmp_path / "out" / "series_results.json").read_text())
    assert {(r["dataset"], r["method"]): r["event_recall"] for r in got["summary"] if r["subset"] == "all_channels"} == {(d, m): 1.0 for d in ("one", "two") for m in ("blend", "zscore")}
    assert got["data_manifest"] == {"files": 5} and got["headline"]["criterion_met"] is False and (tmp_path / "out" / "series_f1.svg").read_text().count("<rect") == 4
    assert cli.main([*common, "--diagnostics"]) == cli.DONE and (tmp_path / "out" / "series_diagnostics.csv").read_text().count("\n") == 5
    assert cli.main([*common, "--expected", "0" * 64]) == cli.REFUSED


def test_exposure_of_many_runs(spark):
    """20,000 runs of two frames a second apart: their times in microseconds add up to more than a long holds."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    frames = spark.range(80_000).select(F.col("id").alias("line"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("regime"), at.alias("timestamp"))
    assert {r["regime"]: r["exposure"] for r in replay.exposure(frames).collect()} == {"a": 40_000.0, "b": 40_000.0}
