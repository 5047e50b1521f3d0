"""Detectors by name: what each needs, how it learns from clean rows and scores frames or streams.

Rows are frames (unit columns and an array of channels) or steps of streams (with a ``step`` column too); scores
are rows (unit columns, [step,] block, score), finite and 0 or more; alarms are scores of the threshold or more.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from importlib import metadata
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.columns import status
from ..settings import Frames
from . import blocks, forest, sequences

SMALLEST = 1e-9


def gate(rows: DataFrame, frames: Frames, missing: bool, vector: str = "channels") -> DataFrame:
    """``rows``, which fail when read if a vector has another length, holds an infinity, or a missing value that is not allowed."""
    fine = F.coalesce(F.size(vector) == frames.channels, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(missing)) | (F.lit(missing) & F.isnan(x)))
    return rows.withColumn(vector, F.when(fine, F.col(vector)).otherwise(F.raise_error(F.lit(f"telemetry is not {frames.channels} channels of finite values"))))


@dataclass(frozen=True)
class Detector:
    """Subclasses give ``frame_scores`` or ``stream_scores`` and, if they need it, ``learn``."""

    name: ClassVar[str] = ""
    rule: ClassVar[str] = ""
    default: ClassVar[float] = 0.5
    temporal: ClassVar[bool] = False
    requires_fit: ClassVar[bool] = False
    supports_missing: ClassVar[bool] = True

    frames: Frames = field(default_factory=Frames)
    threshold: float | None = None
    fitted: Any = None

    def __post_init__(self):
        object.__setattr__(self, "threshold", settings.threshold(self.default if self.threshold is None else self.threshold))

    def learn(self, rows: DataFrame, keys: list[str]) -> Any:
        return True

    def frame_scores(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        raise NotImplementedError

    def stream_scores(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        raise NotImplementedError

    def fit(self, rows: DataFrame, keys: list[str]) -> Detector:
        """A detector that has learned from clean ``rows``, none of whose channels may be missing."""
        return replace(self, fitted=self.learn(gate(rows, self.frames, False), keys))

    def score(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        if self.requires_fit and self.fitted is None:
            raise ValueError(f"{self.name} must be fitted first")
        rows, own = gate(rows, self.frames, self.supports_missing), [*keys, *(["step"] if "step" in rows.columns else [])]
        return self.stream_scores(rows, keys) if self.temporal else self.frame_scores(rows, own)

    def detect(self, rows: DataFrame, keys: list[str], threshold: float | None = None) -> DataFrame:
        return self.score(rows, keys).withColumn("detected", F.col("score") >= (self.threshold if threshold is None else settings.threshold(threshold)))

    def params(self) -> dict:
        return {}

    def result(self, rows: DataFrame, keys: list[str], threshold: float | None = None) -> Result:
        t = self.threshold if threshold is None else settings.threshold(threshold)
        return Result(self, t, self.detect(rows, keys, t), [*keys, *(["step"] if "step" in rows.columns else [])])


@dataclass(frozen=True)
class Result:
    """Scores with marks; a status per unit, and what explains the result."""

    detector: Detector
    threshold: float
    marks: DataFrame
    keys: list[str]

    def units(self) -> DataFrame:
        """Rows (unit columns, detected_blocks, status)."""
        out = self.marks.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.when(F.col("detected"), F.col("block")))).alias("detected_blocks"))
        f = self.detector.frames
        return out.withColumn("status", status(F.size("detected_blocks"), f.blocks, f.fraction))

    def explain(self) -> dict:
        """Rule, settings, number of marks, and the top block of the last unit (of equals the first)."""
        last = self.marks.groupBy(*self.keys).agg(F.sum(F.col("detected").cast("long")).alias("n"), F.max(F.struct("score", (-F.col("block")).alias("b"))).alias("top"))
        row = last.agg(F.sum("n").alias("n"), F.max_by("top", F.struct(*self.keys)).alias("top")).first()
        d = self.detector
        return {"detector": d.name, "rule": d.rule, "threshold": self.threshold, "params": d.params(), "temporal": d.temporal, "detected_count": row["n"], "top_block_last_frame": -row["top"]["b"] if row["top"] else None, "top_score_last_frame": row["top"]["score"] if row["top"] else None}

    def to_dict(self) -> dict:
        """Ready for JSON: for results of few units, which come to the driver."""
        rows = self.marks.groupBy(*self.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "score"))), lambda x: x["score"]).alias("scores")).join(self.units(), self.keys).orderBy(*self.keys).collect()
        return {"detector": self.detector.name, "threshold": self.threshold, "scores": [r["scores"] for r in rows], "detected_blocks": [r["detected_blocks"] for r in rows], "status": [r["status"] for r in rows], "explanation": self.explain()}


def sound(scores: DataFrame) -> DataFrame:
    """``scores``, which fail when read if one is null, not finite or under 0."""
    fine = F.coalesce((F.col("score") >= 0) & (F.col("score") < float("inf")), F.lit(False))
    return scores.withColumn("score", F.when(fine, F.col("score")).otherwise(F.raise_error(F.lit("a score is not finite and 0 or more"))))


_known: dict[str, type[Detector]] = {}


def register(kind: type[Detector], replace: bool = False) -> type[Detector]:
    settings.detector_name(kind.name)
    if kind.name in _known and not replace:
        raise ValueError(f"{kind.name} is registered")
    _known[kind.name] = kind
    return kind


def unregister(name: str) -> None:
    _known.pop(name, None)


def available() -> list[str]:
    return sorted(_known)


def get(name: str) -> type[Detector]:
    if name not in _known:
        raise KeyError(f"no detector {name!r}; there are {', '.join(available())}")
    return _known[name]


def create(name: str, frames: Frames | None = None, **given) -> Detector:
    kind = get(name)
    return kind(**({} if frames is None else {"frames": frames}), **{k: v for k, v in given.items() if k in kind.__dataclass_fields__})


def load_plugins(group: str = "tidegauge.detectors") -> dict[str, str | None]:
    """Registers what installed packages offer under ``group``: a name for each entry point, null where it failed, with a warning."""

    def loaded(point) -> str | None:
        try:
            return register(point.load()).name
        except Exception as e:  # whatever a plugin does wrong concerns it alone
            return warnings.warn(f"{point.name} of {group} is left out: {e!r}", stacklevel=3)

    return {point.name: loaded(point) for point in metadata.entry_points(group=group)}


# Frames.


@register
@dataclass(frozen=True)
class Blend(Detector):
    name = "blend"
    rule = "weighted peak, RMS and mean absolute value of a block's observed channels"

    def frame_scores(self, rows, keys):
        s, w = blocks.array_stats(rows, keys, "channels", self.frames.size), self.frames.weights
        return s.select(*keys, "block", (w[0] * F.col("peak") + w[1] * F.col("rms") + w[2] * F.col("mean_abs")).alias("score"))

    def params(self):
        return {"weights": list(self.frames.weights)}


@register
@dataclass(frozen=True)
class Peak(Detector):
    name = "peak"
    rule = "largest absolute value of a block"

    def frame_scores(self, rows, keys):
        return blocks.array_stats(rows, keys, "channels", self.frames.size).select(*keys, "block", F.col("peak").alias("score"))


def fixed(base: DataFrame, key: str) -> list[tuple]:
    """A learned table with a row per block or channel, on the driver: its size is that of a frame."""
    return [(r[key], r["centre"], r["scale"]) for r in base.collect()]


@register
@dataclass(frozen=True)
class ZScore(Detector):
    name = "zscore"
    rule = "distance of a block's statistic from its median over clean frames, in scaled MADs"
    default = 3.5
    requires_fit = True

    statistic: str = "rms"

    def __post_init__(self):
        super().__post_init__()
        if self.statistic not in ("rms", "mean", "mean_abs"):
            raise ValueError(f"no statistic {self.statistic!r}")

    def learn(self, rows, keys):
        return fixed(blocks.centre_and_scale(blocks.array_stats(rows, keys, "channels", self.frames.size), ["block"], self.statistic), "block")

    def frame_scores(self, rows, keys):
        base = F.broadcast(rows.sparkSession.createDataFrame(self.fitted, "block long, centre double, scale double"))  # a row per block
        s = blocks.array_stats(rows, keys, "channels", self.frames.size).join(base, "block")
        return s.select(*keys, "block", F.when(F.col("observed") > 0, F.abs(F.col(self.statistic) - F.col("centre")) / F.col("scale")).otherwise(0.0).alias("score"))

    def params(self):
        out = {"statistic": self.statistic}
        return out | ({"mean_centre": float(np.mean([b[1] for b in self.fitted])), "mean_scale": float(np.mean([b[2] for b in self.fitted]))} if self.fitted else {})


@register
@dataclass(frozen=True)
class RobustBlend(Detector):
    name = "blend-robust"
    rule = "weighted mean of the four largest, Huber mean and median of the channels' robust residuals"
    default = 4.0
    requires_fit = True

    def learn(self, rows, keys):
        cell = blocks.cells(rows, keys, "channels", self.frames.size)
        return fixed(blocks.centre_and_scale(cell, ["channel"], "x"), "channel")

    def frame_scores(self, rows, keys):
        n, size = self.frames.blocks, self.frames.size
        base = {c: (m, s) for c, m, s in self.fitted}
        centre, scale = (F.array(*(F.lit(base[c][i]) for c in range(self.frames.channels))) for i in (0, 1))

        def fold(b):
            part = F.transform(F.arrays_zip(F.slice("channels", b * size + 1, size).alias("x"), F.slice("_centre", b * size + 1, size).alias("c"), F.slice("_scale", b * size + 1, size).alias("s")), lambda v: F.abs(F.nanvl(v["x"], F.lit(None).cast("double")) - v["c"]) / v["s"])
            r = F.array_sort(F.filter(part, lambda x: x.isNotNull()))
            k = F.size(r)
            mean = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x)) / F.size(a)
            top = F.slice(r, F.greatest(k - 3, F.lit(1)), 4)
            mid = (F.element_at(r, F.floor((k + 1) / 2).cast("int")) + F.element_at(r, F.floor((k + 2) / 2).cast("int"))) / 2
            loss = lambda x: F.when(x <= 1.345, 0.5 * x * x).otherwise(1.345 * (x - 0.6725))
            w = self.frames.weights
            return F.struct(b.cast("long").alias("block"), F.when(k > 0, w[0] * mean(top) + w[1] * F.sqrt(mean(r, loss)) + w[2] * mid).otherwise(0.0).alias("score"))

        whole = rows.withColumns({"_centre": centre, "_scale": scale})
        return whole.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fold)).alias("_b")).select(*keys, "_b.*")

    def params(self):
        out = {"top": 4, "huber_delta": 1.345}
        return out | ({"mean_centre": float(np.mean([b[1] for b in self.fitted])), "mean_scale": float(np.mean([b[2] for b in self.fitted]))} if self.fitted else {})


@register
@dataclass(frozen=True)
class Forest(Detector):
    name = "iforest"
    rule = "isolation score of a block's mean, deviation, peak and RMS in a forest grown on clean frames"
    default = 0.6
    requires_fit = True
    supports_missing = False

    trees: int = 100
    sample: int = 256
    seed: int | None = None

    def __post_init__(self):
        super().__post_init__()
        settings.whole("trees", self.trees, 1), settings.whole("sample", self.sample, 2)

    def features(self, rows, keys):
        s = blocks.array_stats(rows, keys, "channels", self.frames.size)
        return s.select(*keys, "block", F.array("mean", F.sqrt(F.greatest(F.col("rms") * F.col("rms") - F.col("mean") * F.col("mean"), F.lit(0.0))), "peak", "rms").alias("features"))

    def learn(self, rows, keys):
        return forest.grown(self.features(rows, keys), "features", [*keys, "block"], self.trees, self.sample, self.frames.seed if self.seed is None else self.seed)

    def frame_scores(self, rows, keys):
        return forest.scored(self.features(rows, keys), "features", self.fitted).drop("features")

    def params(self):
        return {"trees": self.trees, "sample": self.sample, "seed": self.frames.seed if self.seed is None else self.seed}


class ArrayDetector(Detector):
    """For detectors written on arrays: subclasses give ``array_scores``, (frames, channels) to (frames, blocks)."""

    def array_scores(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def frame_scores(self, rows, keys):
        types = {k: rows.schema[k].dataType.simpleString() for k in keys}

        def run(batches):
            for pdf in batches:
                s = np.asarray(self.array_scores(np.array(pdf["channels"].tolist(), float)), float)
                if s.shape != (len(pdf), self.frames.blocks):
                    raise ValueError(f"{self.name} gave scores of shape {s.shape}")
                n = self.frames.blocks
                yield pd.DataFrame({**{k: np.repeat(pdf[k].to_numpy(), n) for k in keys}, "block": np.tile(np.arange(n), len(pdf)), "score": s.ravel()})

        return sound(rows.select(*keys, "channels").mapInPandas(run, ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", block long, score double"))


# Streams.


@dataclass(frozen=True)
class Temporal(Detector):
    """Block means, standardised by each stream's own warm-up; warm-up steps score 0."""

    temporal = True
    warmup: int = 16

    def __post_init__(self):
        super().__post_init__()
        settings.whole("warmup", self.warmup, 2)

    def standard(self, rows, keys):
        s = blocks.array_stats(rows, [*keys, "step"], "channels", self.frames.size)
        return sequences.weighted(s, keys, "block", "mean", "observed", self.frames.size, self.warmup).withColumn("live", F.col("step") >= self.warmup)

    def params(self):
        return {"warmup": self.warmup}


@register
@dataclass(frozen=True)
class Ewma(Temporal):
    name = "ewma"
    rule = "exponentially weighted mean of z over its stationary deviation"
    default = 3.0

    lam: float = 0.2

    def stream_scores(self, rows, keys):
        return sequences.ewma(self.standard(rows, keys), [*keys, "block"], self.lam).select(*keys, "step", "block", F.col("ewma").alias("score"))

    def params(self):
        return super().params() | {"lam": self.lam}


@register
@dataclass(frozen=True)
class Cusum(Temporal):
    name = "cusum"
    rule = "larger of the two one-sided cumulative sums of z"
    default = 5.0

    k: float = 0.5

    def stream_scores(self, rows, keys):
        return sequences.cusum(self.standard(rows, keys), [*keys, "block"], self.k).select(*keys, "step", "block", F.col("cusum").alias("score"))

    def params(self):
        return super().params() | {"k": self.k}


@register
@dataclass(frozen=True)
class ChangepointCusum(Temporal):
    name = "cusum-cp"
    rule = "cumulative sums that start anew where a Bayes factor tells of a new level"
    default = 5.0

    k: float = 0.5
    m: int = 3
    hazard: float = 1 / 200
    least: float = 0.8
    tau2: float = 4.0

    def stream_scores(self, rows, keys):
        z = self.standard(rows, keys)
        live = sequences.changepoint_cusum(z.where("live"), [*keys, "block"], self.k, self.m, self.hazard, self.least, self.tau2)
        return live.select(*keys, "step", "block", "score").unionByName(z.where("not live").select(*keys, "step", "block", F.lit(0.0).alias("score")))

    def params(self):
        return super().params() | {"k": self.k, "m": self.m, "hazard": self.hazard, "least": self.least, "tau2": self.tau2}


@register
@dataclass(frozen=True)
class Hybrid(Temporal):
    name = "blend+ewma"
    rule = "larger of blend and ewma, each over a high quantile of its clean streams' maxima"
    default = 1.0
    requires_fit = True

    lam: float = 0.2
    quantile: float = 0.99

    def parts(self, rows, keys):
        b = Blend(self.frames).frame_scores(rows, [*keys, "step"]).select(*keys, "step", "block", F.when(F.col("step") < self.warmup, 0.0).otherwise(F.col("score")).alias("_blend"))
        e = Ewma(self.frames, warmup=self.warmup, lam=self.lam).stream_scores(rows, keys).withColumnRenamed("score", "_ewma")
        return b.join(e, [*keys, "step", "block"])

    def learn(self, rows, keys):
        top = self.parts(rows, keys).where(F.col("step") >= self.warmup).groupBy(*keys).agg(F.max("_blend").alias("b"), F.max("_ewma").alias("e"))
        r = top.agg(F.percentile("b", self.quantile).alias("b"), F.percentile("e", self.quantile).alias("e")).first()  # one row
        return max(r["b"], SMALLEST), max(r["e"], SMALLEST)

    def stream_scores(self, rows, keys):
        b, e = self.fitted
        return self.parts(rows, keys).select(*keys, "step", "block", F.greatest(F.col("_blend") / b, F.col("_ewma") / e).alias("score"))

    def params(self):
        return super().params() | {"lam": self.lam, "quantile": self.quantile} | ({"scales": {"blend": self.fitted[0], "ewma": self.fitted[1]}} if self.fitted else {})
