"""Online peaks-over-threshold: compare first, then learn from what was not flagged."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..settings import finite, whole


class Threshold:
    """The state of one stream: the last ``window`` accepted scores, in order of arrival and sorted, and the threshold they give.

    The fit is the moment fit of a generalised Pareto tail over the quantile ``initial``: shape .5 (1 - mean^2 / variance)
    within .45 of 0, scale mean (1 - shape). With fewer than ``least`` excesses, or a tail that cannot be fitted, the
    empirical quantile 1 - ``risk`` is used; never less than the quantile. The window stays sorted, so an update sorts nothing and
    reads its tail only.
    """

    def __init__(self, window: int = 500, initial: float = 0.98, risk: float = 1e-3, least: int = 10):
        whole("window", window, 20), whole("least", least, 1)
        if not 0 < finite("initial", initial) < 1 or not 0 < finite("risk", risk) < 1 - initial:
            raise ValueError("initial must be a quantile, and risk under what lies over it")
        self.window, self.initial, self.risk, self.least = window, initial, risk, least
        self.accepted: deque[float] = deque(maxlen=window)
        self.sorted: list[float] = []
        self.value = float("nan")

    def calibrated(self, scores) -> Threshold:
        """Fits on all of ``scores`` (20 or more, finite) and keeps the last ``window``."""
        x = np.asarray(scores, float)
        if x.ndim != 1 or len(x) < 20 or not np.isfinite(x).all():
            raise ValueError("20 finite scores are needed to calibrate")
        self.accepted = deque(x.tolist(), maxlen=self.window)
        self.value = self.fit(sorted(x.tolist()))
        self.sorted = sorted(self.accepted)
        return self

    def calibrate(self, scores) -> None:
        self.calibrated(scores)

    def reset(self, scores) -> None:
        """Forgets everything, then calibrates anew."""
        self.calibrated(scores)

    @staticmethod
    def quantile(v: list[float], q: float) -> float:
        at = (len(v) - 1) * q
        i = int(at)
        return v[i] if i + 1 >= len(v) else v[i] + (v[i + 1] - v[i]) * (at - i)

    def fit(self, v: list[float]) -> float:
        """The threshold that sorted scores give."""
        n, u = len(v), self.quantile(v, self.initial)
        first = bisect_right(v, u)
        k = n - first
        fallback = max(u, self.quantile(v, 1 - self.risk))
        if k < self.least or k / n <= self.risk:
            return fallback
        over = np.array(v[first:]) - u
        mean, var = float(over.mean()), float(over.var())
        if not mean > 1e-9:
            return fallback
        shape = 0.0 if var <= 1e-18 else min(0.45, max(-0.45, 0.5 * (1 - mean * mean / var)))
        scale = mean * (1 - shape)
        if not 1e-9 < scale < math.inf:
            return fallback
        power = math.log(k / n / self.risk)
        t = u + (scale * power if abs(shape) < 1e-6 else scale * math.expm1(max(-700.0, min(700.0, shape * power))) / shape)
        t = min(t, u - scale / shape) if shape < 0 else t
        return max(u, t) if math.isfinite(t) else fallback

    def update(self, score: float) -> tuple[bool, float]:
        """Whether the score is flagged, and the threshold it was compared with; scores that are not flagged are learned."""
        used = self.value
        if score > used:
            return True, used
        if len(self.accepted) == self.window:
            del self.sorted[bisect_left(self.sorted, self.accepted[0])]
        self.accepted.append(score)
        insort(self.sorted, score)
        self.value = self.fit(self.sorted)
        return False, used


def replayed(scores: DataFrame, stream: str, order: str, calibration: int = 20, **given) -> DataFrame:
    """Rows (stream, order, threshold, flagged): each stream's scores in order, the first ``calibration`` of them to calibrate (threshold NaN)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        x, used, flags = pdf["score"].to_numpy(), np.full(len(pdf), np.nan), np.zeros(len(pdf), bool)
        if len(x) > calibration:
            t = Threshold(**given).calibrated(x[:calibration])
            for i in range(calibration, len(x)):
                flags[i], used[i] = t.update(float(x[i]))
        return pd.DataFrame({stream: pdf[stream], order: pdf[order], "threshold": used, "flagged": flags})

    return scores.groupBy(stream).applyInPandas(run, f"{stream} long, {order} long, threshold double, flagged boolean")
