"""Detectors as streaming state: warm-up, recursions, peaks-over-threshold and alerts, step by step.

Each is a small machine with ``step(row) -> output`` whose state is plain data. ``streamed`` runs one per key as Spark
streaming state (``transformWithStateInPandas``), on streams and on tables alike; rows of a key must come in order, and one whose
step is not after the last is late and left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .pot import Threshold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Warm:
    """Block means, standardised by the warm-up of the stream they come from, and a recursion over z.

    Rows are a step's block means (NaN where no channel was observed) and the shares of channels observed. Warm-up steps score 0.
    """

    def __init__(self, warmup: int = 16):
        self.warmup, self.s = warmup, {"n": 0, "base": [], "mu": [], "sigma": 1.0}

    def z(self, means, share=None) -> np.ndarray | None:
        m = np.asarray(means, float)
        w = np.ones(len(m)) if share is None else np.sqrt(np.asarray(share, float))
        s = self.s
        s["n"] += 1
        if s["n"] <= self.warmup:
            s["base"].append([m.tolist(), w.tolist()])
            if s["n"] == self.warmup:
                x, v = (np.array([b[i] for b in s["base"]], float) for i in (0, 1))
                known = np.isfinite(x)
                mu = np.where(known.any(0), np.where(known, x, 0).sum(0) / np.maximum(known.sum(0), 1), np.nan)
                r = np.where(known, (x - mu) * v, 0.0)
                dof = max(int(known.sum()) - int(np.isfinite(mu).sum()), 1)
                s |= {"base": [], "mu": mu.tolist(), "sigma": max(math.sqrt(float((r * r).sum()) / dof), 1e-9)}
            return None
        z = (m - np.array(s["mu"], float)) * w / s["sigma"]
        return np.where(np.isfinite(z), z, 0.0)

    def step(self, means, share=None) -> list[float]:
        z = self.z(means, share)
        return [0.0] * len(means) if z is None else self.score(z).tolist()

    def held(self, name: str, n: int) -> np.ndarray:
        return np.array(self.s.setdefault(name, [0.0] * n), float)

    def score(self, z: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class OnlineEwma(Warm):
    def __init__(self, warmup: int = 16, lam: float = 0.2):
        super().__init__(warmup)
        self.lam = lam

    def score(self, z):
        e = self.lam * z + (1 - self.lam) * self.held("e", len(z))
        self.s["e"] = e.tolist()
        return np.abs(e) / math.sqrt(self.lam / (2 - self.lam))


class OnlineCusum(Warm):
    def __init__(self, warmup: int = 16, k: float = 0.5):
        super().__init__(warmup)
        self.k = k

    def score(self, z):
        up, down = (np.maximum(0.0, self.held(name, len(z)) + sign * z - self.k) for name, sign in (("up", 1), ("down", -1)))
        self.s |= {"up": up.tolist(), "down": down.tolist()}
        return np.maximum(up, down)


class OnlineChangepoint(Warm):
    """Cumulative sums whose level moves, and which start anew, where a Bayes factor over the last ``m`` residuals tells of a change."""

    def __init__(self, warmup: int = 16, k: float = 0.5, m: int = 3, hazard: float = 1 / 200, least: float = 0.8, tau2: float = 4.0):
        super().__init__(warmup)
        self.k, self.m, self.least, self.tau2, self.prior = k, m, least, tau2, math.log(hazard / (1 - hazard))

    def score(self, z):
        out = np.zeros(len(z))
        blocks = self.s.setdefault("blocks", [[0.0, 0.0, 0.0, []] for _ in z])
        for i, (offset, up, down, past) in enumerate(blocks):
            r = float(z[i]) - offset
            up, down, past = max(0.0, up + r - self.k), max(0.0, down - r - self.k), [*past, r][-self.m :]
            chance = 0.0
            if len(past) == self.m:
                wide = 1 + self.m * self.tau2
                odds = 0.5 * (self.tau2 / wide * sum(past) ** 2 - math.log(wide)) + self.prior
                chance = 1 / (1 + math.exp(-min(700.0, max(-700.0, odds))))
            out[i] = max(up, down, chance / self.least)
            blocks[i] = [offset + sum(past) / self.m, 0.0, 0.0, []] if chance >= self.least else [offset, up, down, past]
        return out


class OnlineThreshold:
    """A threshold that learns from what it does not flag, after ``calibration`` scores; a row with ``reset`` forgets all and calibrates anew."""

    def __init__(self, calibration: int = 20, **given):
        self.calibration, self.given, self.s = calibration, given, {"waiting": [], "accepted": [], "value": None}

    def step(self, score: float, reset: bool = False) -> tuple[float | None, bool]:
        s = self.s
        if reset:
            s |= {"waiting": [], "accepted": [], "value": None}
        if s["value"] is None:
            s["waiting"].append(float(score))
            if len(s["waiting"]) == self.calibration:
                t = Threshold(**self.given).calibrated(s["waiting"])
                s |= {"waiting": [], "accepted": list(t.accepted), "value": t.value}
            return None, False
        t = Threshold(**self.given)
        t.accepted.extend(s["accepted"])
        t.sorted, t.value = sorted(s["accepted"]), s["value"]
        flagged, used = t.update(float(score))
        s |= {"accepted": list(t.accepted), "value": t.value}
        return used, flagged


class OnlineAlerts:
    """Alerts as soon as they are sure: runs over ratio * threshold that hold a score over the threshold, gaps of up to ``gap`` joined, ``least`` samples long, ``rest`` apart.

    An alert is sure once more than ``gap`` quiet steps follow; the last one only then, or by ``close``.
    """

    def __init__(self, threshold: float, ratio: float = 1.0, gap: int = 0, least: int = 1, rest: int = 0):
        self.t, self.low, self.gap, self.least, self.rest = threshold, ratio * threshold, gap, least, rest
        self.s = {"run": None, "open": None, "kept": None}

    def step(self, at: int, score: float) -> tuple[int, int] | None:
        s = self.s
        if score > self.low:
            s["run"] = [at, at, score > self.t] if s["run"] is None else [s["run"][0], at, s["run"][2] or score > self.t]
            return None
        self._end()
        return self._sure() if s["open"] and at - s["open"][1] > self.gap else None

    def _end(self) -> None:
        run, s = self.s["run"], self.s
        s["run"] = None
        if run and run[2]:
            s["open"] = [s["open"][0], run[1]] if s["open"] and run[0] - s["open"][1] - 1 <= self.gap else [run[0], run[1]]

    def _sure(self) -> tuple[int, int] | None:
        s = self.s
        (a, b), s["open"] = s["open"], None
        if b - a + 1 < self.least or self.rest and s["kept"] is not None and a - s["kept"] <= self.rest:
            return None
        s["kept"] = b
        return a, b

    def close(self) -> tuple[int, int] | None:
        self._end()
        return self._sure() if self.s["open"] else None


class Machine(StatefulProcessor):
    """One machine per key; its state is a text of plain data beside the last step."""

    def __init__(self, make, order: str, outputs):
        self.make, self.order, self.outputs = make, order, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "last long, data string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, last = self.make(), None
        if self.state.exists():
            last, data = self.state.get()
            machine.s = json.loads(data)
        every = [r for r in rows if len(r)]
        if not every:
            return
        batch = pd.concat(every).sort_values(self.order, kind="stable")
        fresh = batch if last is None else batch[batch[self.order] > last]
        fresh = fresh.drop_duplicates(self.order)
        if len(fresh):
            out = self.outputs(machine, key, fresh)
            self.state.update((int(fresh[self.order].iloc[-1]), json.dumps(machine.s)))
            yield out

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, key: str, order: str, make, outputs, schema: str) -> DataFrame:
    """``outputs(machine, key, rows)`` for each key's rows in order, the machine's state kept between micro-batches."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # keyed state of this kind needs it
    spark.streams.active  # noqa: B018  the manager of streams brings up the coordinator of states, which tables need too
    return rows.groupBy(key).transformWithStateInPandas(Machine(make, order, outputs), schema, "Append", "None")


def scores(rows: DataFrame, key: str, make, block: str = "block", means: str = "means", share: str | None = None) -> DataFrame:
    """Rows (key, step, block, score) from steps (key, step, means[, share]) by one of the recursions."""
    kind = rows.schema[key].dataType.simpleString()

    def out(machine, k, batch: pd.DataFrame) -> pd.DataFrame:
        got = [machine.step(m, None if share is None else s) for m, s in zip(batch[means], batch[share] if share else batch[means])]
        n = [len(g) for g in got]
        return pd.DataFrame({key: k[0], "step": np.repeat(batch["step"].to_numpy(), n), block: np.concatenate([np.arange(x) for x in n]), "score": np.concatenate(got)})

    return streamed(rows, key, "step", make, out, f"{key} {kind}, step long, {block} long, score double")


def thresholds(rows: DataFrame, key: str, calibration: int = 20, **given) -> DataFrame:
    """Rows (key, step, threshold, flagged) of scores (key, step, score[, reset]); the threshold is null while calibrating."""
    kind = rows.schema[key].dataType.simpleString()

    def out(machine, k, batch: pd.DataFrame) -> pd.DataFrame:
        resets = batch["reset"].tolist() if "reset" in batch else [False] * len(batch)
        got = [machine.step(s, bool(r)) for s, r in zip(batch["score"], resets)]
        return pd.DataFrame({key: k[0], "step": batch["step"].to_numpy(), "threshold": pd.array([g[0] for g in got], float), "flagged": [g[1] for g in got]})

    return streamed(rows, key, "step", lambda: OnlineThreshold(calibration, **given), out, f"{key} {kind}, step long, threshold double, flagged boolean")


def alerts(rows: DataFrame, key: str, **settings) -> DataFrame:
    """Rows (key, start, end) of scores (key, step, score), each as soon as it is sure."""
    kind = rows.schema[key].dataType.simpleString()

    def out(machine, k, batch: pd.DataFrame) -> pd.DataFrame:
        got = [a for a in map(machine.step, batch["step"].tolist(), batch["score"].tolist()) if a]
        return pd.DataFrame({key: [k[0]] * len(got), "start": [a for a, _ in got], "end": [b for _, b in got]})

    return streamed(rows, key, "step", lambda: OnlineAlerts(**settings), out, f"{key} {kind}, start long, end long")
