"""Isolation forests: trees grown on small samples of rows, each row scored by how few cuts set it apart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: Euler's constant, in the mean path of an unsuccessful search.
GAMMA = 0.5772156649015329


def mean_path(n: int) -> float:
    """Mean number of cuts that set a row apart from ``n - 1`` others."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + GAMMA) - 2 * (n - 1) / n


def tree(x: np.ndarray, rng: np.random.Generator, most: int) -> dict[str, np.ndarray]:
    """A tree as arrays: feature (-1 at a leaf), cut, left and right child, path length at a leaf."""
    feature, cut, left, right, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (path, depth + mean_path(len(rows)))):
            a.append(v)
        if parent >= 0:
            (left, right)[side][parent] = node
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if len(rows) < 2 or depth >= most or not len(wide):
            continue
        f = int(rng.choice(wide))
        feature[node], cut[node] = f, float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= cut[node]
        todo += [(rows[~below], depth + 1, node, 1), (rows[below], depth + 1, node, 0)]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "path": np.array(path)}


def depths(t: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    on = np.flatnonzero(t["feature"][at] >= 0)
    while len(on):
        node = at[on]
        at[on] = np.where(x[on, t["feature"][node]] <= t["cut"][node], t["left"][node], t["right"][node])
        on = on[t["feature"][at[on]] >= 0]
    return t["path"][at]


def isolation(trees: list[dict], n: int, x: np.ndarray) -> np.ndarray:
    return 2 ** (-np.mean([depths(t, x) for t in trees], axis=0) / max(mean_path(n), 1e-12))


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> tuple[list[dict], int]:
    n = min(sample, len(x))
    most = math.ceil(math.log2(max(n, 2)))
    rngs = [np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(i,))) for i in range(trees)]
    return [tree(x[np.sort(r.choice(len(x), n, replace=False))], r, most) for r in rngs], n


def grown(rows: DataFrame, features: str, keys: list[str], trees: int, sample: int, seed: int) -> tuple[list[dict], int]:
    """A forest from a sample of ``trees * sample`` rows at most, which a hash of their keys picks: its size does not grow with the rows."""
    some = rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(trees * sample).select(features).collect()
    if not some:
        raise ValueError("a forest needs rows to grow on")
    return grow(np.array([r[0] for r in some], float), trees, sample, seed)


def scored(rows: DataFrame, features: str, model: tuple[list[dict], int]) -> DataFrame:
    """``rows`` with a score from 0 to 1, higher where fewer cuts set a row apart."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(isolation(*model, np.array(x.tolist(), float)) if len(x) else [], dtype=float)

    return rows.withColumn("score", score(features))
