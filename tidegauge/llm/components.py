"""Connected components of a graph of links, without bringing links or components to the driver."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of the links, and for each the smallest id that these links reach from it."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def forest(batches):
    """Links, replaced by as many as a spanning forest has: each id with the smallest that it reaches here."""
    for pdf in batches:
        ids, root = roots(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        yield pd.DataFrame({"a": ids, "b": root})[ids != root]


def components(links: DataFrame, folder: str) -> DataFrame:
    """Rows (id, component_id) of every id that ``links`` (a, b) names; component_id is the smallest id reachable.

    Large-star and small-star steps in turn, each a grouped minimum (combined on the map side) and a
    join on it, until every component is a star round its smallest id; each round is written to the shared folder. A batch of links is
    first replaced by its spanning forest.
    """
    edges = store.saved(links.where("a is not null and b is not null and a != b").mapInPandas(forest, "a long, b long").distinct(), folder, "cc-0")
    for k in count(1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m", "a").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = store.saved(small.where("a != b").distinct(), folder, f"cc-{k}")
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").head(1):
            break  # every leaf has one centre, and no centre is a leaf
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())
