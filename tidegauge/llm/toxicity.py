"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Two interpolated models, of toxic and of ordinary texts, give each byte of a word its probability
after the bytes before it. Both discount their own counts and back off to the same counts of both
classes together, and these to shorter contexts, so that an expression that is rare, or new
but for its stem, is smoothed by what both classes know of it. A word's evidence is its toxic log-likelihood
less the ordinary one; a text's is normalised by length: the mean over its words, and the highest
means of passages of a few words. A logistic curve turns it into a score from 0 to 1; it is fitted on
the labelled rows' evidence by models that counted only the other folds.

The models learn from ``MOST`` labelled rows at most (expected; a hash of doc_id picks them), so they and
the one task that adds the counts up are of bounded size; every row is scored, whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .flat import U
from .kneser_ney import blob, summed, unblob

#: Labelled rows to learn from, at most; folds for fitting the curve.
MOST, FOLDS = 24_000, 3
#: Words of a passage.
PASSAGES = (1, 4, 24)
_FEATURES = 1 + len(PASSAGES)
#: Bytes of an n-gram with its own counts by class, and of one of the shared backoff; END and BEGIN stand round a word.
ORDER, SHORT = 6, 3
END, BEGIN, _BITS = 256, 257, 9
#: Columns of a block of counts: n-gram, then each fold's two classes.
KINDS = ["u8", *["u4"] * (2 * FOLDS)]


def discount(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts 0, 1, 2 and more."""
    n1, n2, n3, n4 = (int((c == i).sum()) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [(i - (i + 1) * y * b / a if a else i / 2) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.1 * i), 0.9 * i) for i, x in enumerate(d, 1))])


def spelled(u8: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number among the slice's distinct words, where each text's words begin, and of the distinct words' bytes, A-Z as a-z, with END: the n-gram that ends at each, where each word's begin."""
    start, end = flat.spans(u8, off)
    at = np.searchsorted(start, off)
    one, word = flat.equals(u8, start, end, lower=True)
    size = end[one] - start[one] + 1
    begin = np.r_[0, np.cumsum(size)]
    place = flat.ragged(np.zeros(len(one), np.int64), size)
    sign = u8[np.minimum(flat.ragged(start[one], size), max(0, len(u8) - 1))].astype(np.uint64) if len(u8) else np.zeros(0, np.uint64)
    sign[(sign > 64) & (sign < 91)] += U(32)
    sign[begin[1:] - 1] = END
    key = sign.copy()
    for lag in range(1, ORDER):
        prev = np.full(len(sign), U(BEGIN))
        prev[lag:] = np.where(place[lag:] >= lag, sign[: max(0, len(sign) - lag)], U(BEGIN))
        key |= prev << U(_BITS * lag)
    return word, at, key, begin


def conditional(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams, sorted: the discounted part of each probability; contexts, and the part each leaves to the backoff."""
    d = discount(counts)
    ctx, to = np.unique(keys >> U(_BITS), return_inverse=True)
    total = np.bincount(to, weights=counts, minlength=len(ctx))
    cut = d[np.minimum(counts, 3)]
    free = np.where(total > 0, np.bincount(to, weights=cut, minlength=len(ctx)) / np.maximum(total, 1), 1.0)
    return (counts - cut) / np.maximum(total, 1)[to], ctx, free


class Models:
    """Probabilities of both models, as sorted arrays in the shared folder."""

    def __init__(self, folder: str, name: str):
        parts = {"0": "f8", "1": "f8", "s": "f8"}
        self.long, self.left = store.Lookup(folder, f"long{name}", 1, parts), store.Lookup(folder, f"left{name}", 1, parts)
        self.short, self.tail = store.Lookup(folder, f"short{name}", 1, {"s": "f8"}), store.Lookup(folder, f"tail{name}", 1, {"s": "f8"})
        self.curve = np.zeros(_FEATURES + 1)
        self.scale = np.stack([np.zeros(_FEATURES), np.ones(_FEATURES)])

    def tables(self) -> list[store.Lookup]:
        return [self.long, self.left, self.short, self.tail]

    def write(self, keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> list[int]:
        """From distinct n-grams, sorted, and their counts in both classes; returns the sizes of the tables."""
        some = ordinary + toxic > 0
        keys, ordinary, toxic = keys[some], ordinary[some], toxic[some]
        got = {"0": conditional(keys, ordinary), "1": conditional(keys, toxic), "s": conditional(keys, ordinary + toxic)}
        self.long.write(0, keys, **{k: v[0] for k, v in got.items()})
        self.left.write(0, got["s"][1], **{k: v[2] for k, v in got.items()})
        short, contexts = np.unique(keys & U((1 << _BITS * SHORT) - 1), return_counts=True)  # in how many longer ones each occurs
        p, ctx, free = conditional(short, contexts)
        self.short.write(0, short, s=p)
        self.tail.write(0, ctx, s=free)
        return [len(keys), len(got["s"][1]), len(short), len(ctx)]

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """The log of toxic over ordinary probability of each n-gram's last sign."""

        def of(table, keys, missing):
            uniq, back = np.unique(keys, return_inverse=True)
            hit, v = table.find(uniq)
            return {k: np.where(hit, x, missing)[back] for k, x in v.items()}

        low = key & U((1 << _BITS * SHORT) - 1)
        base = of(self.short, low, 0.0)["s"] + of(self.tail, low >> U(_BITS), 1.0)["s"] / 257
        p, left = of(self.long, key, 0.0), of(self.left, key >> U(_BITS), 1.0)
        shared = p["s"] + left["s"] * base
        return np.log((p["1"] + left["1"] * shared) / (p["0"] + left["0"] * shared))

    def features(self, u8: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text the mean evidence of its words, and the highest mean of a passage of each length; without words 0."""
        word, at, key, begin = spelled(u8, off)
        out = np.zeros((len(off) - 1, _FEATURES))
        if not len(word):
            return out
        ratio = np.add.reduceat(self.ratios(key), begin[:-1])[word]
        n = np.diff(at)
        full = np.flatnonzero(n)
        head = at[:-1][full]
        out[full, 0] = np.add.reduceat(ratio, head) / n[full]
        sums, end, i = np.r_[0, np.cumsum(ratio)], np.repeat(at[1:], n), np.arange(len(ratio))
        for c, k in enumerate(PASSAGES, 1):
            out[full, c] = np.maximum.reduceat((sums[np.minimum(i + k, end)] - sums[i]) / k, head)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """The logistic curve, by Newton's steps with a slight pull to 0."""
        order = np.lexsort((y, *x.T))  # whatever order the rows came in
        x, y = x[order], y[order]
        if len(x):
            self.scale = np.stack([x.mean(0), np.maximum(x.std(0), 1e-9)])
        z, w = self.shaped(x), np.zeros(_FEATURES + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            pull = np.r_[1e-9, np.full(_FEATURES, 1e-2)]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6), z.T @ (y - p) - pull * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = np.clip(w, -50, 50)

    def shaped(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.scale[0]) / self.scale[1]]

    def score(self, u8: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shaped(self.features(u8, off)) @ self.curve, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Models:
    """Models from the texts whose doc_id ``labels`` (doc_id, toxic) names; rows with a null in either are no labels."""
    spark = docs.sparkSession
    folder = store.shared_dir(spark, "toxicity")
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = min(1.0, most / max(1, named.count()))
    named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    chosen = store.saved(docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").select("text", "toxic", "fold"), folder, "chosen")  # at most ``most`` labels, up to chance
    models, without = Models(folder, ""), [Models(folder, str(f)) for f in range(FOLDS)]

    def count(batches):
        for rows, u8, off in flat.slices(batches):
            word, at, key, begin = spelled(u8, off)
            kind = np.repeat(rows.column("fold").to_numpy() * 2 + (rows.column("toxic").to_numpy() > 0), np.diff(at))
            which = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            (keys,), sums = summed([key], [np.bincount(word[kind == k], minlength=len(begin) - 1)[which] for k in range(2 * FOLDS)])
            yield pa.RecordBatch.from_arrays([pa.array([blob([keys, *sums], KINDS)], pa.binary())], ["data"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sums = np.zeros(0, np.uint64), [np.zeros(0, np.int32)] * 2 * FOLDS
        for a in range(0, len(pdf), 4):
            parts = [unblob(x, KINDS) for x in pdf["data"].iloc[a : a + 4]]
            (keys,), sums = summed([np.concatenate([keys, *(p[0] for p in parts)])], [np.concatenate([sums[i], *(p[1 + i].astype(np.int32) for p in parts)]) for i in range(2 * FOLDS)])
        total = [sum(sums[c::2]) for c in (0, 1)]
        sizes = models.write(keys, *total)
        for f, m in enumerate(without):
            sizes += m.write(keys, *(total[c] - sums[2 * f + c] for c in (0, 1)))
        return pd.DataFrame({"sizes": [sizes]})

    stored = chosen.mapInArrow(count, "data binary").groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: merge(pdf), "sizes array<long>").collect()  # one row, or none without labels
    for r in stored:
        for table, n in zip([x for m in (models, *without) for x in m.tables()], r["sizes"]):
            table.sealed({0: n})

    def measure(batches):
        for rows, u8, off in flat.slices(batches):
            fold = rows.column("fold").to_numpy()
            x = np.zeros((len(fold), _FEATURES))
            for f in np.unique(fold):
                x[fold == f] = without[f].features(u8, off)[fold == f]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), rows.column("toxic")], ["x", "toxic"])

    got = chosen.mapInArrow(measure, "x array<double>, toxic int").collect()  # at most ``most`` rows
    models.fit(np.array([r["x"] for r in got]).reshape(-1, _FEATURES), np.array([r["toxic"] > 0 for r in got], float))
    return models


def fold_of(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def scored(docs: DataFrame, models: Models, name: str = "score") -> DataFrame:
    """``docs`` with its text's score in a column of that name (replaced where there is one); null texts count as empty."""
    from pyspark.sql import types as T

    docs = docs.drop(name)

    def run(batches):
        for rows, u8, off in flat.slices(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(models.score(u8, off))], [*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, least: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted); predicted is 1 where score >= ``least``.

    Labels are learned only from rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out``. A null
    text counts as empty; a null doc_id is scored and its held_out is null; repeated rows are scored each;
    without labels all scores are 0.5; other columns are ignored; an empty table gives no rows.
    """
    models = train(docs, labels.where(fold_of(folds) != held_out))
    out = scored(docs.select("doc_id", "text", (fold_of(folds) == held_out).alias("held_out")), models)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
