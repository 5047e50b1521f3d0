import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import queries, toxicity


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.toxicity(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    yes, no = [r["score"] for r in out if r["toxic"]], [r["score"] for r in out if not r["toxic"]]
    assert sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no) > 0.9
    assert sum(r["predicted"] != r["toxic"] for r in out) / len(out) < 0.1


@pytest.fixture()
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")


def test_edges(documents, labels):
    rows = [(i, ("good fine words here " + ("idiot fool " if i % 3 == 0 else "")) * 3) for i in range(90)] + [(200, None), (201, ""), (202, "idiot " * 20000), (None, "fool idiot"), (5, "good")]
    out = toxicity.toxicity(documents(rows), labels([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (91, None), (3, 1)])).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[202]["predicted"] == 1 and by[1]["predicted"] == 0 and by[None]["held_out"] is None
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(90))
    none = toxicity.toxicity(documents(rows[:3]), labels([]))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert toxicity.toxicity(documents([]), labels([(1, 1)])).count() == 0


def test_labels_never_reach_scores(documents, labels):
    rows = [(i, "a b c " + "vile " * (i % 2)) for i in range(40)]
    one = labels([(i, i % 2) for i in range(40)])
    flipped = one.withColumn("toxic", F.when(toxicity.fold_of(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(documents(rows), one).collect()) == sorted(toxicity.toxicity(documents(rows), flipped).collect())


def twin(rows):
    """The same models from dictionaries: a function from a text to its features."""
    toks = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    def spelled(w):
        signs = [toxicity.BEGIN] * (toxicity.ORDER - 1) + [*w, toxicity.END]
        return [tuple(signs[i : i + toxicity.ORDER]) for i in range(len(w) + 1)]

    counts = [Counter(g for t, y in rows if y == c for w in toks(t) for g in spelled(w)) for c in (0, 1)]
    both = counts[0] + counts[1]
    short = Counter(g[-toxicity.SHORT :] for g in both)

    def conditional(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.1 * i), 0.9 * i) for i in (1, 2, 3))]
        total, cut = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            cut[g[:-1]] += d[min(x, 3)]
        return lambda g: ((c[g] - d[min(c[g], 3)]) / total[g[:-1]], cut[g[:-1]] / total[g[:-1]]) if total[g[:-1]] else (0, 1)

    own, shared, base = [conditional(c) for c in counts], conditional(both), conditional(short)

    def ratio(g):
        p, left = base(g[-toxicity.SHORT :])
        q, more = shared(g)
        q += more * (p + left / 257)
        a, b = ([f(g)[0] + f(g)[1] * q for f in own])
        return math.log(b / a)

    def features(t):
        r = [sum(map(ratio, spelled(w))) for w in toks(t)]
        return [sum(r) / len(r), *(max(sum(r[i : i + k]) / k for i in range(len(r))) for k in toxicity.PASSAGES)] if r else [0] * (1 + len(toxicity.PASSAGES))

    return features


def test_models_equal_dictionaries(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["Vile", "vilest", "scum", "you"] if i % 3 == 0 else ["good", "morning", "you", "thé", "goods"]) for _ in range(rnd.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    models = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    features = twin([(t, int(i % 3 == 0)) for i, t in rows])
    for t in [r[1] for r in rows[:20]] + ["", "unseen vile WORDS", "x" * 300, "a b c d e f g h " * 9]:
        u8 = np.frombuffer(t.encode(), np.uint8)
        off = np.array([0, len(u8)])
        x = models.features(u8, off)
        assert x[0].tolist() == pytest.approx(features(t))
        z = models.curve[0] + sum(w * (v - m) / s for w, v, m, s in zip(models.curve[1:], features(t), *models.scale))
        assert models.score(u8, off)[0] == pytest.approx(1 / (1 + math.exp(-z)))
