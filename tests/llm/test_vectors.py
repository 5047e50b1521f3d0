import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import hnsw, ivfpq, queries


@pytest.fixture(scope="module")
def embeddings(spark):
    return queries.table(spark, "/root/testdata/sf0.1", "embeddings")


@pytest.fixture(scope="module")
def odd(spark):
    """Hot copies, near copies, invalid vectors, ties."""
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(100, 300)]
    rows += [(i, [float(j) for j in range(1, 9)]) for i in range(300, 420)]
    rows += [(i, (np.arange(1, 9) + rnd.normal(size=8) * 0.1).tolist()) for i in range(500, 620)]
    rows += [(700, [2.0 * j for j in range(1, 9)]), (701, None), (702, [0.0] * 8), (703, [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), (704, [float("nan")] * 8), (800, [math.inf] + [1.0] * 7), (705, [1.0, 2.0]), (None, [1.0] * 8)]
    return spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<double>, n_links int, shard int").repartition(4)


def arrays(df):
    ok = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    d = max({len(v) for _, v in ok}, key=lambda n: sum(len(v) == n for _, v in ok))
    ok = [(i, v) for i, v in ok if len(v) == d]
    return np.array([i for i, _ in ok]), np.array([v for _, v in ok])


def recall(df):
    ids, x = arrays(df)
    got, want = {}, {}
    for r in ivfpq.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, v in zip(ids, x):
        if i % 100 == 0:
            dist = np.sqrt(((x - v) ** 2).sum(1))
            dist[ids == i] = np.inf
            best = np.lexsort((ids, dist))[:10]
            want[i] = [int(ids[b]) for b in best]
            for rank, j, score in got[i]:
                assert score == pytest.approx(dist[ids == j][0], abs=1e-12)
            assert [r for r, _, _ in sorted(got[i])] == list(range(1, 11))
            assert sorted(got[i]) == sorted(got[i], key=lambda g: (g[2], g[1]))
    assert set(got) == set(want)
    return sum(len(set(w) & {j for _, j, _ in got[i]}) for i, w in want.items()) / sum(map(len, want.values()))


def test_nearest(embeddings, odd):
    assert recall(embeddings) >= 0.9
    assert recall(odd) >= 0.9


def test_nearest_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(ivfpq.nearest(few).collect())] == [(0, 1, 2), (0, 2, 3)]
    assert ivfpq.nearest(few.where("false")).count() == 0


def links(df):
    ids, x = arrays(df)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    comp = ids.copy()
    while True:
        new = np.array([comp[n].min() for n in near])
        if (new == comp).all():
            break
        comp = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1) - 1, comp)}


def test_near_duplicates(embeddings, odd):
    for df in (embeddings, odd):
        want = links(df)
        rows = hnsw.near_duplicates(df).collect()
        assert len(rows) == df.count()
        got = {r["vec_id"]: r for r in rows if r["vec_id"] is not None}
        assert sum(got[i]["n_links"] for i in want) >= 0.995 * sum(n for n, _ in want.values())
        assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
        assert sum(got[i]["component_id"] != c for i, (_, c) in want.items()) <= 0.005 * len(want)
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
        assert all(r["n_links"] == 0 and r["kept"] for i, r in got.items() if i not in want)


def test_near_duplicates_of_nothing(odd):
    assert hnsw.near_duplicates(odd.where("false")).count() == 0
    assert hnsw.near_duplicates(odd.where("vec_id = 702")).collect()[0]["component_id"] == 702


def narrow(monkeypatch, least):
    """Searches by a beam of under ``least`` lose the links of classes that have less than ten."""
    true, final, widths = hnsw.counted, hnsw.found, []

    def counted(reps, shards, near, width):
        widths.append(width)
        out = true(reps, shards, near, width)
        return out if width >= least else out.selectExpr("a", "case when b < 10 then 0L else b end as b")

    def found(reps, shards, near, width):
        widths.append(width)
        return final(reps, shards, near, width)

    monkeypatch.setattr(hnsw, "counted", counted)
    monkeypatch.setattr(hnsw, "found", found)
    return widths


def pairs(rnd, first, n):
    """Rows of ``n`` pairs of near copies, each far from all others."""
    for i in range(n):
        v = rnd.normal(size=32)
        yield first + 2 * i, v.tolist()
        yield first + 2 * i + 1, (v + rnd.normal(size=32) * 0.05).tolist()


def test_audit_is_not_won_by_a_hot_group(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    hot = rnd.normal(size=32)
    rows = [(i, (hot + rnd.normal(size=32) * 0.05).tolist()) for i in range(400)] + list(pairs(rnd, 1000, 100))
    df, widths = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), narrow(monkeypatch, 128)
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(df).collect()}
    assert widths[-1] >= 128 and all(got[i] == n for i, (n, _) in links(df).items())


def test_audit_of_rare_near_copies(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    order = [r["id"] for r in spark.range(2000).orderBy(F.xxhash64("id", F.lit(3)), "id").collect()]  # the audit's: pairs come last
    rows = [(order[i], v) for i, v in [*((i, rnd.normal(size=32).tolist()) for i in range(1996)), *pairs(rnd, 1996, 2)]]
    df, widths = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), narrow(monkeypatch, 128)
    monkeypatch.setattr(hnsw, "AUDITS", 256, raising=False)  # the pairs are not sampled: planted vectors decide
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(df).collect()}
    assert widths[-1] >= 128 and all(got[i] == n for i, (n, _) in links(df).items())


def test_pairs_join_shards_by_few_rows(spark, monkeypatch):
    """A large group sends pairs of shard components, not its members; planted pairs over all shards are found, and counted for both ends."""
    rnd = np.random.default_rng(9)
    hot, sent, final = rnd.normal(size=32), [], hnsw.found
    rows = [(i, (hot + rnd.normal(size=32) * 0.05).tolist()) for i in range(2500)] + list(pairs(rnd, 10_000, 400))

    def found(*args):
        out = hnsw.store.saved(final(*args), args[1].folder, "sent")
        sent.append(out.where("kind = 1").count())
        return out

    monkeypatch.setattr(hnsw, "found", found)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(df).collect()}
    want = links(df)
    few = [i for i, (n, _) in want.items() if i >= 10_000 and n]
    assert len(few) > 300 and sum(got[i] == want[i] for i in few) >= 0.99 * len(few)
    assert sum(got[i][1] == 0 for i in range(2500)) >= 2490 and sent[0] < 3 * len(rows)
    assert all(got[i ^ 1][0] == got[i][0] for i in few)


def test_a_link_found_from_one_side_counts_for_both(spark):
    rows = [(0, 1, 1, 2, 2), (0, 2, 0, 0, 0), (2, 1, 2, 2, 3), (0, 3, 40, 41, 41), (2, 1, 3, 2, 3)]
    got = hnsw.counts(spark.createDataFrame(rows, "kind long, a long, b long, n long, own long")).collect()
    assert {r["rep"]: r["n"] for r in got} == {1: 2, 2: 3, 3: 41}


def test_cosine_is_the_same_from_both_sides():
    x = np.random.default_rng(1).normal(size=(50, 8)) * 10.0 ** np.arange(50)[:, None]
    y = hnsw.even(x)
    assert np.isfinite((y * y).sum(1)).all() and ((y * y).sum(1) > 0).all()
