import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm import suffix


def brute(rows, length):
    first, out = {}, {}
    text = {i: (t or "").encode() for i, t in rows}
    for i in sorted(text):
        for p in range(len(text[i]) - length + 1):
            first.setdefault(text[i][p : p + length], i)
    for i, b in text.items():
        drop = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                drop[p : p + length] = True
        runs = int((np.diff(np.r_[0, drop.astype(int)]) == 1).sum())
        out[i] = (len(b), int(drop.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~drop].tobytes()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def made(seed):
    rnd, rows = random.Random(seed), []
    passages = ["".join(rnd.choice("abé \n") for _ in range(rnd.choice((30, 49, 50, 51, 70, 200)))) for _ in range(8)]
    for i in range(60):
        t = ""
        for _ in range(rnd.randrange(6)):
            t += rnd.choice(passages)[rnd.randrange(4) :] + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(80)))
        rows.append((i * 3 % 61, t))
    return rows + [(100, "z" * 400), (101, "z" * 500), (102, None), (103, ""), (104, "ab" * 30000), (105, "ba" * 200), (106, rows[4][1]), (107, rows[4][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_made(documents, seed):
    rows = made(seed)
    assert got(suffix.dedup_digests(documents(rows), 50)) == brute(rows, 50)


def test_small_shards(monkeypatch):
    rnd = np.random.default_rng(3)
    parts = [rnd.integers(97, 99, rnd.integers(12, 40)).astype(np.uint8) for _ in range(200)]
    off, doc = np.r_[0, np.cumsum([len(p) for p in parts])], rnd.integers(0, 50, 200)
    want, low = [], {}
    for p, d in zip(parts, doc):
        for i in range(len(p) - 11):
            w = p[i : i + 12].tobytes()
            want.append(w)
            low[w] = min(low.get(w, 99), d)
    for size in (1 << 20, 300, 1):
        monkeypatch.setattr(suffix, "SHARD", size)
        assert suffix.smallest(np.concatenate(parts), off, doc, 12).tolist() == [low[w] for w in want]


def test_documents(table):
    docs = table("documents")
    assert got(suffix.dedup_digests(docs, 50)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


def test_edges(documents):
    assert suffix.dedup_digests(documents([]), 50).count() == 0
    twice = documents([(7, "q" * 60), (7, "q" * 60), (None, "q" * 60), (8, "q" * 60)])
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.dedup_digests(twice).collect()) == [(0, 0), (7, 0), (7, 0), (8, 60)]
    cut = suffix.dedup_text(documents([(1, "x" * 55 + "é"), (2, "x" * 55 + "é!"), (3, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in cut] == ["x" * 55 + "é", "!", None] and "key" in cut[0].asDict()


def test_anchors_in_blocks_cover_every_window(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = [bytes(rnd.integers(97, 100, n, dtype=np.uint8)) for n in (0, 700, 49, 50, 51, 300, 0, 1000)]
    u8, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]

    def hashes():
        out = {}
        for h, t, s, w in zip(*suffix.anchors(u8, off, 50)):
            for i in range(w):
                out[int(t), int(s) + i] = int(h)
        return out

    whole = hashes()
    monkeypatch.setattr(suffix, "WINDOWS", 97)
    assert hashes() == whole and len(whole) == sum(max(0, len(t) - 49) for t in texts)


def test_parts_meet_by_bytes_where_hashes_are_equal(monkeypatch):
    rnd = np.random.default_rng(5)
    parts = [rnd.integers(97, 99, 30).astype(np.uint8) for _ in range(60)]
    off, doc = np.r_[0, np.cumsum([len(p) for p in parts])], rnd.integers(0, 50, 60)
    whole = suffix.smallest(np.concatenate(parts), off, doc, 12).tolist()
    monkeypatch.setattr(suffix, "SHARD", 100)
    for constant in (0, 1 << 63):
        monkeypatch.setattr(suffix.flat, "rolling", lambda u8, k: np.full(len(u8) - k + 1, constant, np.uint64))
        assert suffix.smallest(np.concatenate(parts), off, doc, 12).tolist() == whole


def test_rows_between_tasks_do_not_grow_with_slices(spark, tmp_path):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    rows = [(i, " ".join(rnd.sample(pool, 20))) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs, old = spark.read.parquet(str(tmp_path / "d")), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        stages = [s for j in range(seen.jobsList(None).size()) for s in [seen.jobsList(None).apply(j).stageIds()]]
        ids = {s.apply(i) for s in stages for i in range(s.size())}
        return {i: seen.lastStageAttempt(i).shuffleWriteRecords() for i in ids}

    before = sent()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # each row is a slice
    try:
        assert got(suffix.dedup_digests(docs, 50)) == brute(rows, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sum(n for i, n in sent().items() if i not in before) < 100
