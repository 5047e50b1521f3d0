import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegauge.llm import kneser_ney, queries, store


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def discounts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
    return [0, *(min(max(x, 0.1 * i), 0.9 * i) for i, x in enumerate(d, 1))]


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.levels = order, {}
        words = [w for t in texts for w in t]
        self.c, self.n = Counter(words), len(words)
        level = Counter()
        for t in texts:
            t = ["<s>"] * (order - 1) + t
            level.update(tuple(t[i : i + order]) for i in range(len(t) - order + 1))
        for k in range(order, 0, -1):
            ctx = defaultdict(list)
            for g, c in level.items():
                ctx[g[:-1]].append(c)
            self.levels[k] = level, ctx, discounts(level.values())
            level = Counter(g[1:] for g in level)

    def p(self, hist, w):
        p = 1 / (len(self.c) + 1)
        for k in range(1, self.order + 1):
            level, ctx, d = self.levels[k]
            h = tuple(hist[len(hist) - k + 1 :])
            if h in ctx:
                c, total = level[(*h, w)], sum(ctx[h])
                p = (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in ctx[h]) / total * p
        return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_documents(table, order):
    docs = table("documents").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    m = Plain([toks(t) for i, t in rows if not held[i]], order)
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, order, 7, 2).collect()}
    for i, t in rows:
        t, g = toks(t), got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(t), sum(w in m.c for w in t), m.n)
        assert g["base_score"] == pytest.approx(sum(math.log10((m.c[w] + 1) / (m.n + len(m.c) + 1)) for w in t))
        full = ["<s>"] * (order - 1) + t
        assert g["score"] == pytest.approx(sum(math.log10(m.p(full[j : j + order - 1], full[j + order - 1])) for j in range(len(t))))


def test_sums_to_one():
    texts = [toks(t) for t in ("a b a b c", "a b d", "c c c a", "d a b")]
    m = Plain(texts, 2)
    for h in "abcdx":
        assert sum(m.p([h], w) for w in [*m.c, "unknown"]) == pytest.approx(1)


def test_edges(documents):
    out = {r["doc_id"]: r for r in kneser_ney.score(documents([(1, None), (2, "A b a"), (2, "A b a"), (None, "q q"), (4, "x " * 9000)]), 2, 7, 2).collect()}
    assert out[1]["n_tokens"] == 1 and out[None]["n_known"] == 1 and out[None]["held_out"] is None
    assert kneser_ney.score(documents([]), 2, 7, 2).count() == 0
    assert kneser_ney.score(documents([(None, "a b")]), 2, 7, 2).first()["score"] == 0


def test_query_uses_two_words_of_context(spark, tmp_path):
    texts = [(i, "a b c" if i % 2 else "d b e") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    m = Plain([toks(t) for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    t = toks("a b c")
    full = ["<s>", "<s>"] + t
    want = sum(math.log10(m.p(full[j : j + 2], full[j + 2])) for j in range(len(t)))
    got = {r["doc_id"]: r["score"] for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[1] == pytest.approx(want)


def test_words_alike_by_construction_are_counted_apart(spark, documents):
    w = "a"
    while len(w) < 1024:
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(i, w if i % 2 else w.translate(str.maketrans("ab", "ba"))) for i in range(8)]
    m = Plain([toks(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    out = kneser_ney.score(documents(rows), 3, 7, 2).collect()
    assert len(m.c) == 3 and out[0]["base_score"] == pytest.approx(sum(math.log10((m.c[x] + 1) / (m.n + len(m.c) + 1)) for x in toks(dict(rows)[out[0]["doc_id"]])))


def test_words_of_one_hash_are_told_apart_by_the_other(spark, tmp_path):
    model = kneser_ney.Model(f"file://{tmp_path}", 2, 1)
    key, check = np.array([5, 9, 9, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    model.words.write(0, key, check=check, c=np.array([7, 1, 2, 3]), id=np.array([1, 2, 3, 4]))
    model.words.sealed({0: 4})
    ids, counts = model.ids(np.array([5, 9, 9], np.uint64), np.array([1, 4, 6], np.uint64))
    assert ids.tolist() == [1, 4, kneser_ney.UNKNOWN] and counts.tolist() == [7, 3, 0]


@pytest.mark.parametrize("lost", ["words-", "pair-", "label3-", "contexts3"])
def test_lost_tables_are_an_error(spark, documents, lost):
    docs = documents([(i, "a b c a b d " * 3) for i in range(20)])
    model = kneser_ney.train(docs, 3)
    u8 = np.frombuffer(b"a b c", np.uint8)
    assert model.probabilities(u8, np.array([0, 5]))[1].tolist() == [120, 120, 60, 20]
    store.drop(model.folder, lost)
    for x in (model.words, model.single, *model.contexts.values()):
        x._open.clear()
    model._open.clear()
    with pytest.raises(FileNotFoundError):
        model.probabilities(u8, np.array([0, 5]))


@pytest.mark.parametrize("order", [1, 4])
def test_other_orders_and_large_counts(documents, order):
    rows = [(i, "a b a c " * (200 if i == 1 else i % 3)) for i in range(12)]
    m = Plain([toks(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], order)
    for r in kneser_ney.score(documents(rows), order, 7, 2).collect():
        t = toks(dict(rows)[r["doc_id"]])
        full = ["<s>"] * (order - 1) + t
        assert r["score"] == pytest.approx(sum(math.log10(m.p(full[j : j + order - 1], full[j + order - 1])) for j in range(len(t))))


def test_tables_of_many_shards_need_no_open_files(spark, documents):
    import os
    import resource

    docs = documents([(i, "a b c a b d " * 3) for i in range(20)])
    model = kneser_ney.train(docs, 3)
    u8, soft = np.frombuffer(b"a b c", np.uint8), resource.getrlimit(resource.RLIMIT_NOFILE)
    for i in range(60):  # 60 shards of contexts
        model.contexts[3, 0].write(i + 100, np.arange(3, dtype=np.uint64), **dict.fromkeys(("t", "n1", "n2", "n3"), np.ones(3)))
    model.contexts[3, 0].sealed(model.contexts[3, 0].sizes | {i + 100: 3 for i in range(60)})
    at_most = max(map(int, os.listdir("/proc/self/fd"))) + 64
    resource.setrlimit(resource.RLIMIT_NOFILE, (at_most, soft[1]))
    try:
        assert all(len(model.contexts[3, 0].shard(i + 100)["key"]) == 3 for i in range(60))
        assert model.probabilities(u8, np.array([0, 5]))[1].tolist() == [120, 120, 60, 20]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, soft)


def test_maps_are_bounded(spark, documents, monkeypatch):
    docs = documents([(i, "a b c a b d " * 3) for i in range(20)])
    model = kneser_ney.train(docs, 3)
    u8 = np.frombuffer(b"a b c d b a", np.uint8)
    whole = model.probabilities(u8, np.array([0, 11]))[2].tolist()
    monkeypatch.setattr(store, "MAPS", 5)
    for x in (model, model.words, model.single, *model.contexts.values()):
        x._open.clear()
    assert model.probabilities(u8, np.array([0, 11]))[2].tolist() == whole
    assert sum(len(x) for t in (model, model.words, model.single, *model.contexts.values()) for x in t._open.values()) <= 6


def test_repeated_words_and_ngrams_are_hashed_and_sought_once(spark, documents, monkeypatch):
    docs = documents([(i, "a b c a b d " * 3) for i in range(20)])
    model = kneser_ney.train(docs, 3)
    sizes = {"hashed": 0, "sought": 0}

    def counted(name, f, of):
        def run(*args, **kw):
            sizes[name] += len(of(args))
            return f(*args, **kw)

        return run

    monkeypatch.setattr(kneser_ney.flat, "hashes", counted("hashed", kneser_ney.flat.hashes, lambda x: x[1]))
    monkeypatch.setattr(kneser_ney, "within", counted("sought", kneser_ney.within, lambda x: x[3]))
    text = b"a b c a b d " * 500
    begin, count, p = model.probabilities(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert begin.tolist() == [0, 3001] and count[:3].tolist() == [120, 120, 60] and len(p) == 3001
    assert sizes["hashed"] <= 2 * 4 and sizes["sought"] <= 12


def test_slices_of_ngrams_are_counted_together():
    texts = [[b"a b a b", b"", b"c"], [b"b a b c c c"], [b"x"]]
    names, of, begin, want = [], [], [], Counter()
    ids = {b"a": 7, b"b": 3, b"c": 70000, b"x": 1, None: 2}
    for part in texts:
        words = [[*t.split(), None] for t in part]
        for t in words:
            full = [kneser_ney.BEGIN] * 2 + [ids[w] for w in t]
            want.update(tuple(full[i : i + 3][::-1]) for i in range(len(t)))
        own = sorted({w for t in words for w in t}, key=str)
        names.append(np.array([ids[w] for w in own], np.uint32))
        of.append(np.array([own.index(w) for t in words for w in t], np.uint32))
        begin.append(np.cumsum([0, *map(len, words)]))
    rows, n = kneser_ney.distinct(names, of, begin, 3)
    assert list(zip(*(c.tolist() for c in rows), strict=True)) == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]
