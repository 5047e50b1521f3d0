import random
import re
from collections import defaultdict

import pytest

from tidegauge.llm import components, jaccard, store
from tidegauge.llm.jaccard import jaccard_join


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    lists, up = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        n = defaultdict(int)
        for x in s:
            for j in lists[x]:
                n[j] += j < i
        for j, c in n.items():
            if c and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_documents(table, k, percent):
    docs = table("documents")
    assert got(jaccard_join(docs, k, percent)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_copies(documents, k, percent):
    rnd, rows = random.Random(5), []
    for n in (1, 2, 4, 9, 12, 13, 20, 25, 30, 60, 200):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(40)) for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(1 + n // 40 + 1)):
                w[rnd.randrange(len(w))] = str(rnd.random())
            if rnd.random() < 0.3:
                w.insert(rnd.randrange(len(w) + 1), "Extra")
            rows.append((len(rows), " ".join(w)))
    assert got(jaccard_join(documents(rows), k, percent)) == brute(rows, k, percent)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (9, "x " * 30000), (8, "x " * 20000), (7, "é É")]
    out = got(jaccard_join(documents(rows), 3, 90))
    assert out == brute(rows, 3, 90) and out[5] == (1, 4) and out[9] == (1, 8) and out[2] == (0, 2)
    again = jaccard_join(documents([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")]), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in again) == [(0, None), (1, 1), (1, 1)]
    assert jaccard_join(documents([]), 3, 90).count() == 0


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_words_alike_by_construction_stay_apart(documents, n):
    w, other = thue_morse(n)
    rows = [(1, f"{w} x y"), (2, f"{other} x y"), (3, f"{w} {other} z"), (4, f"{other} {w} z")]
    assert got(jaccard_join(documents(rows), 3, 90)) == brute(rows, 3, 90)


def test_lost_scratch_files_are_an_error(spark, documents, monkeypatch):
    true = jaccard.entries

    def lost(reps, folder, *more):
        store.drop(folder, "sets-")
        return true(reps, folder, *more)

    monkeypatch.setattr(jaccard, "entries", lost)
    with pytest.raises(Exception, match="No such file"):
        jaccard_join(documents([(i, "a b c d e f g h %d" % (i % 3)) for i in range(9)]), 3, 90).collect()


def test_a_long_chain_is_one_component(spark):
    n = 3000
    links = spark.range(n).selectExpr("(id * 7919) % 3000 as a", "(id * 7919 + 1) % 3000 as b").where("b > a")
    got = components.components(links, store.shared_dir(spark, "chain")).collect()
    assert len(got) == n and {r["component_id"] for r in got} == {0}
