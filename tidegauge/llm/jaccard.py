"""Join of documents on the Jaccard similarity of their word shingles: size-aware, heavy and light.

Small sets are light: each enumerates the subsets of fixed sizes that a partner must share with
it, and equal subsets meet by their hash. Large sets are heavy: each enters the inverted lists of
the shingles of its prefix, rare ones first, and each list is scanned. The size where light ends is
chosen by the cost of both ways over the sizes found. Candidates of both ways are verified on the whole sets.
The list of a frequent shingle is split by size, so that only sets meet which sizes allow to link.

Sets are kept as sorted hash arrays in the shared folder, one file per task's attempt, and mapped into memory for
verification. Sets equal in size and in 128 bits of their elements become one class first, so copies are never paired with
each other; within a list, pairs that are in one component already need no verification.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .components import components

#: A list of at most so many sets is verified pair by pair; a longer one set by set against all others.
SHORT = 8
#: What one entry in an inverted list costs against one enumerated subset.
SCAN = 4
#: A shingle in more than this part of a batch of sets counts as frequent, and comes last in the order.
FREQUENT = 0.002
#: Ranges of hashes in which a set's elements are counted: two sets share at most the sum of the smaller counts.
RANGES = 128
#: Bytes of the documents' files for which there is a part of the lists.
BYTES = 10 << 20
#: Elements of sets that are compared at once.
BLOCK = 1 << 20


def least_shared(n: int, percent: int) -> int:
    """How many elements a set of ``n`` shares at least with any partner."""
    return -(-percent * n // 100)


def sets_of(docs: DataFrame, folder: str, k: int) -> DataFrame:
    def build(batches):
        attempt = TaskContext.get().taskAttemptId()  # offsets hold for this attempt's order of rows only
        out = store.Appender(folder, f"sets-{attempt}")
        for rows, u8, off in flat.slices(batches):
            h, at = flat.words(u8, off)
            n, total, other, offset = (np.zeros(len(off) - 1, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
            for i, s in enumerate(flat.shingle_sets(h, at, k)):
                n[i], total[i], other[i], offset[i] = len(s), flat.mix(s).sum(dtype=np.uint64), flat.mix(s ^ flat.U(0xA0761D6478BD642F)).sum(dtype=np.uint64), out.add(s)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), pa.array(np.full(len(n), attempt, np.int64)), pa.array(offset)], ["doc_id", "n", "total", "other", "file", "offset"])
        out.close()

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, total long, other long, file long, offset long")


class Sets:
    """Sets by file and offset."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __call__(self, file: int, offset: int, n: int) -> np.ndarray:
        if file not in self.files:
            self.files[file] = store.mapped(self.folder, f"sets-{file}", np.uint64)
        if offset + n > len(self.files[file]):
            raise OSError(f"sets-{file} is shorter than its rows say")
        return self.files[file][offset : offset + n]


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that is light: what enumeration and scans cost together is least there."""
    subsets = lambda n: sum(comb(n, j) for j in range(n - least_shared(n, percent) + 1))
    scan = lambda n: SCAN * (n - least_shared(n, percent) + 1)

    def cost(b: int) -> int:
        return sum(c * (subsets(n) if n * percent <= b * 100 else 0) + c * (scan(n) if n > b else 0) for n, c in sizes.items())

    return min((b for b in range(0, 64) if b - least_shared(b, percent) <= 3), key=lambda b: (cost(b), b))


def frequent(reps: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and in how many sets they were found; at most mean size / FREQUENT of them."""

    def count(batches):
        read = Sets(folder)
        for pdf in batches:
            every = [read(f, o, n) for f, o, n in zip(pdf["file"], pdf["offset"], pdf["n"])]
            for a in range(0, len(every), 2000):
                part = every[a : a + 2000]
                h, c = np.unique(np.concatenate(part), return_counts=True)
                much = c >= max(4, FREQUENT * len(part))
                yield pd.DataFrame({"h": h[much].view(np.int64), "c": c[much]})

    total = reps.count()
    got = reps.select("file", "offset", "n").mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(4, FREQUENT / 2 * total)).toPandas()
    h, c = got["h"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def entries(reps: DataFrame, folder: str, percent: int, light: int, freq: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (key, shared, doc_id, n, file, offset): shared is a subset's size, -1 in an inverted list."""

    def keys_of(s: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys, shared, out = [], [], n - least_shared(n, percent)
        if n * percent <= light * 100:
            m = flat.mix(np.array(s))
            for j in range(out + 1):
                drop = np.array([m[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), j)], np.uint64)
                keys.append(flat.mix(m.sum(dtype=np.uint64) - drop))
                shared.append(np.full(len(drop), n - j, np.int32))
        if n > light:
            p, df = out + 1, np.zeros(len(s), np.int64)
            if len(freq[0]):
                at = np.minimum(np.searchsorted(freq[0], s), len(freq[0]) - 1)
                df = np.where(freq[0][at] == s, freq[1][at], 0)
            first = np.flatnonzero(df == 0)[:p] if (df == 0).sum() >= p else np.lexsort((s, df))[:p]
            often = np.array(s[first[df[first] > 0]])
            band = int(np.log(n) / np.log(max(100 / percent, 1.001)) + 1e-9)  # partners are in the same band or one beside it
            keys += [np.array(s[first[df[first] == 0]]), *(flat.mix(often + flat.U(b + 1)) for b in (band, band + 1))]
            shared.append(np.full(sum(map(len, keys[-3:])), -1, np.int32))
        return keys, shared

    def emit(batches):
        read = Sets(folder)
        for batch in batches:
            for a in range(0, len(batch), 500):
                pdf = batch.iloc[a : a + 500]
                keys, shared, size = [], [], []
                for n, f, o in zip(pdf["n"], pdf["file"], pdf["offset"]):
                    k, x = keys_of(read(f, o, n), n)
                    keys += k
                    shared += x
                    size.append(sum(map(len, k)))
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "shared": np.concatenate(shared), **{c: np.repeat(pdf[c].to_numpy(), size) for c in ("doc_id", "n", "file", "offset")}})

    return reps.mapInPandas(emit, "key long, shared int, doc_id long, n long, file long, offset long")


class Joined:
    """Ids that are known to be in one component."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements ``one`` shares with each of ``others`` (all sorted, none empty)."""
    out, a = np.zeros(len(others), np.int64), 0
    sizes = np.cumsum([0] + [len(x) for x in others])
    while a < len(others):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + BLOCK, "right")) - 1)
        every = np.concatenate(others[a:b])
        hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        out[a:b] = np.add.reduceat(hit, sizes[a:b] - sizes[a], dtype=np.int64)
        a = b
    return out


def linked(folder: str, percent: int):
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        read, a, b, joined = Sets(folder), [], [], Joined()
        pdf = pdf.sort_values(["shared", "key", "n", "doc_id"], ignore_index=True)
        key, shared, doc, n = (pdf[c].to_numpy() for c in ("key", "shared", "doc_id", "n"))
        file, offset = pdf["file"].to_numpy(), pdf["offset"].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (shared[1:] != shared[:-1])])
        length = np.diff(np.r_[first, len(pdf)])
        head = np.repeat(first, length)

        def check(x, y):
            """Joins the sets in rows x and y if they are known to be apart so far, and link."""
            if joined.top(int(doc[x])) != joined.top(int(doc[y])):
                both = int(shared_counts(read(file[x], offset[x], n[x]), [read(file[y], offset[y], n[y])])[0])
                if 100 * both >= percent * (n[x] + n[y] - both):
                    joined.join(int(doc[x]), int(doc[y]))
                    a.append(doc[x : x + 1]), b.append(doc[y : y + 1])

        ok = (shared >= 0) & (head != np.arange(len(pdf))) & (100 * shared.astype(np.int64) >= percent * (n + n[head] - shared))
        for x, y in zip(np.flatnonzero(ok).tolist(), head[ok].tolist()):  # the smallest set stands for its group: what does not link with it links with none
            check(x, y)
        lists = shared[first] < 0
        many = np.flatnonzero(np.repeat(lists & (length > 1), length))
        _, one, which = np.unique(doc[many], return_index=True, return_inverse=True)
        counts = np.zeros((len(one), RANGES), np.int32)
        for x, y in enumerate(many[one]):
            counts[x] = np.bincount((read(file[y], offset[y], n[y]) >> flat.U(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES)
        of = np.zeros(len(pdf), np.int64)
        of[many] = which

        def near(i, j):
            """Whether the sizes, and the counts in ranges, allow a link."""
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = (np.broadcast_to(x, ok.shape)[ok] for x in (i, j))
            most = np.concatenate([np.minimum(counts[of[i[z : z + 4096]]], counts[of[j[z : z + 4096]]]).sum(1) for z in range(0, len(i), 4096)]) if len(i) else np.zeros(0, np.int64)
            ok[ok] = 100 * most >= percent * (n[i] + n[j] - most)
            return ok

        for size in range(2, SHORT + 1):
            start = first[lists & (length == size)]
            if not len(start):
                continue
            i, j = (np.concatenate([start + p[x] for p in combinations(range(size), 2)]) for x in (0, 1))
            fits = near(i, j)
            i, j = i[fits], j[fits]
            lo, hi = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            order = np.lexsort((hi, lo))
            new = order[np.r_[True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)]] if len(order) else order
            for x, y in zip(i[new].tolist(), j[new].tolist()):
                check(x, y)
        for s, size in zip(first[lists & (length > SHORT)], length[lists & (length > SHORT)]):
            at = np.arange(s, s + size)
            own = counts[of[at]] / n[at, None]
            order = np.argsort(np.abs(own - np.median(own, axis=0)).sum(1), kind="stable")  # the middle of a group is tried first
            top = np.array([joined.top(x) for x in doc[at].tolist()])
            for k, p in enumerate(order):
                rest = order[k + 1 :]
                rest = rest[top[rest] != top[p]]
                rest = rest[near(at[rest], at[p : p + 1])] if len(rest) else rest
                if not len(rest):
                    continue
                both = shared_counts(read(file[at[p]], offset[at[p]], n[at[p]]), [read(file[x], offset[x], n[x]) for x in at[rest]])
                hit = rest[100 * both >= percent * (n[at[rest]] + n[at[p]] - both)]
                if len(hit):
                    for x in doc[at[hit]].tolist():
                        joined.join(int(doc[at[p]]), x)
                    a.append(doc[at[hit]]), b.append(np.full(len(hit), doc[at[p]]))
                    top = np.array([joined.top(x) for x in doc[at].tolist()])
        pdf = key = shared = doc = n = file = offset = read = None
        flat.trim()
        return pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    return scan


class Kept:
    """Ids of documents, in sorted arrays of the shared folder, with how many rows have each."""

    def __init__(self, folder: str, shards: int):
        self.by = store.Lookup(folder, "kept", shards, {"n": "u4"})

    def write(self, ids: DataFrame) -> int:
        """Stores rows (doc_id, n), no id null or twice; returns how many have an n over 1."""
        by = self.by

        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            key = flat.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64))
            order = np.argsort(key)
            s = int(by.of(key[:1])[0])
            by.write(s, key[order], n=pdf["n"].to_numpy()[order])
            return pd.DataFrame({"shard": [s], "n": [len(key)], "many": [int((pdf["n"] > 1).sum())]})

        def home(batches):
            for pdf in batches:
                yield pdf.assign(shard=by.of(flat.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64))).astype(np.int32))

        dealt = ids.mapInPandas(home, "doc_id long, n long, shard int")
        dealt.groupBy("shard").applyInPandas(lambda pdf: put(pdf), "shard int, n long, many long").write.mode("overwrite").parquet(f"{by.folder}/stored")
        stored = ids.sparkSession.read.parquet(f"{by.folder}/stored").collect()  # a row for each shard
        by.sealed({r["shard"]: r["n"] for r in stored})
        return sum(r["many"] for r in stored)

    def only(self, docs: DataFrame, many: bool) -> DataFrame:
        """Rows whose id is kept and stands in several rows, or else in one; rows with a null doc_id count as one."""

        def pick(batches):
            for rows in batches:
                doc = rows.column("doc_id").cast(pa.int64())
                key, back = np.unique(flat.mix(doc.fill_null(0).to_numpy().view(np.uint64)), return_inverse=True)
                n = np.where(doc.is_null().to_numpy(zero_copy_only=False), 1, self.by.find(key)[1]["n"][back])
                yield rows.filter(pa.array(n > 1 if many else n == 1))

        return docs.mapInArrow(pick, docs.schema)


def first_of_each(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component of the join.

    No text moves between tasks. Rows that repeat one doc_id and text count as one; rows with a null doc_id stay.
    """
    spark = docs.sparkSession
    kept = Kept(store.shared_dir(spark, "kept"), store.parts_for(docs, BYTES))
    first = jaccard_join(docs, k, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    many = kept.write(first)
    out = kept.only(docs, False)
    return out.unionByName(kept.only(docs, True).dropDuplicates(["doc_id", "text"])) if many else out


def jaccard_join(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): documents linked where 100 * shared >= percent * union.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text, or one of separators
    alone, has no shingles and links with nothing; a null doc_id links with nothing and keeps a null
    component_id. Repeated rows are equal sets and give a row each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = store.shared_dir(spark, "jaccard")
    every = store.saved(sets_of(docs, folder, k), folder, "rows")
    reps = every.where("n > 0 and doc_id is not null").groupBy("total", "other", "n").agg(F.min(F.struct("doc_id", "file", "offset")).alias("r"))
    parts = store.parts_for(docs, BYTES) * 4
    reps = store.saved(reps.select("r.doc_id", "n", "r.file", "r.offset", "total", "other").repartition(parts, "doc_id"), folder, "classes")  # rows are short, the work on their sets is not
    sizes = {r["n"]: r["count"] for r in reps.where("n < 128").groupBy("n").count().collect()}  # at most 127 rows
    light = boundary(sizes, percent)
    rows = entries(reps.select("doc_id", "n", "file", "offset"), folder, percent, light, frequent(reps, folder))
    links = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("bucket")).applyInPandas(linked(folder, percent), "a long, b long")
    cc = components(links, folder)
    store.drop(folder, "sets-")
    of = reps.join(cc, reps.doc_id == cc.id, "left").select("total", "other", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    full = every.join(of, ["total", "other", "n"], "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
