"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample. Every row is indexed: rows are dealt evenly by a
hash of their id over shards (so a crowded list lies in all of them), each sorted by list and written to
the shared folder. Query tasks map the shards into memory, rank the probed lists' rows by
asymmetric distance tables and rerank the best by exact distance in double precision. A sample of
the queries is compared with brute force over all rows, and probes and reranked rows are doubled until
the recall is reached; a query whose lists hold too few rows looks into more of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .vectors import closest, matrix, precision, valid

#: Rows to fit on and queries to audit, at most; the recall that the audit must reach.
SAMPLE, AUDIT, RECALL = 20_000, 128, 0.97
#: Rows of a shard, on average; shards at least.
ROWS, SHARDS = 100_000, 8
_HIT = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.concatenate([closest(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)][full]) / n[full, None]
        c[n == 0] = x[rnd.choice(len(x), int((n == 0).sum()))]
    return c


class Index:
    def __init__(self, folder: str, d: int, kind: str, shards: int):
        self.folder, self.d, self.kind, self.shards = folder, d, kind, shards
        self.sizes: dict[int, int] = {}
        self.parts = np.array_split(np.arange(d), min(16, d))

    def fit(self, x: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(x, lists, 8)
        rest = x - self.coarse[self.nearest(x)]
        self.books = [kmeans(rest[:, p], min(256, len(x)), 6) for p in self.parts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([closest(x[i : i + 4096], self.coarse).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def write(self, s: int, ids: np.ndarray, raw: np.ndarray) -> None:
        """Files of one shard: rows by list, then id; of each the codes, and what of its distance no query changes."""
        x = raw.astype(np.float32)
        at = self.nearest(x)
        order = np.lexsort((ids, at))
        ids, raw, x, at = ids[order], raw[order], x[order], at[order]
        rest = x - self.coarse[at]
        codes, same = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x), np.float32)
        for j, (p, book) in enumerate(zip(self.parts, self.books)):
            codes[:, j] = np.concatenate([closest(rest[i : i + 4096, p], book).argmin(1) for i in range(0, len(x), 4096)])
            own = book[codes[:, j]]
            same += (own * own + 2 * own * self.coarse[at][:, p]).sum(1)
        for name, array in (("ids", ids), ("raw", raw.astype(self.kind)), ("codes", codes), ("same", same), ("cut", np.searchsorted(at, np.arange(len(self.coarse) + 1)))):
            store.put(self.folder, f"{name}-{s}", array)

    def open(self) -> list[tuple[np.ndarray, ...]]:
        out = []
        for s, n in sorted(self.sizes.items()):
            ids, raw, codes, same, cut = (store.mapped(self.folder, f"{x}-{s}", t, least) for x, t, least in (("ids", "i8", n), ("raw", self.kind, n * self.d), ("codes", "u1", n * len(self.parts)), ("same", "f4", n), ("cut", "i8", len(self.coarse) + 1)))
            out.append((ids, raw.reshape(-1, self.d), codes.reshape(len(ids), -1), same, cut))
        return out

    def search(self, shards, query: int, v: np.ndarray, k: int, probes: int, rerank: int) -> list[tuple[int, int, int, float]]:
        q, exact = v.astype(np.float32), v.astype(np.float64)
        far = closest(q[None], self.coarse)[0]
        lists = np.sort(np.argpartition(far, probes - 1)[:probes])
        table = np.stack([np.pad(book @ q[p], (0, 256 - len(book))) for p, book in zip(self.parts, self.books)])
        got_ids, got = [], []
        for ids, raw, codes, same, cut in shards:
            n = cut[lists + 1] - cut[lists]
            at = flat.ragged(cut[lists], n)
            guess = np.repeat(far[lists], n) + same[at] - 2 * table[np.arange(len(self.parts)), codes[at]].sum(1)
            if len(at) > rerank:
                best = np.sort(np.argsort(guess, kind="stable")[:rerank])
                at = at[best]
            own = ids[at]
            at, own = at[own != query], own[own != query]
            diff = raw[at].astype(np.float64) - exact
            got_ids.append(own), got.append(np.sqrt((diff * diff).sum(1)))
        ids, score = np.concatenate(got_ids), np.concatenate(got)
        if len(ids) < k and probes < len(self.coarse):  # too few in the lists probed: this query looks into more
            return self.search(shards, query, v, k, min(2 * probes, len(self.coarse)), rerank)
        best = np.lexsort((ids, score))[:k]
        return [(query, r, int(ids[b]), float(score[b])) for r, b in enumerate(best, 1)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["query_id", "rank", "vec_id", "score"])


def searched(queries: DataFrame, index: Index, k: int, probes: int, rerank: int) -> DataFrame:
    def run(batches):
        shards = index.open()
        for rows in batches:
            ids, x = rows.column("vec_id").to_pylist(), matrix(rows.column("embedding"), index.d)
            for a in range(0, len(ids), 256):
                yield _batch([hit for i, v in zip(ids[a : a + 256], x[a : a + 256]) for hit in index.search(shards, i, v, k, probes, rerank)])

    return queries.select("vec_id", "embedding").mapInArrow(run, _HIT)


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], d: int, k: int) -> set[tuple[int, int]]:
    """The true neighbours of a few queries, found over all rows in blocks."""
    ids, q = [i for i, _ in queries], np.array([v for _, v in queries], np.float64)

    def run(batches):
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), d).astype(np.float64)
            out = []
            for i, v in zip(ids, q):
                dist = np.sqrt(((x - v) ** 2).sum(1))
                dist[own == i] = np.inf
                best = np.lexsort((own, dist))[:k]
                out += [(i, 0, int(own[b]), float(dist[b])) for b in best if dist[b] < np.inf]
            yield _batch(out)

    from pyspark.sql import Window

    best = rows.select("vec_id", "embedding").mapInArrow(run, _HIT)
    near = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("r") <= k)
    return {(r["query_id"], r["vec_id"]) for r in near.collect()}  # k for each audited query


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each row whose vec_id ``every`` divides.

    Nearest first by Euclidean distance, ties to the smaller vec_id. Vectors that are null or zero, hold null or non-finite
    components or have another length than most take no part, nor does a null vec_id. With fewer candidates than ``k``
    all are returned (the audit then needs all probes). Rows with one vec_id are never each other's neighbours. Other
    columns are ignored; without valid rows there are no results.
    """
    spark = rows.sparkSession
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    fine, d = valid(named)
    kept = named.where(fine)
    n = kept.count()
    if not n:
        return spark.createDataFrame([], _HIT)
    shards = max(SHARDS, -(-n // ROWS))
    index = Index(store.shared_dir(spark, "ivfpq"), d, precision(rows), shards)
    most = min(SAMPLE, max(1, (64 << 20) // (4 * d)))
    sample = kept.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, most / n)))).select("embedding").limit(2 * most).toArrow()
    if not len(sample):
        sample = kept.select("embedding").limit(1).toArrow()
    x = matrix(sample.column("embedding"), d).astype(np.float32)
    lists = max(1, min(4096, int(2 * n**0.5), len(x) // 32))
    index.fit(x, lists)

    def build(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        index.write(s, table.column("vec_id").to_numpy(), matrix(table.column("embedding"), d))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(table)], pa.int64())})

    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int"))
    dealt.groupBy("shard").applyInArrow(build, "shard int, n long").write.mode("overwrite").parquet(f"{index.folder}/built")
    index.sizes = {r["shard"]: r["n"] for r in spark.read.parquet(f"{index.folder}/built").collect()}  # a row for each shard
    queries = kept.where(F.col("vec_id") % every == 0)
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDIT).toArrow()
    audit = list(zip(asked.column("vec_id").to_pylist(), matrix(asked.column("embedding"), d)))
    probes, rerank = max(1, lists // 16), 16 * k
    if audit:
        want = exact(kept, audit, d, k)
        some = spark.createDataFrame(asked)
        while probes < lists or rerank < n:
            found = {(r["query_id"], r["vec_id"]) for r in searched(some, index, k, probes, rerank).collect()}
            if len(found & want) >= RECALL * len(want):
                break
            probes, rerank = min(lists, 2 * probes), min(n, 2 * rerank)
    return searched(queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id"), index, k, probes, rerank)
