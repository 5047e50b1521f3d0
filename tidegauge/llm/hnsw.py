"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors become one class first. Classes are dealt by a hash over shards; a shard's graph is built in
batches: each is searched in the graph so far, neighbours are chosen so that none is closer to one chosen
before than to the node, and full lists are chosen again. Every class is searched in every shard:
tasks map the graphs into memory and search a block of queries in lock step. A beam that ends full of
links is widened for its query; the first width is doubled until an audit, brute force for a
sample over all classes, finds the recall as the mean of each class's found share, for classes of few links
and of many on their own. The sample grows until enough of it has few links; where such classes are too rare,
vectors planted near sampled classes are asked as well. Links are verified by cosine in double precision, computed alike from
both sides. A shard first joins its own nodes by the links inside it; a block of queries then sends pairs of such
shard components only, a spanning forest of them, so no group's links are gathered. Where both ends of a link have few, one that
was found from one side only counts for both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .components import components, roots
from .vectors import matrix, precision, valid

#: Neighbours of a node above the ground and on it, beam while building, first beam of a search.
UP, DOWN, BUILD, BEAM = 12, 24, 40, 32
#: Classes of a shard, on average; shards at least.
ROWS, SHARDS = 100_000, 6
#: Classes that an audit compares with brute force, at first and at most, and the part of their links that must be found.
AUDIT, AUDITS, RECALL = 256, 16_384, 0.995
#: Links that are few (a beam seldom fills with them), and audited classes that should have so few.
FEW, ENOUGH = 32, 64
#: Classes whose links are found at once.
QUERIES = 1024
#: Marks of visited nodes that a block of queries may take.
MARKS = 1 << 22


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``width`` most similar nodes that a best-first search from ``start`` finds, best first (-1: none)."""
    n, b = len(near), len(q)
    ids, sim, done = np.full((b, width), -1, np.int64), np.full((b, width), -2, np.float32), np.ones((b, width), bool)
    seen = np.zeros((b, n), bool)
    m = min(width, start.shape[1])
    ids[:, :m] = start[:, :m]
    rows = np.arange(b)
    for j in range(m):
        sim[:, j] = (x[ids[:, j]] * q).sum(1)
        done[:, j] = seen[rows, ids[:, j]]
        sim[done[:, j], j] = -2
        seen[rows, ids[:, j]] = True
    on = rows
    while len(on):
        s = np.where(done[on], np.float32(-3), sim[on])
        step = min(4, width)
        pick = np.argpartition(-s, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), s.shape)
        good = np.take_along_axis(s, pick, 1) > -2
        live = good.any(1)
        on, pick, good = on[live], pick[live], good[live]
        if not len(on):
            break
        done[on[:, None], pick] = True
        nodes = np.where(good, ids[on[:, None], pick], -1)
        new = np.where((nodes >= 0)[:, :, None], near[np.maximum(nodes, 0)], -1).reshape(len(on), -1).astype(np.int64)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        r, c = np.nonzero((new >= 0) & ~seen[on[:, None], np.maximum(new, 0)])
        found = new[r, c]
        seen[on[r], found] = True
        more = np.full(new.shape, -2, np.float32)
        for a in range(0, len(r), 1 << 15):
            z = slice(a, a + (1 << 15))
            more[r[z], c[z]] = np.einsum("ij,ij->i", x[found[z]], q[on[r[z]]])
        every = np.concatenate([sim[on], more], 1)
        top = np.argpartition(-every, width - 1, axis=1)[:, :width]
        sim[on] = np.take_along_axis(every, top, 1)
        ids[on] = np.take_along_axis(np.concatenate([ids[on], np.where(more > -2, new, -1)], 1), top, 1)
        done[on] = np.take_along_axis(np.concatenate([done[on], more <= -2], 1), top, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(sim > -2, ids, -1), sim


def chosen(x: np.ndarray, node: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
    """For each node up to ``width`` of its candidates (-1: none), nearest first, each nearer to the node than to those chosen before; what room is left goes to the nearest others."""
    out = np.full((len(node), width), -1, np.int32)
    for a in range(0, len(node), 256):
        ids = cand[a : a + 256].copy()
        own = x[node[a : a + 256]]
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == node[a : a + 256, None]] = -1
        v = x[np.maximum(ids, 0)]
        sim = np.where(ids >= 0, np.einsum("bcd,bd->bc", v, own), -2)
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim, v = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = v @ v.transpose(0, 2, 1)
        take = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            clash = np.where(take[:, :j], between[:, j, :j], -2).max(1, initial=-2)
            take[:, j] = (ids[:, j] >= 0) & (clash < sim[:, j]) & (take[:, :j].sum(1) < width)
        rank = np.argsort(np.where(ids < 0, 2, ~take), axis=1, kind="stable")[:, :width]
        got = np.take_along_axis(ids, rank, 1)
        out[a : a + 256, : got.shape[1]] = got
    return out


class Graph:
    """A shard: unit vectors, layers from the ground up, and the node where searches begin."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.n = x, len(x)
        u = (flat.mix(ids.astype(np.int64).view(np.uint64)) >> flat.U(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(UP)).astype(np.int64), 8)
        self.order = np.argsort(-self.level, kind="stable")  # upper nodes first: all layers of a prefix are complete
        self.layers = [np.full((self.n, DOWN if k == 0 else UP), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry = int(self.order[0]) if self.n else 0
        done = 0
        while done < self.n:
            size = min(max(64, done), max(1, min(1024, MARKS // self.n)), self.n - done)
            self.insert(self.order[done : done + size], done)
            done += size

    def insert(self, new: np.ndarray, done: int) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry)
        inner = q @ q.T
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.level[new] >= k
            found = beam(self.x, self.layers[k], q, start, BUILD if here.any() else 1)[0] if done else start
            at = np.flatnonzero(here)
            if len(at):
                peers = np.argsort(-inner[np.ix_(at, at)], axis=1)[:, : DOWN + 1]
                cand = np.concatenate([found[at] if done else np.full((len(at), 1), -1), new[at][peers]], 1)
                width = self.layers[k].shape[1]
                own = chosen(self.x, new[at], cand.astype(np.int64), width // 2 if width > 4 else width)
                self.layers[k][new[at], : own.shape[1]] = own
                self.back(k, new[at], own)
            start = np.where(found >= 0, found, self.entry)

    def back(self, k: int, new: np.ndarray, own: np.ndarray) -> None:
        """The nodes chosen get the new ones as neighbours; lists that run over are chosen again."""
        near, width = self.layers[k], self.layers[k].shape[1]
        to, frm = own.ravel(), np.repeat(new, own.shape[1])
        keep = to >= 0
        order = np.argsort(to[keep], kind="stable")
        to, frm = to[keep][order], frm[keep][order]
        node, first, n = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, int(n.max(initial=0)), width):  # so many of a node's new ones at a time
            part = np.minimum(n - a, width)
            live = np.flatnonzero(part > 0)
            add = np.full((len(live), width), -1, np.int64)
            rows = np.repeat(np.arange(len(live)), part[live])
            cols = flat.ragged(np.zeros(len(live), np.int64), part[live])
            add[rows, cols] = frm[first[live][rows] + a + cols]
            near[node[live]] = chosen(self.x, node[live], np.concatenate([near[node[live]], add], 1), width)


def search(x: np.ndarray, layers: list[np.ndarray], entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.full((len(q), 1), entry)
    for near in layers[:0:-1]:
        found = beam(x, near, q, start, 8)[0]
        start = np.where(found >= 0, found, entry)
    return beam(x, layers[0], q, start, width)


def even(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled by a power of two so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


class Shards:
    def __init__(self, folder: str, d: int, kind: str, shards: int):
        self.folder, self.d, self.kind, self.shards = folder, d, kind, shards
        self.about: dict[int, tuple[int, int, int]] = {}

    def write(self, s: int, ids: np.ndarray, raw: np.ndarray, times: np.ndarray) -> tuple[int, int, int]:
        """Returns the numbers of nodes and layers, and the entry."""
        order = np.argsort(ids, kind="stable")
        ids, raw, times = ids[order], raw[order], times[order]
        x = even(raw)
        x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
        g = Graph(x, ids)
        for name, a in (("ids", ids), ("raw", raw.astype(self.kind)), ("unit", x), ("times", times)):
            store.put(self.folder, f"{name}-{s}", a)
        for k, near in enumerate(g.layers):
            store.put(self.folder, f"near{k}-{s}", near)
        return len(ids), len(g.layers), g.entry

    def open(self, which=None):
        """Of each shard with nodes, or those of ``which``: its number, ids, vectors, unit vectors, copies, layers and entry."""
        for s in sorted(self.about) if which is None else which:
            n, layers, entry = self.about[s]
            ids, times = (store.mapped(self.folder, f"{x}-{s}", "i8", n) for x in ("ids", "times"))
            raw, x = (store.mapped(self.folder, f"{x}-{s}", t, n * self.d).reshape(-1, self.d) for x, t in (("raw", self.kind), ("unit", "f4")))
            yield s, ids, raw, x, times, [store.mapped(self.folder, f"near{k}-{s}", "i4", n).reshape(n, -1) for k in range(layers)], entry

    def parts(self) -> list[np.ndarray]:
        """For each shard with nodes, in order, the smallest id that links inside the shard reach from each node."""
        return [store.mapped(self.folder, f"part-{s}", "i8", self.about[s][0]) for s in sorted(self.about)]

    def links(self, shards, own: np.ndarray, raw: np.ndarray, least: float, width: int) -> tuple[np.ndarray, ...]:
        """Links found: row of ``own``, index in ``shards`` and node there, of cosines of ``least`` or more."""
        exact = even(raw)
        norm = (exact * exact).sum(1)
        q, out = (exact / np.sqrt(norm)[:, None]).astype(np.float32), []
        for index, (_, ids, vectors, x, _, layers, entry) in enumerate(shards):
            block = max(1, min(256, MARKS // len(ids)))
            todo, w = np.arange(len(q)), min(width, len(ids))
            while len(todo):
                again = []
                for a in range(0, len(todo), block):
                    at = todo[a : a + block]
                    found, sim = search(x, layers, entry, q[at], w)
                    full = sim[:, -1] >= least - 1e-4 if w < len(ids) else np.zeros(len(at), bool)
                    again.append(at[full])
                    r, c = np.nonzero((sim >= least - 1e-4) & (found >= 0) & ~full[:, None])
                    for z in range(0, len(r), 1 << 14):
                        row, node = at[r[z : z + (1 << 14)]], found[r[z : z + (1 << 14)], c[z : z + (1 << 14)]]
                        v = even(vectors[node])
                        cos = (v * exact[row]).sum(1) / np.sqrt((v * v).sum(1) * norm[row])
                        ok = (cos >= least) & (ids[node] != own[row])
                        out.append((row[ok], np.full(int(ok.sum()), index), node[ok]))
                todo, w = np.concatenate(again), min(4 * w, len(ids))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def joined_inside(spark, shards: Shards, least: float, width: int) -> None:
    """Stores, for each shard, the smallest id that links inside it reach from each node."""

    def run(batches):
        for rows in batches:
            for s in rows.column("id").to_pylist():
                (one,) = shards.open([s])
                ids, raw, root = one[1], one[2], np.array(one[1])
                for a in range(0, len(ids), 1024):  # links found so far are kept as each node's smallest id: memory stays bounded
                    row, _, node = shards.links([one], ids[a : a + 1024], raw[a : a + 1024], least, width)
                    nodes, low = roots(np.r_[ids[a : a + 1024][row], ids], np.r_[ids[node], root])
                    root = low[np.searchsorted(nodes, ids)]
                store.put(shards.folder, f"part-{s}", root)
            yield pa.RecordBatch.from_arrays([rows.column("id")], ["id"])

    full = spark.createDataFrame([(s,) for s in sorted(shards.about)], "id long").repartition(len(shards.about), "id")
    full.mapInArrow(run, "id long").write.mode("overwrite").parquet(f"{shards.folder}/inside")


COUNT, JOIN, LINK = range(3)


def found(reps: DataFrame, shards: Shards, least: float, width: int) -> DataFrame:
    """Rows (kind, a, b, n, own): for each class a its links to rows n, and to classes b (COUNT); pairs that join shard components (JOIN); of classes with few links each link, the copies of b and of a (LINK)."""

    def run(batches):
        opened, parts = list(shards.open()), shards.parts()
        for rows in batches:
            ids, raw, copies = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), shards.d), rows.column("times").to_numpy()
            for i in range(0, len(ids), QUERIES):
                own = ids[i : i + QUERIES]
                row, index, node = shards.links(opened, own, raw[i : i + QUERIES], least, width)
                to, times, part = np.zeros((3, len(row)), np.int64)
                mine = own.copy()
                for x, one in enumerate(opened):
                    at = index == x
                    to[at], times[at], part[at] = one[1][node[at]], one[4][node[at]], parts[x][node[at]]
                    here = np.minimum(np.searchsorted(one[1], own), len(one[1]) - 1)
                    mine = np.where(one[1][here] == own, parts[x][here], mine)
                n, m = np.bincount(row, weights=times, minlength=len(own)).astype(np.int64), np.bincount(row, minlength=len(own))
                a, b = roots(np.r_[mine[row], own], np.r_[part, mine])
                few = m[row] <= FEW
                a, b = a[a != b], b[a != b]
                columns = [np.repeat([COUNT, JOIN, LINK], [len(own), len(a), int(few.sum())]), np.r_[own, a, own[row[few]]], np.r_[m, b, to[few]], np.r_[n, b, times[few]], np.r_[n, b, copies[i : i + QUERIES][row[few]]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "a", "b", "n", "own"])

    return reps.select("vec_id", "embedding", "times").mapInArrow(run, "kind long, a long, b long, n long, own long")


def counted(reps: DataFrame, shards: Shards, least: float, width: int) -> DataFrame:
    """Rows (a, b): to how many classes each of a few vectors is found to be linked."""

    def run(batches):
        opened = list(shards.open())
        for rows in batches:
            own = rows.column("vec_id").to_numpy()
            row = shards.links(opened, own, matrix(rows.column("embedding"), shards.d), least, width)[0]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(row, minlength=len(own)).astype(np.int64))], ["a", "b"])

    return reps.select("vec_id", "embedding").mapInArrow(run, "a long, b long")


def counts(links: DataFrame) -> DataFrame:
    """Rows (rep, n): the links of each class, those of both ends' few links counted for both although one side only found them."""
    every = links.where(F.col("kind") == COUNT).select(F.col("a").alias("rep"), "n", F.col("b").alias("m"))
    pair = links.where(F.col("kind") == LINK)
    both = pair.select("a", "b", F.lit(1).alias("here"), F.col("n").alias("t")).union(pair.select("b", "a", F.lit(0), "own"))
    missed = both.groupBy("a", "b").agg(F.max("here").alias("here"), F.max("t").alias("t")).where("here = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("t").alias("more"))
    return every.join(missed, "rep", "left").select("rep", (F.col("n") + F.when(F.col("m") <= FEW, F.coalesce("more", F.lit(0))).otherwise(0)).alias("n"))


def true_links(reps: DataFrame, ids: np.ndarray, raw: np.ndarray, least: float) -> np.ndarray:
    """To how many classes each of a few vectors is linked, found over all classes in blocks."""
    q = even(raw)
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    step = max(1, MARKS // len(q))

    def run(batches):
        n = np.zeros(len(q), np.int64)
        for rows in batches:
            x = even(matrix(rows.column("embedding"), q.shape[1]))
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = rows.column("vec_id").to_numpy()
            for a in range(0, len(own), step):
                n += ((x[a : a + step] @ q.T >= least) & (own[a : a + step, None] != ids)).sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["i", "n"])

    want = np.zeros(len(q), np.int64)
    for r in reps.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each of the few
        want[r["i"]] = r["n"]
    return want


def planted(asked: pa.Table, raw: np.ndarray, least: float) -> pa.Table:
    """A vector near each asked class, of a cosine just over ``least``, under an id that is not the class's."""
    u = even(raw)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    g = np.random.default_rng(0).normal(size=u.shape)
    g -= (g * u).sum(1, keepdims=True) * u
    g /= np.maximum(np.sqrt((g * g).sum(1, keepdims=True)), 1e-300)
    c = least + 0.1 * (1 - least)
    near = (c * u + np.sqrt(1 - c * c) * g).tolist()
    return pa.table({"vec_id": pa.array(~asked.column("vec_id").to_numpy()), "embedding": pa.array(near, asked.schema.field("embedding").type)})


def audited(reps: DataFrame, total: int, d: int, least: float) -> list[tuple[pa.Table, np.ndarray]]:
    """Vectors (vec_id, embedding) to be asked in an audit, and to how many classes each is linked; the classes, then planted ones."""
    size, asked, want = AUDIT, None, np.zeros(0, np.int64)
    while True:
        asked = reps.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(size).toArrow()
        ids, raw = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"), d)
        want = np.r_[want, true_links(reps, ids[len(want) :], raw[len(want) :], least)]
        enough = ((want > 0) & (want <= FEW)).sum() >= ENOUGH
        if enough or size >= min(total, AUDITS):
            break
        size = min(4 * size, AUDITS)
    linked = asked.filter(pa.array(want > 0))
    parts = [(linked, want[want > 0])] if len(linked) else []
    if not enough and d > 1:
        near = planted(asked.slice(0, AUDIT), raw[:AUDIT], least)
        more = true_links(reps, near.column("vec_id").to_numpy(), matrix(near.column("embedding"), d), least)
        if more.any():
            parts.append((near.filter(pa.array(more > 0)), more[more > 0]))
    return parts


def met(got: np.ndarray, want: np.ndarray) -> bool:
    """Whether the recall is reached, as a mean over vectors, by those of few links and by the others."""
    share, few = got / want, want <= FEW
    return all(share[m].mean() >= RECALL for m in (few, ~few) if m.any())


def near_duplicates(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row, linked where the cosine is ``least`` or more.

    Vectors that are null or zero, hold null or non-finite components or have another length than most link with
    nothing, nor does a null vec_id (its component_id is null, kept null). n_links counts rows, so repeated rows count each. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine, d = valid(rows.where("vec_id is not null"))
    fine = fine & F.col("vec_id").isNotNull()
    kept = rows.where(fine)
    folder = store.shared_dir(spark, "hnsw")
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]  # equal vectors have equal keys; 128 bits tell others apart
    reps = store.saved(kept.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("embedding").alias("embedding")), folder, "classes")
    total = reps.count()
    alone = lambda rows: rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), True).alias("kept"))
    if not total:
        return alone(rows)
    shards = Shards(folder, d, precision(rows), max(SHARDS, -(-total // ROWS)))

    def build(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        n, layers, entry = shards.write(s, table.column("vec_id").to_numpy(), matrix(table.column("embedding"), d), table.column("times").to_numpy())
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([n], pa.int64()), "layers": pa.array([layers], pa.int64()), "entry": pa.array([entry], pa.int64())})

    dealt = reps.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards.shards)).cast("int")).select("vec_id", "times", "embedding", "shard")
    dealt.groupBy("shard").applyInArrow(build, "shard int, n long, layers long, entry long").write.mode("overwrite").parquet(f"{folder}/built")
    shards.about = {r["shard"]: (r["n"], r["layers"], r["entry"]) for r in spark.read.parquet(f"{folder}/built").collect()}  # a row for each shard
    width = BEAM
    for asked, want in audited(reps, total, d, least):
        some, place = spark.createDataFrame(asked), {int(v): i for i, v in enumerate(asked.column("vec_id").to_numpy())}
        while width < total:
            got = np.zeros(len(want), np.int64)
            for r in counted(some, shards, least, width).collect():  # a row for each audited vector
                got[place[r["a"]]] = r["b"]
            if met(got, want):
                break
            width *= 2
    joined_inside(spark, shards, least, width)
    links = store.saved(found(reps.repartition(min(-(-total // QUERIES), 1 << 16), "vec_id"), shards, least, width), folder, "links")
    for name in ("raw-", "unit-", "near"):
        store.drop(folder, name)
    cc = components(links.where(F.col("kind") == JOIN).select("a", "b"), folder)
    own = counts(links).join(cc.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    of = reps.select("k1", "k2", F.col("vec_id").alias("rep"), "times").join(own, "rep").select("k1", "k2", (F.col("n") + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    full = kept.select("vec_id", *key).join(of, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return full.unionByName(alone(rows.where(~fine)))
