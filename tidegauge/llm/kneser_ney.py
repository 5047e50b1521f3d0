"""Interpolated modified Kneser-Ney n-gram models, counted in Spark and stored as sorted hash arrays.

Three jobs, each of which sends compressed, sorted blocks that tasks have added up before:

1. Tasks count words (128-bit hashes). Shards add up and store them; a word's id is its place in an order by falling
   count (powers of two), shard and hash, so frequent words have small ids and blocks compress.
2. Tasks count n-grams of ids and send them to the shard of their last two words. A shard stores them as a trie read backwards:
   sorted pairs of last words, below each the words before, and so on. How many children a node has is the
   count of its n-gram for the model: in how many contexts it occurs.
3. Tasks read the shards' tries and send sums for each context, and for each word before how many it stands;
   contexts with a single occurrence need no entry, as the trie says that they exist.

Scoring tasks map the arrays into memory and look up each distinct n-gram of a slice of texts once. All counts cover all training
texts. Words and n-grams are told apart exactly (contexts of over two words by 64-bit hashes).
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .flat import U, mix

#: Tokens (contexts) that a task counts (gathers) before it sends; bytes of text that are scored at once.
GATHER, SLICE = 2_000_000, 8_000_000
#: Bytes of the documents' files for which there is a shard of each table: a slice looks into all shards, so these are not small.
BYTES = 10 << 20
#: The end of a text as a word, in two hashes; the ids of what stands before a text, and of a word that is not known.
END = U(0x14057B7EF767814F), U(0x5851F42D4C957F2D)
BEGIN, UNKNOWN = 0, 0xFFFFFFFF


def fold(words: list[np.ndarray]) -> np.ndarray:
    """A key for each sequence of ids: exact for two at most, then a hash."""
    acc = words[0].astype(np.uint64)
    for i, w in enumerate(words[1:]):
        acc = (mix(acc) * U(0x9FB21C651E98DF25) if i else acc << U(32)) + w.astype(np.uint64)
    return mix(acc)


def tokens(u8: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The distinct words as two hashes, each token's place among them (a text's words, then its end), and where each text's tokens begin, then the end."""
    starts, ends = flat.spans(u8, off)
    at = np.searchsorted(starts, off)
    begin = at + np.arange(len(at))
    word = np.zeros(len(starts) + len(at) - 1, bool)
    word[np.arange(len(starts)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = True
    one, own = flat.alike(u8, starts, ends)
    size = ends[one] - starts[one]
    few, to = u8[flat.ragged(starts[one], size)], np.cumsum(size)
    pair = [np.append(flat.hashes(few, to - size, to, lane=lane), END[lane]) for lane in (0, 1)]
    order = flat.ranked(pair[0])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = np.full(len(word), place[-1])
    of[word] = place[own]
    return (pair[0][order], pair[1][order]), of, begin


def grams(ids: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns: each token's ``order - 1`` predecessors in its text, or the begin sign, then the token."""
    place = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
    cols = [ids]
    for lag in range(1, order):
        prev = np.full(len(ids), BEGIN, ids.dtype)
        prev[lag:] = np.where(place[lag:] >= lag, ids[:-lag], BEGIN)
        cols.insert(0, prev)
    return cols


def heads(cols: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows of ``cols`` differ from the row before."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def numbered(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts rows of ``cols`` by a single number each, where a row's distinct ones begin in it, and each row's number among these."""
    key, width, room = cols[0].astype(np.uint64), int(cols[0].max(initial=0)).bit_length(), 64 - len(cols[0]).bit_length()
    for c in cols[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if width + bits > room:
            key = numbered([key])[2].astype(np.uint64)
            width = int(key.max(initial=0)).bit_length()
        if width + bits > 64:
            c = numbered([c])[2]
            bits = int(c.max(initial=0)).bit_length()
        key, width = key << U(bits) | c.astype(np.uint64), width + bits
    order = flat.ranked(key)
    head = heads([key[order]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    return order, np.flatnonzero(head), of


def summed(cols: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``cols``, sorted, with the sums of ``counts``."""
    order = flat.ranked(cols[0]) if len(cols) < 3 else numbered(cols)[0]
    if len(cols) == 2:  # of hashes the first mostly tells
        a, b = cols[0][order], cols[1][order]
        if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():
            order = numbered(cols)[0]
    cols = [c[order] for c in cols]
    head = np.flatnonzero(heads(cols))
    return [c[head] for c in cols], [np.add.reduceat(c[order], head) if len(head) else c for c in counts]


def distinct(names: list[np.ndarray], of: list[np.ndarray], begin: list[np.ndarray], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams as id columns, the last word first, sorted, and how often each occurs; of slices with each distinct word's id, each token's place among these, and where texts begin."""
    ids = np.sort(np.concatenate([np.array([BEGIN], np.uint32), *names]))
    ids = ids[heads([ids])]
    cols = [grams(np.searchsorted(ids, n).astype(np.uint32)[o], b, order)[::-1] for n, o, b in zip(names, of, begin)]  # places among the batch's own words, so that a row fits one number
    cols = [np.concatenate(c) for c in zip(*cols)]
    bits = max(1, int(len(ids)).bit_length())
    if bits * order > 64:
        rows, (n,) = summed(cols, [np.ones(len(cols[0]), np.int64)])
        return [ids[c] for c in rows], n
    key = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        key = (key << U(bits)) | c.astype(np.uint64)
    key.sort()
    head = np.flatnonzero(heads([key]))
    n, key = np.diff(np.r_[head, len(key)]), key[head]
    return [ids[((key >> U(bits * (order - 1 - i))) & U((1 << bits) - 1)).astype(np.int64)] for i in range(order)], n


def dealt(shard: np.ndarray) -> np.ndarray:
    """The order that sorts shards' numbers, equal ones as they stand: numbers of two bytes are sorted by counting."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


def blob(cols: list[np.ndarray], kinds: list[str]) -> bytes:
    """Columns, sorted by the first, as compressed planes of bytes, the first as differences."""
    planes = [np.diff(c.astype(k), prepend=np.array([0], k)) if i == 0 else c.astype(k) for i, (c, k) in enumerate(zip(cols, kinds))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in planes))


def unblob(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for i, k in enumerate(kinds):
        size = np.dtype(k).itemsize
        c = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel()
        out.append(np.cumsum(c, dtype=k) if i == 0 else c)
        at += n * size
    return out


def rows_of(shard: np.ndarray, shards: int, cols: list[np.ndarray], kinds: list[str], **fixed) -> pa.RecordBatch:
    """A row for each shard that gets something, with the block of its part of sorted columns."""
    order = dealt(shard)
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cut))
    data = [blob([c[order[cut[s] : cut[s + 1]]] for c in cols], kinds) for s in full]
    return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(full), v, np.int32)) for v in fixed.values()), pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], [*fixed, "shard", "data"])


def within(labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the place of ``want[i]`` in the sorted ``labels[lo[i]:hi[i]]``, and whether it is there."""
    lo, end = lo.astype(np.int64), hi.astype(np.int64)
    hi, on = end.copy(), np.flatnonzero(end > lo)
    while len(on):
        mid = (lo[on] + hi[on]) >> 1
        less = labels[mid] < want[on]
        lo[on[less]] = mid[less] + 1
        hi[on[~less]] = mid[~less]
        on = on[lo[on] < hi[on]]
    ok = lo < end
    ok[ok] = labels[lo[ok]] == want[ok]
    return lo, ok


def tallied(c: np.ndarray) -> list[int]:
    return [int(c.sum()), len(c), *(int((c == i).sum()) for i in (1, 2, 3, 4))]


def released(spark) -> None:
    """Lets Spark delete the shuffles of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Model:
    """Tables in the shared folder; ``levels`` has for each order the discounts and the numbers of n-grams, ``n`` and ``v`` count tokens and words."""

    def __init__(self, folder: str, order: int, parts: int):
        self.folder, self.order, self.parts = folder, order, parts
        self.words = store.Lookup(folder, "words", parts, {"check": "u8", "c": "u8", "id": "u4"})
        self.single = store.Lookup(folder, "single", parts, {"c": "u4"})
        self.contexts = {(k, big): store.Lookup(folder, f"contexts{k}{big}", parts, dict.fromkeys(("t", "n1", "n2", "n3"), "u8" if big else "u1")) for k in range(2, order + 1) for big in (0, 1)}
        self.sizes: dict[int, list[int]] = {}
        self._open: dict[int, dict] = {}
        self.n = self.v = 0
        self.levels: dict[int, tuple[np.ndarray, list[int]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    # Words.

    def count_words(self, docs: DataFrame) -> None:
        kinds = ["u8", "u8", "u4"]

        def run(batches):
            held, n = [], 0

            def send():
                (a, b), (c,) = summed([np.concatenate([h[i] for h in held]) for i in (0, 1)], [np.concatenate([h[2] for h in held])])
                return rows_of(store.shard_of(a, self.parts), self.parts, [a, b, c], kinds)

            for _, u8, off in flat.pooled(batches, SLICE):
                (a, b), of, _ = tokens(u8, off)
                held.append((a, b, np.bincount(of, minlength=len(a))))
                n += len(a)
                if n >= GATHER:
                    yield send()
                    held, n = [], 0
            if held:
                yield send()

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            s, parts = int(pdf["shard"].iloc[0]), [unblob(x, kinds) for x in pdf["data"]]
            (key, check), (c,) = summed([np.concatenate([p[i] for p in parts]) for i in (0, 1)], [np.concatenate([p[2] for p in parts]).astype(np.int64)])
            self.words.write(s, key, check=check, c=c)
            return pd.DataFrame({"shard": [s], "total": [int(c.sum())], "sizes": [np.bincount(self.rarity(c), minlength=64)]})

        docs.select("text").mapInArrow(run, "shard int, data binary").groupBy("shard").applyInPandas(merge, "shard int, total long, sizes array<long>").write.mode("overwrite").parquet(f"{self.folder}/counted")
        got = docs.sparkSession.read.parquet(f"{self.folder}/counted").collect()  # a row for each shard
        released(docs.sparkSession)
        sizes = {r["shard"]: np.array(r["sizes"]) for r in got}
        self.words.sealed({s: int(x.sum()) for s, x in sizes.items()})
        self.n, self.v = sum(r["total"] for r in got), sum(int(x.sum()) for x in sizes.values())
        if self.v >= UNKNOWN - 1:
            raise ValueError("more words than ids")
        full = sorted(sizes)
        table = np.array([sizes[s] for s in full]).reshape(-1, 64)
        first = dict(zip(full, (1 + np.r_[0, np.cumsum(table.T.ravel())][:-1].reshape(64, -1).T).tolist()))

        def name(batches):
            for rows in batches:
                for s in rows.column("shard").to_pylist():
                    rare = self.rarity(store.mapped(self.folder, f"words-{s}.c", "u8", self.words.sizes[s]))
                    order, ids = np.argsort(rare, kind="stable"), np.zeros(len(rare), np.uint32)
                    ids[order] = np.array(first[s])[rare[order]] + np.arange(len(rare)) - np.searchsorted(rare[order], rare[order])
                    store.put(self.folder, f"words-{s}.id", ids)
                yield rows

        if full:
            docs.sparkSession.createDataFrame([(s,) for s in full], "shard int").repartition(len(full), "shard").mapInArrow(name, "shard int").write.mode("overwrite").parquet(f"{self.folder}/named")

    @staticmethod
    def rarity(c: np.ndarray) -> np.ndarray:
        """63 less the count's power of two."""
        return (64 - np.frexp(c.astype(np.float64))[1]).astype(np.int64)

    def ids(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct words, sorted by key."""
        ids, counts = np.full(len(key), UNKNOWN, np.uint32), np.zeros(len(key), np.int64)
        cut = np.searchsorted(self.words.of(key), np.arange(self.parts + 1))
        for s in np.flatnonzero(np.diff(cut)):
            f, a, b = self.words.shard(int(s)), cut[s], cut[s + 1]
            at, todo = np.searchsorted(f["key"], key[a:b]), np.arange(b - a)
            while len(todo):
                todo = todo[at[todo] < len(f["key"])]
                todo = todo[f["key"][at[todo]] == key[a + todo]]
                ok = f["check"][at[todo]] == check[a + todo]
                ids[a + todo[ok]], counts[a + todo[ok]] = f["id"][at[todo[ok]]], f["c"][at[todo[ok]]]
                todo = todo[~ok]
                at[todo] += 1
        return ids, counts

    # N-grams.

    def count_grams(self, docs: DataFrame) -> None:
        kinds = ["u4"] * (self.order + 1)

        def run(batches):
            held, n = [], 0

            def send():
                cols, c = distinct(*map(list, zip(*held)), self.order)
                return rows_of(self.home(cols[0], cols[1]), self.parts, [*cols, c], kinds)

            for _, u8, off in flat.pooled(batches, SLICE):
                names, of, begin = tokens(u8, off)
                held.append((self.ids(*names)[0], of.astype(np.uint32), begin))
                n += len(of)
                if n >= GATHER:
                    yield send()
                    held, n = [], 0
            if held:
                yield send()

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            flat.trim()
            s, parts = int(pdf["shard"].iloc[0]), [unblob(x, kinds) for x in pdf["data"]]
            cols, (c,) = summed([np.concatenate([p[i] for p in parts]) for i in range(self.order)], [np.concatenate([p[self.order] for p in parts]).astype(np.int64)])
            cols[:2] = [cols[0].astype(np.uint64) << U(32) | cols[1]]
            parts, at = None, {k: np.flatnonzero(heads(cols[: k - 1])) for k in range(2, self.order)} | {self.order: np.arange(len(c))}
            store.put(self.folder, f"pair-{s}", cols[0][at[2]])
            stats, sizes = [], []
            for k in range(2, self.order + 1):
                if k > 2:
                    store.put(self.folder, f"label{k}-{s}", cols[k - 2][at[k]])
                if k < self.order:
                    first = np.searchsorted(at[k + 1], np.r_[at[k], len(c)])
                    store.put(self.folder, f"first{k}-{s}", first.astype(np.uint32))
                stats += tallied(c if k == self.order else np.diff(first))
                sizes.append(len(at[k]))
            many = np.flatnonzero(c > 255)
            store.put(self.folder, f"count-{s}", np.minimum(c, 255).astype(np.uint8))
            store.put(self.folder, f"many-{s}", many.astype(np.uint32))
            store.put(self.folder, f"much-{s}", c[many])
            return pd.DataFrame({"shard": [s], "sizes": [[*sizes, len(many)]], "stats": [stats]})

        docs.select("text").mapInArrow(run, "shard int, data binary").groupBy("shard").applyInPandas(merge, "shard int, sizes array<long>, stats array<long>").write.mode("overwrite").parquet(f"{self.folder}/stored")
        got = docs.sparkSession.read.parquet(f"{self.folder}/stored").collect()  # a row for each shard
        released(docs.sparkSession)
        self.sizes = {r["shard"]: list(r["sizes"]) for r in got}
        total = np.array([r["stats"] for r in got]).reshape(-1, self.order - 1, 6).sum(0)
        for k in range(2, self.order + 1):
            self.level(k, total[k - 2].tolist())

    def home(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return store.shard_of(mix(last.astype(np.uint64) << U(32) | before), self.parts)

    def level(self, k: int, stats: list[int]) -> None:
        _, types, n1, n2, n3, n4 = stats
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [(i - (i + 1) * y * b / a if a else i / 2) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        self.levels[k] = np.array([0.0, *(min(max(x, 0.1 * i), 0.9 * i) for i, x in enumerate(d, 1))]), [stats[0], n1, n2, types - n1 - n2]

    def trie(self, s: int) -> dict:
        if s not in self._open:
            n = dict(zip(range(2, self.order + 1), self.sizes[s]))
            f = {"pair": store.mapped(self.folder, f"pair-{s}", "u8", n[2]), "count": store.mapped(self.folder, f"count-{s}", "u1", n[self.order])}
            f |= {name: store.mapped(self.folder, f"{name}-{s}", t, self.sizes[s][-1]) for name, t in (("many", "u4"), ("much", "i8"))}
            f |= {f"label{k}": store.mapped(self.folder, f"label{k}-{s}", "u4", n[k]) for k in range(3, self.order + 1)}
            return store.keep(self, s, f | {f"first{k}": store.mapped(self.folder, f"first{k}-{s}", "u4", n[k] + 1) for k in range(2, self.order)})
        return self._open[s]

    def counts_at(self, f: dict, k: int, at: np.ndarray) -> np.ndarray:
        if k < self.order:
            return f[f"first{k}"][at + 1].astype(np.int64) - f[f"first{k}"][at]
        c = f["count"][at].astype(np.int64)
        if len(f["many"]):
            to = np.minimum(np.searchsorted(f["many"], at), len(f["many"]) - 1)
            c = np.where(f["many"][to] == at, f["much"][to], c)
        return c

    def find(self, pair: np.ndarray, shard: np.ndarray, below: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Counts (0: not there) of pairs, sorted by shard, and of the longer n-grams ``below``: the sorted place of each one's last words among those before, and the word before these."""
        out, cut = [np.zeros(len(x), np.int64) for x in (pair, *(up for up, _ in below))], [np.searchsorted(shard, np.arange(self.parts + 1))]
        for up, _ in below:
            cut.append(np.searchsorted(up, cut[-1]))
        for s in np.flatnonzero(np.diff(cut[0])):
            if int(s) not in self.sizes:
                continue
            f, a, b = self.trie(int(s)), cut[0][s], cut[0][s + 1]
            at = np.minimum(np.searchsorted(f["pair"], pair[a:b]), len(f["pair"]) - 1)
            ok = f["pair"][at] == pair[a:b]
            out[0][a:b][ok] = self.counts_at(f, 2, at[ok])
            for k, (up, word) in enumerate(below, 3):
                a, (b, c) = a, cut[k - 2][s : s + 2]
                own = up[b:c] - a
                own, on = own[ok[own]], np.flatnonzero(ok[own])
                first = f[f"first{k - 1}"]
                at, ok, found = np.zeros(c - b, np.int64), np.zeros(c - b, bool), at[own]
                at[on], ok[on] = within(f[f"label{k}"], first[found], first[found + 1], word[b:c][on])
                out[k - 2][b:c][ok] = self.counts_at(f, k, at[ok])
                a = b
        return out

    # Contexts.

    def count_contexts(self, spark) -> None:
        kinds = {k: ["u8", "u4" if k == 1 else "u8", *["u4"] * 3] if k > 1 else ["u8", "u4"] for k in range(1, self.order + 1)}

        def run(batches):
            held = {}

            def send():
                for k, parts in held.items():
                    (key,), sums = summed([np.concatenate([p[0] for p in parts])], [np.concatenate(x) for x in zip(*(p[1:] for p in parts))])
                    yield rows_of(store.shard_of(key, self.parts), self.parts, [key, *sums], kinds[k], kind=k)
                held.clear()

            for rows in batches:
                for s in rows.column("shard").to_pylist():
                    f = self.trie(s)
                    pair = np.array(f["pair"])
                    words, at = [pair & U(0xFFFFFFFF), pair >> U(32)], np.arange(len(pair))
                    head = np.flatnonzero(heads([words[1]]))
                    held.setdefault(1, []).append([fold([words[1][head]]), np.diff(np.r_[head, len(pair)])])
                    for k in range(2, self.order + 1):
                        if k > 2:
                            up = np.repeat(np.arange(len(at)), self.counts_at(f, k - 1, at))
                            words, at = [f[f"label{k}"], *(w[up] for w in words)], np.arange(len(up))
                        c = self.counts_at(f, k, at)
                        (key,), sums = summed([fold(words[:-1])], [c, *(x.astype(np.int64) for x in (c == 1, c == 2, c > 2))])
                        held.setdefault(k, []).append([key, *sums])
                    self._open.clear()
                    if sum(len(p[0]) for parts in held.values() for p in parts) > GATHER:
                        yield from send()
            yield from send()

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            flat.trim()
            k, s = int(pdf["kind"].iloc[0]), int(pdf["shard"].iloc[0])
            parts = [unblob(x, kinds[k]) for x in pdf["data"]]
            (key,), sums = summed([np.concatenate([p[0] for p in parts])], [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, len(kinds[k]))])
            if k == 1:
                self.single.write(s, key, c=sums[0])
                return pd.DataFrame({"kind": [1], "shard": [s], "sizes": [[len(key), 0]], "stats": [tallied(sums[0])]})
            start, sizes = fold([np.zeros(1, np.uint32)] * (k - 1))[0], []
            for big, own in ((0, (sums[0] < 256) & ((sums[0] > 1) | (key == start))), (1, sums[0] > 255)):
                self.contexts[k, big].write(s, key[own], **{name: x[own] for name, x in zip(("t", "n1", "n2", "n3"), sums)})
                sizes.append(int(own.sum()))
            return pd.DataFrame({"kind": [k], "shard": [s], "sizes": [sizes], "stats": [[0] * 6]})

        full = spark.createDataFrame([(s,) for s in sorted(self.sizes)], "shard int").repartition(max(1, len(self.sizes)), "shard")
        full.mapInArrow(run, "kind int, shard int, data binary").groupBy("kind", "shard").applyInPandas(merge, "kind int, shard int, sizes array<long>, stats array<long>").write.mode("overwrite").parquet(f"{self.folder}/contexts")
        got = spark.read.parquet(f"{self.folder}/contexts").collect()  # a row for each shard and level
        released(spark)
        self.single.sealed({r["shard"]: r["sizes"][0] for r in got if r["kind"] == 1})
        for (k, big), table in self.contexts.items():
            table.sealed({r["shard"]: r["sizes"][big] for r in got if r["kind"] == k})
        self.level(1, np.array([r["stats"] for r in got if r["kind"] == 1]).reshape(-1, 6).sum(0).tolist())

    def fit(self, docs: DataFrame) -> Model:
        self.count_words(docs)
        if self.order > 1 and self.n:
            self.count_grams(docs)
            self.count_contexts(docs.sparkSession)
        elif self.n:
            got = self.words_of(docs.sparkSession)
            self.level(1, got)
        return self

    def words_of(self, spark) -> list[int]:
        """Of a model of single words, the tallies of their counts."""

        def run(batches):
            for rows in batches:
                stats = [tallied(self.words.shard(s)["c"].astype(np.int64)) for s in rows.column("shard").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.int64()))], ["stats"])

        got = spark.createDataFrame([(s,) for s in sorted(self.words.sizes)], "shard int").mapInArrow(run, "stats array<long>").collect()  # a row for each shard
        return np.array([r["stats"] for r in got]).sum(0).tolist()

    def probabilities(self, u8: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's tokens begin, then the end; each token's count in training, and its probability after the tokens before it."""
        names, of, begin = tokens(u8, off)
        own, counts = self.ids(*names)
        count, even = counts[of], 1 / (self.v + 1)
        if not self.n:
            return begin, count, np.full(len(of), even)
        d, (total, n1, n2, n3) = self.levels[1]
        if self.order > 1:
            key, one, back = np.unique(fold([own]), return_index=True, return_inverse=True)
            counts = self.single.find(key)[1]["c"].astype(np.int64)[back]
        p = (counts - d[np.minimum(counts, 3)] + (d[1] * n1 + d[2] * n2 + d[3] * n3) * even) / total
        if self.order == 1:
            return begin, count, p[of]
        ids, place = np.unique(np.append(own, U(BEGIN).astype(np.uint32)), return_inverse=True)  # BEGIN is the first
        lower, c = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        lower[place[:-1]], c[place[:-1]] = p, counts
        token = place[of]
        before, of, words, start, todo = grams(token, begin, self.order)[::-1], token, [ids], BEGIN, []
        for k in range(2, self.order + 1):  # the distinct n-grams of the texts: each one's first token, words, and the number of its last words
            order, head, to = numbered([of, before[k - 1]])
            one = order[head]
            if k == 2:
                shard = self.home(ids[of[one]], ids[before[1][one]])
                by = dealt(shard)
                back = np.empty(len(by), np.int64)
                back[by] = np.arange(len(by))
                one, shard, to = one[by], shard[by], back[to]
            context = np.r_[0, of[:-1]]
            context[begin[:-1]] = start
            up, words = of[one], [ids[before[k - 1][one]], *(w[of[one]] for w in words)]
            todo.append((up, context[one], words))
            of, start = to, len(one)
        before = token = order = one = to = None
        found = self.find(todo[0][2][1].astype(np.uint64) << U(32) | todo[0][2][0], shard, [(up, words[0]) for up, _, words in todo[1:]])
        words = [ids]
        for k, (up, context, longer) in enumerate(todo, 2):
            key = fold(words) if k == 2 else np.append(fold(words), fold([np.full(1, BEGIN, np.uint32)] * (k - 1)))
            order = flat.ranked(key)
            x = {"t": np.ones(len(key)), "n1": np.ones(len(key)), "n2": np.zeros(len(key)), "n3": np.zeros(len(key))}  # where it is but has no entry, it stands once
            known = np.append(c, [0] * (k > 2)) > 0
            for big in (0, 1):
                hit, v = self.contexts[k, big].find(key[order])
                hit, at = np.flatnonzero(hit), order[hit]
                known[at] = True
                for name in x:
                    x[name][at] = v[name][hit]
            d, c = self.levels[k][0], found[k - 2]
            free = (d[1] * x["n1"] + d[2] * x["n2"] + d[3] * x["n3"]) / x["t"]
            lower, words = lower[up], longer
            lower = np.where(known[context], (c - d[np.minimum(c, 3)]) / x["t"][context] + free[context] * lower, lower)
        return begin, count, lower[of]


def train(docs: DataFrame, order: int) -> Model:
    """The model of all texts of ``docs``."""
    spark = docs.sparkSession
    return Model(store.shared_dir(spark, "kneser-ney"), order, store.parts_for(docs, BYTES)).fit(docs)


def score(docs: DataFrame, order: int, folds: int, held_out: int) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores in log10.

    The model and the base (add-one unigram) learn from the rows whose crc32(doc_id as text) modulo
    ``folds`` is not ``held_out``. A null text counts as empty: its one token is the end. Rows with
    a null doc_id are scored, not learned from, and their held_out is null. Repeated rows count and are
    scored each; other columns are ignored; without training rows every token has probability 1.
    """
    fold_of = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out
    model = train(docs.where(~fold_of), order)

    def run(batches):
        for rows, u8, off in flat.pooled(batches, SLICE):
            begin, c, p = model.probabilities(u8, off)
            base, n = np.log10((c + 1) / (model.n + model.v + 1)), len(off) - 1
            sums = [np.add.reduceat(x, begin[:-1]) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("held_out"), pa.array(np.diff(begin)), pa.array(sums[0]), pa.array(np.full(n, model.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "text", fold_of.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
