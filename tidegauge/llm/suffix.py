"""Removal of byte strings that an earlier document holds too, by suffix arrays.

Three passes over the texts, none of which moves them:

1. Every ``length``-byte window has an anchor, the least hash among its k-mers, so equal windows have
   equal anchors. The anchors that two documents share are found by their hashes (a lossless filter).
2. The text around each shared anchor (all windows it anchors) goes to the bucket of its hash, in blocks
   that tasks gather over many slices, as rows from tasks to buckets grow with the product of both. A bucket's
   shards come one after another: each sorts the suffixes of its distinct passages by Larsson-Sadakane refinement,
   finds common prefixes by Kasai's rule, in lock step over all passages, and takes the smallest doc_id of each
   class of equal windows. A shard over ``SHARD`` bytes is sorted in parts, whose classes meet by hash and bytes. Equal
   passages that a task gathers are sent once, for its smallest doc_id: in the others each window is known to repeat.
3. The spans found are kept as sorted arrays in the shared folder, mapped by the tasks that cut the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store
from .flat import U

#: Bytes of passages whose suffixes are sorted at once.
SHARD = 1_500_000
#: Bytes of the documents' files for which there are two buckets of passages, and the shards of a bucket.
BYTES, FINER = 10 << 20, 4
#: Anchors, and bytes of passages, that a task gathers before it sends them.
GATHER, PASSAGES = 2 << 20, 8 << 20
#: Windows whose anchors are found at once; places in a block take under 28 bits.
WINDOWS = 4 << 20


def anchors(u8: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: its hash, the run's text, first window's start, number of windows."""
    k, parts = max(1, length * 2 // 5), []
    for a in range(0, max(1, len(u8) - length + 1), WINDOWS):  # a run that crosses blocks becomes two
        u, lo = u8[a : a + WINDOWS + length - 1], np.searchsorted(off, a, "right") - 1
        hi = int(np.searchsorted(off, a + len(u), "left"))
        own = np.clip(off[lo : hi + 1] - a, 0, len(u))
        starts = flat.ragged(own[:-1], np.maximum(0, np.diff(own) - length + 1))
        if not len(starts):
            continue
        h = flat.rolling(u, k)
        at = np.arange(len(h))
        least = (h & U(0xFFFFFFFFF0000000)) | at.astype(np.uint64)  # leftmost of equals
        span, width = length - k + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least[starts] & U(0xFFFFFFF)).astype(np.int64)
        text = np.searchsorted(own, starts, "right") - 1
        head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        parts.append((flat.mix(h[place[head]]) & ~U(1), text[head] + lo, starts[head] + a, np.diff(np.r_[head, len(starts)])))
    if not parts:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def shared_anchors(docs: DataFrame, folder: str, length: int, shards: int) -> store.Lookup:
    """The hashes of anchors that at least two rows hold."""
    found = store.Lookup(folder, "anchors", shards, {})

    def gather(batches):
        held, n = [], 0

        def send():
            every = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.r_[True, (every[1:] | U(1)) != (every[:-1] | U(1))])
            every = every[new] | np.bitwise_or.reduceat(every & U(1), new) | (np.diff(np.r_[new, len(every)]) > 1).astype(np.uint64)
            cut = np.searchsorted(found.of(every), np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([every[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())], ["shard", "hashes"])

        for _, u8, off in flat.slices(batches):
            h, text, _, _ = anchors(u8, off, length)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            one = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]  # once for each row
            if len(h):
                held.append(h[one])
                n += len(held[-1])
            if n > GATHER:
                yield send()
                held, n = [], 0
        if held:
            yield send()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        every = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]]))
        head = np.flatnonzero(np.r_[True, (every[1:] | U(1)) != (every[:-1] | U(1))])
        many = (np.diff(np.r_[head, len(every)]) > 1) | (np.bitwise_or.reduceat(every & U(1), head) > 0)
        found.write(s, every[head[many]] & ~U(1))
        return pd.DataFrame({"shard": [s], "n": [int(many.sum())]})

    docs.select("text").mapInArrow(gather, "shard int, hashes binary").groupBy("shard").applyInPandas(merge, "shard int, n long").write.mode("overwrite").parquet(f"{folder}/anchors")
    found.sealed({r["shard"]: r["n"] for r in docs.sparkSession.read.parquet(f"{folder}/anchors").collect()})  # a row for each shard
    return found


def sorted_suffixes(u8: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` bytes, and each one's rank: the first place of its class.

    Larsson-Sadakane: sorted by 8 bytes first, then only the classes that still have several members
    are refined, by the rank of the suffix as far ahead as is sorted already.
    """
    n = len(u8)
    pad = np.zeros(n + 8, np.uint8)
    pad[:n] = u8
    depth = min(8, length)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = (key << U(8)) | pad[i : n + i]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.r_[True, key[1:] != key[:-1]][:n]
    rank = np.zeros(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while depth < length:
        ahead = min(depth, length - depth)
        single = head & np.r_[head[1:], True]
        todo = np.flatnonzero(~single)
        if not len(todo):
            break
        sub = sa[todo]
        nxt = np.where(sub + ahead < n, rank[np.minimum(sub + ahead, n - 1)] + 1, 0)
        key = (rank[sub].astype(np.uint64) << U(32)) | nxt.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        sa[todo], head[todo] = sub, new
        rank[sub] = np.maximum.accumulate(np.where(new, todo, 0))
        depth += ahead
    return sa, rank


def common_prefixes(u8: np.ndarray, off: np.ndarray, sa: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the bytes, ``length`` at most, that it shares with the one before it in ``sa``.

    Kasai's rule (a suffix shares at least one byte less than the suffix one to its left), applied to
    all passages in lock step. As in the sort, a passage's end does not end its suffixes; the text's end
    does. Suffixes of one class share all ``length`` bytes, and as their order is arbitrary the rule
    says nothing about the suffixes to their right.
    """
    n = len(u8)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    lcp, live, start, size = np.zeros(n, np.int64), np.zeros(len(off) - 1, np.int64), off[:-1], np.diff(off)
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        i = start[on] + t
        j = before[i]
        h = np.where((j < 0) | (live[on] == length), 0, np.maximum(live[on] - 1, 0))
        h[(j >= 0) & (rank[i] == rank[j])] = length
        most = np.where(j < 0, 0, np.minimum(n - np.maximum(i, j), length))
        grow = np.flatnonzero(h < most)
        while len(grow):
            same = u8[i[grow] + h[grow]] == u8[j[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most[grow]]
        live[on] = lcp[i] = np.minimum(h, most)
    return lcp


def classes(u8: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the passages the number of its class of equal windows; for each class, in sorted order, one start and the smallest ``doc`` of its passages."""
    sa, rank = sorted_suffixes(u8, length)
    lcp = common_prefixes(u8, off, sa, rank, length)
    new = lcp[sa] < length
    whole = np.repeat(off[1:], np.diff(off)) - np.arange(len(u8)) >= length
    inside = whole[sa]
    number = np.cumsum(new)[inside]
    sa = sa[inside]
    if not len(sa):
        return np.zeros(0, np.int64), sa, np.zeros(0, np.int64)
    new = np.r_[True, number[1:] != number[:-1]]
    of = np.full(len(u8), -1, np.int64)
    of[sa] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return of[whole], sa[head], np.minimum.reduceat(np.repeat(doc, np.diff(off))[sa], head)


def smallest(u8: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For every window of all passages, in order, the smallest doc that holds it; in parts of ``SHARD`` bytes, whose classes meet in ranges of hashes, so time grows as the parts do."""
    parts, a = [], 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SHARD, "right")) - 1)
        text = u8[off[a] : off[b]]
        parts.append((text, *classes(text, off[a : b + 1] - off[a], doc[a:b], length)))
        a = b
    strings = lambda text, at: np.lib.stride_tricks.sliding_window_view(text, length)[at].view(f"S{length}").ravel()
    if len(parts) > 1:
        hashed = [flat.rolling(text, length)[at] if len(at) else np.zeros(0, np.uint64) for text, _, at, _ in parts]
        home = [store.shard_of(h, len(parts)) for h in hashed]
        order = [np.argsort(x, kind="stable") for x in home]
        cut = [np.searchsorted(x[o], np.arange(len(parts) + 1)) for x, o in zip(home, order)]
        for r in range(len(parts)):  # equal windows have equal hashes, so they meet in one range of these
            own = [o[c[r] : c[r + 1]] for o, c in zip(order, cut)]
            h, keys = np.concatenate([x[o] for x, o in zip(hashed, own)]), np.concatenate([strings(p[0], p[2][o]) for p, o in zip(parts, own) if len(o)] or [np.zeros(0, f"S{length}")])
            by = np.argsort(h)
            if ((h[by][1:] == h[by][:-1]) & (keys[by][1:] != keys[by][:-1])).any():  # equal hashes of other bytes
                by = np.lexsort((keys, h))
            head = np.flatnonzero(np.r_[True, keys[by][1:] != keys[by][:-1]][: len(by)])
            if not len(head):
                continue
            low = np.concatenate([p[3][o] for p, o in zip(parts, own)])
            low[by] = np.repeat(np.minimum.reduceat(low[by], head), np.diff(np.r_[head, len(by)]))
            for p, o, x in zip(parts, own, np.split(low, np.cumsum([len(o) for o in own])[:-1])):
                p[3][o] = x
    return np.concatenate([low[of] for _, of, _, low in parts]) if parts else np.zeros(0, np.int64)


def found_spans(docs: DataFrame, anchors_: store.Lookup, length: int, buckets: int, homes: int) -> DataFrame:
    """Rows (home, docs, starts, ends) of spans to remove, as arrays; spans may overlap."""
    columns = "shard int, docs binary, starts binary, wins binary, bytes binary, counts binary"

    def passages(batches):
        held, n = [], 0

        def send():
            h, doc, at, wins, u8 = (np.concatenate(x) for x in zip(*held))
            size = wins + length - 1
            start = np.r_[0, np.cumsum(size)]
            same = flat.equals(u8, start[:-1], start[1:])[1]
            order = np.lexsort((doc, same))
            head = np.r_[True, same[order][1:] != same[order][:-1]]
            first = np.empty(len(order), np.int64)
            first[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            here = doc > first  # the same passage stands in a smaller document that was gathered
            yield from packed(doc[here], at[here], at[here] + size[here])
            own = np.flatnonzero(~here)
            own = own[np.argsort(h[own], kind="stable")]
            cut = np.searchsorted(store.shard_of(h[own], FINER * buckets), np.arange(FINER * buckets + 1))
            full = np.flatnonzero(np.diff(cut[::FINER]))
            own = [(own[cut[FINER * b] : cut[FINER * b + FINER]], np.diff(cut[FINER * b : FINER * b + FINER + 1])) for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32))]
                + [pa.array(x, pa.binary()) for x in ([doc[o].tobytes() for o, _ in own], [at[o].tobytes() for o, _ in own], [wins[o].astype(np.int32).tobytes() for o, _ in own], [u8[flat.ragged(start[o], size[o])].tobytes() for o, _ in own], [c.astype(np.int32).tobytes() for _, c in own])],
                columns.replace(" int", "").replace(" binary", "").split(", "),
            )

        for rows, u8, off in flat.slices(batches):
            doc = rows.column("doc_id").cast(pa.int64())
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            h, text, start, wins = anchors(u8, off, length)
            uniq, back = np.unique(h, return_inverse=True)
            keep = np.flatnonzero(anchors_.find(uniq)[0][back] & known[text])
            if not len(keep):
                continue
            h, text, start, wins = h[keep], text[keep], start[keep], wins[keep]
            held.append((h, doc[text], start - off[text], wins, u8[flat.ragged(start, wins + length - 1)]))
            n += len(held[-1][4])
            if n >= PASSAGES:
                yield from send()
                held, n = [], 0
        if held:
            yield from send()

    def packed(doc, starts, ends):
        """Spans as rows, a row for each home of documents; they pass the shards with the number -1 - home."""
        home = store.shard_of(flat.mix(doc.astype(np.int64).view(np.uint64)), homes)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(homes + 1))
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            own = [order[cut[s] : cut[s + 1]] for s in full]
            yield pa.RecordBatch.from_arrays([pa.array((-1 - full).astype(np.int32))] + [pa.array([x[o].astype(np.int64).tobytes() for o in own], pa.binary()) for x in (doc, starts, ends)] + [pa.array([b""] * len(full), pa.binary())] * 2, columns.replace(" int", "").replace(" binary", "").split(", "))

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["shard"].iloc[0] < 0:
            return pdf.rename(columns={"wins": "ends"})[["shard", "docs", "starts", "ends"]]
        doc, start = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("docs", "starts"))
        wins = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["wins"]]).astype(np.int64)
        shard = np.concatenate([np.repeat(np.arange(FINER), np.frombuffer(x, np.int32)) for x in pdf["counts"]])
        u8 = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
        pdf = None
        size = wins + length - 1
        off, found = np.cumsum(size) - size, []
        for s in range(FINER):
            own = np.flatnonzero(shard == s)
            if len(own):
                which, first, last = runs(doc[own], wins[own], u8[flat.ragged(off[own], size[own])])
                found.append((doc[own[which]], start[own[which]] + first, start[own[which]] + last))
                flat.trim()
        u8 = None
        out = [x.to_pandas() for x in packed(*(np.concatenate(x) for x in zip(*found)))] if found else []
        return pd.concat(out).rename(columns={"wins": "ends"})[["shard", "docs", "starts", "ends"]] if out else pd.DataFrame({"shard": pd.Series(dtype="int32"), "docs": [], "starts": [], "ends": []})

    def runs(doc, wins, u8):
        """Runs of windows that a smaller document holds: the passage, the first byte in it, and the end."""
        size = wins + length - 1
        off = np.r_[0, np.cumsum(size)]
        one, back = flat.equals(u8, off[:-1], off[1:])
        low = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(low, back, doc)
        own = np.r_[0, np.cumsum(size[one])]
        least = smallest(u8[flat.ragged(off[one], size[one])], own, low, length)
        at = np.r_[0, np.cumsum(wins[one])][:-1]
        gone = least[flat.ragged(at[back], wins)] < np.repeat(doc, wins)
        edge = np.zeros(len(gone) + 1, bool)
        edge[np.r_[0, np.cumsum(wins)]] = True
        first = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
        last = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False]))
        which = np.repeat(np.arange(len(wins)), wins)[first]
        base = np.r_[0, np.cumsum(wins)][which]
        return which, first - base, last - base + length

    sent = docs.select("doc_id", "text").mapInArrow(passages, columns)
    return sent.groupBy("shard").applyInPandas(repeats, "shard int, docs binary, starts binary, ends binary")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by document and start, those that meet or overlap as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + group * (1 << 40))
    new = np.r_[True, (start + group * (1 << 40))[1:] > reach[:-1]]
    head = np.flatnonzero(new)
    return doc[head], start[head], (reach - group * (1 << 40))[np.r_[head[1:], len(doc)] - 1]


class Spans:
    """The spans to remove, by document."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.by = folder, store.Lookup(folder, "spans", shards, {"first": "i8", "n": "i8"})
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def write(self, s: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> int:
        """Returns how many documents have spans."""
        key = flat.mix(doc.view(np.uint64))
        order = np.lexsort((start, key))
        key = key[order]
        store.put(self.folder, f"starts-{s}", start[order])
        store.put(self.folder, f"ends-{s}", end[order])
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.by.write(s, key[head], first=head, n=np.diff(np.r_[head, len(key)]))
        return len(head)

    def of(self, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        key, back = np.unique(flat.mix(doc.view(np.uint64)), return_inverse=True)
        _, v = self.by.find(key)
        out = []
        for i in back:
            s = int(self.by.of(key[i : i + 1])[0])
            if not v["n"][i]:
                out.append((np.zeros(0, np.int64),) * 2)
                continue
            if s not in self.open:
                self.open[s] = store.mapped(self.folder, f"starts-{s}", np.int64), store.mapped(self.folder, f"ends-{s}", np.int64)
            a, b = v["first"][i], v["first"][i] + v["n"][i]
            out.append((np.array(self.open[s][0][a:b]), np.array(self.open[s][1][a:b])))
        return out


def repeated_spans(docs: DataFrame, length: int) -> Spans:
    """The maximal runs of bytes, by document, that ``length``-byte strings of smaller doc_ids cover."""
    spark = docs.sparkSession
    folder = store.shared_dir(spark, "suffix")
    parts = store.parts_for(docs, BYTES)
    homes = -(-parts // 4)  # a bucket sends a row to each home at most
    spans = Spans(folder, homes)
    found = found_spans(docs, shared_anchors(docs, folder, length, parts), length, 2 * parts, homes)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        s = -1 - int(pdf["shard"].iloc[0])
        n = spans.write(s, *merged(*(np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("docs", "starts", "ends"))))
        return pd.DataFrame({"home": [s], "docs": [n]})

    found.groupBy("shard").applyInPandas(keep, "home int, docs long").write.mode("overwrite").parquet(f"{folder}/homes")
    spans.by.sealed({r["home"]: r["docs"] for r in spark.read.parquet(f"{folder}/homes").collect()})  # a row for each home
    store.drop(folder, "anchors")
    return spans


def cuts(batches, spans: Spans, text: str = "text"):
    """For each row of each batch: the batch, and per row its bytes, span starts, span ends and the bytes kept."""
    for rows, u8, off in flat.slices(batches, text=text):
        doc = rows.column("doc_id").cast(pa.int64())
        known = doc.is_valid().to_numpy(zero_copy_only=False)
        out = []
        for i, (s, e) in enumerate(spans.of(doc.fill_null(0).to_numpy())):
            own = u8[off[i] : off[i + 1]]
            if not known[i] or not len(s):
                out.append((len(own), 0, 0, own))
                continue
            drop = np.zeros(len(own) + 1, np.int8)
            drop[s] += 1
            drop[e] -= 1
            kept = own[np.cumsum(drop[:-1], dtype=np.int8) == 0]
            out.append((len(own), len(own) - len(kept), len(s), kept))
        yield rows, out


def dedup_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) after the removal of repeated bytes.

    A null text counts as empty; a null doc_id is never a source and loses nothing. Rows with one
    doc_id are one document for the rule: none repeats the other. Other columns are ignored; an empty
    table gives no rows.
    """
    spans = repeated_spans(docs.where("doc_id is not null"), length)

    def digest(batches):
        for rows, out in cuts(batches, spans):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64())] + [pa.array([x[c] for x in out], pa.int64()) for c in range(3)] + [pa.array([hashlib.sha256(x[3]).hexdigest() for x in out])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_text(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with each text's repeated bytes removed; all other columns stay.

    Bytes of a character that was cut in two are dropped with it. Null texts stay null; for other cases see ``dedup_digests``.
    """
    spans = repeated_spans(docs.where("doc_id is not null"), length)

    def cut(batches):
        for rows, out in cuts(batches, spans):
            at = rows.schema.get_field_index("text")
            texts = [x[3].tobytes().decode("utf-8", "ignore") for x in out]
            null = rows.column(at).is_null().to_pylist()
            yield rows.set_column(at, rows.schema.field(at), pa.array([None if z else t for t, z in zip(texts, null)], rows.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)
