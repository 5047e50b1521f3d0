"""Packing of documents into token sequences by Karmarkar-Karp multiway differencing.

A task tokenizes its documents. Whole windows of a document are sequences of their own; what is left of
each is cut into near-equal pieces, and a group of pieces is dealt over as many windows as its tokens
need: the two partial partitions with the largest imbalance are merged again and again, the
fullest window of one with the emptiest of the other. If a window is over capacity in the end,
the group gets one window more. No rows move between tasks, so no key can be hot; a task's last
group may leave part of one window unfilled. A sequence's id has the task's number in its upper bits.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import flat

#: Pieces of leftover tokens that are dealt over windows at once, and the most tokens of such a piece.
GROUP, PIECE = 1024, 256


@lru_cache(4)
def encoding(path: str | None):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken from the same vocabulary (ids are equal)."""
    import json

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """For each piece its window, of ``m``, by multiway differencing of the sizes."""
    if m == 1:
        return np.zeros(len(sizes), np.int64)
    heap, left, right = [], [], []
    for i, s in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    n = len(sizes)
    made = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, k, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        nodes = np.maximum(x, y)
        left.append(x[both]), right.append(y[both])
        nodes[both] = made + np.arange(len(both))
        made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), k, sums, nodes[order]))
    label = np.full(made, -1, np.int64)
    top = heap[0][3]
    label[top[top >= 0]] = np.flatnonzero(top >= 0)
    l, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    for i in range(made - n - 1, -1, -1):
        label[l[i]] = label[r[i]] = label[n + i]
    return label[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """For each piece its window; no window is over capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        label = differencing(sizes, m)
        if np.bincount(label, weights=sizes).max() <= capacity:
            return label
        m += 1


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end: int = 0) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece of a document.

    A null text counts as empty: its one token is the end id. Repeated rows and null doc_ids are
    documents like others, other columns are ignored, an empty table gives no rows.
    """
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        enc, base, seq, rest = encoding(path), TaskContext.get().partitionId() << 40, 0, []

        def batch(rows):
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in columns.split(", ")])

        def dealt(pieces):
            nonlocal seq
            label = windows(np.array([p[2] for p in pieces]), capacity)
            _, label = np.unique(label, return_inverse=True)
            at, out = [0] * (label.max() + 1), []
            for p, w in zip(pieces, label.tolist()):
                out.append((*p, base + seq + w, at[w]))
                at[w] += p[2]
            seq += len(at)
            return out

        for rows, _, _ in flat.slices(batches):
            out = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), flat.column(rows).cast(pa.large_string()).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), end).astype("<u4")
                n = len(ids)
                whole = n - n % capacity
                for s in range(0, whole, capacity):
                    out.append((doc, s, capacity, zlib.crc32(ids[s : s + capacity]), n, base + seq, 0))
                    seq += 1
                k = -(-(n - whole) // min(PIECE, capacity))
                cut = [whole + (n - whole) * i // k for i in range(k + 1)] if k else []
                rest += [(doc, s, e - s, zlib.crc32(ids[s:e]), n) for s, e in zip(cut, cut[1:])]
                while len(rest) >= GROUP:
                    out += dealt(rest[:GROUP])
                    rest = rest[GROUP:]
            if out:
                yield batch(out)
        if rest:
            yield batch(dealt(rest))

    return docs.select("doc_id", "text").mapInArrow(run, columns)
