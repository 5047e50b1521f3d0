"""Whole batches of texts as flat byte arrays: words and their 64-bit hashes without a Python loop per word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is worked on whole.
SLICE = 1_000_000
U = np.uint64


def trim() -> None:
    """Gives freed memory back: a worker lives on after its task, beside others that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_ODD = 0x9E3779B97F4A7C15
#: Fixed values: \x20 and \x09-\x0D part words.
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Spans over so many bytes are hashed one by one, the others eight bytes of all of them at a time.
LONG = 512
#: Masks of a word's first bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd constant modulo 2**64, and those of its inverse."""
    if len(_pow[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _pow[i] = np.cumprod(p)
    return _pow[0][:n], _pow[1][:n]


def column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(name).cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` (large_binary without nulls), and where each text starts, then the end."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    u8 = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return u8, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (one row at least): the rows, their bytes, their offsets."""
    for batch in batches:
        texts = column(batch, text)
        u8, off = flat(texts)
        a, n = 0, len(texts)
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), u8[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b
    texts = u8 = off = batch = None
    trim()


def pooled(batches: Iterator[pa.RecordBatch], limit: int = SLICE, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """As ``slices``, but the last run of a batch goes on in the next one: what a run costs besides its bytes is paid less often."""

    def joined():
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column(text).nbytes
            if n > limit:
                rows = pa.concat_batches(held)
                off = flat(column(rows, text))[1]
                cut = 0  # where the last whole run ends
                while off[-1] - off[cut] > limit:
                    cut = max(cut + 1, int(np.searchsorted(off, off[cut] + limit, "right")) - 1)
                if cut:
                    yield rows.slice(0, cut)
                held, n = [rows.slice(cut)] * (cut < len(rows)), int(off[-1] - off[cut])
        if held:
            yield pa.concat_batches(held)

    return slices(joined(), limit, text)


def spans(u8: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses texts."""
    word = ~_SEP[u8]
    edge = off[(off > 0) & (off < len(u8))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every span of bytes, A-Z as a-z if ``lower``; other lanes give independent ones, so two make 128 bits.

    Every eight bytes go through a bijection that is no polynomial, so texts that are alike by construction
    (Thue-Morse words, say) do not meet.
    """
    size = ends - starts
    acc = mix(size.astype(np.uint64) * U(_ODD) + U(0x2545F4914F6CDD1D * (lane + 1) & (1 << 64) - 1))
    if not len(starts):
        return acc
    raw = np.zeros(len(u8) + 8, np.uint8)
    raw[: len(u8)] = _LOWER[u8] if lower else u8
    eight = np.ndarray((len(u8) + 1,), "<u8", raw.data, strides=(1,))
    on, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(on):
        left = size[on] - at
        piece = eight[starts[on] + at]
        tail = left < 8
        piece[tail] &= (U(1) << (left[tail] * 8).astype(np.uint64)) - U(1)
        acc[on] = mix((acc[on] ^ mix(piece + U(lane))) * U(0xD6E8FEB86659FD93) + U(at + 1))
        at += 8
        on = on[left > 8]
    for i in np.flatnonzero(size > LONG):
        acc[i] = U(int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little"))
    return acc


def ranked(key: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, equal ones as they stand: keys and places are sorted as one number, as values sort several times faster than places.

    Where both do not fit, the keys' low bits give way, and what these would part is sorted again.
    """
    key, bits = key.astype(np.uint64, copy=False), U(max(1, len(key).bit_length()))
    short = not len(key) or int(key.max()) >> 64 - int(bits) == 0
    packed = key << bits if short else key >> bits << bits
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((U(1) << bits) - U(1))).astype(np.int64)
    if short:
        return order
    now = key[order]
    wrong = np.flatnonzero(now[1:] < now[:-1])
    if len(wrong) > len(key) >> 6:  # no hashes
        return np.argsort(key, kind="stable")
    if len(wrong):
        top = packed >> bits
        lo = np.unique(np.searchsorted(top, top[wrong]))
        at = ragged(lo, np.searchsorted(top, top[lo], "right") - lo)
        order[at] = order[at[np.lexsort((now[at], top[at]))]]
    return order


def alike(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``equals`` of lower-cased spans, in another order, and quicker where most have eight bytes at most: a product parts them, and the bytes are compared."""
    size = ends - starts
    if (far := size > LONG).any():
        (one, own), (long, other) = (f(u8, starts[on], ends[on]) for f, on in ((alike, ~far), (lambda *x: equals(*x, True), far)))
        of = np.empty(len(size), np.int64)
        of[~far], of[far] = own, len(one) + other
        return np.r_[np.flatnonzero(~far)[one], np.flatnonzero(far)[long]], of
    raw = np.zeros(len(u8) + 8, np.uint8)
    raw[: len(u8)] = _LOWER[u8]
    eight = np.ndarray((len(u8) + 1,), "<u8", raw.data, strides=(1,))

    def piece(of: np.ndarray, at: int) -> np.ndarray:
        return eight[starts[of] + at] & _FIRST[np.minimum(size[of] - at, 8)]

    first = eight[starts] & _FIRST[np.minimum(size, 8)]
    key = (first ^ size.astype(np.uint64) * U(0xD6E8FEB86659FD93)) * U(_ODD)
    key ^= key >> U(32)
    key *= U(0x94D049BB133111EB)
    rest, at, on = [], 8, np.flatnonzero(size > 8)
    while len(on):
        rest.append((on, piece(on, at)))
        k = (key[on] ^ rest[-1][1]) * U(_ODD)
        key[on] = (k ^ k >> U(32)) * U(0x94D049BB133111EB)
        at += 8
        on = on[size[on] > at]
    order = ranked(key)
    new = np.ones(len(order), bool)
    new[1:] = (now := key[order])[1:] != now[:-1]
    one, of = order[new], np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    by = one[of]
    same = (first == first[by]).all() and (size == size[by]).all()
    for i, (on, own) in enumerate(rest):
        same = same and (own == piece(by[on], 8 + 8 * i)).all()
    return (one, of) if same else equals(u8, starts, ends, True)


def rolling(u8: np.ndarray, k: int) -> np.ndarray:
    """A quick hash of every ``k`` bytes in a row: a filter only, as unequal strings of equal hash can be constructed."""
    p, inv = powers(len(u8) + 1)
    sums = np.zeros(len(u8) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64) * U(_ODD))[u8] * p[:-1], out=sums[1:])
    n = len(u8) - k + 1
    return mix((sums[k:] - sums[:n]) * inv[:n])


def equals(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` of the spans' bytes: where each distinct one occurs first, and each span's number among these. Exact: bytes are compared."""
    h = hashes(u8, starts, ends, lower)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    size, text = ends - starts, _LOWER[u8] if lower else u8
    check = np.flatnonzero(one[of] != np.arange(len(of)))
    wrong = size[check] != size[one[of[check]]]
    at, n = 0, np.cumsum(size[check])
    while at < len(check):  # some bytes at a time
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + (1 << 22), "right")))
        own = check[at:to][~wrong[at:to]]
        if len(own):
            same = text[ragged(starts[own], size[own])] == text[ragged(starts[one[of[own]]], size[own])]
            full = size[own] > 0
            bad = np.zeros(len(own), bool)
            bad[full] = ~np.logical_and.reduceat(same, np.r_[0, np.cumsum(size[own][full])][:-1]) if full.any() else False
            wrong[np.flatnonzero(~wrong[at:to]) + at] = bad
        at = to
    if wrong.any():  # equal hashes of other bytes: these are told apart one by one
        seen: dict[bytes, int] = {}
        more = []
        for i in check[wrong].tolist():
            key = text[starts[i] : ends[i]].tobytes()
            if key not in seen:
                seen[key] = len(one) + len(more)
                more.append(i)
            of[i] = seen[key]
        one = np.r_[one, more]
    return one, of


def words(u8: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and for each text the index of its first word, then the end."""
    starts, ends = spans(u8, off)
    return hashes(u8, starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words (of every start, whatever text it is in)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = mix(acc * U(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
    return mix(acc + U(k))


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingles; with fewer words the whole sequence as one."""
    s = shingles(h, k)
    for a, b in zip(at[:-1], at[1:]):
        yield np.unique(s[a : b - k + 1]) if b - a >= k else shingles(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
