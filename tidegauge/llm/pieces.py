"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a slice of texts lie as flat arrays of symbols. In each round the least rank
among a word's pairs is found by segments, the leftmost such pair of every word is merged at once
(all its leftmost occurrences, where no piece made of the merged one ranks before it), and the arrays are
compacted; words without pairs leave. Words are runs of U+2581 with what follows them up to the next:
no piece of the vocabulary holds U+2581 after another character, so words never merge with each other.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import flat

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Words that a worker remembers from slice to slice, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
_NONE = np.iinfo(np.int32).max
codecs.register_error("tidegauge-each", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Tables of a BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(text) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds U+2581 after another character")
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        score = {p: m.get_score(i) for p, i in self.ids.items()}
        pairs, hurried = {}, set()
        self.within = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        order = {p: r for r, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -score[p]))}
        chars = {c for p in self.ids for c in p}
        self.char = {c: self.ids.get(c, n + ord(c)) for c in chars}
        for p, r in order.items():
            for i in range(1, len(p)):
                a, b = (self.char.get(x) if len(x) == 1 else self.ids.get(x) for x in (p[:i], p[i:]))
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
                hurried.update(x for x in (p[:i], p[i:]) if order.get(x, -1) > r)
        self.keys = np.array(sorted(pairs), np.uint64)
        self.ranks = np.array([pairs[int(k)] for k in self.keys], np.int32)
        self.made = np.array([self.ids[p] for p in order], np.int64)
        self.alone = np.array([p in hurried for p in order] + [False])
        raw = [bytes([int(np.flatnonzero(self.byte == i)[0])]) if m.is_byte(i) else b" \xe2\x81\x87 " if m.is_unknown(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(text)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
        self.prefixed = np.array([not s and p.startswith(SPACE) for s, p in zip(special, text)])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words (none empty) after all merges, and where each word's begin, then the end."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, back = np.unique(code, return_inverse=True)
        sym = np.array([self.char.get(chr(c), self.size + int(c)) for c in known], np.int64)[back]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        r = np.full(len(sym), _NONE, np.int32)
        r[:-1] = np.where(word[1:] == word[:-1], self.rank(sym[:-1], sym[1:]), _NONE)
        done_sym, done_word = [], []
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[head, len(sym)])
            least = np.minimum.reduceat(r, head)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone]), done_word.append(word[gone])
                sym, word, r = sym[~gone], word[~gone], r[~gone]
                size, least = size[~over], least[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(r == np.repeat(least, size))
            n = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], n, 0))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[np.where(self.alone[r[at]], first, (n - run) % 2 == 0)]
            sym[at] = self.made[r[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, word, r = sym[keep], word[keep], r[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                r[i] = np.where((j > i) & (word[j] == word[i]), self.rank(sym[i], sym[j]), _NONE)
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin, then the end."""
        parts, at = [], [0]
        for w in words:
            if len(w) > LONGEST:  # parted between characters that no piece has side by side
                cut = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.within), len(w)]
                parts += [w[a:b] for a, b in zip(cut, cut[1:])]
            else:
                parts.append(w)
            at.append(len(parts))
        sym, start = self.merge(parts)
        start = start[at]
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, start
        raw = [self.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in (sym[odd] - self.size).tolist()]
        n = np.ones(len(sym), np.int64)
        n[odd] = [len(x) for x in raw]
        out, end = np.repeat(sym, n), np.r_[0, np.cumsum(n)]
        out[flat.ragged(end[odd], n[odd])] = np.concatenate(raw)
        return out, end[start]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        out = self.raw[flat.ragged(self.raw_at[ids], n)].tobytes()
        return out[1:] if len(ids) and self.prefixed[ids[0]] else out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "tidegauge-each")


@lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Texts to ids, with a bounded memory of words that came up repeatedly."""

    def __init__(self, path: str):
        self.model, self.known = pieces(path), {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        every = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        count: dict[str, int] = {}
        for words in every:
            for w in words:
                if w not in self.known:
                    count[w] = count.get(w, 0) + 1
        new = {}
        if count:
            ids, at = self.model.encode_words(list(count))
            bounds = at.tolist()
            new = {w: ids[a:b] for w, a, b in zip(count, bounds, bounds[1:])}
        known = self.known
        out = [np.concatenate([known[w] if w in known else new[w] for w in words]) if words else np.zeros(0, np.int64) for words in every]
        for w, c in count.items():
            if c > 1 and len(w) <= LONGEST and len(known) < REMEMBERED:
                known[w] = new[w].copy()
        return out


def vocabulary(path: str | None, name: str) -> str:
    """``path``, or where the public vocabulary of that name lies on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, name: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with a column ids (array of int): the text's ids without begin or end; a null or empty text has none.

    Other columns stay, but for one named ids, which is replaced. Repeated rows are encoded each, null doc_ids stay; an empty
    table gives no rows.
    """
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != "ids"]

    def run(batches):
        enc = Encoder(vocabulary(path, name))
        for rows, u8, off in flat.slices(batches):
            ids = enc(flat.column(rows).cast(pa.large_string()).to_pylist())
            values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, values], [*rest, "ids"])

    return docs.select(*rest).mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str | None = None, name: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with a column decoded: the text of the ids (null as none).

    Other columns stay, but for one named decoded, which is replaced. Repeated rows are decoded each; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != "decoded"]

    def run(batches):
        model = pieces(vocabulary(path, name))
        for rows in batches:
            ids = rows.column("ids").to_pylist() if rows.num_rows else []
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([model.decode(np.array(x or [], np.int64)) for x in ids], pa.string())], [*rest, "decoded"])

    return docs.select(*rest).mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip_digests(docs: DataFrame, path: str | None = None, name: str = "piece_bpe_32k.model") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again.

    A null text counts as empty: no ids. Repeated rows give a row each, null doc_ids stay null, other
    columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        enc = Encoder(vocabulary(path, name))
        decimal = np.array([str(i) for i in range(enc.model.size)], object)
        for rows, u8, off in flat.slices(batches):
            ids = enc(flat.column(rows).cast(pa.large_string()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(decimal[x].tolist()).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(enc.model.decode_bytes(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
