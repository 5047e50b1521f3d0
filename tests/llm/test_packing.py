import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegauge.llm import packing

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def sound(docs, out, capacity):
    """Every id of every document lies in one piece, every sequence is gapless."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in docs:
        ids, at = np.array(ids_of(text), "<u4"), 0
        for start, length, crc, n in sorted(pieces.pop(doc)):
            assert (start, n) == (at, len(ids)) and length > 0
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert not pieces
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_documents(table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    seqs = sound(docs, packing.pack(table("documents")).collect(), 1024)
    used = sum(n for own in seqs.values() for _, n in own)
    assert used / (1024 * len(seqs)) > 0.98


def test_edges(documents):
    docs = [(1, None), (2, ""), (3, "x" * 40000), (4, "a <|endoftext|> b"), (5, "é\n\n  tab\t's 'S don't"), (6, "🤯" * 500)]
    sound(docs, packing.pack(documents(docs)).collect(), 1024)
    sound(docs, packing.pack(documents(docs), capacity=64).collect(), 64)
    assert packing.pack(documents([])).count() == 0
    assert packing.pack(documents([(None, "a"), (None, "a"), (7, "b")])).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [*packing.encoding(None).encode(text, allowed_special="all"), 0] == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=200))
def test_windows(sizes):
    label = packing.windows(np.array(sizes), 1024)
    assert len(label) == len(sizes) and np.bincount(label, weights=sizes).max() <= 1024


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(1).integers(1, 257, 1024)
    sums = np.bincount(packing.differencing(sizes, 100), weights=sizes)
    assert sums.max() - sums.min() <= 4
