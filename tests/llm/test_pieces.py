import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  a  b ", "\n", "a\nb\tc", "▁a ▁", "é\0x", "<s> </s> <unk> <0x41>", "　x", "ﬁ①", "😀🤯 𝔘", "á", "\r\n", "ẞ x", "﻿hi", "a" * 3000, "ab" * 3000, "the" * 2000, "x=" * 900, "▁" * 90, "🤯" * 40]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(PATH)


def test_edges(lib, enc):
    for t, ids in zip(EDGES, enc(EDGES)):
        assert ids.tolist() == lib.encode(t), t[:30]
        assert enc.model.decode(ids) == lib.decode(ids.tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aeinorst ▁.\n", max_size=200)), max_size=8))
def test_any_text(lib, enc, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t, ids in zip(texts, enc(texts)):
        assert ids.tolist() == lib.encode(t)
        assert enc.model.decode(ids) == lib.decode(ids.tolist())


def test_any_ids(lib, enc):
    rnd = np.random.default_rng(1)
    for _ in range(100):
        ids = rnd.integers(3, 32000 if rnd.random() < 0.5 else 400, rnd.integers(0, 20))
        assert enc.model.decode(ids) == lib.decode(ids.tolist())


def test_documents(table, lib):
    docs = table("documents")
    want = {}
    for r in docs.collect():
        ids = lib.encode(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in pieces.round_trip_digests(docs).collect()} == want


def test_tables(documents):
    docs = documents([(1, None), (None, "a b"), (None, "a b"), (4, "é" * 9)])
    out = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(r["decoded"] for r in out) == ["", "a b", "a b", "é" * 9] and "key" in out[0].asDict()
    assert pieces.round_trip_digests(documents([])).count() == 0
    assert sorted(r["n_tokens"] for r in pieces.round_trip_digests(docs).collect())[0] == 0


def test_empty_table(documents):
    docs = documents([])
    assert pieces.encode(docs).count() == 0 and pieces.decode(pieces.encode(docs)).count() == 0
