import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import flat, kneser_ney, store

RND = np.random.default_rng(3)
HASHES = RND.integers(0, 1 << 64, 3000, dtype=np.uint64)
KEYS = {
    "none": HASHES[:0],
    "one": HASHES[:1],
    "hashes": HASHES,
    "repeated hashes": HASHES[RND.integers(0, 900, 3000)],
    "a few alike but for low bits": np.r_[HASHES, HASHES[:9] ^ np.uint64(1), HASHES[:9] ^ np.uint64(2), HASHES[:9]],
    "many alike but for low bits": np.uint64(1 << 63) + RND.integers(0, 500, 3000).astype(np.uint64),
    "small numbers": RND.integers(0, 700, 3000).astype(np.uint32),
    "largest": np.full(5, (1 << 64) - 1, np.uint64),
}


@pytest.mark.parametrize("name", KEYS)
def test_ranked(name):
    assert flat.ranked(KEYS[name]).tolist() == np.argsort(KEYS[name], kind="stable").tolist()


@pytest.mark.parametrize("tops", [(40,), (40, 9), (1 << 20, 1 << 20, 1 << 31), (1 << 62, 1 << 62), (1 << 62, 5, 1 << 62)])
def test_rows_are_numbered(tops):
    cols = [RND.integers(0, top, 400).astype(np.uint64)[RND.integers(0, 20, 900)] for top in tops]
    order, head, of = kneser_ney.numbered(cols)
    rows = np.stack(cols, 1)
    want, back = np.unique(rows, axis=0, return_inverse=True)
    assert order.tolist() == np.lexsort(cols[::-1]).tolist()
    assert rows[order[head]].tolist() == want.tolist() and of.tolist() == back.ravel().tolist()


def words(items):
    u8 = np.frombuffer(b" ".join(items), np.uint8)
    return u8, *flat.spans(u8, np.array([0, len(u8)]))


def collision():
    """Two words, of under eight and of eight bytes, that the product does not part."""
    c, bad = 0xD6E8FEB86659FD93, {*b"\x20\x09\x0a\x0b\x0c\x0d", *range(65, 91)}
    for n in (7, 6, 5, 4, 3) * 500:
        short = RND.integers(128, 255, n).astype(np.uint8).tobytes()
        long = (int.from_bytes(short, "little") ^ (c * n ^ c * 8) & (1 << 64) - 1).to_bytes(8, "little")
        if not set(long) & bad:
            return [short, long]
    raise AssertionError("none found")


@pytest.mark.parametrize("items", [[], [b"a", b"A", b"a\0", b"\0", b"\0a"], [b"word" * i for i in (1, 2, 3, 2, 40, 128, 129, 200, 129, 1)], [b"12345678", b"123456789", b"12345678\0", b"123456789012345678", b"12345678X012345678"], (collision() + collision()) * 2])
def test_words_alike(items):
    u8, starts, ends = words(items)
    one, of = flat.alike(u8, starts, ends)
    low = [x.lower() for x in items]
    assert len(one) == len(set(low)) and sorted(one.tolist()) == sorted({low.index(x) for x in low})
    assert [low[one[i]] for i in of] == low


@pytest.mark.parametrize("sizes", [[], [0], [0, 0], [10] * 7, [10, 10, 10, 90, 5, 5, 0], [90, 90, 1], [31] * 3, [5, 25, 1, 29, 30, 30]])
def test_slices_go_on_in_the_next_batch(sizes):
    made = [pa.record_batch({"i": pa.array(range(a, min(a + 2, len(sizes))), pa.int64()), "text": pa.array([None if not n else "x" * n for n in sizes[a : a + 2]], pa.string())}) for a in range(0, len(sizes), 2)]
    got = [(rows["i"].to_pylist(), bytes(u8), off.tolist()) for rows, u8, off in flat.pooled(iter(made), 30)]
    want, run = [], []
    for i, n in enumerate(sizes):
        if run and sum(sizes[j] for j in run) + n > 30:
            want.append(run)
            run = []
        run.append(i)
    want += [run] * bool(run)
    assert got == [(run, b"x" * sum(sizes[i] for i in run), np.cumsum([0, *(sizes[i] for i in run)]).tolist()) for run in want]


def test_rows_without_a_size_make_few_parts(spark, documents, table):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert store.parts_for(documents([(1, "a")]).select("text"), 10 << 20) == most
    assert store.parts_for(documents([(1, "a")]).crossJoin(documents([(2, "b")]).select("text")), 10 << 20) == most
    assert store.parts_for(table("documents"), 100) > 1000
