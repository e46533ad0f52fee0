"""What op6's cheaper steps must keep: the hashes, orders and passages of the plain ways, and each pass run once."""

import random

import numpy as np
import pytest

from tremorlake.llm import blocks, substring_dedup
from tremorlake.llm.common import WordHash, hashed_words


def test_words_hashed_together_equal_xxh64():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aBZ \t\n\x0b\x0c\r\x1c\x00é漢9") for _ in range(rng.randrange(200))) for _ in range(100)]
    texts += ["", "   ", "a", " ".join("Q" * n for n in range(1, 70)), ""]
    for some in (texts, [], ["", ""], ["x y"]):
        hashed = WordHash()
        want = [hashed.of(t.encode().lower().split()) for t in some]
        got, counts = hashed_words(some)
        assert counts.tolist() == [len(x) for x in want] and got.tolist() == [h for x in want for h in x.tolist()]


@pytest.mark.parametrize("bits", [5, 45, 62])
def test_ascending_is_stable(bits):
    key = np.random.default_rng(0).integers(0, 1 << min(bits, 7), 5000).astype(np.uint64) << np.uint64(max(0, bits - 7))
    assert (substring_dedup.ascending(key, bits) == np.argsort(key, kind="stable")).all()


def test_bytes_of_equal_weight():
    for x in (np.arange(-5, 300, 7), np.empty(0, np.int64), np.array([True, False]), np.arange(0, 2**40, 2**36, dtype=np.uint64), np.arange(-3, 3, dtype=np.int32)):
        (got,) = blocks.unbundle(blocks.bundle(x))
        assert blocks.planes(x) == np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() and got.dtype == x.dtype and (got == x).all()


def test_how_many_documents_hold_a_shingle_is_added_up():
    asked = [([3, 9, 2**32 - 1], [1, 200, 1]), ([9, 10], [100, 2]), ([3], [1])]
    packed = [blocks.bundle(np.diff(np.array(v, np.uint64), prepend=np.uint64(0)).astype(np.uint32), np.array(n, np.uint8)) for v, n in asked]
    assert [blocks.unbundle(x)[0].tolist() for x in substring_dedup.documents(packed)] == [[2, 255, 1], [255, 2], [2]]


def test_an_offset_that_settles_all_counts_nothing(monkeypatch):
    monkeypatch.setattr(substring_dedup, "matchable", None)
    b = np.random.default_rng(2).integers(0, 1 << 32, 300).astype(np.uint32)
    ((first, last, there, share, runs),) = substring_dedup.shared(b[40:160], b, [40, 7])
    assert (first, last, there, share, runs.tolist()) == (0, 119, 40, 1.0, [0, 119])


def test_open_stretches_are_asked_once(spark, monkeypatch):
    calls, plain = [], substring_dedup.open_stretches
    monkeypatch.setattr(substring_dedup, "open_stretches", lambda *a: calls.append(1) or plain(*a))
    rng = random.Random(1)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join([f"a{i}{j}" for j in range(30)] + passage) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in substring_dedup.merged_passages(substring_dedup.repeated_passages(docs)).collect()) == [1, 2]
    assert calls == [1]
