"""Stretches of windows and what is removed for them, on arrays and batches alone."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import anchors, suffix_array
from tallyframe.llm.text import BYTE_CODE


@pytest.mark.parametrize(("window", "gram"), [(20, 0), (20, 19), (7, 3), (1, 1)])
def test_stretches_equal_brute_force(window, gram):
    """Every window's anchor by itself; short and empty texts, and letters that repeat."""
    random = np.random.default_rng(window + gram)
    for _ in range(40):
        sizes = random.integers(0, 70, random.integers(1, 9)) * (random.random() < 0.9)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        hashes = anchors.Hashes(BYTE_CODE[random.integers(0, random.integers(1, 4), bounds[-1])])
        length = gram or window // 2
        grams = hashes.all(length)
        want = []
        for text, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            before = None
            for s in range(a, b - window + 1):
                at = min(range(s, s + window - length + 1), key=lambda p: (grams[p] >> np.uint64(anchors.PLACE_BITS), p))
                if at != before:
                    want.append([text, s, 0, grams[at]])
                want[-1][2] += 1
                before = at
        of, first, count, gram_hash, seg = anchors.stretches(hashes, bounds, window, gram)
        assert [list(x) for x in zip(of, first, count, gram_hash, strict=True)] == want
        assert (seg == hashes.of(first, first + count - 1 + window)).all()


def test_finishing_makes_no_object_for_each_window():
    """A text with 100,000 windows: they stay numbers in arrays."""
    windows, size = 100_000, 150_000
    entries = pa.StructArray.from_arrays(
        [pa.array(np.arange(windows), pa.int32()), pa.array(np.ones(windows), pa.int32())], names=["s", "n"]
    )
    more = pa.ListArray.from_arrays(pa.array([0, windows], pa.int32()), entries)
    none = pa.nulls(1, more.type)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7]), pa.array([b"x" * size], pa.binary()), none, more], names=["doc_id", "text", "hits", "more"]
    )
    tracemalloc.start()
    (found,) = suffix_array._removed(iter([batch]), 200, False)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    removed = windows + 199
    digest = hashlib.sha256(b"x" * (size - removed)).hexdigest()
    assert found.to_pylist() == [
        {"doc_id": 7, "n_bytes": size, "n_removed": removed, "n_spans": 1, "kept": None, "kept_sha256": digest}
    ]
    assert peak < 12e6


def test_texts_side_by_side():
    """Removed ends that touch the next text, empty and null texts, lists that are null."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("w", pa.int32())]))
    given = [
        (1, "abcdef", [{"s": 2, "n": 1, "w": 0}]),
        (2, "ghijkl", [{"s": 0, "n": 1, "w": 0}, {"s": 1, "n": 1, "w": 2}]),
        (3, None, None),
        (None, "", []),
        (5, "mnopqr", [{"s": 0, "n": 2, "w": 0}]),
        (6, "stuvwx", None),
    ]
    columns = [pa.array(c, k) for c, k in zip(zip(*given, strict=True), (pa.int64(), pa.string(), kind), strict=True)]
    (out,) = suffix_array._divided(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "found"])]), 4, True)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in out.to_pylist()]
    assert got == [(1, 6, 4, 1, b"ab"), (2, None, None, None, None), (3, 0, 0, 0, b""), (None, 0, 0, 0, b""), (5, 6, 5, 1, b"r"), (6, 6, 0, 0, b"stuvwx")]
    waits = out.slice(1, 1).to_pylist()[0]
    assert waits["text"] == b"ghijkl" and waits["open"] == [{"s": 1, "n": 1, "w": 2}]
    assert waits["hits"] == [{"s": 0, "n": 1}, {"s": 1, "n": 1}]
