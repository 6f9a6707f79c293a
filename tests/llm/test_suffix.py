"""Memory of the suffix buckets' groups, and their sums over bytes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from rideops.llm import suffix


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_anchors_hold_few_bytes_at_a_time():
    """The hashes of a group's grams, and of one long text, take the memory of a short piece."""
    letters = np.random.default_rng(3).integers(97, 123, 4 << 20).astype(np.uint8).tobytes().decode()
    for texts in ([letters[i:i + 4000] for i in range(0, len(letters), 4000)], [letters]):
        group = suffix._Group(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
        assert _peak(group.anchors) < 100 << 20


def test_sums_over_bytes_are_taken_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.array([0, 30, 1, 0, 0, 57, 200, 2, 0])
    offsets = np.append(0, np.cumsum(sizes))
    covered = rng.random(offsets[-1]) < 0.6
    covered[25:32] = True  # a run over the border of two documents counts in each
    turn = np.diff(np.concatenate([[0], covered * 3, [0]])).astype(np.int32)
    for run in (7, 64, 1 << 19):
        monkeypatch.setattr(suffix, "RUN", run)
        gone, removed, spans = suffix.removed_bytes(turn, offsets)
        assert (gone == covered).all()
        parts = [covered[a:b] for a, b in zip(offsets, offsets[1:])]
        assert removed.tolist() == [int(p.sum()) for p in parts]
        assert spans.tolist() == [sum(1 for x, y in zip([False, *p], p) if y and not x) for p in parts]
    nothing = suffix.removed_bytes(np.zeros(1, np.int32), np.zeros(3, np.int64))
    assert [len(x) for x in nothing] == [0, 2, 2] and not nothing[1].any()
    many = np.zeros((4 << 20) + 1, np.int32)
    assert _peak(lambda: suffix.removed_bytes(many, np.array([0, 1 << 20, 4 << 20]))) < 25 << 20
