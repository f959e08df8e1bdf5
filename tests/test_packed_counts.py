"""Counts of words as few bytes."""

import numpy as np
import pyarrow as pa

from glossa.operators import words as W


def test_packed_counts_come_back_and_zeros_take_no_bytes():
    rng = np.random.default_rng(6)
    rows = np.where(rng.random((500, 42)) < 0.1, rng.choice([1, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**50], (500, 42)), 0)
    rows[[0, 7, 499]] = 0
    for some in (rows, rows[:0], rows[:1], rows[1:2], np.zeros((3, 7), np.int64)):
        packed = W._packed(some).cast(pa.binary())
        assert (W._counts(pa.chunked_array([packed]), some.shape[1]) == some).all()
    sliced = pa.chunked_array([W._packed(rows).slice(5, 60), W._packed(rows).slice(499)])
    assert (W._counts(sliced, 42) == np.concatenate([rows[5:65], rows[499:]])).all()
    assert W._counts(pa.chunked_array([W._packed(np.eye(2, 9, dtype=np.int64))])).tolist() == [[1, 0], [0, 1]]
    assert W._packed(np.eye(42, dtype=np.int64)).nbytes < 42 * (3 + 8) + 9
