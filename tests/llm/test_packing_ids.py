import numpy as np
import pyarrow as pa
import pytest

from filmloom.llm import packing


@pytest.mark.parametrize("rows", [[], [[]], [[1, 2, 3]], [[], [70_000, 5, 0], [], [65_535, 65_536, 2**31 - 1]], [[7] * 3000, [8]]])
def test_ids_come_back_from_their_bytes(rows):
    """Ids of more than two bytes, empty sequences and no sequences at all."""
    flat = np.array([i for row in rows for i in row], np.int64)
    ends = np.r_[0, np.cumsum([len(row) for row in rows])].astype(np.int64)
    stored = packing._stored(flat, ends)
    assert len(stored) == len(rows) and stored.type == pa.binary()
    back = packing._as_lists(stored)
    assert back.type == pa.list_(pa.int32()) and back.to_pylist() == rows


def test_equal_sequences_are_equal_bytes():
    ids, ends = np.array([5, 90_000, 6, 5, 90_000, 6]), np.array([0, 3, 6])
    a, b = packing._stored(ids, ends).to_pylist()
    assert a == b
