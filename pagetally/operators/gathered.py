"""Groups gathered into one row each (a page, a statement): their elements as flat arrays, a whole batch of groups at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def owners(lists: pa.ListArray) -> np.ndarray:
    """The list of each element, for lists that are flattened."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths)


def flat(lists: pa.ListArray) -> pa.Array:
    """The elements of lists. Spark sends lists inside lists that are all empty without offsets, which must not be read."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
    return lists.flatten() if lengths.sum() else pa.array([], lists.type.value_type)


def codes(*arrays: pa.Array) -> list[np.ndarray]:
    """Numbers that are equal where values are, over all arrays; -1 for null, which equals nothing. As in SQL, NaN equals NaN and 0 equals -0."""
    values = pa.concat_arrays(arrays)
    if pa.types.is_floating(values.type):
        found = np.unique(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False) + 0.0, return_inverse=True)[1].reshape(-1)
        found = np.where(values.is_valid().to_numpy(zero_copy_only=False), found, -1)
    else:
        found = pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.split(found.astype(np.int64), np.cumsum([len(a) for a in arrays])[:-1])


def places(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, count) of the keys, which are in order, that equal each wanted one."""
    begin = np.searchsorted(keys, wanted, side="left")
    return begin, np.searchsorted(keys, wanted, side="right") - begin


def ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of ranges."""
    entry = np.repeat(np.arange(len(count)), count)
    return entry, np.arange(len(entry)) + np.repeat(begin - (np.cumsum(count) - count), count)
