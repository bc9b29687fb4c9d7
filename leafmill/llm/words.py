"""Words and word shingles as 64-bit hashes.

Words are the maximal runs of letters and digits (Unicode L and N) of the lower-cased text. They are cut and hashed
by Spark's own functions; Python sees only arrays of integers and works on a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(c: Column | str) -> Column:
    """The hashes of a text's words in order, as array<bigint>; null for null."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads near values apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_parts(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column of integers as one array, and the offsets of its rows (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null([])
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def shingles(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of k words of every row: its hash, row and position in the row."""
    n = len(values) - k + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty.view(np.uint64), empty, empty
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * MULTIPLIER + values[j : j + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = row[:n] == row[k - 1 :]
    row = row[:n][keep]
    return mixed(h[keep]), row, np.flatnonzero(keep) - offsets[row]
