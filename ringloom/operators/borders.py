"""Longest borders of sequences of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ringloom.operators.triggers import codes_of

_ODD = np.uint64(0x9E3779B97F4A7C15)


def longest_border(codes: np.ndarray) -> int:
    """Length of the longest proper prefix that is also a suffix. Prefixes and suffixes of each length are held against each other by sums of powers, all at once; the longest that agree are compared symbol by symbol."""
    n = len(codes)
    value = (codes.astype(np.uint64) + np.uint64(1)) * _ODD
    value ^= value >> np.uint64(29)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _ODD)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)])
    m = np.arange(1, n)
    for k in m[sums[m] * power[n - m] == sums[n] - sums[n - m]][::-1].tolist():
        if np.array_equal(codes[:k], codes[n - k :]):
            return k
    return 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [longest_border(codes_of(s)) for s in batch.column("seq").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(lengths, pa.int64())], ["seq_id", "border"])


def borders(seqs: DataFrame) -> DataFrame:
    """(seq_id, border) of each sequence, in time linear in its length; functions.border() is for short ones."""
    return seqs.select("seq_id", "seq").mapInArrow(_found, "seq_id long, border long")
