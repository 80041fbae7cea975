"""Slices: what a task reads at once, named alike on every reading, with small codes for the keys it holds.

Operators that look keys up in a table as large as the corpus send each slice's distinct keys there once and get
the answers back by code; texts stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

ORDINALS = 1 << 32


class Names:
    """Names of the slices of one task: its partition and a running number."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() * ORDINALS

    def __call__(self) -> int:
        self.next += 1
        return self.next - 1


def width(kinds: int) -> type:
    return np.uint16 if kinds <= 1 << 16 else np.uint32


def packed_lists(codes: np.ndarray, ends: np.ndarray, kinds: int) -> pa.Array:
    """One binary per text: the codes up to each end, in the smallest width that holds ``kinds`` codes."""
    raw = np.ascontiguousarray(codes.astype(width(kinds)))
    offsets = np.concatenate([[0], ends]).astype(np.int64) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked_lists(column: pa.ChunkedArray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes one after another and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), width(kinds)) for x in column]
    return np.concatenate([np.empty(0, width(kinds)), *parts]).astype(np.int64), np.array([len(p) for p in parts], np.int64)


def in_code_order(answers: pa.Table) -> pa.Table:
    """The answers to a slice by code; codes run from 0 without gaps unless the slice changed between readings."""
    answers = answers.sort_by("code")
    if not np.array_equal(answers.column("code").to_numpy(), np.arange(len(answers))):
        raise ValueError("a slice changed between two readings of the documents")
    return answers
