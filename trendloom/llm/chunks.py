"""Numbers of a chunk's entries in compact form, for operators that intern what a chunk of
documents holds, ask for it once, and put the answers back by number."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, the low ones first, after their count of planes:
    planes of high bytes are mostly zeros and compress well."""
    n = np.ascontiguousarray(numbers, "<u8")
    planes = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    return bytes([planes]) + n.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    held = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((held.shape[1], 8), np.uint8)
    out[:, :planes] = held.T
    return out.view("<i8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising numbers, by their distances."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)).astype(np.uint64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def chunk_id(k: int) -> int:
    """Of the task's chunk k. A chunk keeps its number where the table that holds it is written once."""
    return TaskContext.get().partitionId() << 24 | k


def schema_of(docs: DataFrame, key: str, columns: str) -> StructType:
    """The key of docs and further columns."""
    return StructType([docs.schema[key], *StructType.fromDDL(columns).fields])
