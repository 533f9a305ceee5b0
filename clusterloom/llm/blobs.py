"""Compact exchanges of numeric records between Python stages.

A map task packs its records by bucket into one binary value for each bucket, and
Spark shuffles these values by bucket.  A record thus costs its own bytes instead
of a row, and every reduce task reads about total / partitions bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Records that a map task holds before it packs them.
FLUSH = 1_000_000


def bucket_count(spark: SparkSession) -> int:
    """Four buckets for each shuffle partition; grows with the cluster's own setting."""
    return 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(records: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of a structured array's records."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for lo, hi in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
        yield int(bucket[lo]), records[lo:hi].tobytes()


def unpack(values: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype) if values else np.zeros(0, dtype)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cut = np.r_[0, np.flatnonzero(change), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over pairs (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        far = x != y
        if not far.any():
            return root
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
