"""Toxicity scores by FTRL-proximal logistic regression.

Features are lower-cased words, their stems (first bytes), word pairs and one-word skip
pairs of the whole text, hashed into 2^22 coordinates, each counted once in a text.  FTRL-proximal keeps a learning
rate for each coordinate and its L1 term leaves few weights.  These, sorted by
coordinate, are the model: at most MAX_WEIGHTS of them, so their broadcast is bounded.

The model learns from at most `max_rows` labelled rows, those of least hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.text_arrays import U, chunks, mix, prefix_hash, scan
from clusterloom.operators.durable import short_batches

BITS = 22
MAX_WEIGHTS = 100_000
#: Bytes of the stems: inflected and compound words share them.
STEMS = (4, 5)
#: ASCII punctuation parts words too, so "word," is "word".
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 3


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, coordinates, row of each) with repeats."""
    for row, last, data, bounds in chunks(texts):
        w = scan(_PLAIN[data], bounds, lower=True)
        h, doc = w.hash, w.document()
        parts, owners = [h], [doc]
        total, down = prefix_hash(w.data)
        for k in STEMS:
            keep = w.end - w.start > k
            at = w.start[keep]
            parts.append(mix((total[at + k] - total[at]) * down[at] + U(k)))
            owners.append(doc[keep])
        for gap, seed in ((1, U(0x632BE59BD9B4E019)), (2, U(0x8CB92BA72F3D8DD7))):
            keep = doc[:-gap] == doc[gap:]
            parts.append(mix(h[:-gap][keep] * seed + h[gap:][keep]))
            owners.append(doc[:-gap][keep])
        yield row, last - row, (np.concatenate(parts) >> U(64 - BITS)).astype(np.int32), np.concatenate(owners)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, at, owner in features(batch.column(2)):
            cells = np.unique(owner.astype(np.int64) << 32 | at)
            first = np.searchsorted(cells, np.arange(n + 1) << 32)
            at = (cells & 0xFFFFFFFF).astype("<u4")
            blobs = pa.array([at[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), blobs], ["doc_id", "y", "x"])


def fit(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of one pass order repeated p.epochs times.

    A coordinate's gradients are below 1 in size, so one seen l1 / epochs times at most
    ends with weight 0 anyway and is left out before.
    """
    seen, times = np.unique(np.concatenate([x for x, _ in rows] or [np.zeros(0, np.uint32)]), return_counts=True)
    used = seen[times * p.epochs > p.l1]
    rows = [(x[np.isin(x, used, assume_unique=True)], y) for x, y in rows]
    place = np.searchsorted(used, np.concatenate([x for x, _ in rows] or [np.zeros(0, np.uint32)]))
    z, n = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    ends = np.cumsum([len(x) for x, _ in rows])
    at = [np.append(a, len(used)) for a in np.split(place, ends[:-1])] if rows else []

    def weights(i: np.ndarray | slice) -> np.ndarray:
        l1 = p.l1 * (np.arange(len(z))[i] < len(used))
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i, (_, y) in zip(at, rows, strict=True):
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    w = weights(slice(None))
    bias, w = float(w[-1]), w[:-1]
    keep = np.flatnonzero(w)
    if len(keep) > MAX_WEIGHTS:
        raise ValueError(f"{len(keep)} weights; raise l1")
    return used[keep].astype(np.int32), w[keep], bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, params: Ftrl | None = None, label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Model from labelled rows: at most max_rows of them, those whose doc_id has the least hash.

    Null ids and labels are left out.  A document labelled more than once is toxic if any
    row says so.  Without labelled rows the model is empty, with bias 0.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(marks), "doc_id")
        .select("doc_id", "y", "text")
        .mapInArrow(_sparse, "doc_id long, y int, x binary")
        .toArrow()
    )
    held = sorted(zip(rows["doc_id"].to_pylist(), rows["x"].to_pylist(), rows["y"].to_pylist(), strict=True))
    order = np.random.default_rng(0).permutation(len(held))
    return fit([(np.frombuffer(held[i][1], "<u4"), held[i][2]) for i in order], params or Ftrl())


def _score(at: np.ndarray, weight: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[at] = True
        for batch in batches:
            for row, n, x, owner in features(batch.column(1)):
                hit = known[x]
                cells = np.unique(owner[hit].astype(np.int64) << 32 | x[hit])
                total = np.bincount(cells >> 32, weight[np.searchsorted(at, cells & 0xFFFFFFFF)], minlength=n) if len(cells) else np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) for each row of docs; a null or empty text has the bias only.  Other columns are no inputs.

    Repeated rows are scored each for itself, null ids stay null, and an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(*model), "doc_id long, score double")


def held_out(doc_id: str) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000, params: Ftrl | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; learns from rows that are not held out only.

    A null id is not held out.  Null labels and ids of labels are left out; without any the score is 0.5.  Repeated rows,
    ties, nulls and empty tables are as in score and train.
    """
    model = train(docs, labels.where(~held_out("doc_id")), max_rows, params)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
