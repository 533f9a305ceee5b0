"""Agglomerative clustering of topics on pair probabilities, one dendrogram for all cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.durable import settle
from clusterloom.operators.graph import components_by_topic


def merges(d: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """(distance, a, b) in merge order: the nearest two clusters join, the first of equal pairs, distances by Lance-Williams.

    Each cluster keeps its nearest later one, so a step looks at one row of n values and at those whose nearest has changed.
    """
    n = len(d)
    d = d.astype(float).copy()
    d[np.tril_indices(n)] = np.inf  # row a holds the distances to later clusters
    size, out = np.ones(n), []
    near = d.argmin(1)
    least = d[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(least))
        b = int(near[a])
        out.append((float(least[a]), a, b))
        to_a = np.r_[d[:a, a], np.inf, d[a, a + 1 :]]
        to_b = np.r_[d[:b, b], np.inf, d[b, b + 1 :]]
        row = (size[a] * to_a + size[b] * to_b) / (size[a] + size[b]) if linkage == "average" else np.maximum(to_a, to_b)
        row[[a, b]] = np.inf
        stale = np.flatnonzero((near == a) | (near == b) | (np.arange(n) == a))
        d[:a, a], d[a, a + 1 :] = row[:a], row[a + 1 :]
        d[:b, b] = d[b, b + 1 :] = np.inf
        least[b] = np.inf
        closer = np.flatnonzero((row[:a] < least[:a]) | ((row[:a] == least[:a]) & (a < near[:a])))
        for i in np.union1d(stale[stale != b], closer):
            near[i] = d[i].argmin()
            least[i] = d[i, near[i]]
        size[a] += size[b]
    return out


def cut(n: int, steps: list[tuple[float, int, int]], threshold: float) -> list[int]:
    """Labels after the merges below the threshold, numbered by the least member."""
    root = list(range(n))
    for dist, a, b in steps:
        if dist >= threshold:
            break
        root = [a if r == b else r for r in root]
    number = {r: i for i, r in enumerate(dict.fromkeys(root))}
    return [number[r] for r in root]


#: Topics of at most so many mentions are merged together with the others of their size; each larger one by itself.
SMALL = 24
#: Distances that are held at once for topics of one size.
HELD = 1 << 21


def merges_of_many(d: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, a and b of `merges` for each matrix of d[t, n, n], a row a topic."""
    m, n, _ = d.shape
    d, t = d.astype(float).copy(), np.arange(m)
    d[:, np.arange(n), np.arange(n)] = np.inf
    low = np.tri(n, dtype=bool)
    size, out = np.ones((m, n)), np.zeros((3, m, max(n - 1, 0)))
    for k in range(n - 1):
        first = np.where(low, np.inf, d).reshape(m, -1).argmin(1)
        a, b = first // n, first % n
        out[:, :, k] = d[t, a, b], a, b
        to_a, to_b = d[t, a], d[t, b]
        sa, sb = size[t, a][:, None], size[t, b][:, None]
        row = (sa * to_a + sb * to_b) / (sa + sb) if linkage == "average" else np.maximum(to_a, to_b)
        row[t, a] = row[t, b] = np.inf
        d[t, a] = d[t, :, a] = row
        d[t, b] = d[t, :, b] = np.inf
        size[t, a] += size[t, b]
    return out[0], out[1].astype(int), out[2].astype(int)


def cut_many(steps: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """`cut` for each row of merges_of_many."""
    dist, a, b = steps
    m, n = dist.shape[0], dist.shape[1] + 1
    root, on = np.tile(np.arange(n), (m, 1)), np.ones(m, bool)
    for k in range(n - 1):
        on &= dist[:, k] < threshold
        root = np.where(on[:, None] & (root == b[:, k, None]), a[:, k, None], root)
    number = np.cumsum(root == np.arange(n), axis=1) - 1  # a root is the least member
    return np.take_along_axis(number, root, 1)


def _cluster(thresholds: list[float], linkage: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, edges = batch.column(1), batch.column(2)
            at, e_at = nodes.offsets.to_numpy(), edges.offsets.to_numpy()
            own_rows = nodes.flatten()
            idx, more = own_rows.field(0).to_numpy(), own_rows.flatten()[1:]
            i_of, j_of, p_of = (edges.values.field(c).to_numpy()[e_at[0] : e_at[-1]] for c in ("i", "j", "p"))
            sizes, e_sizes = np.diff(at), np.diff(e_at)
            at, e_at = at - at[0], e_at - e_at[0]
            row, e_row = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), e_sizes)
            order = np.lexsort((idx, row))
            idx = idx[order]
            # places of the pairs' ends among the sorted mentions of their topic
            values = np.unique(np.concatenate([idx, i_of, j_of]))
            place = lambda v, r: r * len(values) + np.searchsorted(values, v)  # noqa: B023, E731
            known = place(idx, row)
            i, j = (np.searchsorted(known, place(v, e_row)) - at[e_row] for v in (i_of, j_of))
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == n)
                step = max(1, HELD // (n * n)) if n <= SMALL else 1
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    own = (at[part][:, None] + np.arange(n)).ravel()
                    count = e_sizes[part]
                    e = np.repeat(e_at[part] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    t = np.repeat(np.arange(len(part)), count)
                    d = np.ones((len(part), n, n))
                    d[t, i[e], j[e]] = d[t, j[e], i[e]] = 1 - p_of[e]
                    if n <= SMALL:
                        steps = merges_of_many(d, linkage)
                        labels = [cut_many(steps, x) for x in thresholds]
                    else:
                        steps = merges(d[0], linkage)
                        labels = [np.array([cut(n, steps, x)]) for x in thresholds]
                    topic = batch.column(0).take(pa.array(np.repeat(part, n)))
                    carried = [c.take(pa.array(order[own])) for c in more]
                    for x, label in zip(thresholds, labels, strict=True):
                        yield pa.RecordBatch.from_arrays([topic, pa.array(np.full(len(topic), x)), pa.array(idx[own].astype(np.int64)), pa.array(label.ravel().astype(np.int64)), *carried], ["topic", "threshold", "idx", "label", *names])

    return run


def agglomerate(nodes: DataFrame, scored: DataFrame, thresholds: list[float], linkage: str = "average") -> DataFrame:
    """topic, threshold, idx, label: clusters of nodes topic, idx by scored pairs topic, i, j, p, for every distance threshold.

    A topic is held by one task: its distance matrix is what the linkage is defined on.  Other columns of the nodes are carried.
    """
    if linkage not in ("average", "complete"):
        raise ValueError("linkage is average or complete")
    more = [c for c in nodes.columns if c not in ("topic", "idx")]
    n = nodes.groupBy("topic").agg(F.collect_list(F.struct(F.col("idx").cast("bigint").alias("idx"), *more)).alias("idx"))
    pair = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("p").cast("double").alias("p"))
    e = scored.groupBy("topic").agg(F.collect_list(pair).alias("edges"))
    kind = nodes.schema["topic"].dataType.simpleString()
    edges = F.coalesce("edges", F.array().cast("array<struct<i:bigint,j:bigint,p:double>>")).alias("edges")
    schema = ", ".join([f"topic {kind}, threshold double, idx long, label long", *[f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in more]])
    return n.join(e, "topic", "left").select("topic", "idx", edges).mapInArrow(_cluster(thresholds, linkage, more), schema)


def cluster(nodes: DataFrame, scored: DataFrame, method: str, threshold: float, linkage: str = "average") -> DataFrame:
    """topic, idx, label by connected components (edges with p >= 1 - threshold) or agglomeration."""
    if method == "cc":
        return components_by_topic(nodes, scored.where(F.col("p") >= 1 - threshold))
    return agglomerate(nodes, scored, [threshold], linkage).drop("threshold")


def impurity(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """topic, impure, extra, share, largest: components with several gold clusters, their surplus, mention share and largest size."""
    parts = labels.join(gold, ["topic", "idx"]).groupBy("topic", "label").agg(F.countDistinct("gold").alias("k"), F.count("*").alias("n"))
    bad = F.col("k") > 1
    return parts.groupBy("topic").agg(
        F.count_if(bad).cast("long").alias("impure"),
        F.sum(F.when(bad, F.col("k") - 1).otherwise(0)).cast("long").alias("extra"),
        (F.sum(F.when(bad, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        F.max(F.when(bad, F.col("n")).otherwise(0)).cast("long").alias("largest"),
    )


def labels_at(nodes: DataFrame, scored: DataFrame, thresholds: list[float], method: str, linkage: str = "average") -> DataFrame:
    """topic, threshold, idx, label for every distance threshold; one dendrogram a topic, or one run of components for all thresholds.

    Other columns of the nodes are carried.
    """
    if method != "cc":
        return agglomerate(nodes, scored, thresholds, linkage)
    every = F.array(*[F.lit(float(t)) for t in thresholds])
    at = F.struct("t", "topic").alias("topic")
    edges = scored.withColumn("t", F.explode(F.filter(every, lambda t: F.col("p") >= 1 - t))).select(at, "i", "j")
    found = components_by_topic(nodes.withColumn("t", F.explode(every)).select(at, "idx"), edges)
    out = found.select(F.col("topic.topic").alias("topic"), F.col("topic.t").alias("threshold"), "idx", "label")
    return out if set(nodes.columns) == {"topic", "idx"} else out.join(nodes, ["topic", "idx"]).select(*out.columns, *[c for c in nodes.columns if c not in ("topic", "idx")])


def sweep(nodes: DataFrame, scored: DataFrame, thresholds: list[float], method: str, evaluate: Callable[[DataFrame], DataFrame], linkage: str = "average") -> DataFrame:
    """evaluate(labels): rows with threshold.  It gets topic, threshold, idx, label and the nodes' other columns for all thresholds at once, computed once."""
    return evaluate(settle(labels_at(nodes, scored, thresholds, method, linkage)))


def winner(rows: DataFrame, score: str) -> DataFrame:
    """The row of the first threshold with the largest score, as a sweep with a strict comparison keeps it."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct(score, -F.col("threshold"))).alias("best")).where("best is not null").select("best.*")


def system_topics(topics: DataFrame, clusters: DataFrame, skipped: bool = False) -> DataFrame:
    """topic, mentions array<struct<para, start, end, cluster>>: the topic's mentions with the predicted clusters of the same places.

    topics: topic, mentions; clusters: topic, clusters.  Topics without a prediction are left out, and are the rows of skipped=True; one of
    another length raises an error.
    """
    if skipped:
        return topics.join(clusters.select("topic"), "topic", "left_anti").select("topic")
    sizes = F.concat(F.lit("topic "), F.col("topic").cast("string"), F.lit(": "), F.size("clusters").cast("string"), F.lit(" clusters for "), F.size("mentions").cast("string"), F.lit(" mentions"))
    same = F.when(F.size("clusters") == F.size("mentions"), F.lit(True)).otherwise(F.raise_error(sizes).cast("boolean"))
    zipped = F.zip_with("mentions", "clusters", lambda m, c: F.struct(m["para"].alias("para"), m["start"].alias("start"), m["end"].alias("end"), c.alias("cluster")))
    return topics.select("topic", "mentions").join(clusters.select("topic", "clusters"), "topic").where(same).select("topic", zipped.alias("mentions"))


def merged_clusters(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """mentions topic, cluster, ... with merged: clusters that relations topic, src, dst connect are one, numbered by their least cluster."""
    nodes = mentions.select("topic", F.col("cluster").alias("idx")).distinct()
    parts = components_by_topic(nodes, relations.select("topic", F.col("src").alias("i"), F.col("dst").alias("j")))
    return mentions.join(parts.select("topic", F.col("idx").alias("cluster"), F.col("label").alias("merged")), ["topic", "cluster"])
