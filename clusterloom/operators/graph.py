"""Distributed graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.durable import Workspace, fingerprint, settle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", work: Workspace | None = None) -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    Alternates large-star and small-star steps, each one aggregate and one join
    on the node, so neither a component nor a hub's neighbours ever meet in one
    row; AQE can split a hot hub's join.  Nodes are longs.  Null ends and self loops are
    ignored; repeated edges count once; no edges give no rows.  Each round is
    written to the shared folder, so a lost executor repeats one round at most; its count and fingerprint are
    taken as it is written.  The last round's table is work's, or stays as long as the folder.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    work = work or Workspace(edges.sparkSession)
    graph, mark = work.counted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), *fingerprint("u", "v"))
    while mark["n"]:
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to the least around it
        large = graph.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after, now = work.counted(small.where("u <> v").distinct(), *fingerprint("u", "v"))
        work.drop(graph)
        graph = after
        if now == mark:
            break
        mark = now
    roots = graph.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return graph.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def closure(edges: DataFrame, key: str = "topic") -> DataFrame:
    """key, src, dst, hops: every reachable pair with its least number of edges, cycles included.

    Semi-naive: each round joins the last round's new pairs with the edges and keeps those not yet known.
    """
    e = edges.select(key, "src", "dst").where("src is not null and dst is not null").distinct()
    step = e.select(key, F.col("src").alias("mid"), F.col("dst").alias("to"))
    known = fresh = settle(e.withColumn("hops", F.lit(1)))
    hops = 1
    while fresh.take(1):
        hops += 1
        reached = fresh.select(key, "src", F.col("dst").alias("mid")).join(step, [key, "mid"]).select(key, "src", F.col("to").alias("dst")).distinct()
        fresh = settle(reached.join(known, [key, "src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        known = known.unionByName(fresh)
    return known


def derived_relations(edges: DataFrame, key: str = "topic") -> DataFrame:
    """key, src, dst: reachable pairs of different nodes that are not edges themselves."""
    return closure(edges, key).where("hops > 1 and src <> dst").select(key, "src", "dst")


#: Nodes of a topic whose components one task finds; it holds its nodes, and its edges in chunks.
WHOLE = 1 << 17
#: Rows that a task looks at together.
CHUNK = 1 << 17


def _starts(topics: pa.Array) -> np.ndarray:
    """Whether each row's topic is another than the row's before; structs are compared by their fields."""
    if pa.types.is_struct(topics.type):
        return np.any([_starts(f) for f in topics.flatten()], axis=0)
    a, b = topics[1:], topics[:-1]
    none = pc.xor(a.is_null(), b.is_null())
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), none)
    return np.r_[True, other.to_numpy(zero_copy_only=False)]


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least vertex that each of 0..n-1 reaches over the edges u, v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return root


def _vertices(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """topic number of each row, vertices of i and of j where the row is an edge, whether it is one, and the roots; vertices are in the order of topic, then value."""
    run = np.cumsum(_starts(rows["topic"].combine_chunks())) - 1
    i, j = rows["i"].combine_chunks(), rows["j"].combine_chunks()
    edge = rows["edge"].combine_chunks().to_numpy(zero_copy_only=False)
    ends = pa.concat_arrays([i, j.filter(pa.array(edge))])
    order = pc.rank(ends, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    known, at = np.unique(np.r_[run, run[edge]] * (order.max(initial=0) + 1) + order, return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    return run, u, v, edge, _roots(len(known), u[edge], v)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """topic, idx, label of rows topic, i, j, edge in the order of topics: nodes i and edges i, j."""
    held, n, enough = [], 0, CHUNK

    def labelled(rows: pa.Table) -> pa.RecordBatch:
        run, u, _, edge, root = _vertices(rows)
        own = np.unique(u[~edge])
        _, first = np.unique(root[own], return_index=True)
        new = np.zeros(len(own), np.int64)
        new[first] = 1
        count = np.cumsum(new)
        number = np.zeros(len(root), np.int64)
        number[root[own[first]]] = count[first]
        node = u[~edge]
        lead = np.full(run[-1] + 1, np.iinfo(np.int64).max)  # the number of each topic's first component
        np.minimum.at(lead, run[~edge], number[root[node]])
        out = rows.filter(pa.array(~edge))
        return pa.RecordBatch.from_arrays([out["topic"].combine_chunks(), out["i"].combine_chunks(), pa.array(number[root[node]] - lead[run[~edge]])], ["topic", "idx", "label"])

    def fewer(rows: pa.Table) -> pa.Table:
        """The nodes of one topic, and its components as stars."""
        _, u, v, edge, root = _vertices(rows)
        every = np.r_[u, v]
        known, first = np.unique(every, return_index=True)
        value = pa.concat_arrays([rows["i"].combine_chunks(), rows["j"].combine_chunks().filter(pa.array(edge))]).take(pa.array(first))
        leaf = np.flatnonzero(root[known] != known)
        stars = pa.table({"topic": rows["topic"].combine_chunks().take(pa.array(np.zeros(len(leaf), np.int64))), "i": value.take(pa.array(leaf)), "j": value.take(pa.array(np.searchsorted(known, root[known][leaf]))), "edge": pa.array(np.ones(len(leaf), bool))})
        return pa.concat_tables([rows.filter(pa.array(~edge)), stars.cast(rows.schema)])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_starts(rows["topic"].combine_chunks()))[-1])
        if cut:
            yield labelled(rows.slice(0, cut))
        last = rows.slice(cut)
        if len(last) > CHUNK:
            last = fewer(last)
        held, n, enough = last.to_batches(), len(last), max(CHUNK, 2 * len(last))
    if n:
        yield labelled(pa.Table.from_batches(held))


def components_by_topic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """topic, idx, label: components of edges topic, i, j over nodes topic, idx; labels number the components by their least idx.

    A topic of at most WHOLE nodes is one task's, after one exchange; larger ones go by rounds over all tasks.
    """
    large = nodes.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("topic")
    if not large.take(1):
        return _components_whole(nodes, edges)
    large = settle(large)
    here = large.select(F.struct("topic").alias("_large"))
    part = lambda df, how: df.join(F.broadcast(here), F.struct("topic").eqNullSafe(F.col("_large")), how)
    whole = _components_whole(part(nodes, "left_anti"), part(edges, "left_anti"))
    return whole.unionByName(_components_spread(part(nodes, "left_semi"), part(edges, "left_semi")))


def _components_whole(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = {c: nodes.schema[c].dataType for c in ("topic", "idx")}
    end = lambda c: F.col(c).cast(kinds["idx"])
    n = nodes.select("topic", F.col("idx").alias("i"), F.lit(None).cast(kinds["idx"]).alias("j"), F.lit(False).alias("edge"))
    e = edges.where("i is not null and j is not null").select(F.col("topic").cast(kinds["topic"]).alias("topic"), end("i").alias("i"), end("j").alias("j"), F.lit(True).alias("edge"))
    rows = n.unionByName(e).repartition("topic").sortWithinPartitions("topic")
    return rows.mapInArrow(_labels, f"topic {kinds['topic'].simpleString()}, idx {kinds['idx'].simpleString()}, label long")


def _components_spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    node = lambda c: F.xxhash64("topic", c)
    parts = connected_components(edges.select(node("i").alias("src"), node("j").alias("dst")))
    named = nodes.select("topic", "idx", node("idx").alias("node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.withColumn("least", F.min("idx").over(W.partitionBy("topic", "component")))
    return least.select("topic", "idx", (F.dense_rank().over(W.partitionBy("topic").orderBy("least")) - 1).cast("long").alias("label"))
