"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one node with a count.  A pass gives each node KEY random hyperplane signs, most
significant first, and orders all nodes by them lexicographically.  The order is cut into blocks of
CHUNK nodes.  Each node is compared with its block and the WINDOW nodes behind it; nodes that share
their first `bits` signs are compared wherever they stand, in pairs of blocks, so a dense
region is never cut off by the window.  Verified pairs of all passes are united into components.
Within a component every pair is then compared, in pairs of bounded blocks, so the link counts of a
component are complete however large it is; blocks return counts, never pairs.

Two vectors at the threshold agree on a sign with probability q (0.856 at cosine 0.9), so the passes
miss them with probability (1 - q^bits)^passes at most, at any density, even without the windows.
`plan` takes bits for stretches of about STRETCH nodes and as many passes as hold that at MISS.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.blobs import groups, joined
from clusterloom.operators.durable import Workspace, settle
from clusterloom.operators.graph import connected_components

#: Largest chance that a pair at the threshold meets in no pass.
MISS = 1e-4
#: Signs of a key.
KEY = 62
#: Nodes of a block of the order, and the nodes behind a block that it is compared with, too.
CHUNK, WINDOW = 2048, 128
#: Nodes that are to share their first signs, on average.
STRETCH = 512
#: Nodes of a block of a component.
BLOCK = 2048
SEED = 20240229


def _blobs(wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as bytes of doubles or floats; null where a vector links with nothing."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                a = np.array(v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else [], kind) + kind(0.0)
                top = np.abs(a).max(initial=0.0)
                out.append(a.tobytes() if 0 < top < np.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return run


def _unit(vectors: list[bytes], wide: bool) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64 if wide else np.float32) for x in vectors]).astype(np.float64)
    v /= np.abs(v).max(1)[:, None]  # no square over- or underflows
    return v / np.sqrt((v * v).sum(1))[:, None]


def plan(nodes: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, passes): first signs that stretches share, and passes that miss a pair at the threshold with probability `miss` at most."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    bits = min(KEY, max(2, math.ceil(math.log2(max(1, nodes) / STRETCH)))) if agree > 0 else 0
    meet = agree**bits
    return bits, 1 if meet >= 1 else max(2, math.ceil(math.log(miss) / math.log1p(-meet)))


def _keys(passes: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(KEY - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            node = batch.column(0).to_numpy()
            vectors = batch.column(1).to_pylist()
            size = np.array([len(v) for v in vectors])
            for bytes_ in np.unique(size):
                at = np.flatnonzero(size == bytes_)
                dim = int(bytes_) // (8 if wide else 4)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, passes * KEY))
                for lo in range(0, len(at), 1000):
                    part = at[lo : lo + 1000]
                    signs = (_unit([vectors[i] for i in part], wide) @ planes[dim] > 0).reshape(len(part), passes, KEY)
                    key = signs @ powers
                    n = len(part) * passes
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(part))), pa.array(key.reshape(-1)), pa.array(np.repeat(node[part], passes))],
                        ["dim", "pass", "key", "node"],
                    )

    return run


def _links(cosine: float, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that span the components of the links between two blocks, or of a block and what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["dim", "x", "y"]):
            n = table.num_rows
            if n < 2:
                continue
            node, block = table["node"].to_numpy(), table["block"].to_numpy()
            unit = _unit(table["vec"].to_pylist(), wide)
            x, y = table["x"][0].as_py(), table["y"][0].as_py()
            left = np.flatnonzero(block == x)
            right = np.arange(n) if x == y else np.flatnonzero(block == y)
            label = np.arange(n)
            for lo in range(0, len(left), 512):
                own = left[lo : lo + 512]
                i, j = np.nonzero(unit[own] @ unit[right].T >= cosine)
                a, b = label[own[i]], label[right[j]]
                label = joined(n, a, b)[label]
            rest = np.flatnonzero(node[label] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.array(node[label[rest]])], ["src", "dst"])

    return run


def _count(cosine: float, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["component", "x", "y"]):
            node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
            unit = _unit(table["vec"].to_pylist(), wide)
            x, y = table["x"][0].as_py(), table["y"][0].as_py()
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            near = unit[left] @ unit[right].T >= cosine
            if x == y:
                near &= node[left][:, None] != node[right][None, :]
                at, links = left, near @ copies[right]
            else:
                at, links = np.r_[left, right], np.r_[near @ copies[right], near.T @ copies[left]]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links.astype(np.int64))], ["node", "links"])

    return run


def sorted_blocks(keys: DataFrame, bits: int, work: Workspace) -> DataFrame:
    """(dim, x, y, block, node): nodes dealt to pairs of blocks of the sorted order of (dim, pass, key).

    Only the number of rows of each partition reaches the driver.
    """
    order = ["dim", "pass", "key"]
    number = F.monotonically_increasing_id()
    ranked = work.table(keys.repartitionByRange(*order).sortWithinPartitions(*order, "node").select(*order, "node", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.max("place").alias("m"), F.count("*").alias("n")).collect()}
    before, at = ["0"] * (max(sizes, default=0) + 1), 0
    for part in sorted(sizes):
        before[part] = str(at)
        at += sizes[part]
    place = F.get(F.split(F.lit(",".join(before)), ",").cast("array<long>"), F.col("part").cast("int")) + F.col("place")
    rows = ranked.select(*order[:2], F.shiftright("key", KEY - bits).alias("stretch") if bits else F.lit(0).cast("long").alias("stretch"), "node", place.alias("place"))
    rows = rows.withColumn("block", F.expr(f"place div {CHUNK}"))
    window = F.when((F.col("place") % CHUNK < WINDOW) & (F.col("block") > 0), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    near = rows.select("dim", "block", "node", F.explode(window).alias("x")).select("dim", "x", F.col("x").alias("y"), "block", "node")
    spans = rows.groupBy("dim", "pass", "stretch").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    pair = F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    far = rows.join(spans, ["dim", "pass", "stretch"]).withColumn("other", F.explode(F.sequence("low", "high"))).where("other <> block").select("dim", pair.alias("pair"), "block", "node")
    return near.unionByName(far.select("dim", "pair.x", "pair.y", "block", "node"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    n_links counts the other rows linked directly, copies included.  Null, empty and
    zero vectors, and those with a null or non-finite component, link with nothing and keep
    themselves; vectors of different lengths never link.  component_id is the smallest vec_id of the
    component; kept is vec_id = component_id.  Rows that share an id are vectors of their own.
    A null id is no one's component; such a row is not kept.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    wide = dict(vectors.dtypes)[vector_col] != "array<float>"
    with Workspace(spark) as work:
        rows = work.table(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v")).mapInArrow(_blobs(wide), "vec_id long, vec binary"))
        nodes = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        nodes, figures = work.counted(nodes.withColumn("node", F.monotonically_increasing_id()), F.count(F.lit(1)).alias("n"))
        bits, passes = plan(figures["n"], cosine, miss)
        keys = nodes.select("node", "vec").mapInArrow(_keys(passes, wide), "dim int, pass int, key long, node long")
        meet = ["dim", "x", "y"]
        pairs = sorted_blocks(keys, bits, work).join(nodes.select("node", "vec"), "node")
        links = pairs.repartition(*meet).sortWithinPartitions(*meet).mapInArrow(_links(cosine, wide), "src long, dst long")
        parts = work.table(connected_components(links, work=work).select("node", "component"))
        sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        dense = (
            parts.join(sizes, "component")
            .join(nodes, "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "vec")
        )
        meet = ["component", "x", "y"]
        counts = dense.repartition(*meet).sortWithinPartitions(*meet).mapInArrow(_count(cosine, wide), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
        roots = parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("root"))
        named = nodes.join(parts, "node", "left").join(roots, "component", "left").join(counts, "node", "left")
        named = work.table(named.select("vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("root")))
        out = rows.join(named, "vec", "left")
        component = F.coalesce("root", "vec_id")
        return settle(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(c.b, vec_id), vec_id) AS component_id, coalesce(least(c.b, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
