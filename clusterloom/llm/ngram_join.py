"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct k-word shingles.  Two
sets with |A n B| * 100 >= pct * |A u B| differ in at most
D = (100 - pct) / (100 + pct) * (|A| + |B|) shingles.  Each size band has its own D.
Within it, shingles are dealt by hash into D + 1 + e blocks, and each block keeps
the parity of 64 hash classes (the XOR of one-hot bits) and its count.  One shingle
changes one block, so a linked pair agrees on 1 + e blocks at least: documents are
joined on equal block sketches.  Light blocks say little and are left out, unless a
document has more than e of them, so no pair is lost at any size.

Many signatures are shared by the same documents.  Groups of SMALL documents at most go on as pairs of ids, each once
from a task and then once in all, so a pair costs the same however many blocks and tasks it meets in; larger groups go on as
their documents, each group once from a task.  Documents are compared by size and by whole parity sketches, those of larger groups by
coarse ones first and fine ones for what is left, whose
Hamming distance bounds the symmetric difference from below.  The pairs that these do not
rule out connect candidate clusters; for each larger group a spanning forest of them is enough.
A group of over CHUNK documents is not held by one task: each document meets the group's first, and those that this
leaves open meet the group in pairs of bounded chunks.
Clusters are then compared in pairs of bounded blocks, sketches first, and verified on
the sets.  Tasks return spanning forests, never all pairs.  Only the texts of clusters are shuffled: a bitmap of bounded size
holds back nearly all others before the join.

Exact copies within a map task meet before the shuffle, so a group of copies sends
one document for each task at most.

Most documents never come that far.  A shingle that stands in one document only is in no intersection, so a set of n shingles with
over (1 - pct / 100) * n of those links with no other set.  They are counted first, on a share of all shingles by hash, which can only
find fewer of them: what is left out is left out rightly, whatever the share (`tests/llm` compare with brute force).  What this leaves
is judged once more, by all shingles among itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.blobs import FLUSH, bucket_count, groups, joined, pack, unpack
from clusterloom.llm.text_arrays import U, chunks, distinct_sets, mix, scan, shingles
from clusterloom.operators.durable import Workspace, settle
from clusterloom.operators.graph import connected_components

POSTING = np.dtype([("sig", "<u8"), ("id", "<i8")])
#: A shingle (32 bits of its hash, besides its bucket) of a row, or of several rows: key 0; shingles of a row that stand nowhere else.
SEEN = np.dtype([("hash", "<u4"), ("key", "<u8")])
LONE = np.dtype([("key", "<u8"), ("n", "<u2")])
#: Documents of one block of a cluster's size class.
BLOCK = 2048
FOUND = "kind int, a long, b long, blob binary"
ABOUT, DOC, LINK, MEMBER, PAIR, POSTINGS = -1, 0, 1, 2, 3, 4
COUNTED = "bucket int, a long, b long, key long, blob binary"
#: Documents of a group that a task compares with as many others.
CHUNK = 4096
#: Bits of the whole-set sketches for each shingle, powers of two and LEAST at least: one that travels with every document of a group,
#: and one with those that it leaves.
COARSE, FINE, LEAST = 0.5, 2, 128
#: Groups of so many documents are compared all with all, larger ones along their links.
SMALL = 64
#: Bits of the map of documents that a join wants, in pages; it has this size at any scale, and what it lets pass besides goes in the join.
MAP, PAGE = 1 << 24, 1 << 15


@lru_cache(maxsize=None)
def bands(pct: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Lower bounds of the size bands, and for each its blocks, spare blocks and largest count of a light block."""
    ratio = max(1.25, 100 / pct)
    low, count, spare, light = [], [], [], []
    at = 1
    while at < 1 << 40:
        after = max(at + 1, math.ceil(ratio * at))
        d = 2 * (after - 1) * (100 - pct) // (100 + pct)
        mean = at / (d + 1)
        most, e = -1, 0
        if d:
            for t in (0, 1, 2):
                p = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(t + 1))
                if p <= 0.035:
                    most, e = t, math.ceil(1.2 * p * (d + 1) + 2 * math.sqrt(p * (d + 1)))
        low.append(at)
        count.append(d + 1 + e)
        spare.append(e)
        light.append(most)
        at = after
    return tuple(low), tuple(count), tuple(spare), tuple(light)


def block_sketches(values: np.ndarray, first: np.ndarray, docs: np.ndarray, band: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of the blocks that each of docs keeps in its band."""
    _, count, spare, light = (np.array(x) for x in bands(pct))
    sizes = first[docs + 1] - first[docs]
    blocks = count[band]
    base = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[docs][owner]
    h = values[at]
    block = base[owner] + (((h >> U(32)) * blocks[owner].astype(U)) >> U(32)).astype(np.int64)
    total = int(base[-1])
    filled = np.bincount(block, minlength=total)
    odd = (np.bincount(block * 64 + (h & U(63)).astype(np.int64), minlength=total * 64) & 1).astype(np.uint8)
    parity = np.packbits(odd.reshape(-1, 64), axis=1).view("<u8").reshape(-1)
    of = np.repeat(np.arange(len(docs)), blocks)
    weak = filled <= light[band][of]
    many = np.bincount(of[weak], minlength=len(docs)) > spare[band]
    keep = np.flatnonzero(~weak | many[of])
    of = of[keep]
    place = (keep - base[of]).astype(U)
    sig = mix(mix(parity[keep] + filled[keep].astype(U)) + place * U(0x9E3779B97F4A7C15) + (band[of].astype(U) << U(48)))
    return sig, docs[of]


def postings(values: np.ndarray, first: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) in a document's own band and, near its upper end, in the next."""
    low = np.array(bands(pct)[0])
    size = np.diff(first)
    docs = np.flatnonzero(size)
    own = np.searchsorted(low, size[docs], side="right") - 1
    near = 100 * size[docs] >= pct * low[own + 1]
    return block_sketches(values, first, np.concatenate([docs, docs[near]]), np.concatenate([own, own[near] + 1]), pct)


def text_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values, bounds): sorted shingle hashes of the next rows."""
    for row, last, data, bounds in chunks(texts):
        s, owner = shingles(scan(data, bounds, lower=True), k)
        yield row, *distinct_sets(s, owner, last - row)


def set_sketches(values: np.ndarray, first: np.ndarray, each: float) -> list[bytes]:
    """Parity of hash classes of each set: LEAST, doubled until they are `each` times its values at least."""
    size = np.diff(first)
    bits = LEAST << np.ceil(np.log2(np.maximum(1, size * each / LEAST))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    cell = np.repeat(base[:-1], size) + ((values >> U(7)).astype(np.int64) & np.repeat(bits - 1, size))
    packed = np.packbits((np.bincount(cell, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def folded(sketches: list[bytes], to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of words) of the sketches brought to `to` bytes each, by that length."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for target in np.unique(to).tolist():
        at = np.flatnonzero(to == target)
        out = np.empty((len(at), target // 8), np.uint64)
        for own in np.unique(size[at]).tolist():
            here = np.flatnonzero(size[at] == own)
            rows = np.frombuffer(b"".join([sketches[i] for i in at[here]]), "<u8").reshape(len(here), own // target, target // 8)
            out[here] = np.bitwise_xor.reduce(rows, axis=1)
        yield at, out


def _rows(kind: int, a: np.ndarray, b: np.ndarray, missing: np.ndarray | None = None, blobs: pa.Array | None = None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array((mix(a.astype(U)) & U(0x7FFF)).astype(np.int32)), pa.array(np.full(n, kind), pa.int32()), pa.array(a, pa.int64(), mask=missing), pa.array(b, pa.int64()), pa.nulls(n, pa.binary()) if blobs is None else blobs],
        ["bucket", "kind", "a", "b", "blob"],
    )


def _blobs(packed: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """COUNTED rows of packed records."""
    if packed := list(packed):
        empty = pa.nulls(len(packed), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in packed], pa.int32()), empty, empty, empty, pa.array([x[1] for x in packed], pa.binary())], ["bucket", "a", "b", "key", "blob"])


def _parted(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], pa.Table]:
    """Blobs and the other rows of COUNTED rows."""
    blobs, rest = [], []
    for batch in batches:
        plain = batch.column(4).is_null()
        blobs += batch.column(4).drop_null().to_pylist()
        rest.append(batch.filter(plain))
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "key")), ("blob", pa.binary())])
    return blobs, pa.Table.from_batches(rest, rest[0].schema if rest else schema)


def _key_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % U(buckets)).astype(np.int32)


def _seen(buckets: int, k: int, part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, set size, key of the row) and `part` percent of the shingles of all rows, each once from a task's stretch of rows."""
    share = U(part * (1 << 32) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(hashes)
            hashes, keys = hashes[order], keys[order]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            records = np.empty(len(first), SEEN)
            records["hash"] = hashes[first] >> U(32)
            records["key"] = np.where(np.diff(np.r_[first, len(hashes)]) > 1, U(0), keys[first])
            yield from _blobs(pack(records, ((hashes[first] & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)))

        for batch in batches:
            ids = batch.column(0)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            for row, values, first in text_sets(batch.column(1), k):
                n = len(first) - 1
                here, sizes = slice(row, row + n), np.diff(first)
                total = np.concatenate([[U(0)], np.cumsum(mix(values + U(0x2545F4914F6CDD1D)))])
                key = mix(total[first[1:]] - total[first[:-1]] + mix(number[here].astype(U)) + sizes.astype(U))  # copies have keys of their own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_key_bucket(key, buckets)), pa.array(number[here], pa.int64(), mask=~valid[here]), pa.array(sizes, pa.int64()), pa.array(key.view(np.int64)), pa.nulls(n, pa.binary())],
                    ["bucket", "a", "b", "key", "blob"],
                )
                take = np.repeat(valid[here], sizes) & ((values >> U(32)) < share)
                held.append((mix(values[take]), np.repeat(key, sizes)[take]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def _lone(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passes rows on, and counts for each the shingles of a partition that stand in it only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, rows = _parted(batches)
        yield from rows.to_batches()
        records = unpack(blobs, SEEN)
        if not len(records):
            return
        order = np.argsort(records["hash"])  # equal hashes of several buckets only let some rows pass
        hashes, keys = records["hash"][order], records["key"][order]
        edge = np.r_[True, hashes[1:] != hashes[:-1], True]
        keys = keys[edge[:-1] & edge[1:] & (keys != 0)]
        key, n = np.unique(keys, return_counts=True)
        out = np.empty(len(key), LONE)
        out["key"], out["n"] = key, np.minimum(n, 0xFFFF)
        yield from _blobs(pack(out, _key_bucket(key, buckets).astype(np.int64)))

    return run


def _open(pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n_shingles, open): whether a row has few enough shingles of its own to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, rows = _parted(batches)
        lone = unpack(blobs, LONE)
        names, at = np.unique(lone["key"], return_inverse=True)
        own = np.bincount(at, lone["n"], minlength=len(names)).astype(np.int64)
        names, own = np.r_[names, U(0xFFFFFFFFFFFFFFFF)], np.r_[own, 0]
        for batch in rows.to_batches():
            key, n = batch.column(3).to_numpy().view(U), batch.column(2).to_numpy()
            place = np.searchsorted(names, key)
            alone = np.where(names[place] == key, own[place], 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array((n > 0) & (100 * (n - alone) >= pct * n))], ["doc_id", "n_shingles", "open"])

    return run


def judged(rows: DataFrame, k: int, pct: int, part: int, work: Workspace) -> DataFrame:
    """(doc_id, n_shingles, open) of rows (doc_id, text), by `part` percent of the shingles."""
    buckets = bucket_count(rows.sparkSession)
    counted = work.table(rows.mapInArrow(_seen(buckets, k, part), COUNTED).repartition("bucket").mapInArrow(_lone(buckets), COUNTED))
    out = work.table(counted.repartition("bucket").mapInArrow(_open(pct), "doc_id long, n_shingles long, open boolean"))
    work.drop(counted)
    return out


def _sketch(buckets: int, k: int, pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            records = np.concatenate(held) if held else np.zeros(0, POSTING)
            held.clear()
            out = list(pack(records, (records["sig"] % U(buckets)).astype(np.int64)))
            if out:
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([POSTINGS] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "kind", "a", "b", "blob"])

        for batch in batches:
            ids = batch.column(0)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            for row, values, first in text_sets(batch.column(1), k):
                n = len(first) - 1
                sizes = np.diff(first)
                here = slice(row, row + n)
                for kind, each in ((DOC, COARSE), (ABOUT, FINE)):
                    yield _rows(kind, number[here], sizes, ~valid[here], pa.array(set_sketches(values, first, each), pa.binary()))
                new = np.zeros(n, bool)
                a, b = [], []
                for d in np.flatnonzero(valid[here] & (sizes > 0)):
                    part = values[first[d] : first[d + 1]]
                    key = (len(part), int(np.bitwise_xor.reduce(mix(part))), int(np.add.reduce(mix(part + U(1)))))
                    other = known.setdefault(key, me := int(number[row + d]))
                    if other == me:
                        new[d] = True
                    else:
                        a.append(other)
                        b.append(me)
                if a:
                    yield _rows(LINK, np.array(a), np.array(b))
                if new.any():
                    take = np.repeat(new, sizes)
                    sub = np.concatenate([[0], np.cumsum(np.where(new, sizes, 0))])
                    sig, doc = postings(values[take], sub, pct)
                    records = np.empty(len(sig), POSTING)
                    records["sig"], records["id"] = sig, number[row + doc]
                    held.append(records)
                    size += len(records)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
                if len(known) >= FLUSH:
                    known.clear()  # only lets some copies pass to the shuffle
        yield from flush()

    return run


def distinct_groups(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, id) of the different sets of documents that share a signature; a group's number depends on its documents alone."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])] if len(sig) else np.zeros(0, bool)
    sig, ids = sig[keep], ids[keep]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(sig)])
    first, count = first[count > 1], count[count > 1]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[U(0)], np.cumsum(mix(ids.astype(U) + U(0x2545F4914F6CDD1D)))])
    group = mix(total[first + count] - total[first] + count.astype(U))
    group, at = np.unique(group, return_index=True)
    first, count = first[at], count[at]
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return np.repeat(group, count).astype(np.int64), ids[rows]


def group_pairs(group: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of the ids that share a group, nearly each of them once; rows are sorted by group, then id."""
    names, at = np.unique(ids, return_inverse=True)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[first, len(group)])
    behind = np.repeat(first + count, count) - np.arange(len(group)) - 1
    held, size = [], 0
    for step in range(1, int(behind.max(initial=0)) + 1):
        left = np.flatnonzero(behind >= step)
        held.append(at[left] * len(names) + at[left + step])
        size += len(left)
        if size >= 4 * FLUSH:
            held = [seen := np.unique(np.concatenate(held))]
            size = len(seen)
            if size >= FLUSH:
                yield np.stack([names[seen // len(names)], names[seen % len(names)]], 1)
                held, size = [], 0
    if held:
        seen = np.unique(np.concatenate(held))
        yield np.stack([names[seen // len(names)], names[seen % len(names)]], 1)


def _meet(small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passes documents and links on, and turns the postings of a partition into pairs and, of groups of over `small` documents, (group, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["kind", "a", "b", "blob"]
        blobs: list[bytes] = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            if (plain := kind < MEMBER).any():
                yield batch.select(columns).filter(pa.array(plain))
            if not plain.all():
                blobs += batch.column(4).filter(pa.array(~plain)).to_pylist()
        records = unpack(blobs, POSTING)
        del blobs
        group, ids = distinct_groups(records["sig"], records["id"])
        del records
        if not len(group):
            return
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.r_[first, len(group)])
        few = np.repeat(count <= small, count)
        for pairs in group_pairs(group[few], ids[few]):
            for lo in range(0, len(pairs), 100_000):
                yield _rows(PAIR, pairs[lo : lo + 100_000, 0], pairs[lo : lo + 100_000, 1]).select(columns)
        group, ids = group[~few], ids[~few]
        for lo in range(0, len(group), 100_000):
            yield _rows(MEMBER, group[lo : lo + 100_000], ids[lo : lo + 100_000]).select(columns)

    return run


def _near(n: np.ndarray | int, sketch: np.ndarray, m: np.ndarray | int, other: np.ndarray, pct: int) -> np.ndarray:
    """Where sizes and sketches of one length do not rule a link out."""
    apart = np.bitwise_count(sketch ^ other).sum(1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= pct * np.maximum(n, m)) & (apart * (100 + pct) <= (100 - pct) * (n + m))


def plausible_forest(sig: np.ndarray, ids: np.ndarray, size: np.ndarray, sketches: list[bytes], pct: int) -> np.ndarray:
    """Pairs of rows that span, for each group, the graph of its pairs that sizes and sketches do not rule out.

    Rows are sorted by group.
    """
    if not len(sig):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    group = np.cumsum(np.r_[0, sig[1:] != sig[:-1]])
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = [at[_forest_of(group[at], size[at], rows, pct)] for at, rows in folded(sketches, np.minimum.reduceat(length, first)[group])]
    return np.concatenate(out)


def _forest_of(group: np.ndarray, size: np.ndarray, sketch: np.ndarray, pct: int) -> np.ndarray:
    total = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[first, total])
    behind = np.repeat(first + count, count) - np.arange(total) - 1
    behind[np.repeat(count > SMALL, count)] = 0
    a, b = [], []
    for step in range(1, int(behind.max(initial=0)) + 1):
        left = np.flatnonzero(behind >= step)
        for lo in range(0, len(left), 100_000):
            i = left[lo : lo + 100_000]
            hit = i[_near(size[i], sketch[i], size[i + step], sketch[i + step], pct)]
            a.append(hit)
            b.append(hit + step)
    for at, n in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
        # walk the graph of near pairs, each document once against those not reached yet
        left, reached = np.arange(at + 1, at + n), [at]
        while len(left):
            if not reached:
                reached, left = [int(left[0])], left[1:]
                continue
            me = reached.pop()
            close = _near(size[left], sketch[left], size[me], sketch[me], pct)
            a.append(np.full(int(close.sum()), me))
            b.append(left[close])
            reached += left[close].tolist()
            left = left[~close]
    root = joined(total, np.concatenate(a), np.concatenate(b)) if a else np.arange(total)
    rest = np.flatnonzero(root != np.arange(total))
    return np.stack([root[rest], rest], 1)


def _plausible(pct: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forests of groups of CHUNK documents at most, a bounded number of them at a time; before the last round, the (sig, id) of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forests(table: pa.Table) -> pa.RecordBatch:
            sig, ids = table["sig"].to_numpy(), table["id"].to_numpy()
            pairs = plausible_forest(sig, ids, table["n"].to_numpy(), table["sketch"].to_pylist(), pct)
            if not last:
                rows = np.unique(pairs)
                return pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(ids[rows])], ["sig", "id"])
            ends = np.unique(ids[pairs], axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
            ends = ends[ends[:, 0] != ends[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["src", "dst"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * CHUNK:
                table = pa.Table.from_batches(held)
                sig = table["sig"].to_numpy()
                whole = int(np.searchsorted(sig, sig[-1]))  # the last group may go on
                if whole:
                    yield forests(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield forests(pa.Table.from_batches(held))

    return run


def _near_rows(n: np.ndarray, sketches: list[bytes], m: np.ndarray, others: list[bytes], pct: int) -> np.ndarray:
    to = np.minimum(np.fromiter(map(len, sketches), np.int64, len(sketches)), np.fromiter(map(len, others), np.int64, len(others)))
    out = np.zeros(len(n), bool)
    for (at, a), (_, b) in zip(folded(sketches, to), folded(others, to), strict=True):
        out[at] = _near(n[at], a, m[at], b, pct)
    return out


def _not_apart(pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _near_rows(b["n"].to_numpy(), b["sketch"].to_pylist(), b["m"].to_numpy(), b["other"].to_pylist(), pct)
            yield b.select(["src", "dst"]).filter(pa.array(near))

    return run


def _first(pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with near: whether a document's link to its group's first is not ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _near_rows(b["n"].to_numpy(), b["sketch"].to_pylist(), b["first_n"].to_numpy(), b["first_sketch"].to_pylist(), pct)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("sig", "id", "n", "sketch", "first")), pa.array(near)], ["sig", "id", "n", "sketch", "first", "near"])

    return run


def _between(pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning pairs between the open documents of one chunk and those of another chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["sig", "x", "y"]):
            ids, n, is_open = table["id"].to_numpy(), table["n"].to_numpy(), table["left"].to_numpy()
            blobs = table["sketch"].to_pylist()
            _, sketch = next(folded(blobs, np.full(len(blobs), min(map(len, blobs)))))
            right = np.flatnonzero(~is_open)
            a, b = [], []
            for i in np.flatnonzero(is_open):
                hit = right[_near(n[right], sketch[right], n[i], sketch[i], pct)]
                a.append(np.full(len(hit), i))
                b.append(hit)
            root = joined(len(ids), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids)], ["src", "dst"]).filter(pa.array(ids[root] != ids))

    return run


def plausible_pairs(shared: DataFrame, about: DataFrame, pct: int, work: Workspace) -> DataFrame:
    """(src, dst) that span, for each group of shared (sig, id, n, coarse sketch), what sizes and about's fine sketches (id, n, sketch) do not rule out.

    Two documents that may link keep each other through the coarse sketches, so the fine ones judge every such pair.
    """
    pair = "src long, dst long"
    large = work.table(shared.groupBy("sig").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") > CHUNK))
    small = shared.join(large.select("sig"), "sig", "left_anti") if large.take(1) else shared
    by_group = lambda df: df.repartition("sig").sortWithinPartitions("sig")
    left = work.table(by_group(small).mapInArrow(_plausible(pct, False), "sig long, id long"))
    out = by_group(left.join(about, "id").select("sig", "id", "n", "sketch")).mapInArrow(_plausible(pct, True), pair)
    if not large.take(1):
        work.drop(shared)
        return out
    members = shared.select("sig", "id").join(large, "sig").join(about, "id")
    firsts = members.where("id = first").select("sig", F.col("n").alias("first_n"), F.col("sketch").alias("first_sketch"))
    judged = members.select("sig", "id", "n", "sketch", "first").join(firsts, "sig")
    judged = work.table(judged.mapInArrow(_first(pct), "sig long, id long, n long, sketch binary, first long, near boolean"))
    far = judged.where("not near").groupBy("sig").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("xs"))
    sizes = large.select("sig", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int").alias("ys")).join(far, "sig")
    rows = judged.select("sig", "id", "n", "sketch", "near").join(sizes, "sig")
    x, y = (F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("xs", "ys"))
    opened = rows.where("not near").withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1))).withColumn("left", F.lit(True))
    right = rows.withColumn("y", y).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1))).withColumn("left", F.lit(False))
    meet = ["sig", "x", "y"]
    both = opened.select(*meet, "id", "n", "sketch", "left").unionByName(right.select(*meet, "id", "n", "sketch", "left"))
    rest = both.repartition(*meet).sortWithinPartitions(*meet).mapInArrow(_between(pct), pair)
    return out.unionByName(judged.where("near and id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"))).unionByName(rest)


def likely_in(rows: DataFrame, key: Column, wanted: DataFrame, mark: str) -> DataFrame:
    """rows with a boolean column mark, which is true where wanted's one column has key; elsewhere it is mostly false."""
    place = lambda x: F.xxhash64(x.cast("long")).bitwiseAND(MAP - 1).cast("int")
    page, bits = f"page_{mark}", f"bits_{mark}"
    at = wanted.select(place(F.col(wanted.columns[0])).alias("at")).select((F.col("at") / PAGE).cast("int").alias(page), F.col("at").bitwiseAND(PAGE - 1).cast("long").alias("at"))
    pages = at.repartition(page).groupBy(page).agg(F.bitmap_construct_agg("at").alias(bits))
    byte = F.call_function("substring", F.col(bits), (place(key).bitwiseAND(PAGE - 1) / 8).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), place(key).bitwiseAND(7)).bitwiseAND(1) == 1
    return rows.withColumn(page, (place(key) / PAGE).cast("int")).join(F.broadcast(pages), page, "left").withColumn(mark, F.coalesce(bit, F.lit(False))).drop(page, bits)


def _to_sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, first in text_sets(batch.column(2), k):
                n = len(first) - 1
                part = batch.slice(row, n)
                sets = pa.array([values[first[d] : first[d + 1]].tobytes() for d in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["id", "cluster", "elements"]).filter(pa.array(np.diff(first) > 0))

    return run


def _parity(elements: np.ndarray, bits: int) -> np.ndarray:
    odd = (np.bincount((elements >> U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view("<u8")


def forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """Links that span the linked pairs of left with right rows (both are masks)."""
    n = len(ids)
    size = np.array([len(x) for x in sets])
    bits = 1 << min(13, max(6, int(2 * size.max(initial=1)).bit_length()))
    sketch = np.stack([_parity(x, bits) for x in sets]) if n > 8 else None
    root = np.arange(n)
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(left):
        js = np.flatnonzero(right & (np.arange(n) > i) if left[i] and right[i] else right)
        a, b = size[i], size[js]
        js = js[(100 * np.minimum(a, b) >= pct * np.maximum(a, b)) & (np.minimum(a, b) > 0)]
        if sketch is not None and len(js):
            apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(1, dtype=np.int64)
            near = apart * (100 + pct) <= (100 - pct) * (a + size[js])
            js, apart = js[near], apart[near]
            js = js[np.argsort(apart, kind="stable")]
        for j in js:
            if (x := find(i)) != (y := find(j)):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= pct * (size[i] + size[j] - common):
                    root[max(x, y)] = min(x, y)
                    if ids[i] != ids[j]:
                        out.append((int(ids[i]), int(ids[j])))
    return out


def _verify(pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in groups(batches, ["cluster", "class", "cross", "x", "y"]):
            sets = [np.frombuffer(v, "<u8") for v in table["elements"].to_pylist()]
            left, right = (table[c].to_numpy() for c in ("left", "right"))
            out += forest(table["id"].to_numpy(), sets, left, right, pct)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["src", "dst"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["src", "dst"])

    return run


def pairs_of_blocks(sets: DataFrame) -> DataFrame:
    """sets id, cluster, class, elements dealt to the pairs of blocks that they are compared in: cluster, class, cross, x, y, left, right.

    Sizes of linked sets differ by less than a class, so blocks of one class meet each other and those of the next class.
    """
    counts = sets.groupBy("cluster", "class").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    at = lambda step, name: counts.select("cluster", (F.col("class") + step).alias("class"), F.col("blocks").alias(name))
    rows = sets.join(counts, ["cluster", "class"]).join(at(-1, "above"), ["cluster", "class"], "left").join(at(1, "below"), ["cluster", "class"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own, me = F.col("class"), F.col("block")
    pair = lambda c, cross, x, y, left, right: F.struct(c.alias("class"), F.lit(cross).alias("cross"), x.alias("x"), y.alias("y"), left.alias("left"), right.alias("right"))
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(each("blocks"), lambda o: pair(own, False, F.least(me, o), F.greatest(me, o), me <= o, me >= o))
    up = F.transform(each("above"), lambda o: pair(own, True, me, o, F.lit(True), F.lit(False)))
    down = F.transform(each("below"), lambda o: pair(own - 1, True, o, me, F.lit(False), F.lit(True)))
    return rows.select("cluster", "id", "elements", F.explode(F.concat(within, up, down)).alias("p")).select("cluster", "p.*", "id", "elements")


def link_documents(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Words are lower-cased (A-Z) runs outside 0x20 and 0x09-0x0D of the whole text.  A
    text of fewer than k words has its whole sequence as its one shingle.  Null and
    empty texts have no shingles and are their own component.  Rows with a null id keep
    it, with a null component, and link with nothing.  Rows that share an id are one
    document: any of their texts may link it.  Equal and empty tables, ties: copies are linked like any pair, an empty
    table gives no rows.  Other columns are ignored.  pct is the
    similarity in hundredths, 50 to 99.
    """
    if not 50 <= pct <= 99 or k < 1:
        raise ValueError("pct is 50 to 99 and k at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(spark)
    with Workspace(spark) as work:
        every = judged(rows, k, pct, min(100, 2 * (100 - pct)), work)
        rows = rows.where("doc_id is not null")
        wanted = lambda rows, judged: likely_in(rows, F.col("doc_id"), judged.where("open and doc_id is not null").select("doc_id"), "likely").where("likely").select("doc_id", "text")
        may = wanted(rows, every)
        may = wanted(may, judged(may, k, pct, 100, work))  # few are left, so all their shingles are counted, among themselves
        found = work.table(may.mapInArrow(_sketch(buckets, k, pct), "bucket int, kind int, a long, b long, blob binary").repartition("bucket").mapInArrow(_meet(SMALL), FOUND))
        # each large table goes as soon as the next one is written
        members = found.where(f"kind = {MEMBER}").select(F.col("a").alias("sig"), F.col("b").alias("id"))
        coarse, about = (found.where(f"kind = {kind}").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("blob").alias("sketch")).dropDuplicates(["id", "n", "sketch"]) for kind in (DOC, ABOUT))
        pairs = work.table(found.where(f"kind = {PAIR}").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        shared = work.table(members.join(coarse, "id").select("sig", "id", "n", "sketch"))
        about, rest = work.table(about), work.table(found.where(f"kind = {LINK}").drop("blob"))
        work.drop(found)
        found = rest
        ends = pairs.join(about.withColumnRenamed("id", "src"), "src").join(about.select(F.col("id").alias("dst"), F.col("n").alias("m"), F.col("sketch").alias("other")), "dst")
        close = ends.select("src", "dst", "n", "sketch", "m", "other").mapInArrow(_not_apart(pct), "src long, dst long")
        members = connected_components(close.unionByName(plausible_pairs(shared, about, pct, work)), work=work).withColumnRenamed("component", "cluster")
        members = work.table(members)
        work.drop(pairs, about)
        texts = likely_in(rows, F.col("doc_id"), members.select("node"), "likely").where("likely")
        sets = work.table(
            members.join(texts, F.col("node") == F.col("doc_id"))
            .select("node", "cluster", "text")
            .mapInArrow(_to_sets(k), "id long, cluster long, elements binary")
            .withColumn("class", F.floor(F.log(F.octet_length("elements") / 8.0) / (math.log(100 / pct) * (1 + 1e-9))).cast("int"))
        )
        meet = ["cluster", "class", "cross", "x", "y"]
        links = pairs_of_blocks(sets).repartition(*meet).sortWithinPartitions(*meet).mapInArrow(_verify(pct), "src long, dst long")
        links = links.unionByName(found.where(f"kind = {LINK}").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        parts = connected_components(links, work=work)
        return settle(
            every.join(parts, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        )


def keep_first(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """docs without those that have a linked document of a smaller doc_id in their group; all columns stay.

    Rows with a null doc_id stay, and rows that share the kept doc_id stay together.
    """
    gone = link_documents(docs, k, pct).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    mark = f"likely_{uuid.uuid4().hex}"
    rows = likely_in(docs, docs["doc_id"], gone, mark)  # the others need not meet gone
    rest = rows.where(F.col(mark)).drop(mark)
    return rows.where(~F.col(mark)).drop(mark).unionByName(rest.join(gone, rest["doc_id"] == gone["gone"], "left_anti"))
