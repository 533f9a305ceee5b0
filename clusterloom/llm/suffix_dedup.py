"""Repeated byte strings by run-length (BWT) indexes of the repetitive parts.

A byte goes if a LENGTH-byte string that covers it starts earlier too.  Three exchanges:

1. Anchors.  Of every LENGTH - GRAM + 1 neighbouring GRAM-byte strings the one of least
   hash (leftmost of equals) is an anchor, so each LENGTH-byte string holds one, at an
   offset that its bytes alone decide.  Anchors are dealt by hash with a hash of their context
   (REACH bytes on both sides, all that strings through the anchor can touch).
   An anchor whose context stands earlier is marked over the whole context.  Contexts that are the
   first of their kind are asked for only if their anchor has several kinds.
2. Contexts.  The asked contexts are cut from the texts and dealt by anchor again.
3. Indexes.  A task takes the contexts of an anchor in the order of their places, in blocks of INDEX.  It sorts the suffixes
   of a block and keeps the run-compressed Burrows-Wheeler transform with the text positions at both ends of each run.
   Within a block every context is walked through the index by LF steps; runs do not cross the borders of LENGTH-byte classes
   there, and each keeps the least place of its class, so a step shows whether the LENGTH bytes at that
   offset start earlier.  From one block to later ones matching statistics are streamed: where a step leaves its run, it goes on at
   the sampled end of the nearest run of that byte, whichever shares more, and a match of LENGTH bytes is a mark.  An index of up to
   REFERENCE earlier contexts serves all later ones of the anchor, so blocks meet in halves, quarters and so on.

Marks then meet their texts.  Text outside repeated anchors never enters an index, and
a copy within one map task is marked there, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.blobs import FLUSH, bucket_count, pack, unpack
from clusterloom.llm.text_arrays import U, chunks, mix, prefix_hash
from clusterloom.operators.durable import Workspace, settle

LENGTH = 100
GRAM = 20
REACH = LENGTH - GRAM
WIDTH = 2 * REACH + GRAM
ANCHOR = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("right", "u1")])
ASKED = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("pos", "<u4")])
MARK = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
CONTEXT = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (WIDTH,))])
#: Contexts of one block of an anchor, and of several anchors that share an index; a small index stays in the processor's cache.
INDEX, TOGETHER = 1200, 300
#: Most contexts of an index that later contexts are streamed through (about 100 MB).
REFERENCE = 4096
#: Contexts that are streamed through an index at a time, and contexts that a task holds before it packs them (8 MB).
QUERIES, HELD = 2048, 40_000
MARKS, ANCHORS, ASKS, CONTEXTS, TEXT = 0, 1, 2, 3, 4
ROWS = "bucket int, kind int, blob binary"


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor hash, text) of the anchors; texts below LENGTH bytes have none."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    total, down = prefix_hash(data)
    m = n - GRAM + 1
    gram = mix((total[GRAM:] - total[:m]) * down[:m])
    key = (gram >> U(34) << U(34)) | np.arange(m, dtype=U)
    low, size = key, 1  # least key of the next `size` grams
    while 2 * size <= REACH + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = REACH + 1 - size
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    inside = np.zeros(n + 1, np.int32)  # string starts that stay within their text
    long = np.flatnonzero(np.diff(bounds) >= LENGTH)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long + 1] - LENGTH + 1, -1)
    at = (low[np.cumsum(inside)[: len(low)] > 0] & U((1 << 34) - 1)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, gram[at], np.searchsorted(bounds, at, side="right") - 1


def anchor_records(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    at, gram, text = anchors(data, bounds)
    total, down = prefix_hash(data)
    left = np.minimum(at - bounds[text], REACH)
    right = np.minimum(bounds[text + 1] - at - GRAM, REACH)
    out = np.empty(len(at), ANCHOR)
    out["anchor"] = gram
    out["context"] = mix((total[at + GRAM + right] - total[at - left]) * down[at - left] + (left * 256 + right).astype(U))
    out["doc"], out["pos"], out["right"] = doc[text], at - bounds[text], right
    return out


def first_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """records in order of anchor, context, document and position, and where each context's first stands."""
    records = records[np.lexsort((records["pos"], records["doc"], records["context"], records["anchor"]))]
    new = np.ones(len(records), bool)
    new[1:] = (records["anchor"][1:] != records["anchor"][:-1]) | (records["context"][1:] != records["context"][:-1])
    return records, new


def whole_marks(records: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Marks over the contexts of all but the firsts; an occurrence equal to its first (a repeated row) is not later."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (records["doc"] != records["doc"][head]) | (records["pos"] != records["pos"][head])
    r = records[later]
    out = np.empty(len(r), MARK)
    out["doc"] = r["doc"]
    out["lo"] = r["pos"] - np.minimum(r["pos"], REACH)
    out["hi"] = r["pos"] + GRAM + r["right"]
    return out[out["hi"] - out["lo"] >= LENGTH]


def merged(marks: np.ndarray) -> np.ndarray:
    """Disjoint marks, sorted by document and position."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks["lo"], marks["doc"]))]
    doc = np.cumsum(np.r_[True, marks["doc"][1:] != marks["doc"][:-1]]).astype(np.int64)
    reach = np.maximum.accumulate(marks["hi"].astype(np.int64) + (doc << 32))  # documents are far apart, so one scan serves all
    new = np.r_[True, marks["lo"][1:].astype(np.int64) + (doc[1:] << 32) > reach[:-1]]
    at = np.flatnonzero(new)
    out = marks[at].copy()
    out["hi"] = (reach[np.r_[at[1:] - 1, len(marks) - 1].astype(int)] & 0xFFFFFFFF).astype(np.uint32)
    return out


def _rows(kind: int, packed: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(packed), 1000):
        part = packed[lo : lo + 1000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([x[1] for x in part], pa.binary())], ["bucket", "kind", "blob"])


def _send_by_anchor(kind: int, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    return _rows(kind, list(pack(records, (mix(records["anchor"]) % U(buckets)).astype(np.int64))))


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document; `remove_repeats` computes the same in Spark."""
    return (doc % 1000003 * 7919 + doc // 1000003 % 1000003) % buckets


def _send_by_doc(kind: int, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    return _rows(kind, list(pack(records, _doc_bucket(records["doc"], buckets))))


def _find(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            records, new = first_of(np.concatenate(held) if held else np.zeros(0, ANCHOR))
            held.clear()
            yield from _send_by_doc(MARKS, merged(whole_marks(records, new)), buckets)
            yield from _send_by_anchor(ANCHORS, records[new], buckets)

        for batch in batches:
            doc = batch.column(0).to_numpy()
            for row, last, data, bounds in chunks(batch.column(1)):
                held.append(anchor_records(data, bounds, doc[row:last]))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _split(batches: Iterator[pa.RecordBatch], kind: int) -> tuple[list[bytes], list[pa.RecordBatch]]:
    """Blobs of a kind, and the other rows."""
    blobs, rest = [], []
    for batch in batches:
        is_kind = pa.array(batch.column(1).to_numpy() == kind)
        blobs += batch.column(2).filter(is_kind).to_pylist()
        other = batch.filter(pa.compute.invert(is_kind))
        if other.num_rows:
            rest.append(other)
    return blobs, rest


def _ask(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, rest = _split(batches, ANCHORS)
        yield from rest
        records, new = first_of(unpack(blobs, ANCHOR))
        del blobs
        yield from _send_by_doc(MARKS, merged(whole_marks(records, new)), buckets)
        kinds = records[new]
        if len(kinds):
            edge = np.r_[True, kinds["anchor"][1:] != kinds["anchor"][:-1]]
            group = np.cumsum(edge) - 1
            kinds = kinds[np.bincount(group)[group] > 1]
        asked = np.empty(len(kinds), ASKED)
        for f in ASKED.names:
            asked[f] = kinds[f]
        yield from _send_by_doc(ASKS, asked, buckets)

    return run


def context_records(data: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Contexts of one text's asked anchors."""
    out = np.zeros(len(asked), CONTEXT)
    pos = asked["pos"].astype(np.int64)
    for f in ("anchor", "doc", "pos"):
        out[f] = asked[f]
    out["left"] = np.minimum(pos, REACH)
    out["right"] = np.minimum(len(data) - pos - GRAM, REACH)
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(REACH, np.uint8)])
    out["bytes"] = padded[pos[:, None] + np.arange(WIDTH)]
    return out


def _texts_with(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(doc, bytes, its records) of each text, in a stream sorted by bucket with records before texts."""
    bucket, blobs, records = None, [], None
    for batch in batches:
        b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(batch.num_rows):
            if b[i] != bucket:
                bucket, blobs, records = b[i], [], None
            if kind[i] != TEXT:
                blobs.append(batch.column(2)[i].as_py())
                continue
            if records is None:
                records = unpack(blobs, dtype)
                records = records[np.argsort(records["doc"], kind="stable")]
                blobs = []
            doc = batch.column(3)[i].as_py()
            lo, hi = np.searchsorted(records["doc"], [doc, doc + 1]) if doc is not None else (0, 0)
            yield doc, np.frombuffer(batch.column(4)[i].as_py() or b"", np.uint8), records[lo:hi]


def _cut(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, asked in _texts_with(batches, ASKED):
            asked = asked[asked["pos"].astype(np.int64) + GRAM <= len(data)]
            if len(asked):
                held.append(context_records(data, asked))
                size += len(held[-1])
            if size >= HELD:
                yield from _send_by_anchor(CONTEXTS, np.concatenate(held), buckets)
                held, size = [], 0
        if held:
            yield from _send_by_anchor(CONTEXTS, np.concatenate(held), buckets)

    return run


class RunIndex:
    """Run-compressed BWT of texts of equal width, each closed by an end mark of its own; end marks sort first.

    Rows are suffixes.  A run is a stretch of rows of one preceding symbol.  Kept are each run's symbol, first row and LF
    target, and the text positions at both its ends.  With places, runs end at the borders of classes, too (the rows whose first LENGTH
    symbols are equal), and each knows the least place in its class; a place orders string starts by document and position.
    """

    def __init__(self, texts: np.ndarray, places: np.ndarray | None = None) -> None:
        n, width = texts.shape
        self.n, self.width = n, width + 1
        flat = np.empty((n, width + 1), np.int64)
        flat[:, :width] = texts + n
        flat[:, width] = np.arange(n)
        self.flat = flat = flat.reshape(-1)
        rank = self._dense(self._pair(flat, flat, 1), self._pair(flat, flat, 1), 2)
        size = 4
        while size < 64:
            rank = self._dense(rank, rank, size)
            size *= 2
        order = np.argsort(self._pair(self._dense(rank, rank, 64), rank, 128))  # 192 symbols hold every text with its end mark
        before = np.roll(flat, 1)[order]
        new = np.r_[True, before[1:] != before[:-1]]
        if places is not None:
            cls = self._dense(rank, rank, LENGTH - 64)[order]
            edge = np.r_[True, cls[1:] != cls[:-1]]
            new |= edge
            of_class = np.minimum.reduceat(places.reshape(-1)[order], np.flatnonzero(edge))
            self.least = of_class[(np.cumsum(edge) - 1)[new]]
        self.start = np.flatnonzero(new)
        self.symbol = before[self.start]
        lf = np.empty(len(order), np.int64)  # rows of a preceding symbol keep their order among the suffixes that begin with it
        lf[np.argsort(before, kind="stable")] = np.arange(len(order))
        self.target = lf[self.start]
        self.last = np.r_[self.start[1:], len(order)] - 1
        self.ends = np.stack([order[self.start], order[self.last]], 1)
        self.by_symbol = np.sort(self.symbol * len(self.start) + np.arange(len(self.start)))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        out = a * (int(b.max()) + 1)
        out[: len(b) - by] += b[by:]
        return out

    @classmethod
    def _dense(cls, a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        """Ranks of the pairs (a[i], b[i + by])."""
        key = cls._pair(a, b, by)
        order = np.argsort(key)
        key = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        return out

    def stream(self) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, least place of the LENGTH-byte match there) of all texts, from their ends to their starts."""
        row = np.arange(self.n)
        for offset in range(self.width - 2, -1, -1):
            run = np.searchsorted(self.start, row, side="right") - 1
            row = self.target[run] + row - self.start[run]
            yield offset, self.least[np.searchsorted(self.start, row, side="right") - 1]

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the texts at positions a and b share, at most `most` of them."""
        step = np.arange(int(most.max(initial=0)) + 1)
        size = len(self.flat)
        same = self.flat[(a[:, None] + step) % size] == self.flat[(b[:, None] + step) % size]
        same[:, -1] = False
        return np.minimum(most, same.argmin(1))

    def statistics(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, length, position): for each query the longest match of what follows the offset, and where the texts hold it."""
        runs, size = len(self.start), len(self.flat)
        row, length = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        at = np.full(len(queries), self.ends[0, 0])
        for offset in range(queries.shape[1] - 1, -1, -1):
            c = queries[:, offset] + self.n
            run = np.searchsorted(self.start, row, side="right") - 1
            away = np.flatnonzero(self.symbol[run] != c)
            lost = np.zeros(len(queries), bool)
            if len(away):
                k = np.searchsorted(self.by_symbol, c[away] * runs + run[away])
                sides = []
                for j, end in ((k - 1, 1), (k, 0)):
                    key = self.by_symbol[np.clip(j, 0, runs - 1)]
                    there = (j >= 0) & (j < runs) & (key // runs == c[away])
                    to = np.where(there, key % runs, 0)
                    position = self.ends[to, end]
                    sides.append((np.where(there, self._shared(at[away], position, length[away]), -1), to, position, self.last[to] if end else self.start[to]))
                (above, *up), (below, *down) = sides
                first = above >= below
                run[away], at[away], row[away] = (np.where(first, u, d) for u, d in zip(up, down, strict=True))
                length[away] = np.maximum(above, below)
                lost = length < 0
            row = np.where(lost, 0, self.target[run] + row - self.start[run])
            at = np.where(lost, self.ends[0, 0], (at - 1) % size)
            length += 1
            yield offset, length, at


def _masked(contexts: np.ndarray) -> np.ndarray:
    """Bytes of contexts, and 256 outside their texts."""
    at = np.arange(WIDTH)
    inside = (at >= REACH - contexts["left"][:, None].astype(int)) & (at < REACH + GRAM + contexts["right"][:, None].astype(int))
    return np.where(inside, contexts["bytes"].astype(np.int64), 256)


def _hits(contexts: np.ndarray, hit_of: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Marks from (bytes before the anchor, contexts whose string there stands earlier)."""
    pos = contexts["pos"].astype(np.int64)
    lo, hi = np.full(len(pos), 1 << 40), np.full(len(pos), -1)
    for back, hit in hit_of:
        start = pos[hit] - back
        lo[hit] = np.minimum(lo[hit], start)
        hi[hit] = np.maximum(hi[hit], start + LENGTH)
    keep = hi >= 0
    out = np.empty(int(keep.sum()), MARK)
    out["doc"], out["lo"], out["hi"] = contexts["doc"][keep], lo[keep], hi[keep]
    return out


def _places(contexts: np.ndarray) -> np.ndarray:
    doc = np.unique(contexts["doc"], return_inverse=True)[1].astype(np.int64)
    return (doc << 34) + contexts["pos"]


def _valid(contexts: np.ndarray, back: int) -> np.ndarray:
    return (contexts["left"] >= back) & (contexts["right"] >= REACH - back)


def index_marks(contexts: np.ndarray) -> np.ndarray:
    """For each context the extent of its LENGTH-byte strings through the anchor that start earlier, by a run index."""
    place = _places(contexts)
    index = RunIndex(_masked(contexts), place[:, None] + np.arange(WIDTH + 1))

    def hits() -> Iterator[tuple[int, np.ndarray]]:
        for offset, least in index.stream():
            if offset <= REACH:
                yield REACH - offset, _valid(contexts, REACH - offset) & (least < place + offset)

    return _hits(contexts, hits())


def later_marks(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Marks on the later contexts of an anchor: their LENGTH-byte strings through it that its earlier contexts hold.

    Contexts of one text may overlap, so that a match is the string itself or starts behind it.  A string stands earlier only if an
    earlier context has it at the same offset; that is looked up for such matches.
    """
    both = _places(np.concatenate([earlier, later]))
    before, place = both[: len(earlier)], both[len(earlier) :]
    index = RunIndex(_masked(earlier))

    def hits(queries: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for offset, length, at in index.statistics(_masked(queries)):
            if offset > REACH:
                continue
            hit = (length >= LENGTH) & _valid(queries, REACH - offset)
            found = np.flatnonzero(hit & (before[at // index.width] + at % index.width >= place + offset))
            for i in found:
                same = (earlier["bytes"][:, offset : offset + LENGTH] == queries["bytes"][i, offset : offset + LENGTH]).all(1)
                hit[i] = (same & _valid(earlier, REACH - offset) & (before < place[i])).any()
            yield REACH - offset, hit

    parts = [slice(lo, lo + QUERIES) for lo in range(0, len(later), QUERIES)]  # so memory does not grow with an anchor's contexts
    return np.concatenate([np.zeros(0, MARK), *(_hits(later[part], hits(later[part], place[part])) for part in parts)])


def anchor_marks(contexts: np.ndarray) -> list[np.ndarray]:
    """Marks on one anchor's contexts, any number of them: blocks by themselves, then earlier halves against later ones."""
    contexts = contexts[np.argsort(_places(contexts), kind="stable")]

    def within(lo: int, hi: int) -> Iterator[np.ndarray]:
        if hi - lo <= INDEX:
            yield index_marks(contexts[lo:hi])
            return
        middle = lo + INDEX * -(-(hi - lo) // (2 * INDEX))
        yield from within(lo, middle)
        yield from within(middle, hi)
        for part in range(lo, middle, REFERENCE):
            yield later_marks(contexts[part : min(part + REFERENCE, middle)], contexts[middle:hi])

    return list(within(0, len(contexts)))


def _index(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = unpack(_split(batches, CONTEXTS)[0], CONTEXT)
        order = np.argsort(contexts["anchor"], kind="stable")
        anchor = contexts["anchor"][order]
        cut = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int), len(anchor)]
        lo = 0
        found = []
        while lo < len(cut) - 1:
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + TOGETHER, side="right")) - 1)
            part = contexts[order[cut[lo] : cut[hi]]]
            found += [index_marks(part)] if len(part) <= TOGETHER else anchor_marks(part)
            lo = hi
        if found:
            yield from _send_by_doc(MARKS, merged(np.concatenate(found)), buckets)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        spans = [r[2] for r in rows]
        flat = np.concatenate(spans) if rows else np.zeros(0, MARK)
        offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(flat["lo"].astype(np.int64)), pa.array(flat["hi"].astype(np.int64))], ["start", "end"])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    for doc, data, marks in _texts_with(batches, MARK):
        marks = merged(marks)
        if len(marks):
            keep = np.zeros(len(data) + 1, np.int8)
            keep[marks["lo"]] = 1
            np.subtract.at(keep, np.minimum(marks["hi"], len(data)), 1)
            kept = data[np.cumsum(keep[:-1], dtype=np.int8) == 0].tobytes()
        else:
            kept = data.tobytes()
        rows.append((doc, len(data), marks, kept))
        size += len(data)
        if size > 4 << 20:
            yield out()
            rows.clear()
            size = 0
    yield out()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: removed [start, end) byte spans and the bytes that stay.

    Documents are ordered by doc_id.  An empty table gives no rows.  Null texts are empty.  Rows with a null id keep
    all their bytes and remove none.  Rows that share an id are one document to each other: the same
    position in both is one start, so equal rows stay alike.  Other columns are ignored.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slot = F.expr(f"cast(pmod(pmod(doc_id, 1000003) * 7919 + pmod(cast((doc_id - pmod(doc_id, 1000003)) div 1000003 as long), 1000003), {buckets}) as int)")
    texts = rows.select(F.coalesce(slot, F.lit(0)).alias("bucket"), F.lit(TEXT).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", F.col("text").cast("binary").alias("text"))
    wide = lambda df: df.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("binary")})
    meet = lambda df: wide(df).unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")
    with Workspace(spark) as work:
        found = work.table(rows.where("doc_id is not null").mapInArrow(_find(buckets), ROWS).repartition("bucket").mapInArrow(_ask(buckets), ROWS))
        contexts = work.table(meet(found.where(f"kind = {ASKS}")).mapInArrow(_cut(buckets), ROWS))
        marks = settle(found.where(f"kind = {MARKS}").unionByName(contexts.repartition("bucket").mapInArrow(_index(buckets), ROWS)))
    return meet(marks).mapInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
