"""Harmonic packing of tokenised documents into fixed-length sequences.

Whole sequences are cut off a document first; the rest stays whole.  Its class is the reciprocal of its
length, capacity // length, up to CLASSES, and each bin of class i takes exactly i documents, so a bin needs no search.
What a full bin then lacks is cut once from the front of the next document.  Every task packs its own
documents; nothing is shuffled.  At its end the pieces in unfinished bins are laid end to end and cut at capacity, and
the last stretch into powers of two, which need no padding.

No piece has fewer than SHORT tokens unless its document does: bins rather lack fewer than that many.  Only the last
stretch of a task, less than one sequence, may be cut anywhere.

Tokens of each word or letter run are computed once and kept in a bounded table: the
tokenizer parts text there before it merges, so they are independent.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.text_arrays import _IS_SPACE, _LOWER, Words, chunks, ranges, word_ranges
from clusterloom.operators.durable import short_batches

CAPACITY = 2048
END_ID = 1
#: Most documents of a bin.
CLASSES = 32
#: Least tokens of a piece of a longer document.
SHORT = 16
#: Units that a Python worker keeps the tokens of (about 40 MB).
TABLE = 200_000
#: Batches are handed on after so many pieces.
BATCH = 4_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Token ids of units by 64-bit hash, for a tokenizer that lowers case and merges within words.

    A unit is a white-space-delimited word; a word whose letters are all ASCII or Latin-1
    letters and that has no apostrophe is parted further, between letters and the rest, as the
    tokenizer's own pattern does.  Plain letter units go straight to the merge model and
    the others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.table: dict[int, bytes] = {}
        self.plain = re.compile("[a-zß-öø-ÿ]+")
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]  # fixed value: bytes that byte-level vocabularies write as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def encode(self, unit: bytes) -> bytes:
        text = unit.decode("utf-8", "replace")
        if self.plain.fullmatch(text):
            written = text if text.isascii() else "".join(map(self.symbols.__getitem__, unit))
            ids = [t.id for t in self.model.tokenize(written)]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def documents(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text."""
        words = units(data, bounds)
        keys, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.table) > TABLE:
            self.table = {}
        table = self.table
        values = list(map(table.get, names))
        new = [i for i, v in enumerate(values) if v is None]
        if new:
            body = words.data.tobytes()
            for i, a, b in zip(new, words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True):
                values[i] = table[names[i]] = self.encode(body[a:b])
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(size) - size
        lengths = size[inverse]
        total = np.cumsum(lengths)
        step = np.ones(int(total[-1]) if len(total) else 0, np.int32)
        if len(step):  # each unit's ids are a run of flat: sum up steps instead of adding ranges
            some = np.flatnonzero(lengths)
            first = begin[inverse[some]]
            heads = (total - lengths)[some]
            step[heads[0]] = first[0]
            step[heads[1:]] = first[1:] - (first[:-1] + lengths[some][:-1] - 1)
            np.cumsum(step, out=step)
        ids = flat[step]
        cuts = np.r_[0, total][words.first].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def units(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Units of the texts, ASCII and Latin-1 letters in lower case."""
    data = _LOWER[data]
    after = np.zeros(len(data), bool)  # second byte of a Latin-1 letter
    after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    upper = after & (data < 0x9F)
    data = data + 0x20 * upper.astype(np.uint8)
    begin, end = word_ranges(data, bounds)
    lead = np.zeros(len(data), bool)
    lead[:-1] = after[1:]
    odd = ((data >= 0x80) & ~after & ~lead) | (data == 0x27)
    whole = np.r_[0, np.cumsum(odd)]
    letter = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    part = np.zeros(len(data), bool)
    part[1:] = (letter[1:] != letter[:-1]) & ~_IS_SPACE[data[1:]] & ~_IS_SPACE[data[:-1]]
    cut = np.flatnonzero(part)
    if len(cut):
        word = np.searchsorted(begin, cut, side="right") - 1
        cut = cut[(whole[end[word]] == whole[begin[word]]) & (cut > begin[word])]
    return ranges(data, _merge(begin, cut, len(data)), _merge(end, cut, len(data)), bounds)


def _merge(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, bool)
    mark[a] = True
    mark[b] = True
    return np.flatnonzero(mark)


Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Bins of one task; rows are (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.short = min(SHORT, capacity // 4)
        self.open: dict[int, list[Piece]] = {}
        self.lacking: list[Piece] = []
        self.lack = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def _full(self, pieces: list[Piece]) -> None:
        """A bin with all its documents: it waits for the next document if it lacks enough."""
        lack = self.capacity - sum(len(p[2]) for p in pieces)
        if lack < self.short:
            self._close(pieces)
        else:
            self.lacking, self.lack = pieces, lack

    def _cut(self, length: int, room: int) -> int:
        """Most tokens, room at most, to cut off a piece of `length` without a short one on either side; 0 if there are none."""
        if length <= room:
            return length
        cut = min(room, length - self.short)
        return cut if cut >= self.short else 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while self.lacking and at < total:
            cut = self._cut(total - at, self.lack)
            if cut:
                self.lacking.append((doc, at, ids[at : at + cut], total))
                at, self.lack = at + cut, self.lack - cut
            if not cut or self.lack < self.short:
                self._close(self.lacking)
                self.lacking = []
        while total - at >= self.capacity:
            cut = self._cut(total - at, self.capacity)
            self._close([(doc, at, ids[at : at + cut], total)])
            at += cut
        if at < total:
            count = min(CLASSES, self.capacity // (total - at))
            held = self.open.setdefault(count, [])
            held.append((doc, at, ids[at:], total))
            if len(held) == count:
                del self.open[count]
                self._full(held)

    def finish(self) -> None:
        rest = [*self.lacking, *(p for c in sorted(self.open) for p in self.open[c])]
        self.open, self.lacking = {}, []
        left = sum(len(p[2]) for p in rest)
        held: list[Piece] = []
        room = self._room(left)
        for doc, start, ids, total in rest:
            while len(ids):
                take = min(room, len(ids)) if room < self.capacity and left < self.capacity else self._cut(len(ids), room)
                if take:
                    held.append((doc, start, ids[:take], total))
                    ids, start, left, room = ids[take:], start + take, left - take, room - take
                if not take or not room or room < self.short and left + room >= self.capacity:
                    self._close(held)
                    held, room = [], self._room(left)
        if held:
            self._close(held)

    def _room(self, left: int) -> int:
        return min(self.capacity, 1 << left.bit_length() - 1) if left else 0


def _pack(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _tokens(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, last, data, bounds in chunks(batch.column(1)):
                for doc, ids in zip(names[row:last], tokens.documents(data, bounds), strict=True):
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.rows) > BATCH:
                    yield _batch(packer)
        packer.finish()
        yield _batch(packer)

    return run


_kept: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    """One table for each Python worker."""
    if path not in _kept:
        _kept[path] = WordTokens(path)
    return _kept[path]


def _batch(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    size = np.array([len(r[2]) for r in rows], np.int64)
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(size * 4, out=offsets[1:])
    ids = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.uint32)
    column = lambda i: pa.array([r[i] for r in rows], pa.int64())
    blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
    return pa.RecordBatch.from_arrays([column(0), column(1), pa.array(size), blob, column(3), column(4), column(5)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are little-endian unsigned 32-bit token ids.  A document's tokens are those of
    its whole text, then end_id; a null or empty text is end_id alone.  Pieces of a sequence
    lie gapless from offset 0.  Repeated rows are packed each for itself; a null id
    stays null.  Other columns are ignored.  An empty table gives no rows.  A sequence of
    exactly a power of two needs no padding; the others are padded to capacity.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, capacity, end_id), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
