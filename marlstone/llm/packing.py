"""Harmonic packing of token sequences.

A document's ids, with an end id behind them, give as many full sequences as they hold. What remains, r ids, is of the
reciprocal-capacity class k where capacity/(k+1) < r <= capacity/k, and a bin of class k takes exactly k such remainders,
whole. A bin that has its k may have a gap; the worker's next document is cut to fill it, from its start, before
the rest of it is classified. So documents are cut at the capacity and for gaps only, at most one bin waits at any time,
and every worker packs alone.

At its end a worker has one open bin for each class at most. What these hold, and a bin that waits, is laid end to end:
full sequences again, and at last fewer ids, which are cut into their binary digits. So each sequence is full or a power
of two, and none is padded.

Sequence ids are the partition's number in the high bits and the worker's own count in the low 40, so they
are unique and come out the same when a lost task runs again. Null texts count as empty: one piece, the
end id. Rows are packed one by one; repeated rows are packed repeatedly, null ids as any other. Texts of any length are
encoded whole. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm import tokens

SCHEMA = T.StructType([T.StructField(name, T.LongType()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Piece:
    """Ids of one document from `start` on, little-endian unsigned 32-bit."""

    __slots__ = ("doc_id", "ids", "start", "length", "total")

    def __init__(self, doc_id: int | None, ids: bytes, start: int, length: int, total: int):
        self.doc_id, self.ids, self.start, self.length, self.total = doc_id, ids, start, length, total

    def cut(self, n: int) -> Piece:
        """The first n ids, which leave this piece."""
        head = Piece(self.doc_id, self.ids[: 4 * n], self.start, n, self.total)
        self.ids, self.start, self.length = self.ids[4 * n :], self.start + n, self.length - n
        return head


class Packer:
    """One worker's bins: rows of SCHEMA come out as sequences are settled."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[Piece] = []  # a bin that has its count and waits for its gap to be filled
        self.gap = 0

    def _settle(self, pieces: list[Piece]) -> list[tuple]:
        rows, at = [], 0
        for p in pieces:
            rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.total, self.next, at))
            at += p.length
        self.next += 1
        return rows

    def put(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Takes a document; the rows that it settles."""
        rows: list[tuple] = []
        piece = Piece(doc_id, ids, 0, len(ids) // 4, len(ids) // 4)
        if self.waiting:
            self.waiting.append(piece.cut(min(piece.length, self.gap)))
            self.gap -= self.waiting[-1].length
            if not self.gap:
                rows += self._settle(self.waiting)
                self.waiting = []
        while piece.length >= self.capacity:
            rows += self._settle([piece.cut(self.capacity)])
        if piece.length:
            k = self.capacity // piece.length
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:  # nothing waits here: this document had ids left behind the gap
                del self.open[k]
                self.gap = self.capacity - sum(p.length for p in held)
                if self.gap:
                    self.waiting = held
                else:
                    rows += self._settle(held)
        return rows

    def close(self) -> list[tuple]:
        """The rows of all that is open, laid end to end."""
        left = [*self.waiting, *(p for k in sorted(self.open) for p in self.open[k])]
        self.waiting, self.open = [], {}
        total, rows = sum(p.length for p in left), []
        rest = total % self.capacity
        for n in [self.capacity] * (total // self.capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]:
            sequence: list[Piece] = []
            while n:
                sequence.append(left[0].cut(min(n, left[0].length)))
                n -= sequence[-1].length
                if not left[0].length:
                    left.pop(0)
            rows += self._settle(sequence)
        return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long)."""
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.rest:
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        done: list[tuple] = []
        for whole in batches:
            for batch in (whole.slice(at, 4000) for at in range(0, len(whole), 4000)):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    done += packer.put(doc_id, ids + end)
                if len(done) >= 20_000:
                    yield table(done)
                    done = []
        yield table(done + packer.close())

    return docs.selectExpr("doc_id", "text").mapInArrow(run, SCHEMA)
