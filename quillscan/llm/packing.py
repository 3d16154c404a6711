"""Harmonic packing of token streams into fixed sequences.

Capacity C. A piece of s tokens is of class k = C // s, and a sequence of class k
holds exactly k pieces of that class. What a document leaves after its full
sequences is cut until each piece nearly fills its share C / k (within 1/64):
the head takes the full share of the next class, the tail is cut again.

Each worker (an input partition) fills its own sequences, one open for each
class, and needs no other worker: no shuffle, memory of at most one open
sequence for each class. What lies in open sequences at the end is laid end to
end and cut at the capacity; its last tokens form sequences whose sizes are
powers of two, so that nothing there is padded. A worker that is run again over
the same split gives the same pieces.

Null texts are empty documents (one end id), repeated rows are packed each, an
empty table gives no pieces; only the id and the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm import tok
from quillscan.llm.common import ship, text_of

FILL = 64  #: a piece stays whole if it leaves less than 1 / FILL of its share of a sequence empty

DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"


def shares(capacity: int) -> list[list[int]]:
    """For each size up to the capacity, the sizes of the pieces that it is cut into."""
    out: list[list[int]] = [[]]
    for size in range(1, capacity + 1):
        k = capacity // size
        if k * size * FILL >= (FILL - 1) * capacity:
            out.append([size])
        else:
            head = capacity // (k + 1)
            out.append([head, *out[size - head]])
    return out


class Packer:
    """Fills the sequences of one worker. A placed piece: (document, start, ids, tokens of its document, sequence, offset, class)."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.cuts, self.next = capacity, shares(capacity), worker << 40
        self.open: dict[int, list] = {}  # class: pieces not yet in a full sequence

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def lay(self, pieces: list, k: int) -> Iterator[tuple]:
        number, at = self.sequence(), 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, number, at, k
            at += len(ids) >> 2

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) >> 2, 0
        while total - at >= self.capacity:
            yield doc, at, ids[at * 4 : (at + self.capacity) * 4], total, self.sequence(), 0, 1
            at += self.capacity
        for size in self.cuts[total - at]:
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at * 4 : (at + size) * 4], total))
            at += size
            if len(held) == k:
                yield from self.lay(held, k)
                del self.open[k]

    def close(self) -> Iterator[tuple]:
        """The rest, end to end; its sequences are of class 0."""
        left = sum(len(ids) >> 2 for held in self.open.values() for _, _, ids, _ in held)
        room = at = number = 0
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    if not room:
                        size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                        left -= size
                        number, at, room = self.sequence(), 0, size
                    part = ids[: room * 4]
                    n = len(part) >> 2
                    yield doc, start, part, total, number, at, 0
                    ids, start, at, room = ids[n * 4 :], start + n, at + n, room - n
        self.open = {}


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: where its ids lie in its document and in which sequence and where they are put.

    class is the k of its sequence, 0 for those of the rest. with_ids adds the ids themselves (binary, little-endian unsigned 32 bits).
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    ship(docs.sparkSession)
    path = vocabulary or tok.vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, number, at, k = zip(*rows) if rows else ((),) * 7
        columns = [pa.array(doc, "int64"), pa.array(start, "int64"), pa.array([len(x) >> 2 for x in ids], "int64"), pa.array([zlib.crc32(x) for x in ids], "int64"), pa.array(total, "int64"), pa.array(number, "int64"), pa.array(at, "int64"), pa.array(k, "int32")]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        if with_ids:
            columns, names = [*columns, pa.array(ids, "binary")], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = tok.opened("byte", path), Packer(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tok.portions(texts):
                yield batch_of([row for doc, ids in zip(names[a:b], model.encode(texts[a:b])) for row in packer.add(doc, ids + end)])
        yield batch_of(list(packer.close()))

    kept = docs.select(F.col(doc_id).cast("long").alias("d"), text_of(text).alias("t"))
    return kept.mapInArrow(work, DIGEST + ", ids binary" * with_ids)
