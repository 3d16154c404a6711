"""Token ids in wavelet matrix files.

A shard is one file: a header, its documents' ids and lengths, a directory, and
for each bit of a token id a plane of bits. A plane is cut into blocks of SPAN
bytes that are compressed on their own; the directory has each block's place and
the ones before it. Token access, counting and occurrence lookup read a block or
two of each plane, from bytes in memory or from an open file; decode() restores
all ids.

write() encodes, then sorts the ids by document id over contiguous ranges (ties by
a hash of the ids, so that even one repeated id is dealt out), and leaves a table
in the shared folder with one row for each file: (part, shard, n_docs, n_tokens,
file). A range is cut into further files at about shard_tokens tokens, so neither
a file nor a worker's memory grows with the input, but for a single very long text,
which is encoded whole. export() writes the files out.

Null texts are empty documents (one end id), null ids sort first, repeated rows
are written each, an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm import tok
from quillscan.llm.common import drop, ship, stash, text_of

MAGIC, VERSION = b"QSWM", 2
SPAN = 4096  #: bytes of a plane that are compressed together
HEAD = struct.Struct("<4sHHqqq")  # magic, version, bits, documents, tokens, bytes of the compressed part on documents
_ONES = np.array([bin(i).count("1") for i in range(256)], "u1")


def build(docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of a shard. known: whether a document's id is not null."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    about = squeeze(docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + np.packbits(known).tobytes())
    left = ids.astype("u2") if bits <= 16 else ids.astype("u4")
    blocks, places, ones, at = [], [], [], 0
    for b in range(bits - 1, -1, -1):
        bit = (left >> b & 1).astype(bool)
        plane, seen = np.packbits(bit), 0
        for i in range(0, len(plane), SPAN):
            part = plane[i : i + SPAN]
            blocks.append(squeeze(part.tobytes()))
            places.append(at)
            ones.append(seen)
            at, seen = at + len(blocks[-1]), seen + int(_ONES[part].sum(dtype="i8"))
        places.append(at)
        ones.append(seen)
        left = np.concatenate((left.compress(~bit), left.compress(bit)))
    table = np.array([places, ones], "<i8").T.tobytes()
    return HEAD.pack(MAGIC, VERSION, bits, len(docs), len(ids), len(about)) + about + table + b"".join(blocks)


class WaveletMatrix:
    """Reads a shard's file: bytes, or an open file, of which only what is asked for is read. bytes_read counts."""

    def __init__(self, file):
        self._file, self.bytes_read = file, 0
        magic, version, self.bits, self.n_docs, self.n, about = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet matrix file")
        self._about = HEAD.size, about
        self._blocks = -(-self.n // (8 * SPAN))  # of a plane
        rows = self.bits * (self._blocks + 1)
        at = HEAD.size + about
        table = np.frombuffer(self._read(at, 16 * rows), "<i8").reshape(self.bits, self._blocks + 1, 2)
        self._places, self._before, self._start = table[:, :, 0], table[:, :, 1], at + 16 * rows
        self._held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        if isinstance(self._file, (bytes, memoryview)):
            return self._file[at : at + n]
        self._file.seek(at)
        return self._file.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether each is not null, and sizes."""
        raw = zstandard.ZstdDecompressor().decompress(self._read(*self._about))
        numbers = np.frombuffer(raw, "<i8", count=2 * self.n_docs)
        known = np.unpackbits(np.frombuffer(raw, "u1", offset=16 * self.n_docs), count=self.n_docs).astype(bool)
        return numbers[: self.n_docs], known, numbers[self.n_docs :]

    def _block(self, level: int, block: int) -> np.ndarray:
        """A block's bytes; the last 64 blocks used are held."""
        if (level, block) not in self._held:
            a, b = int(self._places[level, block]), int(self._places[level, block + 1])
            self._held[level, block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(self._start + a, b - a)), "u1")
            if len(self._held) > 64:
                self._held.popitem(last=False)
        return self._held[level, block]

    def _zeros(self, level: int) -> int:
        return self.n - int(self._before[level, -1])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, 8 * SPAN)
        out = int(self._before[level, block])
        if rest:
            plane = self._block(level, block)
            out += int(_ONES[plane[: rest // 8]].sum(dtype="i8"))
            out += bin(int(plane[rest // 8]) >> (8 - rest % 8)).count("1") if rest % 8 else 0
        return out

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            block, rest = divmod(i, 8 * SPAN)
            bit = int(self._block(level, block)[rest // 8]) >> (7 - rest % 8) & 1
            ones = self._ones(level, i)
            i = self._zeros(level) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs among the first i."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = 0, min(i, self.n)
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self._zeros(level) + x, self._zeros(level) + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of a plane."""
        ones = self._before[level]
        before = ones if bit else np.minimum(np.arange(len(ones), dtype="i8") * 8 * SPAN, self.n) - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        rest = np.unpackbits(self._block(level, block))
        return block * 8 * SPAN + int(np.flatnonzero(rest == bit)[j - int(before[block])])

    def select(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of a token."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        a = 0
        for level in range(self.bits):
            ones = self._ones(level, a)
            a = self._zeros(level) + ones if token >> (self.bits - 1 - level) & 1 else a - ones
        at = a + j
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self._zeros(level) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane to the first."""
        out = np.zeros(self.n, "u2" if self.bits <= 16 else "u4")
        open_ = zstandard.ZstdDecompressor().decompress
        for level in range(self.bits - 1, -1, -1):
            a, b = int(self._places[level, 0]), int(self._places[level, -1])
            held, cuts = self._read(self._start + a, b - a), (self._places[level] - a).tolist()
            plane = np.frombuffer(b"".join([open_(held[x:y]) for x, y in zip(cuts, cuts[1:])]), "u1")
            bit, zeros = np.unpackbits(plane, count=self.n).view(bool), self._zeros(level)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:zeros]
            up[np.flatnonzero(bit)] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = up
        return out.astype("<u4")


def write(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, kind: str = "word", end_id: int = 1, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode the documents in ascending order of their ids and write the shards' files; returns the table that holds them."""
    ship(docs.sparkSession)
    path = vocabulary or tok.vocabulary("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tok.opened(kind, path)
        width = "<u2" if max(model.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tok.portions(texts):
                ids = model.encode(texts[a:b])
                sizes = np.array([len(x) // 4 + 1 for x in ids], "i8")
                flat = np.frombuffer(end.join([*ids, b""]), "<u4").astype(width)
                offsets = np.concatenate(([0], np.cumsum(sizes) * flat.itemsize)).astype("i4")
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), held], ["d", "n", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, tokens = TaskContext.get().partitionId(), 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # ids of documents, whether known, sizes, tokens

        def file() -> pa.RecordBatch:
            names, known, sizes, ids = (np.concatenate(x) for x in zip(*parts))
            made = build(names, known, sizes, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], "int32"), pa.array([shard], "int32"), pa.array([len(names)], "int64"), pa.array([len(ids)], "int64"), pa.array([made], "binary")], ["part", "shard", "n_docs", "n_tokens", "file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.asarray(batch.column(0).is_valid())
            names, sizes = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(1))
            column = batch.column(2)
            offsets = np.frombuffer(column.buffers()[1], "<i4", count=len(column) + 1, offset=4 * column.offset)
            width = (int(offsets[-1]) - int(offsets[0])) // int(sizes.sum())
            flat = np.frombuffer(column.buffers()[2], f"<u{width}", count=int(sizes.sum()), offset=int(offsets[0]))
            ends, at = np.cumsum(sizes), 0
            while at < len(names):  # a file ends with the document that fills it
                before = int(ends[at - 1]) if at else 0
                upto = min(int(np.searchsorted(ends, before + shard_tokens - tokens)) + 1, len(names))
                parts.append((names[at:upto], known[at:upto], sizes[at:upto], flat[before : ends[upto - 1]].astype("<u4" if width == 4 else "<u2")))
                tokens += int(ends[upto - 1]) - before
                at = upto
                if tokens >= shard_tokens:
                    yield file()
                    shard, tokens, parts = shard + 1, 0, []
        if parts:
            yield file()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), text_of(text).alias("t"))
    ids = stash(rows.mapInArrow(encoded, "d long, n long, ids binary").withColumn("tie", F.xxhash64("ids")), "ids")
    ordered = ids.repartitionByRange("d", "tie").sortWithinPartitions("d", "tie")
    files = stash(ordered.select("d", "n", "ids").mapInArrow(work, "part int, shard int, n_docs long, n_tokens long, file binary"), "wavelet")
    drop(ids)
    return files


def export(files: DataFrame, folder: str) -> int:
    """Write each file of the table to folder/part-shard.qswm, a file at a time; returns how many. The folder is one of the driver's file systems."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in files.select("part", "shard", "file").toLocalIterator():
        Path(folder, f"{r['part']:06d}-{r['shard']:06d}.qswm").write_bytes(r["file"])
        n += 1
    return n


def read(files: DataFrame) -> DataFrame:
    """From the files alone, a row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
                matrix = WaveletMatrix(file)
                docs, known, sizes = matrix.documents()
                held, ends = memoryview(matrix.decode().tobytes()), np.cumsum(sizes)
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, "i4")), pa.array(np.full(n, shard, "i4")), pa.array(docs, mask=~known), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, "int64")],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    read_back = files.select("part", "shard", "file").mapInArrow(work, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = lambda *by: (Window.partitionBy(*by[:-1]) if by[:-1] else Window).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("before_part"))
    shards = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before("part", "shard")), F.lit(0)).alias("before_shard"))
    bases = shards.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("base"))
    bases = stash(bases, "bases")  # a row for each file: its size decides how it is joined
    return read_back.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
