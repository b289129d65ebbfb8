"""Token-id files: a static range asymmetric numeral system over shared frequency tables.

One table of symbol frequencies, counted over all ids, serves every block. A block holds consecutive
documents, is decoded without any other block, and interleaves ``LANES`` coders so that a step handles
that many ids at once. At every ``STRIDE`` steps it records a checkpoint: the coders' states and the place in the
words, from which decoding can start; each stretch between checkpoints has its own checksum.

Frame layout, little-endian: magic ``RBK1``; u32 documents, ids, words, stretches; u64 table digest;
u64 index of the block's first id in its file; then i64 doc ids, u32 ids per document, per stretch u64 states
[LANES], u32 first word and u32 crc of its ids, the u32 words, and u32 crc of all before.

A file is one partition of the written Parquet table (file, block, n_ids, frame); files and blocks are in ascending
doc_id order. Spark's own commit protocol writes it, so a lost task leaves no half block. Null texts have only their
end id. Repeated rows stay apart, in order of their ids' bytes. An empty table makes no file and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, vectors
from .packing import tokenised
from .tokens import encoder

LANES, STRIDE, SCALE = 1024, 64, 22
#: Ids after which a block ends with the document at hand.
BLOCK = 1 << 18
_LOW = np.uint64(1 << 31)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, none of them 0, as close to the counts as whole numbers allow."""
    room = (1 << SCALE) - len(counts)
    if room < 0:
        raise ValueError(f"more than {1 << SCALE} symbols")
    total = max(1, int(counts.sum()))
    share = counts.astype(object) * room // total
    out = share.astype(np.int64) + 1
    out[int(np.argmax(counts))] += (1 << SCALE) - int(out.sum())
    return out


class Table:
    """Frequencies, their running sums and, for decoding, the symbol at each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.digest = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode_block(table: Table, doc_ids: list[int], sizes: list[int], ids: np.ndarray, first: int) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    padded = np.zeros(steps * LANES, np.int64)
    padded[:n] = ids
    grid = padded.reshape(steps, LANES)
    state, words, heads = np.full(LANES, _LOW, np.uint64), [], []
    for k in range(steps - 1, -1, -1):
        freq, start = table.freq[grid[k]], table.start[grid[k]]
        full = state >= (freq << np.uint64(63 - SCALE))
        words.append((state[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        state = np.where(full, state >> np.uint64(32), state)
        state = ((state // freq) << np.uint64(SCALE)) + state % freq + start
        if k % STRIDE == 0:
            heads.append((state.astype("<u8").tobytes(), k))
    words.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    parts = [b"RBK1", struct.pack("<IIIIQQ", len(doc_ids), n, int(at[-1]), len(heads), table.digest, first), np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<u4").tobytes()]
    raw = ids.astype("<u4")
    for states, k in reversed(heads):
        parts += [states, struct.pack("<II", int(at[k]), zlib.crc32(raw[k * LANES : (k + STRIDE) * LANES].tobytes()))]
    parts += [w.tobytes() for w in words]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(table: Table, frame: bytes, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc ids, ids per document, ids, index of the first id in the file); with ``stretch``, only the ids of that one."""
    if frame[:4] != b"RBK1" or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("damaged frame")
    docs, n, many, heads, digest, first = struct.unpack_from("<IIIIQQ", frame, 4)
    if digest != table.digest:
        raise ValueError("the frame was written with another table")
    at = 36
    doc_ids = np.frombuffer(frame, "<i8", docs, at)
    sizes = np.frombuffer(frame, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    each = 8 * LANES + 8
    words = np.frombuffer(frame, "<u4", many, at + each * heads).astype(np.uint64)
    out, mask = [], np.uint64((1 << SCALE) - 1)
    for h in range(heads) if stretch is None else [stretch]:
        state = np.frombuffer(frame, "<u8", LANES, at + each * h).astype(np.uint64)
        w, crc = struct.unpack_from("<II", frame, at + each * h + 8 * LANES)
        steps = min(STRIDE, -(-n // LANES) - h * STRIDE)
        got = np.empty((steps, LANES), np.int32)
        for k in range(steps):
            slot = state & mask
            symbol = table.slots[slot]
            got[k] = symbol
            state = table.freq[symbol] * (state >> np.uint64(SCALE)) + slot - table.start[symbol]
            need = np.flatnonzero(state < _LOW)
            state[need] = (state[need] << np.uint64(32)) | words[w : w + len(need)]
            w += len(need)
        flat = got.reshape(-1)[: n - h * STRIDE * LANES]
        if zlib.crc32(flat.astype("<u4").tobytes()) != crc:
            raise ValueError(f"damaged stretch {h}")
        out.append(flat)
    return doc_ids, sizes, np.concatenate(out) if out else np.zeros(0, np.int32), first


def _counts(tokens: DataFrame, size: int, kind: type) -> np.ndarray:
    """How often each id occurs in the whole table: one vector of fixed size a task, summed in shares."""
    row = 1 << 11

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(-(-size // row) * row, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                sums += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=len(sums)) if len(blob.as_buffer()) > 4096 else 0
            small = [np.frombuffer(b.as_buffer(), kind) for b in batch.column(0) if len(b.as_buffer()) <= 4096]
            if small:
                sums += np.bincount(np.concatenate(small), minlength=len(sums))
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums) // row), pa.int32()), pa.array([x.tobytes() for x in sums.reshape(-1, row)], pa.binary())], ["chunk", "blob"])

    out = np.zeros(-(-size // row) * row, np.int64)
    for k, sums in vectors.merged(tokens.select("ids").mapInArrow(run, "chunk int, blob binary"), np.int64).items():
        out[k * row : (k + 1) * row] = sums
    return out[:size]


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Writes the ids of all texts under ``path``: ``table`` (the frequencies) and ``files`` (the blocks)."""
    spark = docs.sparkSession
    code = encoder(vocabulary, True)
    size, kind = code.size, code.kind
    tokens = tokenised(docs, vocabulary, end_id, True)
    freq = normalised(_counts(tokens, size, kind))
    spark.createDataFrame([(freq.astype("<u4").tobytes(),)], "freq binary").write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table(shared.value), TaskContext.get().partitionId()
        ids, sizes, blobs, held, first, block = [], [], [], 0, 0, 0
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(blob.as_py(), kind)
                ids.append(NO_ID if doc_id is None else doc_id), sizes.append(len(got)), blobs.append(got)
                held += len(got)
                if held >= BLOCK:
                    yield out(part, block, held, encode_block(table, ids, sizes, np.concatenate(blobs), first))
                    first, block = first + held, block + 1
                    ids, sizes, blobs, held = [], [], [], 0
        if held:
            yield out(part, block, held, encode_block(table, ids, sizes, np.concatenate(blobs), first))

    def out(part: int, block: int, n: int, frame: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([frame], pa.binary())], ["file", "block", "n_ids", "frame"])

    # parts of a size that a task holds easily; their number follows the ids
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(freq.size and tokens.agg(F.sum("n")).first()[0] or 0) >> 24)
    dealt = tokens.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(run, "file int, block int, n_ids long, frame binary").write.option("compression", "uncompressed").parquet(f"{path}/files")


#: Stands for a null doc_id in a frame.
NO_ID = -(1 << 63)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids as uint32 bytes]) of every document under ``path``, decoded in parallel."""
    files = spark.read.schema("file int, block int, n_ids long, frame binary").parquet(f"{path}/files")
    freq = np.frombuffer(spark.read.schema("freq binary").parquet(f"{path}/table").first()[0], "<u4")
    shared = spark.sparkContext.broadcast(freq)
    # ids in each file; as many rows as files
    sizes = dict(tuple(r) for r in files.groupBy("file").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for part, frame in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, n, ids, first = decode_block(table, frame.as_py())
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(n.astype(np.int64))
                starts = ends - n
                cuts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts + before[part] + first, pa.int64()), pa.array(n.astype(np.int64)), pa.array([zlib.crc32(c) for c in cuts], pa.int64())] + ([pa.array([bytes(c) for c in cuts], pa.binary())] if with_ids else []),
                    ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids,
                )

    return files.select("file", "frame").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes all documents to token files in the shared scratch folder and reads them back."""
    path = scratch.place(docs.sparkSession, "files")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
