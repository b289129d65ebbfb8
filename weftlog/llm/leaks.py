"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of all windows, verified hits.

Words are ASCII letters and digits and whatever lies beyond ASCII, lower-cased A-Z. A window is ``width``
consecutive words of a benchmark item; a shorter item, but not an empty one, is one window. Window hashes
of the items go to the executors in blocks of about ``BLOCK`` bytes of text, however large the benchmark
is, and beyond ``HELD`` blocks a worker has one in memory at a time, once a batch; every document's every window is looked up, and a hit counts once its words are equal, not just its hash.

Null and empty texts have no words, hits or items. A null item_id marks its words but names no item.
Repeated items count once; repeated documents each get a row, as do null doc_ids. An empty benchmark hits nothing.
Extra columns of any name pass through ``clean`` and are left out elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import ALNUM, LOWER, slices, window_hashes, word_hashes, words

#: Bytes of benchmark text in one broadcast block, and blocks that a worker keeps in memory from batch to batch.
BLOCK, HELD = 8 << 20, 4
#: Bits of the first look-up of a window's hash.
BITS = 22


def _spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends))


class Index:
    """The windows of a block of items, in arrays: by length the sorted hashes, each with its first word and its item."""

    def __init__(self, rows: list[tuple[int | None, str | None]], width: int):
        self.items, texts, places, found = [r[0] for r in rows], [], [], {}
        words_before = bytes_before = 0
        for first, data, offsets in slices(pa.array([r[1] for r in rows], pa.string())):
            data = LOWER[data]
            starts, ends, count = words(data, offsets, ALNUM)
            hashes, n = word_hashes(data, starts, ends), np.diff(count)
            owner = np.repeat(np.arange(len(n)), n)
            for size in np.unique(np.minimum(n[n > 0], width)).tolist():
                # every window of an item of enough words, or the one window of an item of just so many
                at = np.flatnonzero(np.minimum(n, width)[owner] == size)
                at = at[at + size <= count[owner[at] + 1]]
                found.setdefault(size, []).append((window_hashes(hashes, size)[at], at + words_before, owner[at] + first))
            texts.append(data), places.append(np.stack([starts, ends]) + bytes_before)
            words_before, bytes_before = words_before + len(starts), bytes_before + len(data)
        self.data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.starts, self.ends = np.concatenate(places, axis=1).astype(np.int32) if places else np.zeros((2, 0), np.int32)
        #: (length, bits of the hashes' first BITS bits, hashes, first words, items)
        self.sizes = []
        for size, some in sorted(found.items()):
            keys, word, item = (np.concatenate(x) for x in zip(*some))
            order = np.lexsort((item, keys))
            keys, word, item = keys[order], word[order].astype(np.int32), item[order].astype(np.int32)
            table = np.zeros(1 << BITS, bool)
            table[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.sizes.append((size, np.packbits(table), keys, word, item))

    def named(self, size: int, keys: np.ndarray, word: np.ndarray, item: np.ndarray, key: np.uint64, spelt: bytes) -> set | None:
        """The items with this very window, or None if no window is spelt so."""
        out = None
        for k in range(int(np.searchsorted(keys, key, "left")), int(np.searchsorted(keys, key, "right"))):
            w = int(word[k])
            if _spell(self.data, self.starts[w : w + size], self.ends[w : w + size]) == spelt:
                out = out or set()
                out.add(self.items[item[k]])
        return out


def blocks(benchmark: DataFrame, width: int) -> list:
    """Broadcast indexes over all items, each over at most about ``BLOCK`` bytes of text."""
    spark = benchmark.sparkSession
    benchmark = benchmark.select("item_id", "text").where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-size // BLOCK)
    block = F.pmod(F.xxhash64("text"), F.lit(max(many, 1)))
    out = []
    for k in range(many):
        part = benchmark if many == 1 else benchmark.where(block == k)
        out.append(spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], width)))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<long>, spans array<struct<start, end>> in bytes of UTF-8) of every document."""
    held = blocks(benchmark, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, n_words, hit, owner, items, spans in matches(batch.column(1), held):
                many = len(n_words)
                n_hit = np.bincount(owner[hit], minlength=many)
                pairs = [[{"start": a, "end": b} for a, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, many), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    named = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned(docs, benchmark, width).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, how: str = "drop") -> DataFrame:
    """``docs`` with all its columns, without contaminated documents ("drop") or without their hit spans ("cut").

    Both go over the texts once, with no shuffle: the scan keeps each row's other columns beside it.
    """
    held, names = blocks(benchmark, width), docs.columns
    if not held:
        return docs
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(place)
            marks = [x for found in matches(text, held) for x in found[5]]
            if how == "drop":
                yield batch.filter(pa.array([not x for x in marks], pa.bool_()))
                continue
            texts = [None if t is None else _without(t, m) if m else t for t, m in zip(text.to_pylist(), marks)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, text.type))

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def matches(column: pa.Array, held: list) -> Iterator[tuple]:
    """By runs of rows: (first row, words of each, hit words, their rows, items of each, hit spans of each in bytes)."""
    runs = []
    for first, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, count = words(data, offsets, ALNUM)
        many = len(offsets) - 1
        owner = np.repeat(np.arange(many), np.diff(count))
        runs.append((first, data, offsets, starts, ends, count, word_hashes(data, starts, ends), owner, np.zeros(len(starts), bool), [set() for _ in range(many)]))
    for block in held:
        index = block.value
        for _, data, _, starts, ends, _, hashes, owner, hit, items in runs:
            for size, packed, keys, word, item in index.sizes:
                found = window_hashes(hashes, size)
                slot = (found >> np.uint64(64 - BITS)).astype(np.int64)
                at = np.flatnonzero((packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                at = at[owner[at] == owner[at + size - 1]]
                place = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
                known: dict[tuple, set | None] = {}
                for k in at[keys[place] == found[at]].tolist():
                    asked = (found[k], _spell(data, starts[k : k + size], ends[k : k + size]))
                    if asked not in known:
                        known[asked] = index.named(size, keys, word, item, *asked)
                    if known[asked] is not None:
                        hit[k : k + size] = True
                        items[owner[k]] |= known[asked]
        if len(held) > HELD:
            del index, block._value  # read again for the next batch
    for first, data, offsets, starts, ends, count, _, owner, hit, items in runs:
        spans = [[] for _ in items]
        for k in np.flatnonzero(hit).tolist():
            d = owner[k]
            a, b = int(starts[k] - offsets[d]), int(ends[k] - offsets[d])
            if spans[d] and hit[k - 1] and owner[k - 1] == d:
                spans[d][-1] = (spans[d][-1][0], b)
            else:
                spans[d].append((a, b))
        yield first, np.diff(count), hit, owner, items, spans
