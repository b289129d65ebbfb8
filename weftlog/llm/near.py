"""N-gram Jaccard join: near duplicates by prefix filtering, verified once per pair.

A document's set holds the hashes of its distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The work goes in rounds so that a large group of copies never
becomes all of its pairs:

1. One pass over the texts counts shingles in a fixed sketch (the rare-first order: sketch count, then
   hash; any order that all documents share is exact) and gives each document its set's size and digest.
   Documents with equal sets link with the smallest of them.
2. A second pass posts each set's prefix: its ``n - ceil(percent * n / 100) + 1`` rarest shingles. Postings
   are sorted by shingle and stream by. A row that could link with no other of its list, by length and
   place, is dropped; each other row is paired with one partner. Lists that the sketch takes for very long
   are salted by document; a salted part is looked at alone here and keeps all its rows, and step 4
   joins the parts. A wrong guess costs time, never a link.
3. Candidate pairs are distinct, get their two sets by joins, pass a suffix filter and are verified by an
   exact intersection. Verified links are closed into components.
4. Lists that still hold two components or more are gone through again, pair by pair across components
   and through the same filters; the new pairs are verified and closed again. Lists of more than
   ``SHORT`` rows are joined with some of their rows, eight times as many each turn, until the pairs across
   components that are left are few enough, or the rows are all of them. Nothing is capped.
5. Links are counted within each component, over one document of each distinct set: a component of
   two sets has one link, and in larger ones every pair of sets is intersected exactly, block by block, in
   tasks that hold two blocks. No pair is written; only each document's counts are.

Nulls and empty texts, and texts without words, have empty sets and link with nothing. Rows that repeat
a doc_id are one document when their texts are equal; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch, vectors
from .wordhash import mix, shingle_sets

#: Counters of the shingle sketch, and counters to a row of it; both fixed, whatever the input.
COUNTERS, ROW = 1 << 18, 1 << 12
#: Rows of a list that is looked at pair by pair, across components only.
SHORT = 64
#: A list of this many postings, by what the sketch has over twice its mean, is salted into parts of about so many.
LONG_LIST = 1 << 17
#: Documents and shingles of a block of a component, about; a shingle of more sets than OFTEN is counted by matrix products.
BLOCK_SETS, BLOCK_GRAMS, OFTEN = 1 << 10, 1 << 20, 32
#: The least and the most bits of the filter that lets candidate documents into the pass that makes sets: 16 for each
#: within these bounds. Beyond them more documents pass it; joins by doc_id decide, so the result stays the same.
FILTER_BITS, CHUNKS = (1 << 20, 1 << 28), 64


def _overlap(na, nb, percent: int):
    """The least intersection that links sets of these sizes; for integers and Columns."""
    top, low = percent * (na + nb), 100 + percent
    return F.ceil(top / low) if isinstance(na, Column) else -(-top // low)


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def signatures(docs: DataFrame, width: int = 5) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, h1, h2) of every document and the sketch of shingle counts, from one pass over the texts."""
    shift, wide = np.uint64(65 - COUNTERS.bit_length()), min(ROW, COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n, h1, h2 = (np.zeros(batch.num_rows, t) for t in (np.int32, np.uint64, np.uint64))
            for row, got in shingle_sets(batch.column(1), width):
                n[row], h1[row], h2[row] = len(got), got.sum(dtype=np.uint64), mix(got ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                counts += np.bincount((got >> shift).astype(np.int64), minlength=COUNTERS) if len(got) > COUNTERS else 0
                if len(got) <= COUNTERS:
                    np.add.at(counts, (got >> shift).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if counts.any():
            rows = COUNTERS // wide
            none = pa.nulls(rows)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(rows), pa.int32()), pa.array([counts[k * wide : (k + 1) * wide].tobytes() for k in range(rows)], pa.binary())], names)

    names = ["doc_id", "n", "h1", "h2", "chunk", "counts"]
    both = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, h1 long, h2 long, chunk int, counts binary"), "signatures")

    sketch = np.zeros(COUNTERS, np.int64)
    for k, sums in vectors.merged(both.where("chunk is not null").select("chunk", F.col("counts").alias("blob")), np.int64).items():
        sketch[k * wide : (k + 1) * wide] = sums
    return both.where("chunk is null").select("doc_id", "n", "h1", "h2"), sketch


def postings(docs: DataFrame, sketch: np.ndarray, percent: int, width: int = 5) -> DataFrame:
    """(gram, salt, doc_id, n, pos) of each set's prefix; a task posts equal sets once. The salt is -1 in lists of one part."""
    spark, shift = docs.sparkSession, np.uint64(65 - COUNTERS.bit_length())
    order = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = order.value, set()
        usual = 2 * count.mean()  # what a list shares its counter with, more or less
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            grams, owners, sizes, places, held = [], [], [], [], 0
            for row, got in shingle_sets(batch.column(1), width):
                n = len(got)
                if not n:
                    continue
                digest = (n, int(got.sum(dtype=np.uint64)))
                if digest in seen:
                    continue
                if len(seen) < 1 << 16:
                    seen.add(digest)
                keep = n - -(-percent * n // 100) + 1
                rank = count[(got >> shift).astype(np.int64)]
                # got is sorted by hash, so a stable order by count is the order by (count, hash)
                first = np.argsort(rank, kind="stable")[:keep]
                grams.append(got[first]), owners.append(np.full(keep, ids[row])), sizes.append(np.full(keep, n, np.int32)), places.append(np.arange(keep, dtype=np.int32))
                held += keep
                if held > 200_000:
                    yield pack(grams, owners, sizes, places, count - usual)
                    grams, owners, sizes, places, held = [], [], [], [], 0
            if grams:
                yield pack(grams, owners, sizes, places, count - usual)

    def pack(grams, owners, sizes, places, over) -> pa.RecordBatch:
        g, d = np.concatenate(grams), np.concatenate(owners)
        parts = (np.maximum(over[(g >> shift).astype(np.int64)], 0) // LONG_LIST).astype(np.int64) + 1
        salt = np.where(parts > 1, (mix(d.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32), np.int32(-1))
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(salt), pa.array(d), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["gram", "salt", "doc_id", "n", "pos"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "gram long, salt int, doc_id long, n int, pos int")


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Whole lists of rows sorted by (gram, salt), many at a time; or (True) rows of one list too long to hold."""
    held: list[np.ndarray] | None = None
    long = None
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
            held = None
        if not len(rows[0]):
            continue
        if long is not None:
            same = (rows[0] == long[0]) & (rows[1] == long[1])
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                yield [x[:n] for x in rows], True
                rows = [x[n:] for x in rows]
            if not len(rows[0]):
                continue
            long = None
        g, s = rows[:2]
        differs = (g != g[-1]) | (s != s[-1])
        last = len(g) - int(np.argmax(differs[::-1])) if differs.any() else 0
        if last:
            yield [x[:last] for x in rows], False
        held = [x[last:] for x in rows]
        if len(held[0]) > SHORT:
            long = (g[-1], s[-1])
            yield held, True
            held = None
    if held is not None:
        yield held, False


def _fits(na, pa_, nb, pb, percent: int) -> np.ndarray:
    """Length and positional filter: could sets that share their first prefix shingle at these places link?"""
    least = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= least)


def _paired(g: np.ndarray, s: np.ndarray, c: np.ndarray, n: np.ndarray, p: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, partners further on) in lists of at most ``SHORT`` rows that the filters let pass, by growing distance."""
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(g)))
    end = np.repeat(starts + size, size)
    end[np.repeat(size > SHORT, size)] = 0
    n, p = n.astype(np.int64), p.astype(np.int64)
    for d in range(1, SHORT):
        at = np.flatnonzero(np.arange(len(g)) + d < end)
        if not len(at):
            return
        at = at[c[at] != c[at + d]]
        at = at[_fits(n[at], p[at], n[at + d], p[at + d], percent)]
        if len(at):
            yield at, at + d


def stars(posted: DataFrame, percent: int) -> DataFrame:
    """The postings that may link with another of their list, each with one such partner.

    Lists stream by, sorted. In a list of at most ``SHORT`` rows a row's partner is the nearest before
    it that the filters let pass, and rows without any such pair are dropped: nothing can link them here. A
    longer list is kept whole, and its first row is the partner of all. A part of a salted list is kept whole
    too, however short: what links its rows may be in another part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for (g, s, d, n, p), long in _runs(batches, 5):
            if long:
                if pivot is None or pivot[:2] != (g[0], s[0]):
                    pivot = (g[0], s[0], d[0], int(n[0]), int(p[0]))
                fits = _fits(n.astype(np.int64), p.astype(np.int64), pivot[3], pivot[4], percent) & (d != pivot[2])
                yield out(g, s, d, n, p, pa.array(np.full(len(g), pivot[2]), mask=~fits))
                continue
            use, mate = s >= 0, np.full(len(g), -1)
            for at, to in _paired(g, s, d, n, p, percent):
                use[at] = use[to] = True
                free = mate[to] < 0
                mate[to[free]] = at[free]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            size = np.bincount(head, minlength=len(g))[head]
            big = size > SHORT
            if big.any():
                use |= big
                fits = big & (d != d[head]) & _fits(n.astype(np.int64), p.astype(np.int64), n[head].astype(np.int64), p[head].astype(np.int64), percent)
                mate[fits] = head[fits]
            rows = np.flatnonzero(use)
            if len(rows):
                yield out(g[rows], s[rows], d[rows], n[rows], p[rows], pa.array(d[mate[rows]], mask=mate[rows] < 0))

    def out(g, s, d, n, p, pivot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int32()), pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32()), pa.array(pivot, pa.int64())], ["gram", "salt", "doc_id", "n", "pos", "pivot"])

    dealt = posted.repartition("gram", "salt").sortWithinPartitions("gram", "salt", F.xxhash64("doc_id"), "doc_id")
    return dealt.mapInArrow(run, "gram long, salt int, doc_id long, n int, pos int, pivot long")


def crossings(lists: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """What lists still have between components: pairs (a, b) of lists of at most ``SHORT`` rows, and the rows of longer ones.

    A row is either a pair or a row of a long list (gram, a: doc_id, n, pos, c: component).
    """
    held = lists.join(label, lists["doc_id"] == label["node"], "left").select("gram", F.lit(0).alias("salt"), "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, s, d, n, p, c), long in _runs(batches, 6):
            new = np.concatenate([[True], g[1:] != g[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(g)))
            big = np.flatnonzero(np.repeat(size > SHORT, size) | long)
            if len(big):
                yield out(g[big], d[big], np.zeros(len(big), np.int64), n[big], p[big], c[big], True)
            if not long:
                for at, to in _paired(g, s, c, n, p, percent):
                    yield out(g[at], np.minimum(d[at], d[to]), np.maximum(d[at], d[to]), n[at], p[at], c[at], False)

    def out(g, a, b, n, p, c, long: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32()), pa.array(c, pa.int64()), pa.array(np.full(len(g), long))], ["gram", "a", "b", "n", "pos", "c", "long"])

    dealt = held.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, a long, b long, n int, pos int, c long, long boolean")


def _bits(ids: DataFrame) -> np.ndarray:
    """A packed table of bits with the slots of all values of ``ids`` (one or more columns) set, sized by their number."""
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * len(ids.columns) * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for column in batch.columns:
                bits[_slot(column.to_numpy(zero_copy_only=False), size)] = True
        if bits.any():
            parts = np.packbits(bits).reshape(CHUNKS, -1)
            some = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["chunk", "blob"])

    packed = np.zeros((CHUNKS, size // CHUNKS // 8), np.uint8)
    for k, some in vectors.merged(ids.mapInArrow(mark, "chunk int, blob binary"), np.uint8, np.bitwise_or).items():
        packed[k] = some
    return packed.reshape(-1)


def _among(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    slot = _slot(ids, 8 * len(packed))
    return np.flatnonzero((packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)


def profile(got: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of about as many equal ranges as it has members, a byte each."""
    bits = min(16, max(4, int(len(got)).bit_length()))
    return np.minimum(np.bincount((got >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sets_of(docs: DataFrame, ids: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n, ranges, grams) of the documents in ``ids``, and of the few others that a filter of bits lets pass; written."""
    held = docs.sparkSession.sparkContext.broadcast(_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            rows = _among(ids, held.value)
            some, found, size = batch.column(1).take(pa.array(rows)), [], 0
            for row, got in shingle_sets(some, width):
                found.append((int(ids[rows[row]]), len(got), profile(got), got.tobytes()))
                size += len(found[-1][3])
                if size > 1 << 23:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["doc_id", "n", "ranges", "grams"])

    made = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n int, ranges binary, grams binary")
    return scratch.keep(made, "sets")


def suffix_fits(na: int, ra: bytes, nb: int, rb: bytes, percent: int) -> bool:
    """Suffix filter: members that differ, counted range by range, may not be more than linked sets can have."""
    a, b = np.frombuffer(ra, np.uint8).astype(np.int64), np.frombuffer(rb, np.uint8).astype(np.int64)
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    return int(np.abs(a - b).sum()) <= na + nb - 2 * _overlap(na, nb, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets link, by their exact intersection."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= _overlap(len(a), len(b), percent)


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link: first by the suffix filter over small profiles, then exactly, once each."""

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [k for k, x in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))) if suffix_fits(*x, percent)]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [k for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))) if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    small, rows = sets.select("doc_id", "n", "ranges"), pairs.count()
    one, two = small.toDF("a", "na", "ra"), small.toDF("b", "nb", "rb")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "ra", "nb", "rb")
    left = scratch.keep(both.mapInArrow(coarse, "a long, b long"), "left", 4 * rows)
    held = sets.sparkSession.sparkContext.broadcast(_bits(left))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_among(batch.column(0).to_numpy(zero_copy_only=False), held.value)))

    some = sets.select("doc_id", "grams").mapInArrow(needed, "doc_id long, grams binary")
    one, two = some.toDF("a", "ga"), some.toDF("b", "gb")
    both = left.join(one, "a").join(two, "b").select("a", "b", "ga", "gb")
    return scratch.keep(both.mapInArrow(exact, "a long, b long"), "links", 25 * rows)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of these sorted distinct sets share (the diagonal is not filled)."""
    m = len(sets)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    size = np.diff(np.append(starts, len(grams)))
    few = (size > 1) & (size <= OFTEN)
    at, end = np.flatnonzero(np.repeat(few, size)), np.repeat(starts + size, size)
    both = np.zeros(m * m, np.int32)
    for d in range(1, int(size[few].max(initial=1))):
        at = at[at + d < end[at]]
        np.add.at(both, owner[at] * m + owner[at + d], 1)
    both = both.reshape(m, m)
    both += both.T.copy()
    often = np.flatnonzero(size > OFTEN)
    for k in range(0, len(often), 4096):
        some = often[k : k + 4096]
        x = np.zeros((m, len(some)), np.float32)
        for column, (a, n) in enumerate(zip(starts[some].tolist(), size[some].tolist())):
            x[owner[a : a + n], column] = 1
        both += (x @ x.T).astype(np.int32)
    return both


def link_counts(docs: DataFrame, label: DataFrame, same: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """(node, n_links) of every node of ``label``: the other documents that it links with, equal sets included."""
    more = same.groupBy("a").agg(F.count("*").alias("more")).withColumnRenamed("a", "node")
    reps = label.join(same.select(F.col("b").alias("node")), "node", "left_anti").join(more, "node", "left")
    reps = scratch.keep(reps.select("node", "component", (F.coalesce("more", F.lit(0)) + 1).alias("copies")), "reps", label.count())
    sizes = reps.groupBy("component").agg(F.count("*").alias("m"), F.sum("copies").alias("every"))
    large = scratch.keep(reps.join(sizes.where("m > 2"), "component"), "large", reps.count())
    sets = sets_of(docs, large.select("node"), width)
    held = large.join(sets, large["node"] == sets["doc_id"])
    blocks = large.join(sets.select("doc_id", F.col("n").alias("grams")).groupBy("doc_id").agg(F.max("grams").alias("grams")), F.col("node") == F.col("doc_id"))
    blocks = blocks.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    held = held.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    held = held.select("component", "node", "copies", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, nodes, counts = None, {}, [], []
        for batch in batches:
            for c, i, j, node, copies, block, grams in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (c, i, j) != key:
                    count(members, nodes, counts)
                    key, members = (c, i, j), {}
                    if len(nodes) > 20_000:
                        yield out(nodes, counts)
                        nodes, counts = [], []
                members.setdefault(node, (i != j, block, copies, grams))
        count(members, nodes, counts)
        if nodes:
            yield out(nodes, counts)

    def count(members: dict[int, tuple], nodes: list, counts: list) -> None:
        if not members:
            return
        apart, block, copies, grams = zip(*members.values())
        sets = [np.frombuffer(x, np.uint64) for x in grams]
        n, block = np.array([len(x) for x in sets], np.int64), np.array(block)
        link = intersections(sets) >= _overlap(n[:, None], n[None, :], percent)
        np.fill_diagonal(link, False)
        if apart[0]:  # pairs within a block are counted where it meets itself
            link &= block[:, None] != block[None, :]
        nodes += members
        counts += (link @ np.array(copies, np.int64)).tolist()

    def out(nodes: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64())], ["node", "others"])

    dealt = held.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = dealt.mapInArrow(run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))
    others = F.when(F.col("m") == 1, 0).when(F.col("m") == 2, F.col("every") - F.col("copies")).otherwise(F.col("others"))
    ones = reps.join(sizes, "component").join(found, "node", "left").select("node", (F.col("copies") - 1 + others).alias("n_links"))
    ones = scratch.keep(ones, "counts", reps.count())
    return ones.unionByName(same.join(ones, same["a"] == ones["node"]).select(F.col("b").alias("node"), "n_links"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``: only rows that a filter of bits holds go through the join."""
    held, place = docs.sparkSession.sparkContext.broadcast(_bits(gone.select("doc_id"))), docs.columns.index("doc_id")

    def part(among: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(place)
                hit = np.zeros(batch.num_rows, bool)
                hit[_among(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), held.value)] = True
                hit &= ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit if among else ~hit))

        return docs.mapInArrow(run, docs.schema)

    return part(False).unionByName(part(True).join(gone.select("doc_id"), "doc_id", "left_anti").select(docs.columns))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id[, n_links]) of every document.

    ``component_id`` is the smallest doc_id reachable over links, itself included; ``n_links`` counts all
    other documents that it links with (0 for a document alone), and is left out without ``count``.
    """
    docs = docs.select("doc_id", "text")
    signed, sketch = signatures(docs, width)
    with scratch.temporary(docs.sparkSession) as own:
        label = own.spare(scratch.keep(_grouped(docs, signed, sketch, percent, width, count), "groups", signed.count()))
    out = signed.join(label, F.col("doc_id") == F.col("node"), "left")
    shown = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count else []
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *shown)


def _checked(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs that link; the sets that show it are deleted."""
    with scratch.temporary(docs.sparkSession) as own:
        return own.spare(verified(sets_of(docs, pairs, width), pairs, percent))


def _grouped(docs: DataFrame, signed: DataFrame, sketch: np.ndarray, percent: int, width: int, count: bool) -> DataFrame:
    """(node, component[, n_links]) of the documents that link with any."""
    classes = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    # equal sets: each document links with the smallest of its class
    same = signed.join(classes, ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    same = scratch.keep(same, "same", signed.count() // 4)

    lists = scratch.keep(stars(postings(docs, sketch, percent, width), percent), "lists")
    star = lists.where("pivot is not null").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    pairs = scratch.keep(star.join(same, ["a", "b"], "left_anti"), "pairs", lists.count())
    links = same.unionByName(_checked(docs, pairs, percent, width))
    label = components.connected(links)

    crossed = scratch.keep(crossings(lists.select("gram", "doc_id", "n", "pos"), label, percent), "crossed")
    more = scratch.keep(crossed.where("not long").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs", crossed.count())
    if not more.isEmpty():
        new, pairs = _checked(docs, more, percent, width), pairs.unionByName(more)
        links, label = links.unionByName(new), components.extended(label, new)
    long = crossed.where("long").select("gram", F.col("a").alias("doc_id"), "n", "pos")
    pivots, sets = 16, None
    while True:  # lists too long to look at pair by pair
        held = long.join(label, F.col("doc_id") == F.col("node"), "left").select("gram", "n", "pos", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        mixed = held.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("gram")
        held = scratch.keep(held.join(mixed, "gram"), "mixed", long.count())
        per = held.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("own"))
        row = per.agg(F.max("m").alias("most"), F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
        if not row["rows"]:
            break
        sets = sets_of(docs, held.select("doc_id"), width) if sets is None else sets  # later turns have fewer documents
        # pivots: rows whose document's hash falls into this turn's share of the list; the same documents in all lists of a size
        if row["pairs"] > 16 * row["rows"] and pivots < row["most"]:
            sizes = held.groupBy("gram").agg(F.ceil(F.log2(F.count("*"))).alias("bits"))
            chosen = held.join(sizes, "gram").where(F.pmod(F.xxhash64("doc_id"), F.pow(F.lit(2), F.col("bits")).cast("long")) < pivots).drop("bits")
        else:
            chosen, pivots = held, None
        x, y = held.alias("x"), chosen.alias("y")
        fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= _overlap(F.col("x.n"), F.col("y.n"), percent))
        found = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & fits)
        found = found.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        more = scratch.keep(found.join(pairs, ["a", "b"], "left_anti"), "pairs", row["rows"])
        if not more.isEmpty():
            new, pairs = verified(sets, more, percent), pairs.unionByName(more)
            links, label = links.unionByName(new), components.extended(label, new)
        if pivots is None:
            break
        pivots *= 8

    return label.join(link_counts(docs, label, same, percent, width), "node") if count else label
