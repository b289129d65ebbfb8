"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of its documents' tokens. In turn, each queue is owed its target share of the
tokens given out; what whole tokens leave over is its deficit, carried on. Served token by token in order
of need, what a queue has given after t tokens is a function of t and the weights alone (a divisor rule),
so each queue stays about a token from its target in every window, every window is full, and nothing
about a window depends on how another was filled. Each partition places its own pieces, and deficits
carry across partitions as exactly as across windows.

The default targets are the sources' own shares of tokens: all queues then run dry together, in the last
window. Given weights make phases: when a queue runs dry its share goes to the others. The rest below one
window is cut into sequences of powers of two, which need no padding.

Any number of sources is packed. Beyond ``QUEUES`` of them, the ones with the most tokens (given weights: with
the largest shares, then the most tokens) have queues of their own, and all others share one last
queue, part after part and source after source, whose share is the sum of theirs.

A null text is an empty document, of one end token. A null source is a queue of its own. Repeated rows are
packed as often as they occur. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoder, trim

#: The most queues of a mixture; their totals are the only thing that the driver holds.
QUEUES = 4096
#: The key of the queue that the sources beyond them share; no source's name is a number.
REST = 0


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, blank: bool, queue: str | None = None) -> DataFrame:
    """(part, queue, at, doc_id, n, ids) as a written table: ``at`` counts the queue's tokens before in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code = encoder(vocabulary, blank)
            flat, ends = code.encode(batch.column(1))
            n = np.diff(ends, prepend=0) + 1
            whole = np.insert(flat, ends, code.kind(end_id))
            places = np.concatenate([[0], np.cumsum(n)]) * whole.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
            at, queues = [], batch.column(2)
            for q, k in zip(queues.to_pylist(), n.tolist()):
                at.append(given.get(q, 0))
                given[q] = at[-1] + k
            del flat, whole
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), queues, pa.array(at, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), blobs], ["part", "queue", "at", "doc_id", "n", "ids"])
        trim()

    names = F.lit(None).cast("string") if queue is None else F.col(queue).cast("string")
    made = docs.select("doc_id", "text", names.alias("queue")).mapInArrow(run, "part int, queue string, at long, doc_id long, n long, ids binary")
    return scratch.keep(made, "tokens")


class Schedule:
    """Where each queue's tokens go. ``totals``: (queue, tokens) in order; weights: queue to share, default its tokens.

    Token number a (from 0) of a queue with weight w is due at ``(2 * a + 1) / w``; tokens are given in order
    of that and of the queue. ``counts(t)`` is what the queues have given when t tokens are out.
    """

    def __init__(self, totals: list[tuple[str | None, int]], length: int, weights: dict | None = None):
        self.length, self.slot = length, {q: k for k, (q, _) in enumerate(totals)}
        left = [n for _, n in totals]
        self.totals, self.total, given, t = list(left), sum(left), [0] * len(left), 0
        share = [max(1, round(weights.get(q, 0) * 10**9)) for q, _ in totals] if weights else list(left)
        #: (tokens out before, given before by queue, weights) of each stretch in which the same queues have tokens.
        self.phases: list[tuple[int, list[int], list[int]]] = []
        while any(left):
            live = [w if n else 0 for w, n in zip(share, left)]
            self.phases.append((t, list(given), live))
            due, last = min(((2 * n - 1) / w, k) for k, (n, w) in enumerate(zip(left, live)) if w)
            took = [min(left[k], self._until(w, due, k <= last)) if w else 0 for k, w in enumerate(live)]
            given, left, t = [x + y for x, y in zip(given, took)], [x - y for x, y in zip(left, took)], t + sum(took)
        self._known: dict[int, list[int]] = {}
        self._sums: dict[int, list[int]] = {}

    @staticmethod
    def _until(weight: int, due: float, ties: bool) -> int:
        """How many tokens of a queue are due before ``due``, or at it with ties."""
        a = max(0, int((due * weight - 1) / 2) - 2)
        while a and (2 * a - 1) / weight >= due:
            a -= 1
        while (2 * a + 1) / weight < due or ties and (2 * a + 1) / weight == due:
            a += 1
        return a

    def counts(self, t: int) -> list[int]:
        if t >= self.total:
            return self.totals
        if t not in self._known:
            if len(self._known) > 4096:
                self._known.clear()
            t0, given, live = self.phases[bisect_right(self.phases, t, key=lambda x: x[0]) - 1]
            self._known[t] = [x + y for x, y in zip(given, self._dealt(live, t - t0))]
        return self._known[t]

    def before(self, t: int, k: int) -> int:
        """What the queues before number k have given when t tokens are out."""
        if t not in self._sums:
            if len(self._sums) > 4096:
                self._sums.clear()
            self._sums[t] = [0, *accumulate(self.counts(t))]
        return self._sums[t][k]

    @staticmethod
    def _dealt(live: list[int], t: int) -> list[int]:
        """The first t tokens by due time: from just under the exact shares up, or from further down if that was too high."""
        whole = sum(live)
        for slack in (1, 2 * len(live), t):
            out = [max(0, t * w // whole - slack) for w in live]
            heap = [((2 * a + 1) / w, k) for k, (a, w) in enumerate(zip(out, live)) if w]
            heapq.heapify(heap)
            rest = t - sum(out)
            for _ in range(rest):
                k = heap[0][1]
                out[k] += 1
                heapq.heapreplace(heap, ((2 * out[k] + 1) / live[k], k))
            if rest >= 0 and all(a == 0 or ((2 * a - 1) / w, k) < heap[0] for k, (a, w) in enumerate(zip(out, live)) if w):
                return out
        raise AssertionError("unreachable: slack t starts from nothing")

    def pieces(self, queue: str | None, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, tokens, sequence_id, offset) of a document that is n tokens from ``first`` of its queue."""
        k, at, length = self.slot[queue], first, self.length
        window = self._window(k, at)
        while at < first + n:
            low, high = self.counts(window * length), self.counts((window + 1) * length)
            if high[k] <= at:
                window += 1
                continue
            stop = min(first + n, high[k])
            size = min(length, self.total - window * length)
            offset = self.before((window + 1) * length, k) - self.before(window * length, k) + at - low[k]
            if size == length:
                yield at - first, stop - at, window, offset
            else:  # the last window: all that is left, queue after queue
                yield from self._cut(at - first, stop - at, window, offset, size)
            at = stop

    def _window(self, k: int, at: int) -> int:
        low, high = 0, self.total // self.length
        while low < high:  # the last window that begins with at or fewer tokens of the queue given
            mid = (low + high + 1) // 2
            if self.counts(mid * self.length)[k] <= at:
                low = mid
            else:
                high = mid - 1
        return low

    def _cut(self, start: int, n: int, window: int, offset: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """The last window, if not full, is cut into sequences of powers of two."""
        base, bit = 0, 1 << (size.bit_length() - 1)
        while n:
            while not size & bit or offset >= base + bit:
                if size & bit:
                    base, window = base + bit, window + 1
                bit >>= 1
            took = min(n, base + bit - offset)
            yield start, took, window, offset - base
            start, n, offset = start + took, n - took, offset + took


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, source: str = "source", weights: dict | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue[, ids as uint32 bytes])."""
    held = tokenised(docs, vocabulary, end_id, False, source)
    spark = held.sparkSession
    parts = held.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    names = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    rest = names.count() > QUEUES
    if rest:
        shares = spark.createDataFrame([(q, max(1, round(w * 10**9))) for q, w in (weights or {}).items()], "name string, share long")
        names = names.join(F.broadcast(shares), names["queue"].eqNullSafe(shares["name"]), "left").select("queue", "n", F.coalesce("share", F.lit(1)).alias("share"))
        every = names.agg(F.sum("n").alias("n"), F.sum("share").alias("share")).first()
        names = names.orderBy(F.desc("share"), F.desc("n"), "queue").limit(QUEUES - 1)
    own = names.collect()
    totals = sorted(((r["queue"], r["n"]) for r in own), key=lambda x: (x[0] is not None, x[0] or ""))
    if rest:
        totals.append((REST, every["n"] - sum(r["n"] for r in own)))
        weights = weights and weights | {REST: (every["share"] - sum(r["share"] for r in own)) / 10**9}
    plan = spark.sparkContext.broadcast(Schedule(totals, length, weights))

    def running(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("before", F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    if rest:
        mine = F.broadcast(spark.createDataFrame([(r["queue"], True) for r in own], "name string, own boolean"))
        parts = scratch.keep(parts.join(mine, parts["queue"].eqNullSafe(mine["name"]), "left").select("queue", "part", "n", "own"), "parts")
        shared = parts.where("own is null")
        first = running(shared.groupBy("part").agg(F.sum("n").alias("n")), Window.orderBy("part")).select("part", F.col("before").alias("first"))
        shared = running(shared, Window.partitionBy("part").orderBy("queue")).join(first, "part").select("queue", "part", (F.col("before") + F.col("first")).alias("before"))
        parts = parts.where("own")
    before = running(parts, Window.partitionBy("queue").orderBy("part")).select("queue", "part", "before")
    before = before.unionByName(shared) if rest else before
    before = before.select(F.col("queue").alias("q"), F.col("part").alias("p"), "before")
    placed = held.join(F.broadcast(before) if before.count() <= 200_000 else before, held["queue"].eqNullSafe(before["q"]) & (held["part"] == before["p"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = plan.value
        for batch in batches:
            rows: list[tuple] = []
            for queue, at, doc_id, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(blob, kind).astype("<u4")
                n, data = len(ids), memoryview(ids).cast("B")
                for start, many, sequence, offset in schedule.pieces(queue if queue in schedule.slot else REST, at, n):
                    cut = data[4 * start : 4 * (start + many)]
                    rows.append((doc_id, start, many, zlib.crc32(cut), n, sequence, offset, queue) + ((bytes(cut),) if with_ids else ()))
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names_out)

    kind = encoder(vocabulary, False).kind
    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"] + ["ids"] * with_ids
    kinds = ", ".join(f"{x} {'string' if x == 'queue' else 'binary' if x == 'ids' else 'long'}" for x in names_out)
    return placed.select("queue", (F.col("at") + F.col("before")).alias("at"), "doc_id", "ids").mapInArrow(run, kinds)
