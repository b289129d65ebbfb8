"""Language identification: TF-IDF vectors of byte n-grams against several centroids per language.

A text's vector counts its letter n-grams of two and three bytes (lower-cased in Latin-1's range; ASCII that is
no letter is a border), hashed to ``DIMS`` places, damped, weighted by inverse document frequency and of
length one. Each language has up to ``clusters`` centroids from spherical k-means. The prediction is
the language of the nearest centroid by cosine; ``score`` is that cosine. A text further from its centroid than
nearly all training texts is marked ``rejected``; it still carries its nearest language.

Document frequencies cover all training documents. Centroids are fitted on a sample of at most
``sample`` training documents per language, chosen by hash. Null texts and texts without letters are ``und``
with score 0 and are rejected; so is everything when there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .wordhash import slices

#: Places of a vector, and texts whose dense vectors are held at once.
DIMS, ROWS = 1 << 12, 512
#: Training documents per language that centroids are fitted on.
SAMPLE = 400
UND = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of n-gram counts) for runs of rows."""
    for first, data, offsets in slices(column, rows=ROWS):
        folded = _FOLD[data]
        # capital letters of Latin-1, in UTF-8: 0xC3 then 0x80..0x9E
        cap = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        folded[cap] += 32
        many, n = len(offsets) - 1, len(data)
        owner = np.repeat(np.arange(many, dtype=np.int64) * DIMS, np.diff(offsets))
        last = np.repeat(offsets[1:], np.diff(offsets))
        place = np.arange(n)
        out = np.zeros(many * DIMS, np.float32)
        two = folded[:-1] * np.uint32(257) + folded[1:] if n > 1 else np.zeros(0, np.uint32)
        letters = folded != 32
        for width, code in ((2, two), (3, two[:-1] * np.uint32(263) + folded[2:] if n > 2 else two[:0])):
            slot = ((code * np.uint32(2654435761) + np.uint32(width)) >> np.uint32(20)).astype(np.int64)
            good = place[: len(code)] + width <= last[: len(code)]
            middle = letters[1 : 1 + len(code)]
            good &= middle if width == 3 else (letters[: len(code)] & middle)
            out += np.bincount(owner[: len(code)][good] + slot[good], minlength=many * DIMS).astype(np.float32)
        yield first, out.reshape(many, DIMS)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(found) * idf
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(size, 1e-12)


def centroids(v: np.ndarray, clusters: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    rng = np.random.default_rng(seed)
    start = [int(rng.integers(len(v)))]
    near = v @ v[start[0]]
    for _ in range(min(clusters, len(v)) - 1):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[start[-1]])
    c = v[start].copy()
    for _ in range(12):
        own = np.argmax(v @ c.T, axis=1)
        for k in range(len(c)):
            if (own == k).any():
                c[k] = v[own == k].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], owners: np.ndarray, points: np.ndarray, limits: np.ndarray):
        self.idf, self.names, self.owners, self.points, self.limits = idf, names, owners, points, limits


def fit(docs: DataFrame, lang: str = "lang", clusters: int = 4, sample: int = SAMPLE, reject: float = 0.005) -> Model:
    """Learns from the rows of ``docs`` with text and language."""
    docs = docs.select("doc_id", "text", F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def seen(batch: pa.RecordBatch) -> np.ndarray:
        return sum((c > 0).sum(axis=0) for _, c in counts(batch.column(0))).astype(np.float64)

    rows = sum(sizes.values())
    idf = np.log((1 + rows) / (1 + vectors.total(docs.select("text"), DIMS, seen))).astype(np.float32) + np.float32(0.1)
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int((1 << 30) * min(1.0, sample / n)))) for k, n in sizes.items()]) if sizes else F.lit(0)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, c in counts(batch.column(1)):
                blobs = [x.astype(np.uint16).tobytes() if x.max(initial=0) < 65536 else np.minimum(x, 65535).astype(np.uint16).tobytes() for x in c]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(c)), pa.array(blobs, pa.binary())], ["lang", "v"])

    got = docs.where(share < limit).select("lang", "text").mapInArrow(vector, "lang string, v binary").collect()
    names, points, owners, limits = sorted({r["lang"] for r in got}), [], [], []
    for k, name in enumerate(names):
        v = weighted(np.array([np.frombuffer(r["v"], np.uint16) for r in got if r["lang"] == name], np.float32), idf)
        v = v[np.linalg.norm(v, axis=1) > 0.5]
        if not len(v):
            continue
        c = centroids(v, clusters)
        near = v @ c.T
        own = np.argmax(near, axis=1)
        limits += [float(np.quantile(near[own == j, j], reject)) if (own == j).any() else 0.0 for j in range(len(c))]
        points.append(c)
        owners += [k] * len(c)
    return Model(idf, names, np.array(owners, np.int64), np.concatenate(points) if points else np.zeros((0, DIMS), np.float32), np.array(limits))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs``, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for first, found in counts(batch.column(1)):
                texts = batch.column(1).slice(first, len(found))
                some = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
                for k in np.flatnonzero(~some):  # letters beyond ASCII are told by code point
                    some[k] = any(x.isalpha() for x in texts[k].as_py() or "")
                if len(m.points):
                    near = weighted(found, m.idf) @ m.points.T
                    best = np.argmax(near, axis=1)
                    score = np.where(some, np.clip(near[np.arange(len(near)), best], 0, 1), 0.0).astype(np.float64)
                    names = [m.names[m.owners[b]] if s else UND for b, s in zip(best, some)]
                    far = ~some | (score < m.limits[best])
                else:
                    score, names, far = np.zeros(len(found)), [UND] * len(found), np.ones(len(found), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from the documents not held out, predicts all."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
