"""Quality classification by hierarchical empirical Bayes over sites and the sections of sites.

Two classifiers give a document's own evidence: logistic regression over measures of its form (junk
against good), and insult words learnt from toxic labels. The probability that a document is bad is then
aggregated over all documents by host (``host``) and by path within it (``path``). A host's rate is
shrunk toward the global rate and a path's toward its host's, with strengths that the spread of the rates
themselves determines. The posterior is the document's evidence times the odds of its path, so a sparse site
adds next to nothing and a large bad one a little.

The classifiers are fitted on at most ``sample`` labelled documents, chosen by hash (``CLEAN`` for the clean uses
of insult words); rates, strengths and decisions cover all documents. Null and empty texts have the evidence of an empty form and are
rejected when that is bad. Null hosts and paths are sites of their own, null doc_ids documents without labels.
Repeated rows are judged each. Documents without labels are judged all the same; without any labels nothing is
rejected. Extra columns of any name pass through ``kept`` untouched and are left out of ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch, vectors
from .wordhash import ALNUM, LOWER, slices, window_hashes, word_hashes, words

#: Labelled documents that the classifiers are fitted on, and those in which clean uses of insult words are counted.
SAMPLE, CLEAN = 12_000, 60_000
#: Toxic documents that a word must be in (at least this, and this share of them), and its shrunk rate of toxic ones, to count.
SUPPORT, SHARE, RATE = 5, 0.01, 0.4
FORMS = 9
#: Paths whose rates are broadcast; beyond it they are joined.
SITES = 100_000
#: A document is rejected above this posterior probability of being bad; and if what a toxic one costs, kept, as a
#: multiple of what a clean one costs, lost, times the posterior probability of toxic is more than that of clean.
REJECT, COST = 0.5, 7.4
VERDICT = ["quality_score", "p_junk", "p_toxic", "host_rate", "path_rate", "rejected"]

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"!#$%&*+<=>@[]^_`{|}~\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def forms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, measures of each row, word hashes, words before each row) for runs of rows."""

    def per(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[offsets[1:]] - run[offsets[:-1]]).astype(np.float64)

    for first, data, offsets in slices(column):
        low = LOWER[data]
        starts, ends, count = words(low, offsets, ALNUM)
        hashes = word_hashes(low, starts, ends)
        n, size = np.diff(count).astype(np.float64), np.maximum(np.diff(offsets), 1).astype(np.float64)
        signs, upper, digits, lines = (per(m, offsets) for m in (_SIGNS[data], _UPPER[data], _DIGIT[data], data == 10))
        capital = _UPPER[data[ends - 1]] & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
        run = np.concatenate([[0], np.cumsum(capital)])
        shout = (run[count[1:]] - run[count[:-1]]) / np.maximum(n, 1)
        kinds = np.array([len(np.unique(hashes[a:b])) for a, b in zip(count[:-1], count[1:])], np.float64)
        same = 1 - kinds / np.maximum(n, 1)
        twos = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) > 1 else hashes[:0]
        pairs = np.array([1 - len(np.unique(twos[a : b - 1])) / (b - 1 - a) if b - a > 1 else 0.0 for a, b in zip(count[:-1], count[1:])])
        x = np.column_stack([np.ones(len(n)), np.minimum(30 * signs / size, 3), 3 * upper / size, 5 * digits / size, 3 * shout, same, 3 * pairs, np.minimum(10 * lines / np.maximum(n, 1), 3), (n == 0).astype(float)])
        yield first, x, hashes, count


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights of the forms, the insult words' hashes with their evidence, and the share of bad documents."""

    def __init__(self, weights: np.ndarray, insults: dict[int, float], bad: float, toxic: float):
        self.weights, self.bad, self.toxic = weights, bad, toxic
        self.hashes = np.array(sorted(insults), np.uint64)
        self.gain = np.array([insults[k] for k in sorted(insults)])

    def evidence(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, log odds of junk, log odds of toxic) of runs of rows."""
        for first, x, hashes, count in forms(column):
            junk = x @ self.weights
            toxic = np.full(len(x), np.log(self.toxic / (1 - self.toxic)))
            if len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                at = np.flatnonzero(self.hashes[place] == hashes)
                owner = np.searchsorted(count, at, "right") - 1
                for d, k in set(zip(owner.tolist(), place[at].tolist())):
                    toxic[d] += self.gain[k]
            yield first, junk, toxic


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits both classifiers on labelled documents; None without labels. Of labels that disagree about a document the worse counts."""
    labels = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and (quality is not null or toxic is not null)")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    many = labels.count()

    def labelled(most: int) -> DataFrame:
        some = vectors.sampled(labels, F.col("doc_id"), most, many)
        return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, hashes, count in forms(batch.column(3)):
                bags = [np.unique(hashes[a:b]) for a, b in zip(count[:-1], count[1:])]
                # near copies mostly have the same least run of three words
                signs = [int(window_hashes(hashes[a:b], 3).min(initial=2**64 - 1) >> np.uint64(1)) for a, b in zip(count[:-1], count[1:])]
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (1, 2)), pa.array(list(x), pa.list_(pa.float64())), pa.array([b.tobytes() if t else b"" for b, t in zip(bags, part.column(2).to_pylist())], pa.binary()), pa.array(signs, pa.int64())], ["quality", "toxic", "x", "bag", "sign"])

    rows = labelled(sample).mapInArrow(run, "quality int, toxic int, x array<double>, bag binary, sign long").collect()
    if not rows:
        return None
    x, q = np.array([r["x"] for r in rows if r["quality"] is not None]), np.array([r["quality"] for r in rows if r["quality"] is not None], float)
    weights = logistic(x, 1 - q) if len(x) else np.zeros(FORMS)
    told = sum(r["toxic"] is not None for r in rows)
    rate = min(0.5, max(1e-3, sum(bool(r["toxic"]) for r in rows) / max(told, 1)))
    # a word counts once for all copies of a toxic document
    seen: dict[int, set[int]] = {}
    for r in rows:
        if r["toxic"]:
            for word in np.frombuffer(r["bag"], np.uint64).tolist():
                seen.setdefault(word, set()).add(r["sign"])
    least = max(SUPPORT, SHARE * len({r["sign"] for r in rows if r["toxic"]}))
    often = {w: len(x) for w, x in seen.items() if len(x) >= least}
    names = np.array(sorted(often), np.uint64)
    insults: dict[int, float] = {}
    if len(names):

        def clean(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(len(names))
            for first, _, hashes, count in forms(batch.column(3)):
                for k, (a, b) in enumerate(zip(count[:-1], count[1:])):
                    if batch.column(2)[first + k].as_py() == 0:
                        got = np.unique(hashes[a:b])
                        at = np.searchsorted(names, got)
                        good = at < len(names)
                        good[good] = names[at[good]] == got[good]
                        out[at[good]] += 1
            return out

        other = dict(zip(names.tolist(), vectors.total(labelled(CLEAN), len(names), clean).tolist()))
        part = min(1.0, sample / many) / min(1.0, CLEAN / many)
        for word, n in often.items():
            p = _rate(n, other[word] * part, rate)
            if p >= RATE:
                insults[word] = float(np.log(p / (1 - p)) - np.log(rate / (1 - rate)))
    bad = min(0.9, max(1e-3, float(np.mean([(r["quality"] == 0) or bool(r["toxic"]) for r in rows]))))
    return Model(weights, insults, bad, rate)


def _rate(toxic: float, clean: float, rate: float, strength: float = 6.0) -> float:
    return (toxic + strength * rate) / (toxic + clean + strength)


def _spread(groups: DataFrame, mean) -> float:
    """The weight of a prior: within variance over that between groups (n, s); one aggregation, however many there are."""
    p, within = F.col("s") / F.col("n"), F.greatest(mean * (1 - mean), F.lit(1e-6))
    row = groups.agg(F.sum(F.col("n") * ((p - mean) * (p - mean) - within / F.col("n"))).alias("b"), F.sum(F.col("n") * within).alias("w"), F.sum("n").alias("n")).first()
    if not row["n"]:
        return 1.0
    return float(np.clip((row["w"] / row["n"]) / max(row["b"] / row["n"], 1e-6) - 1, 1.0, 1e5))


def measured(docs: DataFrame, model: Model, host: str, path: str, carry: list[str]) -> DataFrame:
    """(row, host, path, junk, toxic, bad): the ``carry`` columns in one struct, the log odds of both kinds and their joint probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, junk, toxic in held.value.evidence(batch.column(1)):
                bad = 1 - 1 / (1 + np.exp(np.clip(junk, -30, 30))) / (1 + np.exp(np.clip(toxic, -30, 30)))
                part = batch.slice(first, len(junk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(junk), pa.array(toxic), pa.array(bad)], names)

    names = ["row", "host", "path", "junk", "toxic", "bad"]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    picked = docs.select(row.alias("row"), F.col("text").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    return picked.mapInArrow(run, StructType([picked.schema["row"], *StructType.fromDDL("host string, path string, junk double, toxic double, bad double")]))


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, carry: list[str], sample: int) -> DataFrame:
    """(row, verdict): the ``carry`` columns and the verdict's columns, each in one struct, so that no names can clash."""
    model = fit(docs, labels, sample)
    if model is None:
        named = lambda *x: F.struct(*[F.lit(v).alias(k) for k, v in zip(VERDICT, x)])
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), named(1.0, 0.0, 0.0, 0.0, 0.0, False).alias("verdict"))
    sums = measured(docs, model, host, path, []).groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("s"))
    sites, mean = rates(scratch.keep(sums, "sites"))
    # a row a site and path: sent to all tasks while few, so that documents stay where they are
    sites = scratch.keep(sites, "rates", 0)
    if sites.count() <= SITES:
        sites = F.broadcast(sites)
    out = measured(docs, model, host, path, carry).join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    odds = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    # the site speaks for junk; an insult is in the document or not, whoever the site is
    junk = 1 / (1 + F.exp(-(F.col("junk") + odds(F.col("path_rate")) - odds(F.lit(mean)))))
    out = out.withColumn("pj", junk).withColumn("pt", 1 / (1 + F.exp(-F.col("toxic"))))
    score = (1 - F.col("pj")) * (1 - F.col("pt"))
    least = max(1 / (1 + COST), min(RATE, 1.01 * model.toxic))  # a text without any insult word has the share of toxic texts
    rejected = (score < 1 - REJECT) | (F.col("pt") > least)
    return out.select("row", F.struct(*[x.alias(k) for k, x in zip(VERDICT, (score, F.col("pj"), F.col("pt"), F.col("host_rate"), F.col("path_rate"), rejected))]).alias("verdict"))


def rates(sums: DataFrame) -> tuple[DataFrame, float]:
    """(h, p, host_rate, path_rate) of sites (host, path, n documents, s of them bad by expectation), and the rate of all.

    A host's rate is (s + k * mean) / (n + k), a path's the same about its host's rate; each k is the spread's.
    """
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    row = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(0.99, max(1e-4, (row["s"] or 0) / max(row["n"] or 0, 1)))
    k = _spread(hosts, F.lit(mean))
    rated = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_rate"))
    sites = sums.join(rated, F.col("host").eqNullSafe(F.col("h")))
    k = _spread(sites, F.col("host_rate"))
    return sites.select("h", F.col("path").alias("p"), "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), mean


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality_score (1 - posterior), p_junk, p_toxic, host_rate, path_rate, rejected of every row of ``docs``."""
    return _scored(docs, labels, host, path, ["doc_id"], sample).select("row.doc_id", "verdict.*")


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns as they are."""
    return _scored(docs, labels, host, path, docs.columns, sample).where("not verdict.rejected").select("row.*")
