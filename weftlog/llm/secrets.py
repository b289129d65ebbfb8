"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans to theirs.

Words of a text are tagged secret-begin, inside or outside. Features are a word's shape (classes,
length, changes between letters and digits), the two words before it and the one after, and the file's share of
words with signs. A field over these is trained on the words that the patterns mark in at most ``sample`` documents,
chosen by hash: on at most ``stretches`` distinct stretches, those with a secret first and then by hash, each
counted as often as it occurs, and on the first ``LONGEST`` words of a stretch. Each is also shown without the
features of neighbours and without those of shape, so that either can tell a secret that no pattern has. It is
decoded by Viterbi, over whole stretches. Words with a digit or "=", of 24 and more bytes, with a name such as
"credential", or with ":" at the end, and the two words on either side of each, are trained on and decoded. The
rest is outside: no feature of those words speaks of a secret.

Null and empty texts have no spans; null doc_ids and repeated rows are rows like others. Extra columns pass through
``redacted`` and are left out elsewhere. Without any pattern's secret to learn from the field adds nothing. Every text is read whole. Spans of one kind never overlap; a span of
the field is dropped where it meets one of the patterns. Positions count code points, the end excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .wordhash import SPACED, slices, words

#: The fixed kinds, in the order in which spans with the same start are listed.
KINDS = ["assign", "access", "hex", "crf"]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_NAMES = re.compile(rb"passw|secret|token|api_?key|credential|auth|private", re.IGNORECASE)
#: Documents that the field is trained on, distinct stretches of them, and the words of one training sequence.
SAMPLE, STRETCHES, LONGEST = 20_000, 3_000, 24
FEATURES = 22
#: Features of the words around a word.
_AROUND = [13, 14, 15, 20, 21]
_VIEWS = np.ones((3, FEATURES))
_VIEWS[1, _AROUND] = 0
_VIEWS[2, [k for k in range(1, FEATURES) if k not in _AROUND]] = 0
#: What _NAMES finds, in lower case; none begins as it ends, so that places found one after another are all.
_NAMED = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"credential", b"auth", b"private")
_EDGE = b"\"'`.,;:()[]{}<>!*#$%&|"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789=")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def base_spans(raw: bytes, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns; ``hexes``: the runs of 24 and more hex digits, if known."""
    out = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if hexes is None:
        hexes = [m.span() for m in re.finditer(rb"[0-9a-f]+", raw) if m.end() - m.start() >= 24]
    return out + [(a, 2, b) for a, b in hexes]


def _code_points(raw: bytes, places: set[int]) -> dict[int, int]:
    out, at, n = {}, 0, 0
    for p in sorted(places):
        n += len(raw[at:p].decode("utf-8", "ignore"))
        at = p
        out[p] = n
    return out


def _shape(word: bytes, before: bytes, before2: bytes, after: bytes, busy: bool) -> np.ndarray:
    digits = sum(48 <= c < 58 for c in word)
    upper, lower = any(65 <= c < 91 for c in word), any(97 <= c < 123 for c in word)
    core = word.strip(_EDGE)
    changes = sum((48 <= a < 58) != (48 <= b < 58) for a, b in zip(core, core[1:]))
    n = len(core)
    plain = core.isalnum()
    return np.array(
        [1, digits > 0, upper, lower, not plain, n > 0 and not core.strip(b"0123456789abcdef"), n >= 12, n >= 20, n >= 32, digits * 5 > n, changes >= 4, changes >= 8, bool(_NAMES.search(word)), bool(_NAMES.search(before)), before[-1:] in (b"=", b":"), bool(_NAMES.search(before2)), b"=" in word or b":" in word, n > 0 and digits * 10 >= 8 * n, b"@" in word, busy, bool(_NAMES.search(after)), after[:1] in (b"=", b":")],
        np.float64,
    )


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words hold a name or end with a colon: what follows them may be a secret, whatever its shape."""
    hit = np.zeros(len(starts), bool)
    if not len(starts):
        return hit
    hit |= data[ends - 1] == 58
    low = data.tobytes().lower()
    for name in _NAMED:
        at = low.find(name)
        while at >= 0:
            k = int(np.searchsorted(ends, at, "right"))
            if k < len(ends) and starts[k] <= at and at + len(name) <= ends[k]:
                hit[k] = True
            at = low.find(name, at + 1)
    return hit


def sequences(column: pa.Array) -> Iterator[tuple[int, bytes, list, list]]:
    """(row, bytes of its text, runs of hex digits, [words of a stretch to decode as (start, end, features)])."""
    for first, data, offsets in slices(column):
        starts, ends, count = words(data, offsets, SPACED)
        run = np.concatenate([[0], np.cumsum(_MARK[data])])
        odd = (run[ends] > run[starts]) | (ends - starts >= 24)
        marked = odd | named(data, starts, ends)
        inside = np.concatenate([[False], _HEX[data], [False]])
        cut = offsets[1:-1]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        h0, h1 = edges[::2], edges[1::2]
        long = h1 - h0 >= 24
        h0, h1 = h0[long], h1[long]
        at = np.flatnonzero(marked)
        owner, hexed = np.searchsorted(count, at, "right") - 1, np.searchsorted(offsets, h0, "right") - 1
        for d in range(len(offsets) - 1):
            own = at[owner == d] if len(at) < 64 else at[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")]
            a, b = int(offsets[d]), int(offsets[d + 1])
            hexes = [(int(x - a), int(min(y, b) - a)) for x, y in zip(h0[hexed == d], h1[hexed == d])] if len(h0) else []
            raw = data[a:b].tobytes()
            if len(cut) and len(h0) and any(y > b for y in h1[hexed == d]):  # a run of hex digits goes on in the next text
                hexes = None
            if len(h0) and d and hexes is not None and any(x < a < y for x, y in zip(h0, h1)):
                hexes = None
            if not len(own):
                yield first + d, raw, hexes, []
                continue
            w0, w1 = int(count[d]), int(count[d + 1])
            busy = np.count_nonzero(odd[w0:w1]) > 0.3 * (w1 - w0) and w1 - w0 > 20
            groups = np.split(own, np.flatnonzero(np.diff(own) > 4) + 1)
            found = []
            for g in groups:
                low, high = max(w0, int(g[0]) - 2), min(w1, int(g[-1]) + 3)
                word = [data[starts[k] : ends[k]].tobytes() for k in range(max(w0, low - 2), min(w1, high + 1))]
                lead = low - max(w0, low - 2)
                shapes = [_shape(word[k], word[k - 1] if k else b"", word[k - 2] if k > 1 else b"", word[k + 1] if k + 1 < len(word) else b"", busy) for k in range(lead, lead + high - low)]
                found.append([(int(starts[low + k] - a), int(ends[low + k] - a), s) for k, s in enumerate(shapes)])
            yield first + d, raw, hexes, found


class Field:
    """A chain over outside (0), begin (1) and inside (2): ``emit`` (features by tags) and ``move`` (tags by tags)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi's best tags; inside never follows outside or comes first."""
        score = x @ self.emit
        best = score[0] + np.array([0, 0, -1e9])
        back = []
        for k in range(1, len(x)):
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score[k]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def train(samples: list[tuple[np.ndarray, np.ndarray]], weights: list[float] | None = None, turns: int = 120, ridge: float = 1e-5) -> Field | None:
    """Maximum likelihood by gradient steps over all sequences at once, each counted by its weight; None without any secret."""
    samples = [(x[:LONGEST], y[:LONGEST]) for x, y in samples]
    if not any((y > 0).any() for _, y in samples):
        return None
    samples, weights = [(x * v, y) for v in _VIEWS for x, y in samples], list(weights or [1.0] * len(samples)) * len(_VIEWS)
    n, t = len(samples), max(len(y) for _, y in samples)
    share = np.array(weights, float) / sum(weights)
    x, y, real = np.zeros((n, t, FEATURES)), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for k, (a, b) in enumerate(samples):
        x[k, : len(b)], y[k, : len(b)], real[k, : len(b)] = a, b, True
    barred = np.zeros((3, 3))
    barred[0, 2] = -1e9
    emit, move = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    hot = np.eye(3)[y] * (real * share[:, None])[..., None]
    want_e = np.einsum("ntf,ntk->fk", x, hot)
    want_m = np.einsum("nti,ntj->ij", hot[:, :-1], np.eye(3)[y][:, 1:] * real[:, 1:, None])
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    log = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
    for turn in range(1, turns + 1):
        score, m = x @ emit, move + barred
        a = np.zeros((n, t, 3))
        a[:, 0] = score[:, 0] + np.array([0, 0, -1e9])
        for k in range(1, t):
            a[:, k] = np.where(real[:, k, None], log(a[:, k - 1][:, :, None] + m, 1) + score[:, k], a[:, k - 1])
        z = log(a[:, -1], 1)
        b = np.zeros((n, t, 3))
        pair = np.zeros((3, 3))
        for k in range(t - 2, -1, -1):
            step = m + (score[:, k + 1] + b[:, k + 1])[:, None, :]
            b[:, k] = np.where(real[:, k + 1, None], log(step, 2), b[:, k + 1])
            pair += np.einsum("nij,n->ij", np.exp(np.minimum(a[:, k][:, :, None] + step - z[:, None, None], 0)), share * real[:, k + 1])
        prob = np.exp(np.minimum(a + b - z[:, None, None], 0)) * (real * share[:, None])[..., None]
        grads = [np.einsum("ntf,ntk->fk", x, prob) - want_e + ridge * emit, pair - want_m + ridge * move]
        for w, g, p, q in ((emit, grads[0], *moments[:2]), (move, grads[1], *moments[2:])):
            p += 0.1 * (g - p)
            q += 0.03 * (g * g - q)
            w -= 0.1 * (1 - turn / (turns + 1)) * (p / (1 - 0.9**turn)) / (np.sqrt(q / (1 - 0.97**turn)) + 1e-8)
    return Field(emit, move + barred)


def fit(docs: DataFrame, sample: int = SAMPLE, stretches: int = STRETCHES) -> Field | None:
    """Trains the field on what the patterns mark in a bounded sample of documents."""
    docs = docs.select("doc_id", "text").where("text is not null")
    some = vectors.sampled(docs, F.col("doc_id"), sample, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for _, raw, hexes, found in sequences(batch.column(1)):
                if not found:
                    continue
                spans = base_spans(raw, hexes)
                for stretch in found:
                    y, last = [], None
                    for a, b, _ in stretch[:LONGEST]:
                        # of a pattern with a name and a value, the value is the secret
                        hit = next((s for s in spans if s[0] < b and a < s[2] and (s[1] or b >= s[2])), None)
                        y.append(0 if hit is None else 2 if hit == last else 1)
                        last = hit
                    xs.append(np.packbits(np.array([s for _, _, s in stretch[:LONGEST]], bool)).tobytes()), ys.append(bytes(y))
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    secret = F.regexp_replace(F.hex("y"), "0", "") != ""
    rows = some.mapInArrow(run, "x binary, y binary").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy(secret.desc(), F.xxhash64("x", "y")).limit(stretches).collect()
    return train([(np.unpackbits(np.frombuffer(r["x"], np.uint8))[: len(r["y"]) * FEATURES].reshape(-1, FEATURES).astype(float), np.frombuffer(r["y"], np.uint8).astype(np.int64)) for r in rows], [r["n"] for r in rows]) if rows else None


def _all_spans(raw: bytes, hexes: list | None, found: list, field: Field | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: of the patterns, and of the field where it adds some."""
    base = base_spans(raw, hexes)
    added = []
    for stretch in found if field is not None else []:
        tags = field.decode(np.array([s for _, _, s in stretch]))
        k = 0
        while k < len(tags):
            if tags[k] == 1:
                end = k
                while end + 1 < len(tags) and tags[end + 1] == 2:
                    end += 1
                a, b = stretch[k][0], stretch[end][1]
                part = raw[a:b]
                a += len(part) - len(part.lstrip(_EDGE))
                b -= len(part) - len(part.rstrip(_EDGE))
                if a < b and not any(x < b and a < y for x, _, y in base):
                    added.append((a, 3, b))
                k = end
            k += 1
    return sorted(base + added)


def scanned(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every document, by start and then kind."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raw, hexes, found in sequences(batch.column(1)):
                spans = _all_spans(raw, hexes, found, held.value)
                place = _code_points(raw, {p for s in spans for p in (s[0], s[2])})
                out.append([{"kind": KINDS[k], "start": place[a], "end": place[b]} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every document."""
    found = scanned(docs, fit(docs, sample))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "crf"), line), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), count("crf"))


def redacted(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all columns and every span replaced by ``mark``; n_chars, where there is one, follows the text."""
    held, names = docs.sparkSession.sparkContext.broadcast(field), docs.columns
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for row, raw, hexes, found in sequences(batch.column(place)):
                spans = _all_spans(raw, hexes, found, held.value)
                if spans:
                    out, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            out += [raw[at:a], mark.encode()]
                        at = max(at, b)
                    new[row] = b"".join([*out, raw[at:]]).decode()
            if new:
                texts = batch.column(place).to_pylist()
                for row, text in new.items():
                    texts[row] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
                if size is not None:
                    counts = batch.column(size).to_pylist()
                    for row, text in new.items():
                        counts[row] = len(text)
                    batch = batch.set_column(size, batch.schema.field(size), pa.array(counts, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
