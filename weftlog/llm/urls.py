"""URL filter: rules by longest match, and gradient-boosted trees over lexical features for the rest.

A rule is a host and a path, and a verdict. It fits its host and all subdomains when the url's path starts
with its path; of several the longest (host and path together) decides. Trees are trained on urls with
known verdicts (those that a rule decides, or given labels), at most ``sample`` distinct ones chosen by
hash, and judge the urls without a rule. Features: lengths, depth, digit ratio, entropy, numbers of
parameters, hyphens, labels of the host, and how often urls with the same last one and two host labels
were blocked, shrunk toward the overall share.

Null urls and urls without "://" have empty host and path, fit no rule and are judged by the trees as such. With no
training url, or only one verdict among them, the trees are one constant (allow without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

#: The rules that the filter applies unless given others: rule, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Distinct labelled urls that the trees are trained on.
SAMPLE = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: str) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: str) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: str, path: str) -> str | None:
    """The longest rule that fits, by a look-up of the host's suffixes; equal lengths: the longer host."""
    index: dict[str, list[str]] = _indexed(tuple(r for r, _ in rules))
    labels = host.split(".")
    best = None
    for k in range(len(labels)):
        name = ".".join(labels[k:])
        for rule in index.get(name, ()):
            if path.startswith(rule[len(name) :]) and (best is None or len(rule) > len(best)):
                best = rule
    return best


_INDEXES: dict[tuple, dict] = {}


def _indexed(rules: tuple[str, ...]) -> dict[str, list[str]]:
    if rules not in _INDEXES:
        out: dict[str, list[str]] = {}
        for r in rules:
            out.setdefault(r[: r.index("/")], []).append(r)
        _INDEXES[rules] = out
    return _INDEXES[rules]


def _part(text: pa.Array, pattern: str) -> pa.Array:
    """The group ``x`` of a pattern, or the empty text."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(text, pattern), "x"), "")


def _entropy(urls: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Bits of a character of each url: every (row, code point) is counted once for all rows of a batch."""
    points = np.frombuffer("".join(urls.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    pair, count = np.unique(np.repeat(np.arange(len(lengths)), lengths) << 21 | points, return_counts=True)
    row = pair >> 21
    share = count / lengths[row]
    return np.bincount(row, -share * np.log2(share), len(lengths))


def features(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """The lexical features, a row of numbers a url; a url's numbers do not depend on its batch. Digits are 0 to 9."""
    urls, numbers = pc.fill_null(urls, ""), lambda found: np.asarray(found).astype(np.float64)
    query = _part(urls, r"^[^?]*\?(?P<x>[^#]*)")
    lengths = np.asarray(pc.utf8_length(urls)).astype(np.int64)
    labels = pc.split_pattern(hosts, ".")
    widest = np.maximum.reduceat(np.asarray(pc.utf8_length(labels.flatten())), np.cumsum(np.r_[0, np.asarray(pc.list_value_length(labels))[:-1]]))
    columns = [
        lengths,
        pc.utf8_length(hosts),
        pc.utf8_length(paths),
        pc.count_substring(paths, "/"),
        np.asarray(pc.count_substring_regex(urls, "[0-9]")) / np.maximum(lengths, 1),
        _entropy(urls, lengths),
        pc.count_substring(query, "="),
        pc.utf8_length(query),
        pc.count_substring(hosts, "-"),
        pc.list_value_length(labels),
        widest,
        pc.starts_with(urls, "https").cast(pa.int8()),
        pc.match_substring(urls, "#").cast(pa.int8()),
        pc.match_substring_regex(paths, r"\.[^/]*$").cast(pa.int8()),
        pc.utf8_length(_part(paths, "^[^/]*/(?P<x>[^/]*)")),
    ]
    return np.column_stack([numbers(c) for c in columns])


def matched(rules: list[tuple[str, str]], hosts: pa.Array, paths: pa.Array) -> list[str | None]:
    """``rule_of`` of every row: hosts are looked up once each, and only rows whose host has a rule look at their path."""
    index, coded = _indexed(tuple(r for r, _ in rules)), hosts.dictionary_encode()
    named = []
    for host in coded.dictionary.to_pylist():
        labels = host.split(".")
        named.append(any(".".join(labels[k:]) in index for k in range(len(labels))))
    found: list[str | None] = [None] * len(hosts)
    for k in np.flatnonzero(np.array(named, bool)[np.asarray(coded.indices)]) if len(hosts) else ():
        found[k] = rule_of(rules, hosts[k].as_py(), paths[k].as_py())
    return found


class Trees:
    """Boosted regression trees of the logistic loss over quantile bins, and the suffixes' block rates."""

    def __init__(self, start: float, trees: list, rates: dict[str, float], share: float):
        self.start, self.trees, self.rates, self.share = start, trees, rates, share

    def suffixes(self, hosts: pa.Array) -> np.ndarray:
        """The block rates of the last one, two and three labels, looked up once a distinct host."""
        coded = hosts.dictionary_encode()
        labels = [h.split(".") for h in coded.dictionary.to_pylist()]
        rates = np.array([[self.rates.get(".".join(x[-k:]), self.share) for k in (1, 2, 3)] for x in labels])
        return rates.reshape(-1, 3)[np.asarray(coded.indices)]

    def inputs(self, urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        return np.hstack([features(urls, hosts, paths), self.suffixes(hosts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability that each row is to be blocked."""
        total = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                f, cut = nodes["feature"][at], nodes["cut"][at]
                leaf = f < 0
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut, 2 * at + 1, 2 * at + 2)
                at = np.where(leaf, at, go)
            total += nodes["value"][at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32, least: int = 5) -> tuple[float, list]:
    """Depth-three trees by histograms of gradients; ties go to the first feature and cut."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start, total, trees = math.log(p / (1 - p)), np.full(len(y), math.log(p / (1 - p))), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        g, h = y - q, q * (1 - q)
        nodes = {"feature": np.full(15, -1), "cut": np.zeros(15), "value": np.zeros(15)}
        at = np.zeros(len(y), np.int64)
        for node in range(7):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs, best = g[mine].sum(), h[mine].sum(), (1e-6, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                a = np.cumsum(np.bincount(code[mine, f], g[mine], len(c) + 1))[:-1]
                b = np.cumsum(np.bincount(code[mine, f], h[mine], len(c) + 1))[:-1]
                k = np.cumsum(np.bincount(code[mine, f], minlength=len(c) + 1))[:-1]
                gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                gain[(k < least) | (len(mine) - k < least)] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), f, j)
            if best[1] >= 0:
                nodes["feature"][node], nodes["cut"][node] = best[1], cuts[best[1]][best[2]]
                at[mine] = np.where(code[mine, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
        for node in range(15):
            mine = at == node
            if mine.any():
                nodes["value"][node] = rate * g[mine].sum() / (h[mine].sum() + 1)
        total += nodes["value"][at]
        trees.append(nodes)
    return start, trees


def _parsed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), host("url").alias("host"), path("url").alias("path"))


def fit(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> Trees:
    """Trains on the urls that rules decide, or on ``labels`` (url, verdict)."""
    verdicts = dict(rules)
    rows = _parsed(pages).select("url", "host", "path") if labels is None else labels.select("url", host("url").alias("host"), path("url").alias("path"), "verdict")
    fits = F.lit(False)
    for rule, _ in rules:
        name, rest = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = fits | (((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(rest))
    rows = (rows.where(fits) if labels is None else rows).distinct()
    got = vectors.sampled(rows, F.col("url"), sample, rows.count()).orderBy("url").collect()
    if not got:
        return Trees(-10.0, [], {}, 0.0)
    y = np.array([float((verdicts[rule_of(rules, r["host"], r["path"])] if labels is None else r["verdict"]) == "block") for r in got])
    share = float(y.mean())
    seen: dict[str, list[float]] = {}
    for r, v in zip(got, y):
        parts = r["host"].split(".")
        for name in {".".join(parts[-k:]) for k in (1, 2, 3)}:
            n = seen.setdefault(name, [0.0, 0.0])
            n[0], n[1] = n[0] + 1, n[1] + v
    rates = {k: (b + 10 * share) / (n + 10) for k, (n, b) in seen.items() if n >= 3}
    model = Trees(0.0, [], rates, share)
    x = model.inputs(*[pa.array([r[c] for r in got], pa.string()) for c in ("url", "host", "path")])
    model.start, model.trees = boosted(x, y) if 0 < share < 1 else (20 * share - 10, [])
    return model


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score is the trees' probability of a block."""
    held = pages.sparkSession.sparkContext.broadcast((fit(pages, rules, labels, sample), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rules = held.value
        verdicts = dict(rules)
        for batch in batches:
            if not batch.num_rows:
                continue
            urls, hosts, paths = (batch.column(k).cast(pa.string()) for k in (1, 2, 3))
            score = model.score(model.inputs(urls, hosts, paths))
            found = matched(rules, hosts, paths)
            verdict = [verdicts[r] if r else "block" if s > 0.5 else "allow" for r, s in zip(found, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(found, pa.string()), pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return _parsed(pages).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
