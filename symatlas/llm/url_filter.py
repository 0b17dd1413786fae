"""URL filter: allow and block rules, and gradient-boosted trees on lexical features (operator 5).

The URLs that a rule decides are the labelled ones. A bounded sample of them (about SAMPLE rows, drawn
by hash) trains boosted regression trees on the logistic loss in numpy; the trees decide the
URLs that no rule fits. Features: lengths, depth, digit and letter ratios, entropy, parameter counts,
and smoothed statistics of how URLs with the same host suffix, first path segment or ending were labelled.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule and is judged
by the trees as the empty URL; without labelled URLs the verdict is allow, and with labels of one kind
it is that kind; repeated URLs are judged alike; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, sampling

#: Fixed values: (rule, verdict). The rule's host ends at its first slash.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
SAMPLE = 10_000
ROUNDS, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 5


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.encode().lower().decode(), path


def ruled(host, path, rules=RULES):
    """Columns (rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, judged in sorted(rules, key=lambda r: len(r[0])):  # the longest is laid on last and wins
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path, by built-in functions."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", F.coalesce(ascii_lower, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def endings(host: str, path: str) -> tuple[str, str, str]:
    """The parts whose label statistics are features: host suffix, first path segment, file ending."""
    last = path.rsplit("/", 1)[-1]
    return host.rsplit(".", 1)[-1], path[1:].split("/", 1)[0], last.rsplit(".", 1)[1] if "." in last else ""


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), url.count("-"), host.count("-"),
        sum(c.isdigit() for c in url) / n, sum(c.isalpha() for c in url) / n, entropy(url), entropy(host),
        len(query), query.count("=") + (query.count("&") if query else 0), float("#" in url), float(url.startswith("https")),
        float(path.endswith("/")), max((len(x) for x in host.split(".")), default=0), sum(c.isdigit() for c in path),
    ]


class Model:
    """Boosted trees over lexical features and label statistics."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.constant = None
        labels = np.array([r[3] for r in rows], float)
        if not len(rows) or labels.min() == labels.max():
            self.constant = float(labels[0]) if len(rows) else 1.0
            return
        self.prior = float(labels.mean())
        self.rates: list[dict[str, float]] = []
        for k in range(3):
            sums: dict[str, list[float]] = {}
            for url, host, path, label in rows:
                both = sums.setdefault(endings(host, path)[k], [0.0, 0.0])
                both[0] += label
                both[1] += 1
            self.rates.append({key: (a + 10 * self.prior) / (b + 10) for key, (a, b) in sums.items() if b >= LEAST})
        x = self.table([r[:3] for r in rows])
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self.binned(x)
        self.start = math.log(self.prior / (1 - self.prior))
        f = np.full(len(rows), self.start)
        self.trees = []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = grown(binned, labels - p, p * (1 - p), DEPTH)
            f += RATE * applied(tree, binned)
            self.trees.append(tree)

    def table(self, rows) -> np.ndarray:
        out = [lexical(*r) + [rate.get(key, self.prior) for rate, key in zip(self.rates, endings(r[1], r[2]))] for r in rows]
        return np.array(out, float).reshape(len(rows), -1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def chances(self, rows) -> np.ndarray:
        """Probability of allow."""
        if self.constant is not None or not len(rows):
            return np.full(len(rows), self.constant or 0.0)
        binned = self.binned(self.table(rows))
        f = np.full(len(rows), self.start)
        for tree in self.trees:
            f += RATE * applied(tree, binned)
        return 1 / (1 + np.exp(-f))


def grown(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A tree as nested (feature, bin, left, right), or a number at a leaf."""
    g, h = gradient.sum(), weight.sum()
    leaf = float(g / (h + 1.0))
    if not depth or len(gradient) < 2 * LEAST:
        return leaf
    best, where = 1e-6, None
    for j in range(binned.shape[1]):
        gs = np.cumsum(np.bincount(binned[:, j], gradient, BINS + 1))[:-1]
        hs = np.cumsum(np.bincount(binned[:, j], weight, BINS + 1))[:-1]
        ns = np.cumsum(np.bincount(binned[:, j], minlength=BINS + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST) | (len(gradient) - ns < LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (j, k)
    if where is None:
        return leaf
    left = binned[:, where[0]] <= where[1]
    return (*where, grown(binned[left], gradient[left], weight[left], depth - 1), grown(binned[~left], gradient[~left], weight[~left], depth - 1))


def applied(tree, binned: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(binned), tree)
    j, k, left, right = tree
    return np.where(binned[:, j] <= k, applied(left, binned), applied(right, binned))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and, where the trees judged, the probability of allow."""
    common.tuned(pages.sparkSession)
    found = located(pages)
    rule, verdict = ruled(F.col("host"), F.col("path"))
    found = found.withColumns({"rule": rule, "ruled": verdict})
    labelled = found.filter(F.col("rule").isNotNull()).select("page_id", "url", "host", "path", "ruled")
    sample = sampling.by_hash(labelled, SAMPLE, "page_id", "url").collect()
    model = Model([(r["url"], r["host"], r["path"], int(r["ruled"] == "allow")) for r in sorted(sample, key=lambda r: r["url"])])

    def make():
        def step(batch):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path", "rule", "ruled"))))
            free = [i for i, r in enumerate(rows) if r[3] is None]
            chance = dict(zip(free, model.chances([rows[i][:3] for i in free]).tolist()))
            out = {c: batch.column(c) for c in ("page_id", "host", "path", "rule")}
            out["verdict"] = [r[4] or ("allow" if chance[i] >= 0.5 else "block") for i, r in enumerate(rows)]
            out["allow_chance"] = [chance.get(i) for i in range(len(rows))]
            return out

        return step

    kinds = [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("allow_chance", pa.float64())]
    return common.map_batches(found.withColumn("page_id", F.col("page_id").cast("long")), make, "page_id long, host string, path string, rule string, verdict string, allow_chance double", kinds)


def op5(spark, sf_dir):
    return judge(common.table(spark, sf_dir, "pages", "page_id", "url"))
