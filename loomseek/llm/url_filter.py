"""URL filter: gradient-boosted trees on lexical features of the URL, trained here from labelled URLs.

Features: lengths, depth, ratio of digits, entropy, numbers of parameters, hyphens and labels, and statistics of the host's
public suffix (how often the labelled rows have it, and its smoothed share of bad ones; a row that is trained on is left out of
its own suffix's statistics). Trees are grown on binned features with second-order gains for the logistic loss. The classes
are sampled apart; their rows are weighted to the shares that the classes have in the whole table, so a URL's score
doesn't hang on the table's size. Scoring is one pass over the table, the URLs alone being read.

Definitions. A null URL has a null score and is kept; an empty or malformed one has the features of an empty host. Rows alike are
scored alike. A score that equals the threshold rejects. Without rows of both classes nothing is filtered (score null).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length",
            "hyphens", "host_hyphens", "labels", "longest_label", "https", "fragment", "suffix_count", "suffix_bad")
#: Words of seed hosts by which URLs are labelled where a table has no labels of its own.
SEED_BAD = ("adult", "xxx", "porn", "casino", "bets", "pills", "spam", "ads", "track", "malware", "warez")
_BINS, _SMOOTH = 64, 20


def seed_label(url: Column) -> Column:
    """1 if a part of the host, cut at dots and hyphens, is a word of the seed list, else 0; null for a null URL."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in SEED_BAD])).cast("int")


def parts(url: str) -> tuple[str, str, str, str, str]:
    """(scheme, host, path, query, fragment), by RFC 3986's own regular cut; never fails."""
    rest, _, fragment = url.partition("#")
    rest, _, query = rest.partition("?")
    scheme, sep, rest_ = rest.partition("://")
    if not sep or "/" in scheme:
        return "", "", rest, query, fragment
    host, slash, path = rest_.partition("/")
    return scheme.lower(), host.rpartition("@")[2].partition(":")[0].lower(), slash + path, query, fragment


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _digits(s: str) -> float:
    return sum(c.isdigit() for c in s) / len(s) if s else 0.0


def suffix(host: str) -> str:
    """The last label of a host, or the last two of such as co.uk: a country's code after a label of at most three letters."""
    labels = host.split(".")
    return ".".join(labels[-2:] if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-1:])


def features(url: str, suffixes: dict[str, tuple[float, float]], prior: float, own: tuple[float, int] | None = None) -> list[float]:
    """``suffixes``: weight of all labelled rows and of bad ones by suffix. ``own``: weight and class of a row that is among them."""
    scheme, host, path, query, fragment = parts(url)
    labels = host.split(".") if host else []
    count, bad = suffixes.get(suffix(host), (0.0, 0.0))
    if own is not None:
        count, bad = count - own[0], bad - own[0] * own[1]
    return [len(url), len(host), len(path), sum(1 for p in path.split("/") if p), _digits(url), _digits(host), _entropy(url), _entropy(host),
            query.count("&") + 1 if query else 0, len(query), url.count("-"), host.count("-"), len(labels), max(map(len, labels), default=0),
            scheme == "https", bool(fragment), math.log1p(max(count, 0.0)), (bad + _SMOOTH * prior) / (count + _SMOOTH)]


@dataclass(frozen=True)
class UrlModel:
    """Trees as arrays of (feature, cut, left, right, value) over nodes; a leaf has feature -1."""

    base: float
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    suffixes: dict[str, tuple[float, float]]
    prior: float

    def score(self, urls: list[str]) -> np.ndarray:
        """Probability that each URL is bad."""
        x = np.array([features(u, self.suffixes, self.prior) for u in urls], np.float64).reshape(len(urls), len(FEATURES))
        total = np.full(len(urls), self.base)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(urls), np.int64)
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                n = node[at]
                node[at] = np.where(x[at, feature[n]] <= cut[n], left[n], right[n])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: float, ridge: float) -> tuple:
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0)):
            a.append(v)
        gs, hs = g[rows].sum(), h[rows].sum()
        value.append(-gs / (hs + ridge))
        best = (1e-6, -1, 0)
        if level < depth and hs >= 2 * least:
            for f in range(bins.shape[1]):
                if not len(cuts[f]):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, f], g[rows], _BINS + 1))[: len(cuts[f])]
                hl = np.cumsum(np.bincount(bins[rows, f], h[rows], _BINS + 1))[: len(cuts[f])]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            side = bins[rows, f] <= k
            feature[me], cut[me] = f, float(cuts[f][k])
            left[me] = node(rows[side], level + 1)
            right[me] = node(rows[~side], level + 1)
        return me

    node(np.arange(len(g)), 0)
    return tuple(np.array(a) for a in (feature, cut, left, right, value))


def fit(rows: Iterable[tuple[str, int]], *, totals: tuple[int, int] | None = None, trees: int = 80, depth: int = 4, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> UrlModel | None:
    """Train on (url, bad) pairs; None without rows of both classes. ``totals``: how many rows of class 0 and 1 these stand for."""
    rows = [(u, int(y)) for u, y in rows if u is not None and y is not None]
    y = np.array([b for _, b in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    totals = totals or (int(len(y) - y.sum()), int(y.sum()))
    weigh = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum())) * len(y) / sum(totals)
    prior = totals[1] / sum(totals)
    suffixes: dict[str, tuple[float, float]] = {}
    for (u, b), w in zip(rows, weigh.tolist(), strict=True):
        x = suffix(parts(u)[1])
        n, bad = suffixes.get(x, (0.0, 0.0))
        suffixes[x] = n + w, bad + w * b
    x = np.array([features(u, suffixes, prior, (w, b)) for (u, b), w in zip(rows, weigh.tolist(), strict=True)], np.float64)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < _BINS else np.unique(np.quantile(middle, np.linspace(0, 1, _BINS))))
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    base = math.log(prior / (1 - prior))
    total, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(bins, weigh * (p - y), np.maximum(weigh * p * (1 - p), 1e-9), cuts, depth, least, ridge)
        tree = (*tree[:4], tree[4] * rate)
        node = np.zeros(len(y), np.int64)
        while (inner := tree[0][node] >= 0).any():
            at = np.flatnonzero(inner)
            n = node[at]
            node[at] = np.where(x[at, tree[0][n]] <= tree[1][n], tree[2][n], tree[3][n])
        total += tree[4][node]
        grown.append(tree)
    return UrlModel(base, tuple(grown), suffixes, prior)


def sample_labelled(pages: DataFrame, label: Column, most: int = 20_000) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most ``most`` labelled rows of each class, chosen by a hash of the URL, in a fixed order; rows alike count once. And how many there are of class 0 and 1."""
    rows = pages.select("url", label.alias("bad")).where("url IS NOT NULL AND bad IN (0, 1)").distinct()
    counts = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
    out = []
    for value in (1, 0):
        part = rows.where(F.col("bad") == value).orderBy(F.xxhash64("url"), "url").limit(most)
        out += [(r.url, r.bad) for r in part.collect()]
    return out, (counts.get(0, 0), counts.get(1, 0))


def classify(pages: DataFrame, model: UrlModel | None, threshold: float = 0.5, score: str = "url_score", keep: str = "keep") -> DataFrame:
    """``pages`` with the score of its column url and whether the row is kept; columns with these names are replaced."""

    @F.arrow_udf("double")
    def scores(urls: pa.Array) -> pa.Array:
        if model is None:
            return pa.nulls(len(urls), pa.float64())
        known = [u for u in urls.to_pylist() if u is not None]
        got = iter(model.score(known).tolist())
        return pa.array([next(got) if v else None for v in urls.is_valid().to_pylist()], pa.float64())

    return pages.withColumn(score, scores(F.col("url"))).withColumn(keep, F.coalesce(F.col(score) < threshold, F.lit(True)))
