"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows, one on toxic and one on ordinary text, each on the stretches that
its class has far more often than the other; both begin with what the trainer picks from whole ordinary texts, so that
they differ only in what marks a class.
Every text is cut into windows of whole words, and each window is compressed with both. How much shorter the toxic
dictionary makes it says how toxic the window is; held-out rows turn that gain into a log-likelihood ratio. A text is
judged by the run of consecutive windows whose ratios have the greatest sum, so that ordinary text around a toxic
passage doesn't outvote it; LENGTH_COST times the logarithm of the number of windows is taken off, as the best of so many
places gets about that much by chance. Held-out rows set the threshold, at a chosen rate of ordinary texts that exceed it.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = -15, 25
#: 1 if windows were independent; chance hits cluster by topic, and 1.5 kept the rates of false hits of held-out texts of check_l most alike over lengths.
LENGTH_COST = 1.5
_SLICE_DOCS = 256


@dataclass(frozen=True)
class ToxicityModel:
    """``toxic`` and ``ordinary``: the dictionaries' contents. ``ratio``: log-likelihood ratio of gains from LOW to HIGH."""

    toxic: bytes
    ordinary: bytes
    threshold: float
    ratio: tuple[float, ...] = field(repr=False, default=())
    window: int = 64
    level: int = 9


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    # matches of 6 bytes or more: shorter ones are common syllables, which any text shares with some mark
    params = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=128, dict_size=len(content), min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def windows(texts: list[str], width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One buffer, (start, length) of each window of whole words in it, and the text that each belongs to.

    A window begins at the first space at or after each multiple of ``width`` bytes and ends where the next begins,
    so that windows cover the text; a word longer than that makes its window longer.
    """
    coded = [(" " + n + " ").encode("utf-8", "replace") if n else b"" for n in map(normal, texts)]
    data = b"".join(coded)
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in coded])])
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    owner = np.searchsorted(bounds, spaces, "right") - 1
    cell = (spaces - bounds[owner]) // width
    first = np.ones(len(spaces), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
    start, owner = spaces[first], owner[first]
    end = np.empty_like(start)
    end[:-1] = np.where(owner[1:] == owner[:-1], start[1:] + 1, bounds[owner[:-1] + 1]) if len(start) else []
    if len(start):
        end[-1] = bounds[-1]
    keep = end - start > 1
    return data, np.stack([start, end - start], 1)[keep].astype(np.uint64), owner[keep]


def gains(texts: list[str], toxic, ordinary, width: int) -> tuple[np.ndarray, np.ndarray]:
    """By window: bytes that the toxic dictionary saves against the ordinary one; and the window's text."""
    data, parts, owner = windows(texts, width)
    if not len(parts):
        return np.zeros(0, np.int64), owner
    source = zstandard.BufferWithSegments(data, parts.tobytes())

    def sizes(c: zstandard.ZstdCompressor) -> np.ndarray:
        out = c.multi_compress_to_buffer(source, threads=0)
        return np.fromiter(map(len, out), np.int64, len(out))

    return sizes(ordinary) - sizes(toxic), owner


_STEM = 5


def _terms(text: str) -> set[str]:
    """Words, and phrases of two."""
    words = normal(text).split()
    return {*words, *map(" ".join, itertools.pairwise(words))}


def _frequent(texts: list[str], least: float) -> Counter:
    """Number of texts by term, for terms in ``least`` texts or more. Hashed counts come first, so that memory doesn't grow with the rare ones."""
    few = np.zeros(1 << 20, np.int32)
    for t in texts:
        few[list({hash(x) % len(few) for x in _terms(t)})] += 1
    often = (few >= least).tolist()
    found = Counter(x for t in texts for x in _terms(t) if often[hash(x) % len(often)])
    return Counter({x: n for x, n in found.items() if n >= least})


def _stems(texts: list[str]) -> Counter:
    return Counter(x for t in texts for x in {w[:_STEM] for w in normal(t).split()})


def _chance(own: int, other: int, share: float) -> float:
    """Bound on the logarithm of the chance that so many of own + other texts are of the own class, whose share in all texts that is."""
    q = own / (own + other)
    return -(own + other) * (q * np.log(q / share) + (0.0 if q == 1 else (1 - q) * np.log((1 - q) / (1 - share)))) if q > share else 0.0


def _marks(own: list[str], other: list[str], rate: float, lift: float) -> set[str]:
    """Words and phrases that are in a share ``rate`` of one class's texts and ``lift`` times more often than in the other's.

    Of as many terms as there are, less than one would be so much more frequent by chance.
    """
    found = _frequent(own, max(4, rate * len(own)))
    there = Counter(x for t in other for x in _terms(t) & found.keys())
    share, least = len(own) / (len(own) + len(other)), -np.log(max(2, sum(1 for t in own for _ in _terms(t))))
    marks = {x for x, n in found.items() if n * len(other) > lift * (there[x] + 1) * len(own) and _chance(n, there[x], share) < least}
    stems_own, stems_other = _stems(own), _stems(other)
    # words that merely begin like many words of the other class would save bytes there too
    return {x for x in marks if " " in x or stems_own[x[:_STEM]] * len(other) > lift / 2 * (stems_other[x[:_STEM]] + 1) * len(own)}


def _telling(texts: list[str], marks: set[str]) -> list[bytes]:
    """The stretches of the texts that consist of marks. All else is alike in both classes and would fill the dictionaries."""
    out = []
    for t in texts:
        words = normal(t).split()
        told = [w in marks for w in words]
        for i, pair in enumerate(itertools.pairwise(words)):
            if " ".join(pair) in marks:
                told[i] = told[i + 1] = True
        for tells, run in itertools.groupby(zip(told, words, strict=True), lambda x: x[0]):
            if tells:
                out.append(f" {' '.join(w for _, w in run)} ".encode("utf-8", "replace"))
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary by zstandard's trainer; if it finds too little text even for a small one, the distinct samples, the commonest last."""
    at = size
    while at >= 256:
        try:
            return zstandard.train_dictionary(at, samples, k=32, d=6).as_bytes()
        except zstandard.ZstdError:
            at //= 2
    return b"".join(x for x, _ in reversed(Counter(samples).most_common()))[-size:]


def fit(rows: Iterable[tuple[str, int]], *, false_rate: float = 0.004, window: int = 64, level: int = 9,
        mark_bytes: int = 1536, common_bytes: int = 4096, mark_rate: float = 0.005, mark_lift: float = 12.0) -> ToxicityModel | None:
    """Train on (text, toxic) pairs. Half of them make the dictionaries; of the others each half is scored with the ratios of the other half, for the threshold.

    ``false_rate``: share of held-out ordinary texts that may exceed the threshold. None without 4 rows of each class.
    """
    rows = list(rows)
    toxic = [t for t, x in rows if x == 1 and t]
    clean = [t for t, x in rows if x == 0 and t]
    if len(toxic) < 4 or len(clean) < 4:
        return None
    cut = lambda xs: (xs[0::2], xs[1::4], xs[3::4] or xs[1::4])
    (t_dict, *t_rest), (c_dict, *c_rest) = cut(toxic), cut(clean)

    sample = [normal(t).encode("utf-8", "replace") for t in c_dict]
    common = _trained([s[i: i + 100_000] for s in sample for i in range(0, len(s), 100_000)], common_bytes)
    toxic_content = common + _trained(_telling(t_dict, _marks(t_dict, c_dict, mark_rate, mark_lift)), mark_bytes)
    plain_content = common + _trained(_telling(c_dict, _marks(c_dict, t_dict, mark_rate, mark_lift)), mark_bytes)
    a, b = _compressor(toxic_content, level), _compressor(plain_content, level)

    def histogram(texts: list[str]) -> np.ndarray:
        x = np.zeros(HIGH - LOW + 1)
        for i in range(0, len(texts), _SLICE_DOCS):
            g, _ = gains(texts[i: i + _SLICE_DOCS], a, b, window)
            x += np.bincount(np.clip(g, LOW, HIGH) - LOW, minlength=len(x))
        return x

    counts = [(histogram(t), histogram(c)) for t, c in zip(t_rest, c_rest, strict=True)]
    held = np.concatenate([scores(c_rest[k], a, b, rising_ratio(*counts[1 - k]), window) for k in (0, 1)])
    at = min(len(held) - 1, int(np.ceil((1 - false_rate) * len(held))))
    ratio = rising_ratio(counts[0][0] + counts[1][0], counts[0][1] + counts[1][1])
    return ToxicityModel(toxic_content, plain_content, float(max(0.0, np.sort(held)[at])), tuple(map(float, ratio)), window, level)


def rising_ratio(toxic: np.ndarray, clean: np.ndarray, weight: float = 30.0) -> np.ndarray:
    """Log-likelihood ratio by gain from two histograms, which never falls as the gain rises.

    Rare gains lean on all windows taken together (as ``weight`` windows), so that a gain seen in one class alone says
    little; neighbours out of order are pooled.
    """
    every = (toxic + clean + 0.01) / (toxic + clean + 0.01).sum()
    t, c = (toxic + weight * every) / (toxic.sum() + weight), (clean + weight * every) / (clean.sum() + weight)
    groups: list[list[float]] = []  # toxic share, clean share, number of gains
    for x, y in zip(t, c, strict=True):
        groups.append([x, y, 1])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] > groups[-1][0] * groups[-2][1]:
            x_, y_, n = groups.pop()
            groups[-1] = [groups[-1][0] + x_, groups[-1][1] + y_, groups[-1][2] + n]
    # in 1024ths: sums of them are exact, so a text's score is the same whatever lies beside it
    return np.repeat([np.rint(np.log(x / y) * 1024) / 1024 for x, y, _ in groups], [int(n) for _, _, n in groups])


def best_run(x: np.ndarray) -> float:
    """The greatest sum of consecutive entries; 0 if all are negative."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    return float((total - np.minimum.accumulate(total)).max())


def scores(texts: list[str], toxic, ordinary, ratio: np.ndarray, width: int) -> np.ndarray:
    """By text: the best sum of log-likelihood ratios over a run of windows, less what their number costs; 0 for a text without words."""
    out = np.zeros(len(texts))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < _SLICE_DOCS and (j == i or size + len(texts[j]) <= 1 << 20):
            size += len(texts[j])
            j += 1
        g, owner = gains(texts[i:j], toxic, ordinary, width)
        own = np.split(ratio[np.clip(g, LOW, HIGH) - LOW], np.searchsorted(owner, np.arange(1, j - i)))
        out[i:j] = [best_run(x) - LENGTH_COST * np.log(len(x)) if len(x) else 0.0 for x in own]
        i = j
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, most_toxic: int = 2500, most_clean: int = 6000) -> list[tuple[str, int]]:
    """At most so many labelled texts of each class, chosen by a hash of the id, in a fixed order.

    The ids are cut to that bound before they meet the documents, so the broadcast has at most their sum of rows
    whatever the tables' sizes. Labels that are null or contradict each other for one id are left out.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id")
           .agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi"))
    ids = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        part = one.where(F.col("lo") == value).select("doc_id", F.col("lo").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionAll(part)
    rows = (docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
            .select(F.xxhash64("doc_id", F.lit("turn")).alias("turn"), "text", "y").collect())
    rows.sort(key=lambda r: (r.turn, r.text))
    return [(r.text, r.y) for r in rows]


def scorer(model: ToxicityModel | None):
    """Arrow UDF: text to its score, null for a null text or without a model."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.nulls(len(text), pa.float64())
        known = [t for t in text.to_pylist() if t is not None]
        a, b = _compressor(model.toxic, model.level), _compressor(model.ordinary, model.level)
        got = iter(scores(known, a, b, np.array(model.ratio), model.window).tolist())
        return pa.array([next(got) if v else None for v in text.is_valid().to_pylist()], pa.float64())

    return score


def classify(docs: DataFrame, model: ToxicityModel | None, score: str = "tox_score", flag: str = "toxic") -> DataFrame:
    """``docs`` with a score and a flag, in one pass without a shuffle.

    Null and empty texts, and all texts if there was too little to train on, are not toxic (score null or 0).
    Repeated rows are classified alike. Columns of ``docs`` named like the two new ones are replaced; others stay.
    """
    out = docs.withColumn(score, scorer(model)(F.col("text")))
    limit = F.lit(model.threshold if model else 0.0)
    return out.withColumn(flag, F.coalesce(F.col(score) > limit, F.lit(False)))
