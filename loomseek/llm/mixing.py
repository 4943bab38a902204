"""Mixing sources to target weights by the cube method.

Every row of a source has the same inclusion probability, so that the expected tokens of the sources are in the ratio
of the target weights, but for sources that run out and are kept whole. Balanced sampling then walks the vector of probabilities through the null space of the
constraints (documents and tokens) until nearly all are 0 or 1: first within each source and range of hashes of its rows, then
over what is left in wider and wider ranges, then over what is left of all sources. The landing decides the last two.

A row's hash, of all its columns, says in which range it is and when its turn comes, so the draw is the same however the
rows lie in files, partitions and batches. A walk holds three rows at a time, whatever the length of its range.

Definitions. A token of the default measure is a stretch of text between white space (a null text has none). A null source
is a source of its own. Rows are drawn each for itself, also rows that are alike (of which any may be the drawn ones; they follow one another in
one walk). A source with a weight of 0 (or with none, if weights are given) is left out. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.llm.shared import GOLDEN, fresh, mix, shared_folder, small, tasks, written

_NEAR = 1e-9
#: Part of the weight whose sources, the first to run out, may be kept whole without holding the others down.
SCARCE = 0.1
#: Rows of a walk, about; and the binary logarithm of the number of walks whose rests (two rows each) the next level joins.
_WALK, _JOINED = 4096, 11
_NONE = "\u0000"


def token_count(text: Column) -> Column:
    """Stretches of text between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def water_level(tokens: np.ndarray, weights: np.ndarray, often: np.ndarray) -> float:
    """Tokens to draw for a weight of 1, from the totals of sources (above 0), their weights (above 0) and how many sources are like that.

    The sample is as large as the sources allow that hold all of the weight but SCARCE: those that run out before,
    however small, don't set its size; they are kept whole and the others get the rest of their share.
    """
    if not len(tokens):
        return 0.0
    ratio = tokens / weights
    order = np.argsort(ratio, kind="stable")
    ratio, n, w = ratio[order], (tokens * often)[order].astype(np.float64), (weights * often)[order]
    share = w.sum()
    rest = ratio[np.argmax(np.cumsum(w) > SCARCE * share)] * share
    level = np.maximum(0.0, rest - np.cumsum(n) + n) / np.maximum(share - np.cumsum(w) + w, 1e-300)
    more = ratio > level
    return float(level[np.argmax(more) if more.any() else -1])


def inclusion(totals: dict[str, int], weights: dict[str, float] | None = None, temperature: float = 0.7) -> dict[str, float]:
    """Inclusion probability by source, in the ratio of the weights but for sources that run out (see water_level).

    Without ``weights``, a source's weight is its tokens to the power ``temperature``: 1 keeps all, 0 levels the sources. A
    source without tokens is kept whole, as it weighs nothing.
    """
    if weights is None:
        weights = {s: float(n) ** temperature for s, n in totals.items() if n > 0}
    used = [s for s, w in weights.items() if w > 0 and totals.get(s, 0) > 0]
    level = water_level(np.array([totals[s] for s in used], np.float64), np.array([weights[s] for s in used], np.float64), np.ones(len(used)))
    return {s: min(1.0, level * weights.get(s, 0.0) / n) if n > 0 else float(weights.get(s, 1.0) > 0) for s, n in totals.items()}


class Walk:
    """A walk with two constraints, documents and tokens, over rows as they come: at most two are left open.

    Three open rows always have a direction that changes neither total; the walk follows it, one way or the other with
    the chances that keep the expectation, until one of them is 0 or 1 and the next takes its place.
    """

    def __init__(self, seed: int) -> None:
        self.seed, self.turn = seed % (1 << 64), 0
        self.hand: list[tuple[float, float, int]] = []  # probability, tokens, row
        self.chances: list[float] = []

    def _chance(self) -> float:
        k = self.turn % 256
        if not k:
            with np.errstate(over="ignore"):
                at = np.arange(self.turn, self.turn + 256, dtype=np.uint64) * GOLDEN + np.uint64(self.seed)
            self.chances = ((mix(at) >> np.uint64(11)).astype(np.float64) / float(1 << 53)).tolist()
        self.turn += 1
        return self.chances[k]

    def step(self, p: float, tokens: float, row: int) -> list[tuple[int, float]]:
        """Take in a row; the rows that this settles, with 0 or 1."""
        if p <= _NEAR or p >= 1 - _NEAR:
            return [(row, 0.0 if p <= _NEAR else 1.0)]
        self.hand.append((p, tokens, row))
        if len(self.hand) < 3:
            return []
        (p0, t0, i0), (p1, t1, i1), (p2, t2, i2) = self.hand
        u0, u1, u2 = t2 - t1, t0 - t2, t1 - t0
        if u0 == 0 and u1 == 0:
            u0, u1 = 1.0, -1.0
        up = down = float("inf")
        for p, u in ((p0, u0), (p1, u1), (p2, u2)):
            if u > 0:
                up, down = min(up, (1 - p) / u), min(down, p / u)
            elif u < 0:
                up, down = min(up, -p / u), min(down, (p - 1) / u)
        far = up if self._chance() * (up + down) < down else -down
        self.hand, done = [], []
        for p, u, t, i in ((p0, u0, t0, i0), (p1, u1, t1, i1), (p2, u2, t2, i2)):
            p += far * u
            if p <= _NEAR:
                done.append((i, 0.0))
            elif p >= 1 - _NEAR:
                done.append((i, 1.0))
            else:
                self.hand.append((p, t, i))
        return done

    def land(self) -> list[tuple[int, float]]:
        """The open rows become 0 or 1, as suits the totals best; ties by the order of choices."""
        if not self.hand:
            return []
        p, t = np.array([h[0] for h in self.hand]), np.array([h[1] for h in self.hand])
        scale = max(1.0, float(np.abs(t).mean()))
        cost = lambda c: abs(sum(c) - p.sum()) + abs(np.dot(c, t) - np.dot(p, t)) / scale
        out = [(h[2], float(x)) for h, x in zip(self.hand, min(itertools.product((0, 1), repeat=len(p)), key=cost), strict=True)]
        self.hand = []
        return out


def flight(pi: np.ndarray, tokens: np.ndarray, seed: int, landing: bool = False) -> np.ndarray:
    """One walk over arrays: at most two entries of the result lie between 0 and 1, none after a landing."""
    out, walk = np.empty(len(pi)), Walk(seed)
    for k, (p, t) in enumerate(zip(pi.tolist(), tokens.tolist(), strict=True)):
        for i, x in walk.step(p, t, k):
            out[i] = x
    for i, x in walk.land() if landing else [(i, p) for p, _, i in walk.hand]:
        out[i] = x
    return out


def _walks(level: int, landing: bool):
    """Over rows sorted by walk and hash: (unit, state) with state 0 or 1 of those that are settled, as they were of those left open."""
    kind = ["walk", "source", "hash", "tokens", "state", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, rows = None, Walk(0), {}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64())], kind[1:])

        def rest(end: list[tuple]) -> None:
            for i, x in walk.land() if landing else [(i, p) for p, _, i in walk.hand]:
                source, h, tokens = rows.pop(i)
                end.append((source, h, tokens, x, i))

        for batch in batches:
            out: list[tuple] = []
            for w, source, h, tokens, p, unit in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in kind), strict=True):
                if w != now:
                    rest(out)
                    now, walk = w, Walk(h + level)
                rows[unit] = source, h, tokens
                for i, x in walk.step(p, tokens, unit):
                    out.append((*rows.pop(i), x, i))
            yield batch_of(out)
        out = []
        rest(out)
        yield batch_of(out)

    return run


def balanced_sample(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, tokens: Column | None = None,
                    names: tuple[str, str, str] = ("tokens", "pi", "selected"), only_selected: bool = False) -> DataFrame:
    """``docs`` with tokens, inclusion probability and whether the row is drawn; columns of ``docs`` with these names are replaced.

    With ``only_selected`` the drawn rows, with the columns of ``docs`` alone. The rows are written once with a number each, so a
    repeated task can't change which they are. Only rows of sources that are not kept whole are walked, as six narrow
    columns; each level of walks is written, and leaves two rows a walk to the next.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "mixing")
    base = docs if only_selected else docs.drop(*names)
    own = [f for f in base.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tok, pi, unit, key, name = (fresh([*base.columns, *names], n) for n in ("tok_", "pi_", "unit_", "hash_", "source_"))
    counted = (base.withColumn(tok, token_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0)))
               .withColumn(name, F.coalesce(F.col("source").cast("string"), F.lit(_NONE))).withColumn(key, F.xxhash64(*[F.col(f"`{f.name}`") for f in own])))
    first = written(counted.withColumn(unit, F.monotonically_increasing_id()), f"{folder}/first")
    totals = written(first.groupBy(F.col(name).alias(name)).agg(F.sum(tok).alias("n"), F.count(F.lit(1)).alias("rows")), f"{folder}/totals")
    if weights is None:
        weight = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(float(temperature)))).otherwise(F.lit(1.0))
        weighed = totals.withColumn("w", weight)
    else:
        given = spark.createDataFrame([(_NONE if k is None else k, float(w)) for k, w in weights.items()] or [(_NONE, 0.0)], f"`{name}` string, w double")
        weighed = totals.join(F.broadcast(given), name, "left").withColumn("w", F.coalesce("w", F.when(F.col("n") > 0, 0.0).otherwise(1.0)))
    # totals that are equal are seen once by the driver; as they add up to the corpus, they are not more than the root of twice its tokens
    kinds = weighed.where("n > 0 AND w > 0").groupBy("n", "w").count().orderBy("n", "w").toArrow()
    level = water_level(*(kinds[c].to_numpy().astype(np.float64) for c in ("n", "w", "count")))
    chance = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(level) * F.col("w") / F.col("n"))).otherwise((F.col("w") > 0).cast("double"))
    rates = weighed.select(name, chance.alias(pi))
    rated = first.join(F.broadcast(rates) if small(rates, row_bytes=64) else rates, name)
    is_open = (F.col(pi) > _NEAR) & (F.col(pi) < 1 - _NEAR)
    left = rated.where(is_open).select(F.col(name).alias("source"), F.col(key).alias("hash"), F.col(tok).alias("tokens"), F.col(pi).alias("state"), F.col(unit).alias("unit"))
    most, sources = totals.agg(F.max("rows"), F.count(F.lit(1))).first()
    leading = lambda h, bits: F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    within = [F.struct("source", leading(F.col("hash"), b).alias("cell")) for b in _levels(most or 0, _WALK)]
    across = [F.struct(F.lit("").alias("source"), leading(F.xxhash64("source"), b).alias("cell")) for b in _levels(sources, _WALK // 2)]
    decided = None
    for k, walk in enumerate([*within, *across]):
        last = k == len(within) + len(across) - 1
        rows = left.withColumn("walk", walk).repartition(tasks(spark), "walk").sortWithinPartitions("walk", "hash", "tokens", "source", "unit")
        rows = rows.withColumn("walk", F.concat_ws(" ", F.col("walk.cell").cast("string"), "walk.source"))
        done = written(rows.mapInArrow(_walks(k, last), "source string, hash long, tokens long, state double, unit long"), f"{folder}/walks-{k}")
        settled = done.where("state = 0 OR state = 1").select("unit", F.col("state").alias("decided_"))
        decided = settled if decided is None else decided.unionAll(settled)
        left = done.where("state > 0 AND state < 1")
    decided = decided.withColumnRenamed("unit", unit)
    decided = F.broadcast(decided) if small(decided) else decided
    drawn = F.coalesce("decided_", F.round(F.col(pi))) == 1
    full = rated.join(decided, unit, "left")
    if only_selected:
        return full.where(drawn).select(*[F.col(f"`{c}`") for c in docs.columns])
    return full.select(*[F.col(f"`{c}`") for c in base.columns], F.col(tok).alias(names[0]), F.col(pi).alias(names[1]), drawn.alias(names[2]))


def _levels(rows: int, walk: int) -> list[int]:
    """Bits of the hash that tell the walks of each level apart: from walks of about that many rows to a single one."""
    bits = max(0, (rows // walk).bit_length())
    return [*range(bits, 0, -_JOINED), 0]
