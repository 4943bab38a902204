"""What the training-data operators share: placing packed rows, and hashing of words, n-grams and lines in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions.arrays import SLICE_BYTES, buffers, slices  # noqa: F401
from loomseek.functions.folders import filesystem, release, shared_folder, written  # noqa: F401

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0x100000001B3)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of the size that the session is tuned for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def placed(df: DataFrame, part: str, *order) -> DataFrame:
    """Rows of one ``part`` (an int from 0) together and in order, parts dealt out to the tasks in turn."""
    return df.repartitionById(tasks(df.sparkSession), F.col(part).cast("int")).sortWithinPartitions(part, *order)


def ranges(total: int, least: int, each: int) -> int:
    """How many ranges of hashes a total of entries needs, so that none has much more than ``each``."""
    return max(1, least, -(-total // each))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def plain_words(col: pa.Array) -> pa.Array:
    """Lower case, with every run of characters that are no letter or number made one space."""
    return pc.replace_substring_regex(pc.utf8_lower(col.fill_null("")), r"[^\pL\pN]+", " ")


def run_hashes(raw: np.ndarray, off: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes other than ``stop``, in order; the run's start; the number of runs before each row.

    Runs never cross from one value to the next.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = raw != stop
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(start)
    per_row = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.uint64), at, per_row
    run = np.cumsum(start) - 1
    place = np.arange(n) - at[np.maximum(run, 0)]
    longest = int(place[inside].max()) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(longest + 1, _WORD_BASE, np.uint64))
        value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, place, 0)], np.uint64(0))
        return mix(np.add.reduceat(value, at)), at, per_row


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and numbers, lower case) of a string array; offsets by row. Nulls have none."""
    raw, off = buffers(plain_words(col))
    h, _, per_row = run_hashes(raw, off, 32)
    return h, per_row


_ORDER = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def ngram_hashes(h: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each row, and offsets by row; rows with fewer words give one hash of all of them, empty rows none."""
    count = np.diff(per_row)
    with np.errstate(over="ignore"):
        wide = np.concatenate([h, np.zeros(n, np.uint64)])
        ends = np.repeat(per_row[1:], count)
        at = np.arange(len(h))
        total = np.zeros(len(h), np.uint64)
        for k in range(n):
            total += np.where(at + k < ends, (wide[k: k + len(h)] + GOLDEN) * _ORDER[k], np.uint64(0))
    keep = (at + n <= ends) | ((np.repeat(count, count) < n) & (at == np.repeat(per_row[:-1], count)))
    return mix(total[keep]), np.concatenate([[0], np.cumsum(keep)])[per_row]


def small(df: DataFrame, most_bytes: int = 32 << 20, row_bytes: int = 16) -> bool:
    """Whether ``df`` (a written table, cheap to count) is small enough for a broadcast of so many bytes."""
    return df.count() * row_bytes <= most_bytes


def matched(left: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi- or anti-join with a table of keys: by broadcast if its checked size allows, else by shuffled hash on the key."""
    keys = keys.select(on)
    return left.join(F.broadcast(keys) if small(keys) else keys, on, how)
