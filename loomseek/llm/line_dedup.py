"""Line deduplication over a sharded minimal perfect hash of the distinct hashes of repeated lines.

Lines are hashed where they are read; each task sends the counts and smallest ids of its line hashes, packed by range of
hashes. The owner of a range sums them and writes one shard: a minimal perfect hash (a cascade of bit arrays with ranks)
that numbers the hashes that occur twice or more, and arrays of fingerprints, counts and first ids in that order. The
fingerprint is a second hash of the line, so lines are told apart by 128 bits; lines
that occur once are in no shard, and the fingerprint rejects them. Documents probe the shards, loaded from the shared
folder as needed, so that neither lines nor texts are shuffled again.

Definitions. A line is what lies between line feeds, byte by byte. An empty line is no line but a gap, and stays (so does one of less than
``min_bytes``, which is 1 if not given). Any other line that occurs ``min_count`` times or more, in one text or several, stays in the row with the smallest id, there at its first place; rows that
share that id keep it each. Null ids come last; a line in such rows alone stays in each of them, once. A null text stays null.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm.shared import GOLDEN, filesystem, fresh, mix, placed, ranges, shared_folder, tasks

_CACHE_BYTES = 128 << 20
_LAST = np.int64(2**63 - 1)
_SLOTS_PER_KEY = 2.0
_MOST_LEVELS = 24
#: Lines of a shard, at most about.
SHARD_LINES = 4_000_000
_ENTRY = np.dtype([("key", "<u8"), ("mark", "<u8"), ("count", "<u4"), ("first", "<i8")])


class PerfectHash:
    """Numbers n different 64-bit keys 0 to n - 1. Each level keeps the keys that are alone at their bit; the rest go on to the next."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        total, level = 0, 0
        while len(keys) and level < _MOST_LEVELS:
            words = int(len(keys) * _SLOTS_PER_KEY) // 64 + 1
            at = self._slot(keys, level, words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            each = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, (total + np.cumsum(each) - each).astype(np.int64)))
            total += int(each.sum())
            keys = keys[~alone[at]]
            level += 1
        self.rest = np.sort(keys)
        self.size = total + len(self.rest)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + GOLDEN * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for what is no key."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._slot(keys[left], level, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = bits[word]
            hit = (value >> bit & np.uint64(1)).astype(bool)
            rank = before[word] + np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.size - len(self.rest) + at[hit]
        return out


class Shard:
    """Perfect hash, and in its order fingerprint, count and first id of each key. Entries whose key has several fingerprints lie beside it, in order."""

    def __init__(self, entries: np.ndarray) -> None:
        """``entries``: sorted by key and fingerprint, each pair once."""
        keys = entries["key"]
        twin = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        self.twins, own = entries[twin], entries[~twin]
        self.hash = PerfectHash(own["key"])
        self.mark, self.count, self.first = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64)
        at = self.hash.index(own["key"])
        self.mark[at], self.count[at], self.first[at] = own["mark"], own["count"], own["first"]

    def probe(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and first id of each line; 1 and the last id for one that is not in the shard."""
        count, first = np.ones(len(keys), np.int64), np.full(len(keys), _LAST)
        if self.hash.size:
            at = self.hash.index(keys)
            hit = (at >= 0) & (self.mark[at] == marks)
            count[hit], first[hit] = self.count[at[hit]], self.first[at[hit]]
        for e in self.twins:
            hit = (keys == e["key"]) & (marks == e["mark"])
            count[hit], first[hit] = e["count"], e["first"]
        return count, first

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = {f"b{i}": b for i, (b, _) in enumerate(self.hash.levels)} | {f"r{i}": r for i, (_, r) in enumerate(self.hash.levels)}
        np.savez(out, twins=self.twins, rest=self.hash.rest, mark=self.mark, count=self.count, first=self.first, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as z:
            self = cls.__new__(cls)
            self.hash = PerfectHash(np.zeros(0, np.uint64))
            n = sum(k.startswith("b") for k in z.files)
            self.hash.levels = [(z[f"b{i}"], z[f"r{i}"]) for i in range(n)]
            self.twins, self.hash.rest, self.mark, self.count, self.first = z["twins"], z["rest"], z["mark"], z["count"], z["first"]
            self.hash.size = len(self.mark)
            return self


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _summed(entries: np.ndarray) -> np.ndarray:
    """One entry for each line: the sum of its counts, its least first id; sorted by key and fingerprint."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["mark"], entries["key"]))]
    start = np.flatnonzero(np.append(True, (entries["key"][1:] != entries["key"][:-1]) | (entries["mark"][1:] != entries["mark"][:-1])))
    out = entries[start].copy()
    out["count"] = np.minimum(np.add.reduceat(entries["count"].astype(np.int64), start), 2**32 - 1)
    out["first"] = np.minimum.reduceat(entries["first"], start)
    return out


def _flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and fingerprints of all lines (0 and 0 for one that doesn't count) and the number of lines of each row."""
    lens = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten()
    return *(pc.fill_null(flat.field(k), 0).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2)), lens


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, lens = _flat(batch.column(1))
            ids = np.repeat(batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False), lens)
            counts = np.flatnonzero((keys != 0) | (marks != 0))
            entries = np.empty(len(counts), _ENTRY)
            entries["key"], entries["mark"], entries["count"], entries["first"] = keys[counts], marks[counts], 1, ids[counts]
            entries = _summed(entries)
            part = _shard_of(entries["key"], shards)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(shards + 1))
            out = [(int(p), order[edge[p]: edge[p + 1]]) for p in np.flatnonzero(np.diff(edge))]
            data = [entries[at].tobytes() for _, at in out]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])

    return run


def _build(folder: str):
    def finish(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        entries = _summed(np.concatenate([np.frombuffer(b, _ENTRY) for b in blobs]))
        entries = entries[entries["count"] > 1]
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{shard}.npz") as f:  # a repeated task writes the same bytes
            f.write(Shard(entries).to_bytes())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(entries)], pa.int64())], ["shard", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != current and blobs:
                    yield finish(current, blobs)
                    blobs = []
                current = shard
                blobs.append(data)
        if blobs:
            yield finish(current, blobs)

    return run


def line_keys(text: Column, min_bytes: int) -> Column:
    """Two hashes (key, mark) for each line, null for one that is too short to count."""
    key = lambda x: F.when(F.octet_length(x) >= min_bytes, F.struct(F.xxhash64(x).alias("key"), F.xxhash64(F.lit("mark"), x).alias("mark")))
    return F.transform(F.split(text, "\n", -1), key)


_SHARDS: OrderedDict[str, tuple[Shard, int]] = OrderedDict()


def _shard(path: str) -> Shard:
    if path in _SHARDS:
        _SHARDS.move_to_end(path)
        return _SHARDS[path][0]
    fs, where = filesystem(path)
    with fs.open_input_file(where) as f:
        data = f.read()
    _SHARDS[path] = (Shard.from_bytes(data), len(data))
    while len(_SHARDS) > 1 and sum(n for _, n in _SHARDS.values()) > _CACHE_BYTES:
        _SHARDS.popitem(last=False)
    return _SHARDS[path][0]


def _prober(folder: str, shards: int, present: frozenset[int], min_count: int):
    @F.arrow_udf("array<boolean>")
    def keep(ids: pa.Array, lines: pa.Array) -> pa.Array:
        keys, marks, lens = _flat(lines)
        own = np.repeat(ids.fill_null(_LAST).to_numpy(zero_copy_only=False), lens)
        row = np.repeat(np.arange(len(lens)), lens)
        at = np.flatnonzero((keys != 0) | (marks != 0))
        count, first = np.ones(len(keys), np.int64), np.full(len(keys), _LAST)
        part = _shard_of(keys[at], shards)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(shards + 1))
        for p in np.flatnonzero(np.diff(edge)):
            if int(p) in present:
                sel = at[order[edge[p]: edge[p + 1]]]
                count[sel], first[sel] = _shard(f"{folder}/{p}.npz").probe(keys[sel], marks[sel])
        gone = count >= min_count
        again = np.flatnonzero(gone & (own == first))  # in the row that keeps the line, only its first place stays
        order = again[np.lexsort((again, marks[again], keys[again], row[again]))]
        lead = np.ones(len(order), bool)
        for x in (keys[order], marks[order], row[order]):
            lead[1:] &= x[1:] == x[:-1]
        lead[1:] = ~lead[1:]
        gone[order[lead]] = False
        some = np.bincount(row[gone], minlength=len(lens)) > 0
        ends = np.concatenate([[0], np.cumsum(np.where(some, lens, 0))])
        masks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(~gone[some[row]]))
        return pc.if_else(pa.array(some), masks, pa.nulls(len(lens), masks.type))

    return keep


def drop_repeated_lines(docs: DataFrame, min_bytes: int = 1, min_count: int = 2, removed: str = "lines_removed") -> DataFrame:
    """``docs`` with the text that stays, and how many lines went (a column of that name is replaced)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lines")
    docs = spread(docs)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    shards = ranges(docs.agg(F.sum(breaks)).first()[0] or 0, tasks(spark), SHARD_LINES)
    keys = line_keys(F.col("text"), min_bytes)
    ids = F.col("doc_id").cast("long")
    packed = docs.where("text IS NOT NULL").select(ids.alias("doc_id"), keys.alias("lines")).mapInArrow(_count(shards), "shard int, data binary")
    built = placed(packed, "shard").mapInArrow(_build(folder), "shard int, n long").collect()
    present = frozenset(r.shard for r in built if r.n)
    docs = docs.drop(removed)
    keep = fresh([*docs.columns, removed], "keep_")
    probed = docs.withColumn(keep, _prober(folder, shards, present, min_count)(ids, keys))
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: F.col(keep)[i])
    text = F.when(F.col(keep).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text"))
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return probed.select(*columns, F.when(F.col(keep).isNotNull(), F.size(F.filter(keep, lambda x: ~x))).otherwise(0).cast("long").alias(removed))


LINES_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs WHERE text IS NOT NULL),
rep AS (SELECT line, coalesce(min(doc_id), 9223372036854775807) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(*) >= 2),
marked AS (SELECT l.*, rep.line IS NOT NULL AND NOT (coalesce(doc_id, 9223372036854775807) = first
             AND row_number() OVER (PARTITION BY r, l.line ORDER BY pos) = 1) AS gone FROM lines l LEFT JOIN rep ON l.line = rep.line),
clean AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n FROM marked GROUP BY r)
SELECT doc_id, clean.text AS text, coalesce(n, 0) AS lines_removed FROM docs LEFT JOIN clean USING (r)"""
