"""Exact deduplication over an extendible-hash index on shared files.

A text's key is its 64-bit hash. The directory maps the key's leading bits to buckets: starting from one bucket, an
overfull one is split on its next bit, and the directory doubles when a bucket becomes deeper than the directory. Each owner
task holds the buckets of a contiguous range of keys: it fills them with (key, number of rows), written to the
shared folder, and it chains the texts under the keys that occur twice or more, comparing bytes. What comes to an owner was
combined where it was read, so a text that a third of all rows have arrives once from each task; ids are
never listed.

Definitions. Copies are texts with the same bytes; empty texts are copies of each other. A null text has no copy. Of
copies, the row with the smallest id stays (null ids last; of rows alike in both, one). Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm.shared import fresh, matched, placed, shared_folder, small, tasks, written

#: Bytes of texts that a task combines before it sends them on, and rows of a block of equal rows.
_HELD_BYTES, _BLOCK_ROWS = 32 << 20, 10_000


class Directory:
    """Extendible-hash directory over the leading bits of keys, built from counts by their first bits."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        limit = int(len(counts)).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        self.depth, self.slots, buckets = 0, [0], [(0, 0)]  # bucket: (prefix, local depth)

        def load(prefix: int, depth: int) -> int:
            width = 1 << (limit - depth)
            return int(total[(prefix + 1) * width] - total[prefix * width])

        pending = [0]
        while pending:
            b = pending.pop()
            prefix, local = buckets[b]
            if load(prefix, local) <= capacity or local == limit:  # at the limit a bucket overflows into a chain
                continue
            if local == self.depth:
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            buckets[b] = (2 * prefix, local + 1)
            buckets.append((2 * prefix + 1, local + 1))
            new, width = len(buckets) - 1, 1 << (self.depth - local - 1)
            self.slots[(2 * prefix + 1) * width: (2 * prefix + 2) * width] = [new] * width
            pending += [b, new]
        order = sorted(range(len(buckets)), key=lambda b: buckets[b][0] / (1 << buckets[b][1]))
        place = {b: i for i, b in enumerate(order)}
        self.slots = [place[s] for s in self.slots]  # buckets are numbered by key range
        self.loads = [load(*buckets[b]) for b in order]

    def owners(self, n: int) -> list[int]:
        """For each bucket one of n owners: contiguous ranges of about equal load."""
        ends = np.cumsum(self.loads)
        return [int(x) for x in np.minimum(n - 1, (ends - np.array(self.loads)) * n // max(1, int(ends[-1])))]


def build_index(keys: DataFrame, folder: str, capacity: int | None = None) -> tuple[DataFrame, DataFrame, Directory]:
    """The index of the column ``key``, one row (owner, bucket, key, n) for each key, written below ``folder``; the directory as a table; and itself.

    Buckets hold ``capacity`` different keys (by default a quarter of a task's share, from 4,096 to 4 million), so hot keys
    don't split them. The directory has as many bits as that needs and two to spare, since hashes are even: some 16 slots
    a task, which is what the driver sees and sends.
    """
    spark = keys.sparkSession
    distinct = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"{folder}/keys")
    n = distinct.count()
    capacity = capacity or min(1 << 22, max(1 << 12, n // (4 * tasks(spark)) + 1))
    bits = max(1, (n // capacity).bit_length() + 2)
    counts = np.zeros(1 << bits, np.int64)
    for c, k in distinct.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("cell")).count().collect():
        counts[c] = k
    directory = Directory(counts, capacity)
    owner = directory.owners(tasks(spark))
    slots = spark.createDataFrame([(i, b, owner[b]) for i, b in enumerate(directory.slots)], "slot long, bucket int, owner int")
    return written(placed(owned(distinct, slots, directory), "owner", "bucket", "key"), f"{folder}/index"), slots, directory


def owned(rows: DataFrame, slots: DataFrame, directory: Directory) -> DataFrame:
    """``rows`` with the bucket of their key and its owner."""
    slot = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    return rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")


_CHAIN = "key long, text string, id long, first long, n long"


def _combined(chain: dict[tuple[int, str], list]) -> pa.RecordBatch:
    cols = list(zip(*((k, t, *s) for (k, t), s in chain.items()), strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["key", "text", "id", "first", "n"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, id) to one row for each key and text: smallest id (null last), the number of rows with it, and of all."""
    chain: dict[tuple[int, str], list] = {}
    held = 0
    for batch in batches:
        for key, text, i in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            at = chain.get((key, text))
            if at is None:
                chain[key, text] = [i, 1, 1]
                held += len(text) + 100
                if held > _HELD_BYTES:
                    yield _combined(chain)
                    chain, held = {}, 0
                continue
            at[2] += 1
            if i == at[0]:
                at[1] += 1
            elif i is not None and (at[0] is None or i < at[0]):
                at[:2] = [i, 1]
    if chain:
        yield _combined(chain)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over combined rows sorted by key: the chain of different texts under each key, told apart by their bytes.

    One row for each: key, place in the chain, smallest id, rows with it, all rows; and the text if the chain is longer than one.
    """
    def report(key: int, chain: dict[str, list]) -> pa.RecordBatch:
        rows = [(key, k, *s, t if len(chain) > 1 else None) for k, (t, s) in enumerate(chain.items())]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.string())],
                                          ["key", "chain", "id", "first", "n", "text"])

    now, chain, out = None, {}, []
    for batch in batches:
        for key, text, i, first, n in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("key", "text", "id", "first", "n")), strict=True):
            if key != now and chain:
                out.append(report(now, chain))
                chain = {}
            now = key
            at = chain.get(text)  # str of equal hash are compared in full
            if at is None:
                chain[text] = [i, first, n]
            else:
                at[2] += n
                if i == at[0]:
                    at[1] += first
                elif i is not None and (at[0] is None or i < at[0]):
                    at[:2] = [i, first]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if chain:
        yield report(now, chain)


def chains(docs: DataFrame, folder: str, capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, bool]:
    """Of each text that occurs twice or more: (key, chain, id, first, n, text); and whether any key has more than one text.

    Of a key with one text the text is left out: all rows with that key have it, byte by byte. Texts that occur once but share
    their key are listed too.
    """
    rows = docs.where("text IS NOT NULL").select(key(F.col("text")).alias("key"), F.col("text").alias("text"), F.col("doc_id").cast("long").alias("id"))
    index, slots, directory = build_index(rows.select("key"), folder, capacity)
    suspects = written(index.where("n > 1").select("key"), f"{folder}/suspects")
    met = matched(rows, suspects, "key", "left_semi").select("key", "text", "id").mapInArrow(_combine, _CHAIN)
    found = written(placed(owned(met, slots, directory), "owner", "bucket", "key")
                    .mapInArrow(_chains, "key long, chain int, id long, first long, n long, text string"), f"{folder}/chains")
    return found, not found.where("chain > 0").isEmpty()


def _marked(rows: DataFrame, found: DataFrame, collided: bool, names: tuple[str, ...], key: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the key, chain, id, first and n of their text (null for a text without copies) under the ``names``."""
    k, *facts = names
    table = found.select(F.col("key").alias(k), *[F.col(c).alias(x) for c, x in zip(("chain", "id", "first", "n"), facts, strict=True)], F.col("text").alias("text_"))
    table = F.broadcast(table) if small(found, row_bytes=48) and not collided else table
    rows = rows.withColumn(k, key(F.col("text")))
    if not collided:
        return rows.join(table.drop("text_"), k, "left")
    keyed = rows.alias("l").join(table.alias("r"), (F.col(f"l.{k}") == F.col(f"r.{k}")) & (F.col("r.text_").isNull() | (F.col("r.text_") == F.col("l.text"))), "left")
    return keyed.select("l.*", *[F.col(f"r.{x}") for x in facts])


def find_copies(docs: DataFrame, capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keeper_id (smallest id with the same text), copies, is_copy."""
    folder = shared_folder(docs.sparkSession, "exact-dedup")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found, collided = chains(docs, folder, capacity, key)
    rows = _marked(docs, found, collided, ("key", "chain", "keeper", "first", "copies"), key).drop("text")
    lead = F.col("doc_id").eqNullSafe(F.col("keeper"))
    tied = F.coalesce(lead & (F.col("first") > 1), F.lit(False))
    plain = rows.where(~tied).select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keeper")).alias("keeper_id"),
                                     F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("copies").isNotNull() & ~lead).alias("is_copy"))
    # rows alike in text and id can't be told apart: as many are given, all but one as copies, in blocks
    blocks = (found.where("first > 1").select("id", "n", "first", F.explode(F.expr(f"sequence(0L, (first - 1) div {_BLOCK_ROWS})")).alias("block"))
              .select("id", "n", F.explode(F.expr(f"sequence(block * {_BLOCK_ROWS}, least(first, (block + 1) * {_BLOCK_ROWS}) - 1)")).alias("k")))
    return plain.unionAll(blocks.select("id", "id", "n", F.col("k") > 0))


def drop_copies(docs: DataFrame, capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` without the rows that are copies of an earlier one; all columns, whatever their names, unchanged."""
    folder = shared_folder(docs.sparkSession, "exact-dedup")
    found, collided = chains(docs, folder, capacity, key)
    names, taken = [], [*docs.columns, "text_"]
    for x in ("key", "chain", "keeper", "first", "copies"):
        names.append(fresh([*taken, *names], x))
    k, chain, keeper, first, copies = (F.col(x) for x in names)
    rows = _marked(docs, found, collided, tuple(names), key)
    lead = F.col("doc_id").cast("long").eqNullSafe(keeper)
    kept = rows.where(copies.isNull() | (lead & (first == 1)))
    out = [F.col(f"`{c}`") for c in docs.columns]
    if found.where("first > 1").isEmpty():
        return kept.select(*out)
    tied = rows.where(copies.isNotNull() & lead & (first > 1)).dropDuplicates([names[0], names[1]])
    return kept.select(*out).unionAll(tied.select(*out))


COPIES_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS keeper_id,
  CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER w END AS copies,
  CASE WHEN text IS NULL THEN false ELSE row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 END AS is_copy
FROM documents WINDOW w AS (PARTITION BY text)"""
