"""Approximate nearest neighbours by cross-polytope hashing.

In each table one or more fast pseudo-rotations (three rounds of random signs and a Hadamard transform) turn a unit vector, and the
signed axes nearest to it are its bucket. A query probes the combinations of axes nearest to it, several in each table; what the probed
buckets hold is ranked by exact cosine. The more rows, the more rotations make a bucket, so that a query meets an ever
smaller part of them. How many rotations, tables and probes is fitted: the cosines of the nearest neighbours of a bounded sample of
queries (SAMPLE, by brute force over all rows) say how near neighbours are, a simulation of the hash how often such
neighbours meet, and of all plans with an expected recall of RECALL the cheapest is taken.

Plan: vectors are packed once for each range that holds a bucket they are in or probe; buckets of more than PIECE rows are cut by
id into pieces; each range keeps the best k of each query, and these are merged.

Definitions. Vectors are compared by cosine; a row is no neighbour of rows with its own id. Of equal cosines the smaller id comes
first. Rows alike in id count once as neighbours. A null id, or a vector that is null, zero, not finite or not of the commonest length (of
equally common ones the longest), has null lists and is nobody's neighbour. Fewer than k other rows give shorter lists.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm.shared import mix, placed, ranges, shared_folder, small, tasks, written

SAMPLE, RECALL, PIECE = 64, 0.95, 4096
#: Vectors of a range, at most about, counting each table.
RANGE_ROWS = 500_000
_BATCH = 1024
#: What a plan costs beside comparisons: comparisons for which a row in a table counts, and one probe.
_ROW_COST, _PROBE_COST = 30, 12


@dataclass(frozen=True)
class Plan:
    """Rotations for each bucket, tables, and buckets that a query probes in each table."""

    rotations: int
    tables: int
    probes: int


def _best_axes(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest entries of each row, the greatest first, and their places."""
    count = min(count, scores.shape[1])
    if count < scores.shape[1]:
        at = np.argpartition(-scores, count - 1, 1)[:, :count]
    else:
        at = np.broadcast_to(np.arange(count), scores.shape)
    own = np.take_along_axis(scores, at, 1)
    order = np.lexsort((at, -own), axis=1)
    return np.take_along_axis(own, order, 1), np.take_along_axis(at, order, 1)


def nearest_buckets(rotated: list[np.ndarray], count: int) -> np.ndarray:
    """For each row the ``count`` combinations of signed axes, one of each rotation, with the greatest sum of coordinates."""
    scores, codes = np.zeros((len(rotated[0]), 1), np.float32), np.zeros((len(rotated[0]), 1), np.int64)
    for r in rotated:
        value, axis = _best_axes(np.concatenate([r, -r], 1), count)
        # of a rows-by-columns grid of sorted sums only places with row * column <= count can be among the best
        grid = np.add.outer(np.arange(1, scores.shape[1] + 1), np.zeros(value.shape[1], int)) * np.arange(1, value.shape[1] + 1)
        i, j = np.nonzero(grid <= count)
        scores, at = _best_axes(scores[:, i] + value[:, j], count)
        codes = np.take_along_axis(codes[:, i] * (2 * r.shape[1]) + axis[:, j], at, 1)
    return codes


def simulated(cosines: np.ndarray, width: int, rotations: int, most: int, draws: int = 96) -> np.ndarray:
    """For each cosine, and 2 ** 0, 2 ** 1, ... up to ``most`` probes, how often a pair so near meets in one table."""
    rng = np.random.default_rng(5)
    counts = 2 ** np.arange(int(math.log2(most)) + 1)
    out = np.zeros((len(cosines), len(counts)))
    for k, c in enumerate(cosines):
        a, b = [], []
        for _ in range(rotations):
            x = rng.normal(size=(draws, width)).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y = rng.normal(size=(draws, width)).astype(np.float32)
            y -= (x * y).sum(1, keepdims=True) * x
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
            a.append(x)
            b.append(np.float32(c) * x + np.float32(math.sqrt(max(0.0, 1 - c * c))) * y)
        hit = nearest_buckets(a, most) == nearest_buckets(b, 1)
        rank = np.where(hit.any(1), hit.argmax(1), most)
        out[k] = (rank[:, None] < counts).mean(0)
    return out


def fitted(rows: int, queries: int, k: int, width: int, cosines: np.ndarray) -> Plan:
    """The cheapest plan whose expected recall is RECALL at these cosines of neighbours; if none has it, all buckets of one table are probed."""
    cosines = np.quantile(cosines, (np.arange(12) + 0.5) / 12) if len(cosines) else np.zeros(1)
    best, least = Plan(1, 1, 2 * width), float(queries) * rows + rows * _ROW_COST
    for rotations in (1, 2, 3, 4):
        cells = (2 * width) ** rotations
        if rotations > 1 and cells > min(4 * rows, 1 << 36):
            break
        most = min(cells, 1 << 12)
        met = simulated(cosines, width, rotations, 1 << int(math.log2(most)))
        for tables in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32):
            recall = (1 - (1 - met) ** tables).mean(0)
            for p in np.flatnonzero(recall >= RECALL)[:1]:
                probes = 2 ** int(p)
                cost = rows * tables * _ROW_COST + queries * tables * probes * (rows / cells + _PROBE_COST)
                if cost < least:
                    best, least = Plan(rotations, tables, probes), cost
    return best


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of one table; the number of columns is a power of two."""
    width = x.shape[1]
    signs = np.random.default_rng(7_919 * (table + 1)).choice(np.array([-1, 1], np.float32), (3, width))
    out = x.astype(np.float32)
    for s in signs:
        out = out * s
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), width)
            step *= 2
        out = out / np.float32(math.sqrt(width))
    return out


def widened(x: np.ndarray) -> np.ndarray:
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def buckets(x: np.ndarray, plan: Plan, count: int) -> np.ndarray:
    """By row, table and nearness: the ``count`` buckets nearest to each row, numbered over all tables."""
    cells = (2 * x.shape[1]) ** plan.rotations
    near = [nearest_buckets([rotate(x, t * 4 + r) for r in range(plan.rotations)], count) + t * cells for t in range(plan.tables)]
    return np.stack(near, 1)


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have them."""
    ids, vecs = batch.column(0), batch.column(1)
    ok = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(vecs), dims), False))
    vecs = vecs.filter(ok)
    x = np.asarray(vecs.flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(len(vecs), dims)
    norm = np.sqrt((x**2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return np.asarray(ids.filter(ok)).astype(np.int64)[good], (x[good] / norm[good, None]).astype(np.float32)


def _loads(dims: int, plan: Plan):
    """Rows of each bucket, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells = [np.zeros(0, np.int64)]
            for i in range(0, len(whole), _BATCH):
                _, x = _vectors(whole.slice(i, _BATCH), dims)
                if len(x):
                    cells.append(buckets(widened(x), plan, 1).ravel())
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return run


def _send(dims: int, plan: Plan, heavy, parts: int):
    """Per batch and range: one row (kind 0) of members, ids, cells and vectors, and one (kind 1) of queries, with the cells they probe.

    ``heavy``: broadcast (cells in order, pieces) of buckets that are cut; a cell is a bucket's number and a piece's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces_of = heavy.value

        def pieces(bucket: np.ndarray) -> np.ndarray:
            if not len(cut):
                return np.ones(len(bucket), np.int64)
            at = np.minimum(np.searchsorted(cut, bucket), len(cut) - 1)
            return np.where(cut[at] == bucket, pieces_of[at], 1)

        for whole in batches:
            for i in range(0, len(whole), _BATCH):
                part_ = whole.slice(i, _BATCH)
                every, x = _vectors(part_, dims)
                if not len(every):
                    continue
                home = buckets(widened(x), plan, 1).reshape(len(every), -1)
                where = home.ravel()
                piece = (mix(np.repeat(every, plan.tables).view(np.uint64)) % pieces(where).view(np.uint64)).astype(np.int64)
                sent = [(0, every, x, np.repeat(np.arange(len(every)), plan.tables), where, piece)]
                ids, y = _vectors(part_.filter(part_.column(2)), dims)
                if len(ids):
                    near = buckets(widened(y), plan, plan.probes).reshape(len(ids), -1)
                    where = near.ravel()
                    row = np.repeat(np.arange(len(ids)), near.shape[1])
                    n = pieces(where)
                    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    sent.append((1, ids, y, np.repeat(row, n), np.repeat(where, n), piece))
                out_part, out_kind, out_data = [], [], []
                for kind, own_ids, vecs, row, bucket, piece in sent:
                    part = (mix(bucket.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    edge = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(edge)):
                        at = order[edge[p]: edge[p + 1]]
                        own, back = np.unique(row[at], return_inverse=True)
                        out_part.append(int(p))
                        out_kind.append(kind)
                        out_data.append(struct.pack("<II", len(own), len(at)) + own_ids[own].tobytes() + vecs[own].tobytes() + back.astype("<u4").tobytes()
                                        + (bucket[at] << 20 | piece[at]).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_kind, pa.int32()), pa.array(out_data, pa.binary())], ["part", "kind", "data"])

    return run


def _sample_cosines(dims: int, k: int, ids: np.ndarray, x: np.ndarray):
    """The k greatest cosines of each sampled query, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_: list[np.ndarray] = []
        for batch in batches:
            own, y = _vectors(batch, dims)
            if len(own):
                sims = x @ y.T
                sims[ids[:, None] == own[None, :]] = -2.0
                best_ = [np.concatenate([*best_, -np.partition(-sims, min(k, sims.shape[1]) - 1, 1)[:, :k]], 1)]
                best_ = [-np.partition(-best_[0], min(k, best_[0].shape[1]) - 1, 1)[:, :k]]
        if best_:
            flat = best_[0].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), flat.shape[1])), pa.array(flat.ravel())], ["q", "cosine"])

    return run


def _read(b: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<II", b)
    at = 8 + 8 * n
    ids = np.frombuffer(b, "<i8", n, 8)
    x = np.frombuffer(b, "<f4", n * dims, at).reshape(n, dims)
    at += 4 * n * dims
    return ids, x, np.frombuffer(b, "<u4", m, at).astype(np.int64), np.frombuffer(b, "<i8", m, at + 4 * m)


def best(query: np.ndarray, found: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of each query, by cosine and then id."""
    order = np.lexsort((-cosine, found, query))
    query, found, cosine = query[order], found[order], cosine[order]
    new = np.append(True, (query[1:] != query[:-1]) | (found[1:] != found[:-1]))[: len(query)]
    query, found, cosine = query[new], found[new], cosine[new]
    order = np.lexsort((found, -cosine, query))
    query, found, cosine = query[order], found[order], cosine[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], found[rank < k], cosine[rank < k]


def _search(dims: int, k: int, parts: int):
    """Over rows sorted by partition, members before queries: the best k of each query there, packed by the query's own partition."""

    def answer(cells: dict[int, tuple[np.ndarray, np.ndarray]], data: bytes) -> Iterator[pa.RecordBatch]:
        ids, x, row, cell = _read(data, dims)
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        queries, found, cosines = [], [], []
        for i, j in zip(edge, [*edge[1:], len(cell)]):
            held = cells.get(int(cell[i]))
            if held is None:
                continue
            own = row[i:j]
            sims = x[own] @ held[1].T
            sims[ids[own][:, None] == held[0][None, :]] = -2.0
            keep = min(k, sims.shape[1])
            if keep < sims.shape[1]:
                # all that reach the k-th cosine, so that ties are settled by id and not by chance
                floor = -np.partition(-sims, keep - 1, 1)[:, keep - 1: keep]
                r, c = np.nonzero((sims >= floor) & (sims > -1.5))
            else:
                r, c = np.nonzero(sims > -1.5)
            queries.append(own[r])
            found.append(held[0][c])
            cosines.append(sims[r, c])
        if not queries:
            return
        q, f, s = best(np.concatenate(queries), np.concatenate(found), np.concatenate(cosines), k)
        q = ids[q]
        part = (mix(q.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [b"".join(a[order[cut[p]: cut[p + 1]]].tobytes() for a in (q, f, s.astype("<f4"))) for p in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, cells = None, [], None
        for batch in batches:
            for part, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    now, members, cells = part, [], None
                if kind == 0:
                    members.append(data)
                    continue
                if cells is None:
                    cells = {}
                    read = [_read(m, dims) for m in members]
                    members = []
                    if read:
                        base = np.cumsum([0, *(len(r[0]) for r in read)])
                        ids, x = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
                        row, cell = np.concatenate([r[2] + b for r, b in zip(read, base)]), np.concatenate([r[3] for r in read])
                        order = np.argsort(cell, kind="stable")
                        row, cell = row[order], cell[order]
                        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                        for i, j in zip(edge, [*edge[1:], len(cell)]):
                            cells[int(cell[i])] = ids[row[i:j]], x[row[i:j]]
                yield from answer(cells, data)

    return run


def _merge(k: int):
    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], []]
        for b in blobs:
            n = len(b) // 20
            for col, (kind, at) in zip(cols, (("<i8", 0), ("<i8", 8 * n), ("<f4", 16 * n)), strict=True):
                col.append(np.frombuffer(b, kind, n, at))
        q, f, s = best(*(np.concatenate(c) for c in cols), k)
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        off = pa.array(np.append(first, len(q)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(q[first]), pa.ListArray.from_arrays(off, pa.array(f)), pa.ListArray.from_arrays(off, pa.array(s.astype(np.float32)))],
                                         ["id_", "neighbours", "cosines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield from settle(held)
                    held = []
                now = part
                held.append(data)
        if held:
            yield from settle(held)

    return run


def nearest(rows: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", queries: Column | None = None) -> DataFrame:
    """One row for each row of ``rows`` that is a query (all, if no condition is given): its id, the ids of its k nearest neighbours, and their cosines."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "neighbours")
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    source = spread(rows.select(F.col(id_column).cast("long").alias("id_"), F.col(vector).cast("array<float>").alias("vector_"), asks.alias("asks_")))
    lengths = source.where("id_ IS NOT NULL AND vector_ IS NOT NULL").groupBy(F.size("vector_").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks_").alias("asks"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).head(1)
    nothing = [F.lit(None).cast("array<long>").alias("neighbours"), F.lit(None).cast("array<float>").alias("cosines")]
    if not common or not common[0].dims or not common[0].asks:
        return source.where("asks_").select(F.col("id_").alias(id_column), *nothing)
    dims, n = common[0].dims, common[0].n
    width = 1 << max(0, dims - 1).bit_length()
    picked = source.where((F.col("id_").isNotNull()) & F.col("asks_") & (F.size("vector_") == dims)).orderBy(F.xxhash64("id_"), "id_").limit(SAMPLE).toArrow()
    cosines = np.zeros(0)
    ids, x = _vectors(pa.RecordBatch.from_arrays([picked[c].combine_chunks() for c in ("id_", "vector_")], ["id_", "vector_"]), dims)
    if len(ids):
        near = source.mapInArrow(_sample_cosines(dims, k, ids, x), "q long, cosine double").groupBy("q").agg(F.sort_array(F.collect_list("cosine"), False).alias("c"))
        cosines = np.array([c for r in near.select(F.slice("c", 1, k).alias("c")).collect() for c in r.c if c > -1.5])
    plan = fitted(n, common[0].asks, k, width, cosines)
    loads = written(source.mapInArrow(_loads(dims, plan), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > PIECE), f"{folder}/heavy")
    heavy = loads.orderBy("cell").toArrow()  # fewer than tables * rows / PIECE buckets can hold so many
    cut = heavy["cell"].to_numpy(), -(-heavy["n"].to_numpy() // PIECE)
    parts = ranges(n * plan.tables, tasks(spark), RANGE_ROWS)
    sent = source.mapInArrow(_send(dims, plan, spark.sparkContext.broadcast(cut), parts), "part int, kind int, data binary")
    found = placed(sent, "part", "kind").mapInArrow(_search(dims, k, parts), "part int, data binary")
    found = written(placed(found, "part").mapInArrow(_merge(k), "id_ long, neighbours array<long>, cosines array<float>"), f"{folder}/found")
    usable = F.col("id_").isNotNull() & (F.size("vector_") == dims) & F.forall("vector_", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector_", lambda v: v != 0)
    return (source.where("asks_").select("id_", F.coalesce(usable, F.lit(False)).alias("usable_")).join(F.broadcast(found) if small(found, row_bytes=200) else found, "id_", "left")
            .select(F.col("id_").alias(id_column),
                    *[F.when(F.col("usable_"), F.coalesce(F.col(c), F.array().cast(t))).alias(c) for c, t in (("neighbours", "array<long>"), ("cosines", "array<float>"))]))
