"""LM scoring by deleted interpolation of word unigrams, bigrams and trigrams.

P3 = l3 c(uvw)/c(uv) + (1 - l3) P2,  P2 = l2 c(vw)/c(v) + (1 - l2) P1,  P1 = l1 c(w)/N + (1 - l1)/V,  where each l depends
on the frequency bucket (binary logarithm) of its context. The estimates are deleted ones: the event in question is held
out of the counts, so an n-gram that occurs once tells nothing about itself. The weights are learned by expectation-
maximisation on these held-out counts, of all positions of all texts, order by order. As deleting makes a lone n-gram's
count 0, trigrams are only counted where both of their bigrams occur twice or more, which loses nothing.

Plan: texts become blocks of word codes, written once. A block sends its distinct n-grams, packed by range of hashes;
the owner of a range sums the counts of all blocks and answers each with an array of counts in the order it asked, which is kept
in the shared folder by block. So the corpus is counted with two shuffles of packed hashes, and texts never move.

Definitions. Words are runs of letters and numbers in lower case; every text begins and ends with a boundary, and the one at its end is
scored as a word. A null text has null scores, an empty one the score of its end. Rows alike are scored alike, each a part of the
corpus. N-grams are told apart by 48 bits of hash within a range, and the number of ranges follows the corpus (RANGE_WORDS), so that
of n-grams about one in 10**8 is merged with another, at any size. For the weights, estimates are counted in cells of half an
octave each way, whose geometric means stand for them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm.shared import filesystem, mix, placed, ranges, release, shared_folder, slices, tasks, word_hashes, written

BLOCK_BYTES = 8 << 20
_EDGE = np.uint64(0x51A7E0B5D9F3C62B)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Words of the corpus for each range of hashes, about: no range gets more n-grams of an order from all blocks than that.
RANGE_WORDS = 2_000_000
_BITS = 48
_NONE = 127
_ROUNDS = 60


def _pack(x: np.ndarray) -> bytes:
    """Compressed byte planes of 64-bit numbers: the planes of small ones vanish."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to blocks: ids, lengths with both boundaries (-1 for a null text), distinct words, and packed word codes."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j in slices(batch.column(1), BLOCK_BYTES):
            text = batch.column(1).slice(i, j - i)
            parts, lens = [], []
            for a, b in slices(text):
                h, per_row = word_hashes(text.slice(a, b - a))
                n = np.diff(per_row)
                at = np.repeat(np.arange(len(n)) * 2 + 1, n) + np.arange(len(h))
                wide = np.full(len(h) + 2 * len(n), _EDGE)
                wide[at] = h
                parts.append(wide)
                lens.append(n + 2)
            valid = text.is_valid().to_numpy(zero_copy_only=False)
            lens = np.concatenate(lens)
            flat = np.concatenate(parts)[np.repeat(valid, lens)]
            vocab, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small codes, which pack well
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            vocab, codes = vocab[order], place[codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                 pa.array([np.where(valid, lens, -1)], pa.list_(pa.int32())), pa.array([vocab.tobytes()], pa.binary()), pa.array([_pack(codes)], pa.binary())],
                ["block", "ids", "lens", "vocab", "codes"])
            block += 1


_BLOCKS = "block long, ids array<long>, lens array<int>, vocab binary, codes binary"


class Block:
    """One block: its words in order, and for each order n the distinct n-grams with the place of each position's one."""

    def __init__(self, row: dict, parts: int) -> None:
        self.block, self.ids, self.parts = row["block"], row["ids"], parts
        self.bits = min(64, _BITS + parts.bit_length())
        self.lens = np.array(row["lens"], np.int64)
        vocab = np.frombuffer(row["vocab"], "<u8")
        self.words = vocab[_unpack(row["codes"]).astype(np.int64)]
        own = np.maximum(self.lens, 0)
        begin = np.cumsum(own) - own
        self.start = np.arange(len(self.words)) - np.repeat(begin, own)  # position within its text

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n-gram that ends at each position, cut to 48 bits more than tell the ranges apart; meaningless at the first n - 1 of a text."""
        w = self.words
        with np.errstate(over="ignore"):
            if n == 1:
                h = mix(w * _A)
            elif n == 2:
                h = mix(np.concatenate([[_EDGE], w[:-1]])[: len(w)] * _B + w * _C)
            else:
                h = mix(np.concatenate([[_EDGE] * 2, w[:-2]])[: len(w)] * _A + np.concatenate([[_EDGE], w[:-1]])[: len(w)] * _B + w * _C)
        return h >> np.uint64(64 - self.bits)

    def asked(self, n: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams at the chosen positions in order, the index of each position's one, and their counts in the block."""
        keys, back, count = np.unique(self.grams(n)[where], return_inverse=True, return_counts=True)
        return keys, back, count


def _requests(b: Block, kind: int, keys: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    part = ((keys >> np.uint64(b.bits - 32)) * np.uint64(b.parts) >> np.uint64(32)).astype(np.int64)  # ranges are in the order of keys
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for i, j in zip(start, [*start[1:], len(part)]):
        steps, often = _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(count[i:j])
        yield int(part[i]), b.block, kind, struct.pack("<I", len(steps)) + steps + often


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["part", "block", "kind", "data"])


_ROWS = "part int, block long, kind int, data binary"


def _each_block(parts: int, fn: Callable[[Block], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                yield fn(Block(row, parts))

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over requests sorted by range and kind: to each its counts, summed over all; and for words the number of distinct ones and the sum."""

    def settle(part: int, kind: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        keys, counts = [], []
        for _, data in held:
            (n,) = struct.unpack_from("<I", data)
            keys.append(np.cumsum(_unpack(data[4: 4 + n]), dtype=np.uint64))
            counts.append(_unpack(data[4 + n:]).astype(np.int64))
        every = np.concatenate(keys)
        order = np.argsort(every)
        new = np.append(True, every[order][1:] != every[order][:-1])
        sums = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        total = np.empty(len(every), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        edge = np.cumsum([0, *map(len, keys)])
        out = [(part, block, kind, _pack(total[i:j])) for (block, _), i, j in zip(held, edge, edge[1:])]
        if kind == 1:
            out.append((part, -1, kind, struct.pack("<qq", len(sums), int(sums.sum()))))
        return _rows(out)

    now, held = None, []
    for batch in batches:
        for part, block, kind, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (part, kind) != now and held:
                yield settle(*now, held)
                held = []
            now = part, kind
            held.append((block, data))
    if held:
        yield settle(*now, held)


def _keep_answers(folder: str):
    """Over answers sorted by block, kind and range: one file for each block; rows give the sums of words."""

    def keep(block: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        kinds: dict[int, list[np.ndarray]] = {}
        distinct = total = 0
        for kind, data in held:
            if block < 0:
                d, t = struct.unpack("<qq", data)
                distinct, total = distinct + d, total + t
            else:
                kinds.setdefault(kind, []).append(_unpack(data))
        if block >= 0:
            fs, path = filesystem(folder)
            fs.create_dir(path, recursive=True)
            for kind, parts in kinds.items():
                with fs.open_output_stream(f"{path}/{block}-{kind}") as f:  # a repeated task writes the same bytes
                    f.write(_pack(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([pa.array([distinct], pa.int64()), pa.array([total], pa.int64())], ["words", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, kind, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if block != now and held:
                    yield keep(now, held)
                    held = []
                now = block
                held.append((kind, data))
        if held:
            yield keep(now, held)

    return run


def _ask(blocks: DataFrame, parts: int, folder: str, requests: Callable[[Block], pa.RecordBatch]) -> tuple[int, int]:
    """Send the requests of all blocks, keep the answers below ``folder``; number of distinct words and of all (0 if none were asked for)."""
    answers = placed(blocks.mapInArrow(_each_block(parts, requests), _ROWS), "part", "kind").mapInArrow(_answers, _ROWS)
    answers = (answers.repartition(tasks(blocks.sparkSession), "block").sortWithinPartitions("block", "kind", "part")
               .mapInArrow(_keep_answers(folder), "words long, total long"))
    got = answers.agg(F.sum("words").alias("words"), F.sum("total").alias("total")).first()
    return got.words or 0, got.total or 0


def _answer(folder: str, block: int, kind: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    fs, path = filesystem(f"{folder}/{block}-{kind}")
    with fs.open_input_file(path) as f:
        out = _unpack(f.read()).astype(np.int64)
    if len(out) != n:
        raise RuntimeError(f"block {block} asked for {n} counts and got {len(out)}")
    return out


def _first_requests(b: Block) -> pa.RecordBatch:
    out = []
    for kind in (1, 2):
        keys, _, count = b.asked(kind, np.flatnonzero(b.start > 0))
        out += _requests(b, kind, keys, count)
    return _rows(out)


def _low_counts(b: Block, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the word and the bigram at each position (of the boundary, at the first of a text; bigram 0 there)."""
    at = np.flatnonzero(b.start > 0)
    c1, c2 = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
    keys, back, _ = b.asked(1, at)
    c1[at] = _answer(folder, b.block, 1, len(keys))[back]
    ends = np.flatnonzero(b.words == _EDGE)
    c1[ends] = c1[ends].max(initial=0)  # the boundary's count was asked for at the end of each text
    keys, back, _ = b.asked(2, at)
    c2[at] = _answer(folder, b.block, 2, len(keys))[back]
    return c1, c2


def _open_trigrams(b: Block, c2: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], c2[:-1]])[: len(c2)]
    return np.flatnonzero((b.start > 1) & (c2 > 1) & (before > 1))


def _second_requests(folder: str):
    def requests(b: Block) -> pa.RecordBatch:
        _, c2 = _low_counts(b, folder)
        keys, _, count = b.asked(3, _open_trigrams(b, c2))
        return _rows(list(_requests(b, 3, keys, count)))

    return requests


def _estimates(b: Block, folder: str, total: int) -> tuple[np.ndarray, ...]:
    """For each scored position: p1, p2, p3 (deleted) and the deleted counts of the two contexts (0: no estimate)."""
    c1, c2 = _low_counts(b, folder)
    at = _open_trigrams(b, c2)
    c3 = np.ones(len(c1), np.int64)
    keys, back, _ = b.asked(3, at)
    c3[at] = _answer(folder, b.block, 3, len(keys))[back]
    scored = np.flatnonzero(b.start > 0)
    n1 = np.maximum(c1[scored - 1] - 1, 0)
    n2 = np.where(b.start[scored] > 1, np.maximum(c2[scored - 1] - 1, 0), 0)
    p1 = (c1[scored] - 1) / max(1, total - 1)
    # n-grams of equal hash can be counted more often than their contexts: no estimate is above 1
    p2 = np.where(n1 > 0, np.minimum((c2[scored] - 1) / np.maximum(n1, 1), 1.0), 0.0)
    p3 = np.where(n2 > 0, np.minimum((c3[scored] - 1) / np.maximum(n2, 1), 1.0), 0.0)
    return p1, p2, p3, n1, n2


def bucket(n: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 if it is not seen elsewhere, else 1 + the binary logarithm rounded down."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0).astype(np.int64)


def half_octave(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.rint(-2 * np.log2(np.where(p > 0, p, 1.0))), _NONE - 1), _NONE).astype(np.int64)


def _counted(x: np.ndarray, y: np.ndarray, bucket_: np.ndarray) -> pa.RecordBatch:
    """Cells of two estimates and a bucket: how many positions each has, and the sums of the estimates' logarithms (0 where they are 0)."""
    code = (half_octave(x) << 7 | half_octave(y)) << 7 | bucket_
    code, back, n = np.unique(code, return_inverse=True, return_counts=True)
    logs = [np.bincount(back, np.log(np.where(v > 0, v, 1.0)), len(code)) for v in (x, y)]
    return pa.RecordBatch.from_arrays([*(pa.array((code >> k & 127).astype(np.int32)) for k in (14, 7, 0)), pa.array(n.astype(np.int64)), *map(pa.array, logs)], ["x", "y", "z", "n", "lx", "ly"])


def _low_histogram(folder: str, total: int):
    """How often the positions of a block have these p1 and p2 (by half octaves) and bucket of the word before."""

    def run(b: Block) -> pa.RecordBatch:
        p1, p2, _, n1, _ = _estimates(b, folder, total)
        return _counted(p1, p2, bucket(n1))

    return run


def _high_histogram(folder: str, words: int, total: int, l1: float, l2: np.ndarray):
    """How often they have these P2 and p3 and bucket of the two words before."""

    def run(b: Block) -> pa.RecordBatch:
        p1, p2, p3, n1, n2 = _estimates(b, folder, total)
        return _counted(_mixed(p1, p2, n1, words, l1, l2), p3, bucket(n2))

    return run


def _mixed(p1: np.ndarray, p2: np.ndarray, n1: np.ndarray, words: int, l1: float, l2: np.ndarray) -> np.ndarray:
    """P2 at each position."""
    w = l2[bucket(n1)]
    return w * p2 + (1 - w) * (l1 * p1 + (1 - l1) / (words + 1))


def learn(high: np.ndarray, low: np.ndarray, bucket_: np.ndarray, n: np.ndarray, buckets: int = 64) -> np.ndarray:
    """Expectation-maximisation: for each bucket the weight of ``high`` against ``low`` that makes the n events likeliest; 0 for bucket 0."""
    weight = np.full(buckets, 0.5)
    mass = np.bincount(bucket_, n, buckets)
    for _ in range(_ROUNDS):
        w = weight[bucket_]
        share = w * high / np.maximum(w * high + (1 - w) * low, 1e-300)
        weight = np.clip(np.bincount(bucket_, n * share, buckets) / np.maximum(mass, 1), 0.0, 1 - 1e-6)
    weight[0] = 0.0
    return weight


def fit(blocks: DataFrame, parts: int, folder: str, words: int, total: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The weights l1, l2 by bucket, l3 by bucket. The driver sees histograms of 128 x 128 x 64 cells at most, whatever the corpus."""

    def cells(fn: Callable[[Block], pa.RecordBatch]) -> list[np.ndarray]:
        rows = blocks.mapInArrow(_each_block(parts, fn), "x int, y int, z int, n long, lx double, ly double")
        got = rows.groupBy("x", "y", "z").agg(*[F.sum(c).alias(c) for c in ("n", "lx", "ly")]).orderBy("x", "y", "z").toArrow()
        x, y, z, n, lx, ly = (got[c].to_numpy() for c in ("x", "y", "z", "n", "lx", "ly"))
        return [np.where(x == _NONE, 0.0, np.exp(lx / n)), np.where(y == _NONE, 0.0, np.exp(ly / n)), z.astype(np.int64), n.astype(np.int64)]

    p1, p2, b2, n = cells(_low_histogram(folder, total))
    even = np.full(len(p1), 1 / (words + 1))
    l1 = float(learn(p1, even, np.ones(len(p1), np.int64), n)[1])
    l2 = learn(p2, l1 * p1 + (1 - l1) * even, b2, n)
    low, p3, b3, n = cells(_high_histogram(folder, words, total, l1, l2))
    return l1, l2, learn(p3, low, b3, n)


def _scores(folder: str, words: int, total: int, l1: float, l2: np.ndarray, l3: np.ndarray):
    def run(b: Block) -> pa.RecordBatch:
        p1, p2, p3, n1, n2 = _estimates(b, folder, total)
        w = l3[bucket(n2)]
        p = w * p3 + (1 - w) * _mixed(p1, p2, n1, words, l1, l2)
        n = np.maximum(b.lens - 1, 0)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), np.log(p), len(n))
        null = b.lens < 0
        mean = sums / np.maximum(n, 1)
        return pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(n, mask=null), pa.array(sums, mask=null), pa.array(np.exp(-mean), mask=null)],
                                          ["doc_id", "n_scored", "log_prob", "perplexity"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_scored (words and the end), log_prob (natural logarithm), perplexity."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm")
    blocks = written(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_blocks, _BLOCKS), f"{folder}/blocks")
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + F.greatest(x, F.lit(0)))
    parts = ranges(blocks.agg(F.sum(size)).first()[0] or 0, tasks(spark), RANGE_WORDS)
    counts = f"{folder}/counts"
    words, total = _ask(blocks, parts, counts, _first_requests)
    release(spark)
    _ask(blocks, parts, counts, _second_requests(counts))
    release(spark)
    l1, l2, l3 = fit(blocks, parts, counts, words, total)
    return blocks.mapInArrow(_each_block(parts, _scores(counts, words, total, l1, l2, l3)), "doc_id long, n_scored long, log_prob double, perplexity double")
