"""Near duplicates: all pairs of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Exact, with adaptive multi-match prefixes. A text with a set of size s overlaps any partner in at least
o = ceil(t s) n-grams, so of two partners, each of which puts its s - o + l first n-grams (in one global order, rare ones
first) into its prefix, at least l are in both prefixes. Each text chooses its own l: a longer prefix costs more
entries, but a pair must then share more of them before it is verified: min(l, l'), and also the overlap that sets of just
these two sizes need, less the longer of the two rests outside the prefixes (what is shared up to the end of the prefix
that ends first lies in both). The choice minimises the estimated cost, entries plus candidates to verify, from a sketch
of n-gram frequencies over the whole corpus.

Plan: (1) a frequency sketch that grows with the corpus up to a fixed size, summed by chunk; (2) prefixes, packed into one binary row for each task and
range of hashes and shuffled once by range; (3) pairs within ranges, their shared counts packed and summed by pair;
(4) candidates verified on whole sets, their texts fetched by key once for each block of candidates.

Texts that share a passage or are near copies of one text give runs of entries with the same n-gram, and pairs as the
square of the run. A run of more than MOST_RUN is not expanded: its texts become one group (groups that share a text
are merged), and all pairs within a group are verified by products of 0-1 matrices, tile by tile. A tile sends on how many
partners each text has, and stars that connect what it linked, so what leaves a tile grows with its texts, not with its pairs.

Definitions. Words are runs of letters and numbers in lower case; a text of fewer than n words has one n-gram, all its words; a null
text, or one without words, has no partner but its copies. Identical texts are one unit and always alike. A unit's key is a
64-bit hash; texts that share it are told apart by a second one, so units are told apart by 128 bits.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm.shared import fresh, matched, mix, ngram_hashes, placed, ranges, release, shared_folder, slices, small, tasks, word_hashes, written

#: The sketch has 2 ** bits counters, sent in rows of 2 ** CHUNK_BITS by each task and broadcast as a byte each. The bits follow the
#: corpus between these two (4 to 32 MB), so that a counter has some CELL_CHARS characters of text: what falls in one by chance hides frequent n-grams.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 22, 25, 18
CELL_CHARS = 64
MOST_MATCHES = 8
_KEY_BITS = 40
#: N-grams in a range of hashes, at most about; a range is what a worker holds at once.
RANGE_GRAMS = 2_000_000
#: Pairs that a worker holds at once before it sends them on.
_MOST_PAIRS = 4_000_000
#: Characters of the texts of a block of pairs to verify, about.
_BLOCK_CHARS = 16_000_000
_VERIFY_COST = 0.05
#: Entries with the same n-gram, of sizes that can be partners, that are expanded into pairs; longer runs make a group.
MOST_RUN = 200
#: Characters of the texts of one side of a tile, about; a text counts as _TEXT_CHARS more, so a side has at most 2,000 texts.
_TILE_CHARS, _TEXT_CHARS = 8_000_000, 4000


def _sets(text: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each row that has any."""
    for i, j in slices(text):
        h, off = ngram_hashes(*word_hashes(text.slice(i, j - i)), n)
        for k in np.flatnonzero(np.diff(off)):
            yield i + int(k), np.unique(h[off[k]: off[k + 1]])


def sketch_bits(chars: int) -> int:
    """Bits of a sketch of texts of so many characters."""
    return min(MOST_BITS, max(LEAST_BITS, (chars // CELL_CHARS).bit_length()))


def _sketch(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(1 << bits, "<u2"), False
        for batch in batches:
            hashes = [s for _, s in _sets(batch.column(0), n)]
            for i in range(0, len(hashes), 512):
                cell = (np.concatenate(hashes[i: i + 512]) >> np.uint64(64 - bits)).astype(np.int64)
                at, c = np.unique(cell, return_counts=True)
                counts[at] = np.minimum(counts[at] + c, 65535)
                any_ = True
        if any_:
            packed = [_pack_counts(x) for x in counts.reshape(-1, 1 << CHUNK_BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    return run


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counters, most of them 0, as compressed byte planes of the steps from one that isn't to the next, and of their values."""
    at = np.flatnonzero(counts)
    cols = np.stack([np.diff(at, prepend=0), counts[at]]).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(cols.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes(), 1)


def _unpack_counts(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cells, their counts) of what _pack_counts gives."""
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(2, 4, -1)
    step, count = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(step), count


def _classes(cells: int):
    """Sums each chunk of so many counters: (chunk, classes of its cells, sum). Cells are dealt out by hash, so rare ones have the same average in any chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, count = _unpack_counts(b)
                if chunk not in total:
                    total[chunk] = np.zeros(cells, np.int64)
                total[chunk][at] += count
        for chunk, counts in total.items():
            floor = int(np.median(counts))
            cls = np.ceil(np.log2(np.maximum(1, counts - floor - int(2 * np.sqrt(floor)) + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zstandard.compress(cls.tobytes(), 1)], pa.binary()), pa.array([int(counts.sum())])], ["chunk", "classes", "total"])

    return run


def frequency_classes(texts: DataFrame, n: int, bits: int = LEAST_BITS) -> tuple[np.ndarray, int]:
    """For each of the 2 ** bits cells of the sketch, the rounded-up binary logarithm of its count above the average of rare cells; and the sum of all counts.

    Counts cover all texts.
    """
    rows = (texts.select("text").mapInArrow(_sketch(n, bits), "chunk int, counts binary").repartition(1 << (bits - CHUNK_BITS), "chunk")
            .mapInArrow(_classes(1 << CHUNK_BITS), "chunk int, classes binary, total long").collect())
    table = np.zeros((1 << (bits - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for r in rows:
        table[r.chunk] = np.frombuffer(zstandard.decompress(r.classes), np.uint8)
    return table.ravel(), sum(r.total for r in rows)


def overlap_needed(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """Least overlap of a set of that size with a partner of any size."""
    return np.maximum(1, np.ceil(np.asarray(size) * threshold - 1e-9)).astype(np.int64)


def shared_needed(size_a: np.ndarray, size_b: np.ndarray, matches_a: np.ndarray, matches_b: np.ndarray, threshold: float) -> np.ndarray:
    """Least number of n-grams that the prefixes of two partners of these sizes share."""
    both = np.ceil((size_a + size_b) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
    rest = np.maximum(overlap_needed(size_a, threshold) - matches_a, overlap_needed(size_b, threshold) - matches_b)
    return np.maximum(np.minimum(matches_a, matches_b).astype(np.int64), both - rest)


def choose_prefix(cls: np.ndarray, threshold: float) -> tuple[int, int]:
    """(matches, length) of the prefix of one set, whose n-grams have the classes ``cls`` in the global order.

    At l matches a prefix meets about sum(2 ** cls) other entries, and at most a share 1 / l of them can be candidates,
    each of which costs a part of its length to verify.
    """
    size = len(cls)
    need = int(overlap_needed(size, threshold))
    load = np.cumsum(np.exp2(cls.astype(np.float64)) - 1)
    most = min(MOST_MATCHES, need)
    lengths = size - need + np.arange(1, most + 1)
    met = load[lengths - 1]
    cost = lengths + met + _VERIFY_COST * size * met / np.arange(1, most + 1)
    best = int(np.argmin(cost))
    return best + 1, int(lengths[best])


def _prefixes(classes, n: int, threshold: float, parts: int):
    """Per batch and range of hashes one row: (part, units, sizes, matches, counts, keys of 40 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        away = np.uint64(65 - len(table).bit_length())
        buffer: list[tuple[int, int, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            units = batch.column(1).to_numpy()
            for row, s in _sets(batch.column(0), n):
                cls = table[(s >> away).astype(np.int64)]
                order = np.argsort(cls, kind="stable")
                matches, length = choose_prefix(cls[order], threshold)
                buffer.append((int(units[row]), len(s), matches, s[order[:length]]))
                held += length
                if held > 2_000_000:
                    yield _pack(buffer, parts)
                    buffer, held = [], 0
        if buffer:
            yield _pack(buffer, parts)

    return run


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(_KEY_BITS)) % np.uint64(parts)).astype(np.int64)


def _pack(rows: list[tuple[int, int, int, np.ndarray]], parts: int) -> pa.RecordBatch:
    keys = np.concatenate([r[3] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    part = _part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    keys, doc, part = keys[order], doc[order], part[order]
    unit = np.array([r[0] for r in rows], np.int64)
    size = np.array([r[1] for r in rows], "<u4")
    matches = np.array([r[2] for r in rows], np.uint8)
    edge = np.searchsorted(part, np.arange(parts + 1))
    out_part, blobs = [], []
    for p in np.flatnonzero(np.diff(edge)):
        d = doc[edge[p]: edge[p + 1]]
        own, count = np.unique(d, return_counts=True)  # doc ascends within a part
        low = keys[edge[p]: edge[p + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8]
        out_part.append(int(p))
        blobs.append(struct.pack("<II", len(own), len(d)) + unit[own].astype("<i8").tobytes() + size[own].tobytes()
                     + matches[own].tobytes() + count.astype("<u4").tobytes() + low.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])


def _unpack(b: bytes) -> tuple[np.ndarray, ...]:
    docs, entries = struct.unpack_from("<II", b)
    at = 8
    out = []
    for kind, count in (("<i8", docs), ("<u4", docs), (np.uint8, docs), ("<u4", docs)):
        out.append(np.frombuffer(b, kind, count, at))
        at += out[-1].nbytes
    low = np.zeros((entries, 8), np.uint8)
    low[:, : _KEY_BITS // 8] = np.frombuffer(b, np.uint8, entries * _KEY_BITS // 8, at).reshape(entries, -1)
    return (*out, low.view("<u8").ravel())


def _grouped(doc: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(docs, the least one connected to each) of adjacent runs of docs with these lengths; a run connects its docs."""
    own, d = np.unique(doc, return_inverse=True)
    label, start = np.arange(len(own)), np.cumsum(length) - length
    while True:
        least = label.copy()
        np.minimum.at(least, d, np.repeat(np.minimum.reduceat(label[d], start), length))
        least = least[least]
        if (least == label).all():
            return own, own[label]
        label = least


def _pairs(threshold: float, bits: int, parts: int, most_run: int):
    """Within each range of hashes: pairs of units, how many prefix n-grams they share there, how many they need.

    A pair may be sent on more than once, with parts of what it shares, so that a worker holds a bounded number of them.
    Of runs longer than ``most_run`` the units are sent in place of the pairs (``grouped``): unit, least unit, size.
    """

    def flush(current: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        unpacked = [_unpack(b) for b in blobs]
        unit = np.concatenate([u[0] for u in unpacked])
        size = np.concatenate([u[1] for u in unpacked]).astype(np.int64)
        matches = np.concatenate([u[2] for u in unpacked])
        count = np.concatenate([u[3] for u in unpacked])
        key = np.concatenate([u[4] for u in unpacked])
        doc = np.repeat(np.arange(len(unit)), count)
        _, first = np.unique(unit, return_index=True)  # identical texts have identical entries: one stays
        once = np.zeros(len(unit), bool)
        once[first] = True
        keep = once[doc]
        key, doc = key[keep], doc[keep]
        order = np.lexsort((size[doc], key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (size[doc[1:]] * threshold > size[doc[:-1]] + 1e-9)  # no pair reaches across a gap in size
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(key)))
        long = length > most_run
        if long.any():
            own, least = _grouped(doc[np.repeat(long, length)], length[long])
            data = np.stack([unit[own], unit[least], size[own]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([data], pa.binary()), pa.array([True])], ["part", "data", "grouped"])
        shared_start, shared_length = start[(length > 1) & ~long], length[(length > 1) & ~long]
        step = 1
        found: list[np.ndarray] = []
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, back = np.unique(np.concatenate([code, *found]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([n, np.ones(sum(map(len, found)), np.int64)]), len(every)).astype(np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(code), 1_000_000):
                c, k = code[i: i + 1_000_000], n[i: i + 1_000_000]
                x, y = c // len(unit), c % len(unit)
                yield from _pack_pairs(unit[x], unit[y], k, shared_needed(size[x], size[y], matches[x], matches[y], threshold), bits, parts)

        # the step-th next entry of each run, for all runs at once; runs are sorted by size, so a run ends for an entry
        # at the first partner that is too large
        left = np.repeat(shared_start - np.cumsum(shared_length) + shared_length, shared_length) + np.arange(shared_length.sum())
        ends = np.repeat(shared_start + shared_length, shared_length)
        while len(left):
            right = left + step
            ok = right < ends
            left, ends, right = left[ok], ends[ok], right[ok]
            a, b = doc[left], doc[right]
            ok = size[b] * threshold <= size[a] + 1e-9
            left, ends, a, b = left[ok], ends[ok], a[ok], b[ok]
            found.append(np.minimum(a, b) * len(unit) + np.maximum(a, b))
            if sum(map(len, found)) > _MOST_PAIRS:
                code, n = merged()
                found = []
                if len(code) > _MOST_PAIRS:
                    yield from sent()
                    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            step += 1
        code, n = merged()
        yield from sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != current and blobs:
                    yield from flush(current, blobs)
                    blobs = []
                current = part
                blobs.append(data)
        if blobs:
            yield from flush(current, blobs)

    return run


def _pack_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    a, b = (x.view(np.uint64) >> np.uint64(64 - bits) for x in (a, b))
    a, b = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    part = (mix(a.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((b, a, part))
    a, b, part = a[order], b[order], part[order]
    n, need = (np.minimum(x[order], 65535) for x in (n, need))
    edge = np.searchsorted(part, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edge))
    blob = [_squeeze(*(x[edge[p]: edge[p + 1]] for x in (a, b, n, need))) for p in some]
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blob, pa.binary()), pa.array([False] * len(some))], ["part", "data", "grouped"])


def _squeeze(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray) -> bytes:
    """Sorted pairs in little space: steps from one to the next, as compressed byte planes (of 4 bytes, or 8 where keys need them)."""
    step = np.diff(a, prepend=0)
    width = 4 if max(a[-1], b.max()) < 1 << 32 else 8
    cols = np.stack([step, np.where(step == 0, np.diff(b, prepend=0), b), n, need]).astype(f"<u{width}")
    planes = np.ascontiguousarray(cols.view(np.uint8).reshape(4, -1, width).transpose(0, 2, 1))
    return struct.pack("<IB", len(a), width) + zstandard.compress(planes.tobytes(), 3)


def _unsqueeze(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, width = struct.unpack_from("<IB", x)
    planes = np.frombuffer(zstandard.decompress(x[5:]), np.uint8).reshape(4, width, m)
    step, b, n, need = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<u{width}").reshape(4, m).astype(np.int64)
    total = np.cumsum(b)
    first = np.flatnonzero(np.append(True, step[1:] != 0))
    base = np.repeat(total[first] - b[first], np.diff(np.append(first, m)))
    return np.cumsum(step), total - base, n, need


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the shared counts of each pair and keeps those with enough. Units of groups pass: unit, another of its group, size."""

    def flush(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols = zip(*(_unsqueeze(x) for x in blobs), strict=True)
        a, b, n, need = (np.concatenate(c) for c in cols)
        order = np.lexsort((b, a))
        a, b, n, need = a[order], b[order], n[order].astype(np.int64), need[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(new)
        keep = start[np.add.reduceat(n, start) >= np.minimum.reduceat(need, start)] if len(start) else start
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.nulls(len(keep), pa.int64())], ["a", "b", "size"])

    current, blobs = None, []
    for batch in batches:
        for part, data, grouped in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if grouped:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(data, "<i8").reshape(3, -1)], ["a", "b", "size"])
                continue
            if part != current and blobs:
                yield from flush(blobs)
                blobs = []
            current = part
            blobs.append(data)
    if blobs:
        yield from flush(blobs)


def _verify(n: int, threshold: float):
    """Over rows sorted by block, texts before pairs: the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            names = batch.schema.names
            blocks = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("hub", "ca", "cb")), strict=True))
            a, b = batch.column(names.index("a")).to_pylist(), batch.column(names.index("b")).to_pylist()
            text = batch.column(names.index("text"))
            own = dict(_sets(text, n))
            wanted: dict[int, list[int]] = defaultdict(list)
            out: tuple[list, ...] = ([], [], [], [])

            def settle() -> None:
                for left, rights in wanted.items():
                    s = sets.get(left)
                    if s is None:
                        continue
                    rights = [r for r in rights if r in sets]
                    for i in range(0, len(rights), 256):
                        part = rights[i: i + 256]
                        lens = np.array([len(sets[r]) for r in part])
                        every = np.concatenate([sets[r] for r in part])
                        at = np.minimum(np.searchsorted(s, every), len(s) - 1)
                        both = np.add.reduceat((s[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
                        union = len(s) + lens - both
                        for r, x, u in zip(part, both.tolist(), union.tolist(), strict=True):
                            if x >= threshold * u - 1e-9:
                                out[0].append(left)
                                out[1].append(r)
                                out[2].append(x)
                                out[3].append(u)
                wanted.clear()

            for k, x in enumerate(blocks):
                if x != block:
                    settle()
                    block, sets = x, {}
                if b[k] is None:
                    if k in own:
                        sets[a[k]] = own[k]
                else:
                    wanted[a[k]].append(b[k])
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "overlap", "unions"])

    return run


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``a`` shares with each one of ``b``.

    Values in many sets of both are counted by products of matrices, the others pair by pair.
    """
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out

    def sorted_by_value(sets: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        ok = both[at] == v
        at, row = at[ok], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[ok]
        order = np.argsort(at, kind="stable")
        return at[order], row[order], np.bincount(at, minlength=len(both))

    (at_a, row_a, count_a), (at_b, row_b, count_b) = sorted_by_value(a, va), sorted_by_value(b, vb)
    dense = count_a * count_b > len(a) * len(b) / 300  # a pair costs as much as some 300 steps of a product
    column, wide = np.cumsum(dense) - 1, max(64, 4_000_000 // (len(a) + len(b)))
    for low in range(0, int(dense.sum()), wide):
        sides = []
        for at, row, sets in ((at_a, row_a, a), (at_b, row_b, b)):
            own = dense[at] & (column[at] >= low) & (column[at] < low + wide)
            x = np.zeros((len(sets), min(wide, int(dense.sum()) - low)), np.float32)
            x[row[own], column[at[own]] - low] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    first_a, first_b, rare = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b, np.flatnonzero(~dense)
    ends = np.cumsum(count_a[rare] * count_b[rare])
    i = 0
    while i < len(rare):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2_000_000, "right")))
        v = rare[i:j]
        each = count_a[v] * count_b[v]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        v = np.repeat(v, each)
        np.add.at(out, (row_a[first_a[v] + k // count_b[v]], row_b[first_b[v] + k % count_b[v]]), np.float32(1))
        i = j
    return out


def _stars(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row that stands for what ``link`` connects, for each row and for each column; -1 where nothing does."""
    row, column = np.full(link.shape[0], -1), np.full(link.shape[1], -1)
    for r in np.flatnonzero(link.any(1)):
        front = np.array([r]) if row[r] < 0 else np.zeros(0, np.int64)
        row[front] = r
        while len(front):
            met = np.flatnonzero(link[front].any(0) & (column < 0))
            column[met] = r
            front = np.flatnonzero(link[:, met].any(1) & (row < 0))
            row[front] = r
    return row, column


def _packed_sets(n: int):
    """Rows (unit, root, piece, rows, text) with the set in place of the text: a tile needs no hashing, which takes most of the time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            for i, j in slices(text):
                own = [(i + k, s.astype("<u8").tobytes()) for k, s in _sets(text.slice(i, j - i), n)]
                at = pa.array([k for k, _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).take(at) for c in ("unit", "root", "piece", "rows")), pa.array([s for _, s in own], pa.binary())],
                                                 ["unit", "root", "piece", "rows", "grams"])

    return run


def _tiles(threshold: float):
    """Over rows sorted by tile: the rows of a unit's partners in the tile (a, linked), and units that links connect (a, b)."""

    def settle(sides: list[list[tuple[int, int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        one = not sides[1]
        x, y = sides[0], sides[0] if one else sides[1]
        unit_x, unit_y = (np.array([r[0] for r in z], np.int64) for z in (x, y))
        rows_x, rows_y = (np.array([r[1] for r in z], np.int64) for z in (x, y))
        size_x, size_y = (np.array([len(r[2]) for r in z]) for z in (x, y))
        both = _shared([r[2] for r in x], [r[2] for r in y])
        link = np.zeros(both.shape, bool)
        for i in range(0, len(x), 256):
            c = both[i: i + 256].astype(np.float64)
            link[i: i + 256] = c >= threshold * (size_x[i: i + 256, None] + size_y - c) - 1e-9
        if one:
            np.fill_diagonal(link, False)
        linked = [(unit_x, link @ rows_y)] + ([] if one else [(unit_y, rows_x @ link)])
        if one:
            np.fill_diagonal(link, True)
        for unit, count in linked:
            a = unit[count > 0]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(count[count > 0])], ["a", "b", "linked"])
        for unit, star in zip((unit_x, unit_y), _stars(link), strict=True):
            a, b = unit_x[star[star >= 0]], unit[star >= 0]
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides = None, [[], []]
        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("root", "x", "y")), strict=True))
            for key, side, unit, rows, grams in zip(keys, *(batch.column(names.index(c)).to_pylist() for c in ("side", "unit", "rows", "grams")), strict=True):
                if key != tile:
                    if tile:
                        yield from settle(sides)
                    tile, sides = key, [[], []]
                sides[side].append((unit, rows, np.frombuffer(grams, "<u8")))
        if tile:
            yield from settle(sides)

    return run


def group_links(units: DataFrame, groups: DataFrame, n: int, threshold: float, folder: str) -> DataFrame:
    """All links within ``groups`` (unit, root, size, chars, rows): the rows of a unit's partners (a, linked; several rows for
    one unit), and units that links connect (a, b).

    The units of a group, in the order of their sizes, are cut into pieces, and each pair of pieces with sizes that can be
    partners is a tile.
    """
    spark = units.sparkSession
    weight = F.col("chars") + F.lit(_TEXT_CHARS)
    before = F.sum(weight).over(Window.partitionBy("root").orderBy("size", "unit")) - weight
    pieces = written(groups.select("unit", "root", "size", "rows", F.floor(before / _TILE_CHARS).cast("int").alias("piece")), f"{folder}/pieces")
    x = written(pieces.groupBy("root", "piece").agg(F.min("size").alias("least"), F.max("size").alias("most")), f"{folder}/piece-sizes")
    y = x.select("root", F.col("piece").alias("y"), F.col("least").alias("least_y"))
    tiles = x.withColumnRenamed("piece", "x").join(y, "root").where(f"x = y OR x < y AND least_y * {threshold!r}D <= most + 1e-9D").select("root", "x", "y")
    one, two = F.struct(F.col("x").alias("piece"), F.lit(0).alias("side")), F.struct(F.col("y").alias("piece"), F.lit(1).alias("side"))
    sides = tiles.select("root", "x", "y", F.explode(F.when(F.expr("x = y"), F.array(one)).otherwise(F.array(one, two))).alias("of")).select("root", "x", "y", "of.piece", "of.side")
    sides = written(sides, f"{folder}/sides")
    texts = matched(units.select("unit", "text"), pieces, "unit", "left_semi").dropDuplicates(["unit"])
    sets = texts.join(pieces, "unit").select("unit", "root", "piece", "rows", "text").mapInArrow(_packed_sets(n), "unit long, root long, piece int, rows long, grams binary")
    sets = written(sets, f"{folder}/group-sets")
    rows = sets.join(F.broadcast(sides) if small(sides, row_bytes=32) else sides, ["root", "piece"]).select("root", "x", "y", "side", "unit", "rows", "grams")
    done = rows.repartition(tasks(spark), "root", "x", "y").sortWithinPartitions("root", "x", "y", "side").mapInArrow(_tiles(threshold), "a long, b long, linked long")
    return written(done, f"{folder}/group-links")


def candidate_pairs(units: DataFrame, keys: DataFrame, n: int, threshold: float, folder: str, most_run: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of unit keys (all of which are in ``keys``), a < b, that share enough prefix n-grams; and groups of
    units (unit, root, size, chars, rows), or None if there are none. No pair that reaches the threshold is in neither; none is in both.

    Shared counts are summed under the leading bits of the keys, a few more than tell the units apart; where two units
    have the same, their counts add up, which can only make more candidates.
    """
    spark = units.sparkSession
    table, grams = frequency_classes(units, n, sketch_bits(keys.agg(F.sum(F.col("chars") * F.col("rows"))).first()[0] or 0))
    release(spark)
    classes = spark.sparkContext.broadcast(table)
    parts = ranges(grams, tasks(spark), RANGE_GRAMS)
    bits = min(62, max(8, keys.count().bit_length() + 3))
    data = (placed(units.select("text", "unit").mapInArrow(_prefixes(classes, n, threshold, parts), "part int, data binary"), "part")
            .mapInArrow(_pairs(threshold, bits, parts, most_run), "part int, data binary, grouped boolean"))
    every = written(placed(data, "part").mapInArrow(_candidates, "a long, b long, size long"), f"{folder}/shared")
    found, grouped = every.where("size IS NULL").select("a", "b"), every.where("size IS NOT NULL")
    place = F.shiftrightunsigned("unit", 64 - bits)
    full = (found.join(keys.select(place.alias("a"), F.col("unit").alias("ua")), "a").join(keys.select(place.alias("b"), F.col("unit").alias("ub")), "b")
            .where("a <> b OR ua < ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")))
    groups = None
    if not grouped.isEmpty():
        root = components(grouped, f"{folder}/grouped")
        one = grouped.groupBy(F.col("a").alias("unit")).agg(F.max("size").alias("size")).join(root, "unit")
        groups = written(matched(keys, one, "unit", "left_semi").join(one, "unit").select("unit", "root", "size", "chars", "rows"), f"{folder}/groups")
        of = lambda c: F.broadcast(x) if small(x := groups.select(F.col("unit").alias(c), F.col("root").alias(f"root_{c}"))) else x
        full = full.join(of("a"), "a", "left").join(of("b"), "b", "left").where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b")
    return written(full, f"{folder}/candidates"), groups


def unit_links(units: DataFrame, keys: DataFrame, n: int, threshold: float, folder: str, most_run: int) -> tuple[DataFrame, DataFrame | None]:
    """Verified pairs of unit keys outside groups: a, b, overlap, unions (sizes of intersection and union); and what group_links
    gives for the groups, or None. ``units`` and ``keys``: see as_units."""
    spark = units.sparkSession
    found, groups = candidate_pairs(units, keys, n, threshold, folder, most_run)
    release(spark)
    within = None if groups is None else group_links(units, groups, n, threshold, folder)
    # Blocks: a unit's hub is its least partner (or itself), a pair belongs to the lesser hub of its two; near copies of one
    # text so come to one block, which gets each text once. Large hubs are split into pairs of chunks of bounded size.
    both = found.unionAll(found.select("b", "a"))
    hub = both.groupBy(F.col("a").alias("unit")).agg(F.least(F.min("b"), F.first("a")).alias("hub"))
    hub = written(hub, f"{folder}/hubs")
    load = (matched(keys, hub, "unit", "left_semi").join(hub, "unit").groupBy("hub").agg(F.ceil(F.sum("chars") / _BLOCK_CHARS).cast("int").alias("chunks"))
            .where("chunks > 1"))
    blocks = (found.join(hub.select(F.col("unit").alias("a"), F.col("hub").alias("ha")), "a")
              .join(hub.select(F.col("unit").alias("b"), F.col("hub").alias("hb")), "b")
              .select("a", "b", F.least("ha", "hb").alias("hub")).join(load, "hub", "left"))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.coalesce("chunks", F.lit(1))).cast("int")
    blocks = written(blocks.select("a", "b", "hub", F.least(chunk("a"), chunk("b")).alias("ca"), F.greatest(chunk("a"), chunk("b")).alias("cb")), f"{folder}/blocks")
    members = written(blocks.select("hub", "ca", "cb", F.explode(F.array("a", "b")).alias("unit")).distinct(), f"{folder}/members")
    texts = matched(units.select("unit", "text"), written(members.select("unit").distinct(), f"{folder}/wanted"), "unit", "left_semi")
    texts = texts.dropDuplicates(["unit"]) if not small(members) else texts
    member = F.broadcast(members) if small(members, row_bytes=32) else members
    rows = (texts.join(member, "unit").select("hub", "ca", "cb", F.col("unit").alias("a"), F.lit(None).cast("long").alias("b"), "text")
            .unionAll(blocks.select("hub", "ca", "cb", "a", "b", F.lit(None).cast("string"))))
    pairs = (rows.repartition(tasks(spark), "hub", "ca", "cb").sortWithinPartitions("hub", "ca", "cb", F.col("b").asc_nulls_first())
             .mapInArrow(_verify(n, threshold), "a long, b long, overlap long, unions long"))
    return written(pairs, f"{folder}/pairs"), within


def connected(pairs: DataFrame, within: DataFrame | None) -> DataFrame:
    """Edges (a, b) that connect what the links of unit_links connect."""
    edges = pairs.select("a", "b")
    return edges if within is None else edges.unionAll(within.where("b IS NOT NULL").select("a", "b"))


def as_units(docs: DataFrame, folder: str, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, bool]:
    """(unit, text, doc_id) of each text; the units' keys: (unit, chars, rows, id), the number of rows and their smallest id; and whether keys clashed.

    ``key`` gives a 64-bit hash of a text. Where different texts share one (as a second hash shows), which is rare, their
    units are a hash of both.
    """
    text = F.col("text")
    other = F.xxhash64(F.lit("other"), text)
    rows = docs.where("text IS NOT NULL").select(key(text).alias("unit"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        length = F.length("text")
        one = rows.groupBy("unit").agg(F.max(length).cast("long").alias("chars"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("id"),
                                       (F.min(other) != F.max(other)).alias("clash"))
        return written(one, f"{folder}/{name}")

    keys = grouped(rows, "keys")
    clash = keys.where("clash").select("unit")
    apart = not clash.isEmpty()
    if apart:
        mark = F.broadcast(clash.withColumn("clash", F.lit(True))) if small(clash) else clash.withColumn("clash", F.lit(True))
        rows = rows.join(mark, "unit", "left").select(F.when(F.col("clash"), F.xxhash64(other, "unit")).otherwise(F.col("unit")).alias("unit"), "text", "doc_id")
        keys = grouped(rows, "keys-apart")
    return rows, keys.drop("clash"), apart


def near_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: Callable[[Column], Column] = F.xxhash64, most_run: int = MOST_RUN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, links.

    Two rows are linked if their texts are identical or have at least that similarity; ``links`` is the number of other
    rows to which this one is linked, and a class is what links connect. ``class_id`` is the smallest id in the class
    (null if it has none). Copies are counted, not paired; each pair of different texts is verified once. A row
    without links is a class of its own; so is one with a null text.
    """
    folder = shared_folder(docs.sparkSession, "near-classes")
    docs = spread(docs.select("doc_id", "text"))
    units, keys, _ = as_units(docs, folder, key)
    pairs, within = unit_links(units, keys, n, threshold, folder, most_run)
    root = components(connected(pairs, within), f"{folder}/components")
    some = written(keys.join(root, "unit", "left").where("rows > 1 OR root IS NOT NULL").select("unit", F.coalesce("root", "unit").alias("root"), "rows", "id"), f"{folder}/some")
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a"))
    counts = some.select(F.col("unit").alias("b"), "rows")
    linked = both.join(F.broadcast(counts) if small(counts) else counts, "b").select("a", F.col("rows").alias("linked"))
    linked = linked if within is None else linked.unionAll(within.where("linked IS NOT NULL").select("a", "linked"))
    linked = linked.groupBy(F.col("a").alias("unit")).agg(F.sum("linked").alias("linked"))
    least = some.groupBy("root").agg(F.min("id").alias("class_id"))
    facts = written(some.join(least, "root").join(linked, "unit", "left")
                    .select("unit", "class_id", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("links")), f"{folder}/facts")
    own = units.select("unit", "doc_id").unionAll(docs.where("text IS NULL").select(F.lit(None).cast("long"), F.col("doc_id").cast("long")))
    facts = F.broadcast(facts) if small(facts, row_bytes=32) else facts
    return (own.join(facts, "unit", "left")
            .select("doc_id", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(unit, root): the least unit connected to each one, by hooking and pointer jumping on written tables.

    Each partition first reduces its edges to a forest, so the rounds (logarithmic in the longest path) see few edges.
    """
    edges = written(edges.select("a", "b").mapInArrow(_forest, "a long, b long"), f"{folder}/forest")
    label = written(edges.select(F.explode(F.array("a", "b")).alias("unit")).distinct().withColumn("root", F.col("unit")), f"{folder}/label-0")
    turn = 0
    while True:
        turn += 1
        la = label.select(F.col("unit").alias("a"), F.col("root").alias("ra"))
        lb = label.select(F.col("unit").alias("b"), F.col("root").alias("rb"))
        roots = edges.join(la, "a").join(lb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to"))
        hooks = written(roots.groupBy("root").agg(F.min("to").alias("to")), f"{folder}/hooks-{turn}")
        if hooks.isEmpty():
            return label
        label = written(label.join(hooks, "root", "left").select("unit", F.coalesce("to", "root").alias("root")), f"{folder}/hooked-{turn}")
        # a root that was hooked may itself have a new root: jump until none has
        jump = 0
        while True:
            up = label.where("unit <> root").select(F.col("unit").alias("root"), F.col("root").alias("to"))
            moved = label.join(up, "root", "left").select("unit", F.coalesce("to", "root").alias("next"), "root")
            moved = written(moved, f"{folder}/jump-{turn}-{jump}")
            label = moved.select("unit", F.col("next").alias("root"))
            jump += 1
            if moved.where("next <> root").isEmpty():
                break


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    star = [(find(x), x) for x in up if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in star], pa.int64()), pa.array([s[1] for s in star], pa.int64())], ["a", "b"])


def keep_one(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: Callable[[Column], Column] = F.xxhash64, most_run: int = MOST_RUN) -> DataFrame:
    """``docs`` with one text of each group of near duplicates, the one with the smallest id; all columns unchanged.

    A group is what pairs connect. Identical texts stay or go together (exact deduplication is its own operator);
    rows whose text is null or has no words stay.
    """
    folder = shared_folder(docs.sparkSession, "near-groups")
    units, keys, told = as_units(docs, folder, key)
    root = components(connected(*unit_links(units, keys, n, threshold, folder, most_run)), f"{folder}/components")
    ranked = root.join(keys, "unit").select("unit", "root", F.struct(F.col("id").isNull(), "id", "unit").alias("place"))
    best = ranked.groupBy("root").agg(F.min_by("unit", "place").alias("best"))
    gone = written(ranked.join(best, "root").where("unit <> best").select("unit"), f"{folder}/gone")
    first, apart = (fresh(docs.columns, x) for x in ("unit", "apart"))
    text = F.col("text")
    stay = matched(docs.withColumn(first, key(text)), gone.withColumnRenamed("unit", first), first, "left_anti")
    if told:
        stay = matched(stay.withColumn(apart, F.xxhash64(F.xxhash64(F.lit("other"), text), F.col(first))), gone.withColumnRenamed("unit", apart), apart, "left_anti")
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB: what near_classes gives at n = 3 and threshold 0.5.
CLASSES_SQL = """
WITH RECURSIVE words AS (SELECT text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, count(*) AS rows, min(doc_id) AS id
               FROM documents WHERE text IS NOT NULL GROUP BY text),
units AS (SELECT row_number() OVER (ORDER BY text) AS u, text, rows, id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS grams FROM words),
grams AS (SELECT u, unnest(grams) AS g FROM units),
shared AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.u < b.u GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN units x ON x.u = a JOIN units y ON y.u = b WHERE c >= 0.5 * (len(x.grams) + len(y.grams) - c)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS u, a AS v FROM edges UNION SELECT reach.u, edges.b FROM reach JOIN edges ON edges.a = reach.v),
class AS (SELECT reach.u, min(id) AS class_id FROM reach JOIN units ON units.u = reach.v GROUP BY reach.u),
linked AS (SELECT a AS u, sum(rows) AS n FROM edges JOIN units ON units.u = b GROUP BY a)
SELECT doc_id, CASE WHEN units.u IS NULL THEN doc_id WHEN class.u IS NULL THEN id ELSE class_id END AS class_id,
  CASE WHEN units.u IS NULL THEN 0 ELSE (rows - 1 + coalesce(n, 0))::BIGINT END AS links
FROM documents LEFT JOIN units USING (text) LEFT JOIN class USING (u) LEFT JOIN linked USING (u)"""
