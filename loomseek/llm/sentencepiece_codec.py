"""SentencePiece BPE models: exact encoding by backtracking over longest matches, and decoding.

A model file is read with a small parser of its own. The text is cut where no piece can cross: before a run of spaces
after other characters, and around characters that no piece has. Each different unit of a slice of texts is encoded once,
all of them side by side in arrays (``encode_units``; ``backtrack`` is the same for one unit, for what doesn't fit there):
an Aho-Corasick automaton gives the longest piece at each position; a piece is taken if it is compatible with the one
before it, that is, if merging the two pieces' characters again gives the two (which is followed backwards along their border: where
a union across it scores better than the merge that is undone next, it would have come first); otherwise the next shorter prefix
is tried, and a position where none is left is marked in a bitfield and the piece before it taken back.
Pieces of equal score (runs of spaces) have no total order, so a unit with such a run is merged directly.

Definitions. A null text has null ids; an empty one has none. Characters without a piece become byte pieces, or the unknown
piece if the model has no bytes. Text like "<s>" is ordinary text. Decoding gives back every encoded text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.llm.shared import fresh, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_MOST_CACHED = 100_000  # pairs, and units in each of two generations, that a worker remembers: some 20 MB each
_BLOCK = 1 << 20  # characters of units that are encoded side by side
_MEMO_BITS = 20
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes, i: int, end: int) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one message; a nested one is given as its range."""
    while i < end:
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            value, i = (i, i + n), i + n
        else:
            n = 4 if wire == 5 else 8
            value, i = struct.unpack("<f" if wire == 5 else "<d", b[i: i + n])[0], i + n
        yield key >> 3, value


class Recent(dict):
    """Remembers what was used lately: when the young generation is full it becomes the old one, and what is used again moves up."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def find(self, key):
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Codec:
    """Encoder and decoder of one model of type BPE with identity normalization."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.prefix, self.squeeze, kind, charsmap = True, True, 1, b""
        self.byte_ids = [-1] * 256
        for field, at in _fields(model, 0, len(model)):
            if field == 1:
                d = dict(_fields(model, *at))
                piece, score, sort = model[slice(*d[1])].decode(), float(d.get(2, 0.0)), int(d.get(3, _NORMAL))
                if sort == _NORMAL:
                    self.score[piece], self.ids[piece] = score, len(self.pieces)
                elif sort == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = len(self.pieces)
                elif sort == _USER:
                    raise ValueError("user-defined pieces are not supported")
                self.pieces.append(piece)
                self.kinds.append(sort)
            elif field == 2:
                kind = dict(_fields(model, *at)).get(3, 1)
            elif field == 3:
                d = dict(_fields(model, *at))
                self.prefix, self.squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
                charsmap = model[slice(*d[2])] if 2 in d else b""
        if kind != 2 or charsmap or self.squeeze:
            raise ValueError("the model must be of type BPE, with identity normalization that keeps all spaces")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        tied: dict[float, int] = {}
        for s in self.score.values():
            tied[s] = tied.get(s, 0) + 1
        self.tied = {p for p, s in self.score.items() if tied[s] > 1}
        if any(p.strip(SPACE) for p in self.tied):
            raise ValueError("pieces other than runs of spaces share a score")
        self.known = {c for p in self.ids for c in p}
        chars = "".join(sorted(self.known)).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-")
        self._segments = re.compile(f"[{chars}]+|[^{chars}]+")
        # pieces that merging reaches, with the parts of the last merge; the automaton over them; for each the longest other one that it begins with
        self.halves: dict[str, tuple[str, str]] = {}
        self.reached = {p for p in self.ids if len(p) == 1 or self.merge(p, self.halves) == [p]}
        self.level = {p: -self.score[p] if len(p) > 1 else -np.inf for p in self.reached}
        # scores fall from parts to wholes in a model of merges; where they don't, pieces are merged from their characters
        self.falls = all(max(self.level[a], self.level[b]) < self.level[p] for p, (a, b) in self.halves.items() if p in self.reached and p not in self.tied)
        self.automaton = ahocorasick.Automaton()
        # a node looks for a character in the order that its children came in: common ones, which have the lower ids, come first
        self._ordered = sorted(self.reached, key=lambda p: (len(p) > 1, self.ids[p]))
        for p in self._ordered:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.reached), None) for p in self.reached}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._cache = Recent(_MOST_CACHED)
        self.side_by_side = self.falls and self.splits and self.prefix and self.known <= self.ids.keys() and min(self.byte_ids) >= 0
        if self.side_by_side:
            self._tables()
        raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else p.replace(SPACE, " ").encode()
               for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._raw = pa.array(raw, pa.large_binary())
        self._raw_len = np.array([len(x) for x in raw], np.int64)

    def merge(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The pieces that merging gives: always the pair whose union scores best, of equals the leftmost. If the text becomes one, ``halves`` gets its two parts."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                union = parts[i] + parts[j]
                s = self.score.get(union)
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, union))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, union = heapq.heappop(heap)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != union:
                continue
            if halves is not None and len(union) == len(text):
                halves[text] = parts[i], parts[j]
            parts[i], parts[j] = union, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of two adjacent pieces gives these two pieces."""
        if not self.falls:
            return self.merge(a + b) == [a, b]
        level, score, halves = self.level, self.score, self.halves
        next_, right = np.inf, False
        while True:
            s = score.get(a + b)
            if s is not None and (-s < next_ or (right and -s == next_)):  # of equals the leftmost comes first
                return False
            x, y = level[a], level[b]
            if x > y:
                next_, right, a = x, False, halves[a][1]
            elif len(b) > 1:
                next_, right, b = y, True, halves[b][0]
            else:  # two characters
                return True

    def _tables(self) -> None:
        """Arrays over piece ids for ``encode_units``."""
        n = len(self.pieces)
        self._len = np.array([len(p) for p in self.pieces], np.int32)
        self._next_shorter = np.full(n, -1, np.int32)
        self._level = np.full(n, np.inf)
        self._left, self._right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self._coded = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in self._ordered:
            k = self.ids[p]
            self._coded.add_word(p, k)
            self._level[k] = self.level[p]
            if self.shorter[p] is not None:
                self._next_shorter[k] = self.ids[self.shorter[p]]
            if len(p) > 1:
                self._left[k], self._right[k] = (self.ids[h] for h in self.halves[p])
        self._coded.make_automaton()
        unions = sorted((self.ids[p[:i]] * n + self.ids[p[i:]], -s) for p, s in self.score.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids)
        self._union = np.array([k for k, _ in unions] or [-1], np.int64)
        self._union_level = np.array([x for _, x in unions] or [np.inf])
        self._known_char = np.zeros(0x110000, bool)
        self._known_char[[ord(c) for c in self.known]] = True
        self._gap = next(c for c in "\n\0\1\2" if c not in self.known)
        self._memo_key, self._memo = np.full(1 << _MEMO_BITS, -1, np.int64), np.zeros(1 << _MEMO_BITS, bool)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of ids; what was found lately is remembered under a hash of the pair."""
        key = a * len(self.pieces) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        out = self._memo[slot]
        new = np.flatnonzero(self._memo_key[slot] != key)
        if len(new):
            fits = np.ones(len(new), bool)
            at, a, b = np.arange(len(new)), a[new], b[new]
            limit, right = np.full(len(new), np.inf), np.zeros(len(new), bool)
            while len(at):
                union = a * len(self.pieces) + b
                i = np.minimum(np.searchsorted(self._union, union), len(self._union) - 1)
                first = self._union_level[i]
                clash = (self._union[i] == union) & ((first < limit) | (right & (first == limit)))  # of equals the leftmost comes first
                fits[at[clash]] = False
                x, y = self._level[a], self._level[b]
                left = x > y
                on = np.flatnonzero(~clash & (left | (self._len[b] > 1)))
                at, a, b, left, limit = at[on], a[on], b[on], left[on], np.maximum(x, y)[on]
                right = ~left
                a, b = np.where(left, self._right[a], a), np.where(left, b, self._left[b])
            out[new] = fits
            self._memo_key[slot[new]], self._memo[slot[new]] = key[new], fits
        return out

    def _encode_block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, ids of each word, whether it was done here) for words with the sign of the space before them."""
        text = self._gap.join(words) + self._gap
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = self._known_char[chars]
        gap = chars == ord(self._gap)
        ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64))
        size = np.diff(ends, prepend=0)
        strange = np.concatenate([[0], np.cumsum(~(known | gap))])
        done = (strange[ends] == strange[ends - size]) & (size <= 400)
        known &= np.repeat(done, size)
        n = len(chars)
        found = np.fromiter(itertools.chain.from_iterable(self._coded.iter(text)), np.int64).reshape(-1, 2)
        longest = np.full(n, -1, np.int32)
        longest[found[:, 0] - self._len[found[:, 1]] + 1] = found[:, 1]  # longer ends come later for one start
        del found
        edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
        pos, stop = edge[::2], edge[1::2]  # runs of known characters
        chosen, came = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        failed, path = np.zeros(n + 1, bool), np.zeros(n, bool)  # failed: the bitfield of positions that no valid rest begins at
        piece, last = longest[pos], np.full(len(pos), -1, np.int32)
        while len(pos):
            end = pos + self._len[piece]
            ok = (piece >= 0) & ~failed[end]
            ask = np.flatnonzero(ok & (last >= 0))
            ok[ask] = self._compatible(last[ask].astype(np.int64), piece[ask].astype(np.int64))
            none = np.flatnonzero(piece < 0)
            if len(none):  # the piece before is taken back
                failed[pos[none]] = True
                back = came[pos[none]]
                if (back < 0).any():
                    raise ValueError("a text has no encoding")
                path[back] = False
                before = came[back]
                pos[none], piece[none] = back, chosen[back]
                last[none] = np.where(before < 0, -1, chosen[before])
            take = np.flatnonzero(ok)
            at, to = pos[take], end[take]
            chosen[at], path[at] = piece[take], True
            piece[~ok] = self._next_shorter[piece[~ok]]
            over = to == stop[take]
            on, to_on = take[~over], to[~over]
            came[to_on], last[on] = at[~over], piece[on]
            pos[on], piece[on] = to_on, longest[to_on]
            if over.any():
                left = np.ones(len(pos), bool)
                left[take[over]] = False
                pos, stop, piece, last = pos[left], stop[left], piece[left], last[left]
        inside = gap & np.repeat(done, size)
        inside[ends - 1] = False
        chosen[inside], path[inside] = self.byte_ids[ord(self._gap)], True
        upto = np.concatenate([[0], np.cumsum(path)])
        return chosen[path], upto[ends] - upto[ends - size], done

    def encode_units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, begin and number of those of each unit); units with unknown characters or of 400 characters and more are encoded one by one."""
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        tables: list[np.ndarray] = []
        total = i = 0
        rest = range(len(words))
        if self.side_by_side:
            alone: list[np.ndarray] = []
            ends = np.cumsum(np.array([len(w) for w in words], np.int64))
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _BLOCK, "right")))
                table, n, done = self._encode_block(words[i:j])
                count[i:j], begin[i:j] = n, total + np.cumsum(n) - n
                alone.append(np.flatnonzero(~done) + i)
                tables.append(table)
                total += len(table)
                i = j
            rest = np.concatenate(alone).tolist() if alone else []
        for k in rest:
            own = np.array(self.unit(words[k]), np.int32)
            begin[k], count[k] = total, len(own)
            tables.append(own)
            total += len(own)
        return np.concatenate([*tables, np.zeros(0, np.int32)]), begin, count

    def backtrack(self, text: str) -> list[str]:
        """The encoding of a text of known characters without pieces of tied scores."""
        longest: list[str | None] = [None] * len(text)
        for end, piece in self.automaton.iter(text):  # shorter starts come later for one end; longer ends come later for one start
            longest[end - len(piece) + 1] = piece
        if longest[0] is not None and len(longest[0]) == len(text):
            return [text]
        out: list[str] = []
        failed = 0  # the bitfield of positions that no valid rest begins at
        pos, piece, last = 0, longest[0], None
        pairs, shorter, size = self._pairs, self.shorter, len(text)
        if len(pairs) > _MOST_CACHED:
            pairs.clear()
        while True:
            while piece is not None:
                end = pos + len(piece)
                if not failed >> end & 1:
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if fits is None:
                        fits = pairs[last, piece] = self.compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece is None:
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else None
                piece = shorter[piece]
                continue
            out.append(piece)
            if end == size:
                return out
            last, pos, piece = piece, end, longest[end]

    def _known_ids(self, text: str) -> list[int]:
        if SPACE * 2 in text:  # tied scores
            pieces = self.merge(text)
        elif len(text) > 400:  # the bitfield of a very long unit is kept short by cutting where no piece crosses
            pieces = [p for part in self._cut(text) for p in self.backtrack(part)]
        else:
            pieces = self.backtrack(text)
        return [self.ids[p] for p in pieces]

    def _cut(self, text: str) -> list[str]:
        """Parts of a text between which no piece can lie."""
        inside = bytearray(len(text) + 1)
        reach = 0
        starts = [[] for _ in range(len(text))]
        for end, piece in self.automaton.iter(text):
            starts[end - len(piece) + 1].append(end + 1)
        for i, ends in enumerate(starts):
            if i >= reach:
                inside[i] = 1
            reach = max(reach, max(ends, default=i + 1))
        cuts = [i for i in range(len(text)) if inside[i]] + [len(text)]
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]

    def unit(self, text: str) -> list[int] | array:
        """Ids of one unit (spaces already replaced)."""
        found = self._cache.find(text)
        if found is not None:
            return found
        out: list[int] = []
        if "\n" in text and "\n" not in self.known:  # the commonest character without a piece: the parts are worth caching
            for k, part in enumerate(text.split("\n")):
                if k:
                    out += self._unknown("\n")
                if part:
                    out += self.unit(part)
        else:
            for part in self._segments.findall(text):
                out += self._known_ids(part) if part[0] in self.known else self._unknown(part)
        if len(text) <= 64:
            self._cache.keep(text, array("i", out))
        return out

    def _unknown(self, part: str) -> list[int]:
        if min(self.byte_ids) < 0:
            return [self.unknown] * len(part)
        return [self.byte_ids[b] for b in part.encode("utf-8", "replace")]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.splits:
            return list(self.unit(text))
        return [i for u in _UNIT.findall(text) for i in self.unit(u)]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of a string array: each different unit is encoded once. Null for null."""
        if not (self.splits and self.prefix):
            return pa.array([None if t is None else self.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts.fill_null(""), " ")
        flat, off = words.flatten(), np.asarray(words.offsets).astype(np.int64)
        off = off - off[0]
        odd = np.asarray(pc.equal(pc.binary_length(flat), 0)) | np.asarray(pc.match_substring(flat, SPACE))
        before = np.concatenate([[0], np.cumsum(odd)])
        slow = (before[off[1:]] > before[off[:-1]])  # runs of spaces, spaces at an end, the space sign itself: cut one by one
        coded = flat.dictionary_encode()
        need = np.zeros(len(coded.dictionary), bool)
        codes = np.asarray(coded.indices)
        need[codes[~np.repeat(slow, np.diff(off))]] = True
        table, begin, number = self.encode_units([SPACE + w for w in coded.dictionary.filter(pa.array(need)).to_pylist()])
        start, count = np.zeros(len(need), np.int64), np.zeros(len(need), np.int64)
        start[need], count[need] = begin, number
        each = count[codes]
        each[np.repeat(slow, np.diff(off))] = 0
        ends = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(start[codes] - ends[:-1], each) + np.arange(ends[-1])
        out = table[take]
        per_row = ends[off]
        if slow.any():
            parts, at = [], 0
            lens = np.diff(per_row)
            for r in np.flatnonzero(slow):
                parts.append(out[at: per_row[r]])
                at = per_row[r]
                own = np.array(self.encode(texts[int(r)].as_py()) if size[r] else [], np.int32)
                parts.append(own)
                lens[r] = len(own)
            out = np.concatenate([*parts, out[at:]])
            per_row = np.concatenate([[0], np.cumsum(lens)])
        rows = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.array(out))
        return rows if not texts.null_count else pc.if_else(texts.is_valid(), rows, pa.nulls(len(texts), rows.type))

    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """Texts of arrays of ids; bytes that are no UTF-8 become the replacement character. Null for null."""
        flat = ids.flatten()
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        at = np.asarray(flat)
        if len(at) and (at.min() < 0 or at.max() >= len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(self._raw_len[at])])[off]
        data = self._raw.take(flat).buffers()[2] or pa.py_buffer(b"")
        view = memoryview(data)
        out = []
        for valid, i, j in zip(ids.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = bytes(view[i:j]).decode("utf-8", "replace") if valid else None
            out.append(text[1:] if text and self.prefix and text[0] == " " else text)
        return pa.array(out, pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_array(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_LOADED: dict[str, Codec] = {}


def load(path: str = DEFAULT_MODEL) -> Codec:
    """The codec of a model file of this machine."""
    with open(path, "rb") as f:
        return Codec(f.read())


def sent(spark: SparkSession, path: str) -> Callable[[], Codec]:
    """Reads a model file on the driver and sends it to the workers; what is returned gives the codec there, made once for each process."""
    with open(path, "rb") as f:
        data = f.read()
    name, model = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def get() -> Codec:
        if name not in _LOADED:
            _LOADED[name] = Codec(model.value)
        return _LOADED[name]

    return get


def _encoder(codec_of: Callable[[], Codec], column: str, ids: str, exact: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            text = batch.column(batch.schema.names.index(column))
            for i, j in slices(text, 4 << 20):
                part = batch.slice(i, j - i)
                own = part.column(batch.schema.names.index(column))
                coded = codec.encode_array(own)
                keep = [n for n in batch.schema.names if n != column or exact is None]
                cols = [part.column(batch.schema.names.index(n)) for n in keep]
                more = [coded, pc.cast(pc.list_value_length(coded), pa.int32())]
                if exact is not None:
                    more.append(pc.equal(codec.decode_array(coded), own))
                yield pa.RecordBatch.from_arrays([*cols, *more], [*keep, ids, f"n_{ids}", *([exact] if exact is not None else [])])
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, path: str = DEFAULT_MODEL, ids: str = "token_ids", exact: str | None = None) -> DataFrame:
    """``docs`` with the ids of its text and their number (``n_`` before the name); one pass, no shuffle.

    With ``exact`` the text itself is left out and a column of that name says whether decoding gives it back. Columns of
    ``docs`` named like the new ones are replaced.
    """
    new = [ids, f"n_{ids}", *([exact] if exact is not None else [])]
    docs = docs.drop(*new)
    text = next(f.name for f in docs.schema.fields if f.name.lower() == "text")
    # columns go to the workers under plain names, as theirs may have dots
    plain = {f.name: text if f.name == text else f"c{k}" for k, f in enumerate(docs.schema.fields)}
    kept = [f for f in docs.schema.fields if f.name != text or exact is None]
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(f"n_{ids}", T.IntegerType())]
    if exact is not None:
        more.append(T.StructField(exact, T.BooleanType()))
    schema = T.StructType([*(T.StructField(plain[f.name], f.dataType, f.nullable) for f in kept), *more])
    return docs.toDF(*plain.values()).mapInArrow(_encoder(sent(docs.sparkSession, path), text, ids, exact), schema).toDF(*(f.name for f in kept), *new)


def decode(tokens: DataFrame, path: str = DEFAULT_MODEL, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of its ids in a column ``text``, in place of one of that name."""

    codec_of = sent(tokens.sparkSession, path)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return codec_of().decode_array(column)

    return tokens.withColumn(text, texts(F.col(ids)))
