"""Text functions on columns. All run in the JVM but for Unicode decomposition, which is an Arrow UDF over C++ kernels."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.functions.arrays import buffers, slices

#: Blocks of ideographs, each of which is a word of its own.
_IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
_TOKEN = r"[\p{P}\p{S}]|[^\s\p{Z}\p{P}\p{S}]+"
_WORD = r"[^\s\p{Z}\p{P}\p{S}]*[\p{L}\p{N}][^\s\p{Z}\p{P}\p{S}]*"
#: English words that say nothing specific, by kind: what the ranking of specific terms passes over.
STOP_WORDS = tuple((
    "i me my we us our ours you your yours he him his she her hers it its they them their theirs this that these those "
    "is are was were be do does did has have can could should will would no not so too than then there and but or if as "
    "at by for from in into of on to with how what when where which who why a an the").split())


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Tabs and line ends as spaces, other control characters gone, ideographs set apart by spaces."""
    spaced = F.regexp_replace(text, r"[\t\n\r]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"[\p{C}\x{FFFD}]", ""), _IDEOGRAPHS, r" $0 ")


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def bare(column: pa.Array) -> pa.Array:
    """Lower case, decomposed, without marks."""
    out = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(column), form="NFD"), r"\p{Mn}", "")
    odd = pc.fill_null(pc.match_substring(column, "Σ"), False)  # a final sigma needs its neighbours
    if pc.any(odd).as_py():
        out = pa.array([_bare(t.as_py()) if o else x.as_py() for t, o, x in zip(column, odd.to_pylist(), out, strict=True)], pa.string())
    return out


def without_accents(text: Column) -> Column:
    """Lower case, decomposed, without marks."""

    @F.arrow_udf("string")
    def fold(column: pa.Array) -> pa.Array:
        return bare(column)

    return fold(text)


SPACE, MARK, ALONE, WORD, OTHER, GONE = range(6)
_ALONE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
#: In place of a folded character: it goes; it isn't folded by itself.
_DROP, _ODD = 0x110000, 0x110001


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: space, mark of punctuation or symbol, ideograph, letter or number, any other part of a word, or what ``clean`` takes away."""
    by = {"Z": SPACE, "P": MARK, "S": MARK, "L": WORD, "N": WORD, "C": GONE}
    kinds = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for i, j in _ALONE:
        kinds[i: j + 1][kinds[i: j + 1] != GONE] = ALONE
    kinds[[9, 10, 13]], kinds[0xFFFD] = SPACE, GONE
    return kinds


@functools.cache
def _folds() -> np.ndarray:
    """By code point below 0x3000 what ``bare`` makes of it, if that is one character or none wherever it stands."""
    out = np.full(0x3000, _ODD, np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        plain = unicodedata.normalize("NFD", low)
        bases = "".join(x for x in plain if unicodedata.category(x) != "Mn")
        if len(low) == 1 and len(bases) <= 1 and chr(c) != "Σ" and not any(unicodedata.combining(x) for x in bases):
            out[c] = ord(bases) if bases else _DROP
    return out


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of texts, as ``tokens`` has them, one after the other, and their offsets by row. Nulls have none.

    Characters that fold by themselves are looked up in a table. Where a text has others, all in the array go through ``bare``.
    """
    raw, off = buffers(texts.fill_null(""))
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) < len(raw):
        off = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[off]
    keep = _kinds()[points] != GONE
    if not keep.all():
        points, off = points[keep], np.append(0, np.cumsum(keep))[off]
    fold = _folds()[np.minimum(points, 0x2FFF)]
    if len(points) and int(points.max()) >= 0x3000:
        fold = np.where(points < 0x3000, fold, np.where((_kinds()[points] == ALONE) & ((points < 0xF900) | (points >= 0x20000) & (points < 0x2F800)), points, _ODD))
    if len(fold) and int(fold.max()) == _ODD:
        data = points.tobytes().decode("utf-32-le").encode("utf-8")
        at = np.append(0, np.cumsum(_width(points)))[off].astype(np.int32)
        raw, off = buffers(bare(pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))))
        fold = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        off = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[off]
    elif len(fold) and int(fold.max()) == _DROP:
        keep = fold != _DROP
        fold, off = fold[keep], np.append(0, np.cumsum(keep))[off]
    if not len(fold):
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    kind = _kinds()[fold]
    inside = kind != SPACE
    start = inside.copy()
    start[1:] &= (kind[1:] < WORD) | (kind[:-1] < WORD)
    first = off[:-1][off[:-1] < len(fold)]
    start[first] = inside[first]
    at, tokens = np.flatnonzero(start), fold[inside]
    if int(fold.max()) < 0x80:
        data, ends = tokens.astype(np.uint8), np.cumsum(inside)[at] - 1
    else:
        data, ends = tokens.tobytes().decode("utf-32-le").encode("utf-8"), np.cumsum(np.where(inside, _width(fold), 0))[at] - _width(fold[at])
    ends = np.append(ends, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(at, off)


def _width(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def are_words(tokens: pa.Array) -> np.ndarray:
    """Which tokens have a letter or a number."""
    return np.asarray(pc.match_substring_regex(tokens, r"[\pL\pN]"))


def normalize(text: Column) -> Column:
    return without_accents(clean(text))


def pre_tokenize(normal: Column) -> Column:
    """Words of a normalized text, each mark of punctuation or symbol by itself."""
    return F.regexp_extract_all(normal, F.lit(_TOKEN), F.lit(0))


def lexical_terms(normal: Column) -> Column:
    """The words that have a letter or a number, in order."""
    return F.regexp_extract_all(normal, F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Words and marks of a text as it is; none for null."""
    return F.coalesce(pre_tokenize(normalize(text)), F.array().cast("array<string>"))


COUNTED = "dl:int,terms:array<string>,tfs:array<int>"


def count_terms(dictionary: pa.Array, codes: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
    """``dl``, ``terms`` and ``tfs`` (see counted_terms) of ``n`` rows, whose tokens are numbers in a dictionary."""
    word = are_words(dictionary)
    keep = word[codes] if len(codes) else np.zeros(0, bool)
    codes, row = codes[keep], row[keep]
    pair, tf = np.unique(row * max(1, len(word)) + codes, return_counts=True)
    off = pa.array(np.searchsorted(pair // max(1, len(word)), np.arange(n + 1)).astype(np.int32))
    terms = pa.ListArray.from_arrays(off, dictionary.take(pa.array(pair % max(1, len(word)))))
    return [pa.array(np.bincount(row, minlength=n).astype(np.int32)), terms, pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32)))]


def counted_terms(tokens: Column) -> Column:
    """Of an array of tokens: ``dl``, how many are words, and the different ``terms`` with how often each occurs (``tfs``)."""

    @F.arrow_udf(f"struct<{COUNTED}>")
    def count(column: pa.Array) -> pa.Array:
        coded = column.flatten().dictionary_encode()
        lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.StructArray.from_arrays(count_terms(coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(column)), lens), len(column)), ["dl", "terms", "tfs"])

    return count(tokens)


def text_terms(text: Column) -> Column:
    """As ``counted_terms`` of the tokens of a text; a text at a time in slices, and its tokens never leave the worker."""

    @F.arrow_udf(f"struct<{COUNTED}>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for i, j in slices(column):
                found, off = split_tokens(column[i:j])
                coded = found.dictionary_encode()
                yield pa.StructArray.from_arrays(count_terms(coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(j - i), np.diff(off)), j - i), ["dl", "terms", "tfs"])

    return count(text)


def rows_with(df: DataFrame, text: Column) -> DataFrame:
    """term, n: in how many rows of ``df`` each word of ``text`` occurs; summed within slices before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(0), 8 << 20):
                found, off = split_tokens(batch.column(0)[i:j])
                coded = found.dictionary_encode()
                codes, row = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(j - i), np.diff(off))
                often = np.bincount(np.unique(row * max(1, len(coded.dictionary)) + codes) % max(1, len(coded.dictionary)), minlength=len(coded.dictionary))
                word = are_words(coded.dictionary)
                yield pa.RecordBatch.from_arrays([coded.dictionary.filter(pa.array(word)), pa.array(often[word])], ["term", "n"])

    return df.select(text).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def casefold(text: Column) -> Column:
    """Full case folding, which lower case is not: ss for a sharp s."""

    @F.arrow_udf("string")
    def fold(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.casefold() for x in column.to_pylist()], pa.string())

    return fold(text)


def sentences(collapsed: Column) -> Column:
    """A collapsed text cut after . ! ? where a capital, digit, quote or bracket follows."""
    return F.filter(F.split(collapsed, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", -1), lambda s: s != "")


def with_anchor(href: Column, anchor: Column) -> Column:
    return F.when(anchor.isNull() | (anchor == "") | (F.instr(href, "#") > 0), href).otherwise(F.concat(href, F.lit("#"), anchor))


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` in a template replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)
