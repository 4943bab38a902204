"""The binary bundle: a manifest and five content-hashed files; and models to read and write.

Bundles are for exchange: they are single files in the order of the chunks, so the driver writes and reads them; the
workers make their bytes, and the driver holds a piece of them at a time (write_bundle, stored_chunks). The native index is the Parquet tables of :mod:`loomseek.plans.index`.
"""

from __future__ import annotations

import filecmp
import hashlib
import json
import math
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions.folders import filesystem, release, shared_folder

VERSION, DOC_SCALE = "1.0", 127
FILES = ("chunks", "docs", "tokens", "scales", "vocab")
#: The manifest's key for the version, where the caller names no other.
VERSION_KEY = "format_version"
_MANIFEST = {"model_id", "dims", "vocab_size", "n_chunks", "chunk_size", "chunk_overlap", "title_prefix", "chunker_version", "doc_scale", "files"}
_STALE = re.compile(rf"({'|'.join(FILES)})[.]([0-9a-f]{{12}})[.](json|bin)")
_REQUIRED, _OPTIONAL = ("document", "title", "href", "snippet"), ("heading", "anchor")
_CHUNK = "chunk_ix long, document string, title string, href string, snippet string, heading string, anchor string, v array<tinyint>"


class BundleError(ValueError):
    """A bundle or model that breaks a rule of the format."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise BundleError(message)


def safe_name(name: object) -> bool:
    return isinstance(name, str) and bool(name) and not name.startswith("/") and "\\" not in name and ".." not in name.split("/")


def check_manifest(m: object, version_key: str = VERSION_KEY) -> dict:
    """The manifest if it keeps all rules."""
    keys = _MANIFEST | {version_key}
    _need(isinstance(m, dict), "the manifest must be an object")
    _need(set(m) == keys, f"manifest keys differ: {sorted(set(m) ^ keys)}")
    _need(m[version_key] == VERSION, f"unsupported version {m[version_key]!r}")
    whole = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
    for key, least in (("dims", 1), ("vocab_size", 1), ("chunk_size", 1), ("n_chunks", 0), ("chunk_overlap", 0)):
        _need(whole(m[key], least), f"{key} must be an integer of at least {least}")
    _need(whole(m["doc_scale"], DOC_SCALE) and m["doc_scale"] == DOC_SCALE, "doc_scale must be 127")
    _need(isinstance(m["title_prefix"], bool), "title_prefix must be true or false")
    _need(isinstance(m["model_id"], str) and bool(m["model_id"]), "model_id must not be empty")
    _need(isinstance(m["chunker_version"], str), "chunker_version must be text")
    _need(isinstance(m["files"], dict) and set(m["files"]) == set(FILES), "files must name the five files")
    _need(all(safe_name(n) for n in m["files"].values()), "file names must be relative and safe")
    return m


@dataclass(frozen=True)
class Bundle:
    """manifest, chunks (records), docs and tokens (int8 matrices), scales (float32), vocab."""

    manifest: dict
    chunks: list[dict]
    docs: np.ndarray
    tokens: np.ndarray
    scales: np.ndarray
    vocab: list[str]

    def chunk_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *(c.get(k) for k in (*_REQUIRED, *_OPTIONAL)), v.tolist()) for i, (c, v) in enumerate(zip(self.chunks, self.docs, strict=True))]
        return spark.createDataFrame(rows, _CHUNK)

    def model_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, v.tolist(), float(s)) for i, (t, v, s) in enumerate(zip(self.vocab, self.tokens, self.scales, strict=True))]
        return spark.createDataFrame(rows, "token_id int, token string, v array<tinyint>, scale float")


def _check_record(c: object) -> None:
    _need(isinstance(c, dict) and set(_REQUIRED) <= set(c) <= {*_REQUIRED, *_OPTIONAL} and all(isinstance(v, str) for v in c.values()), "a chunk record is wrong")


def from_bytes(manifest: bytes | dict, files: dict[str, bytes], version_key: str = VERSION_KEY) -> Bundle:
    """A bundle from the manifest and the bytes of the files it names."""
    m = check_manifest(json.loads(manifest.decode("utf-8")) if isinstance(manifest, bytes) else manifest, version_key)
    data = {k: files[m["files"][k]] for k in FILES}
    _need(all(isinstance(b, bytes) for b in data.values()), "files must be bytes")
    for key, want in (("docs", m["n_chunks"] * m["dims"]), ("tokens", m["vocab_size"] * m["dims"]), ("scales", 4 * m["vocab_size"])):
        _need(len(data[key]) == want, f"{key} has {len(data[key])} bytes, not {want}")
    scales = np.frombuffer(data["scales"], "<f4")
    _need(bool(np.isfinite(scales).all() and (scales > 0).all()), "scales must be finite and above 0")
    chunks, vocab = json.loads(data["chunks"].decode("utf-8")), json.loads(data["vocab"].decode("utf-8"))
    _need(isinstance(chunks, list) and len(chunks) == m["n_chunks"], "the number of chunks differs")
    for c in chunks:
        _check_record(c)
    _need(isinstance(vocab, list) and all(isinstance(t, str) for t in vocab) and len(vocab) == m["vocab_size"], "the vocabulary is wrong")
    _need(len(set(vocab)) == len(vocab), "a token occurs twice")
    shape = lambda b: np.frombuffer(b, np.int8).reshape(-1, m["dims"])
    return Bundle(m, chunks, shape(data["docs"]), shape(data["tokens"]), scales, vocab)


def fetch_bundle(fetch: Callable[[str], bytes], manifest: str = "manifest.json", version_key: str = VERSION_KEY) -> Bundle:
    """A bundle by any function from a name to bytes: the manifest first, then its files at once. Whatever ``fetch`` raises is raised."""
    raw = fetch(manifest)
    _need(isinstance(raw, bytes), "fetched values must be bytes")
    m = check_manifest(json.loads(raw.decode("utf-8")), version_key)
    names = sorted(set(m["files"].values()))
    with ThreadPoolExecutor(len(names)) as pool:
        return from_bytes(m, dict(zip(names, pool.map(fetch, names), strict=True)), version_key)


def read_bundle(folder: str, version_key: str = VERSION_KEY) -> Bundle:
    """A bundle of a folder, or of a manifest's own path (``.json``)."""
    name = "manifest.json"
    if folder.lower().endswith(".json"):
        folder, name = os.path.split(folder)

    def fetch(file: str) -> bytes:
        with open(os.path.join(folder, file), "rb") as f:
            return f.read()

    return fetch_bundle(fetch, name, version_key)


#: Bytes of a file, and rows of a table, that the driver holds at once.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 8192


def _records(path: str) -> Iterator[dict]:
    """The chunk records of a file, an array of JSON, of which a piece at a time is read."""
    decoder, text, at = json.JSONDecoder(), "", 0
    with open(path, encoding="utf-8") as f:
        more = f.read(PIECE_BYTES)
        text, state = more, "["
        while True:
            while at < len(text) and text[at] in " \t\n\r":
                at += 1
            if at < len(text) and state in "[,":  # what comes before a record, or ends the array
                if text[at] == "]":
                    break
                _need(text[at] == state, "the chunks are no array")
                at, state = at + 1, "{" if state == "," else "first"
            elif at < len(text) and state == "first" and text[at] == "]":
                break
            elif at < len(text):
                try:
                    record, at = decoder.raw_decode(text, at)
                except ValueError:
                    more = f.read(PIECE_BYTES)
                    _need(bool(more), "the chunks are no array")
                    text, at = text[at:] + more, 0
                    continue
                _check_record(record)
                yield record
                state = ","
            else:
                more = f.read(PIECE_BYTES)
                _need(bool(more), "the chunks are no array")
                text, at = more, 0
        _need(not (text[at + 1:] + f.read(PIECE_BYTES)).strip(), "the chunks are no array")


def stored_chunks(spark: SparkSession, folder: str, version_key: str = VERSION_KEY) -> DataFrame:
    """As ``read_bundle(folder).chunk_table(spark)`` for a bundle of any size: passed on to the shared folder piece by piece."""
    with open(os.path.join(folder, "manifest.json"), "rb") as f:
        m = check_manifest(json.loads(f.read().decode("utf-8")), version_key)
    docs, dims, n = os.path.join(folder, m["files"]["docs"]), m["dims"], m["n_chunks"]
    _need(os.path.getsize(docs) == n * dims, f"docs has {os.path.getsize(docs)} bytes, not {n * dims}")
    uri, texts = shared_folder(spark, "bundle"), (*_REQUIRED, *_OPTIONAL)
    fs, path = filesystem(uri)
    fs.create_dir(path)
    kind = pa.schema([("chunk_ix", pa.int64()), *((c, pa.string()) for c in texts), ("v", pa.list_(pa.int8()))])
    done, part = 0, []

    def piece() -> pa.Table:
        raw = np.frombuffer(vectors.read(len(part) * dims), np.int8)
        v = pa.ListArray.from_arrays(pa.array((np.arange(len(part) + 1) * dims).astype(np.int32)), pa.array(raw))
        return pa.Table.from_arrays([pa.array(np.arange(done, done + len(part))), *(pa.array([r.get(c) for r in part], pa.string()) for c in texts), v], schema=kind)

    with open(docs, "rb") as vectors, pq.ParquetWriter(f"{path}/chunks.parquet", kind, filesystem=fs, compression="zstd") as out:
        for record in _records(os.path.join(folder, m["files"]["chunks"])):
            _need(done + len(part) < n, "the number of chunks differs")
            part.append(record)
            if len(part) == PIECE_ROWS:
                out.write_table(piece())
                done, part = done + len(part), []
        _need(done + len(part) == n, "the number of chunks differs")
        out.write_table(piece())
    return spark.read.schema(_CHUNK).parquet(uri)


def _hashed(folder: str, stem: str, ext: str, data: bytes | Iterable[bytes]) -> str:
    """Written under the name that its content gives."""
    digest, new = hashlib.sha256(), os.path.join(folder, f"{stem}.{ext}.tmp")
    try:
        with open(new, "wb") as f:
            for piece in [data] if isinstance(data, bytes) else data:
                digest.update(piece)
                f.write(piece)
        name = f"{stem}.{digest.hexdigest()[:12]}.{ext}"
        path = os.path.join(folder, name)
        if os.path.exists(path):
            _need(filecmp.cmp(new, path, shallow=False), f"{name} exists with other content")
        else:
            os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)
    return name


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as the bytes they are in the files: records with commas between them, and vectors."""
    for batch in batches:
        for i in range(0, len(batch), PIECE_ROWS):
            part = batch.slice(i, PIECE_ROWS)
            columns = [part.column(c).to_pylist() for c in range(len(_REQUIRED) + len(_OPTIONAL))]
            records = [{k: v for k, v in zip((*_REQUIRED, *_OPTIONAL), row, strict=True) if k in _REQUIRED or v is not None} for row in zip(*columns, strict=True)]
            data = np.asarray(part.column(len(columns)).flatten()).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([len(records)], pa.int64()), pa.array([_json(records)[1:-1]], pa.binary()), pa.array([data], pa.binary())], ["n", "records", "docs"])


def _pieces(uri: str, column: str) -> Iterator[object]:
    """A column of a table of _packed in the table's order, which is that of its files."""
    fs, path = filesystem(uri)
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda x: x.base_name):
        if info.base_name.endswith(".parquet"):
            for batch in pq.ParquetFile(info.path, filesystem=fs).iter_batches(4, columns=[column]):
                yield from batch.column(0).to_pylist()


def _array(pieces: Iterable[bytes]) -> Iterator[bytes]:
    yield b"["
    for i, piece in enumerate(pieces):
        yield b"," + piece if i else piece
    yield b"]"


def _json(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8")


def _commit(folder: str, name: str, value: dict) -> None:
    path = os.path.join(folder, name)
    with open(path + ".tmp", "wb") as f:
        f.write(_json(value))
    os.replace(path + ".tmp", path)


def write_bundle(folder: str, chunks: DataFrame, model: DataFrame, *, model_id: str, chunk_size: int = 600, chunk_overlap: int = 120, title_prefix: bool = True,
                 chunker_version: str = "1", quarantine: bool = False, version_key: str = VERSION_KEY) -> dict:
    """Write chunks (display columns, doc_ord, chunk_ord, ``v`` as unit vectors) and model (token_id, token, ``v`` as floats); the manifest.

    A chunk whose vector is null, not finite or not of length 1 is an error, or is left out with ``quarantine``.
    """
    from loomseek.functions import vectors as fv

    _need(isinstance(model_id, str) and bool(model_id), "model_id must not be empty")
    os.makedirs(folder, exist_ok=True)
    tokens = model.withColumn("scale", fv.row_scale(F.col("v"))).select("token_id", "token", fv.quantize(F.col("v"), F.col("scale")).alias("v"), "scale").orderBy("token_id").toArrow().combine_chunks()
    sizes = [] if not len(tokens) else tokens["v"].combine_chunks().value_lengths().fill_null(-1).to_pylist()
    _need(bool(sizes) and sizes[0] > 0, "a model needs a token and a dimension")
    dims = sizes[0]
    _need(all(x == dims for x in sizes) and tokens["token_id"].to_pylist() == list(range(len(tokens))), "token ids must run from 0 and vectors have one length")
    off = ~F.coalesce((F.size("v") == dims) & (F.abs(fv.l2_norm(F.col("v")) - 1) <= 2e-4), F.lit(False))
    if not quarantine:
        bad = chunks.where(off).select("document", "chunk_ord").head(5)
        _need(not bad, f"chunks without a unit vector: {[(b.document, b.chunk_ord) for b in bad]}")
    spark = chunks.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    fields = chunks.where(~off).select("doc_ord", "chunk_ord", *_REQUIRED, *_OPTIONAL, fv.to_int8(F.col("v")).alias("v"))
    rows = fields.repartitionByRange(parts, "doc_ord", "chunk_ord").sortWithinPartitions("doc_ord", "chunk_ord").drop("doc_ord", "chunk_ord")
    packed = shared_folder(spark, "packed")
    rows.mapInArrow(_packed, "n long, records binary, docs binary").write.option("compression", "zstd").parquet(packed)
    release(spark)
    n_chunks = sum(_pieces(packed, "n"))
    files = {
        "chunks": _hashed(folder, "chunks", "json", _array(_pieces(packed, "records"))), "docs": _hashed(folder, "docs", "bin", _pieces(packed, "docs")),
        "tokens": _hashed(folder, "tokens", "bin", np.asarray(tokens["v"].combine_chunks().flatten()).astype(np.int8).tobytes()),
        "scales": _hashed(folder, "scales", "bin", tokens["scale"].to_numpy().astype("<f4").tobytes()), "vocab": _hashed(folder, "vocab", "json", _json(tokens["token"].to_pylist())),
    }
    fs, path = filesystem(packed)
    fs.delete_dir(path)
    manifest = {version_key: VERSION, "model_id": model_id, "dims": dims, "vocab_size": len(tokens), "n_chunks": n_chunks, "chunk_size": chunk_size, "chunk_overlap": chunk_overlap,
                "title_prefix": title_prefix, "chunker_version": chunker_version, "doc_scale": DOC_SCALE, "files": files}
    _commit(folder, "manifest.json", check_manifest(manifest, version_key))
    for name in os.listdir(folder):
        if _STALE.fullmatch(name) and name not in files.values():
            os.remove(os.path.join(folder, name))
    return manifest


def write_model(folder: str, model: DataFrame, model_id: str, dims: int | None = None) -> dict:
    """Portable model: model.json, vocabulary, int8 vectors cut to ``dims`` components, and scales."""
    from loomseek.functions import vectors as fv

    if dims is not None:
        model = model.withColumn("v", F.slice("v", 1, dims))
    rows = model.withColumn("scale", fv.row_scale(F.col("v"))).select("token_id", "token", fv.quantize(F.col("v"), F.col("scale")).alias("v"), "scale").orderBy("token_id").collect()
    _need(bool(rows) and (dims is None or len(rows[0].v) == dims), "dims exceeds the model's")
    os.makedirs(folder, exist_ok=True)
    info = {"model_id": model_id, "dims": len(rows[0].v), "vocab": _hashed(folder, "vocab", "json", _json([r.token for r in rows])),
            "tokens": _hashed(folder, "tokens", "bin", b"".join(np.array(r.v, np.int8).tobytes() for r in rows)), "scales": _hashed(folder, "scales", "bin", np.array([r.scale for r in rows], "<f4").tobytes())}
    _commit(folder, "model.json", info)
    return info


def read_model(spark: SparkSession, folder: str) -> DataFrame:
    """token_id, token, v (int8), scale of a portable model."""
    load = lambda n: open(os.path.join(folder, n), "rb").read()  # noqa: E731, SIM115
    info = json.loads(load("model.json"))
    _need(isinstance(info, dict) and {"model_id", "dims", "vocab", "tokens", "scales"} <= set(info) and all(safe_name(info[k]) for k in ("vocab", "tokens", "scales")), "model.json is wrong")
    vocab, scales = json.loads(load(info["vocab"])), np.frombuffer(load(info["scales"]), "<f4")
    tokens = np.frombuffer(load(info["tokens"]), np.int8)
    whole = isinstance(info["dims"], int) and not isinstance(info["dims"], bool) and info["dims"] > 0
    _need(whole and isinstance(info["model_id"], str) and bool(info["model_id"]), "model.json is wrong")
    _need(isinstance(vocab, list) and bool(vocab) and all(isinstance(t, str) for t in vocab) and len(set(vocab)) == len(vocab), "the vocabulary is wrong")
    _need(bool(np.isfinite(scales).all() and (scales > 0).all()), "scales must be finite and above 0")
    _need(len(tokens) == len(vocab) * info["dims"] and len(scales) == len(vocab), "lengths of the model's files differ")
    rows = [(i, t, v.tolist(), float(s)) for i, (t, v, s) in enumerate(zip(vocab, tokens.reshape(len(vocab), -1), scales, strict=True))]
    return spark.createDataFrame(rows, "token_id int, token string, v array<tinyint>, scale float")


def tokenizer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token of a tokenizer.json; ids must run from 0 without a gap."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    _need(isinstance(vocab, dict) and all(isinstance(t, str) and t for t in vocab) and sorted(vocab.values()) == list(range(len(vocab))), "token ids must run from 0 without a gap")
    return spark.createDataFrame(sorted((i, t) for t, i in vocab.items()), "token_id int, token string")


def safetensors_embeddings(data: bytes) -> np.ndarray:
    """The 2-D tensor ``embeddings`` (F16, F32 or I8) as float32."""
    _need(len(data) >= 8, "too short")
    (size,) = struct.unpack_from("<Q", data)
    _need(8 + size <= len(data), "the header is longer than the file")
    header = json.loads(data[8: 8 + size].decode("utf-8"))
    info = header.get("embeddings")
    _need(isinstance(info, dict) and info.get("dtype") in ("F16", "F32", "I8"), "no tensor named embeddings of a known type")
    shape, (start, end) = info["shape"], info["data_offsets"]
    kind = {"F16": "<f2", "F32": "<f4", "I8": "i1"}[info["dtype"]]
    _need(len(shape) == 2 and all(isinstance(n, int) and n > 0 for n in shape), "the tensor must have two dimensions")
    _need(0 <= start <= end <= len(data) - 8 - size and end - start == math.prod(shape) * np.dtype(kind).itemsize, "offsets are out of bounds")
    out = np.frombuffer(data[8 + size + start: 8 + size + end], kind).astype(np.float32).reshape(shape)
    _need(bool(np.isfinite(out).all()), "values must be finite")
    return out


def safetensors_model(spark: SparkSession, folder: str) -> DataFrame:
    """token_id, token, v (floats) of a folder with model.safetensors and tokenizer.json."""
    with open(os.path.join(folder, "model.safetensors"), "rb") as f:
        matrix = safetensors_embeddings(f.read())
    vocab = tokenizer_vocabulary(spark, os.path.join(folder, "tokenizer.json"))
    _need(vocab.count() == len(matrix), "there must be one row for each token")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "token_id int, v array<float>")
    return vocab.join(rows, "token_id")
