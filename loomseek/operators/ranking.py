"""Lexical, semantic and specific-term ranking of sets of queries, and their fusion.

A ranking has query_id, document, chunk_ord and score, one row for each query and document. Scores are rounded before
they are compared (see SearchOptions), so that equal ones are equal on any machine; ties go to the lesser document.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.functions.arrays import slices
from loomseek.functions.folders import shared_folder, small, written
from loomseek.functions import text as ft
from loomseek.functions import vectors as fv
from loomseek.options import RRF_K, HybridOptions, SearchOptions

K1, B = 1.2, 0.75


def rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """document, chunk_ord, dl (words of title, heading and snippet), the different terms and how often each occurs (tfs); counted within the row."""
    counted = ft.text_terms(F.concat_ws(" ", "title", "heading", "snippet"))
    return chunks.select("document", "chunk_ord", counted.alias("t")).select("document", "chunk_ord", "t.dl", "t.terms", "t.tfs")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct words of each query."""
    return queries.select("query_id", F.explode(ft.text_terms(F.col("query"))["terms"]).alias("term"))


def postings(terms: DataFrame) -> DataFrame:
    """document, chunk_ord, dl, term, tf; no shuffle."""
    return terms.select("document", "chunk_ord", "dl", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})


def document_frequency(posts: DataFrame) -> DataFrame:
    """term, df: the number of chunks that have the term."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: n chunks, avgdl (1 at least; chunks without terms count)."""
    return terms.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(0.0))).alias("avgdl"))


def rollup(scores: DataFrame) -> DataFrame:
    """The best chunk of each document; of equal ones the first."""
    best = F.max_by("chunk_ord", F.struct("score", -F.col("chunk_ord")))
    return scores.groupBy("query_id", "document").agg(best.alias("chunk_ord"), F.max("score").alias("score"))


def ranked(ranking: DataFrame, name: str = "rank") -> DataFrame:
    """Ranks from 1 by score, then document: a window for each query, which Spark limits within partitions where only the first ranks are asked for."""
    return ranking.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document")))


def top(ranking: DataFrame, limit: int) -> DataFrame:
    """The first rows of each query; Spark limits them within partitions before the shuffle."""
    return ranked(ranking).where(F.col("rank") <= limit)


def _place(column: int):
    """Over rows sorted by query: the partition's number and each row's place in its query's run there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, seen, me = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            coded = batch.column(column).dictionary_encode()
            codes = np.asarray(coded.indices)
            start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes)))) + 1
            if len(codes):
                first = coded.dictionary[int(codes[0])].as_py()
                if first == now:
                    place[: start[1] if len(start) > 1 else len(place)] += seen
                now, seen = coded.dictionary[int(codes[-1])].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), me)), pa.array(place)], [*batch.schema.names, "part_", "place_"])

    return run


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` numbered from 1 within each query_id by ``order``, which must settle all ties.

    Rows are sorted by ranges over all tasks, so that one query's ranking may be of any length: a row's number is
    its place in its range plus the lengths of the query's ranges before. The sorted rows are written, as the two passes must see the same.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    by = [F.col("query_id"), *order]
    schema = T.StructType([*rows.schema.fields, T.StructField("part_", T.LongType()), T.StructField("place_", T.LongType())])
    placed = written(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_place(rows.columns.index("query_id")), schema), shared_folder(spark, "ranks"))
    sizes = placed.groupBy("query_id", "part_").agg(F.max("place_").alias("n_"))  # as many as there are ranges and queries, at most
    before = sizes.select("query_id", "part_", F.coalesce(F.sum("n_").over(Window.partitionBy("query_id").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return placed.join(before, ["query_id", "part_"]).withColumn(name, F.col("place_") + F.col("before_")).select(*rows.columns, name)


def all_ranked(ranking: DataFrame, name: str = "rank") -> DataFrame:
    """As ``ranked``, for rankings of any length."""
    return numbered(ranking.select("query_id", "document", "chunk_ord", "score"), [F.desc("score"), F.col("document")], name)


def oov_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, term: query words of two or more characters that, case folded, are neither a whole word of the vocabulary (term) nor a stop word."""
    known = vocabulary.where(~F.col("term").startswith("##")).select(ft.casefold(F.col("term")).alias("folded"))
    asked = query_terms(queries).where(F.length("term") > 1).withColumn("folded", ft.casefold(F.col("term")))
    return asked.where(~F.col("folded").isin(*ft.STOP_WORDS)).join(known, "folded", "left_anti").select("query_id", "term")


def _matches(words: pa.Array, weights: list[int]):
    """Over document, chunk_ord and fields: document, chunk_ord, term and weight of each field and word of ``words`` that is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(words) else ():
            for i, j in slices(batch.column(batch.num_columns - 1)):
                for c, w in enumerate(weights, 2):
                    found, off = ft.split_tokens(batch.column(c)[i:j])
                    which = pc.index_in(found, words)
                    hit = np.flatnonzero(np.asarray(which.is_valid()))
                    pair = np.unique(np.repeat(np.arange(j - i), np.diff(off))[hit] * len(words) + np.asarray(which.take(pa.array(hit))))
                    if len(pair):
                        at = pa.array(pair // len(words) + i)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.take(pa.array(pair % len(words))), pa.array(np.full(len(pair), w, np.int32))], ["document", "chunk_ord", "term", "w"])

    return run


def specific_rank(chunks: DataFrame, queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Exact matches of words outside the vocabulary: 4 in the title, 2 in the heading, 1 in the snippet. Only words that queries have leave the chunks."""
    asked = written(oov_terms(queries, vocabulary), shared_folder(queries.sparkSession, "specific"))
    words = asked.select("term").distinct().toArrow()["term"].combine_chunks()
    fields = chunks.select("document", "chunk_ord", "title", "heading", "snippet")
    hits = fields.mapInArrow(_matches(pa.array(words.to_pylist(), pa.string()), [4, 2, 1]), "document string, chunk_ord int, term string, w int")
    scores = hits.join(asked, "term").groupBy("query_id", "document", "chunk_ord").agg(F.sum("w").cast("double").alias("score"))
    return rollup(scores).where("score > 0")


def mean_pool(ids: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: the mean of the vectors (``v``, by ``token_id``) of an array ``ids``, as a unit vector; rows without ids have none.

    One entry for each distinct id and row is joined with the model, which Spark broadcasts while its size allows; the sums are by component.
    """
    entries = ids.select(*keys, F.explode("ids").alias("token_id")).groupBy(*keys, "token_id").agg(F.count(F.lit(1)).alias("tf"))
    hit = entries.join(model.select("token_id", "v"), "token_id")
    dims = hit.select(*keys, "tf", F.posexplode("v").alias("dim", "x"))
    sums = dims.groupBy(*keys, "dim").agg(F.sum(F.col("x").cast("double") * F.col("tf")).alias("x"), F.sum("tf").alias("n"))
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("x") / F.col("n")).alias("x")))).alias("p"))
    return rows.select(*keys, fv.unit(F.col("p.x")).alias("v"))


def run_sums(table: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """By owner (ascending, below ``n``) the sum of the rows of ``table`` at ``at``; so many of them at once as bounds the memory."""
    out, most = np.zeros((n, table.shape[1])), max(1, (8 << 20) // (8 * table.shape[1]))
    for i in range(0, len(at), most):
        own = owner[i: i + most]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[start]] += np.add.reduceat(table[at[i: i + most]], start, axis=0, dtype=np.float64)
    return out


def pooled(table: np.ndarray, flat: np.ndarray, n: np.ndarray, codes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the vectors of each row's pieces as unit vectors, and how many pieces each row has. Each different word is summed up once.

    ``flat`` and ``n``: what each word is cut into; ``codes`` and ``row``: the words of the rows, in the rows' order.
    """
    words = run_sums(table, flat, np.repeat(np.arange(len(n)), n), len(n))
    known = n[codes] > 0 if len(codes) else np.zeros(0, bool)
    codes, row = codes[known], row[known]
    sums, count = run_sums(words, codes, row, rows), np.bincount(row, n[codes], rows)
    sums[count > 0] /= count[count > 0, None]
    norm = np.sqrt((sums**2).sum(1))
    sums[norm > 0] /= norm[norm > 0, None]
    return sums, count


def as_lists(matrix: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list for each row of a matrix, null where not ``there``."""
    flat = pa.ListArray.from_arrays(pa.array((np.arange(len(matrix) + 1) * matrix.shape[1]).astype(np.int32)), pa.array(matrix.ravel()))
    return flat if there.all() else pc.if_else(pa.array(there), flat, pa.nulls(len(matrix), flat.type))


@dataclass(frozen=True)
class Scan:
    """A ranking that is made by going over ``rows`` (document, chunk_ord and what scores are made from) once for all queries.

    ``prepare`` takes a batch and gives a function from a range of queries to a matrix of scores (rows by queries), -inf where there is none.
    """

    rows: DataFrame | None
    query_ids: list
    kind: str
    prepare: Callable[[pa.RecordBatch], Callable[[slice], np.ndarray]]
    min_score: float = -np.inf

    @property
    def schema(self) -> str:
        return f"query_id {self.kind}, document string, chunk_ord int, score double"

    def over(self, rows: DataFrame) -> Scan:
        return replace(self, rows=rows.select(*self.rows.columns))

    def partial(self, limit: int | None = None) -> DataFrame:
        """Rows of documents as far as they lie together in a task, so a document may have several (see rollup). With ``limit`` only what can be among a query's first."""
        return self.rows.mapInArrow(_emitted(replace(self, rows=None), limit), self.schema)

    def all(self) -> DataFrame:
        """One row for each query and document. Only documents that are cut, by tasks or in the table, are shuffled."""
        split = cut_documents(self.rows)
        if split is None:
            return rollup(self.partial())
        return self.over(self.rows.join(F.broadcast(split), "document", "left_anti")).partial().unionAll(rollup(self.over(self.rows.join(F.broadcast(split), "document", "left_semi")).partial()).select("query_id", "document", "chunk_ord", "score"))

    def top(self, limit: int) -> DataFrame:
        """The first ``limit`` documents of each query, and what has the score of the last of them."""
        return rollup(self.partial(limit))


def cut_documents(rows: DataFrame, most: int = 100_000) -> DataFrame | None:
    """document: those whose rows don't lie together in one task; None if there are more than ``most``."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = np.asarray(coded.indices)
            if len(codes):
                first = np.append(coded.dictionary[int(codes[0])].as_py() != last, codes[1:] != codes[:-1])
                last = coded.dictionary[int(codes[-1])].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(first))], ["document"])

    found = rows.select("document").mapInArrow(starts, "document string").groupBy("document").count().where("count > 1").select("document").limit(most + 1).toArrow()
    return None if len(found) > most else rows.sparkSession.createDataFrame(found, "document string")


#: Rows that are scored at once, and queries.
RUN_ROWS, RUN_QUERIES = 1024, 512


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about RUN_ROWS that cut no document whose rows lie together."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if len(batch) else held
        codes = np.asarray(batch.column(0).dictionary_encode().indices)
        edges, i = np.flatnonzero(codes[1:] != codes[:-1]) + 1, 0
        while len(edges) and i < edges[-1]:
            k = np.searchsorted(edges, i + RUN_ROWS, "right")
            j = int(edges[k - 1]) if k and edges[k - 1] > i else int(edges[k])
            yield batch.slice(i, j - i)
            i = j
        held = batch.slice(i) if i < len(batch) else None
    if held is not None:
        yield held


def _bests(scan: Scan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Batch, first query, and matrices by document and query: the batch's row of the best chunk (of equal ones the first) and its score."""
    for part in _runs(batches):
        score = scan.prepare(part)
        document = np.asarray(part.column(0).dictionary_encode().indices)
        order = np.lexsort((np.asarray(part.column(1)), document))
        start = np.flatnonzero(np.append(True, document[order][1:] != document[order][:-1]))
        step = max(1, min(RUN_QUERIES, RUN_ROWS * RUN_QUERIES // len(part)))
        for q in range(0, len(scan.query_ids), step):
            sims = score(slice(q, min(q + step, len(scan.query_ids))))[order]
            high = np.maximum.reduceat(sims, start)
            at = np.where(sims == np.repeat(high, np.diff(np.append(start, len(order))), 0), np.arange(len(order))[:, None], len(order))
            yield part, q, order[np.minimum.reduceat(at, start)], np.where(high >= scan.min_score, high, -np.inf)


def _emitted(scan: Scan, limit: int | None):
    ids = pa.array(scan.query_ids)
    names = ["query_id", "document", "chunk_ord", "score"]

    def shown(t: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x in t.to_batches(65536) if isinstance(t, pa.Table) else [t]:
            yield pa.RecordBatch.from_arrays([ids.take(x.column(0)), *x.columns[1:]], names)

    def pruned(found: list, least: np.ndarray) -> pa.Table:
        """What is left of ``found``; ``least`` becomes the score of each query's limit-th document so far."""
        t = pa.Table.from_batches(found)
        once = t.group_by(["query_id", "document"]).aggregate([("score", "max")])
        k, score = once["query_id"].to_numpy(), once["score_max"].to_numpy()
        order = np.lexsort((-score, k))
        start = np.searchsorted(k[order], np.arange(len(least)))
        full = np.flatnonzero(np.diff(np.append(start, len(k))) >= limit)
        least[full] = score[order[start[full] + limit - 1]]
        return t.filter(pa.array(t["score"].to_numpy() >= least[t["query_id"].to_numpy()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, found, n, most = np.full(len(ids), -np.inf), [], 0, 200_000
        for part, q, row, high in _bests(scan, batches) if len(ids) and limit != 0 else ():
            keep = high > -np.inf
            if limit is not None:
                keep &= high >= least[q: q + high.shape[1]]
                if limit < len(high):
                    keep &= high >= -np.partition(-high, limit - 1, 0)[limit - 1]
            d, k = np.nonzero(keep)
            at = pa.array(row[d, k])
            out = pa.RecordBatch.from_arrays([pa.array(k + q), part.column(0).take(at), part.column(1).take(at), pa.array(high[d, k])], names)
            if limit is None:
                yield from shown(out)
            elif len(out):
                found.append(out)
                if (n := n + len(out)) > most:
                    found = pruned(found, least).to_batches()
                    n = sum(map(len, found))
                    most = max(200_000, 2 * n)
        if found:
            yield from shown(pruned(found, least))

    return run


def cosine(vectors: DataFrame, query_ids: list, query_matrix: np.ndarray, digits: int | None = 9, min_score: float | None = None, kind: str = "long") -> Scan:
    """By cosine of chunk vectors (``v``, int8 or float): one matrix product for each batch. Vectors that are null or of another length are an error."""
    norms, dims = np.sqrt((query_matrix**2).sum(1)), query_matrix.shape[1]

    def prepare(part: pa.RecordBatch) -> Callable[[slice], np.ndarray]:
        v = part.column(2)
        if v.null_count or (len(v) and (np.asarray(v.value_lengths()) != dims).any()):
            raise ValueError(f"vectors must have {dims} components")
        x = np.asarray(v.flatten()).astype(np.float64).reshape(len(part), -1)
        own = np.sqrt((x**2).sum(1))[:, None]

        def score(q: slice) -> np.ndarray:
            scale = own * norms[None, q]
            sims = np.divide(x @ query_matrix[q].T, scale, out=np.zeros(scale.shape), where=scale > 0)
            return sims if digits is None else np.round(sims, digits)

        return score

    return Scan(vectors.select("document", "chunk_ord", "v"), query_ids, kind, prepare, -np.inf if min_score is None else min_score)


def cosine_scan(vectors: DataFrame, query_ids: list, query_matrix: np.ndarray, digits: int | None = 9, min_score: float | None = None, limit: int | None = None, kind: str = "long") -> DataFrame:
    """query_id, document, chunk_ord, score: for every query the best chunk vector of each document (see cosine), of equal ones the first.

    With ``limit`` at least the ``limit`` best documents of each query, with ``min_score`` those that reach it. A document whose
    chunks don't lie together has several rows (see rollup).
    """
    return cosine(vectors, query_ids, query_matrix, digits, min_score, kind).partial(limit)


def keyword(terms: DataFrame, queries: DataFrame, digits: int | None = 9) -> Scan:
    """By BM25. The queries' words and their statistics go to the workers; no postings are shuffled.

    ``terms`` (see chunk_terms) are read here for the statistics and again in each pass, so they should be a written table.
    """
    asked = query_terms(queries).toArrow()
    coded, own = asked["term"].combine_chunks().dictionary_encode(), asked["query_id"].combine_chunks().dictionary_encode()
    words, ids, word, query = coded.dictionary, own.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), np.asarray(own.indices).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At -1 the chunks, at -2 their words, at k the chunks that have the k-th of the queries' words."""
        df, n, dl = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.asarray(pc.index_in(batch.column(1).flatten(), words).drop_null()), minlength=len(words))
            n, dl = n + len(batch), dl + int(np.asarray(batch.column(0)).sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n, dl], df[some]]))], ["k", "n"])

    got = {r.k: r.n for r in terms.select("dl", "terms").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    n, df = got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(words))], np.float64)
    avgdl = max(1.0, got.get(-2, 0) / max(1, n))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    order = np.lexsort((query, word))
    word, query = word[order], query[order]

    def prepare(part: pa.RecordBatch) -> Callable[[slice], np.ndarray]:
        _, _, dl, terms, tfs = part.columns
        which = pc.index_in(terms.flatten(), words)
        hit = np.flatnonzero(np.asarray(which.is_valid()))
        w, row = np.asarray(which.take(pa.array(hit))).astype(np.int64), np.repeat(np.arange(len(part)), np.asarray(terms.value_lengths()))[hit]
        by = np.lexsort((w, row))  # parts are added up in one order, wherever the chunk lies
        hit, w, row = hit[by], w[by], row[by]
        tf = np.asarray(tfs.flatten())[hit].astype(np.float64)
        gain = idf[w] * ((tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * np.asarray(dl)[row] / avgdl)))

        def score(q: slice) -> np.ndarray:
            within = (query >= q.start) & (query < q.stop)
            off, to = np.searchsorted(word[within], np.arange(len(words) + 1)), query[within] - q.start
            each = off[w + 1] - off[w]
            at = np.repeat(np.arange(len(w)), each)
            which = to[np.repeat(off[w] - (np.cumsum(each) - each), each) + np.arange(len(at))]
            wide = q.stop - q.start
            sums = np.bincount(row[at] * wide + which, gain[at], len(part) * wide).astype(np.float64).reshape(len(part), wide)
            if digits is not None:
                sums = np.round(sums, digits)
            sums[sums <= 0] = -np.inf
            return sums

        return score

    return Scan(terms.select("document", "chunk_ord", "dl", "terms", "tfs"), ids, queries.schema["query_id"].dataType.simpleString(), prepare)


def keyword_rank(terms: DataFrame, queries: DataFrame, digits: int | None = 9) -> DataFrame:
    """By BM25 all documents that share a word with the query."""
    return keyword(terms, queries, digits).all()


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both rankings one after the other, a document only where it comes first: columns and rank."""
    both = all_ranked(first).withColumn("priority", F.lit(0)).unionByName(all_ranked(second).withColumn("priority", F.lit(1)))
    once = both.groupBy("query_id", "document").agg(F.min(F.struct("priority", "rank", "chunk_ord", "score")).alias("s")).select("query_id", "document", "s.*")
    return numbered(once.withColumnRenamed("rank", "own"), [F.col("priority"), F.col("own")]).select("query_id", "document", "chunk_ord", "score", "rank")


def merged_top(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of ``merge``: the second ranking's first 2 * limit are enough, as the first can take away ``limit`` of them at most."""
    both = top(first, limit).withColumn("priority", F.lit(0)).unionByName(top(second, 2 * limit).withColumn("priority", F.lit(1)))
    once = both.groupBy("query_id", "document").agg(F.min(F.struct("priority", "rank", "chunk_ord", "score")).alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("s.priority", "s.rank"))
    return once.select("query_id", "document", "s.chunk_ord", "s.score", place.alias("rank")).where(F.col("rank") <= limit)


def _check_rrf(rankings: list, k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer of at least 1")
    if any(isinstance(w, bool) or not np.isfinite(w) or w < 0 for _, w in rankings):
        raise ValueError("weights must be finite and not negative")


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K, digits: int | None = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion: query_id, document, chunk_ord (from the first ranking that has the document), score. Weight 0 skips a ranking."""
    _check_rrf(rankings, k)
    parts = [all_ranked(r).select("query_id", "document", "chunk_ord", F.lit(i).alias("priority"), (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part"), F.lit(w > 0).alias("counts"))
             for i, (r, w) in enumerate(rankings)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "document").agg(F.min_by("chunk_ord", "priority").alias("chunk_ord"), rounded(F.sum("part"), digits).alias("score"), F.bool_or("counts").alias("counts"))
    return fused.where("counts").drop("counts")


class _Ahead:
    """Of each query's candidates, sorted by score and document, how many documents are ahead."""

    def __init__(self, candidates: dict[int, list[tuple[float, str]]]) -> None:
        self.scores = {k: np.array([x for x, _ in c]) for k, c in candidates.items()}  # negative, so that they ascend
        self.documents = {k: [d for _, d in c] for k, c in candidates.items()}
        self.seen = {k: np.zeros(len(c) + 1, np.int64) for k, c in candidates.items()}

    def add(self, k: int, documents: pa.Array, scores: np.ndarray) -> None:
        if k not in self.scores:
            return
        own = self.scores[k]
        place, end = np.searchsorted(own, -scores), np.searchsorted(own, -scores, "right")
        tied = np.flatnonzero(place < end)
        for i, d in zip(tied, documents.take(pa.array(tied)).to_pylist(), strict=True):
            place[i] = bisect.bisect_right(self.documents[k], d, place[i], end[i])
        self.seen[k] += np.bincount(place, minlength=len(own) + 1)

    def batch(self) -> pa.RecordBatch:
        some = [(k, i, int(n)) for k, seen in self.seen.items() for i, n in enumerate(seen) if n]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in some], pa.int64()) for j in range(3)], ["k", "place", "n"])


class Ranking:
    """A ranking of which the first documents, and the ranks of any candidates, can be had without all of it being sorted. Of a scan, or of a table with query_id, document, chunk_ord and score."""

    def __init__(self, of: Scan | DataFrame, weight: float) -> None:
        self.of, self.weight = of, weight
        self.split = cut_documents(of.rows) if isinstance(of, Scan) else None

    def table(self) -> DataFrame:
        return self.of.all() if isinstance(self.of, Scan) else self.of

    def first(self, n: int) -> DataFrame:
        return top(self.of.top(n) if isinstance(self.of, Scan) else self.of, n)

    def found(self, pairs: DataFrame, documents: DataFrame) -> DataFrame:
        """query_id, document, chunk_ord and score of the ``pairs`` (query_id, document) that are in the ranking."""
        own = self.of
        if isinstance(own, Scan):
            wanted, scan = pairs.toArrow(), replace(own, rows=None)
            at = {q: i for i, q in enumerate(own.query_ids)}
            names = pa.array(sorted(set(wanted["document"].to_pylist())), pa.string())
            query = np.array([at.get(q, -1) for q in wanted["query_id"].to_pylist()], np.int64)
            document = np.asarray(pc.index_in(wanted["document"], names).combine_chunks()).astype(np.int64)
            key = np.unique((query * len(names) + document)[query >= 0])
            ids = pa.array(own.query_ids)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part, q, row, high in _bests(scan, batches) if len(key) else ():
                    document = np.asarray(pc.index_in(part.column(0), names))[row[:, 0]]
                    pair = (np.arange(high.shape[1]) + q)[None, :] * len(names) + document[:, None]
                    d, k = np.nonzero((key[np.minimum(np.searchsorted(key, pair), len(key) - 1)] == pair) & (high > -np.inf))
                    where = pa.array(row[d, k])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k + q)), part.column(0).take(where), part.column(1).take(where), pa.array(high[d, k])], ["query_id", "document", "chunk_ord", "score"])

            return rollup(own.rows.join(F.broadcast(documents), "document", "left_semi").select(*own.rows.columns).mapInArrow(run, own.schema))
        return own.join(F.broadcast(pairs), ["query_id", "document"], "left_semi").select("query_id", "document", "chunk_ord", "score")

    def ahead(self, ids: list, candidates: dict[int, list[tuple[float, str]]]) -> dict[int, np.ndarray]:
        """By query (its place in ``ids``) the ranks of its candidates (negative score and document, sorted), counted in one pass over the ranking."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, own = _Ahead(candidates), pa.array(ids)
            for batch in batches:
                which = pc.fill_null(pc.index_in(batch.column(0), own), -1).to_numpy()
                order = np.argsort(which, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(which[order]) != 0)) if len(order) else []
                for i, j in zip(cut, [*cut[1:], len(order)]):
                    counts.add(int(which[order[i]]), batch.column(1).take(pa.array(order[i:j])), np.asarray(batch.column(2))[order[i:j]])
            yield counts.batch()

        if not isinstance(self.of, Scan):
            parts = [self.of.select("query_id", "document", "score").mapInArrow(rows, "k long, place long, n long")]
        elif self.split is None:
            parts = [self.table().select("query_id", "document", "score").mapInArrow(rows, "k long, place long, n long")]
        else:
            scan, at = replace(self.of, rows=None), {q: i for i, q in enumerate(ids)}
            number = [at.get(q, -1) for q in scan.query_ids]

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts = _Ahead(candidates)
                for part, q, row, high in _bests(scan, batches):
                    documents = part.column(0).take(pa.array(row[:, 0]))
                    for k in range(high.shape[1]):
                        there = np.flatnonzero(high[:, k] > -np.inf)
                        counts.add(number[q + k], documents if len(there) == len(high) else documents.take(pa.array(there)), high[there, k])
                yield counts.batch()

            cut = F.broadcast(self.split)
            parts = [self.of.over(self.of.rows.join(cut, "document", "left_anti")).rows.mapInArrow(whole, "k long, place long, n long"),
                     rollup(self.of.over(self.of.rows.join(cut, "document", "left_semi")).partial()).select("query_id", "document", "score").mapInArrow(rows, "k long, place long, n long")]
        seen = {k: np.zeros(len(c) + 1, np.int64) for k, c in candidates.items()}
        for part in parts:
            for r in part.groupBy("k", "place").agg(F.sum("n").alias("n")).collect():
                seen[r.k][r.place] += r.n
        return {k: 1 + np.cumsum(x)[:-1] for k, x in seen.items()}


def depth(weights: list[float], k: int, limit: int, digits: int | None) -> int | None:
    """How many documents of each ranking hold the first ``limit`` of their fusion; None if rounding may make any documents equal.

    A document beyond place n of all rankings has at most the sum of w / (k + n + 1). If some ranking has more than n documents,
    the first ``limit`` of the one of them with the largest weight have w / (k + limit) at least, each.
    """
    room = 1 / (k + limit) - (0 if digits is None else 10.0**-digits / min(weights))
    return None if room <= 0 else max(limit, int(len(weights) / room) - k + 1)


#: Candidates of one fusion that the driver holds at once.
FUSED_ROWS = 2_000_000


def rrf_top(rankings: list[tuple[Scan | DataFrame, float]], limit: int, k: int = RRF_K, digits: int | None = 9) -> DataFrame:
    """The first ``limit`` rows of ``rrf`` and their ranks, without all documents being ranked.

    Only the first documents of the rankings can be among them (see depth). These are looked up in all rankings, and for their ranks the
    documents ahead of them are counted. What the driver holds grows with queries, not with documents; beyond FUSED_ROWS all is ranked.
    """
    _check_rrf(rankings, k)
    lists = [Ranking(of, float(w)) for of, w in rankings]
    counted = [x for x in lists if x.weight > 0]
    n = depth([x.weight for x in counted], k, limit, digits) if counted and limit > 0 else None
    size = max((len(x.of.query_ids) for x in lists if isinstance(x.of, Scan)), default=0)
    if n is None or not size or size * n * len(counted) > FUSED_ROWS:
        return top(rrf([(x.table(), x.weight) for x in lists], k, digits), limit)
    spark = next(x.of.rows.sparkSession for x in lists if isinstance(x.of, Scan))
    folder = shared_folder(spark, "fused")
    first = counted[0].first(n).select("query_id", "document")
    for x in counted[1:]:
        first = first.unionAll(x.first(n).select("query_id", "document"))
    pairs = written(first.distinct(), f"{folder}/pairs")
    documents = pairs.select("document").distinct()
    got = [x.found(pairs, documents).toArrow().to_pydict() for x in lists]
    ids = sorted({q for g in got for q in g["query_id"]})
    number, fused = {q: i for i, q in enumerate(ids)}, {}
    for x, g in zip(lists, got, strict=True):
        candidates: dict[int, list] = {}
        chunk = {}
        for q, d, c, score in zip(g["query_id"], g["document"], g["chunk_ord"], g["score"], strict=True):
            candidates.setdefault(number[q], []).append((-score, d))
            chunk[number[q], d] = c
        for own in candidates.values():
            own.sort()
        ranks = x.ahead(ids, candidates) if x.weight > 0 and candidates else {}
        for q, own in candidates.items():
            for i, (_, d) in enumerate(own):
                was = fused.setdefault((q, d), [chunk[q, d], 0.0])
                was[1] += x.weight / (k + float(ranks[q][i])) if x.weight > 0 else 0.0
    by: dict[int, list] = {}
    for (q, d), (c, score) in fused.items():
        by.setdefault(q, []).append((-(score if digits is None else float(np.round(score, digits))), d, c))
    rows = [(ids[q], d, int(c), -s, r) for q, own in by.items() for r, (s, d, c) in enumerate(sorted(own)[:limit], 1)]
    kind = pairs.schema["query_id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"query_id {kind}, document string, chunk_ord int, score double, rank int")


def semantic_search(specific: DataFrame, semantic: DataFrame, options: SearchOptions) -> DataFrame:
    """``semantic`` needs only each query's first 2 * limit documents."""
    semantic = semantic.where(F.col("score") >= options.min_score)
    return merged_top(specific, semantic, options.limit) if options.specific_term_heuristic else top(semantic, options.limit)


def hybrid_search(specific: DataFrame, semantic: Scan | DataFrame, keyword: Scan | DataFrame, options: HybridOptions) -> DataFrame:
    """``semantic`` has only what reaches the least score."""
    lists = [(semantic, options.semantic_weight), (keyword, options.keyword_weight)]
    if options.specific_term_heuristic:
        lists.insert(0, (specific, 1.0))
    return rrf_top(lists, options.limit, options.rrf_k, options.score_digits)


def with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Display fields for the rows of a result. Where they are few, only their chunks are shuffled."""
    fields, keys = chunks.select("document", "chunk_ord", "title", "href", "heading", "anchor", "snippet"), ["document", "chunk_ord"]
    results = written(results, shared_folder(results.sparkSession, "results"))
    if small(results):
        fields = fields.join(F.broadcast(results.select(*keys).distinct()), keys, "left_semi")
    return results.join(fields, keys, "left")
