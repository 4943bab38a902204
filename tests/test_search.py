"""Chunking, ranking, fusion, sources, bundles and the registered queries."""

import glob
import json
import os
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomseek.operators import chunking
from loomseek.operators import ranking as rk
from loomseek.client import SearchClient, call_tool, copy_sources, source_text
from loomseek.options import ChunkOptions, HybridOptions, SearchOptions, SiteOptions, ToolArguments
from loomseek.plans import index as ix
from loomseek.plans import queries as engine
from loomseek.sources import bundle, corpus

SF = "/root/testdata/sf0.001"
DOC = "id string, title string, href string, text string, sections array<struct<text:string,heading:string,anchor:string>>"
MODEL = "token_id int, term string, v array<float>"


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([
        ("a", "Alpha guide", "/a", "", [("alpha basics", None, None), ("advanced alpha", "More", "more")]),
        ("b", "Beta reference", "/b", "beta alpha a the", None)], DOC)
    return ix.build(docs, spark.createDataFrame([(0, "alpha", [1.0, 0.0]), (1, "beta", [0.0, 1.0])], MODEL), ChunkOptions(title_prefix=False))


def ask(spark, index, text, mode="semantic", options=None):
    return ix.search(index, spark.createDataFrame([(1, text)], "query_id long, query string"), mode, options).orderBy("rank").collect()


def test_chunks(spark):
    text = "First sentence. Second sentence. Third sentence."
    docs = spark.createDataFrame([("g", "Guide", "", "ignored", [(text, "Start", "start"), (" ", "None", None)]), ("p", "Plain", "/p", "First sentence.", None), ("e", "Empty", "/e", "", None)], DOC)
    got = chunking.chunk_documents(docs, ChunkOptions(35, 10)).orderBy("document", "chunk_ord").collect()
    assert [(r.document, r.chunk_ord, r.snippet, r.heading) for r in got] == [
        ("g", 0, "First sentence. Second sentence.", "Start"), ("g", 1, "Second sentence. Third sentence.", "Start"), ("p", 0, "First sentence.", None)]
    assert got[0].embed_text == "Guide\n\nFirst sentence. Second sentence."


def test_document_checks(spark):
    for rows in ([("", "t", "h", "x", None)], [("a", None, "h", "x", None)], [("a", "t", "h", "x", None)] * 2):
        with pytest.raises(ValueError):
            chunking.check_documents(spark.createDataFrame(rows, DOC))
    chunking.check_documents(spark.createDataFrame([("a", "t", "", "x", None)], DOC))


def test_semantic(spark, index):
    assert [(r.document, r.score) for r in ask(spark, index, "alpha", options=SearchOptions(min_score=0.1))] == [("a", 1.0), ("b", pytest.approx(0.7071, abs=1e-2))]
    assert ask(spark, index, "unknown") == [] and ask(spark, index, "A THE") == []
    assert [r.document for r in ask(spark, index, "GUIDE")] == ["a"]
    assert ask(spark, index, "GUIDE", options=SearchOptions(specific_term_heuristic=False)) == []


def test_keyword_and_hybrid(spark, index):
    assert [r.document for r in ask(spark, index, "beta alpha", "keyword")] == ["b", "a"]
    assert [r.document for r in ask(spark, index, "beta", "hybrid", HybridOptions(keyword_weight=0, semantic_weight=2))][0] == "b"
    assert ask(spark, index, "alpha", "hybrid", HybridOptions(limit=0)) == []
    with pytest.raises(ValueError):
        ask(spark, index, "x", "other")


def test_join_pooling_equals_workers(spark, monkeypatch):
    words = spark.createDataFrame([(1, ["alpha", "beta", "beta", "x"]), (2, ["x"]), (3, [])], "k int, tokens array<string>")
    model = spark.createDataFrame([(0, "alpha", [1.0, 0.0]), (1, "beta", [0.0, 1.0])], MODEL)
    a = sorted(ix.embedded(words, model).collect())
    monkeypatch.setattr(ix, "MODEL_BYTES", 0)
    b = sorted(ix.embedded(words, model).collect())
    assert [r.v is None for r in a] == [r.v is None for r in b] == [False, True, True]
    assert np.allclose(a[0].v, b[0].v) and np.allclose(a[0].v, np.array([1, 2]) / np.sqrt(5))
    assert [r.v for r in ix.embedded(words, model.limit(0)).collect()] == [None] * 3


@pytest.fixture(scope="module")
def pieces(spark):
    """A model of word pieces and marks."""
    docs = spark.createDataFrame([("a", "Played", "/a", "Playing.", None), ("b", "Other", "/b", "other, words", None), ("c", "Strasse", "/c", "eine straße", None)], DOC)
    model = spark.createDataFrame([(0, "[UNK]", [9.0, 9.0, 9.0]), (1, "play", [1.0, 0.0, 0.0]), (2, "##ing", [0.0, 1.0, 0.0]), (3, "other", [0.0, 0.0, 1.0]), (4, ".", [0.0, 0.5, 0.0]), (5, "strasse", [0.3, 0.3, 0.0])], MODEL)
    return ix.build(docs, model, ChunkOptions(title_prefix=False))


def test_word_pieces_are_embedded(spark, pieces):
    vectors = {r.document: r.v for r in pieces.table.collect()}
    mean = np.array([1.0, 1.5, 0.0])  # play, ##ing and the mark
    assert vectors["a"] == np.rint(mean / np.linalg.norm(mean) * 127).astype(int).tolist() and vectors["b"] == [0, 0, 127] and vectors["c"] is None
    got = ask(spark, pieces, "playing", options=SearchOptions(min_score=0.1, specific_term_heuristic=False))
    want = (np.array(vectors["a"]) @ [1, 1, 0]) / np.linalg.norm(vectors["a"]) / np.sqrt(2)
    assert [r.document for r in got] == ["a"] and got[0].score == pytest.approx(want, abs=1e-6)
    assert got[0].title == "Played" and got[0].snippet == "Playing."


def test_vocabulary_is_case_folded(spark, pieces):
    """A sharp s folds to the two letters that the vocabulary has, so the word isn't specific."""
    asked = spark.createDataFrame([(1, "straße words the ours players")], "query_id long, query string")
    assert {r.term for r in rk.oov_terms(asked, pieces.model).collect()} == {"words", "players"}


def test_encoder_of_the_caller(spark):
    docs = spark.createDataFrame([("a", "T", "/a", "one", None), ("b", "T", "/b", "two", None)], DOC)
    model = spark.createDataFrame([(0, "one", [1.0, 0.0])], MODEL)

    def encode(texts):
        return np.array([[1.0, 0.0] if "one" in t else [0.0, -1.0] for t in texts])

    assert {r.document: r.v for r in ix.build(docs, model, encoder=encode).table.collect()} == {"a": [127, 0], "b": [0, -127]}
    for wrong in (lambda t: np.ones((len(t), 3)), lambda t: np.full((len(t), 2), np.nan), lambda t: np.ones((len(t), 2))):
        with pytest.raises(Exception, match="encoder"):
            ix.build(docs, model, encoder=wrong).table.collect()


def test_ranges_number_like_windows(spark):
    rows = [(q, f"d{i:04d}", 0, float((i * 7919) % 100)) for q in (1, 2, 3) for i in range(0 if q == 2 else 700)] + [(2, "x", 0, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, document string, chunk_ord int, score double")
    assert sorted(rk.all_ranked(df).collect()) == sorted(rk.ranked(df).collect())


def test_merge_of_long_rankings(spark):
    a, b = ranking(spark, [f"a{i}" for i in range(30)] + ["x"]), ranking(spark, ["x", *(f"b{i}" for i in range(40)), "a3"])
    merged = [r.document for r in rk.merge(a, b).orderBy("rank").collect()]
    assert merged == [f"a{i}" for i in range(30)] + ["x"] + [f"b{i}" for i in range(40)]
    for limit in (0, 1, 5, 31, 33, 200):
        assert [r.document for r in rk.merged_top(a, b, limit).orderBy("rank").collect()] == merged[:limit]


def test_scan_keeps_the_best_of_each_batch(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i // 3}", i % 3, [int(x) for x in rng.integers(-9, 9, 4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "document string, chunk_ord int, v array<tinyint>").repartition(3)
    queries = rng.normal(size=(5, 4))
    whole = rk.rollup(rk.cosine_scan(df, ["p", "q", "r", "s", "t"], queries, kind="string"))
    exact = {}
    for d, c, v in rows:
        for k, q in zip("pqrst", queries):
            x = round(float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), 9) if any(v) else 0.0
            exact[k, d] = min(exact.get((k, d), (9.0, 0)), (-x, c))
    assert {(r.query_id, r.document): (r.chunk_ord, pytest.approx(r.score, abs=2e-9)) for r in whole.collect()} == {k: (c, -x) for k, (x, c) in exact.items()}
    few = rk.top(rk.rollup(rk.cosine_scan(df, ["p", "q", "r", "s", "t"], queries, min_score=0.5, limit=4, kind="string")), 4).select("query_id", "document", "chunk_ord").collect()
    assert sorted(few) == sorted(rk.top(whole.where("score >= 0.5"), 4).select("query_id", "document", "chunk_ord").collect())
    with pytest.raises(Exception, match="components"):
        rk.cosine_scan(df, ["p"], rng.normal(size=(1, 3)), kind="string").collect()


def test_many_queries_go_in_blocks(spark, index, monkeypatch):
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["alpha", "beta", "alpha beta", "x"] * 5)], "query_id string, query string")
    once = sorted(ix.semantic_rank(index, asked).collect())
    monkeypatch.setattr(ix, "QUERY_BYTES", 64)
    assert sorted(ix.semantic_rank(index, asked).collect()) == once and len(once) == 30


def ranking(spark, documents):
    return spark.createDataFrame([(1, d, 0, float(-i)) for i, d in enumerate(documents)], "query_id long, document string, chunk_ord int, score double")


def test_rrf(spark):
    first = rk.ranked(rk.rrf([(ranking(spark, "ab"), 2), (ranking(spark, "ba"), 1)])).orderBy("rank").collect()
    assert [r.document for r in first] == ["a", "b"]
    only = rk.rrf([(ranking(spark, "a"), 0), (ranking(spark, "b"), 1)]).collect()
    assert [(r.document, r.score) for r in only] == [("b", round(1 / 61, 9))]
    for bad in ([(ranking(spark, "a"), -1)], [(ranking(spark, "a"), float("nan"))]):
        with pytest.raises(ValueError):
            rk.rrf(bad)
    with pytest.raises(ValueError):
        rk.rrf([(ranking(spark, "a"), 1)], k=0)
    merged = rk.merge(ranking(spark, "c"), ranking(spark, "abc")).orderBy("rank").collect()
    assert [r.document for r in merged] == ["c", "a", "b"]


@pytest.mark.parametrize("make", [lambda: ChunkOptions(0), lambda: ChunkOptions(10, 10), lambda: ChunkOptions(10, -1), lambda: SearchOptions(limit=-1), lambda: SearchOptions(limit=True), lambda: SearchOptions(specific_term_heuristic=1), lambda: SiteOptions(dims=0),
                                  lambda: SearchOptions(min_score=float("inf")), lambda: HybridOptions(rrf_k=0), lambda: HybridOptions(keyword_weight=-1), lambda: ToolArguments(" "), lambda: ToolArguments("q", 21)])
def test_wrong_options(make):
    with pytest.raises(ValueError):
        make()


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    again = ix.Index.load(spark, str(tmp_path / "ix"))
    assert [tuple(r) for r in ask(spark, again, "beta alpha", "hybrid")] == [tuple(r) for r in ask(spark, index, "beta alpha", "hybrid")]
    shown = ix.format_results(ix.search(again, spark.createDataFrame([(1, "alpha")], "query_id long, query string"), "keyword").withColumn("query", F.lit("alpha"))).head().text
    assert shown.startswith('Found 2 results for "alpha"') and "## Result 1: Alpha guide" in shown and "/a" in shown


def with_vectors(index):
    from loomseek.functions import vectors as fv

    return index.table.withColumn("doc_ord", F.ascii("document").cast("long")).withColumn("v", fv.unit(F.col("v")))


def test_bundle(spark, index, tmp_path):
    folder, model = str(tmp_path / "b"), ix.dequantized(index.model).withColumnRenamed("term", "token")
    m = bundle.write_bundle(folder, with_vectors(index), model, model_id="m")
    again = bundle.write_bundle(folder, with_vectors(index), model, model_id="m")
    other = bundle.write_bundle(str(tmp_path / "o"), with_vectors(index), model, model_id="m", version_key="their_version")
    assert other["their_version"] == "1.0" and bundle.read_bundle(str(tmp_path / "o" / "manifest.json"), "their_version").vocab == ["alpha", "beta"]
    with pytest.raises(bundle.BundleError):
        bundle.read_bundle(str(tmp_path / "o"))
    assert m == again and m["n_chunks"] == 3 and len(os.listdir(folder)) == 6
    b = bundle.read_bundle(folder)
    assert [c["document"] for c in b.chunks] == ["a", "a", "b"] and b.chunks[1]["anchor"] == "more" and "anchor" not in b.chunks[0]
    assert b.docs.tolist() == [[127, 0], [127, 0], [90, 90]] and b.tokens.tolist() == [[127, 0], [0, 127]]
    assert b.chunk_table(spark).count() == 3 and b.model_table(spark).count() == 2
    with pytest.raises(bundle.BundleError):
        bundle.write_bundle(folder, with_vectors(index).withColumn("v", F.array(F.lit(1.0), F.lit(1.0))), model, model_id="m")
    bundle.write_bundle(folder, with_vectors(index).limit(0), model, model_id="m")
    assert bundle.read_bundle(folder).chunks == [] and len(os.listdir(folder)) == 6


def test_bundle_rules():
    files = {"c": b"[]", "d": b"", "t": b"\x7f", "s": np.array([1], "<f4").tobytes(), "v": b'["x"]'}
    good = {"format_version": "1.0", "model_id": "m", "dims": 1, "vocab_size": 1, "n_chunks": 0, "chunk_size": 1, "chunk_overlap": 0, "title_prefix": True, "chunker_version": "1", "doc_scale": 127,
            "files": dict(zip(bundle.FILES, "cdtsv", strict=True))}
    assert bundle.from_bytes(json.dumps(good).encode(), files).vocab == ["x"]
    for change in ({"format_version": "2.0"}, {"dims": True}, {"doc_scale": 1}, {"model_id": ""}, {"title_prefix": 1}, {"extra": 1}, {"n_chunks": 1}, {"files": {**good["files"], "docs": "../d"}}):
        with pytest.raises(bundle.BundleError):
            bundle.from_bytes({**good, **change}, files)
    for change in ({"t": b""}, {"s": np.array([0], "<f4").tobytes()}, {"v": b"[1]"}, {"c": b"[{}]"}, {"d": "text"}):
        with pytest.raises(bundle.BundleError):
            bundle.from_bytes(good, {**files, **change})


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(0, "one", [1.0, -1.0]), (1, "two", [0.5, -0.5])], "token_id int, token string, v array<float>")
    bundle.write_model(str(tmp_path / "m"), rows, "m")
    got = bundle.read_model(spark, str(tmp_path / "m")).orderBy("token_id").collect()
    assert [r.v for r in got] == [[127, -127], [127, -127]] and np.allclose([r.scale for r in got], [1 / 127, 0.5 / 127])
    data = np.array([[1, -1], [0.5, -0.5]], "<f4").tobytes()
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}}).encode()
    raw = struct.pack("<Q", len(header)) + header + data
    assert bundle.safetensors_embeddings(raw).tolist() == [[1, -1], [0.5, -0.5]]
    for bad in (raw[:-1], raw[:4], raw.replace(b"F32", b"F64")):
        with pytest.raises(bundle.BundleError):
            bundle.safetensors_embeddings(bad)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/model.safetensors").write_bytes(raw)
    (tmp_path / "s/tokenizer.json").write_text(json.dumps({"model": {"vocab": {"one": 0, "two": 1}}}))
    assert [r.token for r in bundle.safetensors_model(spark, str(tmp_path / "s")).orderBy("token_id").collect()] == ["one", "two"]
    (tmp_path / "s/tokenizer.json").write_text(json.dumps({"model": {"vocab": {"one": 0, "two": 2}}}))
    with pytest.raises(bundle.BundleError):
        bundle.tokenizer_vocabulary(spark, str(tmp_path / "s/tokenizer.json"))


def test_corpus(spark, tmp_path):
    good = [{"id": "a", "title": "A", "href": "", "text": "x", "sections": [{"text": "y", "heading": "H"}]}, {"id": "b", "title": "B", "href": "/b", "text": "z"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n\n")
    (tmp_path / "c.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(good[1]))
    for name, n in (("c.jsonl", 2), ("c.json", 2), ("one.json", 1)):
        got = corpus.read_corpus(spark, str(tmp_path / name)).orderBy("doc_ord").collect()
        assert len(got) == n and got[-1].id == "b"
    assert corpus.read_corpus(spark, str(tmp_path / "c.json")).orderBy("doc_ord").head().sections[0].heading == "H"
    for k, bad in enumerate(({"id": "a"}, {**good[1], "more": 1}, {**good[1], "title": 3}, {**good[1], "sections": [{"heading": "h"}]}, [1], {**good[1], "text": 3, "sections": [{"text": "a"}]}, {**good[1], "sections": [{"text": "a", "heading": 3}]},
                             {**good[1], "sections": "zz"}, {**good[1], "sections": [{"text": "a"}, {"text": "b", "heading": None}]}, {**good[1], "sections": ["x"]}, {**good[1], "sections": [{"text": "a", "z": "b"}]}, {**good[1], "id": None})):
        (tmp_path / f"bad{k}.jsonl").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            corpus.read_corpus(spark, str(tmp_path / f"bad{k}.jsonl"))
    for k, fine in enumerate(({**good[1], "sections": None}, {**good[1], "sections": []}, {**good[1], "sections": [{"text": "a", "anchor": "b"}, {"text": "c"}]})):
        (tmp_path / f"fine{k}.ndjson").write_text(json.dumps(fine))
        assert corpus.read_corpus(spark, str(tmp_path / f"fine{k}.ndjson")).count() == 1
        with pytest.raises(ValueError):
            corpus.read_corpus(spark, str(tmp_path / f"fine{k}.ndjson"), strict=True)
    assert corpus.read_corpus(spark, str(tmp_path / "c.json"), strict=True).count() == 2
    (tmp_path / "x.md").write_text("# T\n")
    assert corpus.read_markdown(spark, str(tmp_path), "x.md") == "# T\n"
    for path in ("../x.md", "/x.md", "x.txt", "a\\x.md"):
        with pytest.raises(ValueError):
            corpus.read_markdown(spark, str(tmp_path), path)


def test_client_of_a_bundle(spark, index, tmp_path):
    folder = str(tmp_path / "b")
    bundle.write_bundle(folder, with_vectors(index), ix.dequantized(index.model).withColumnRenamed("term", "token"), model_id="m")
    own, native = SearchClient.open(spark, folder=folder), SearchClient(index)
    for ask_ in (lambda c: c.semantic("beta"), lambda c: c.lexical("alpha the"), lambda c: c.hybrid("beta guide", HybridOptions(2)), lambda c: call_tool(c, {"query": " beta ", "limit": 1}, "hybrid"), lambda c: call_tool(c, {"query": "alpha"}, "keyword")):
        assert [(r.document, r.snippet, r.score) for r in ask_(own)] == [(r.document, r.snippet, r.score) for r in ask_(native)] != []
    for wrong in ({}, {"query": " "}, {"query": "a", "limit": 21}, {"query": "a", "more": 1}):
        with pytest.raises(ValueError):
            call_tool(own, wrong)
    for wrong in ({}, {"path": "x", "folder": "y"}):
        with pytest.raises(ValueError):
            SearchClient.open(spark, **wrong)
    copy_sources(spark.createDataFrame([("a.md", "# A")], "path string, text string"), str(tmp_path / "s"))
    assert source_text(spark, str(tmp_path / "s"), " a.md") == "# A" and source_text(spark, str(tmp_path / "s"), "b.md") is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_query_equals_sql(spark, name):
    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)

    got = engine.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rows = con.execute(engine.ORACLE[name])
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rows.fetchall())


def scattered(spark, docs, chunks, copies=1):
    """Chunks of documents in any order over three tasks, with more rows than go into one batch where asked."""
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", c, [f"w{k}" for k in set(rng.integers(0, 9, 4).tolist())]) for i in range(docs) for c in range(chunks)] * copies
    return spark.createDataFrame([(d, c, 5 * len(t), t, [int(k % 3 + 1) for k in range(len(t))]) for d, c, t in rows], "document string, chunk_ord int, dl int, terms array<string>, tfs array<int>")


def test_bm25_of_cut_documents(spark):
    """Documents whose chunks lie together are ranked in their tasks, those that are cut by a shuffle; both as by the formula over all pairs."""
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{(i * 2) % 9} none") for i in range(7)] + [("x", "nothing")], "query_id string, query string")
    together = scattered(spark, 60, 3)
    rows = together.collect()
    n, avgdl = len(rows), sum(r.dl for r in rows) / len(rows)
    df, want = {}, {}
    for r in rows:
        for t in r.terms:
            df[t] = df.get(t, 0) + 1
    for q in range(7):
        for r in rows:
            s = round(sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * r.dl / avgdl))) for t, f in zip(r.terms, r.tfs) if t in {f"w{q}", f"w{(q * 2) % 9}"}), 9)
            if s > 0:
                want[f"q{q}", r.document] = min(want.get((f"q{q}", r.document), (9, 0)), (-s, r.chunk_ord))
    for table in (together.coalesce(1), together.repartition(3), together.repartitionByRange(3, "document", "chunk_ord").sortWithinPartitions("document")):
        got = rk.keyword_rank(table, asked).collect()
        assert len(got) == len(want) and {(r.query_id, r.document): (pytest.approx(-r.score, abs=2e-9), r.chunk_ord) for r in got} == want
        first = rk.top(rk.keyword(table, asked).top(4), 4).collect()
        assert {(r.query_id, r.rank): r.document for r in first} == {(q, i): d for q in {k[0] for k in want} for i, (_, d) in enumerate(sorted((s[0], d) for (p, d), s in want.items() if p == q)[:4], 1)}
    plan = rk.keyword(together.coalesce(1), asked).partial()._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan  # nothing is shuffled for documents that lie together


def test_first_of_a_fusion_equals_all_of_it(spark):
    """Ranks that are counted for candidates are those of whole rankings: with ties, weights of 0, documents that tasks cut, few and many documents."""
    rng = np.random.default_rng(5)
    for docs, parts in ((400, 3), (7, 1)):
        rows = [(f"d{i}", c, [int(x) for x in rng.integers(-2, 3, 3)], [f"w{k}" for k in set(rng.integers(0, 9, 3).tolist())]) for i in range(docs) for c in range(2)]
        table = spark.createDataFrame([(d, c, v, 4, t, [1] * len(t)) for d, c, v, t in rows], "document string, chunk_ord int, v array<tinyint>, dl int, terms array<string>, tfs array<int>").repartition(parts).persist()
        asked = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(3)], "query_id long, query string")
        special = spark.createDataFrame([(i, f"d{j}", 1, float(j % 2)) for i in range(2) for j in range(0, docs, 3)], "query_id long, document string, chunk_ord int, score double")
        for w in ((1.0, 1.0, 1.0), (0.0, 0.0, 2.0), (1.0, 3.0, 0.5)):
            lists = list(zip((special, rk.cosine(table, [0, 1, 2], rng.normal(size=(3, 3)), 1, 0.0), rk.keyword(table, asked)), w, strict=True))
            want = rk.top(rk.rrf([(x.all() if isinstance(x, rk.Scan) else x, y) for x, y in lists]), 5)
            got = rk.rrf_top(lists, 5)
            columns = ["query_id", "rank", "document", "chunk_ord", "score"]
            assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and got.count() == 15 or docs < 9
    assert rk.depth([1.0, 1.0], 60, 10, 9) == 81 and rk.depth([1e-9], 60, 10, 9) is None


def test_bundle_in_pieces(spark, index, tmp_path, monkeypatch):
    """A bundle that is written and read in pieces of a few bytes and rows is the same as one that is read whole."""
    folder, model = str(tmp_path / "b"), ix.dequantized(index.model).withColumnRenamed("term", "token")
    table = with_vectors(index).crossJoin(spark.range(9)).withColumn("chunk_ord", (F.col("id") * 2 + F.col("chunk_ord")).cast("int")).withColumn("snippet", F.concat("snippet", F.lit(' "],[{é ☃\n'), F.col("id").cast("string")))
    bundle.write_bundle(folder, table, model, model_id="m")
    want = [tuple(r) for r in bundle.read_bundle(folder).chunk_table(spark).orderBy("chunk_ix").collect()]
    for size in (1, 7, 1000):
        monkeypatch.setattr(bundle, "PIECE_BYTES", size)
        monkeypatch.setattr(bundle, "PIECE_ROWS", size)
        assert [tuple(r) for r in bundle.stored_chunks(spark, folder).orderBy("chunk_ix").collect()] == want and len(want) == 27
    for wrong in (b"", b"[", b"{}", b"[1]", b"[{}]", b"[]x", b"[,]"):
        (tmp_path / "w.json").write_bytes(wrong)
        with pytest.raises(bundle.BundleError):
            list(bundle._records(str(tmp_path / "w.json")))
    (tmp_path / "w.json").write_bytes(b" [ ] ")
    assert list(bundle._records(str(tmp_path / "w.json"))) == []
