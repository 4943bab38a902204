"""Mixing, chat formatting, neighbours, queries and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from loomseek.llm import chat_format, mixing, neighbours, toxicity

SF = "/root/testdata/sf0.001"


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    pi, tokens = np.full(500, 0.37), rng.integers(0, 1000, 500).astype(float)
    out = mixing.flight(pi, tokens, 5)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ tokens - pi @ tokens) < 1e-3
    landed = mixing.flight(pi, tokens, 5, True)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed.sum() - pi.sum()) <= 2
    nearly = np.append(np.full(100, 1 - 1e-16), np.full(100, np.nextafter(1.0, 0)))
    assert (mixing.flight(np.append(nearly, 1e-12), np.ones(201), 1, True) == np.append(np.ones(200), 0)).all()
    assert set(np.unique(mixing.flight(np.full(7, 0.5), np.full(7, 3.0), 1, True))) <= {0.0, 1.0}


def test_flight_keeps_expectation():
    pi, tokens = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([1.0, 5, 2, 9, 4, 4])
    mean = np.mean([mixing.flight(pi, tokens, s) for s in range(4000)], 0)
    assert np.abs(mean - pi).max() < 0.03


def test_balanced_sample(docs):
    r = random.Random(1)
    rows = [(k, "w " * r.randint(0, 300), r.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)] + [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x y", "c"), (5, "z " * 60_000, "a")]
    got = mixing.balanced_sample(docs(rows)).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        own = [x for x in got if x.source == s]
        pi = own[0].pi
        tokens = sum(x.tokens for x in own)
        drawn = sum(x.tokens for x in own if x.selected)
        assert all(x.pi == pi for x in own)
        assert abs(sum(x.selected for x in own) - pi * len(own)) <= 3
        assert abs(drawn - pi * tokens) <= 2 * max(x.tokens for x in own)
    again = mixing.balanced_sample(docs(rows), only_selected=True)
    assert again.columns == docs(rows).columns and again.count() == sum(x.selected for x in got)


def brute_levels(rows, chance):
    """Which rows are drawn: the walks of all levels over plain lists."""
    open_, drawn = [], set()
    for h, tokens, source, unit in rows:
        p = chance[source]
        if 1e-9 < p < 1 - 1e-9:
            open_.append((h, tokens, source, p, unit))
        elif p > 0.5:
            drawn.add(unit)
    levels = [("within", b) for b in mixing._levels(max(sum(r[2] == s for r in rows) for s in chance), mixing._WALK)] + [("across", 0)]
    for k, (kind, bits) in enumerate(levels):
        groups = {}
        for r in sorted(open_, key=lambda r: (r[0], r[1], r[2])):
            cell = (r[0] % (1 << 64)) >> (64 - bits) if bits else 0
            groups.setdefault((r[2] if kind == "within" else "", cell), []).append(r)
        open_ = []
        for own in groups.values():
            got = mixing.flight(np.array([r[3] for r in own]), np.array([float(r[1]) for r in own]), own[0][0] + k, k == len(levels) - 1)
            for r, x in zip(own, got.tolist()):
                if x == 1:
                    drawn.add(r[4])
                elif x > 0:
                    open_.append((*r[:3], x, r[4]))
    return drawn


def test_mixing_is_the_same_however_rows_lie(spark, docs):
    r = random.Random(4)
    rows = [(k, "w " * r.randint(1, 60), r.choice(["a", "a", "a", "b", "c"])) for k in range(9000)]
    key, how = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = docs(rows).cache()
    drawn = {}
    try:
        for batch, parts in ((10_000, 4), (97, 4), (500, 11)):
            spark.conf.set(key, batch)
            drawn[batch] = {x.doc_id for x in mixing.balanced_sample(whole.repartition(parts, F.rand(3)), only_selected=True).collect()}
    finally:
        spark.conf.set(key, how)
    assert drawn[10_000] == drawn[97] == drawn[500]
    keyed = whole.select(F.xxhash64(*whole.columns).alias("h"), mixing.token_count(F.col("text")).alias("n"), "source", "doc_id").collect()
    totals = {}
    for x in keyed:
        totals[x.source] = totals.get(x.source, 0) + x.n
    assert brute_levels([tuple(x) for x in keyed], mixing.inclusion(totals)) == drawn[97]


def test_token_count(spark):
    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,), (" ",), ("x",)], "text string")
    assert [r[0] for r in df.select(mixing.token_count(F.col("text"))).collect()] == [3, 0, 0, 0, 1]


def test_mixing_many_sources(docs):
    got = mixing.balanced_sample(docs([(k, "w " * (k % 37 + 1), f"s{k % 3000}") for k in range(9000)])).collect()
    assert abs(sum(x.selected for x in got) - sum(x.pi for x in got)) <= 2
    assert abs(sum(x.selected * x.tokens for x in got) - sum(x.pi * x.tokens for x in got)) <= 80


def test_mixing_weights(docs):
    rows = [(k, "w " * 99 + "w", "a" if k < 800 else "b") for k in range(1000)]
    got = mixing.balanced_sample(docs(rows), {"a": 1, "b": 1}).collect()
    assert sum(x.selected for x in got if x.source == "a") == 200 and all(x.selected for x in got if x.source == "b")
    only = mixing.balanced_sample(docs(rows), {"a": 1}).collect()
    assert {x.source for x in only if x.selected} == {"a"}
    assert mixing.balanced_sample(docs([])).count() == 0
    assert mixing.inclusion({}) == {} and mixing.inclusion({"a": 0}) == {"a": 1.0}


def test_mixing_tiny_source_leaves_the_rest(docs):
    got = mixing.inclusion({"tiny": 100, mixing._NONE: 7, "hot": 2_400_000_000, **{f"s{k}": 80_000_000 for k in range(300)}})
    assert got["tiny"] == got[mixing._NONE] == 1 and all(got[f"s{k}"] > 1 - 1e-9 for k in range(300)) and 0.3 < got["hot"] < 0.5
    exact = mixing.inclusion({"a": 1000, "b": 4000, "c": 5}, {"a": 1, "b": 2, "c": 0.1})  # c's share is 100, 95 go to the others
    assert exact["a"] == exact["c"] == 1 and abs(exact["b"] * 4000 - 2095) < 1e-6
    rows = [(k, "w " * 99 + "w", "a" if k % 2 else "b") for k in range(1000)] + [(2000, "x", "tiny"), (2001, "x y", None)]
    assert mixing.balanced_sample(docs(rows), only_selected=True).count() == len(rows)


def legal(roles):
    state = ""
    for r in roles:
        if r not in chat_format.NEXT[state]:
            return False
        state = r
    return state in chat_format.FINAL


def cheapest(roles):
    """Least cost over all sequences of operations, by exhaustive search."""
    best = [10**9]

    def go(i, out, cost, pending):
        if cost >= best[0] or pending > 2:
            return
        if i == len(roles) and legal(out):
            best[0] = cost
        state = out[-1] if out else ""
        if i < len(roles):
            for to in chat_format.NEXT[state]:
                go(i + 1, [*out, to], cost + chat_format.relabel_cost(roles[i], to), 0)
            if out:
                go(i + 1, out, cost + chat_format.MERGE + chat_format.relabel_cost(roles[i], state), 0)
        for to in chat_format.NEXT[state]:
            go(i, [*out, to], cost + chat_format.INSERT, pending + 1)

    go(0, [], 0, 0)
    return best[0]


def test_repair_is_cheapest():
    for n in range(5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            cost, turns = chat_format.repair(roles)
            assert legal([r for r, _, _ in turns]) and cost == cheapest(roles), roles
            assert [i for _, first, k in turns for i in range(first, first + k)] == list(range(n))


def test_format_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "b"), (2, 0, "Human", "a"), (3, 0, "user", "x"), (3, 1, "user", "y"), (3, 2, "bot", None),
            (4, 0, "weird", "<|im_end|>"), (1, 1, "assistant", "yo"), (None, 0, "user", "n"), (5, None, None, None), (6, 0, "user", "q" * 100_000), (6, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS turns", "'z' AS plan", "'z' AS last")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert got[1].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n" and got[1].turns_in == 2 and got[1].repair_cost == 0
    assert got[2].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got[3].text == "<|im_start|>user\nx\ny<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[3].repair_cost == chat_format.MERGE
    assert got[4].text.count("<|im_end|>") == got[4].turns_out == 2 and None in got and 5 in got
    assert got[6].turns_in == 2
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_repair_long():
    cost, turns = chat_format.repair(("user", "assistant") * 20_000)
    assert cost == 0 and len(turns) == 40_000


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 64)).astype(np.float32)
    for t in range(3):
        r = neighbours.rotate(x, t)
        assert np.allclose(np.linalg.norm(r, axis=1), np.linalg.norm(x, axis=1), rtol=1e-4) and np.allclose(r @ r.T, x @ x.T, atol=1e-3)


def recall(rows, got, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    hit = total = 0
    for a in range(len(ids)):
        if ids[a] not in got:
            continue
        order = sorted((b for b in range(len(ids)) if ids[b] != ids[a]), key=lambda b: (-sims[a, b], ids[b]))[:k]
        hit += len({ids[b] for b in order} & set(got[ids[a]]))
        total += len(order)
    return hit / total


@pytest.mark.parametrize(("n", "dims", "spread_"), [(30, 16, 1.0), (1500, 64, 1.0), (3000, 128, 0.5), (2000, 768, 0.3), (6000, 48, 0.2)])
def test_neighbours_recall(spark, n, dims, spread_):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(20, dims))
    rows = [(int(i), v.tolist()) for i, v in enumerate((centres[rng.integers(0, 20, n)] * (1 - spread_) + rng.normal(size=(n, dims)) * spread_).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS part", "'x' AS neighbours")
    got = {r.vec_id: r.neighbours for r in neighbours.nearest(df, queries=F.col("vec_id") % 10 == 0).collect()}
    assert set(got) == set(range(0, n, 10)) and recall(rows, got, 10) >= 0.9


def test_neighbours_meet_fewer_rows_as_tables_grow():
    share = []
    for n, cosine in ((10**5, 0.48), (10**7, 0.59), (10**9, 0.65)):
        plan = neighbours.fitted(n, n // 50, 10, 64, np.full(10, cosine))
        share.append(plan.tables * plan.probes / 128**plan.rotations)
    assert share[0] > 4 * share[1] > 8 * share[2]


def test_neighbours_buckets_are_the_best_combinations():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(5, 8)).astype(np.float32) for _ in range(2))
    got = neighbours.nearest_buckets([a, b], 20)
    for k in range(5):
        x, y = np.concatenate([a[k], -a[k]]), np.concatenate([b[k], -b[k]])
        assert got[k].tolist() == sorted(range(256), key=lambda c: -(x[c // 16] + y[c % 16]))[:20]


def test_neighbours_in_a_bucket_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 50)
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)).astype(np.float32))] + [(1000 + i, [1.0] * 16) for i in range(400)]
    got = {r.vec_id: r.neighbours for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()}
    assert got[1000] == [1001, 1002, 1003, 1004, 1005] and got[1399] == [1000, 1001, 1002, 1003, 1004] and recall(rows, got, 5) >= 0.9


def test_neighbours_of_another_length(spark):
    rows = [(k, [1.0, float(k), 0.0]) for k in range(6)] + [(10, [1.0, 1.0, 1.0, 1.0]), (11, [1.0])]
    got = {r.vec_id: r.neighbours for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=1).collect()}
    assert got[10] is None and got[11] is None and got[0] == [1]


def test_neighbours_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].neighbours == [2, 9] and by[9].neighbours == [1, 2] and by[2].neighbours == [1, 9]
    assert all(by[k].neighbours is None for k in (4, 5, 6, 7, 8, None))
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    (alone,) = neighbours.nearest(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).collect()
    assert alone.neighbours == []


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    """Each stage against what its operator does alone on the stage's own input."""
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), [docs]
    for name, fn in corpus_pipeline.STAGES:
        kept.append(fn(spark, kept[-1], SF).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in itertools.pairwise(ids)) and ids[-1] == ids[-2] == {r.doc_id for r in out}
    assert len(out) == len(ids[-1]) and all(len(r.token_ids) == r.n_token_ids for r in out)
    texts = [r.text for r in kept[2].select("text").collect()]
    assert len(texts) == len(set(texts))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - ids[1]) <= 0.02 * len(clean) + 1
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


ODD = [(1, "toxic words here " * 30, "a"), (2, None, "a"), (3, None, None), (4, "", "b"), (5, "", "b"), (6, "same text twice", "a"), (6, "same text twice", "a"), (7, "same text twice", None),
       (8, " ".join(f"w{k}" for k in range(60_000)), "b"), (9, "...", "a"), (None, "no id at all", "a"), (None, None, None), (10, " ".join(f"v{k}" for k in range(40)), "a"), (11, " ".join(f"v{k}" for k in range(41)), "a")]


def odd(spark, tmp_path, rows):
    schema = "doc_id long, text string, source string, tox_score string, toxic string, key string, unit string, apart string, hash_ string, pi_ string, `a.b` string, token_ids string"
    spark.createDataFrame([(*r, *"123456789") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, tmp_path):
    folder = odd(spark, tmp_path, ODD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema, name
            assert all(tuple(r)[3:] == tuple("123456789") for r in out.collect()), name
        kept.append(out)
    ids = [sorted((r.doc_id for r in k.select("doc_id").collect()), key=str) for k in kept]
    assert ids[1] == ids[0]  # too few labels
    assert ids[2] == sorted([1, 2, 3, 4, 6, 8, 9, None, None, 10, 11], key=str)
    assert ids[3] == sorted([1, 2, 3, 4, 6, 8, 9, None, None, 10], key=str)
    assert ids[5] == ids[4]
    coded = {r.doc_id: (r.text, r.token_ids, r.n_token_ids) for r in kept[5].collect() if r.doc_id is not None}
    for text, tokens, n in coded.values():
        assert (tokens is None) == (text is None) and (text is None or (len(tokens) == n and (n == 0) == (text == "")))
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert corpus_pipeline.run(spark, folder).count() == len(ids[5]) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == conf


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = odd(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_drop_toxic_rejects_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'mine' AS tox_score", "'mine' AS toxic")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(toxicity.sample_labelled(docs, labels))
    rows = docs.select("doc_id", "text").collect()
    a, b = (toxicity._compressor(x, model.level) for x in (model.toxic, model.ordinary))
    score = toxicity.scores([r.text or "" for r in rows], a, b, np.array(model.ratio), model.window)
    want = sorted(r.doc_id for r, x in zip(rows, score.tolist(), strict=True) if x <= model.threshold)
    got = corpus_pipeline.drop_toxic(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == want and {r.tox_score for r in got} == {"mine"}
