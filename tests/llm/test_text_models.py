"""Toxicity, URL filter, LM scoring and the tokenizer."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseek.llm import lm_scoring, sentencepiece_codec, toxicity, url_filter

SF = "/root/testdata/sf0.01"
BAD = ["zorgul", "hateful", "vilefoe", "grubscum"]


def made_texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(300)]
    out = []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(len(w) // 8 + 2):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(docs):
    model = toxicity.fit(made_texts(600, 1))
    held = made_texts(400, 1)[200:]
    rows = [(k, t) for k, (t, _) in enumerate(held)] + [(1000, None), (1001, ""), (1002, "calm " * 50_000), (0, held[0][0])]
    got = toxicity.classify(docs(rows), model)
    assert got.columns == [*(c for c in docs(rows).columns if c != "toxic"), "toxic", "tox_score"] or set(got.columns) == {*docs(rows).columns, "tox_score"}
    flags = {}
    for r in got.collect():
        flags.setdefault(r.doc_id, set()).add(r.toxic)
    assert all(len(v) == 1 for v in flags.values())
    hit = [flags[k] == {True} for k, (_, y) in enumerate(held) if y]
    false = [flags[k] == {True} for k, (_, y) in enumerate(held) if not y]
    assert np.mean(hit) > 0.95 and np.mean(false) < 0.03
    assert flags[1000] == {False} and flags[1001] == {False}


def test_toxicity_passage_in_long_text(docs):
    texts = made_texts(1200, 1)
    model = toxicity.fit(texts[:800])
    clean = [w for t, y in texts[800:] if not y for w in t.split()]
    clean = (clean * (20_000 // len(clean) + 1))[:20_000]
    passage = [w for t, y in texts[800:] if y for w in t.split()][:500]
    rows = [(1, " ".join(clean)), (2, " ".join(clean[:9_000] + passage + clean[9_000:])), (3, " ".join(passage + clean)), (4, " ".join(clean + passage))]
    assert {r.doc_id: r.toxic for r in toxicity.classify(docs(rows), model).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_toxicity_trained_on_phrases():
    """Ordinary words that only toxic texts have side by side."""
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(6, 9))) for _ in range(300)]

    def made(k):
        w = [r.choice(words) for _ in range(100)]
        if k % 4 == 0:
            for i in range(0, 100, 10):
                w[i: i + 2] = words[:2]
        return " ".join(w), int(k % 4 == 0)

    texts = [made(k) for k in range(1200)]
    model = toxicity.fit(texts[:800])
    a, b = (toxicity._compressor(x, model.level) for x in (model.toxic, model.ordinary))
    flags = toxicity.scores([t for t, _ in texts[800:]], a, b, np.array(model.ratio), model.window) > model.threshold
    toxic = np.array([y for _, y in texts[800:]]) == 1
    assert flags[toxic].mean() > 0.9 and flags[~toxic].mean() < 0.03


def test_toxicity_marks_of_few_texts():
    toxic = ["calm words here"] * 990 + ["calm words gnarfle"] * 10
    assert toxicity._marks(toxic, ["calm words here"] * 2000, 0.005, 12.0) >= {"gnarfle", "words gnarfle"}


def test_toxicity_matches_windows_compressed_one_by_one(docs):
    """The score from its definition: each window compressed by itself with both dictionaries, all runs of windows tried."""
    import zstandard

    r = random.Random(9)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    made = [(" ".join(r.choice(words[:8] if k % 3 == 0 and r.random() < 0.3 else words[8:]) for _ in range(60)), int(k % 3 == 0)) for k in range(300)]
    model = toxicity.fit(made)
    coders = [zstandard.ZstdCompressor(
        compression_params=zstandard.ZstdCompressionParameters.from_level(model.level, source_size=128, dict_size=len(x), min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False),
        dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for x in (model.ordinary, model.toxic)]

    def score(text):
        data, cuts = f" {' '.join(text.lower().split())} ".encode(), [0]
        spaces = [i for i, c in enumerate(data) if c == 32]
        for i in spaces[1:]:
            if i // model.window > cuts[-1] // model.window:
                cuts.append(i)
        parts = [data[i: j + 1] for i, j in zip(cuts, [*cuts[1:], len(data)])]
        gains = [len(coders[0].compress(p)) - len(coders[1].compress(p)) for p in parts if len(p) > 1]
        ratio = [model.ratio[min(max(g, toxicity.LOW), toxicity.HIGH) - toxicity.LOW] for g in gains]
        return max(0.0, *(sum(ratio[i:j]) for i in range(len(ratio)) for j in range(i + 1, len(ratio) + 1))) - toxicity.LENGTH_COST * math.log(len(ratio))

    texts = [t for t, _ in made[:40]] + [" ".join(t for t, _ in made[:30])]
    got = {x.doc_id: (x.tox_score, x.toxic) for x in toxicity.classify(docs(list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        assert math.isclose(got[k][0], score(t), abs_tol=1e-6) and got[k][1] == (score(t) > model.threshold)


def test_toxicity_without_training(docs):
    assert toxicity.fit([]) is None
    got = toxicity.classify(docs([(1, "a"), (2, None)]), None).collect()
    assert [r.toxic for r in got] == [False, False] and [r.tox_score for r in got] == [None, None]
    assert toxicity.classify(docs([]), None).count() == 0


def test_toxicity_windows_cover_text():
    data, parts, owner = toxicity.windows(["a" * 500 + " b c", "", "x y"], 96)
    assert owner.tolist() == sorted(owner.tolist()) and 1 not in owner
    for k, t in ((0, "a" * 500 + " b c"), (2, "x y")):
        joined = b"".join(data[int(s): int(s + n)].strip() + b" " for (s, n), o in zip(parts, owner) if o == k)
        assert joined.decode().split() == t.split()


def test_url_filter_held_out(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(4, 9)))
    urls = []
    for k in range(1200):
        bad = k % 3 == 0
        host = f"{word()}-{word()}.example.{r.choice(['biz', 'com'])}" if bad else f"{word()}.example.{r.choice(['org', 'com'])}"
        urls.append((f"http://{host}/{word()}/{r.randint(1, 99)}" + (f"?a={r.randint(1, 9**9)}&b=1" if bad and r.random() < 0.5 else ""), int(bad)))
    model = url_filter.fit(urls[:900])
    score = model.score([u for u, _ in urls[900:]])
    assert np.mean((score >= 0.5) == np.array([y == 1 for _, y in urls[900:]])) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no url"), (4, "http://"), (5, "//x?" + "q" * 100_000), (6, urls[0][0]), (6, urls[0][0])], "page_id long, url string").withColumn("keep", F.lit("k"))
    got = url_filter.classify(odd, model)
    rows = {r.page_id: r for r in got.collect()}
    assert got.columns.count("keep") == 1 and rows[1].keep and rows[1].url_score is None and all(rows[k].url_score is not None for k in range(2, 7)) and not rows[6].keep
    assert url_filter.fit([("http://a", 1)]) is None and all(r.keep for r in url_filter.classify(odd, None).collect())
    assert url_filter.classify(odd.limit(0), model).count() == 0


def test_url_labels_and_parts(spark):
    df = spark.createDataFrame([("http://m.casino-win.example.com/a",), ("https://casinos.example.com/casino",), (None,)], "url string")
    assert [r[0] for r in df.select(url_filter.seed_label(F.col("url"))).collect()] == [1, 0, None]
    assert url_filter.parts("HTTPS://u@Host.org:80/a/b?x=1&y#f") == ("https", "host.org", "/a/b", "x=1&y", "f")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labelled, totals = url_filter.sample_labelled(pages, url_filter.seed_label(F.col("url")))
    assert url_filter.fit(labelled, totals=totals) is not None and sum(totals) == len(labelled) == pages.select("url").distinct().count()
    assert [url_filter.suffix(h) for h in ("a.b.co.uk", "a.com", "x.de", "a.info.de", "", "co.uk")] == ["co.uk", "com", "de", "de", "", "uk"]


def test_url_suffix_leaves_the_row_out():
    """A suffix that one row alone has says nothing about that row, and weights make the sample like the whole."""
    own = url_filter.features("http://a.zz", {"zz": (1.0, 1.0)}, 0.1, (1.0, 1))
    assert own == url_filter.features("http://a.zz", {}, 0.1)
    rows = [(f"http://h{k}.example.org/{'x' * (k % 7)}", int(k % 10 == 0)) for k in range(400)]
    even = [r for r in rows if r[1]] + [r for r in rows if not r[1]][:40]
    whole, part = url_filter.fit(rows), url_filter.fit(even, totals=(360, 40))
    assert whole.prior == part.prior == 0.1 and part.base == whole.base


def test_url_scores_match_trees_walked_by_hand():
    r = random.Random(6)
    rows = [(f"http://{'bad-' * (k % 3 == 0)}h{r.randint(0, 99)}.org/{r.randint(0, 9**6)}", int(k % 3 == 0)) for k in range(300)]
    model = url_filter.fit(rows, trees=10)
    for u, _ in rows[:50]:
        x, total = url_filter.features(u, model.suffixes, model.prior), model.base
        for feature, cut, left, right, value in model.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] if x[feature[node]] <= cut[node] else right[node]
            total += value[node]
        assert math.isclose(model.score([u])[0], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def brute_scores(texts):
    """The same model from plain dicts, its weights by expectation-maximisation over every single event, nothing rounded."""

    def em(high, low, context):
        weights = {}
        for b in set(context):
            own = [(h, l) for h, l, c in zip(high, low, context) if c == b]
            w = 0.5
            for _ in range(60):
                w = min(sum(w * h / (w * h + (1 - w) * l) for h, l in own) / len(own), 1 - 1e-6)
            weights[b] = w if b else 0.0
        return np.array([weights[b] for b in context])

    octave = lambda n: [int(math.log2(x)) + 1 if x > 0 else 0 for x in n]
    seqs = [["\0", *re.findall(r"[^\W_]+", t.lower()), "\0"] for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for s in seqs:
        c1.update(s[1:])
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    total, words = sum(c1.values()), len(c1)
    events = []
    for k, s in enumerate(seqs):
        for i in range(1, len(s)):
            n1 = c1[s[i - 1]] - 1
            n2 = c2[s[i - 2], s[i - 1]] - 1 if i > 1 else 0
            p1 = (c1[s[i]] - 1) / (total - 1)
            p2 = (c2[s[i - 1], s[i]] - 1) / n1 if n1 > 0 else 0.0
            p3 = (c3[s[i - 2], s[i - 1], s[i]] - 1) / n2 if n2 > 0 else 0.0
            events.append((k, p1, p2, p3, n1, n2))
    k, p1, p2, p3, n1, n2 = (np.array(x) for x in zip(*events))
    even = np.full(len(k), 1 / (words + 1))
    w1 = em(p1, even, [1] * len(k))
    low1 = w1 * p1 + (1 - w1) * even
    w2 = em(p2, low1, octave(n1))
    low2 = w2 * p2 + (1 - w2) * low1
    w3 = em(p3, low2, octave(n2))
    return np.bincount(k.astype(int), np.log(w3 * p3 + (1 - w3) * low2), len(texts)), [len(s) - 1 for s in seqs]


def test_lm_scores_match_brute_force(docs):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(3000)]
    texts = [" ".join(words[i: i + r.randint(0, 60)]) for i in r.sample(range(2900), 60)]
    texts += [texts[0], texts[0], "", "unseen words only", "w1 " * 5000, " ".join(f"w{k % 700}" for k in range(60_000))]
    got = lm_scoring.score(docs([(k, t) for k, t in enumerate(texts)] + [(999, None)]))
    rows = {x.doc_id: x for x in got.collect()}
    want, n = brute_scores(texts)
    for k in range(len(texts)):
        assert rows[k].n_scored == n[k]
        assert math.isclose(rows[k].log_prob, want[k], rel_tol=5e-3, abs_tol=0.02), k
        assert math.isclose(rows[k].perplexity, math.exp(-rows[k].log_prob / n[k]), rel_tol=1e-9)
    assert rows[999].log_prob is None and rows[999].n_scored is None
    assert rows[0].perplexity < rows[len(texts) - 3].perplexity


def test_lm_empty(docs):
    assert lm_scoring.score(docs([])).count() == 0
    (row,) = lm_scoring.score(docs([(1, None)])).collect()
    assert row.doc_id == 1 and row.log_prob is None


def test_em_raises_likelihood():
    rng = np.random.default_rng(0)
    high, low, b, n = rng.random(500), rng.random(500) * 0.1, rng.integers(0, 5, 500), rng.integers(1, 9, 500)
    w = lm_scoring.learn(high, low, b, n)
    like = lambda x: np.sum(n * np.log(x[b] * high + (1 - x[b]) * low))
    assert w[0] == 0
    for d in (-0.05, 0.05):
        other = w.copy()
        other[1:5] = np.clip(other[1:5] + d, 0, 1 - 1e-6)
        assert like(w) >= like(other) - 1e-6


needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.DEFAULT_MODEL), reason="no tokenizer files here")


@needs_model
def test_codec_equals_sentencepiece():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    codec = sentencepiece_codec.load()
    r = random.Random(1)
    texts = ["".join(r.choice(" ▁\n\tabcdefeeetthhin,.<s>0x1é你好😀\x00ß-]^\\  ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [x * n for n in (1, 2, 3, 15, 16, 17, 33, 64) for x in (" ", "a", "the", " the")] + ["a" + " " * n + "b" for n in range(1, 40)]
    vocab = list(codec.ids)
    texts += ["".join(r.choice(vocab) for _ in range(r.randint(1, 8))).replace("▁", " ") for _ in range(2000)]
    texts += ["qzx" * 5000, " " * 3000, "word " * 20_000]
    want = sp.encode(texts)
    assert [codec.encode(t) for t in texts] == want
    column = pa.array([*texts, None])
    coded = codec.encode_array(column)
    assert coded.to_pylist() == [*want, None]
    plain = [t for t in texts if "▁" not in t]
    assert codec.decode_array(codec.encode_array(pa.array(plain))).to_pylist() == plain
    assert codec.decode_array(pa.array([None, [], [3, 200]], pa.list_(pa.int32()))).to_pylist()[:2] == [None, ""]


@needs_model
def test_units_side_by_side_equal_one_by_one(monkeypatch):
    """Blocks of few characters, pairs remembered under few hashes, line breaks, unknown characters and long units."""
    monkeypatch.setattr(sentencepiece_codec, "_BLOCK", 40)
    monkeypatch.setattr(sentencepiece_codec, "_MEMO_BITS", 3)
    codec = sentencepiece_codec.load()
    assert codec.side_by_side
    rnd = random.Random(8)
    pieces = [p.strip("▁") for p in codec.pieces[300:] if p.strip("▁")]
    words = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    words += ["\n", "\n\nab\n", "a\x00b", "\U0001f600", "x\U0001f600y", "ab" * 150, "ab" * 300, "a" * 399, "q"]
    units = ["▁" + w for w in words]
    table, begin, count = codec.encode_units(units)
    assert [table[b: b + n].tolist() for b, n in zip(begin, count)] == [list(codec.unit(u)) for u in units]
    assert len(codec.encode_units([])[0]) == 0


@needs_model
def test_codec_on_tables(docs):
    rows = [(1, None), (2, ""), (3, "Hello  world\nagain"), (3, "Hello  world\nagain"), (4, "x" * 100_000)]
    coded = sentencepiece_codec.encode(docs(rows).withColumn("token_ids", F.lit("old")))
    back = sentencepiece_codec.decode(coded)
    assert back.columns.count("token_ids") == 1
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    exact = {(r.doc_id, r.exact) for r in sentencepiece_codec.encode(docs(rows).select("doc_id", "text"), exact="exact").collect()}
    assert exact == {(1, None), (2, True), (3, True), (4, True)}
    assert sentencepiece_codec.encode(docs([])).count() == 0


def test_codec_rejects_other_models():
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(b"")
