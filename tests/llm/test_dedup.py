"""Exact dedup, line dedup and the n-gram join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseek.llm import exact_dedup, line_dedup, ngram_join
from loomseek.llm.exact_dedup import Directory

ROWS = [(3, "a b c"), (1, "a b c"), (1, "a b c"), (None, "a b c"), (5, None), (6, None), (7, ""), (2, ""), (8, "x" * 200_000), (9, "x" * 200_000), (10, "x" * 199_999), (11, "a  b c")]


def test_directory_splits_and_doubles():
    counts = np.zeros(256, np.int64)
    counts[:4] = 50
    d = Directory(counts, 60)
    assert max(d.loads) <= 60 and sum(d.loads) == 200 and len(d.slots) == 1 << d.depth
    for cell in range(256):
        assert 0 <= d.slots[cell >> (8 - d.depth)] < len(d.loads)
    assert d.owners(3) == sorted(d.owners(3))
    full = np.zeros(4, np.int64)
    full[1] = 1000
    assert max(Directory(full, 10).loads) == 1000  # at the limit of bits it overflows into a chain


def test_find_copies(docs):
    got = sorted(tuple(r) for r in exact_dedup.find_copies(docs(ROWS), capacity=2).fillna(-1).collect())
    want = sorted([(1, 1, 4, False), (1, 1, 4, True), (3, 1, 4, True), (-1, 1, 4, True), (5, 5, 1, False), (6, 6, 1, False), (2, 2, 2, False), (7, 2, 2, True),
                   (8, 8, 2, False), (9, 8, 2, True), (10, 10, 1, False), (11, 11, 1, False)])
    assert got == want


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs(ROWS))
    assert kept.columns == docs(ROWS).columns
    assert sorted((r.doc_id, len(r.text) if r.text is not None else -1, r.key) for r in kept.collect()) == [
        (1, 5, "k"), (2, 0, "k"), (5, -1, "k"), (6, -1, "k"), (8, 200_000, "k"), (10, 199_999, "k"), (11, 6, "k")]


def clash(text):
    """A key that different texts share."""
    return F.length(text).cast("long") % 3


def test_texts_that_share_a_key(docs):
    rows = [*ROWS, (20, "c b a"), (None, "c b a"), (21, "q")]
    plain = lambda df: sorted(tuple(r) for r in df.fillna(-1).collect())
    assert plain(exact_dedup.find_copies(docs(rows), key=clash)) == plain(exact_dedup.find_copies(docs(rows)))
    assert plain(exact_dedup.drop_copies(docs(rows), key=clash).select("doc_id")) == plain(exact_dedup.drop_copies(docs(rows)).select("doc_id"))
    near = near_rows(3)
    assert plain(ngram_join.near_classes(docs(near), key=clash)) == plain(ngram_join.near_classes(docs(near)))
    assert plain(ngram_join.keep_one(docs(near), key=clash).select("doc_id")) == plain(ngram_join.keep_one(docs(near)).select("doc_id"))


def test_hot_text(docs):
    rows = [(k % 20_000, "hot") for k in range(25_000)] + [(None, "hot")] * 12_000
    got = exact_dedup.find_copies(docs(rows))
    assert got.count() == len(rows) and got.where("NOT is_copy").count() == 1 and got.where("copies <> 37000 OR keeper_id <> 0").count() == 0
    nulls = exact_dedup.find_copies(docs(rows[25_000:]))
    assert nulls.count() == 12_000 and nulls.where("NOT is_copy").count() == 1
    (one,) = exact_dedup.drop_copies(docs(rows)).collect()
    assert one.doc_id == 0


def test_dotted_column(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, None, "c")], "doc_id long, text string, `a.b` string")
    for drop in (exact_dedup.drop_copies, ngram_join.keep_one, line_dedup.drop_repeated_lines):
        got = drop(df)
        assert "a.b" in got.columns and {r["a.b"] for r in got.collect()} >= {"a", "c"}


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        h = line_dedup.PerfectHash(keys)
        assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
        entries = np.zeros(len(keys), line_dedup._ENTRY)
        entries["key"], entries["mark"], entries["count"], entries["first"] = keys, keys >> np.uint64(7), np.arange(len(keys)) + 2, np.arange(len(keys))
        shard = line_dedup.Shard.from_bytes(line_dedup.Shard(entries).to_bytes())
        count, first = shard.probe(keys, keys >> np.uint64(7))
        assert (count == np.arange(len(keys)) + 2).all() and (first == np.arange(len(keys))).all()
        assert (shard.probe(keys, keys)[0] == 1).all()
        assert (shard.probe(keys + np.uint64(1), keys)[0] == 1).all()


def test_shard_with_keys_of_two_lines():
    entries = np.array([(5, 1, 2, 10), (7, 1, 3, 11), (7, 2, 4, 12), (9, 9, 5, 13)], line_dedup._ENTRY)
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard(entries).to_bytes())
    count, first = shard.probe(np.array([7, 7, 7, 5, 9, 9], np.uint64), np.array([1, 2, 3, 1, 9, 8], np.uint64))
    assert count.tolist() == [3, 4, 1, 2, 5, 1] and first.tolist()[:2] == [11, 12]


def brute_lines(rows, min_bytes=1, min_count=2):
    last = 2**63 - 1
    count, first = {}, {}
    for i, t in rows:
        for x in (t.split("\n") if t is not None else []):
            if len(x.encode()) >= min_bytes:
                count[x] = count.get(x, 0) + 1
                first[x] = min(first.get(x, last), last if i is None else i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            if count.get(x, 0) >= min_count and ((last if i is None else i) != first[x] or x in seen):
                continue
            seen.add(x)
            kept.append(x)
        out.append((i, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return out


def test_line_dedup(docs):
    r = random.Random(3)
    lines = [f"line {k} with some more bytes of text" for k in range(30)] + ["short", "", "ü" * 10, "y" * 100_000]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 8)))) for k in range(60)] + [(5, "\n".join(lines)), (5, "\n".join(lines)), (None, lines[0]), (None, "only here, but twice in null rows"), (None, "only here, but twice in null rows"), (99, None), (98, "")]
    clash = docs(rows).withColumnRenamed("row", "keep_").withColumnRenamed("unit", "lines_removed")
    got = line_dedup.drop_repeated_lines(clash)
    assert sorted(got.columns) == sorted(clash.columns)
    want = brute_lines(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "", x[2])
    assert sorted(((x.doc_id, x.text, x.lines_removed) for x in got.collect()), key=key) == sorted(want, key=key)


def grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set() if not w else {tuple(w)} if len(w) < 3 else {tuple(w[i: i + 3]) for i in range(len(w) - 2)}


def brute_pairs(rows, t=0.5):
    out = set()
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1:]:
            if a is None or b is None or i is None or j is None:
                continue
            x, y = grams(a), grams(b)
            if a == b or (x and y and len(x & y) >= t * len(x | y) - 1e-9):
                out.add((min(i, j), max(i, j)))
    return out


def near_rows(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice((2, 5, 30, 80, 200)))] for _ in range(25)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 1, 2, 5, 12))):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w += passage
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        rows.append((k, " ".join(w)))
    return rows + [(900, ""), (901, ""), (902, "..."), (903, None), (904, None), (None, rows[0][1]), (905, rows[1][1]), (906, rows[1][1]), (907, " ".join(words * 200)), (908, " ".join(words * 200) + " end")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_and_groups(docs, seed):
    rows = near_rows(seed)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_classes(docs(rows)).collect()}
    want = brute_pairs(rows)
    texts = dict((i, t) for i, t in rows if i is not None)
    null_text = next(t for i, t in rows if i is None)
    links = {i: sum(i in p for p in want) for i in texts}
    for i, t in texts.items():
        if t is not None and (t == null_text or (grams(t) and grams(null_text) and len(grams(t) & grams(null_text)) >= 0.5 * len(grams(t) | grams(null_text)) - 1e-9)):
            links[i] += 1
    assert {i: n for i, (_, n) in got.items() if i is not None} == links and len(got) == len(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(docs(rows)).collect()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in want:
        up[max(find(a), find(b))] = min(find(a), find(b))
    groups = {i: find(i) for i in texts}
    assert {i: c for i, (c, _) in got.items() if i is not None} == groups
    for i, t in texts.items():
        stays = groups[i] == i or t == texts[groups[i]] or t is None or not grams(t)
        assert (i in kept) == stays, i


def family_rows(seed):
    """Near copies of three texts, some with a passage in common, and texts that are mostly that passage; with exact copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for k, base in enumerate([[r.choice(words) for _ in range(size)] for size in (60, 90, 25)]):
        for _ in range(70):
            w = list(base)
            for _ in range(r.choice((0, 1, 3, 8, 14))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w + passage * (k == 2)))
    rows += [" ".join(passage + [r.choice(words) for _ in range(r.randint(2, 70))]) for _ in range(70)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("most_run", [2, 20])
def test_groups_lose_no_link(docs, monkeypatch, most_run):
    """Runs in groups and tiles of several pieces give what brute force gives."""
    monkeypatch.setattr(ngram_join, "_TILE_CHARS", 150_000)
    rows = family_rows(most_run)
    want = brute_pairs(rows)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_classes(docs(rows), most_run=most_run).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(i in p for p in want) for i, _ in rows}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in want:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: c for i, (c, _) in got.items()} == {i: find(i) for i, _ in rows}
    kept = {r.doc_id for r in ngram_join.keep_one(docs(rows), most_run=most_run).collect()}
    assert kept == {i for i, t in rows if t == rows[find(i)][1]}


def _runs_of(texts, most_run):
    """What leaves the ranges for these texts: packed pairs, and units of groups."""
    sets = [s for _, s in ngram_join._sets(pa.array(texts), 3)]
    rows = [(k, len(s), 1, s) for k, s in enumerate(sets)]
    out = [b for b in ngram_join._pairs(0.5, 40, 1, most_run)(iter([ngram_join._pack(rows, 1)]))]
    pairs = sum(len(ngram_join._unsqueeze(x)[0]) for b in out for x, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if not g)
    return pairs, sum(len(x) // 24 for b in out for x, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if g)


def test_long_runs_send_texts_and_not_pairs():
    family = [f"{' '.join(f'w{k}' for k in range(20))} own{j} more{j}" for j in range(300)]
    assert _runs_of(family, 100) == (0, 300)
    assert _runs_of(family, 300) == (300 * 299 // 2, 0)
    # runs end where sizes can't be partners
    sizes = [f"{' '.join(f'w{k}' for k in range(10))} {' '.join(f'{j}x{k}' for k in range(j % 2 * 60))}" for j in range(100)]
    assert _runs_of([*sizes[::2][:1], *sizes[1::2]], 50)[1] == 0


def test_shared_counts_and_stars():
    r = np.random.default_rng(1)
    a, b = ([np.unique(r.integers(0, high, 50).astype(np.uint64)) for high in (60, 60, 60, 5000, 10**9)] for _ in range(2))
    a, b = a * 30, b * 20
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert (ngram_join._shared(a, b) == want).all()
    assert (ngram_join._shared(a[:1], [np.array([10**18], np.uint64)]) == 0).all()
    link = np.zeros((4, 3), bool)
    link[0, 1] = link[2, 1] = link[2, 2] = link[3, 0] = True
    row, column = ngram_join._stars(link)
    assert row.tolist() == [0, -1, 0, 3] and column.tolist() == [3, 0, 0]


def test_sketch_grows_with_the_corpus(docs, monkeypatch):
    """What falls into a cell by chance doesn't hide n-grams of 25 texts, however many texts there are."""
    for name, value in (("LEAST_BITS", 12), ("MOST_BITS", 20), ("CHUNK_BITS", 12)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(5)
    words = [f"w{i}" for i in range(20000)]
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [" ".join(r.choices(words, k=200)) + (f" {shared}" if i < 25 else "") for i in range(2000)]
    units = docs(list(enumerate(texts))).select("text")
    hot = np.unique(next(s for _, s in ngram_join._sets(pa.array([shared]), 3)))
    rare = np.unique(np.concatenate([s for _, s in ngram_join._sets(pa.array(texts[25:]), 3)]))
    bits = ngram_join.sketch_bits(sum(map(len, texts)))
    table, total = ngram_join.frequency_classes(units, 3, bits)
    assert total == sum(len(s) for _, s in ngram_join._sets(pa.array(texts), 3)) and len(table) == 1 << bits
    cls = lambda s: table[(s >> np.uint64(64 - bits)).astype(np.int64)]
    assert (cls(hot) >= 4).all() and (cls(rare) >= 4).mean() < 0.01


def test_packed_counts():
    for counts in (np.zeros(64, "<u2"), np.arange(64).astype("<u2"), np.where(np.arange(1 << 18) % 70001 == 5, 65535, 0).astype("<u2")):
        out = np.zeros(len(counts), np.int64)
        at, count = ngram_join._unpack_counts(ngram_join._pack_counts(counts))
        out[at] += count
        assert (out == counts).all()


def test_choose_prefix_never_loses():
    r = random.Random(5)
    for _ in range(3000):
        na, nb = r.randint(1, 60), r.randint(1, 60)
        universe = list(range(90))
        a, b = set(r.sample(universe, na)), set(r.sample(universe, nb))
        if r.random() < 0.7:
            b = set(list(a)[: r.randint(1, na)]) | set(r.sample(universe, r.randint(0, 10)))
        t = 0.5
        if len(a & b) < t * len(a | b) - 1e-9:
            continue
        order = {x: k for k, x in enumerate(r.sample(universe, len(universe)))}
        sizes, ls, prefixes = [], [], []
        for s in (a, b):
            need = int(ngram_join.overlap_needed(len(s), t))
            m = r.randint(1, need)
            prefixes.append(set(sorted(s, key=order.get)[: len(s) - need + m]))
            sizes.append(np.array([len(s)]))
            ls.append(np.array([m]))
        assert len(prefixes[0] & prefixes[1]) >= ngram_join.shared_needed(sizes[0], sizes[1], ls[0], ls[1], t)[0]


def test_empty_tables(docs):
    empty = docs([])
    assert exact_dedup.find_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert ngram_join.near_classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0
