"""Text, vector, path, HTML and word-piece functions."""

import html as html_lib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseek.functions import text as ft
from loomseek.functions.arrays import slices
from loomseek.functions import vectors as fv
from loomseek.functions.html import HIDDEN_TAGS, VOID, PageRules, page_sections
from loomseek.functions.paths import path_matches
from loomseek.functions.wordpiece import WordPiece, word_ids
from loomseek.operators.chunking import spans


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


def test_normalize_and_tokens(spark):
    assert one(spark, ft.normalize, "Café\x00\x07\t中！") == "cafe  中 ！"
    assert one(spark, lambda x: ft.pre_tokenize(ft.normalize(x)), "Naïve can't + 中") == ["naive", "can", "'", "t", "+", "中"]
    assert one(spark, lambda x: ft.lexical_terms(ft.normalize(x)), "Naïve can't + 中") == ["naive", "can", "t", "中"]
    assert one(spark, ft.normalize, None) is None
    assert one(spark, ft.normalize, "ΣΑΣ") == "σας"


def test_normalize_against_a_loop(spark):
    r = random.Random(1)
    alphabet = "aB é Ü ß Ω İ 中 한 😀 ́ ​ \x01 \n \t - $ ' 3 ½ ﬁ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]

    def loop(text):
        out = ""
        for c in text:
            if c in "\t\n\r":
                out += " "
            elif c == "�" or unicodedata.category(c).startswith("C"):
                continue
            else:
                out += f" {c} " if 0x4E00 <= ord(c) <= 0x9FFF else c
        return "".join(c for c in unicodedata.normalize("NFD", out.lower()) if unicodedata.category(c) != "Mn")

    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", ft.normalize(F.col("x"))).collect()
    assert [g[1] for g in sorted(got)] == [loop(t) for t in texts]


def test_collapse_and_sentences(spark):
    assert one(spark, ft.collapse, " a  b\n\nc ") == "a b c"
    assert one(spark, lambda x: ft.sentences(ft.collapse(x)), 'One. two! Three? "Four" (five). 6.') == ["One. two!", "Three?", '"Four" (five).', "6."]


def test_spans_formula():
    r = random.Random(2)
    for _ in range(3000):
        lens = [r.randint(1, 40) for _ in range(r.randint(1, 30))]
        size = r.randint(1, 120)
        overlap = r.randint(0, size - 1)
        p = np.concatenate([[0], np.cumsum(np.array(lens) + 1)])
        want, s, n = [], 0, len(lens)
        while True:
            e = max(s + 1, max((e for e in range(s, n + 1) if p[e] - p[s] - 1 <= size), default=0))
            want.append((s, e))
            if e == n:
                break
            s = max(s + 1, max((j for j in range(e + 1) if p[e] - p[j] >= overlap), default=0))
        row, first, end = spans(np.array(lens * 2), np.array([0, n, n, 2 * n]), size, overlap)
        assert [(int(a), int(b)) for r_, a, b in zip(row, first, end) if r_ == 0] == [(int(a), int(b)) for r_, a, b in zip(row, first, end) if r_ == 2] == want and 1 not in row


def test_vectors(spark):
    scale = lambda v: one(spark, lambda x: F.struct(fv.row_scale(x), fv.quantize(x, fv.row_scale(x))), v, "array<float>")
    s, q = scale([2.0, -1.0])
    assert abs(s - 2 / 127) < 1e-7 and q == [127, -64]
    assert scale([0.0, 4.0])[1] == [0, 127] and tuple(scale([0.0, 0.0])) == (1.0, [0, 0])
    assert one(spark, fv.to_int8, [0.5, -0.5, 2.0], "array<double>") == [64, -64, 127]
    assert one(spark, lambda x: fv.to_int8(x, half_up=True), [0.5, -0.5], "array<double>") == [64, -63]
    assert one(spark, fv.unit, [0.0, 0.0], "array<double>") == [0.0, 0.0]


@pytest.mark.parametrize(("path", "pattern", "expected"), [
    ("a.md", "a.md", True), ("x/y/b.md", "x", True), ("x/y/b.md", "x/", True), ("x/y/b.md", "x/*.md", False), ("x/y/b.md", "x/**/*.md", True), ("x/b.md", "x/**/*.md", True),
    ("a.md", "**/*.md", True), ("api/t/B.md", "api/**", True), ("api", "api/**", True), ("p/f.md", "x/**", False), ("x/y/b.md", r"x\y\*.md", True), ("./x/b.md", "x/?.md", True),
    ("x/c.md", "x/[ab].md", False), ("x/c.md", "x/[!ab].md", True), ("xy/b.md", "x", False), ("a.b", "a?b", True), ("a+b.md", "a+b.md", True)])
def test_paths(spark, path, pattern, expected):
    assert one(spark, lambda x: path_matches(x, pattern), path) is expected


def test_html_sections():
    page = page_sections('<p>Intro <b>bo</b>ld &amp; more</p><h2 id="a">First <a class="headerlink">#</a></h2><p>One.</p><pre>hidden</pre><div data-search-exclude><p>no</p></div><h3>Empty</h3><h2>Last</h2><br/>end<code>x</code>')
    assert page["sections"] == [{"text": "Intro bo ld & more", "heading": None, "anchor": None}, {"text": "One.", "heading": "First", "anchor": "a"}, {"text": "end", "heading": "Last", "anchor": None}]
    assert "Empty" in page["text"] and "hidden" not in page["text"] and "#" not in page["text"]
    assert page_sections("a <svg><p>b</svg> c")["text"] == "a" and page_sections("")["sections"] == []
    own = PageRules(classes=frozenset(["secret"]), attributes=frozenset(["data-x"]))
    assert page_sections('<p class="a secret">x</p><p data-x>y</p><p class="no-index">z</p>', own)["text"] == "z"
    assert page_sections('<p class="no-index">z</p>w')["text"] == "w" and page_sections('<h1 id="">T</h1>x')["sections"] == [{"text": "x", "heading": "T", "anchor": None}]


def literal_sections(html):
    """Sections by cutting the page with a regular expression: only for pages without comments, scripts or broken tags."""
    hidden, heading, open_ = [], None, None
    out, text = [["", None, ""]], ""
    for tag, data in re.findall(r"(<[^>]*>)|([^<]+)", html):
        name = re.match(r"</?\s*([a-z0-9]*)", tag)[1] if tag else ""
        if data:
            if not hidden:
                text += " " + data
                out[-1][2 if open_ is None else 0] += " " + data
        elif tag.startswith("</"):
            if hidden:
                hidden = hidden[:-1] if hidden[-1] == name else hidden
            elif name == open_:
                open_ = None
        elif tag.endswith("/>"):
            continue
        elif hidden or name in HIDDEN_TAGS:
            hidden += [] if name in VOID else [name]
        elif re.fullmatch("h[1-6]", name):
            open_ = name
            anchor = re.search(r'\sid="([^"]*)"', tag)
            out.append(["", (anchor[1] or None) if anchor else None, ""])
    flat = lambda x: " ".join(html_lib.unescape(x).split())
    return flat(text), [(flat(t), flat(h) or None, a) for h, a, t in out if flat(t)]


def test_html_against_a_literal_cut():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<h1>", "</h1>", '<h2 id="x">', "</h2>", '<h3 id="">', "</h3>", "<code>", "</code>", "<svg>", "</svg>", "<br>", "<br/>", "one ", " two", "&amp;", "é 中", "<b>", "</b>", "\n"]
    for _ in range(2000):
        html = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        got = page_sections(html)
        assert (got["text"], [(x["text"], x["heading"], x["anchor"]) for x in got["sections"]]) == literal_sections(html), html


def test_word_pieces(spark):
    ids = {t: i for i, t in enumerate(["[UNK]", "play", "##ing", "player", "'", "t", "中"])}
    shared = spark.sparkContext.broadcast(ids)
    got = one(spark, lambda x: word_ids(ft.pre_tokenize(ft.normalize(x)), shared), "Playing mystery 中")
    assert got == [1, 2, 6]
    assert one(spark, lambda x: word_ids(ft.pre_tokenize(ft.normalize(x)), shared), "x" * 101) == []
    assert WordPiece().word("players", ids) == []
    with pytest.raises(ValueError):
        WordPiece(longest_word=0)


def test_word_pieces_against_a_loop(spark):
    r = random.Random(5)
    ids = {t: i for i, t in enumerate(["[UNK]", "a", "ab", "abc", "##a", "##bc", "##b", "##cab", "中", "."])}
    shared = spark.sparkContext.broadcast(ids)
    rows = [[("".join(r.choice("abc") for _ in range(r.randint(1, 9)))) for _ in range(r.randint(0, 5))] for _ in range(300)] + [None, [], ["中", ".", "[UNK]"]]

    def loop(word):
        out, at = [], 0
        while at < len(word):
            n = max((k for k in range(1, len(word) - at + 1) if ("##" if at else "") + word[at: at + k] in ids), default=0)
            if not n:
                return []
            out.append(ids[("##" if at else "") + word[at: at + n]])
            at += n
        return [x for x in out if x]

    got = spark.createDataFrame(list(enumerate(rows)), "i int, w array<string>").select("i", word_ids(F.col("w"), shared)).collect()
    assert [g[1] for g in sorted(got)] == [None if w is None else [i for x in w for i in loop(x)] for w in rows]


def test_tokens_and_counts(spark):
    assert one(spark, ft.tokens, None) == [] and one(spark, ft.tokens, "A b, B!") == ["a", "b", ",", "b", "!"]
    rows = [["b", "a", "b", ".", "é1"], [], None, ["."]]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t array<string>").select("i", ft.counted_terms(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(g.c.dl, dict(zip(g.c.terms, g.c.tfs))) for g in got] == [(4, {"b": 2, "a": 1, "é1": 1}), (0, {}), (0, {}), (0, {})]
    assert one(spark, ft.casefold, "Straße") == "strasse" and one(spark, ft.casefold, None) is None


def test_links_and_templates(spark):
    row = spark.createDataFrame([("/a", "b"), ("/a#x", "b"), ("/a", None)], "h string, a string").select(ft.with_anchor(F.col("h"), F.col("a"))).collect()
    assert [r[0] for r in row] == ["/a#b", "/a#x", "/a"]
    assert one(spark, lambda x: ft.fill(x, query=F.lit("q"), count=F.lit(2)), "{count} for {query}") == "2 for q"
    assert re.fullmatch("[0-9a-f]{12}", one(spark, ft.content_hash, "x"))


def test_split_tokens_equals_tokens(spark):
    """The tokens of a worker's own pass are those of the functions on columns, for any text, in any company."""
    r = random.Random(4)
    alphabet = [*"aB é Ü ß Ω İ 中 한 😀 ́ ​ \x01 \n \t - $ ' 3 ½ ﬁ Σ ς ñ ¿ “ 豈 々 ー", "‍", "�", "\x0b", "\x1f", "\x85", " ", "ͅ", "ཾ", "\U0002f801", "\U00020001"]
    texts = ["".join(r.choice(alphabet[:30] if i % 3 else "ab é.Ü") for _ in range(r.randint(0, 40))) for i in range(600)] + ["".join(r.choice(alphabet) for _ in range(30)) for _ in range(300)] + [None, ""]
    want = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", ft.tokens(F.col("x"))).collect())]
    for cut in (1, 7, len(texts)):
        got = []
        for i in range(0, len(texts), cut):
            found, off = ft.split_tokens(pa.array(texts[i: i + cut], pa.string()))
            got += [found[a:b].to_pylist() for a, b in zip(off[:-1], off[1:], strict=True)]
        assert got == want


def test_texts_are_counted_in_slices(spark):
    """A batch of any size leaves a worker in pieces of bounded size."""
    texts = pa.array(["word " * 50_000] * 12)
    assert [j - i for i, j in slices(texts)] == [4] * 3
    rows = [(0, "Ab ab, c"), (1, None), (2, ""), (3, "ab")]
    df = spark.createDataFrame(rows, "i int, x string")
    assert [(r.t.dl, dict(zip(r.t.terms, r.t.tfs, strict=True))) for r in sorted(df.select("i", ft.text_terms(F.col("x")).alias("t")).collect())] == [(3, {"ab": 2, "c": 1}), (0, {}), (0, {}), (1, {"ab": 1})]
    assert {(r.term, r.n) for r in ft.rows_with(df, F.col("x")).collect()} == {("ab", 2), ("c", 1)}


def test_pages_are_parsed_in_slices(monkeypatch):
    """No list of parsed pages is longer than a slice of the batch, whatever Spark puts into one."""
    from loomseek.functions import html as fh

    seen = []
    monkeypatch.setattr(fh.pa, "array", lambda rows, kind: (seen.append(len(rows)), pa.lib.array(rows, kind))[1])
    pages = pa.lib.array(["<h1>T</h1>" + "x " * 150_000] * 9 + [None])
    got = list(fh.parsed(iter([pages]), PageRules()))
    assert max(seen) == 4 and sum(map(len, got)) == 10 and got[-1][-1].as_py() is None and got[0][0].as_py()["sections"][0]["heading"] == "T"
