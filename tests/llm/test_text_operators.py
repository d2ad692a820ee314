"""Operators that look at one text or page at a time: BPE, licenses, HTML, quality."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, html_text, licenses, quality
from ledgerspark.llm.common import text_buffer

TRICKY = [" ", "  ", "\n", "\t", "\r\n", "'", "'s", "'ll", "don't", "é", "ß", " ", "　", " ", "\u0085", "\x1c", "日本", "🙂", "a", "The", " the", "123", "٣", "#", "$$$", "\"'", "§", "<|endoftext|>", "<|end", "́", "\x00", "_", "�"]


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_tokenizer(), "rb") as f:
        return bpe.ForcedBoundaryBPE(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def ids(encoder, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(encoder.encode(raw, np.array([0, len(raw)]))[0], np.int32)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(TRICKY), max_size=12).map("".join)))
def test_bpe_is_the_library(encoder, library, text):
    got = ids(encoder, text)
    want = library.encode(text, add_special_tokens=False).ids
    assert got.tolist() == want
    assert encoder.decode(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_bpe_long_words(encoder, library):
    for text in ("a" * 3000, "ab" * 2000, "€" * 1500, "x" * 64 + " " + "y" * 65):
        assert ids(encoder, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (3, "", "y"), (4, "a b\n" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = sorted(bpe.encode_and_decode(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.decoded for r in out] == ["Hello world", "Hello world", "", "a b\n" * 5000, ""]
    assert out[0].ids == library.encode("Hello world").ids and out[4].ids == []
    assert bpe.encode_and_decode(docs.where("false")).count() == 0


def edits(pattern, text):
    """Least edits of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_fuzzy_notices_against_edit_distance():
    rng = random.Random(5)
    scanner = licenses.LicenseScanner({}, {"released under the mit license": "mit", "mozilla public license": "mpl"})
    texts = []
    for _ in range(400):
        notice = list(rng.choice([n.words.decode() for n in scanner.notices]))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(notice))
            notice[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "e ", "q"])
        texts.append("some words " * rng.randint(0, 2) + "".join(notice) + " more" * rng.randint(0, 2))
    raw, offsets = text_buffer(pa.array(texts))
    _, _, found = scanner.scan(raw, offsets)
    for text, spans in zip(texts, found):
        plain = " ".join(regex.findall(r"[0-9a-z]+", text))
        for notice in scanner.notices:
            least = edits(notice.words.decode(), plain)
            mine = [e for label, _, _, e, _ in spans if label == notice.label]
            assert bool(mine) == (least <= notice.edits), (text, notice.words)
            if mine:
                assert min(mine) == least


def test_near_matches_of_a_long_text_take_linear_time():
    import time

    scanner = licenses.LicenseScanner()
    took = []
    for n in (2_000, 20_000):
        raw = np.frombuffer(b"all rights resorved " * n, np.uint8)
        began = time.time()
        spans = scanner.scan(raw, np.array([0, len(raw)]))[2][0]
        took.append(time.time() - began)
        assert [s[1] for s in spans] == list(range(0, 3 * n, 3)) and {s[3] for s in spans} == {1}
    assert took[1] < 25 * took[0] + 1


def test_license_rows(spark):
    rows = [
        (1, "Under the GNU General\nPublic-License!", None), (2, "cc by; CC-BY accbyx", None), (3, None, None), (4, "", None), (5, "gnu general public", None), (6, "license mit", None),
        (7, "Permission is herebby granted, free of charge, to any person obtaining a copy", None), (7, "x " * 50_000 + "MIT license", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, exact string")
    out = {}
    for r in licenses.license_places(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    one = lambda k: out[k][0]
    assert [(x.word, x.label) for x in one(1).exact] == [(2, "gpl")] and one(1).n_words == 6
    assert [x.word for x in one(2).exact] == [0, 2] and one(2).n_words == 5
    assert one(3).n_words == one(4).n_words == 0 and one(3).exact == one(6).exact == []
    long = next(r for r in out[7] if r.n_words > 100)
    assert [(x.word, x.label) for x in long.exact] == [(50_000, "mit")]
    short = next(r for r in out[7] if r.n_words < 100)
    assert [(s.label, s.errors) for s in short.spans] == [("mit", 1)]
    assert licenses.license_places(docs.where("false")).count() == 0


def test_distinguishing_words_of_notices(spark):
    texts = {
        "Licensed under CC BY 4.0": set(), "licensed under CC BY-SA": set(), "licensed under CC-BY-ND 4.0": set(), "licensed under cc by ncd": set(),
        "liicensed unnder cc by ncd": set(), "Released under the BSD license": set(), "Released under the ISC license": set(),
        "Licensed under CC BY-NC 4.0": {("cc-by-nc", 0)}, "licenced under CC BY-NC-SA": {("cc-by-nc", 1)}, "licenced undr cc by nc": {("cc-by-nc", 2)}, "lcenced undr cc by nc": set(),
        "Relaesed under the MIT license": {("mit", 2), ("mit", 0)}, "releazed under teh MIT license": {("mit", 3), ("mit", 0)}, "released under the mt license": {("mit", 1)}, "released under the mpl license": set(), "gnu leser general public license": {("lgpl", 1)}, "gnu lesser genral public license": {("lgpl", 1)},
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: {(s.label, s.errors) for s in r.spans} for r in licenses.license_places(docs).collect()}
    assert [out[k] for k in range(len(texts))] == list(texts.values())


def test_short_notices_with_an_edit(spark):
    texts = {
        "Apache Licence 2.0": {("apache", 1)}, "the Apach License": {("apache", 1)}, "MIT Licence": {("mit", 1)}, "under the MIT License.": {("mit", 0)}, "MIT licensed": {("mit", 1)},
        "submit license": set(), "bit license": set(), "MIT lessons": set(), "MIT Licnese": set(), "a pache licence": set(), "Apache licensees": set(),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: {(s.label, s.errors) for s in r.spans} for r in licenses.license_places(docs).collect()}
    assert [out[k] for k in range(len(texts))] == list(texts.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="ad">Buy this now, it is long enough to look like text, really it is.</div><div id=cookie-banner>We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First  line<b> bold</b></p><!-- no --><p>Short.</p><p>Last &eacute;&#8364;</p><form>Search</form>
<section class="comments"><p>A reader wrote a long comment about this article here.</p></section></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_html_page():
    assert html_text.main_text(PAGE)[0] == "Title & more\nFirst line bold\nShort.\nLast é€"


def test_html_without_article():
    text = "Long text with words. " * 20
    page = f"<body><div class=menu><a href=1>Home</a></div><div class=post><p>{text}</p><p>Short.</p></div><div class=footer>x</div></body>"
    assert html_text.main_text(page)[0] == f"{text.strip()}\nShort."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Body.</p><div class='article-comments'>A comment.</div></article><article class=comment>Me too.</article>", "Body."),
        ("<body class='has-sidebar'><main class='with-header'><p>Body.</p></main><div id=sidebar>x</div></body>", "Body."),
        ("<div class='wrapper has-sidebar'><div class='entry-content'><p>Body.</p></div></div><div id='disqus_thread'>No.</div>", "Body."),
        ("<article><div class='page-header'><h1>Title</h1></div><p>Body.</p><div class='adBox'>Buy</div><aside>x</aside></article>", "Title\nBody."),
        ("<div role=navigation>Menu</div><p>Body.</p><div class=notice>Notice</div>", "Body."),
        ("<article><p>One<p>Two<div hidden>no</div><div style='display: none'>no</div><table><tr><td>a<td>b</table></article>", "One\nTwo\na\nb"),
        ("<article><p>a&nbsp;&nbsp;b\n c</p><p> &lt;p&gt; </p></article>", "a b c\n<p>"),
    ],
)
def test_html_parts(page, text):
    assert html_text.main_text(page)[0] == text


LONG = "This section has a long text of its own that says something. " * 5


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h2 id='search'>Search</h2><p id=related-work>Body.</p><p><b id=feedback>Bold</b> <span id='ad'>word</span></p></article>", "Search\nBody.\nBold word"),
        ("<article><div data-id='ad' data-class=promo><p>Body.</p></div></article>", "Body."),
        (f"<article><p>Body.</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p><p>Short.</p></section><p>End.</p></article>", f"Body.\nDiscussion\n{LONG.strip()}\nShort.\nEnd."),
        (f"<main><section class=response><p>{LONG}</p></section></main>", LONG.strip()),
        ("<article><p>Body.</p><div class=related><h3>Related</h3><ul><li><a href=1>One more story</a><li><a href=2>Another story</a></ul></div></article>", "Body."),
        (f"<article><p>Body.</p><div class=related><article><a href=1>{LONG}</a></article></div><div id=search>Search</div></article>", "Body."),
        (f"<article><p>Body.</p><section id=discussion><div class=comment>{LONG}</div></section></article><div class=related>{LONG}</div>", "Body."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> holds.</p></article>", "So x=2 holds."),
        (f"<article><p>Body.</p><noscript><p>{LONG}</p></noscript><noscript>Please enable JavaScript.</noscript></article><noscript>{LONG}</noscript>", f"Body.\n{LONG.strip()}"),
    ],
)
def test_html_ambiguous_parts(page, text):
    assert html_text.main_text(page)[0] == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<", ">", "<!--", "-->", "<a href='", "'", '"', "text", "&amp;", "&#x", "<script>", "</script>", "<b>", "<td>", "</", "<br/>", "<article>", "<nav class=x>"]), max_size=14))
def test_html_never_fails(parts):
    text, kept, dropped = html_text.main_text("".join(parts))
    assert isinstance(text, str) and kept >= 0 and dropped >= 0


def test_min_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 7)
        a, b = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 3)) for _ in range(rng.randint(0, 9))]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda x: sum(b[k] if x[k] else a[k] for k in range(n)) + sum(w for i, j, w in edges if x[i] != x[j])
        assert cost(html_text.min_cut(a, b, edges)) == min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))


def plain_page(rng):
    """A page of divs without telling names, and which of its blocks are content: paragraphs, some of a word or two,
    between a menu, a list of links with a sentence among them, and small print."""
    words = "the a of lake stone river walked green after before house was light under many slowly north winter".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    link = lambda: f"<a href='/x'>{some(rng.randint(1, 3)).capitalize()}</a>"
    out, truth = ["<body><div class=c1><div>"], []
    for _ in range(rng.randint(4, 9)):
        out.append(f"<div>{link()}</div>")
        truth.append(False)
    out.append("</div></div><div class=c2>")
    for k in range(rng.randint(6, 14)):
        short = 0 < k and rng.random() < 0.25
        out.append(f"<p>{some(rng.randint(1, 3) if short else rng.randint(15, 60)).capitalize()}{'' if short else ', ' + some(4) + '.'}</p>")
        truth.append(True)
    out.append("</div><div class=c3><ul>")
    for _ in range(rng.randint(5, 10)):
        plain = rng.random() < 0.15
        out.append(f"<li>{some(7).capitalize() + '.' if plain else link()}</li>")
        truth.append(False)
    out.append(f"</ul></div><div class=c4><div>{some(3)}</div><div>{link()} | {link()}</div></div></body>")
    truth += [False, False]
    return "".join(out), truth


def test_cut_improves_pages_without_declared_parts():
    rng = random.Random(11)
    right = {True: 0, False: 0}
    changed = total = 0
    for _ in range(150):
        page, truth = plain_page(rng)
        blocks = html_text.blocks_of(page)
        assert len(blocks) == len(truth)
        found = {smooth: html_text.labels(blocks, smooth=smooth) for smooth in (True, False)}
        for smooth, own in found.items():
            right[smooth] += sum(a == b for a, b in zip(own, truth))
        changed += sum(a != b for a, b in zip(*found.values()))
        total += len(truth)
    assert changed > 0.03 * total and right[True] > right[False] + 0.03 * total and right[True] > 0.97 * total


def test_classifier_learns_from_declared_blocks(spark):
    """A site whose paragraphs are table cells: the fitted classifier finds them on its pages without an article."""
    rng = random.Random(12)
    words = "lake stone river walked green after before house light under".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body = lambda: "".join(f"<table><tr><td>{some(14)}; {some(8)}</td></tr></table>" for _ in range(12))
    menu = "".join(f"<p>{w.capitalize()} page.</p>" for w in words)
    rows = [(k, "u", f"<nav>{menu}</nav><article>{body()}</article>") for k in range(30)]
    plain = body()
    rows.append((99, "u", f"<div>{menu}</div><div>{plain}</div>"))
    out = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[99].split("\n") == [t for t in __import__("re").findall(r"<td>(.*?)</td>", plain)]


def test_deep_nesting_is_linear():
    import resource
    import time

    page = "<div>x " * 40_000
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    html_text.main_text(page)
    assert time.time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_html_rows(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "u", "", 3), (4, "u", "<article>" + "<p>word word</p>" * 3000, 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_blocks int")
    out = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert out[None].text == out[3].text == "" and out[4].n_blocks == 3000 and out[1].text.startswith("Title")
    assert html_text.extract_text(pages.where("false")).count() == 0


def in_memory(a, b, keys=None):
    """A picker among arrays: every row scored, sorted, the best taken."""
    keys = keys or [(0, k) for k in range(len(a))]

    def pick(views, calibrations, got):
        out = {}
        for view, label in ((0, 1), (0, 0), (1, 1), (1, 0)):
            sure = quality.sureness(views[view], calibrations[view], (a, b)[view], label)
            best = sorted((-s, keys[k], k) for k, s in enumerate(sure) if s >= quality.SURE and keys[k] not in got[1 - view])[: quality.HANDED]
            at = [k for _, _, k in best]
            out[view, label] = [keys[k] for k in at], a[at], b[at]
        return out

    return pick


def test_views_teach_each_other():
    """Both views are informative, each on rows where the other is in doubt; each hands labels to the other, and the other gains."""
    rng = np.random.default_rng(3)

    def rows(n):
        y = (rng.random(n) < 0.5).astype(float)
        clear = rng.random((n, 2)) < 0.6  # where a view tells the class
        views = [np.where(clear[:, k, None], (2 * y - 1)[:, None] * [2.5, 1.5], 0) + rng.normal(size=(n, 2)) * 0.7 for k in (0, 1)]
        return *(np.column_stack([v, rng.normal(size=(n, 8))]) for v in views), y

    a, b, y = rows(200)
    pool_a, pool_b, _ = rows(4000)
    test_a, test_b, truth = rows(4000)
    side = np.arange(200) % 5
    taught = quality.co_train((side, a, b, y), in_memory(pool_a, pool_b))
    alone = quality.co_train((side, a, b, y), in_memory(pool_a, pool_b), rounds=0)
    assert {(view, label) for _, view, label, n in taught.handed if n} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    right = lambda m, k: ((m.scores(test_a, test_b)[k] >= 0.5) == truth).mean()
    assert right(taught, 2) >= right(alone, 2) and right(taught, 0) + right(taught, 1) > right(alone, 0) + right(alone, 1)


def test_quality_scores_against_direct_co_training(spark, monkeypatch):
    """The distributed rounds give the scores that sorting all rows in memory gives; ties, copies, long texts and repeated labels included."""
    from ledgerspark.llm.common import Scratch

    monkeypatch.setattr(quality, "HANDED", 25)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = [(-k, t, None, "s", 0) for k, t in enumerate(["", None, "word " * 200_000, "same text here", "same text here"], 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(7)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.where("doc_id % 7 = 0").withColumn("quality", F.lit(1)))
    work = Scratch(spark, "t")
    docs = work.write(docs, "docs")
    got = {(r._f, r._r): (r.text_score, r.meta_score, r.score) for r in quality.score(docs, labels, work).collect()}
    t = quality.features(docs, work).toPandas()
    known = labels.toPandas().groupby("doc_id").quality.max()
    stack = lambda f, c: np.stack([np.array(v, float) for v in f[c]])
    place = {r.doc_id: n for n, r in enumerate(spark.createDataFrame([(int(k),) for k in known.index], "doc_id bigint").orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    own = t[t.doc_id.isin(known.index)].sort_values(["doc_id", "_f", "_r"])
    own = own.iloc[np.argsort(own.doc_id.map(place).to_numpy(), kind="stable")]
    rest = t[~t.doc_id.isin(known.index)]
    keys = list(zip(rest._f.tolist(), rest._r.tolist()))
    model = quality.co_train((own.side.to_numpy(), stack(own, "a"), stack(own, "b"), (own.doc_id.map(known) > 0).to_numpy().astype(float)), in_memory(stack(rest, "a"), stack(rest, "b"), keys))
    want = np.stack(model.scores(stack(t, "a"), stack(t, "b")), 1)
    assert model.handed and len(got) == len(t) == 1005
    assert np.allclose(np.array([got[k] for k in zip(t._f.tolist(), t._r.tolist())]), want, atol=1e-6)


def test_quality_held_out_accuracy(spark):
    import duckdb

    con = duckdb.connect()
    t = con.sql("SELECT text, lang, source, quality FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY hash(doc_id) LIMIT 3000").df()
    raw, offsets = text_buffer(pa.array(t.text))
    a = quality.text_features(raw, offsets)
    code = lambda c, n: (t[c].map({v: k for k, v in enumerate(sorted(t[c].unique()))}) % n).to_numpy()
    b = quality.meta_features(code("lang", quality.LANGS), code("source", quality.SOURCES), t.text.str.len().to_numpy())
    y = t.quality.to_numpy().astype(float)
    model = quality.co_train((np.arange(1000) % 5, a[:1000], b[:1000], y[:1000]), in_memory(a[1000:2000], b[1000:2000]))
    score = model.scores(a[2000:], b[2000:])[2]
    good = y[2000:] == 1
    assert (score[good] >= 0.5).mean() > 0.99 and (score[~good] < 0.5).mean() > 0.9


def test_quality_rows(spark, tmp_path):
    from ledgerspark.llm.common import Scratch

    docs = spark.createDataFrame([(1, "text here", None, 5), (1, "text here", None, 5), (None, None, "s", 6), (3, "", "s", 7)], "doc_id bigint, text string, source string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality.score(docs, none, Scratch(spark, "t")).collect()
    assert len(out) == 4 and all(r.kept and r.score == 1 for r in out)
    assert quality.score(docs.where("false"), none, Scratch(spark, "t")).count() == 0
    good = [(k, "Some plain words stand here, and they go on for a while.", "s", k) for k in range(40)]
    bad = [(100 + k, "XX!! YY!! ZZ!! ### *** " * 3, "s", k) for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    mixed = spark.createDataFrame(good + bad, "doc_id bigint, text string, source string, score int")
    kept = quality.keep_good(mixed, labels, Scratch(spark, "t"))
    assert kept.columns == mixed.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))
