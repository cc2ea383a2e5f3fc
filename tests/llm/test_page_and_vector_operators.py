"""Pages, archives, vectors and the pipeline."""

import collections
import gzip
import time
import zlib

import numpy as np
import pytest

from matchlake.llm import ann, components, html, warc
from matchlake.llm.shared import new_path
from tests.compare import duck_rows, spark_rows

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header><div id="cookie-notice">We use cookies to give you the best service ever on this page.</div>
<nav><a href=x>Home</a></nav><main><article><header><h1>Big &amp; news</h1></header><p>First   para<br>graph with <a href=y>a link</a> inside.<p>Second &lt;b&gt; one &copy
<aside>Side bar text here about other things of no interest at all</aside><p>Short.</p><form><label>Mail me your address</label><input></form>
<div class="comments"><p>I think this is really great, thanks for all of the long text in here</p></div></article></main><div class=sidebar><p>Other news</div><footer>c 2020</footer><script>if(a<b) x("</p>")</script>"""
PLAIN = """<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>The title of the thing</h1><p>A long paragraph of text with many words that should be seen as content because it has no links whatever.</p>
<p>Another long paragraph of text with many words that should be seen as content, too, I hope so.</p><ul><li><a href=3>Link one</a><li><a href=4>Link two</a></ul>"""


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, PLAIN), (3, "u", None), (4, "u", ""), (5, "u", "<p>" + "word " * 60_000), (1, "u", PAGE), (None, "u", "<article><p>A &am")]
    got = html.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == "Big & news\nFirst para graph with a link inside.\nSecond <b> one ©\nShort."
    assert by[2].text.startswith("The title of the thing\nA long") and by[2].text.endswith("I hope so.")
    assert by[3].text == by[4].text == "" and by[5].n_chars == 5 * 60_000 - 1 and by[None].text == "A &am"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_is_the_article(spark, data):
    """The table's pages hold their text in <article>; blocks are cut there by hand."""
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html.op3(spark, data).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r.text == "\n".join(p for p in parts if p)


LONG = " ".join(f"word{i}" for i in range(20))


@pytest.mark.parametrize(("page", "want"), [
    (f"<head><title>T</title><p>{LONG}</p><p>Short one.</p>", f"{LONG}\nShort one."),  # the head has no end tag
    (f"<body><button>Go<p>{LONG}</p><p>Short.</p>", f"{LONG}\nShort."),
    (f"<body class='single no-sidebar'><p>{LONG}</p><p>Short.</p>", f"{LONG}\nShort."),
    (f"<body class='has-comments'><article><p>{LONG}</p></article>", LONG),
    (f"<article class='post tag-news share-on'><h1>Title</h1><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f"<body><form id=page><div class=nav><a href=x>Home</a></div><h1>Title</h1><p>{LONG}</p><p>Tail.</p></form>", f"Title\n{LONG}\nTail."),
    ("Just text here, no tags &amp; more", "Just text here, no tags & more"),
    (f"<div><h1>T t</h1><p>{LONG}</p><p>{LONG}</p><p>Last few words here</p></div>", f"T t\n{LONG}\n{LONG}\nLast few words here"),
    (f"<article><div class='entry-header'><h1>Title here</h1></div><p>{LONG}</p><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul><p>end</p></article>", f"Title here\n{LONG}\nLink one\nLink two\nend"),
    (f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><h3>2 Comments</h3><p>{LONG}</p><p>{LONG}</p>", f"Title\n{LONG}\n{LONG}"),
])
def test_main_text_of_odd_markup(page, want):
    assert html.main_text(page, html.train_tree(html.labelled_blocks())) == want


def test_short_lines_of_what_stands_apart_are_no_text():
    tree, title = html.train_tree(html.labelled_blocks()), f"<h1>Title here</h1><p>{LONG}</p>"
    for name in ("sidebar", "ad", "notice", "promo", "related"):
        for words in ("Other", "Other news", "Other news here", "Other news here Other news"):
            for part in (f"<p>{words}</p>", f"<p>{words}.</p>", words, f"<h3>{words}</h3>", f"<ul><li>{words}<li>{words}</ul>"):
                apart = f"<div class={name}>{part}</div>"
                for page in (f"<nav><a href=x>Home</a></nav><article>{title}<p>Short.</p></article>{apart}", f"{title}<p>Short.</p>{apart}", f"<main>{title}{apart}<p>Short.</p></main><footer>c 2020</footer>"):
                    assert html.main_text(page, tree) == f"Title here\n{LONG}\nShort.", page


def test_time_does_not_grow_with_the_square_of_the_depth():
    import time

    began = time.process_time()
    found = html.blocks("<div>" * 20_000 + "x y z" + "</div>" * 20_000)
    assert [b[0] for b in found] == ["x y z"] and time.process_time() - began < 5


def test_tree_tells_blocks_of_pages_that_it_has_not_seen():
    right = []
    for i in range(8):
        tree = html.train_tree(html.labelled_blocks([p for k, p in enumerate(html.PAGES) if k % 8 != i], draws=4))
        right += [html.classify(tree, r[:-1]) == r[-1] for r in html.labelled_blocks(html.PAGES[i::8], draws=4, seed=5)]
    assert np.mean(right) > 0.9
    tree = html.train_tree(html.labelled_blocks())
    assert np.mean([html.classify(tree, r[:-1]) == r[-1] for r in html.labelled_blocks(seed=11)]) > 0.99


# ---- archives


def test_archives_are_the_sql(spark, data):
    assert spark_rows(warc.op10(spark, data)) == duck_rows(warc.OP10_SQL, data)


def test_odd_pages_come_back(spark):
    long = "é" * 700_000
    rows = [(1, "u", None), (2, None, "x" * 2000), (3, "a b\n\u0001", "x" * 2000), (None, "q", "x" * 2000), (3, "z", "x" * 2000), (4, "q", "ééé\r\n\r\nWARC/1.1"), (5, "l", long), (6, "q", "y" * 999), (7, "q", "y" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    t = warc.Tables(spark, "test")
    folder = new_path(spark, "archives")
    whole = warc.write_archives(warc.with_revisits(pages, t), f"{folder}/whole")
    index = warc.normalise(spark, whole, f"{folder}/records")
    got = sorted(((r.page_id, bytes(r.payload).decode() if r.payload is not None else None, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index).collect()), key=str)
    x = "x" * 2000
    want = [(1, "", 0, "response", None), (2, None, 2000, "revisit", 3), (3, x, 2000, "response", None), (3, x, 2000, "response", None), (None, None, 2000, "revisit", 3), (4, rows[5][2], 18, "response", None), (5, long, 1_400_000, "response", None), (6, "y" * 999, 999, "response", None), (7, "y" * 999, 999, "response", None)]
    assert got == sorted(want, key=str)
    # the normalised file is the same stream, a member a record, and the sidecar tells where each begins
    for name in {r.file for r in index.collect()}:
        source = name.replace("/records/", "/whole/").removeprefix("file:")
        path = name.removeprefix("file:")
        assert gzip.open(path).read() == gzip.open(source).read()
        for line in open(path + ".idx"):
            offset, length = map(int, line.split("\t")[:2])
            raw = open(path, "rb").read()[offset : offset + length]
            assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\n")


def test_archives_that_are_cut_off_are_errors(tmp_path):
    good = gzip.compress(warc._record(1, "u", b"abc" * 100, "00" * 20, None))
    for name, raw, message in (("cut", good[:-20], "ends inside"), ("no", b"nothing", "not a gzip"), ("half", gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx"), "ends inside a record"), ("other", gzip.compress(b"hello\r\n\r\n"), "no WARC record")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError, match=message):
            warc._rewrite(str(tmp_path / name), str(tmp_path / f"{name}.out"))
    (tmp_path / "two").write_bytes(good + good)  # members of their own are read, too
    assert len(warc._rewrite(str(tmp_path / "two"), str(tmp_path / "two.out"))) == 2


def test_no_pages(spark):
    t = warc.Tables(spark, "test")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(warc.with_revisits(none, t), new_path(spark, "archives"))
    assert files == [] and warc.read_records(warc.normalise(spark, files, new_path(spark, "archives"))).count() == 0


# ---- vectors


def brute(rows, k=10, every=100):
    """query -> [(vec_id, distance)]"""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {q: sorted(((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q))[:k] for q, x in good if q % every == 0}


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 320)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    odd = [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None, *[0.0] * 6]), (2300, [float("nan")] * 8), (2400, [float("inf"), *[0.0] * 7]), (2500, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<float>, label int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows + odd]
    got = collections.defaultdict(list)
    for r in ann.search(df, parts=1, block=64).collect():  # blocks and groups, but all of them
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(as_float)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want[q]] and np.allclose([s for _, _, s in sorted(found)], [d for d, _ in want[q]])
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [4.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1), (0, 2, 2)]


def test_recall_of_the_table(spark, data):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = collections.defaultdict(set)
    for r in ann.op6(spark, data).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & got[ids[q]])
    assert hits / (10 * len(got)) >= 0.9


def test_learned_parts_are_balanced_and_route_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 4
    x = centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16))
    graph = ann.neighbours(x, 10)
    part = ann.balanced_parts(x, graph, 8)
    assert np.ptp(np.bincount(part)) <= 1
    crossing = lambda p: (p[np.repeat(np.arange(2000), 10)] != p[graph.ravel()]).mean()
    assert crossing(part) < 0.5 * crossing(rng.permutation(part))
    assert ann.train_index(x, 8).probes <= 4


def _recall(got, x, ids, k, every):
    hits = queries = 0
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(got[ids[q]]) == k
        hits, queries = hits + len(set(ids[np.lexsort((ids, d))[:k]]) & got[ids[q]]), queries + 1
    return hits / (k * queries)


def _clusters(spark, n):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(12, 8)) * 4)[rng.integers(0, 12, n)] + rng.normal(size=(n, 8))
    return x, np.arange(n), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def _found(df):
    got = collections.defaultdict(set)
    for r in df.collect():
        got[r.query_id].add(r.vec_id)
    return got


def test_parts_cut_twice_find_the_neighbours(spark):
    x, ids, df = _clusters(spark, 1500)
    assert _recall(_found(ann.search(df, every=10, parts=12, parts_a_router=4)), x, ids, 10, 10) >= 0.9


def test_queries_with_small_parts_go_through_the_others(spark):
    x, ids, df = _clusters(spark, 300)
    # One part a query holds about 40 vectors; 120 are asked for, and all are found.
    assert _recall(_found(ann.search(df, k=120, every=20, parts=8, target=0.0)), x, ids, 120, 20) > 0.5
    assert _recall(_found(ann.search(df, k=299, every=20, parts=8, target=0.0)), x, ids, 299, 20) == 1


def test_repeated_query_ids_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [4.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_parts_grow_with_the_root_of_the_rows():
    assert [ann.parts_for(n) for n in (0, 1, 10_000, 1_000_000)] == [1, 1, 25, 250]


# ---- components and the pipeline


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    up = list(range(600))
    find = lambda i: i if up[i] == i else find(up[i])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for pair in links if pair[0] != pair[1] for i in pair}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_components, check_packed

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = new_path(spark, f"test-stage-{k}")
        stage(spark, docs, data).write.parquet(path)
        before, after = docs.collect(), spark.read.parquet(path)
        if name != "best-fit packing":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = collections.Counter(r.doc_id for r in rows)
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q]
            assert sum(i in ids for i in good) > 0.98 * len(good) and sum(i in ids for i, q in labels.items() if not q) <= 1
        elif name == "language ID":
            assert len(rows) > 0.98 * len(before)
        elif name == "MinHash near-dedup":
            assert set(ids) == {i for i, v in brute_components([(r.doc_id, r.text) for r in before]).items() if v[2]} and max(ids.values()) == 1
        elif name == "mixing sources to target weights":
            assert max(ids.values()) <= 2 and sum(len(r.text.split()) for r in rows) == pytest.approx(1.5 * sum(len(r.text.split()) for r in before), rel=0.05)
        else:
            check_packed(rows, {(r.doc_id, r.text) for r in before})
        docs = after


def test_pipeline_of_odd_rows(spark, data):
    """Null ids, repeated rows, unlike rows of one id, empty and long texts, and columns that have the operators' names."""
    import corpus_pipeline
    from tests.llm.test_text_operators import prose

    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(40)] + [(None, prose(50), "en", None)] * 3 + [(None, prose(51), None, "s1"), (7, prose(7), "en", "s1"), (8, prose(60), "de", "s2"), (90, None, "en", "s0"), (91, "", None, None), (92, " \n", "en", "s0"), (93, "word " * 30_000, "en", "s0"), (94, "12 34 !?", "en", "s1")]
    names = "host path evidence _evidence _label _copies _row _set"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names.split()))
    for none in (True, False):
        now = docs.limit(0) if none else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = new_path(spark, f"odd-stage-{k}")
            stage(spark, now, data).write.parquet(path)
            after = spark.read.parquet(path)
            assert name == "best-fit packing" or after.columns == docs.columns
            assert not none or after.isEmpty()
            if name == "MinHash near-dedup":
                kept = collections.Counter((r.doc_id, r.text) for r in after.collect())
                assert max(kept.values(), default=1) == 1 and set(kept) <= {(r.doc_id, r.text) for r in now.collect()}
            now = after


# ---- 3: pages whose tags and names say little, or the wrong thing

STORY = "The river rose over the old stone bridge in March, and nobody in the village slept that night. Later, when the water had gone, the baker opened his shop as if nothing had happened. " * 4
THREE = "".join(f"<p>{STORY}</p>" for _ in range(3))
TOP = "<nav><a href=a>a</a></nav>"
LONG_PAGES = {
    "two divs": (f"{TOP}<div>{STORY}</div><div>{STORY}</div>", 2), "cell": (f"<table><tr><td><a href=h>Home</a></td><td>{STORY}<br>{STORY}</td></tr></table>", 2), "breaks": (f"<div>{TOP}{STORY}<br><br>{STORY}</div>", 2),
    "section": (f"{TOP}<main><section class=legal>{THREE}</section></main><footer>x y</footer>", 3), "articles": (f"<main><article><h2>First title here</h2>{THREE}</article><article><h2>Second title here</h2>{THREE}</article></main>", 6),
    "header": (f"{TOP}<div class='page-header'><h1>A title of words</h1></div>{THREE}", 3),
    **{c: (f"{TOP}<div class='{c}'>{THREE}</div><footer>x y</footer>", 3) for c in ("search", "legal", "post legal", "contact-form", "topic-social", "widget", "my-banner")},
}


@pytest.fixture(scope="module")
def page_tree():
    return html.train_tree(html.labelled_blocks())


@pytest.mark.parametrize("name", LONG_PAGES)
def test_long_text_is_kept_whatever_it_is_called(page_tree, name):
    page, n = LONG_PAGES[name]
    text = html.main_text(page, page_tree)
    assert text.count("river") == 4 * n and text.lower().count("title") == page.lower().count("title ") and "x y" not in text


def test_foreign_blocks_within_an_article(page_tree):
    page = f"<article><h1>A title</h1><p>{STORY}</p><div class='ad-slot'><p>Buy this now for less.</p></div><p>{STORY}</p><div><a href=x>Great offers on all shoes today</a></div><p>{STORY}</p></article><div class=xyz><h3>Comments</h3><div>Anna</div><p>I like this very much, thanks.</p></div>"
    text = html.main_text(page, page_tree)
    assert text.startswith("A title\n") and text.count("river") == 12 and not any(x in text for x in ("Buy", "offers", "Anna", "like this"))


HOSTILE = ['<a href="' * 8000, "<form>" + "<div>x" * 4000 + "<section>y" * 4000, "<!--" * 32_000, "<" * 64_000, "&" * 60_000, "<a " + "b " * 30_000 + ">", "<script>" * 8000, "<![CDATA[" * 8000, "<div>" * 12_000 + "x"]


@pytest.mark.parametrize("page", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_pages_take_no_longer_than_others(page_tree, page):
    began = time.process_time()
    html.main_text(page, page_tree)
    assert time.process_time() - began < 1


def test_markup_that_never_ends():
    assert html.whole_markup("a <b>x</b> <!-- y") == "a <b>x</b> " and html.whole_markup("a <b>x</b> <i class='") == "a <b>x</b> " and html.whole_markup("1 < 2 <!-- z --> 3") == "1 < 2 <!-- z --> 3"
    assert html.whole_markup("") == "" and html.whole_markup("no tags") == "no tags"
