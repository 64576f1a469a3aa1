"""Page differencing and neighbour search."""

import random

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import htmltext, nndescent


def test_lines_of_a_page():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><nav><a>Menu</a></nav><div class="cookie-notice">ok?</div>
    <article><h1>Head &amp;\n line</h1><p>one <b>two</b> three<br>four<p>five<aside>side</aside><form>f</form></article><!-- <p>no</p> --><div id="comments"><p>reader</p></div><footer>&copy; x</footer></body></html>"""
    kept = [t for t, inside, skip in htmltext.page_lines(page) if inside and not skip]
    assert kept == ["Head & line", "one two three", "four", "five"]
    assert htmltext.page_lines("") == [] and htmltext.page_lines("<p>open <b>never closed") == [("open never closed", False, False)]
    assert htmltext.page_lines("a < b &lt; c")[0][0] == "a < b < c"


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = [x for x, s in zip(a, htmltext.shared_lines(a, b), strict=True) if s]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(got) == t[-1][-1]
        it = iter(b)
        assert all(x in it for x in got)


def test_template_lines_go_and_copies_stay(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SLICE", 3)
    body = lambda i: "".join(f"<p>page {i} line {k}</p>" for k in range(5))
    rows = [(i, f"http://www.h.example/a/{i:03d}?x=1", f"<div>Top bar</div>{body(i)}<div>Bottom</div>", "z") for i in range(11)]
    rows += [(20, "http://solo.example/x", "<p>alone</p>", "z"), (21, None, "<p>no url</p>", "z"), (22, "http://h2.example/1", body(5), "z"), (23, "http://h2.example/1", body(5), "z"), (24, "http://h2.example/3", None, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in htmltext.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(11):
        assert got[i] == "\n".join(f"page {i} line {k}" for k in range(5))
    assert got[20] == "alone" and got[21] == "no url" and got[24] == ""
    assert got[22] == got[23] == "\n".join(f"page 5 line {k}" for k in range(5))
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_shared_lines_of_marked_articles_go_and_copies_stay(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SLICE", 5)
    body = lambda i: "".join(f"<p>page {i} line {k}</p>" for k in range(4))
    rows = [(i, f"http://h.example/a/{i:03d}", f"<article><div>Menu line</div>{body(i)}</article><div>beside {i}</div><div>Bottom</div>") for i in range(12)]
    # copies of one article under the same template, and pages between them
    rows += [(30 + i, f"http://c.example/{i}", f"<div>Top</div><article><div>Menu line</div>{body(99 if i in (1, 2) else i)}</article>") for i in range(5)]
    got = {r.page_id: r.main_text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = lambda i: [f"page {i} line {k}" for k in range(4)]
    assert got == {**{i: "\n".join([*want(i), f"beside {i}"]) for i in range(12)}, **{30 + i: "\n".join(want(99 if i in (1, 2) else i)) for i in range(5)}}
    # without pages near by, the article alone stays
    alone = htmltext.page_lines("<article><p>long enough text</p></article><p>other</p>")
    assert htmltext.main_lines(alone, [], []) == "long enough text"


def kept_lines(page):
    return [t for t, _, skip in htmltext.page_lines(page) if not skip]


def test_wrappers_around_the_text_stay():
    for name in ("content no-sidebar", "has-sidebar", "with-menu", "page-header-wrap"):
        page = f'<div class="top menu"><p>Menu</p></div><div id="{name}"><article><p>text</p></article></div><div class="comments"><article>a longer answer of a reader</article></div>'
        assert kept_lines(page) == ["text"], name
    assert kept_lines('<form id="f"><main><p>text</p></main><div class="ads">x</div></form>') == ["text"]
    assert kept_lines('<div class="page-header-wrap"><p>most of the text</p></div><p>rest</p>') == ["most of the text", "rest"]
    assert kept_lines('<p>text</p><div class="comments"><p>many long answers</p></div><nav>a very long list of pages</nav>') == ["text"]
    assert kept_lines('<div><p class="notice">new<p>one<p>two</div>') == ["one", "two"]
    assert kept_lines('<ul><li class="ad">new<li>one<ul><li>two</ul></ul>') == ["one", "two"]


def test_template_longer_than_the_text_and_pages_between_copies(spark):
    menu = "".join(f"<div>menu {k}</div>" for k in range(9))
    rows = [(i, f"http://s.example/{i}", f"{menu}<p>short {i}</p>") for i in range(6)]
    text = "".join(f"<p>line {k}</p>" for k in range(6))
    rows += [(10 + i, f"http://k.example/{i}", f"<div>menu</div>{text if i < 3 else f'<p>other {i}</p><p>more {i}</p>'}") for i in range(5)]
    got = {r.page_id: r.main_text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"short {i}" for i in range(6))
    assert all(got[10 + i] == "\n".join(f"line {k}" for k in range(6)) for i in range(3))
    assert all(got[10 + i] == f"other {i}\nmore {i}" for i in (3, 4))


def test_neighbours_recall_and_cases(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "SHARD_ROWS", 400)
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 16))
    x[100:140] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, rows[5], *bad], "vec_id long, embedding array<double>")
    out = nndescent.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=400).collect()
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        got = sorted((t for t in out if t.query_id == q), key=lambda t: t["rank"])
        assert [t["rank"] for t in got] == list(range(1, 21))
        assert all(abs(t.score - s[t.vec_id]) < 1e-9 for t in got)
        hits += len({t.vec_id for t in got} & set(want.tolist()))
    assert hits >= 0.9 * 20 * 45
    assert {t.query_id for t in out} == set(range(0, 900, 20))
    assert nndescent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nndescent.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted(t.vec_id for t in few) == [1, 2]


def test_sentences_that_articles_share_stay(spark, monkeypatch):
    """Pages of one host whose articles repeat sentences, in the middle and at an end, under a template."""
    import random

    monkeypatch.setattr(htmltext, "SLICE", 7)
    rng = random.Random(8)
    said = [f"a sentence of many pages {k}" for k in range(6)]
    rows, want = [], {}
    for i in range(40):
        own = [f"own line {i} {k}" for k in range(rng.randrange(4, 9))]
        for x in rng.sample(said, 3):
            own.insert(rng.randrange(len(own) + 1), x)
        want[i] = "\n".join(own)
        rows.append((i, f"http://h.example/{i:03d}", f"<nav>{rng.choice(said)}</nav><div>Top</div><article>{''.join(f'<p>{x}</p>' for x in own)}<p>Share this</p></article><div>Bottom</div>"))
    got = {r.page_id: r.main_text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_template_ends_against_counting():
    import random

    rng = random.Random(1)
    for _ in range(300):
        own, *others = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 7))]
        head, tail = htmltext.template_ends(list(own), [list(x) for x in others])
        common = lambda n, way: sum(x[::way][: n + 1][n:] == own[::way][n] for x in others)
        others = sorted(set(others))
        most = lambda n, way: common(n, way) >= 3 and 2 * common(n, way) > len(others)
        first = next((n for n in range(len(own)) if not most(n, 1)), len(own))
        assert head == first and 0 <= tail <= len(own) - head
        last = next((n for n in range(len(own)) if not most(n, -1)), len(own))
        assert tail == min(last, len(own) - head)
