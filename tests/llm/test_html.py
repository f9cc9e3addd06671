"""HTML extraction against a brute-force version over whole tables."""

import random
import time
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, html string"


def test_blocks():
    from millrace.llm import html_text as h

    page = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body class="single"><header>Top</header>
    <nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice">We use</div><article><header><h1>Ti&amp;tle</h1></header><p>First <b>bold
    text</b>&nbsp;x<br>y<p>Second<div class="ad banner">Buy</div><form>f</form><section id="comments"><p>Nice</p></section></article><aside>a</aside><footer>&copy;</footer>"""
    assert h.Page.of(page).text() == "Ti&tle First bold text x y Second"
    found = h.blocks(page)
    assert [t for t, z in found if z == h.BOILERPLATE] == ["Top", "One", "Two", "We use", "Buy", "f", "Nice", "a", "\u00a9"]
    assert h.Page.of(None).text() == "" and h.Page.of("<p>a<!-- <p>no --> b").text() == "a b"
    assert h.Page.of('<p title="a>b">kept</p><style>p{}</style><div class="address">here</div>').text() == "kept here"
    assert h.blocks("<p>seen <span class=ad>hidden</span> too</p>") == [("seen too", h.PLAIN), ("hidden", h.BOILERPLATE)]


def lcs_length(a, b):
    @cache
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return go(i + 1, j + 1) + 1 if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_common_lines_against_recursion():
    from millrace.llm import html_text as h

    rng = random.Random(6)
    for _ in range(120):
        a, b = (tuple(rng.choice("abcde") for _ in range(rng.randrange(14))) for _ in range(2))
        shared = h.common(list(a), list(b))
        kept = [x for x, s in zip(a, shared, strict=True) if s]
        it = iter(b)
        assert len(kept) == lcs_length(a, b) and all(x in it for x in kept)


def test_pages_of_many_lines_align_in_linear_memory():
    from millrace.llm import html_text as h

    rng = random.Random(2)
    a = [f"line {rng.randrange(30_000)}" for _ in range(50_000)]
    b = a[:]
    for _ in range(2_000):
        b[rng.randrange(len(b))] = f"line {rng.randrange(30_000)}"
    began = time.time()
    assert h.common(a, b).sum() >= 48_000
    assert time.time() - began < 60


def brute(rows, near):
    """Text and deleted lines of every row, from whole hosts in a list."""
    import xxhash

    from millrace.llm import html_text as h

    by_host = {}
    for i, (page_id, url, page) in enumerate(rows):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        by_host.setdefault(rest[:end].lower(), []).append((path, page_id is not None, page_id or 0, i, h.blocks(page or "")))
    out = {}
    for pages in by_host.values():
        runs = []
        for *_, i, found in sorted(pages, key=lambda p: p[:3]):
            lines = [t for t, _ in found]
            if not runs or runs[-1][0] != lines:
                runs.append((lines, []))
            runs[-1][1].append((i, found))
        for k, (lines, members) in enumerate(runs):
            others = [runs[j][0] for j in range(max(0, k - near), min(len(runs), k + near + 1)) if j != k]
            votes = sum((h.common(lines, o).astype(int) for o in others), np.zeros(len(lines), int))
            for i, found in members:
                gone = [v >= (1 if z == h.BOILERPLATE else min(2, max(1, len(others)))) and z != h.ARTICLE for v, (_, z) in zip(votes, found, strict=True)]
                kept = [(t, g) for g, (t, z) in zip(gone, found, strict=True) if z != h.BOILERPLATE]
                out[i] = (" ".join([t for t, g in kept if not g] or [t for t, _ in kept]), sum(gone))
    return out


def a_page(rng):
    pick = lambda n, of: "".join(f"<p>{rng.choice(of)}</p>" for _ in range(rng.randrange(n)))
    shared, own = [f"Shared {k}" for k in range(6)], [f"Own {rng.randrange(500)}" for _ in range(5)]
    body = f"<nav>{pick(3, shared)}</nav>" + pick(4, shared) + pick(4, own)
    if rng.random() < 0.3:
        body += f"<article>{pick(3, shared)}{pick(3, own)}</article>"
    return body + pick(3, shared)


@pytest.mark.parametrize("near,part_pages", [(1, 8), (2, 8), (2, 10_000), (3, 1)])
def test_extraction_against_brute_force(spark, near, part_pages):
    from millrace.llm import html_text as h

    rng = random.Random(17)
    rows = []
    for i in range(700):
        host = rng.choice(["Big.test", "big.test", "big.test", "small.test", "x.big.test"])
        same = rng.random() < 0.3 and rows
        rows.append((i, f"https://{host}/{rng.randrange(40):02d}/{rng.randrange(30):02d}?q={i}", rng.choice(rows)[2] if same else a_page(rng)))
    rows += [(2000 + k, f"https://run.test/{k:03d}", rows[0][2]) for k in range(120)] + [(1999, "https://run.test/", rows[1][2]), (2999, "https://run.test/z", rows[2][2])]
    rows += [(3000, "https://hot.test/x", "<p>Hot</p><p>Shared 1</p>")] * 200 + [(3001, "https://hot.test/y", "<p>Shared 1</p><p>Other</p>"), (2990, "https://hot.test/w", "<p>Wide</p><p>Shared 1</p>")]
    rows += [(None, "https://n.test/a", "<p>A</p>"), (None, None, None), (7, "no scheme", ""), (8, None, "<p>lost</p>")]
    # Pages that tie in host, path and id differ in nothing else, so the order is defined.
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    want = brute(rows, near)
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars, r.n_deleted) for r in h.extract(df, near=near, part_pages=part_pages).collect())
    assert got == sorted((str(p), str(u), want[i][0], len(want[i][0]), want[i][1]) for i, (p, u, _) in enumerate(rows))


def test_extraction_odd_tables(spark):
    from millrace.llm import html_text as h

    rows = [(100, "https://copy.test/1", "<p>Same</p>"), (101, "https://copy.test/2", "<p>Same</p>"), (102, None, None), (103, "https://x.test/", "<p>" + "long " * 100_000)]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[100].text == got[101].text == "Same" and got[102].text == "" and got[103].n_chars == len(got[103].text) == 499_999
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_differencing_beside_articles(spark):
    """A declared article protects its own lines; all others are aligned with the neighbours'."""
    from millrace.llm import html_text as h

    rows = [(i, f"https://h.test/a/{i:03d}", f"<div>Site name</div><p>Lead of page {i}.</p><article><h2>Quoted by all</h2><p>Teaser {i}.</p></article><p>Rest of page {i}.</p><div>Shared tail</div>") for i in range(6)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Lead of page {i}. Quoted by all Teaser {i}. Rest of page {i}." for i in range(6)}


def test_quoted_once_stays(spark):
    """A line that one neighbour of several quotes is no template."""
    from millrace.llm import html_text as h

    rows = [(i, f"https://q.test/{i}", f"<div>Menu</div><p>Text {i}.</p>" + ("<p>A quoted line.</p>" if i in (2, 3) else "")) for i in range(6)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Text {i}." + (" A quoted line." if i in (2, 3) else "") for i in range(6)}


def test_class_words_decide_nothing_inside_a_declared_article():
    from millrace.llm import html_text

    page = '<div class="share">out</div><article><div class="article-header"><h1>The title</h1></div><p><span class="tags">one</span></p><section id="related-work">two</section><div class="share-price">three</div><div class="big ad">buy</div><section id="comments">so true</section></article>'
    assert html_text.Page.of(page).text() == "The title one two three"


def test_broken_markup_is_read_in_one_pass():
    import time

    from millrace.llm import html_text

    began = time.time()
    for page in ("<a " * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<a '" * 50_000 + ">", "<!--" * 100_000, "<![" * 100_000, "<svg>" * 100_000):
        html_text.blocks(page)
    assert time.time() - began < 20
    assert html_text.blocks('a<p title="z>w</p>v') == [("a", 0), ("w", 0), ("v", 0)]  # a quote that does not close
    assert html_text.blocks("a < b<p>x<a href='q>r'>y</a></p>z <b") == [("a < b", 0), ("xy", 0), ("z <b", 0)]
