import time

import pytest

from voc.llm import page_text as pt

SCHEMA = "page_id bigint, url string, html string, host string, text string, others string"


def texts(html):
    return pt.main_blocks(pt.blocks(html))


def test_article_without_its_surroundings():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";if(a<b){}</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
    <article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp;word<br>next   line<p>Two &lt;tag&gt; 3 < 4
    <form><input name=q>Search</form><div class="share">Share</div><ul><li>first<li>second</ul><!-- <p>no</p> --></article>
    <section class="comments"><article>Nice!</article></section><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert texts(html) == ["Head & line", "One bold word next line", "Two <tag> 3 < 4", "first", "second"]


@pytest.mark.parametrize("html, expected", [
    ("<main><p>a</p></main><p>b</p>", ["a"]),
    ("<article><p>cut off &amp; en", ["cut off & en"]),
    ("<article>x<p hidden>y</p><p role='alert'>z</p></article>", ["x"]),
    ('<article>a<div title="1 > 0">b</div></article>', ["a", "b"]),
    ('<article>a<div title="open>b</div></article>', ["a", "b"]),
    ("<ARTICLE>A<SCRIPT>x</SCRIPT >B</ARTICLE>", ["AB"]),
    ("<article></article>", None), ("", None), ("plain", None),
])
def test_marks(html, expected):
    assert texts(html) == expected


@pytest.mark.parametrize("part", ['<a "', "<", "<p>", '<div class="ad">', "</div>", "<!--", "&", "<a b='", "<script>", "<div></p>"])
def test_reading_is_linear(part):
    start = time.process_time()
    pt.blocks(part * 200_000)
    assert time.process_time() - start < 10


def brute(rows):
    """Windows of tokens by dictionary, for pages that mark no article."""
    pages = [(pt.host_of(url), [(t, r) for t, r, _ in pt.blocks(html or "") if r != pt.MAIN], texts(html or "")) for _, url, html, *_ in rows]
    seen = {}
    for host, blocks, _ in pages:
        tokens, content = [w for t, _ in blocks for w in t.split()], "\n".join(t for t, _ in blocks)
        for i in range(len(tokens) - pt.RUN + 1):
            seen.setdefault((host, tuple(tokens[i : i + pt.RUN])), set()).add(content)
    out = []
    for (page_id, url, *_), (host, blocks, main) in zip(rows, pages):
        if main is None:
            tokens = [w for t, _ in blocks for w in t.split()]
            covered = {i + k for i in range(len(tokens) - pt.RUN + 1) if len(seen[host, tuple(tokens[i : i + pt.RUN])]) > 1 for k in range(pt.RUN)}
            main, at = [], 0
            for text, role in blocks:
                n = len(text.split())
                left = " ".join(w for k, w in enumerate(text.split(), at) if k not in covered)
                at += n
                if left and role != pt.NOISE:
                    main.append(left)
        text = "\n".join(main)
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=repr)


MENU = "<div>Home News Sport Weather Culture Travel Food Contact us</div>"


def own(i):
    return " ".join(f"word{i}and{k}" for k in range(12))


ROWS = [
    (i, f"https://a.example/{i}", f"<body>{MENU}<p>{own(i)}</p><div>All rights reserved by the example company since 1999</div>", "h", "t", "o")
    for i in range(12)
] + [
    (20, "https://b.example/1", f"<body>{MENU}<p>Alone on its host</p>", "h", "t", "o"),
    (21, "https://a.example/m", f"<body>{MENU}<article><p>Marked</p><p>All rights reserved by the example company since 1999</p></article>", "h", "t", "o"),
    (3, "https://a.example/3", f"<body>{MENU}<p>{own(3)}</p><div>All rights reserved by the example company since 1999</div>", "h", "t", "o"),
    (None, None, None, None, None, None), (22, None, "", "", "", ""), (23, "http://[bad", "<p>x</p>", "", "", ""), (24, "https://a.example/l", "<p>" + "long text here " * 20_000, "", "", ""),
]


def test_hosts_boilerplate_is_removed(spark):
    got = sorted(map(tuple, pt.main_text(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=repr)
    assert got == brute(ROWS)
    of = {r[0]: r[2] for r in got}
    assert of[5] == own(5)
    assert of[20].startswith("Home News") and of[21].startswith("Marked\nAll rights")


def page_texts(spark, pages):
    rows = [(i, f"https://{host}/{i}", html, "h", "t", "o") for i, (host, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in pt.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_what_marked_articles_repeat_is_removed(spark):
    line = "<div class=x>Tell your friends about this story by mail or post</div>"
    pages = [("a.example", f"<article><p>{own(i)}</p>{line}</article>") for i in range(8)] + [("b.example", f"<article>{line}</article>")]
    got = page_texts(spark, pages)
    assert all(got[i] == own(i) for i in range(8)) and got[8].startswith("Tell your friends")


FOOT = "<div>All rights reserved by the example company since 1999</div>"


def test_a_phrase_on_few_pages_of_a_large_host_stays(spark):
    phrase = "as everybody knows in this old town"
    got = page_texts(spark, [("a.example", f"<p>{own(i)} {phrase if i % 4 == 0 else ''} {own(i + 100)}</p>{FOOT}") for i in range(40)])
    assert all(got[i].split() == [*own(i).split(), *(phrase.split() if i % 4 == 0 else []), *own(i + 100).split()] for i in range(40))


def test_near_copies_do_not_erase_each_other(spark):
    long = " ".join(own(i) for i in range(10))
    copies = [("a.example", f"<p>{long} printed on day{i}</p>{FOOT}") for i in range(6)]
    others = [("a.example", f"<p>{own(50 + i)}</p>{FOOT}") for i in range(4)]
    got = page_texts(spark, copies + others)
    assert all(got[i] == f"{long} printed on day{i}" for i in range(6))
    assert all(got[6 + i] == own(50 + i) for i in range(4))


@pytest.mark.parametrize("html, expected", [
    ('<article class="post comments-open">a</article>', ["a"]),
    ('<div class="layout has-sidebar"><article>a</article><div class="left-sidebar">b</div></div>', ["a"]),
    ('<div class="widget"><article>a<p class="share">b</p></article></div><p>c</p>', ["a"]),
    ('<article>a</article><div class="related-posts"><article>b</article></div>', ["a"]),
    ('<p>a</p><div id="comments"><article>b</article></div>', None),
])
def test_names_do_not_cost_the_article(html, expected):
    assert texts(html) == expected


def test_a_page_that_names_leave_empty_keeps_its_text(spark):
    got = page_texts(spark, [("a.example", '<div id="page" class="no-share"><p>a</p></div>'), ("b.example", '<div class="notice"><p>b</p></div><nav>n</nav>')])
    assert got == {0: "a", 1: "b"}


def test_empty_table(spark):
    assert pt.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
