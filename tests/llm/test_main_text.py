from html.parser import HTMLParser

import pytest

from cardtrail.llm.main_text import extract_main_text, main_text
from cardtrail.llm.queries import op10_main_text

from .helpers import SF001

LONG = "A sentence of the article that is long enough to count as text, with several words in it."


class Article(HTMLParser):
    """The blocks of <article>, by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p", "footer"):
            self.cut()
        self.inside = tag == "article" or self.inside

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.cut()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_whole_table_matches_the_article(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    got = op10_main_text(spark, SF001).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == "\n".join(Article(pages[r["page_id"]]["html"]).blocks)


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("   ", ""),
    (f"<body><div id=menu><a href=/>Home</a> <a href=/a>News</a></div><h1>Short title here</h1><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>"
     f"<div class='comments'><p>{LONG} says a reader</p></div><div class=footer>Imprint</div></body>", f"Short title here\n{LONG}\nTiny.\n{LONG}"),
    (f"<article><header><h1>T &amp; U</h1></header><p>{LONG}<p>a&nbsp;&lt;b&gt;  c\n d</p><aside>Not this {LONG}</aside><form>Sign up</form></article>", f"T & U\n{LONG}\na <b> c d"),
    (f"<main><p>{LONG}</p><script>var t = '</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><section class='related-posts'><p>{LONG} more</p></section></main>", LONG),
    (f"<nav><ul><li>One</ul></nav><p><b>{LONG}<br><p>{LONG}", f"{LONG}\n{LONG}"),
    (f"<div role=alert>We use cookies {LONG}</div><div><p>{LONG} &eacute;&#233;&#x1F642;</p></div>", f"{LONG} éé🙂"),
    (f"<p>{LONG}</p><p>5 < 6 and &am", f"{LONG}\n5 < 6 and &am"),
    (f"<body class='has-sidebar no-ads'><div class='page with-menu'><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></body>", LONG),
    (f"<table><tr><td>{LONG}</td><td>cell two is here</td></tr></table>", f"{LONG}\ncell two is here"),
])
def test_pages(html, want):
    assert main_text(html) == want


TEASER = "<article class='teaser'><p>Five more words for you</p></article>"


@pytest.mark.parametrize("html, want", [
    (f"<div><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></div>{TEASER}", f"The title\n{LONG}\n{LONG}"),
    (f"{TEASER}{TEASER}<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{TEASER}<p>The end.</p></div>", f"{LONG}\n{LONG}\n{LONG}\nThe end."),
    (f"<div><p>{LONG}</p></div><article class='comment'><p>{LONG} {LONG} {LONG}</p></article>", LONG),
    (f"<article class='post tag-comments category-social'><p>{LONG}</p></article>", LONG),
    (f"<div><p>{LONG}</p></div><article><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><h2>T</h2><p>{LONG}</p><nav><p>a<p>b<p>c<p>d</nav><p>The end.</p><p><a href=/x>A source</a></p></article><div>Stray words</div>", f"T\n{LONG}\nThe end.\nA source"),
    (f"<div>{LONG} {LONG} {LONG} {LONG}</div><nav><p>a<p>b<p>c<p>d</nav><article><p>{LONG}</p></article>", f"{LONG} {LONG} {LONG} {LONG}"),
])
def test_articles_weigh_lines_and_do_not_replace_the_stretches(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("html, want", [
    (f"<div style='overflow:hidden'><p>{LONG}</p></div>", LONG),
    (f'<div style="visibility:hidden" data-x-hidden="false" title="the hidden truth"><p>{LONG}</p></div>', LONG),
    (f"<p>{LONG} <a href='/hidden-falls'>Hidden Falls</a> and <a href=/x?id=related>more</a>.</p>", f"{LONG} Hidden Falls and more."),
    (f"<div data-class='menu' data-id=footer data-role='navigation'><p>{LONG}</p></div>", LONG),
    (f"<p>{LONG}</p><div hidden><p>{LONG} not</p></div><div HIDDEN=''>{LONG} not</div><div aria-hidden=true>{LONG} not</div>", LONG),
    (f"<p>{LONG}</p><div data-x id = 'related'>{LONG} not</div><div class=plain class=menu>{LONG}</div>", f"{LONG}\n{LONG}"),
    (f"<div class='elementor-widget-container'><h1>The title</h1></div><div class='elementor-widget elementor-widget-container'><p>{LONG}</p></div>", f"The title\n{LONG}"),
    (f"<div class='public-notice'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}\n{LONG}"),
    ("<nav>Menu</nav><div class='notice'><p>Closed today.</p></div>", "Closed today."),
    (f"<p>{LONG}</p><div class='social-share'>Tell your friends about it</div><div class='widget'>Weather today: sunny</div><p>{LONG}</p>", f"{LONG}\n{LONG}"),
])
def test_attributes_are_read_whole(html, want):
    assert main_text(html) == want


LINKS = "<ul><li><a href=/1>One link</a><li><a href=/2>Two links</a><li><a href=/3>Three</a><li><a href=/4>Four</a></ul>"


@pytest.mark.parametrize("html, want", [
    (f"<div><p>{LONG} {LONG}</p>{LINKS}<p>The closing paragraph.</p></div>", f"{LONG} {LONG}\nThe closing paragraph."),
    (f"<body><p>{LONG} {LONG}</p>{LINKS}<p>Between.</p>{LINKS}<p>{LONG} {LONG}</p>{LINKS}<div><p>Elsewhere.</p></div></body>", f"{LONG} {LONG}\nBetween.\n{LONG} {LONG}"),
])
def test_light_stretches_of_the_same_container_stay(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("n", [1, 100, 200, 201, 400])
def test_vague_blocks_are_judged_by_what_they_hold(n):
    words = "word " * n
    assert main_text(f"<p>{LONG}</p><div class=notice><p>{words}</p></div><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert main_text(f"<p>{LONG}</p><div class=discussion><h1>A title</h1><p>{words}</p></div>") == f"{LONG}\nA title\n{words.strip()}"


@pytest.mark.parametrize("html, want", [
    (f'<p>{LONG}</p><p title="open>Second para is kept</p>', f"{LONG}\nSecond para is kept"),
    (f'<p>{LONG}</p><p title="open>Second para is kept</p><p class="x">Third</p>', f"{LONG}\nSecond para is kept\nThird"),
    (f"<p>{LONG}</p><p>It <a title=it's>link</a> goes on and on</p><p>{LONG}</p>", f"{LONG}\nIt link goes on and on\n{LONG}"),
    (f"<p data-x='a > b' title=\"c > 'd'\">{LONG}</p>", LONG),
])
def test_broken_attributes(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<b>x</i>", "<i><b>x</i><p>", "<b><div>x</div>", "<li><b>x", "<table><tr><td>x", '<p title="x>y'])
def test_time_grows_with_the_page(unit):
    import time
    took = []
    for n in (10_000, 20_000, 40_000):
        began = time.process_time()
        main_text(unit * n)
        took.append(time.process_time() - began)
    assert took[2] < 3 * took[1] + 0.2 and took[1] < 3 * took[0] + 0.2


def test_very_long_and_deep_pages():
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG


def test_awkward_rows(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", LONG, len(LONG)), (3, "u", LONG, len(LONG)), (3, "u", LONG, len(LONG))], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0
