"""Main text of pages: a plain twin of the line blocks, and pages that were once lost."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from loomtide.llm import html_extract

BODY = ["word " * 40, "more " * 30, "last words of the text"]
TEXT = "\n\n".join(" ".join(x.split()) for x in BODY)
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)


def twin(lines):
    """Surge and dive written out line by line: a stretch lasts while any of the next three lines has text."""
    length = [n * (2 if inside else 1) for _, n, inside in lines]
    total = [sum(length[k : k + 3]) for k in range(len(lines))]
    bound = min(86, max(total, default=0) / 2)
    out, stretch = [], []
    for k in range(len(lines) + 1):
        if k < len(lines) and total[k] > 0:
            stretch.append(k)
            continue
        if any(total[j] > bound for j in stretch):
            while not length[stretch[0]]:
                stretch.pop(0)
            while not length[stretch[-1]]:
                stretch.pop()
            out += [lines[j][0] for j in stretch]
        stretch = []
    return out


class Reader(HTMLParser):
    """Text of the article element of plainly marked pages, by a parser of the standard library; knows nothing of line blocks."""

    INLINE = ("a", "b", "br", "meta")

    def __init__(self):
        super().__init__()
        self.open, self.out = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.out[-1] += " "
        elif tag not in self.INLINE:
            self.out.append("")
            self.open.append((tag, ("class", "ad") in attrs))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.out.append("")
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(ad or t in ("nav", "footer", "script", "style") for t, ad in self.open):
            self.out[-1] += data


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content has-sidebar">{PARAGRAPHS}</div>',
        f'<div class="site no-sidebar"><main>{PARAGRAPHS}</main></div>',
        f'<div class="site no-sidebar"><article>{PARAGRAPHS}</article></div>',
        f'<div data-testid="related-body">{PARAGRAPHS}</div>',
        f'<div class="search-results">{PARAGRAPHS}</div>',
        f"<div>{PARAGRAPHS.replace('<p>word', '<p title=it' + chr(39) + 's>word')}</div>",
        f'{PARAGRAPHS}<article class="comment"><p>{"me too " * 40}</p></article>',
        f'<div class="adsbygoogle">Buy {"now " * 50}</div>{PARAGRAPHS}',
        f'<div id="site-footer">{"words " * 50}</div>{PARAGRAPHS}',
        f"<svg><p>{PARAGRAPHS}",
    ],
)
def test_pages_once_lost(page):
    assert html_extract.main_text(page) == TEXT


ENDING = '<ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul>'
LINKS = "".join(f"<div><a href='/{k}'>See part {k}</a></div>" for k in range(4))


@pytest.mark.parametrize(
    ("inside", "added"),
    [
        ('<section class="related-work">Others did this before.</section>', "Others did this before."),
        ('<section id="social-history">Towns grew.</section>', "Towns grew."),
        ('<p class="ad-hoc">A rule for one case.</p>', "A rule for one case."),
        (ENDING, "First source\n\nSecond source"),
        (LINKS + "<p>Short final words.</p>", "See part 0\n\nSee part 1\n\nSee part 2\n\nSee part 3\n\nShort final words."),
        ("<p hidden>Not seen.</p>", ""),
        ("<p style='color:red; display: none'>Not seen.</p>", ""),
        ('<p title="a hidden b">Seen.</p>', "Seen."),
        ('<p>Words <span class="ad">Buy <span>now</span> here</span>go on<script>x</script>ward.</p>', "Words go onward."),
        ("<p>Let <math><mi>x</mi></math> be one.</p>", "Let x be one."),
        ('<div class="comment-list"><p>First!</p></div><section id="site-footer">Imprint</section>', ""),
    ],
)
@pytest.mark.parametrize("name", ["article", "main"])
def test_an_article_is_whole(name, inside, added):
    want = TEXT + ("\n\n" + added if added else "")
    assert html_extract.main_text(f"<nav><a href=/>Home</a></nav><{name}>{PARAGRAPHS}{inside}</{name}><footer>Imprint</footer>") == want


def test_lines_before_links_of_an_article_stay():
    assert html_extract.main_text(f"<article><h1>Title</h1>{LINKS[:-6]}</div>{PARAGRAPHS}</article>").startswith("Title\n\nSee part 0\n\n")


def test_columns_beside_an_article_go():
    column = f"<div>{'side words ' * 20}</div>"
    assert html_extract.main_text(f"{column}<article>{PARAGRAPHS}</article>{column}") == TEXT
    assert html_extract.main_text(f"<main><article>{PARAGRAPHS}</article>{ENDING}</main>{column}") == TEXT
    teaser = "<article><h2>Next</h2><p>A short teaser.</p></article>"
    assert html_extract.main_text(f"<div>{PARAGRAPHS}</div><hr>{ENDING * 2}{teaser}") == TEXT


def test_link_lines_stay_in_the_text():
    page = PARAGRAPHS.replace("<p>more", "<p><a href=x>One linked line</a></p><p>more")
    assert html_extract.main_text(page) == TEXT.replace("more", "One linked line\n\nmore", 1)


def test_unclosed_elements_take_linear_time():
    begin = time.monotonic()
    html_extract.main_text("<svg>" * 40_000 + "x" * 1_000_000 + "<a b='" * 20_000)
    assert time.monotonic() - begin < 5


def test_twin_on_the_tables(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    want = {p: "\n\n".join(twin(html_extract.page_lines(h or ""))) for p, h in rows}
    assert got == {p: (t, len(t)) for p, t in want.items()}
    assert all(want.values())


def test_a_plain_reader_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/pages.parquet"
        want = {}
        for page, text in duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall():
            reader = Reader()
            reader.feed(text or "")
            reader.close()
            want[page] = "\n\n".join(" ".join(x.split()) for x in reader.out if x.split())
        assert {r.page_id: r.text for r in html_extract.extract_pages(spark.read.parquet(path)).collect()} == want


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "a"), (1, "u", None, "a"), (None, None, PARAGRAPHS, "b"), (3, "v", "", None), (4, "w", f"<p>{'long ' * 300_000}", "c")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.url, r.n_chars) for r in html_extract.extract_pages(pages).collect())
    assert got == [("1", "u", 0), ("1", "u", 0), ("3", "v", 0), ("4", "w", 1_499_999), ("None", None, len(TEXT))]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
