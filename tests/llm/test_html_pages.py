"""Main text against an independent reader of the given pages, ordinary wrappers, and time on hostile pages."""

import time
from html.parser import HTMLParser

import pytest
from loglattice.llm import QUERIES
from loglattice.llm.html_extract import BLOCKS, extract_main_text, main_text

SF = "/root/testdata/sf0.001"
GOOD = "The cat sat on the mat and it was good for all of the people who were in the house. " * 3


class ArticleReader(HTMLParser):
    """Blocks of all articles of a tidy page, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attributes):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.blocks.append("")
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def read_articles(page):
    reader = ArticleReader()
    reader.feed(page)
    return "\n".join(filter(None, (" ".join(block.split()) for block in reader.blocks)))


def test_query_equals_an_independent_reader(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op8_html_extract"](spark, SF).collect()}
    assert got == {k: read_articles(page) for k, page in pages.items()}


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article><p>{}</p></article></div>", "<div class='no-search comments-open'><main><p>{}</p></main></div>",
    "<div id='main-navigation-wrapper'><div class='content'><p>{}</p></div></div>", "<div data-id='nav'><p>{}</p></div>", "<div title='class=nav'><p>{}</p></div>",
    "<article><section id='related-work'><p>{}</p></section></article>", "<article><p id='share-prices'>{}</p></article>", "<p><b class=x' >{}</b></p>", "<div class=sidebar><div><article>{}</article></div></div>",
    "<div CLASS=page><p style='color:red' data-x='a>b'>{}</p></div>", "<article><header class=header><p>{}</p></header></article>", "<p>{}</p><div class=nav><p>x</p>",
])
def test_wrappers_do_not_hide_the_article(page):
    assert main_text(page.format(GOOD)) == GOOD.strip()


@pytest.mark.parametrize("other", [
    "<div class='comment-list'><p>{}</p></div>", "<div class='cookie-notice'><p>{}</p></div>", "<aside><article><p>{}</p></article></aside>", "<section id=comments><p>{}</p><p>{}</p></section>",
    "<div class=ad>{}</div>", "<div class='sidebar-left'><p>{}</p></div>", "<div role=navigation><p>{}</p></div>", "<form><p>{}</p></form>", "<div hidden><p>{}</p></div>", "<p aria-hidden=true>{}</p>",
    "<div style='display: none'><p>{}</p></div>", "<div class=siteFooter><p>{}</p></div>", "<ul class='related-posts'><li>{}</li></ul>", "<p class='newsletter-box'>{}</p>", "<script>{}</script>", "<!-- {} -->",
])
def test_other_parts_of_a_page_go(other):
    body = "Here is what the writer has to say to all of you, and it is not a short text at all. " * 3
    assert main_text(f"<article><p>{body}</p></article>{other.format(GOOD, GOOD)}") == body.strip()
    assert main_text(f"{other.format(GOOD, GOOD)}<main><p>{body}</p></main>") == body.strip()


@pytest.mark.parametrize("page", [
    "<p class='" * 110_000, '<a b="' * 200_000, "<div><p>a</p>" * 80_000, "<div>" * 200_000, "<!" * 500_000, "<div>" * 100_000 + "</nav>" * 90_000, "<div class=nav>" * 70_000,
    "<div class=nav><article>" * 45_000, "<p" + " " * 1_000_000, "<p " + "=" * 1_000_000, "<" * 1_000_000, "<a href=x" * 110_000, "<ul><li><a href=x>" * 60_000, "&#" * 500_000,
])
def test_a_megabyte_of_open_tags_and_quotes(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 20


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "u", f"<article>{GOOD}</article>", "x")] * 2 + [(None, None, None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(df).collect()))
    assert got == [(0, "", 0), (1, GOOD.strip(), len(GOOD) - 1), (1, GOOD.strip(), len(GOOD) - 1), (2, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0
