"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what is plain: blocks in
menus, footers, forms and the like, or made of links, are bad; blocks with enough running text
(length and stop-word density) are good; the rest, short or without stop words, is ambiguous. In
the second pass an ambiguous block takes the label of its nearest decided neighbour within the same
section (an article, or the page around it); on equal distance the earlier one counts. A section
without any decided block follows its kind: an article is good, anything else bad.

Defined results: null or empty html gives an empty text; unclosed and stray tags are tolerated, and
a comment, script or style without end runs to the end of the page. Other hidden elements without
end are tags like any other, and of a head only hidden elements go: its text belongs to the body, as
in browsers; a title without end hides the text up to the next tag. A tag without end hides the rest. Marks
are whole values of class, id or role, or ends of compound ones; values of other attributes say nothing.
Rows are independent, repeated ones give repeated results; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole

# Kinds of elements, marks in class or id, and stop words of four languages.
HIDDEN = "script|style|noscript|template|svg|iframe|object|select|textarea|title"
TO_THE_END = frozenset(("script", "style"))
FURNITURE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "header"))
ARTICLE = frozenset(("article", "main"))
CONTAINERS = FURNITURE | ARTICLE | {"div", "section", "ul", "ol", "dl", "table", "body"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "address",
                       "hr", "html", "caption", "details", "summary", "fieldset", "center", "thead", "tbody", "tfoot"}
# Names of what is no part of the text, as whole class, id or role values, or as the head or the last part of compound ones.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription sidebar sidebars menu menus navbar navigation nav breadcrumb breadcrumbs footer masthead header comment comments reply replies disqus share sharing "
    "social related popup modal login signup search".split()
)
# A compound is marked when its last part is a mark, or its first part is one and the last part names a piece of page.
PIECES = frozenset(
    "area bar block box bottom button buttons card column content feed form group item items left link links list main notice panel post posts right section slot story stories "
    "strip thread top unit widget widgets".split()
)
# Compounds that begin so speak of a page or an article as a whole.
STATES = frozenset("has no not with without is show hide hidden toggle enable disable post-type page".split())
OWN_MARKS = frozenset(("ad", "advert", "sponsored", "promo", "comment", "comments", "reply", "related"))
TITLE_MARKS = frozenset(("header", "masthead"))
# Marks of text by others, which stays out however much of it there is.
FOREIGN = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "sponsored", "comment", "comments", "reply", "replies", "disqus", "cookie", "cookies"))
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
STOP_WORDS = frozenset(
    "a about al an and are as at au aus auf avec be but by car con como da das de del dem den der des die dans du ein eine el elle en er es est et for from "
    "für had has have he his ich ihr il in is ist it la las le les lo los mais mit más nicht no nous of on or ou par para pas pero por pour que qui se sich sie "
    "sind son su sur that the their they this to un una und une von vor was were which with y zu zum zur".split()
)
LONG, SHORT = 140, 50
LINKED, STOP_HIGH, STOP_LOW = 0.5, 0.25, 0.08

HIDDEN_NAMES = frozenset(HIDDEN.split("|"))
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?)?""")
CLOSING = re.compile(rf"</({HIDDEN})\s*>", re.I)


class Mark:
    """An element that its class or id marks, in a chain to the marked elements around it."""

    def __init__(self, around: Mark | None, foreign: bool):
        self.around, self.foreign, self.holds_article, self.good, self.condemns = around, foreign, False, 0, True


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    section: int
    article: bool
    mark: Mark | None = None


def tag_end(page: str, begin: int) -> tuple[int, dict[str, str]]:
    """Where a tag ends whose name ends at ``begin``, and its attributes; a quote without end is a character like others.

    A tag without end runs to the end of the page, as in browsers.
    """
    at, found = begin, {}
    while m := ATTRIBUTE.match(page, at):
        found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
        at = m.end()
    end = page.find(">", at)
    return (len(page) if end < 0 else end + 1), found


def mark_of(token: str) -> str:
    """The mark that a class, id or role value carries; empty for none."""
    whole_name = token.lower()
    if whole_name in MARKS:
        return whole_name
    parts = [part.lower() for part in PARTS.split(token) if part]
    if len(parts) < 2 or parts[0] in STATES:
        return ""
    if parts[-1] in MARKS:
        return parts[-1]
    return parts[0] if parts[0] in MARKS and parts[-1] in PIECES else ""


def not_shown(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(NOT_SHOWN.search(attributes.get("style", "")))


def marks_of(tag: str, attributes: dict[str, str], in_article: bool) -> set[str]:
    """Marks in class, id or role that say that an element is no part of the text."""
    if tag in ("body", "html", "main"):
        return set()
    tokens = [t for name in ("class", "id", "role") for t in attributes.get(name, "").split()]
    if tag in ARTICLE:
        return {t.lower() for t in tokens} & OWN_MARKS
    found = {mark_of(t) for t in tokens} - {""}
    # The head of an article holds its title.
    return found - TITLE_MARKS if in_article else found


def hidden_end(page: str, name: str, begin: int, closings: dict[str, list[tuple[int, int]]]) -> int:
    """Where a hidden element ends whose content begins at ``begin``."""
    places = closings.get(name, [])
    k = bisect_left(places, (begin,))
    if k < len(places):
        return places[k][1]
    if name in TO_THE_END:
        return len(page)
    if name == "title":
        following = page.find("<", begin)
        return len(page) if following < 0 else following
    return begin


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, white space settled, character references decoded; time grows with the page."""
    found: list[Block] = []
    # Open containers: name, counts towards furniture, is an article, the chain of marks outside of it.
    stack: list[tuple[str, bool, bool, Mark | None]] = []
    marks: list[Mark] = []
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    state = {"linked": 0, "in_link": 0, "section": 0, "furniture": 0, "articles": 0, "hidden": False}
    chain: Mark | None = None
    own: Mark | None = None  # of the block itself

    def close() -> None:
        nonlocal own
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, state["linked"], state["hidden"] or state["furniture"] > 0, state["section"], state["articles"] > 0, own or chain))
        parts.clear()
        state["linked"], state["hidden"], own = 0, False, None

    def take(text: str) -> None:
        parts.append(text)
        if state["in_link"]:
            state["linked"] += len("".join(html.unescape(text).split()))

    def pop() -> None:
        nonlocal chain
        tag, furniture, article, chain = stack.pop()
        open_tags[tag] -= 1
        state["furniture"] -= furniture
        state["articles"] -= article

    at, size = 0, len(page)
    # Where hidden elements of each name end, in page order.
    closings: dict[str, list[tuple[int, int]]] = {}
    for c in CLOSING.finditer(page):
        closings.setdefault(c[1].lower(), []).append(c.span())
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            take(page[at:])
            break
        take(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, begin)
        if not m:
            take("<")
            at = begin + 1
            continue
        at, attributes = tag_end(page, m.end())
        ends, tag, empty = bool(m[1]), m[2].lower(), page.endswith("/>", begin, at)
        if tag in HIDDEN_NAMES and not ends:
            at = at if empty else hidden_end(page, tag, at, closings)
            continue
        if tag in BLOCKS:
            close()
            state["in_link"] = 0
        if tag == "a":
            state["in_link"] = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in CONTAINERS and not ends and not empty:
            inside = state["articles"] > 0
            furniture = tag in FURNITURE and not (tag == "header" and inside) or not_shown(attributes)
            article = tag in ARTICLE
            names = marks_of(tag, attributes, inside)
            if article and chain is not None:
                chain.holds_article = True
            stack.append((tag, furniture, article, chain))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            state["furniture"] += furniture
            state["articles"] += article
            state["section"] += article
            if names:
                chain = Mark(chain, bool(names & FOREIGN))
                marks.append(chain)
        elif tag in CONTAINERS and ends and open_tags.get(tag):
            while stack[-1][0] != tag:
                pop()
            pop()
            state["section"] += tag in ARTICLE
        elif tag in BLOCKS and not ends:
            state["hidden"] = not_shown(attributes)
            names = marks_of(tag, attributes, state["articles"] > 0)
            if names:
                own = Mark(chain, bool(names & FOREIGN))
                marks.append(own)
    close()
    settle_marks(found, marks)
    return found


def settle_marks(blocks: list[Block], marks: list[Mark]) -> None:
    """Set ``outside`` of blocks in marked elements, but for marks that cannot be meant.

    A mark condemns no element that holds an article, and on a page without articles none, but those
    of others' text, that holds more than half of the running text.
    """
    total, no_article = 0, not any(block.article for block in blocks)
    for block in blocks if marks and no_article else ():
        if not block.outside and good_text(block):
            total += len(block.text)
            if block.mark is not None:
                block.mark.good += len(block.text)
    for mark in reversed(marks):  # inner ones come after those around them
        if mark.around is not None:
            mark.around.holds_article |= mark.holds_article
            mark.around.good += mark.good
    for mark in marks:
        overruled = mark.holds_article or no_article and not mark.foreign and 2 * mark.good > total
        mark.condemns = not overruled or mark.around is not None and mark.around.condemns
    for block in blocks:
        block.outside |= block.mark is not None and block.mark.condemns


def stop_share(block: Block) -> float:
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def good_text(block: Block) -> bool:
    """Long enough and with enough stop words to be running text."""
    if len(block.text) < SHORT or block.linked > LINKED * len(block.text.replace(" ", "")):
        return False
    return runs_on(block, stop_share(block))


def runs_on(block: Block, stops: float) -> bool:
    return stops >= STOP_HIGH or stops >= STOP_LOW and (len(block.text) >= LONG or block.article)


def first_pass(block: Block) -> bool | None:
    """True (good), False (bad) or None (ambiguous)."""
    letters = len(block.text.replace(" ", ""))
    if block.outside or block.linked > LINKED * letters:
        return False
    if len(block.text) < SHORT:
        return None
    stops = stop_share(block)
    if runs_on(block, stops):
        return True
    if stops < STOP_LOW and len(block.text) >= LONG and not block.article:
        return False
    return None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block of their section."""
    def walk(order: range) -> list[tuple[int, bool] | None]:
        seen: dict[tuple[int, bool], tuple[int, bool]] = {}
        out: list[tuple[int, bool] | None] = [None] * len(blocks)
        for k in order:
            key = (blocks[k].section, blocks[k].article)
            if labels[k] is not None:
                if not blocks[k].outside:
                    seen[key] = (k, labels[k])
            else:
                out[k] = seen.get(key)
        return out

    before, after = walk(range(len(blocks))), walk(range(len(blocks) - 1, -1, -1))
    done = []
    for k, label in enumerate(labels):
        if label is None:
            near = [x for x in (before[k], after[k]) if x is not None]
            label = min(near, key=lambda x: abs(x[0] - k))[1] if near else blocks[k].article
        done.append(label)
    return done


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            texts = [main_text(page) for page in part["html"]]
            yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``id_col``, ``url_col``, ``text``, ``n_chars``. Rows stay where they are."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), whole(F.col(html_col)).alias("html"))
    done = rows.mapInPandas(extract, "id string, url string, text string, n_chars long")
    return done.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
