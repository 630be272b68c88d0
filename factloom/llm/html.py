"""Main text of web pages by two passes over their blocks.

The page is cut into blocks at block-level tags. First pass: a block is bad
inside menus, headers, footers, sidebars, notices, adverts, forms or reader
comments (by tag, role, class or id), or if most of it is links; it is good if
it is long enough and few of its words are links and, outside an article
element, enough of them are stop words. Other blocks are ambiguous. Second pass:
an ambiguous block takes the label of the nearest decided block of its region;
equally near ones of both kinds make it good, and a region without decided
blocks is good if it is an article or its text stands in paragraphs.

A paragraph that is one link counts as a menu even inside an article, whatever
its length (none of the 2,500 pages at sf0.1 has one).

Defined results: null and empty pages, and pages whose only text is in menus,
notices, comments and the like, give an empty text; unclosed and misnested tags, cut-off tags and comments are taken as they
come; repeated rows give repeated results; time is linear in the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.arrow import map_texts

LONG = 60
STOP_SHARE = 0.2
LINK_SHARE = 0.5

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me même mes ne nos notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "als am an auch auf aus bei bin bis da das dass dem den der des die dir du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wenn wie wir zu zum zur "
    "al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto está fue ha hay la las le les lo los me mi muy más nada ni nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label legend map menu nav noembed noframes noscript object optgroup option picture select svg template textarea title video".split())
RAW_TAGS = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
HINTS = frozenset("ad ads adbox adblock advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu submenu nav navbar navigation topnav footer comment comments commentlist disqus reply replies respond login register search searchbox toolbar pagination pager copyright disclaimer hidden skip sitemap tagcloud".split())
HEAD_HINTS = frozenset("header masthead topbar head top site-header".split())
SPARED = frozenset("has with no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
REGIONS = frozenset(("article", "main"))

# A quote opens a value only after an equals sign; one that never closes is part of a name.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>""")
COMMENT = re.compile(r"<!--(?:-?>|(?s:.*?)--!?>)")
CLOSERS = {t: re.compile(rf"(?ai)</{t}(?=[\s/>])") for t in RAW_TAGS}
ATTRIBUTE = re.compile(r"""([A-Za-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"(?i)\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden")


def _hinted(attributes: str, in_article: bool) -> bool:
    """Whether role, class, id or style say that an element is no main text."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    plain = ATTRIBUTE.sub(" ", attributes)
    if "hidden" in plain.split():
        return True
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES and not (in_article and value == "banner"):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = [p for p in re.split(r"[-_]+", token) if p]
                if parts and parts[0] in SPARED:
                    continue
                if HINTS.intersection(parts) or token in HINTS or not in_article and (token in HEAD_HINTS or "header" in parts):
                    return True
    return False


class Block:
    __slots__ = ("text", "links", "bad", "region", "tag")

    def __init__(self, text: str, links: int, bad: bool, region: int, tag: str):
        self.text, self.links, self.bad, self.region, self.tag = text, links, bad, region, tag


def blocks_of(page: str) -> tuple[list[Block], set[int]]:
    """Blocks in page order, and which regions are articles."""
    out: list[Block] = []
    articles: set[int] = set()
    stack: list[tuple[str, bool, int]] = []  # tag, whether dropped, region
    parts: list[str] = []
    links = breaks = 0
    at, n, regions = 0, len(page), 0
    unclosed: set[str] = set()  # raw tags that no later tag closes

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        nonlocal links, breaks
        text = " ".join("".join(parts).split())
        if text:
            dropped, region = state()
            out.append(Block(text, links, dropped, region, next((t for t, _, _ in reversed(stack) if t in BLOCK_TAGS), "")))
        parts.clear()
        links = breaks = 0

    def add(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if text.strip():
                breaks = 0
                if anchors:
                    links += len(" ".join(text.split()))

    anchors = 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            comment = COMMENT.match(page, lt)
            at = comment.end() if comment else n
            continue
        if following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha() or following == "/"):
            add("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            end = page.find(">", lt)
            if end < 0:
                break  # a tag cut off by the end of the page
            at = end + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW_TAGS and not closing:
            end = None if tag in unclosed else CLOSERS[tag].search(page, at)
            if tag in BLOCK_TAGS:
                flush()
            if end is None:
                unclosed.add(tag)
                if tag in ("script", "style"):
                    break
                continue
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if tag == "br":
            breaks += 1
            flush() if breaks > 1 else parts.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in REGIONS for t, _, _ in stack[k + 1 :]) and tag not in ("body", "html", "main", "article"):
                        break  # it belongs to an element outside the article
                    del stack[k:]
                    break
            if tag in BLOCK_TAGS:
                anchors = 0
            continue
        dropped, region = state()
        in_article = region in articles
        if tag in REGIONS:
            # A nested article (a teaser or a reader's comment) keeps its parent's state.
            if not in_article or _hinted(attributes, True):
                regions += 1
                dropped, region = _hinted(attributes, True), regions
                articles.add(region)
        elif tag in DROPPED_TAGS or tag == "header" and not in_article:
            dropped = True
        elif tag not in ("body", "html") and not dropped and _hinted(attributes, in_article):
            dropped = True
        if tag in BLOCK_TAGS or tag not in VOID_TAGS and (dropped != state()[0]):
            if tag not in BLOCK_TAGS:
                flush()
            stack.append((tag, dropped, region))
    flush()
    return out, articles


def main_text(page: str) -> str:
    """The good blocks, one a line; no text where only menus, notices and the like have any."""
    return "\n".join(_chosen(*blocks_of(page)))


def _chosen(blocks: list[Block], articles: set[int]) -> list[str]:
    label: list[bool | None] = []
    has_article = any(b.region in articles and not b.bad for b in blocks)
    for b in blocks:
        in_article = b.region in articles
        if b.bad or b.links > LINK_SHARE * len(b.text) or has_article and not in_article:
            label.append(False)
        elif len(b.text) < LONG:
            label.append(None)
        elif in_article:
            label.append(True)
        else:
            words = WORD.findall(b.text.lower())
            label.append(True if words and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words) else None)
    # Nearest decided block of the same region on each side: (distance, label).
    # A block that is bad by its place says nothing of its neighbours.
    sides = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        side: list[tuple[int, bool] | None] = [None] * len(blocks)
        for i in order:
            if label[i] is None:
                side[i] = last.get(blocks[i].region)
            elif not blocks[i].bad:
                last[blocks[i].region] = (i, bool(label[i]))
        sides.append(side)
    out = []
    for i, b in enumerate(blocks):
        keep = label[i]
        if keep is None:
            near = [(abs(i - s[i][0]), not s[i][1]) for s in sides if s[i]]
            keep = not min(near)[1] if near else b.region in articles or b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "td", "li")
        if keep:
            out.append(b.text)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns: the id, the columns named in keep, and text."""

    def make():
        return lambda _, texts: [pa.array([main_text(t) for t in texts], pa.string())]

    return map_texts(pages, id_col, html_col, make, "text string", keep=keep)
