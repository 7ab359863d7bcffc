"""HTML extraction: blocks labelled as content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import runs
from folioflow.llm.mincut import min_cut

# The first pattern of a tag takes up to 400 quoted values of up to 10,000 characters at once. Where it fails, _tag_end looks for the tag's end
# step by step; a tag with a quote that does not end goes to the next >.
_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]{0,10000}"|'[^']{0,10000}'){0,800}+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNQUOTED = re.compile(r"""[^>"']*""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style noscript template head title textarea select svg iframe object canvas audio video math datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Log-odds for an enclosing element, by its tag, its role, and the names in its class and id. A name of several words counts with the
# mean of its words.
AWAY = {
    "nav": -7, "menu": -6, "header": -4, "footer": -7, "aside": -6, "form": -6, "button": -6, "dialog": -6, "fieldset": -6,
    "navigation": -7, "navbar": -7, "breadcrumb": -6, "breadcrumbs": -6, "pagination": -6, "pager": -6, "banner": -5, "contentinfo": -7,
    "complementary": -6, "search": -6, "sidebar": -7, "widget": -5, "ad": -7, "ads": -7, "advert": -7, "adverts": -7, "advertisement": -7,
    "sponsor": -7, "sponsored": -7, "promo": -6, "cookie": -7, "cookies": -7, "consent": -7, "gdpr": -7, "notice": -6, "popup": -6,
    "modal": -6, "subscribe": -6, "newsletter": -6, "signup": -6, "login": -6, "comment": -9, "comments": -9, "respond": -8, "disqus": -9,
    "reply": -7, "replies": -8, "related": -6, "recommended": -6, "share": -6, "sharing": -6, "social": -6, "toolbar": -6, "copyright": -6,
    "skip": -5, "hidden": -8, "alert": -5, "disclaimer": -5, "tags": -4,
}
TOWARD = {"article": 4, "main": 4, "content": 3, "post": 3, "entry": 3, "story": 3, "body": 2, "text": 2, "articlebody": 4}
STRONG = -5
ADJACENT = 1.6
SIBLING = 1.2
BORDER = 0.25
SCALE = 1000


class Element:
    __slots__ = ("tag", "up", "depth", "toward", "away", "unseen")

    def __init__(self, tag: str, up, names: list, hidden: bool):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        plain = tag in ("html", "body")
        told = [(0, 0) if plain else (AWAY.get(tag, 0), TOWARD.get(tag, 0))]
        for parts in [] if plain else names:
            told.append((sum(AWAY.get(w, 0) for w in parts) / len(parts), sum(TOWARD.get(w, 0) for w in parts) / len(parts)))
        away, toward = min(a for a, _ in told), max(t for _, t in told)
        inside = up.toward if up else 0
        if tag == "header" and away == AWAY["header"] and inside > 0 and not up.away:
            away = 0  # an article's own heading
        self.away = min(away, up.away if up else 0)
        # what is clearly no content is not content for standing in an article
        self.toward = 0 if self.away <= STRONG else max(inside, toward)
        self.unseen = hidden or tag in UNSEEN or bool(up and up.unseen)


def _attributes(text: str) -> tuple[list, bool]:
    """The names in class, id and role, each as its words, and whether the element is hidden."""
    names, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            names += [parts for token in value.split() if (parts := _PART.findall(_CAMEL.sub(r"\1 \2", token).lower()))]
        value = value.lower()
        hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true")
    return names, hidden


def _tag_end(source: str, at: int, open_quotes: set[int]) -> int:
    """The place of the > that ends a tag, outside of quotes, or -1. open_quotes keeps the quotes from which no end was found, so that no part of
    a page is searched more than twice."""
    tried = []
    while True:
        at = _UNQUOTED.match(source, at).end()
        if at < len(source) and source[at] == ">":
            return at
        behind = source.find(source[at], at + 1) + 1 if at < len(source) and at not in open_quotes else 0
        tried.append(at)
        if not behind:
            open_quotes.update(tried)
            return -1
        at = behind


def blocks_of(page: str | None) -> list[tuple]:
    """(text, element, characters inside links) of every visible block with text, in page order. Character references
    are decoded and white space is turned into single spaces."""
    out: list[tuple] = []
    here, links, linked = None, 0, 0
    held: list[str] = []
    source = page or ""

    def end_block():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and not (here and here.unseen):
                out.append((text, here, min(linked, len(text))))
            held.clear()
        linked = 0

    at = 0
    last = source.rfind(">")
    open_quotes: set[int] = set()
    while at < len(source):
        if at > last:  # no tag ends any more
            held.append(source[at:])
            break
        m = _PIECE.match(source, at)
        at = m.end()
        piece = m.group()
        tag = m.group(2) or m.group(5)
        rest = m.group(3) if m.group(2) else m.group(6)
        if m.group(5) and (end := _tag_end(source, m.end(5), open_quotes)) >= 0:
            rest, at = source[m.end(5) : end], end + 1
        if tag is None:
            if not piece.startswith(("<!", "<?")):
                held.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                held.append(" ")
            elif tag in BLOCKS or tag in UNSEEN or tag == "button":
                node = here
                while node and node.tag != tag:
                    node = node.up
                if node:
                    end_block()
                    here = node.up
                    links = 0
            continue
        if tag == "br":
            held.append(" ")
        elif tag in BLOCKS or tag in UNSEEN or (tag == "button"):
            end_block()
            links = 0
            if here and here.tag == "p" and tag in BLOCKS:
                here = here.up
            if here and tag in CLOSES and here.tag in CLOSES[tag]:
                here = here.up
            if tag in VOID:
                continue
            if tag == "body":
                while here and here.tag != "html":
                    here = here.up
            names, hidden = _attributes(rest) if rest.strip() else ([], False)
            here = Element(tag, here, names, hidden)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                here = here.up
            elif rest.rstrip().endswith("/") and tag in ("svg", "math"):
                here = here.up
        elif tag == "a":
            links += 1
        elif tag in ("input", "img", "wbr"):
            pass
    end_block()
    return out


def _odds(text: str, element, linked: int, marked: bool) -> float:
    """The classifier: log-odds that a block is content. Words count by their logarithm, from -1.5 to 2.5; on pages that mark their
    article, blocks outside are less likely content, on others all start somewhat above even."""
    z = max(-1.5, min(2.5, 0.9 * math.log((text.count(" ") + 1) / 8)))
    z -= 4.0 * linked / len(text)
    if text[-1] in ".!?:;\"'”»…":
        z += 0.4
    if element is None:
        return z - (2.0 if marked else -1.0)
    if element.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"):
        z += 0.5
    z += -2.0 if marked and element.toward <= 0 else 0.0 if marked else 1.0
    return z + element.toward + element.away


def _nearness(a, b) -> float:
    """Share of the deeper block's ancestors that both blocks have."""
    if a is None or b is None:
        return 1.0 if a is b else 0.2
    x, y = a, b
    while x.depth > y.depth:
        x = x.up
    while y.depth > x.depth:
        y = y.up
    while x is not y:
        x, y = x.up, y.up
        if x is None or y is None:
            return 0.0
    return (x.depth + 1) / (max(a.depth, b.depth) + 1)


def labels(blocks: list[tuple]) -> tuple[list[int], list[bool]]:
    """Each block's log-odds, scaled, and whether it is content by the minimum cut.

    Neighbours in the page are tied the stronger the more ancestors they share, and siblings with the same tag to the last one before;
    ties are weaker between a block that its elements tell to be no content and one that they do not."""
    marked = any(e is not None and e.toward > 0 for _, e, _ in blocks)
    gain = [round(SCALE * _odds(t, e, k, marked)) for t, e, k in blocks]
    edges, last = [], {}
    for i, (_, e, _) in enumerate(blocks):
        if i:
            before = blocks[i - 1][1]
            near = _nearness(before, e)
            edges.append((i - 1, i, round(SCALE * ADJACENT * near * near * _open(before, e))))
        up = (id(e.up), e.tag) if e is not None else None
        if up in last:
            edges.append((last[up], i, round(SCALE * SIBLING * _open(blocks[last[up]][1], e))))
        last[up] = i
    return gain, min_cut(gain, edges)


def _open(a, b) -> float:
    return BORDER if bool(a and a.away) != bool(b and b.away) else 1.0


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by empty lines."""
    blocks = blocks_of(page)
    return "\n\n".join(t for (t, _, _), keep in zip(blocks, labels(blocks)[1]) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    The page is cut into blocks at block-level tags; scripts, styles and the like never count. A classifier over
    length, links, punctuation and the enclosing elements' tags, roles, classes and ids gives each block a cost for
    either label; neighbours in the page and siblings in its tree are tied by edges, stronger the more ancestors
    they share, and the minimum cut labels all blocks at once. A null or empty html has the text ''; broken tags are
    read as far as they go; repeated rows each give a row and an empty table none."""
    base = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for start, pages_ in runs(batch.column(2)):
                texts = [main_text(p.as_py()) for p in pages_]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    return base.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
