"""Main text of web pages by the line-block distribution: text lengths over sliding windows of lines, surge to dive."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import parts
from cashlens.llm.shelf import Shelf

# Element names of HTML by their role, and words in class, id and role that mark parts beside the article.
RAW = "script style noscript template iframe svg math canvas object head title textarea select option datalist".split()
BOILER = "nav header footer aside form button menu dialog label".split()
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul"
).split()
CLOSED_BY_BLOCK = "p h1 h2 h3 h4 h5 h6 dt dd li td th tr option".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav "
    "navbar navigation menu topbar breadcrumb breadcrumbs header masthead footer foot copyright cookie cookies consent gdpr "
    "notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus discussion share "
    "sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar "
    "form hidden contentinfo complementary navigation".split()
)
# Words that say where or what such a part is, and decide nothing by themselves.
PLACE_WORDS = frozenset(
    "site page left right top bottom primary secondary upper lower sticky fixed floating mobile desktop global list item items "
    "bar box block area section container wrap wrapper inner outer panel column col links link buttons button icons".split()
)
# Parts that hold articles of their own: those in them don't show that they wrap the page's article.
OWN_ARTICLES = frozenset(
    "aside nav footer dialog menu button label related recommended comment comments commentlist reply replies respond disqus "
    "discussion".split()
)
EMPTY = frozenset(VOID + RAW)  # elements without content, which hide nothing; raw ones are left in the tokens only if self-closed
MAIN = ("article", "main")
UNMARKED, IN_MAIN, IN_ARTICLE = 0, 1, 2  # what marks a block as text of the article, by strength
NAMING = ("class", "id", "role")

WINDOW = 3  # lines in a block of the distribution
SURGE = 80  # characters in a block at which text begins, where no element marks the article; where one does, any text is
LINK_SHARE = 0.7  # of a line's characters in links, from which on it is a menu line

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TOKEN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>""")
# Attributes are consumed in order, values with them, so that no name is found inside a value.
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+""")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


def _beside(name: str, attributes: str, in_main: bool) -> str:
    """The word that names an element as something beside the article, or "". A header inside the article carries its title.

    A token of a class, id or role names it if all words of the token do so, or say where it is: sidebar, site-footer and
    cookie-notice, but not has-sidebar.
    """
    if name in BOILER and not (name == "header" and in_main):
        return name
    if not attributes or name in ("html", "body", *MAIN):
        return ""
    found = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            found.add("hidden")
        if key in NAMING:
            for token in value.split():
                words = _WORDS.findall(token)
                if all(w in BOILER_WORDS or w in PLACE_WORDS for w in words):
                    found.update(w for w in words if w in BOILER_WORDS)
    return min(found, key=lambda w: (w not in OWN_ARTICLES, w), default="")


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close. Comments and the inside of raw elements are gone."""
    page = _COMMENT.sub("", page)
    out, at = [], 0
    while tag := _TOKEN.search(page, at):
        if tag.start() > at:
            out.append(("text", page[at : tag.start()], ""))
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            out.append(("close", name, ""))
        elif name in _RAW_END and not (tag[3] or tag[6] or "").endswith("/"):
            end = _RAW_END[name].search(page, at)
            # A raw element that is never closed ends with the head, or with its own tag.
            at = end.end() if end else at
            out.append(("open", "br", ""))
        else:
            out.append(("open", name, tag[3] or tag[6] or ""))
    if at < len(page):
        out.append(("text", page[at:], ""))
    return out


def _ends(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each opening tag: where its element ends. An element that is never closed ends at its own tag."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in VOID:
            if name in BLOCK:
                for short in CLOSED_BY_BLOCK:
                    for j in open_.pop(short, ()) if short == name or short[0] in "ph" else ():
                        ends[j] = i
            open_.setdefault(name, []).append(i)
        elif kind == "close":
            if open_.get(name):
                ends[open_[name].pop()] = i
            if name in BLOCK:
                for j in open_.pop("p", ()):
                    ends[j] = i
    return ends


class _Contents:
    """What elements hold: characters outside links, article and main elements, as sums up to each token."""

    def __init__(self, tokens: list[tuple[str, str, str]], ends: dict[int, int]):
        self.free, self.articles, self.mains = [0], [0], [0]
        link_until = 0
        for i, (kind, name, _) in enumerate(tokens):
            opens = kind == "open"
            if opens and name == "a":
                link_until = max(link_until, ends.get(i, i))
            self.free.append(self.free[-1] + (len(name.strip()) if kind == "text" and i >= link_until else 0))
            self.articles.append(self.articles[-1] + (opens and name == "article"))
            self.mains.append(self.mains[-1] + (opens and name == "main"))

    def wraps(self, start: int, end: int, word: str, in_main: bool) -> bool:
        """Whether an element named by `word` is a wrapper: it holds article or main, or most text outside links.

        A short part of a short article can be most of it: inside article and main, it must be all or SURGE characters.
        """
        inside = lambda sums: sums[end] - sums[start]
        most = 2 * inside(self.free) > self.free[-1]
        most = most and (not in_main or inside(self.free) >= min(SURGE, self.free[-1]))
        if inside(self.mains):
            return True
        if word in OWN_ARTICLES:
            return most and inside(self.articles) == self.articles[-1]
        return most or inside(self.articles) > 0


class _Blocks:
    """The open block elements, as tokens are passed in order."""

    def __init__(self, tokens: list[tuple[str, str, str]], ends: dict[int, int]):
        self.tokens, self.ends = tokens, ends
        self.open: list[int] = []
        self.holders: set[int] = set()  # elements with block elements in them

    def at(self, i: int) -> None:
        while self.open and self.ends[self.open[-1]] <= i:
            self.open.pop()
        if self.tokens[i][0] == "open" and self.tokens[i][1] in BLOCK and i in self.ends:
            self.holders.update(self.open[-1:])
            self.open.append(i)

    def place(self) -> tuple[int, int]:
        """The innermost element and the one around it; -1 is the page."""
        around, own = [-1, -1, *self.open][-2:]
        return own, around


def page_lines(page: str) -> list[tuple[str, int, bool, int, int, bool]]:
    """Each block of text, in page order.

    (text, characters in links, beside the article, what marks it, the element that holds the block, whether the block is a
    paragraph of its own)
    """
    tokens = _tokens(page)
    ends = _ends(tokens)
    contents = _Contents(tokens, ends)
    blocks = _Blocks(tokens, ends)
    lines: list[tuple[str, int, bool, int, tuple[int, int]]] = []
    held: list[str] = []
    linked = beside_until = article_until = main_until = link_until = 0
    state = (False, UNMARKED)
    place = (-1, -1)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            lines.append((text, linked, *state, place))
        held.clear()
        linked = 0

    for i, (kind, name, attributes) in enumerate(tokens):
        if kind == "text":
            held.append(name)
            if not name.isspace():
                blocks.at(i)
                place = blocks.place()
            if i < link_until:
                linked += len(name.strip())
            continue
        if name == "br":
            held.append(" ")
            continue
        if kind == "open":
            if name in MAIN:
                until = ends.get(i, len(tokens))
                main_until = max(main_until, until)
                article_until = max(article_until, until if name == "article" else 0)
            elif name == "a":
                link_until = max(link_until, ends.get(i, i))
            if name not in EMPTY and i >= beside_until and (word := _beside(name, attributes, i < main_until)):
                end = min(ends.get(i, i + 2), len(tokens))
                beside_until = i if contents.wraps(i, end, word, i < main_until) else end
        new = (i < beside_until, IN_ARTICLE if i < article_until else IN_MAIN if i < main_until else UNMARKED)
        if name in BLOCK or new != state:
            flush()
            state = new
        blocks.at(i)
    flush()
    out = []
    for *line, (own, around) in lines:
        # Text between the blocks of an element is a block of its own.
        out.append((*line, own if own in blocks.holders else around, own >= 0 and tokens[own][1] == "p"))
    return out


def line_lengths(lines: list[tuple[str, int, bool, int, int, bool]]) -> list[int]:
    """What each line adds to the windows that cover it: its characters, or 0 for a line of a menu.

    A line of links is one of a menu, except in article, whose lists of links are its own, and in main, unless a whole
    window is of such lines.
    """
    length = [len(line[0]) for line in lines]
    run = 0
    for i, (text, linked, _, mark, *_) in enumerate(lines):
        link = linked >= LINK_SHARE * len(text)
        run = run + 1 if link and mark == IN_MAIN else 0
        if link and mark == UNMARKED:
            length[i] = 0
        elif run >= WINDOW:
            first = i - WINDOW + 1 if run == WINDOW else i
            length[first : i + 1] = [0] * (i + 1 - first)
    return length


def text_regions(length: list[int], surge: int) -> list[range]:
    """Runs of lines from a surge, a line with text whose window reaches `surge`, to the dive, where windows hold nothing."""
    window = [0] * (len(length) + 1)
    for i in range(len(length) - 1, -1, -1):
        window[i] = window[i + 1] + length[i] - (length[i + WINDOW] if i + WINDOW < len(length) else 0)
    regions, start = [], None
    for i in range(len(length) + 1):
        if start is None and i < len(length) and length[i] and window[i] >= surge:
            start = i
        elif start is not None and not window[i]:
            regions.append(range(start, i))
            start = None
    return regions


def main_blocks(page: str | None) -> list[str]:
    """Blocks of the article: those between a surge and a dive of the distribution, on every page.

    Blocks beside the article are no lines of the distribution. Article and main elements are evidence: blocks outside
    them are no lines either, any text is a surge in them, and a region in them counts whatever its size.

    Where no element marks the article, a region of less than a fifth of the largest is dropped. Text that begins later or
    ends earlier than the distribution says then joins as a sibling: regions that the same element holds as blocks of the
    article, and paragraphs among its paragraphs.
    """
    lines = [line for line in page_lines(page or "") if not line[2]]
    marked = any(line[3] for line in lines)
    if marked:
        lines = [line for line in lines if line[3]]
    length = line_lengths(lines)
    longest = max(length, default=1)
    if not longest and marked:  # nothing but a menu is marked, so it's what the page is about
        return [line[0] for line in lines]
    regions = text_regions(length, 1 if marked else min(SURGE, max(1, longest // 2)))
    if marked:
        return [lines[i][0] for region in regions for i in region]
    size = [sum(length[i] for i in region) for region in regions]
    kept = {i for region, s in zip(regions, size) if 5 * s >= max(size) for i in region}
    within = {lines[i][4] for i in kept if length[i]}
    paragraphs = {lines[i][4] for i in kept if length[i] and lines[i][5]}
    for region in regions:
        if any(length[i] and lines[i][4] in within for i in region):
            kept.update(region)
    kept.update(i for i, line in enumerate(lines) if length[i] and line[5] and line[4] in paragraphs)
    return [lines[i][0] for i in sorted(kept)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "html"):
        texts = ["\n\n".join(main_blocks(page)) for page in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by an empty line), n_chars.

    Null and empty pages, and pages without main text, give an empty text. Text that no element encloses counts as a
    line. An element that is never closed ends at its own tag, so a stray opening tag doesn't swallow the page. Repeated
    pages give repeated rows; an empty table gives none; other columns are ignored.
    """
    Shelf(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
