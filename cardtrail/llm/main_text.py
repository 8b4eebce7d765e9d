"""Main text of HTML pages by the distribution of text over line blocks.

1. Strip markup: scripts, styles, comments and the head go; every block-level tag starts
   a new line; character references are decoded; white space inside a line becomes one
   space. A line remembers whether it stands in boilerplate (a menu, header, footer,
   sidebar, advert, form or comment container, by tag, role, class or id; or one whose
   name is vague, such as notice or share, unless it holds a heading of the first rank or
   an article container), in an article container, in which block, and how much of it is
   link text.
2. Weigh: a line weighs its characters outside links, boilerplate lines nothing.
3. Surge and dive: over sums of ``window`` consecutive lines, a surge is where the sum
   rises from 0 and a dive where it falls back to 0; the lines between a surge and its
   dive form a stretch. The stretch of the largest sum is kept with all stretches of at
   least ``share`` of it; of lighter ones the lines stay that stand in a container of
   lines of these.
4. Check by article containers: of a kept stretch, the lines inside article containers
   and those outside are two groups, and a group of less than ``share`` of the other's
   weight is left out (teasers beside a plain text, stray lines beside an article). If
   the heaviest stretch lies mostly inside, the page's other article lines are kept too.
5. The kept lines, in page order, are the text; boilerplate lines and, outside of such
   articles, lines that are mostly links are left out, short lines between long ones stay.

Null and empty pages give an empty text. Broken markup (unclosed tags, cut pages) is read
as far as it goes; a quote that opens a value but has no end that space, / or > follows is
a character of the value, which ends at the tag's end. Every row gives one result row; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from cardtrail.llm.common import map_batches

#: Tags that start and end a block (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead tr ul".split())
#: Tags without content (fixed values).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never text of the page (fixed values).
HIDDEN_TAGS = frozenset("script style noscript template head title textarea select button iframe object svg canvas".split())
#: Tags of boilerplate containers (fixed values).
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that mark a boilerplate container (fixed values).
BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|"
    r"disqus|footer|gdpr|masthead|menu|nav|navbar|navigation|newsletter|pagination|popup|promo|"
    r"related|replies|respond|sidebar|sitemap|sponsor|sponsored|subscribe|toolbar)(?:$|[\s_-])")
#: Words that name boilerplate or content: such a block is boilerplate unless it holds one of HOLDS.
#: ``widget`` counts only as a whole name, for page builders wrap content in x-widget-y.
VAGUE_NAME = re.compile(r"(?:^|[\s_-])(?:discussion|notice|promotion|share|sharing|social)(?:$|[\s_-])|(?:^|\s)widget(?:$|\s)")
#: Tags that show that a block holds the page's text (fixed values).
HOLDS = frozenset("article h1 main".split())
#: Classes of an <article> that is a reader's comment; its other names may be topics.
COMMENT_CLASS = re.compile(r"(?:comment|reply)(?:[_-](?:body|content|item|text|wrap|wrapper|\d+))?")
#: Names that say what stands beside a container, not what it is: has-sidebar, no-ads.
LAYOUT_NAME = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|show|hide)[_-][\w-]+")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|[^>])*+)(?:>|\Z)""", re.S)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.S | re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
#: One attribute: its whole name, then its value, quoted or not, if it has one.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?)?""")
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _attributes(text: str) -> dict[str, str]:
    """Lower-case names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _is_boiler(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether a tag opens a boilerplate container, and whether its name is vague."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True, False
    if tag in ("body", "html", "main") or not attributes:
        return False, False
    of = _attributes(attributes)
    if "hidden" in of or of.get("aria-hidden") == "true" or of.get("role") in BOILER_ROLES:
        return True, False
    if tag == "article":
        return any(COMMENT_CLASS.fullmatch(c) for c in of.get("class", "").split()), False
    names = [LAYOUT_NAME.sub(" ", of[n]) for n in ("class", "id") if n in of]
    return any(map(BOILER_NAME.search, names)), tag in BLOCK_TAGS and any(map(VAGUE_NAME.search, names))


class Open(NamedTuple):
    """An open element: its flags hold for all below it. ``vague``: the lines and HOLDS tags
    before it, if its name is vague."""

    tag: str
    boiler: bool
    hidden: bool
    article: bool
    link: bool
    number: int
    vague: tuple[int, int] | None


PAGE = Open("", False, False, False, False, 0, None)


class Line(NamedTuple):
    text: str
    linked: int
    boiler: bool
    article: bool
    container: int


class _Page:
    """What stands open and what was read so far. Every step looks at the innermost
    elements only, or at those that it closes."""

    def __init__(self):
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.linked: list[str] = []
        self.stack = [PAGE]
        self.blocks = [0]                 # places of PAGE and the open block tags in the stack
        self.inline = [Counter()]         # open inline tags above each of these
        self.open_blocks: Counter = Counter()
        self.elements = self.holds = 0
        self.vague: list[tuple[int, int]] = []  # lines of vague containers that hold no text of the page

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.words)).split())
        if text:
            top = self.stack[-1]
            links = min(len(text), len(" ".join(unescape("".join(self.linked)).split())))
            container = self.stack[self.blocks[-2] if len(self.blocks) > 1 else 0].number  # what the line's block stands in
            self.lines.append(Line(text, links, top.boiler, top.article, container))
        self.words.clear()
        self.linked.clear()

    def say(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.hidden:
            self.words.append(text)
            if top.link:
                self.linked.append(text)

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            top = self.stack[-1]
            if top.tag in BLOCK_TAGS or top.boiler != self.stack[-2].boiler:
                self.flush()
            self.stack.pop()
            if top.tag in BLOCK_TAGS:
                self.blocks.pop()
                self.inline.pop()
                self.open_blocks[top.tag] -= 1
            else:
                self.inline[-1][top.tag] -= 1
            if top.vague is not None and self.holds == top.vague[1] and len(self.lines) > top.vague[0]:
                self.vague.append((top.vague[0], len(self.lines)))

    def end(self, tag: str) -> None:
        """An end tag; an inline one doesn't close blocks."""
        if tag in BLOCK_TAGS:
            if self.open_blocks[tag]:
                self.close(next(i for i in reversed(self.blocks) if self.stack[i].tag == tag))
            self.flush()
        elif self.inline[-1][tag] > 0:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.close(at)

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK_TAGS
        if block:
            self.flush()
            for at in range(len(self.blocks) - 1, 0, -1):
                inner = self.stack[self.blocks[at]].tag
                if tag in CLOSED_BY.get(inner, ()):
                    self.close(self.blocks[at])
                    break
                if inner != "p":
                    break
        up = self.stack[-1]
        boiler, vague = (True, False) if up.boiler else _is_boiler(tag, attributes, up.article)
        if boiler and not up.boiler:
            self.flush()
        self.elements += 1
        article = tag in ("article", "main")
        self.stack.append(Open(tag, boiler, up.hidden or tag in HIDDEN_TAGS, up.article or article, up.link or tag == "a", self.elements,
                               (len(self.lines), self.holds) if vague and not boiler else None))
        self.holds += tag in HOLDS
        if block:
            self.blocks.append(len(self.stack) - 1)
            self.inline.append(Counter())
            self.open_blocks[tag] += 1
        else:
            self.inline[-1][tag] += 1


def page_lines(html: str) -> list[Line]:
    """The non-empty lines of a page."""
    page = _Page()
    at = 0
    while True:
        m = TOKEN.search(html, at)
        page.say(html[at:m.start() if m else len(html)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
        elif tag == "br":
            page.say(" ")
        elif tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                page.flush()
        elif not (m[3].rstrip().endswith("/") and tag in ("svg", "iframe", "script")):
            page.start(tag, m[3])
            if tag in RAW_END:
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                page.close(len(page.stack) - 1)
    page.close(1)
    page.flush()
    out, done = list(page.lines), 0
    for a, b in sorted(page.vague):
        for i in range(max(a, done), b):
            out[i] = out[i]._replace(boiler=True)
        done = max(done, b)
    # a page with nothing else keeps its vague blocks
    return out if any(not line.boiler and len(line.text) > line.linked for line in out) else page.lines


def main_text(html: str | None, window: int = 3, share: float = 0.3) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    lines = page_lines(html) if html else []
    weights = [0 if line.boiler else len(line.text) - line.linked for line in lines]
    sums = [sum(weights[max(0, i - window + 1):i + 1]) for i in range(len(lines))]
    stretches, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i                                   # surge
        elif not total and start is not None:
            stretches.append((sum(weights[start:i]), start, i))  # dive
            start = None
    kept = [False] * len(lines)
    most, home = 0, False
    for total, a, b in stretches:
        inside = sum(weights[i] for i in range(a, b) if lines[i].article)
        if total > most:
            most, home = total, inside * 2 >= total
    text_like = [weight * 2 >= len(line.text) for weight, line in zip(weights, lines)]
    containers = {lines[i].container for total, a, b in stretches if total >= share * most for i in range(a, b) if text_like[i]}
    for total, a, b in stretches:
        if total < share * most:
            for i in range(a, b):
                kept[i] = text_like[i] and lines[i].container in containers
            continue
        inside = sum(weights[i] for i in range(a, b) if lines[i].article)
        groups = {True: inside >= share * (total - inside), False: total - inside >= share * inside}
        for i in range(a, b):
            kept[i] = groups[lines[i].article] and text_like[i]
    return "\n".join(line.text for line, keep in zip(lines, kept) if not line.boiler and (keep or home and line.article))


def extract_main_text(pages: DataFrame, window: int = 3, share: float = 0.3) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) of every page."""

    def run(batches):
        for pdf in batches:
            text = [main_text(h, window, share) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
