"""Main text of web pages by two-pass block rules.

The first pass gives each block of text a score from its stop-word density, length and link density,
to which a mark of ownership and the element that holds it, where that says what it is for, add
evidence; a high score is text, a low one is not. The second pass gives the blocks in between, short
ones mostly, the label of the nearest decided neighbours in the same container, those of the same
element first.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .quality import STOP_WORDS

#: Elements whose text is never shown.
HIDDEN = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video head title".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tag -> open elements that it ends within their list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)} | dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot"))
#: Blocks across which a list item or a definition is looked for.
_LOOSE = frozenset("address div p li dt dd".split())
#: Elements that hold anything but the article.
ASIDE = frozenset("nav aside footer form menu dialog".split())
#: Words in an element's class, id or role that say the same.
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!with-)(?<!has-)(?<!no-)(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"footer|masthead|topbar|cookie|cookies|consent|notice|gdpr|alert|popup|modal|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|related|recommended|widget|pagination|pager|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: What marks an article element as a reader's comment or a teaser.
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|related|recommended|teaser)(?:$|[\s_-])", re.I)
#: Elements, and words in class, id or role, that hold the article.
ARTICLE, ARTICLE_NAMES = frozenset(("article", "main")), re.compile(r"(?:^|[\s_-])(?:article|main|post-body|entry-content|article-body|post-content)(?:$|[\s_-])", re.I)

#: How notices of ownership begin.
OWNED = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)

_BEGIN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_LETTERS = re.compile(r"[^\W\d_]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_STOP = frozenset(STOP_WORDS)

#: The first pass: stop-word share that is full evidence, characters at which a block's stop words and its length count in full,
#: weights of links, of a mark of ownership, of standing in an article, outside of the one that there is, and in an aside.
STOPS, ENOUGH, LONG, LINKS, MARK, INSIDE, OUTSIDE, BESIDE = 0.2, 140, 800, 3.0, 2.0, 3.0, 1.1, 4.0
#: Scores from which a block is text, and up to which it is not.
TEXT, NO_TEXT = 0.8, -0.5


class Tokens:
    """Tags of a page one after the other, in time that is linear in the page whatever its quotes and ends are."""

    def __init__(self, page: str):
        self.page, self.dead, self.bare, self.endless, self.raw = page, set(), len(page) + 1, len(page) + 1, set()

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, tag or None for a comment or declaration, closing, attributes) of what begins at or after ``at``."""
        page = self.page
        while m := _BEGIN.search(page, at):
            if m.group(1):
                end = page.find("-->", m.end() - 2)
                return m.start(), len(page) if end < 0 else end + 3, None, False, ""
            end = self._first_end(m.end()) if m.group(2) else self._tag_end(m.end())
            if end >= 0:
                return m.start(), end, m.group(4) and m.group(4).lower(), bool(m.group(3)), page[m.end() : end - 1]
            at = m.end()
        return None

    def _first_end(self, at: int) -> int:
        end = self.page.find(">", at) if at < self.endless else -1
        if end < 0:
            self.endless = min(self.endless, at)
        return end + 1 if end >= 0 else -1

    def _tag_end(self, at: int) -> int:
        """After the first > outside of quotes; where quotes never close, after the first > of all."""
        pos, seen = at, []
        while pos < self.bare:
            m = _QUOTE_OR_END.search(self.page, pos)
            if not m:
                self.bare = pos
                break
            if m.group() == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            close = self.page.find(m.group(), m.end())
            if close < 0:
                break
            pos = close + 1
        self.dead.update(seen)
        return self._first_end(at)

    def raw_end(self, tag: str, at: int) -> int:
        """After the end tag of an element whose content is no markup; -1 where there is none."""
        m = None if tag in self.raw else _RAW_END[tag].search(self.page, at)
        if not m:
            self.raw.add(tag)
        return m.end() if m else -1


class Block:
    """Text of one block with its shares and its container."""

    __slots__ = ("text", "links", "inside", "aside", "tag", "label")

    def __init__(self, text: str, links: int, inside: int, aside: bool, tag: str):
        self.text, self.links, self.inside, self.aside, self.tag, self.label = text, links, inside, aside, tag, None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; character references decoded, white space made single blanks."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    # open elements: (tag, makes aside, number of the article that it opens or 0)
    stack: list[tuple[str, bool, int]] = []
    asides, links, articles, inside = 0, 0, 0, 0
    # the articles that are open; places in the stack: of each tag, of blocks, of blocks that hold list items
    within: list[int] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []
    holders: list[int] = []

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, inside, asides > 0, stack[open_blocks[-1]][0] if open_blocks else ""))
        parts, linked = [], 0

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def pop() -> str:
        nonlocal asides, links, inside
        tag, aside, article = stack.pop()
        opened[tag].pop()
        for places in (open_blocks, holders):
            if places and places[-1] == len(stack):
                places.pop()
        asides -= aside
        links -= tag == "a"
        if article:
            within.pop()
            inside = within[-1] if within else 0
        return tag

    at, tokens = 0, Tokens(page)
    while token := tokens.next(at):
        start, end, tag, closing, attributes = token
        text_of(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in BLOCKS:
            close_block()
        if closing:
            depth = opened[tag][-1] if opened[tag] else len(stack)
            while len(stack) > depth:
                pop()
            continue
        self_closed = bool(_SELF_CLOSED.search(attributes))
        if tag in HIDDEN and tag != "head":
            raw = tokens.raw_end(tag, at) if tag in _RAW_END and not (self_closed and tag in ("iframe", "noscript", "template")) else -1
            if raw >= 0:
                at = raw
            elif not self_closed or tag in ("script", "style", "textarea", "title"):
                at = _hidden_end(tokens, at, tag, opened)
            continue
        if tag in EMPTY or self_closed or attributes.rstrip().endswith("/"):
            continue
        if tag in ENDS_P and open_blocks and stack[open_blocks[-1]][0] == "p":
            while len(stack) > open_blocks[-1] + 1:
                pop()
            pop()
        if tag in ENDS:  # an open one ends where the next begins
            last = lambda places: places[-1] if places else -1
            depth = max(last(opened[t]) for t in ENDS[tag])
            while depth > last(holders if tag in ("li", "dt", "dd") else opened["table"]) and len(stack) > depth:
                pop()
        names = " ".join(" ".join(filter(None, x)) for x in _NAMED.findall(attributes)) if "=" in attributes else ""
        article = (tag in ARTICLE or bool(names and ARTICLE_NAMES.search(names))) and not (names and COMMENT_NAMES.search(names))
        aside = not article and (tag in ASIDE or (tag == "header" and not inside) or bool(names and tag != "body" and tag != "html" and ASIDE_NAMES.search(names)))
        if article:
            articles += 1
            inside = articles
            within.append(articles)
        opened[tag].append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
            if tag not in _LOOSE:
                holders.append(len(stack))
        stack.append((tag, aside, articles if article else 0))
        asides += aside
        links += tag == "a"
    text_of(page[at:])
    close_block()
    return found


def _hidden_end(tokens: Tokens, at: int, hidden: str, opened: dict[str, list[int]]) -> int:
    """Where a hidden element that begins before ``at`` ends: after its end tag, before the end tag of an element around it, or with the page."""
    nested: dict[str, int] = defaultdict(int)
    depth = 1
    while token := tokens.next(at):
        start, at, tag, closing, attributes = token
        if tag is None:
            continue
        if tag == hidden:
            if not closing and hidden == "option":
                return start
            depth += -1 if closing else not _SELF_CLOSED.search(attributes)
            if not depth:
                return at
        elif closing and opened.get(tag) and not nested[tag]:
            return start
        elif closing:
            nested[tag] = max(0, nested[tag] - 1)
        elif tag in _RAW_END and (raw := tokens.raw_end(tag, at)) >= 0:
            at = raw
        elif tag not in EMPTY and tag not in ENDS and tag != "p":
            nested[tag] += 1
    return len(tokens.page)


def score(block: Block, known: bool, article: bool) -> float:
    """Evidence that a block is text. ``known``: the page has known stop words; ``article``: it has an article element."""
    words, length = _LETTERS.findall(block.text.lower()), len(block.text)
    stops = sum(w in _STOP for w in words) / max(1, len(words))
    fluent = min(stops / STOPS, 1.5) if known else 1.0
    value = fluent * min(length / ENOUGH, 1.0) + min(length / LONG, 0.5)
    value -= LINKS * block.links / max(1, length)
    if OWNED.match(block.text):
        value -= MARK
    if block.aside:
        return value - BESIDE
    return value + INSIDE if block.inside else value - OUTSIDE if article else value


def classify(page_blocks: list[Block]) -> None:
    """Labels every block True (text) or False, in two passes; what nothing around it decides stays only in an article."""
    article = any(b.inside and not b.aside for b in page_blocks)
    known = any(w in _STOP for b in page_blocks if not b.aside for w in _LETTERS.findall(b.text.lower()))
    for b in page_blocks:
        value = score(b, known, article)
        b.label = True if value >= TEXT else False if value <= NO_TEXT else None
    decided = [b.label for b in page_blocks]
    for low, high in _runs(page_blocks):
        before, last = {}, None
        for i in range(low, high):
            last = i if decided[i] is not None else last
            before[i] = last
        last = None
        for i in range(high - 1, low - 1, -1):
            last = i if decided[i] is not None else last
            if decided[i] is None:
                # a neighbour in another element counts as one place further away
                near = [(abs(k - i) + (page_blocks[k].tag != page_blocks[i].tag), decided[k]) for k in (before[i], last) if k is not None]
                close = min((d for d, _ in near), default=0)
                page_blocks[i].label = any(label for d, label in near if d == close) if near else bool(page_blocks[i].inside)


def _runs(page_blocks: list[Block]) -> Iterator[tuple[int, int]]:
    """Ranges of successive blocks in the same container."""
    low = 0
    for i in range(1, len(page_blocks) + 1):
        if i == len(page_blocks) or (page_blocks[i].inside, page_blocks[i].aside) != (page_blocks[low].inside, page_blocks[low].aside):
            yield low, i
            low = i


def main_text(page: str | None) -> str:
    """The article of a page, a line a block; empty for null and for pages without one."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to ``pages``; columns of these names are replaced.

    Null and empty pages have empty texts. Whole pages are read whatever their length; broken markup
    is taken as it comes. Repeated rows each get their row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            texts = [main_text(x.as_py()) for x in batch.column(column)]
            kept = [i for i, n in enumerate(batch.schema.names) if n in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(batch.schema.names[i] for i in kept), "text", "n_chars"])

    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema.add("text", "string").add("n_chars", "long")
    return pages.mapInArrow(run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 5 names."""
    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
