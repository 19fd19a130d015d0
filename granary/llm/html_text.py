"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside elements that
never hold the article (menus, footers, sidebars, forms, scripts, headers
outside an article: by tag, role or a hidden attribute) are out at once. Other
elements only have a name, a class or an id, that says so: of an advert, a
notice, reader comments, a sidebar. Such a name is doubted where the rest of the page speaks
against it: where the element holds the article element or the main heading,
or where next to no prose is left without it. A header in an article is kept if
it holds a heading.

The first pass decides the rest by their own figures: link density, length, and
density of stop words, which are learnt as the words that very many pages
hold; in an article or main element less is asked for. Short blocks may stay
undecided, and so may a paragraph of an article that is mostly a link. In the
second pass an undecided block takes the label of its nearest decided
neighbours: kept between two good ones, or if the nearer of two is good; a
page's edge is no neighbour. Labels aren't handed across an article's border,
which counts as good inside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, quoted, with_fields, written

# HTML's tag names, by what they mean for a block.
BREAKING = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("aside button canvas dialog embed fieldset footer form head iframe menu nav noscript object option select svg template textarea video audio".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
OUTSIDE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
# Parts of a name that make it tell of a state or of the layout about the thing named ("no-sidebar", "comments-closed"), names of content, and what a header's name goes with where it isn't an article's or a section's.
STATES = frozenset("no not has have with without is are on off free enabled disabled active inactive closed open opened hidden fixed sticky visible layout grid col columns template theme type style mode".split())
CONTENT = frozenset("article body content entry hentry main post prose story text".split())
PAGE_HEADERS = frozenset("app blog global main nav page site sub top".split())
# Tags at whose start an open one of the same set ends, as HTML lets the end tag be left out.
IMPLIED_END = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
# Tags that end an open paragraph, and those that it may be beyond: a paragraph outside them stays open.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
PARAGRAPH_SCOPE = frozenset("button caption html marquee object table td template th".split())

#: A tag without quotes: most are. It never looks beyond the next angle bracket.
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^<>\"']*)>")
_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_TAG_PART = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOLD = re.compile("class|id|role|hidden|style", re.I)
_NAME_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"[^\W\d_]+")
# Numeric references of more digits than any character has: Python refuses to read very long numbers.
_ZEROS, _TOO_LONG = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
_HTML_TAG, _LANG = re.compile(r"<html(?=\s)", re.I), re.compile(r'\slang\s*=\s*["\']?([a-z]{2})', re.I)
#: Counted words, and their characters, that a task holds before it hands them on.
_HELD, _HELD_CHARS = 1 << 17, 8 << 20


@dataclass
class Rules:
    """Thresholds of the first pass, the stop words, and the language tags that they were learnt for."""

    stop_words: frozenset[str] = frozenset()
    languages: frozenset[str] = frozenset()
    link_density: float = 0.5
    short: int = 40
    long: int = 140
    stop_low: float = 0.1
    stop_high: float = 0.2


@dataclass
class Block:
    text: str
    tag: str
    linked: int
    inside: bool  # of an article or main element
    label: str = "?"
    element: int = -1  # the innermost element whose name or tag may put it out


@dataclass
class Element:
    """An element that may not belong to the article, by the word in its name or as an article's header."""

    above: int
    word: str
    exact: bool
    inside: bool
    anchor: bool = False  # whether it holds an article or main element, or a main heading
    heading: bool = False
    # Of the blocks in it and in no such element within it, all and those of an article: characters of prose, and of any text.
    own: list[int] = field(default_factory=lambda: [0, 0])
    text: list[int] = field(default_factory=lambda: [0, 0])
    prose: int = 0
    out: bool = True


def _outside_word(names: str) -> tuple[str, bool] | None:
    """The word in a class or an id that tells of something outside the article, and whether it is a whole name or one part of it: the first or the last, and no other tells of a state."""
    tokens, found = names.split(), None
    for token in tokens:
        low = token.lower()
        if low in OUTSIDE_NAMES:
            return low, True
        parts = [p.lower() for p in _NAME_PART.findall(token)]
        if not parts or not STATES.isdisjoint(parts):
            continue
        for word in (parts[-1], parts[0]):
            if word in OUTSIDE_NAMES and not (word == "header" == parts[-1] and len(parts) > 1 and PAGE_HEADERS.isdisjoint(parts)):
                found = found or (word, False)
    return None if found and any(t.lower() in CONTENT for t in tokens) else found


def _judged(tag: str, attributes: str, in_article: bool) -> bool | tuple[str, bool] | None:
    """True if an element can't belong to the article; the word, and whether it is a whole name, if its name or tag alone tells so; else None."""
    if tag in OUTSIDE or tag == "header" and not in_article:
        return True
    found = ("header", False) if tag == "header" else None
    if not attributes or not _TOLD.search(attributes):
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in OUTSIDE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main", "header"):
            word = _outside_word(value)
            found = word if word and (not found or word[1]) else found
    return found


class _Scanner:
    """The tags of a page in turn; each character is looked at a bounded number of times, however broken the markup."""

    def __init__(self, page: str):
        self.page, self.missing = page, {}

    def _find(self, what: str, start: int) -> int:
        """Like str.find; where there is nothing more to find, that is known from then on."""
        if start >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, start)
        if found < 0:
            self.missing[what] = start
        return found

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; quoted parts are skipped, but not from a quote that is never closed. -1: nowhere."""
        while self._find(">", at) >= 0:
            part = _TAG_PART.search(self.page, at)
            if part[0] == ">":
                return part.start()
            closed = self._find(part[0], part.end())
            at = part.end() if closed < 0 else closed + 1
        return -1

    def _raw_end(self, name: str, at: int) -> int:
        """Where the element's own end tag begins: nothing is a tag until there."""
        last = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(self.page, at)
        return last.start() if last else len(self.page)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes); comments and declarations have no name. A tag or comment that the page breaks off in ends with the page, as a comment."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if plain := _PLAIN_TAG.match(page, at):
                start, at, tag = at, plain.end(), plain[2].lower()
                yield start, at, tag, plain[1] == "/", plain[3]
                if tag in RAW and not plain[1]:
                    at = self._raw_end(tag, at)
                continue
            start, closing = at, page.startswith("/", at + 1)
            name = _TAG_NAME.match(page, at + 1 + closing)
            if name:
                end = self._tag_end(name.end())
            elif page.startswith("<!--", at):
                end = self._find("-->", at + 4)
                end = end + 2 if end >= 0 else -1
            elif page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:
                end = self._find(">", at)
            else:
                at += 1
                continue
            at = end + 1 if end >= 0 else len(page)
            yield (start, at, name[0].lower(), closing, page[name.end() : end]) if name and end >= 0 else (start, at, "", False, "")
            if name and end >= 0 and not closing and name[0].lower() in RAW:
                at = self._raw_end(name[0], at)


def _decoded(parts: list[str]) -> str:
    text = "".join(parts)
    if "&#" in text:
        text = _TOO_LONG.sub("\ufffd", _ZEROS.sub("&#", text))
    return " ".join(html.unescape(text).split())


def _parsed(page: str) -> tuple[list[Block], list[Element]]:
    """All blocks of a page but those in elements that can't belong to the article, and the elements whose names tell so. Time is linear in the page."""
    found: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, whether it is out, the innermost element above
    opened: Counter[str] = Counter()
    paragraphs = [0]  # open ones, in each scope
    out, article, links, element = 0, 0, 0, -1
    parts: list[tuple[str, bool]] = []
    tag_now, at, raw = "body", 0, False

    def close() -> str:
        nonlocal out, article, links, element
        name, was, element = stack.pop()
        opened[name] -= 1
        out -= was
        article -= name in ("article", "main")
        links -= name == "a"
        if name == "p":
            paragraphs[-1] -= 1
        elif name in PARAGRAPH_SCOPE:
            paragraphs.pop()
        return name

    def flush() -> None:
        if parts:
            # References are decoded over the whole block: an end of text inside one is none in the block.
            text = _decoded([t for t, _ in parts])
            if text:
                inside_links = [t for t, a in parts if a]
                linked = len(_decoded(inside_links)) if inside_links else 0
                found.append(Block(text, tag_now, linked, article > 0, element=element))
            parts.clear()

    def told(what: str) -> None:
        at = element
        while at >= 0 and not getattr(elements[at], what):
            setattr(elements[at], what, True)
            at = elements[at].above

    for start, end, tag, closing, attributes in _Scanner(page).tags():
        if not raw and not out and start > at:
            parts.append((page[at:start], links > 0))
        at, raw = end, False
        if not tag:
            continue
        if tag in BREAKING:
            flush()
            tag_now = "body" if closing else tag
        if closing:
            while opened[tag] and close() != tag:
                pass
            continue
        if tag in ENDS_PARAGRAPH and paragraphs[-1]:
            while close() != "p":
                pass
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in IMPLIED_END and stack and stack[-1][0] in IMPLIED_END[tag]:
            close()
        judged, raw = _judged(tag, attributes, article > 0), tag in RAW
        was = judged is True or raw
        stack.append((tag, was, element))
        opened[tag] += 1
        out += was
        if not out:
            if tag in ("article", "main", "h1"):
                told("anchor")
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                told("heading")
            if judged:
                elements.append(Element(element, *judged, article > 0))
                element = len(elements) - 1
        article += tag in ("article", "main")
        links += tag == "a"
        if tag == "p":
            paragraphs[-1] += 1
        elif tag in PARAGRAPH_SCOPE:
            paragraphs.append(0)
    if not raw and not out and at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return found, elements


def _doubted(found: list[Block], elements: list[Element], short: int, few: int = 200) -> None:
    """Set each element's ``out``: whether the rest of the page bears out what its name tells.

    It doesn't where the element holds the article element or a main heading,
    or most of the prose of its article or page while less than ``few``
    characters of it are left without; if its name is a whole word, while no text
    but headings is left in an article, or on a page that has none.
    """
    free, whole, text = [0, 0], [0, 0], [0, 0]  # prose that no name speaks against, all prose, and the former's text of any length but headings; of the page, and of its articles
    article = any(b.inside for b in found)
    for b in found:
        prose = len(b.text) * (len(b.text) >= short and 2 * b.linked <= len(b.text))
        size = len(b.text) * (re.fullmatch("h[1-6]", b.tag) is None)
        own, any_text = (elements[b.element].own, elements[b.element].text) if b.element >= 0 else (free, text)
        for scope in {False, b.inside}:
            whole[scope] += prose
            own[scope] += prose
            any_text[scope] += size
    for e in reversed(elements):
        e.prose += e.own[0]
        if e.above >= 0:
            elements[e.above].prose += e.prose
    for e in elements:
        if e.above >= 0 and elements[e.above].out:
            continue
        if e.word == "header" and e.inside and e.heading:
            e.out = False
        else:
            bare = text[e.inside or article] == 0 if e.exact else free[e.inside] < few
            e.out = not (e.anchor or 2 * e.prose > whole[e.inside] and bare)
        if not e.out:
            for scope in (0, 1):
                free[scope] += e.own[scope]
                text[scope] += e.text[scope]
    outer = [e for e in elements if e.out and (e.above < 0 or not elements[e.above].out)]
    if 10 * free[article] < whole[article]:  # a word that so many elements bear that next to nothing is left is no name of what stands outside
        by_word: Counter[str] = Counter()
        for e in outer:
            by_word[e.word] += e.prose * (e.inside or not article)
        for word, prose in by_word.most_common(1):
            if 2 * prose > whole[article]:
                for e in elements:
                    e.out = e.out and e.word != word
    for e in elements:
        e.out = e.out or e.above >= 0 and elements[e.above].out


def blocks(page: str, short: int = 40) -> list[Block]:
    """The blocks of a page that aren't in an element outside the article, in page order; blocks of ``short`` characters count as prose."""
    found, elements = _parsed(page)
    if elements:
        _doubted(found, elements, short)
    return [b for b in found if b.element < 0 or not elements[b.element].out]


def first_pass(block: Block, rules: Rules) -> str:
    """good, bad, or ? where a short block's own figures don't tell; ~ for an article's block that is mostly a link."""
    n = len(block.text)
    if block.linked / n > rules.link_density:
        return "~" if block.inside else "bad"
    heading = re.fullmatch("h[1-6]", block.tag) is not None
    if heading or n < rules.short:
        return "?"
    stops = _share(block, rules)
    if block.inside:  # the page itself says that this is the article: less length and fewer stop words tell
        return "good" if stops >= rules.stop_low or not rules.stop_words else "?"
    if stops >= rules.stop_high or not rules.stop_words:
        return "good" if n > rules.long else "?"
    return "?" if stops >= rules.stop_low or not block.linked else "bad"  # lists and names hold no stop words


def _menus(found: list[Block], short: int, run: int = 3) -> None:
    """Label ``bad`` the runs of an article's short list items that are links alone: a menu, a table of contents."""
    item = [b.label == "~" and b.tag == "li" and b.linked == len(b.text) < short for b in found]
    a = 0
    while a < len(found):
        b = a
        while b < len(found) and item[b]:
            b += 1
        for x in found[a:b] if b - a >= run else ():
            x.label = "bad"
        a = max(a + 1, b)


def _language(page: str) -> str:
    tag = _HTML_TAG.search(page)
    found = _LANG.search(page, tag.end(), page.find(">", tag.end()) + 1 or len(page)) if tag else None
    return found[1].lower() if found else ""


def _share(block: Block, rules: Rules) -> float:
    words = _WORDS.findall(block.text.lower())
    return sum(map(rules.stop_words.__contains__, words)) / max(1, len(words))


def main_text(page: str, rules: Rules) -> str:
    found = blocks(page)
    if not (tag := _language(page)) or tag not in rules.languages:
        if all(_share(b, rules) < rules.stop_low for b in found if len(b.text) >= rules.short):
            rules = replace(rules, stop_words=frozenset())  # a language that none were learnt of: length and links decide
    for b in found:
        b.label = first_pass(b, rules)
    _menus(found, rules.short)
    good = {id(b) for side in (True, False) for b in _second_pass([b for b in found if b.inside is side])}
    if not good:  # nothing is decided for good: what the page calls the article, or else sentences
        good = {id(b) for b in found if b.label == "?" and (b.inside or len(b.text) >= rules.short and _share(b, rules) >= rules.stop_low)}
    return "\n\n".join(b.text for b in found if id(b) in good)


def _second_pass(found: list[Block]) -> list[Block]:
    """The good blocks of ``found``: the article's or the others, so that labels aren't handed across its border."""
    n = len(found)
    before: list[tuple[str, int]] = []
    edge = "good" if n and found[0].inside and any(b.label == "good" for b in found) else ""  # a page's edge is no neighbour
    last = (edge, -1)
    for i, b in enumerate(found):
        before.append((last[0], i - last[1]) if b.label != "~" or last[1] >= 0 else ("", 0))
        if b.label not in "?~":
            last = (b.label, i)
    keep = [b.label == "good" for b in found]
    last = (edge, n)
    for i in range(n - 1, -1, -1):
        b = found[i]
        if b.label not in "?~":
            last = (b.label, i)
            continue
        (left, near), (right, far) = before[i], (last[0], last[1] - i)
        if b.label == "~":  # mostly a link: only within the text
            keep[i] = left == right == "good" and last[1] < n
        else:
            keep[i] = "good" in (left, right) and (left == right or not left or not right or (near <= far if left == "good" else far <= near))
    return [b for b, k in zip(found, keep) if k]


def stop_words(pages: DataFrame, share: float = 0.3) -> tuple[frozenset[str], frozenset[str]]:
    """Words that at least ``share`` of all pages with the same language tag hold, two pages at least, counted over whole pages; and the tags that have any. Pages without a tag are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}
        held = chars = 0

        def counted() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

        for batch in batches:
            for page in batch.column(0):
                own = counts.setdefault(_language(page := page.as_py()), Counter())
                words = {""}.union(*(_WORDS.findall(b.text.lower()) for b in blocks(page)))  # the empty word counts the pages
                chars += sum(map(len, filterfalse(own.__contains__, words)))
                held -= len(own)
                own.update(words)
                held += len(own)
                if held > _HELD or chars > _HELD_CHARS:
                    yield counted()
                    counts.clear()
                    held = chars = 0
        yield counted()

    found = written(map_batches(pages.where(F.length("html") > 0).select("html"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # A tag is two letters from a to z, or none: 677 rows at most.
    total = F.broadcast(found.where("word = ''").select("lang", F.col("n").alias("pages")))
    kept = found.where("n > 1 AND word <> ''").join(total, "lang").where(F.col("n") >= share * F.col("pages")).select("lang", "word").collect()
    return frozenset(r["word"] for r in kept), frozenset(r["lang"] for r in kept)


def extracted(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``pages`` (html and any other columns) with ``text`` in place of html: the main text's blocks, joined by an empty line.

    Whole pages are read. A null, empty or blank page gives "". Repeated rows
    stay; a column that is called text already is replaced; an empty table
    gives no rows. Without ``rules`` the stop words are learnt from the pages.
    """
    rules = rules or Rules(*stop_words(pages))
    shared = pages.sparkSession.sparkContext.broadcast(rules)
    kept = pages.select(*quoted(c for c in pages.columns if c.lower() not in ("text", "html")), "html")
    names = kept.columns[:-1]
    schema = with_fields(kept.schema.fields[:-1], "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    return map_batches(kept, run, schema)
