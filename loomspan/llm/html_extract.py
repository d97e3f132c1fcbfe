"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element is a line. Lines of menus, notices, forms and the like, and, where the page
marks its article, of anything outside it, are no text. Of the others, those of one list or table are one unit, every
other line is its own; a unit counts with the length of its text, and with ``PARAGRAPH`` more for each line that an
element names as text: headings, paragraphs, quotes, items, cells. Link lists count nothing. The sums over sliding windows
of ``WINDOW`` units surge where the main text begins and dive where it ends.

Inside a marked article everything that an element names as text stays whatever its length; windows decide about
lines of bare containers, which stay where a window with them reaches the surge. Without a marked article the text is
the units in windows that reach the surge, less bare short lines at both ends of such a stretch.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at a surge.
SURGE = 90
#: What a line that an element names as text counts besides its length: three of them are a surge, however short.
PARAGRAPH = SURGE // WINDOW
#: Share of link text from which a list of two lines or more, or a line of two links or more, is a link list.
LINKS = 0.5

# Element names of HTML, and words of class, id and role that name what is no main text. A name of several
# words, such as cookie-notice or ad-slot, counts if all its words are of these or say no more than where or how.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = frozenset("html body head div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr figure fieldset menu dialog select details center blockquote hgroup address search".split())
SKIPPED = frozenset("head nav footer aside form menu dialog select button fieldset search title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("p pre li td th dt dd figcaption caption summary".split())
LISTS = frozenset("ul ol dl table".split())
WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr hidden login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets complementary".split()
)
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content entry field fixed floating footer form group header heading holder inner item items label large left link links list main mobile outer panel primary "
    "region right row secondary section site slot small sticky text title top unit wrap wrapper".split()
)
#: Marks at the end of a sentence.
SENTENCE_ENDS = ".!?:;\u2026\u3002\uff01\uff1f\"'\u201d\u2019)"
#: Words that rule out an article or main element.
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored teaser".split())
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_QUOTE = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def _named(attributes: str, words: frozenset[str]) -> bool:
    """Whether a class, id, role or label of an element is made of ``words``, and of neutral ones besides."""
    if not attributes or "=" not in attributes:
        return False
    for names in _NAMES.findall(attributes):
        for name in names.strip("\"'").split():
            parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
            if not words.isdisjoint(parts) and all(w in words or w in WORDS or w in NEUTRAL for w in parts):
                return True
    return False


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Where the tag whose name ends at ``at`` ends; -1 if a quote in it stays open or nothing closes it.

    ``failed`` keeps the quotes that searches without success have opened: a later search that comes to one of them is
    lost as well, so that all searches of a page together are linear in its length.
    """
    opened = []
    while found := _QUOTE.search(page, at):
        at = found.end()
        if found[0] == ">":
            return at
        if at in failed:
            break
        opened.append(at)
        at = page.find(found[0], at) + 1
        if not at:
            break
    failed.update(opened)
    return -1


class Line(NamedTuple):
    text: str
    skipped: bool
    inside: bool  #: of a marked article
    linked: int  #: characters of links
    links: int
    element: str  #: the element that names it as text; empty for bare containers
    block: int  #: the number of the outermost list or table around it; -1 without


def lines_of(page: str) -> tuple[list[Line], bool]:
    """The lines of a page, and whether it marks an article."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name; skipped, in article, list or table, quoted: of the element and all around it
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked, links, in_link, off, element, marked, blocks = 0, 0, 0, False, "", False, 0
    at, n = 0, len(page)
    failed: set[int] = set()
    final = page.rfind(">")

    def flush():
        nonlocal held, linked, links, off, element
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            _, skipped, inside, block, quoted = stack[-1] if stack else ("", False, False, -1, False)
            lines.append(Line(text, off or skipped, inside, linked, links, element or ("li" if block >= 0 else "blockquote" if quoted else ""), block))
            held, linked, links = [], 0, 0
        off, element = False, ""

    while at < n:
        open_ = page.find("<", at)
        end = n if open_ < 0 else open_
        if end > at and not (stack and stack[-1][1] and stack[-1][0] in INLINE):
            held.append(page[at:end])
            linked += (end - at) * (in_link > 0)
        if open_ < 0:
            break
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = n if end < 0 else end + 3
            continue
        if page[open_ + 1 : open_ + 2] in ("!", "?"):
            end = page.find(">", open_)
            at = n if end < 0 else end + 1
            continue
        tag = _NAME.match(page, open_)
        if not tag:
            held.append("<")
            at = open_ + 1
            continue
        at = _tag_end(page, tag.end(), failed) if open_ < final else -1
        if at < 0:  # a tag cut off, or with a quote left open
            end = page.find(">", open_)
            at = n if end < 0 else end + 1
            continue
        closing, name, attributes = tag[1], tag[2].lower(), page[tag.end() : at - 1]
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "a":
            in_link = 0 if closing else 1
            links += in_link
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif closing:
                if stack and stack[-1][0] == name:
                    stack.pop()
                    opened[name] -= 1
            elif name not in VOID and (_named(attributes, WORDS) or _HIDDEN.search(attributes)):
                stack.append((name, True, *(stack[-1][2:] if stack else (False, -1, False))))
                opened[name] += 1
            continue
        flush()
        if name == "body" and not closing:
            stack.clear()
            opened.clear()
        if closing:
            if opened[name]:
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
            continue
        if name in VOID:
            continue
        _, skipped, inside, block, quoted = stack[-1] if stack else ("", False, False, -1, False)
        if name in ("article", "main"):
            named = _named(attributes, ARTICLE_WORDS)
            inside, marked = inside or not (named or skipped), marked or not (named or skipped)
        else:
            named = name in SKIPPED or (name == "header" and not inside) or (name not in ("html", "body") and _named(attributes, WORDS))
        if attributes and _HIDDEN.search(attributes):
            named = True
        if name in CONTAINERS or name in SKIPPED:
            if name in LISTS and block < 0:
                block, blocks = blocks, blocks + 1
            stack.append((name, skipped or named, inside, block, quoted or name == "blockquote"))
            opened[name] += 1
        else:
            off, element = named, name if name in TEXTS else ""
    flush()
    return lines, marked


def _units(lines: list[Line]) -> list[list[Line]]:
    """Lines in order, those of one list or table together."""
    units: list[list[Line]] = []
    for line in lines:
        if units and line.block >= 0 and units[-1][0].block == line.block:
            units[-1].append(line)
        else:
            units.append([line])
    return units


def _link_list(unit: list[Line]) -> bool:
    """Whether a unit is a list of links: two lines or two links at least, most of whose text they are, no heading; or a bare line that is a link."""
    if unit[0].element in HEADINGS:
        return False
    some = len(unit) > 1 or unit[0].links > 1 or not unit[0].element
    return some and sum(x.linked for x in unit) > LINKS * sum(len(x.text) for x in unit)


def main_text(page: str | None) -> str:
    """The kept lines, joined by line ends; empty for null and empty pages and pages without text."""
    if not page:
        return ""
    lines, marked = lines_of(page)
    some = [x for x in lines if x.text and not x.skipped and (x.inside or not marked)]
    units = [u for u in _units(some) if not _link_list(u)]
    weights = [sum(len(x.text) + PARAGRAPH * bool(x.element) for x in u) for u in units]
    dense = [False] * len(units)
    for i in range(max(1, len(units) - WINDOW + 1)):
        if sum(weights[i : i + WINDOW]) >= SURGE:
            dense[i : i + WINDOW] = [True] * len(dense[i : i + WINDOW])
    if marked:
        kept = [u for u, d in zip(units, dense, strict=True) if d or u[0].element]
    else:
        kept = _trimmed(units, dense)
    return "\n".join(x.text for u in kept or units or [some] for x in u)


def _trimmed(units: list[list[Line]], dense: list[bool]) -> list[list[Line]]:
    """The stretches of dense units without the bare lines at their ends that are short and no sentence."""
    kept: list[list[Line]] = []
    at = 0
    while at < len(units):
        end = at
        while end < len(units) and dense[end]:
            end += 1
        first, last = at, end
        weak = lambda u: not u[0].element and len(u[0].text) < PARAGRAPH and u[0].text[-1] not in SENTENCE_ENDS
        while first < last and weak(units[first]):
            first += 1
        while first < last and weak(units[last - 1]):
            last -= 1
        kept += units[first:last]
        at = end + 1
    return kept


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` and ``text``, ``n_chars`` of every row of pages.

    Null and empty html, and pages without text, give an empty text; very long pages, lines and attributes are read
    whole; ids may be null and rows repeat as they come; an empty table gives an empty one. Only the named columns are
    read, so that others may have any name.
    """
    some = pages.select(*carry, F.col(html_col).alias("__html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(carry))]
            columns = [*batch.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "text", "n_chars"])

    kinds = dict(some.dtypes)
    return some.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "text string", "n_chars long"]))
