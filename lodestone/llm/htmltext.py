"""HTML extraction: flat text blocks, their neighbours' word counts and link densities, and a decision tree.

A page is cut into blocks at block-level tags. Each block has its number of words, the share of its words
inside links, the same of the block before and after it, and what encloses it: the article or main
element, a heading, whether a container around it is furniture (navigation, header, footer, aside, form,
or hidden), and whether one is marked as such by its class, id or role alone. A mark is whole tokens, is
weighed with the rest, and ends at an article or main element. A decision tree (CART by Gini impurity)
tells main text from the rest. It is trained on the small labelled table below whenever the operator is
set up: pages written for this purpose, with and without an article element, as sequences of blocks, so
that each block has the neighbours that it has on its page.

What a marked or hidden inline element holds is weighed by itself; the flags of the block around it are
those of the block-level elements that enclose it.

Edge cases: a null or empty page, or one without main text, gives the empty text; markup that is cut
short or unclosed is read as far as it goes; repeated rows give repeated results; extra columns stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import arrow_rows

#: HTML elements.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIP = frozenset("script style noscript template head title select textarea button svg math iframe object embed canvas audio video map datalist".split())
#: What can stand in a head. Anything else ends one whose end tag is left out, as its text does.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset search".split())
#: Elements that end where another of the group begins.
ENDS_AT = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
#: Whole tokens of a class, id or role that mark furniture.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead topbar footer bottombar sidebar aside rail widget widgets related recommended recommendations trending popular social share sharing comment comments respond discussion disqus replies reply"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog newsletter subscribe subscription signup login search searchbox form pagination pager paging toolbar"
    " tags taglist legal copyright disclaimer colophon contentinfo complementary hidden skip skiplink".split()
)
#: Those that say nothing inside an article: its own heading may be in a header.
IN_ARTICLE = frozenset("header masthead".split())
#: What a token may have beside marks and still be one: site-header, sidebar-left, comments-area.
BESIDE_MARKS = frozenset("site page global top bottom left right primary secondary main inner area list box bar block links wrapper container".split())
#: Those that title sections of a text as well: as an id they say nothing inside an article, or on a heading.
TITLES = frozenset("advertising alert copyright disclaimer discussion form header legal menu navigation notice notices notification notifications overlay popular promotion recommendations related replies search sharing social subscription tags trending".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[^\W\d_]+|\d+")
_SPACE = re.compile(r"\s+")
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"'])/\s*\Z")
_HREF = re.compile(r"(?<![^\s\"'/])href\s*=", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    heading: bool
    furniture: bool
    marked: bool
    #: The text in order with what marked or hidden inline elements hold, each piece of those a block of its own; none: the text alone.
    pieces: list[tuple[str, Block | None]] = field(default_factory=list)


def _is_mark(token: str, mute: frozenset[str]) -> bool:
    """Whether all words of a token are marks or may stand beside them, and one is a mark that is not mute."""
    parts = {*_PART.findall(token)}
    return parts <= MARKED | BESIDE_MARKS and bool(parts & MARKED - mute)


def _signs(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its tag or hidden, and whether its class, id or role marks it."""
    furniture = tag in FURNITURE and not (tag == "header" and in_article)
    if "=" not in attributes and "hidden" not in attributes.lower():
        return furniture, False
    mute = IN_ARTICLE if in_article else frozenset()
    marked = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            furniture = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            furniture = True
        elif name in ("class", "role"):
            marked = marked or any(_is_mark(x, mute) for x in value.split())
        elif name == "id":
            marked = marked or _is_mark(value.strip(), mute | TITLES if in_article or tag in HEADINGS else mute)
    return furniture, marked and tag not in ("body", "html")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    # tag, furniture, marked, article, link, skipped: of it and all around it; the marked inline element it is in; the first three flags of its block
    stack: list[tuple[str, bool, bool, bool, bool, bool, object, tuple[bool, bool, bool]]] = []
    held: list[tuple[str, object, int, int, tuple[bool, bool]]] = []  # text, the marked inline element around it, words, linked, flags

    def top() -> tuple[str, bool, bool, bool, bool, bool, object, tuple[bool, bool, bool]]:
        return stack[-1] if stack else ("", False, False, False, False, False, None, (False, False, False))

    def flush() -> None:
        nonlocal held
        around = top()[7]
        heading = any(s[0] in HEADINGS for s in stack[-4:])

        def block(part: list, flags: tuple[bool, bool]) -> Block:
            words, linked = sum(h[2] for h in part), sum(h[3] for h in part)
            return Block(_SPACE.sub(" ", "".join(h[0] for h in part)).strip(), max(words, 1), linked, around[2], heading, *flags)

        runs = [(mark, [*part]) for mark, part in groupby(held, key=lambda h: h[1])]
        held = []
        own = block([h for mark, part in runs if mark is None for h in part], around[:2])
        apart = [(part, None if mark is None else block(part, part[0][4])) for mark, part in runs]
        if not own.text:
            out.extend(b for _, b in apart if b is not None and b.text)
            return
        if len(runs) > 1:
            own.pieces = [("".join(h[0] for h in part), b) for part, b in apart]
        out.append(own)

    raw = ""
    at, n = 0, len(page)
    while at < n:
        if raw:  # text up to the end tag, as it stands
            end = re.compile(rf"</{raw}[\s/>]", re.I).search(page, at)
            raw = ""
            if end is None:
                break
            at = end.start()
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            piece = m[0]
            if piece[:2] in ("<!", "<?"):
                continue
            if top()[0] == "head" and piece.strip():
                stack.pop()
            if top()[5]:
                continue
            if "&" in piece:
                piece = html.unescape(piece)
            k = len(piece.split())
            held.append((piece, top()[6], k, k * top()[4], top()[1:3]))
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                held.append((" ", top()[6], 0, 0, top()[1:3]))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and any(s[0] in BLOCK for s in stack[i + 1 :]):
                        # an inline element does not close the blocks inside it
                        stack = stack[:i] + stack[i + 1 :]
                    else:
                        stack = stack[:i]
                    break
            continue
        if top()[0] == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in BLOCK:
            flush()
            while stack and stack[-1][0] in ENDS_AT and tag in ENDS_AT[stack[-1][0]]:
                stack.pop()
        elif tag == "br":
            held.append((" ", top()[6], 0, 0, top()[1:3]))
        if tag in VOID:
            continue
        _, furniture, marked, article, link, skipped, mark, around = top()
        if tag in ("script", "style", "noscript", "template", "textarea", "title", "iframe"):
            raw = tag
        if tag not in BLOCK and _SELF_CLOSED.search(m[3]):  # not the slash that ends an address
            raw = ""
            continue
        if tag == "a":  # a link ends where another begins
            stack = [s for s in stack if s[0] != "a"]
            link = top()[4]
        whole = tag in ("article", "main")
        own = _signs(tag, m[3], article and not whole)
        # a mark ends at an article or main element, unless that has one as well: a comment among comments
        marked = marked and own[1] if whole else marked or own[1]
        furniture, article = furniture or own[0], article or whole
        if tag in BLOCK:
            mark, around = None, (furniture, marked, article)
        elif own[0] or own[1] and mark is None:
            mark = object()
        stack.append((tag, furniture, marked, article, link or tag == "a" and bool(_HREF.search(m[3])), skipped or tag in SKIP, mark, around))
    flush()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "article", "heading", "furniture", "mark", "page with an article")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Per block: words, link density, those of its neighbours, article, heading, furniture, mark, whether the page has an article."""
    density = [b.linked / b.words for b in found]
    page = float(any(b.in_article and not b.furniture and not b.marked for b in found))
    out = []
    for i, b in enumerate(found):
        before, after = (i - 1, i + 1) if len(found) > 1 else (-1, len(found))
        out.append(
            (
                float(b.words),
                density[i],
                float(found[before].words) if before >= 0 else 0.0,
                density[before] if before >= 0 else 0.0,
                float(found[after].words) if after < len(found) else 0.0,
                density[after] if after < len(found) else 0.0,
                float(b.in_article),
                float(b.heading),
                float(b.furniture),
                float(b.marked),
                page,
            )
        )
    return out


#: The labelled table: pages as sequences of blocks, each with its words, how many of these are linked, where
#: it stands (a: in an article, h: heading, f: furniture, m: marked) and whether it is main text. Fixed values.
LABELLED: list[list[tuple[int, int, str, int]]] = [
    # whatever stands in an article, long or short, linked or not; the rest of its page goes
    [(1, 1, "f", 0), (1, 1, "f", 0), (2, 2, "f", 0), (9, 0, "m", 0), (8, 0, "ah", 1), (120, 0, "a", 1), (90, 0, "a", 1), (2, 0, "a", 1), (60, 0, "a", 1), (14, 0, "f", 0)],
    [(3, 0, "h", 0), (1, 1, "f", 0), (7, 0, "ah", 1), (2, 2, "a", 1), (110, 4, "a", 1), (40, 0, "af", 0), (45, 14, "a", 1), (6, 6, "a", 1), (80, 0, "a", 1), (12, 0, "", 0), (4, 4, "", 0), (4, 4, "", 0)],
    [(9, 0, "f", 0), (1, 0, "a", 1), (3, 0, "a", 1), (15, 0, "a", 1), (9, 4, "a", 1), (60, 0, "f", 0), (40, 0, "f", 0)],
    [(35, 0, "", 0), (5, 0, "ah", 1), (300, 6, "a", 1), (5, 0, "ahf", 0), (20, 2, "af", 0), (20, 2, "af", 0), (12, 0, "a", 1), (5, 0, "a", 1), (3, 0, "h", 0), (25, 2, "", 0), (5, 5, "", 0)],
    [(2, 2, "f", 0), (6, 0, "ah", 1), (4, 0, "ah", 1), (30, 30, "a", 1), (22, 0, "a", 1), (70, 0, "", 0), (15, 0, "m", 0)],
    [(2, 2, "a", 1), (1, 0, "a", 1), (2, 2, "a", 1), (2, 0, "a", 1), (3, 3, "a", 1), (1, 1, "a", 1), (12, 11, "a", 1), (3, 0, "a", 1), (4, 4, "a", 1), (4, 4, "a", 1), (2, 0, "ah", 1), (8, 8, "a", 1), (3, 0, "a", 1)],
    [(1, 1, "", 0), (1, 0, "a", 1), (1, 1, "", 0), (30, 0, "", 0), (2, 0, "a", 1), (80, 0, "", 0), (9, 9, "a", 1), (1, 0, "a", 1), (9, 9, "a", 1), (60, 0, "", 0), (3, 0, "a", 1), (4, 4, "f", 0), (3, 0, "a", 1), (6, 6, "m", 0), (2, 0, "a", 1), (5, 5, "m", 0)],
    [(90, 0, "", 0), (40, 0, "", 0), (18, 0, "", 0), (6, 0, "h", 0), (120, 0, "", 0), (25, 0, "", 0), (5, 0, "ah", 1), (2, 0, "a", 1), (40, 36, "a", 1), (70, 65, "a", 1), (6, 5, "a", 1), (55, 0, "", 0), (30, 3, "", 0), (12, 0, "", 0), (6, 0, "", 0), (3, 0, "", 0), (45, 0, "", 0), (200, 0, "", 0), (5, 5, "", 0), (60, 0, "", 0), (9, 9, "", 0), (35, 0, "", 0), (4, 4, "", 0), (90, 0, "", 0), (1, 1, "", 0), (70, 0, "", 0), (2, 2, "", 0), (50, 0, "", 0), (7, 7, "", 0), (40, 0, "", 0), (6, 6, "", 0), (80, 0, "", 0), (20, 20, "", 0), (65, 0, "", 0)],
    [(30, 30, "f", 0), (2, 0, "a", 1), (30, 30, "f", 0), (90, 0, "f", 0), (70, 0, "f", 0), (150, 3, "f", 0), (1, 0, "ah", 1), (25, 25, "a", 1), (60, 0, "f", 0), (200, 0, "f", 0)],
    # marked in an article: long text without links stays, short or linked text goes
    [(6, 0, "ah", 1), (90, 0, "a", 1), (150, 0, "am", 1), (80, 0, "a", 1), (11, 0, "am", 0), (60, 0, "a", 1), (30, 0, "am", 0), (3, 3, "am", 0), (70, 4, "am", 1), (60, 0, "a", 1)],
    [(6, 0, "ah", 1), (60, 0, "a", 1), (1, 0, "ahm", 0), (11, 0, "am", 0), (2, 2, "am", 0), (60, 0, "a", 1), (80, 64, "am", 0), (40, 0, "a", 1), (120, 0, "am", 1), (3, 3, "am", 0)],
    # marked, beside the article
    [(7, 0, "hm", 0), (150, 0, "m", 0), (110, 0, "a", 1), (60, 6, "a", 1), (70, 4, "m", 0), (120, 0, "m", 0), (3, 3, "m", 0), (12, 0, "m", 0), (90, 0, "m", 0), (5, 0, "hm", 0)],
    # pages without an article: running text with its headings and short lines, after and before lists of links
    [(2, 0, "", 0), (1, 1, "", 0), (1, 1, "", 0), (2, 2, "", 0), (1, 1, "", 0), (7, 0, "h", 1), (90, 0, "", 1), (4, 0, "h", 1), (60, 3, "", 1), (5, 0, "", 1), (45, 0, "", 1), (2, 0, "h", 0), (8, 8, "", 0), (7, 7, "", 0), (9, 9, "", 0), (3, 0, "", 0)],
    [(1, 1, "", 0), (2, 2, "", 0), (1, 0, "", 0), (2, 2, "", 0), (2, 2, "", 0), (110, 0, "", 1), (30, 6, "", 1), (25, 0, "", 1), (1, 0, "", 1), (40, 0, "", 1), (18, 0, "", 1), (3, 3, "", 0), (4, 0, "", 0), (3, 3, "", 0)],
    [(3, 0, "", 0), (2, 2, "", 0), (3, 3, "", 0), (6, 0, "h", 1), (14, 0, "", 1), (9, 0, "", 1), (3, 0, "", 1), (20, 8, "", 1), (3, 0, "", 1), (70, 0, "", 1), (3, 0, "h", 0), (6, 6, "", 0), (6, 6, "", 0)],
    [(2, 2, "", 0), (2, 2, "", 0), (14, 0, "", 1), (2, 2, "", 0), (2, 2, "", 0), (2, 0, "", 0)],
    [(4, 4, "", 0), (12, 11, "", 0), (3, 3, "", 0), (12, 11, "", 0), (40, 32, "", 0), (12, 11, "", 0), (4, 0, "", 0), (4, 4, "", 0)],
    # a block of links between long paragraphs belongs to them; beside short ones, or before more links, it doesn't
    [(80, 0, "", 1), (8, 8, "", 1), (60, 0, "", 1), (6, 4, "", 0), (4, 4, "", 0), (3, 0, "", 0), (4, 4, "", 0)],
    [(3, 3, "", 0), (45, 0, "", 1), (5, 5, "", 1), (70, 2, "", 1), (10, 9, "", 1), (38, 0, "", 1), (6, 6, "", 0), (5, 5, "", 0), (6, 6, "", 0), (30, 0, "", 1), (7, 7, "", 0), (8, 0, "", 1), (6, 6, "", 0), (6, 0, "", 1), (50, 0, "", 1), (12, 12, "", 0)],
    [(5, 0, "h", 1), (9, 9, "", 0), (6, 0, "", 1), (7, 7, "", 0), (90, 0, "", 1), (9, 9, "", 1), (55, 0, "", 1), (4, 4, "", 0), (4, 0, "", 0), (4, 4, "", 0)],
    [(6, 0, "h", 1), (66, 0, "", 1), (110, 0, "", 1), (5, 5, "", 0), (5, 5, "", 0), (6, 6, "", 0)],
    [(2, 2, "", 0), (1, 0, "h", 1), (14, 0, "", 1), (1, 0, "", 1)],
    [(1, 1, "", 0), (1, 1, "", 0), (2, 0, "h", 1), (40, 0, "", 1), (3, 0, "h", 1), (25, 0, "", 1), (2, 2, "", 0), (4, 0, "h", 1), (60, 0, "", 1), (3, 0, "h", 0), (4, 4, "", 0), (4, 4, "", 0)],
    [(3, 3, "", 0), (75, 0, "", 1), (7, 7, "", 0), (8, 8, "", 0), (3, 3, "", 0)],
    [(30, 0, "", 1), (120, 0, "", 1), (9, 9, "", 0)],
    [(2, 2, "", 0), (28, 0, "", 1), (6, 6, "", 1), (33, 0, "", 1), (4, 4, "", 1), (40, 0, "", 1), (85, 0, "", 1), (4, 4, "", 0), (3, 0, "", 0), (4, 4, "", 0)],
    [(3, 0, "", 1), (2, 0, "", 1), (4, 0, "", 1)],
    [(3, 0, "h", 1), (5, 0, "", 1), (9, 0, "", 1), (2, 0, "", 1)],
    [(2, 0, "", 1)],
    [(12, 0, "", 1)],
    [(5, 0, "h", 1), (30, 0, "", 1)],
    # furniture and marks on such pages
    [(1, 0, "f", 0), (1, 0, "f", 0), (2, 0, "hf", 0), (50, 0, "f", 0), (8, 0, "h", 1), (60, 0, "", 1), (90, 0, "", 1), (20, 0, "f", 0), (3, 0, "f", 0), (4, 4, "f", 0), (30, 0, "f", 0)],
    [(4, 4, "m", 0), (3, 0, "m", 0), (4, 4, "m", 0), (7, 0, "h", 1), (110, 0, "", 1), (150, 0, "m", 1), (70, 4, "m", 1), (30, 0, "m", 0), (60, 0, "", 1), (9, 0, "m", 0), (40, 0, "", 1), (12, 11, "m", 0), (100, 80, "m", 0), (40, 0, "", 1), (5, 0, "hm", 0), (25, 0, "m", 0), (2, 0, "m", 0)],
    [(3, 0, "m", 0), (2, 0, "m", 0), (60, 0, "", 1), (1, 0, "m", 0), (2, 0, "m", 0), (4, 0, "m", 0), (35, 0, "", 1), (80, 0, "m", 1), (2, 0, "m", 0), (3, 0, "m", 0), (2, 2, "m", 0), (3, 0, "m", 0)],
    [(60, 0, "", 1), (5, 5, "f", 0), (70, 0, "", 1), (4, 4, "m", 0), (50, 0, "", 1), (9, 9, "f", 0), (45, 0, "", 1), (2, 2, "m", 0), (90, 0, "", 1), (3, 3, "f", 0), (35, 0, "", 1)],
]


def labelled_rows(pages: list[list[tuple[int, int, str, int]]] = LABELLED) -> list[tuple[float, ...]]:
    """The table's blocks with the features that they have beside each other, and their label."""
    out = []
    for page in pages:
        found = [Block("x", words, linked, *(c in where for c in "ahfm")) for words, linked, where, _ in page]
        out += [(*row, label) for row, (*_, label) in zip(features(found), page, strict=True)]
    return out


def used(tree: tuple) -> set[str]:
    """Names of the features that a tree splits on."""
    return {FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if len(tree) > 1 else set()


def train(rows: list[tuple], depth: int = 10) -> tuple:
    """CART: (feature, threshold, below or equal, above), or the label at a leaf. Ties go to the first feature and the smallest threshold."""

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    def grow(part: list[tuple], left: int) -> tuple:
        ones = sum(r[-1] for r in part)
        if left == 0 or ones in (0, len(part)):
            return (int(ones * 2 >= len(part)),)
        best = None
        for f in range(len(part[0]) - 1):
            values = sorted({r[f] for r in part})
            for x, y in zip(values, values[1:], strict=False):
                cut_at = (x + y) / 2
                low, high = [r for r in part if r[f] <= cut_at], [r for r in part if r[f] > cut_at]
                score = gini(low) + gini(high)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, cut_at, low, high)
        if best is None:
            return (int(ones * 2 >= len(part)),)
        return (best[1], best[2], grow(best[3], left - 1), grow(best[4], left - 1))

    return grow(rows, depth)


def classify(tree: tuple, row: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree[0])


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    out = []
    for b, row in zip(found, features(found), strict=True):
        keep = classify(tree, row)
        text = b.text if keep else ""
        if b.pieces:
            beside = (float(b.words), b.linked / b.words) * 2

            def kept(x: Block) -> bool:
                return classify(tree, (float(x.words), x.linked / x.words, *beside, *map(float, (x.in_article, x.heading, x.furniture, x.marked)), row[-1]))

            text = _SPACE.sub(" ", "".join(piece for piece, x in b.pieces if (keep if x is None else kept(x)))).strip()
        if text:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the column `into`, the main text, in place of an earlier one of that name."""
    tree = train(labelled_rows())
    kept = [f for f in pages.schema.fields if f.name != into]
    at, kept_at = pages.columns.index(html), [pages.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x, tree) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept_at] + [text], names=[f.name for f in kept] + [into])

    with arrow_rows(pages.sparkSession, 1000):
        return pages.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
