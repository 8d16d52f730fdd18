"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element's run of text. Each line
weighs its length without the text of links; sums over a sliding window of lines rise
sharply where the article begins (surge) and fall to nothing behind it (dive), and the
text between them stays if its largest window is a quarter of the page's at least. A
line whose container is unlike that of the line before, neither inside the other, is
set apart by empty lines, as it is on a page, so that a window does not reach over.

Names only weigh: a line in a marked article fourteen times its length, a line in an element
whose class, id or role speaks against it a sixteenth. What elements are for is used to
leave out content that is no running text (scripts, styles, forms, menus, page footers,
sidebars, hidden elements) and comments; where nothing else is left, comments stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import map_slices

WINDOW = 3
#: The share of the page's largest window that a surge reaches, and a sum that is one
#: in any case where an article inside an element that is left out is read instead.
SHARE, SURGE = 0.25, 86
#: What a character in a marked article weighs, and one in an element with a doubtful name.
MARKED, DOUBTED = 14, 0.0625

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\baria-hidden\s*=\s*["']?true|\bdisplay\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

#: Elements whose content is not markup, or not for reading.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset label head".split())
#: Words in a class, id or role that speak against article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended widget comment comments disqus reply replies respond pagination pager toolbar contentinfo complementary search".split()
)
#: Of these, what inside an article heads the article itself.
HEADINGS = frozenset("header masthead banner".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Where a block starts, an open paragraph ends; a list item or cell ends its like.
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Plain text, a marked article, an article inside what is left out (read only where the
#: page has no other), what a name speaks against, what is left out, and comments.
PLAIN, MAIN, INNER, DOUBTFUL, OUT, COMMENT = range(6)


def _kind(tag: str, attributes: str, outer: int) -> int:
    """Whether an element's content is plain, marked as the article, doubtful or left out."""
    if tag == "body" or tag == "html":
        return outer
    words: set[str] = set()
    names: list[set[str]] = []
    if attributes:
        for m in _NAMES.finditer(attributes):
            names += [set(_WORDS.findall(name)) for name in m[1].lower().split()]
        words.update(*names)
        if _HIDDEN.search(attributes):
            return OUT
    if outer == COMMENT or words & COMMENTS and tag not in INLINE:
        return COMMENT if tag != "main" and not (tag == "article" and outer != COMMENT and "comment" not in words) else MAIN
    marks = MARKS - HEADINGS if outer in (MAIN, INNER) else MARKS
    if tag in ("article", "main"):
        if any(name and name <= MARKS for name in names):  # a name of nothing but marks: an advert, related pages
            return OUT if outer == OUT else INNER
        return INNER if outer in (OUT, INNER) and tag == "article" else MAIN
    # main-content, but not main-menu
    if outer == PLAIN and tag in ("div", "section") and any(name & {"articlebody", "main"} and not name & MARKS for name in names):
        return MAIN
    if outer == OUT or tag in BOILERPLATE or (tag == "header" and outer not in (MAIN, INNER)):
        return OUT
    return DOUBTFUL if words & marks and tag not in INLINE else outer


class Line(NamedTuple):
    text: str
    links: int  # characters in links
    kind: int
    container: int


def lines(page: str) -> tuple[list[Line], list[int]]:
    """The page's blocks of text in order, and for each container the last one inside it:
    containers are numbered as they open, 0 is the page."""
    found: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    links = 0
    stack: list[tuple[str, int, int]] = []  # tag, kind, number of the element
    open_tags: Counter[str] = Counter()
    parent, last, has_blocks = [0], [0], [True]
    kind = inside = 0
    in_link = 0
    at = 0

    def end_line() -> None:
        nonlocal links
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                found.append((line, links, kind, inside))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece and kind != OUT:
            text.append(piece)
            if in_link:
                links += len(piece)

    def push(tag: str, new: int, number: int) -> None:
        nonlocal kind, inside
        stack.append((tag, new, number))
        open_tags[tag] += 1
        kind, inside = new, number

    def close(to: int) -> None:
        nonlocal kind, inside
        for tag, _, number in stack[to:]:
            open_tags[tag] -= 1
            last[number] = max(last[number], len(parent) - 1)
        del stack[to:]
        _, kind, inside = stack[-1] if stack else ("", PLAIN, 0)

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in INLINE:
                in_link -= tag == "a" and in_link > 0
                if tag != "br" and open_tags[tag] and any(t == tag for t, _, _ in stack[-8:]):
                    close(max(i for i in range(max(0, len(stack) - 8), len(stack)) if stack[i][0] == tag))
                continue
            end_line()
            if open_tags[tag]:  # else it closes nothing, however deep the stack
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
                in_link = 0
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = None if attributes.endswith("/") and tag in ("svg", "math", "object") else _RAW_END[tag].search(page, at)
            if end:
                close_at = page.find(">", end.start())
                at = len(page) if close_at < 0 else close_at + 1
            elif not attributes.endswith("/"):
                at = len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                in_link = 1
            if attributes and tag not in VOID and (new := _kind(tag, attributes, kind)) != kind:
                push(tag, new, inside)
            continue
        end_line()
        in_link = 0
        if tag in VOID:
            continue
        for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[i][0] in ENDS_LIKE.get(tag, ()) or stack[i][0] == "p":
                close(i)
                break
            if stack[i][0] not in INLINE:
                break
        if not attributes.endswith("/"):
            number = 0
            if tag not in ("html", "body"):
                has_blocks[inside] = True
                parent.append(inside)
                has_blocks.append(False)
                number = len(parent) - 1
                last.append(number)
            push(tag, _kind(tag, attributes, kind), number)
    add(page[at:])
    end_line()
    close(0)
    # a block that holds no other is a line of the one around it
    return [Line(t, n, k, c if has_blocks[c] else parent[c]) for t, n, k, c in found], last


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text between surge and dive points, blocks joined by one space."""
    every, last = lines(page or "")
    found = [x for x in every if x.kind != COMMENT]
    text = _surging([x for x in found if x.kind != INNER], last, window)
    inner = [x for x in found if x.kind == INNER]
    if inner and len(text) < SURGE:
        other = _surging(inner, last, window)
        if not text or len(other) >= SURGE:
            return other
    return text or _surging(every, last, window)


def _weight(line: Line) -> float:
    if line.kind in (MAIN, INNER):
        return len(line.text) * MARKED
    own = max(0, len(line.text) - 2 * line.links)
    return own * DOUBTED if line.kind == DOUBTFUL else own


def _surging(found: list[Line], last: list[int], window: int) -> str:
    """The lines between surge and dive, of those that nothing speaks against and of the
    others by themselves, so that a doubtful block does not part the text around it."""
    parts = []
    for doubtful in (False, True):
        places: list[int] = []
        before: list[float] = [0.0]  # sums of weights; empty lines have no place
        at: list[int] = []
        for i, line in enumerate(found):
            if (line.kind == DOUBTFUL) != doubtful:
                continue
            if places and _apart(found[places[-1]], line, last):
                before += [before[-1]] * window
            at.append(len(before) - 1)
            places.append(i)
            before.append(before[-1] + _weight(line))
        n = len(before) - 1
        # the window that starts at each line, from one that ends at the first line on
        sums = [before[min(n, i + window)] - before[max(0, i)] for i in range(1 - window, n)]
        parts.append((places, at, before, sums))
    least = max((x for _, _, _, sums in parts for x in sums), default=0.0) * SHARE
    kept: list[int] = []
    for places, at, before, sums in parts:
        n = len(before) - 1
        place = dict(zip(at, places, strict=True))
        i = 0
        while i < n:
            if before[i + 1] == before[i]:
                i += 1
                continue
            j = i  # a surge may begin here; it dives where a whole window weighs nothing
            peak = 0.0
            while j < n and (s := sums[j + window - 1]) > 0:
                peak = max(peak, s)
                j += 1
            if peak >= least:
                end = max(k for k in range(i, j) if before[k + 1] > before[k])
                kept += [place[k] for k in range(i, end + 1) if k in place]
            i = j + 1
    return " ".join(found[i].text for i in sorted(kept))


def _apart(a: Line, b: Line, last: list[int]) -> bool:
    """Whether the containers of two lines are unlike and neither is inside the other. The
    page as a whole is no container that a line's own would be a part of."""
    x, y = sorted((a.container, b.container))
    if x == y or a.kind in (MAIN, INNER) and a.kind == b.kind:
        return False
    return x == 0 or not x <= y <= last[x]


def extract(df: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The main text of every whole page.

    Null and empty pages, and pages of markup only, give an empty text; very long pages
    and unclosed markup take time in proportion; what is cut off inside a tag, comment or
    script ends there; of windows that tie all are surges; repeated rows are treated alike;
    an empty table gives no rows; other columns are left out.
    Returns page_id, url, text, n_chars."""
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(page), F.lit("")).alias("html"), F.col(url).alias("url"))

    def per_slice():
        def run(batch: pa.RecordBatch) -> dict:
            texts = [main_text(p) for p in batch.column(1).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(2), "text": texts, "n_chars": list(map(len, texts))}

        return run

    return map_slices(rows, per_slice, "page_id long, url string, text string, n_chars long")
