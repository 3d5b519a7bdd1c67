"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Menus, headers, footers, sidebars and other
page furniture leave ``WINDOW`` empty lines in their place, adverts, notices, comments and the like
inside a text leave one. A line weighs its characters outside links, and weights are summed over
sliding windows of ``WINDOW`` lines. A stretch surges where a window's sum rises from nothing and dives where it
falls to nothing again; it is kept if a window in it reaches ``SURGE``, with every line from its first to its
last that weighs something, so that a paragraph that is one link stays where text surrounds it. An ``article`` or
``main`` element adds ``SURGE`` to its own stretches and counts its links as text, so that these count
however short their lines are; text outside is judged by the windows alone. If no stretch is kept, the heaviest one is.

A class or id names boilerplate if one of its parts does so beyond doubt (``main-sidebar``), or if a part that is also a plain word stands alone or
beside words of layout only (``share``, ``share-buttons``, but not ``market-share`` or ``related-work``).

An ``article`` within boilerplate (a teaser in a sidebar, a reader's comment) belongs to the boilerplate. Inside a
block white space becomes one space, ``br`` included; two ``br`` in a row end the block. Character
references are decoded. Blocks are joined by an empty line. Nothing else is dropped or capped.

Edge cases: null, empty or text-free html gives an empty string; unclosed and mis-nested tags are
followed by their names; a paragraph, list item or table cell ends where the next one starts, and any
element where an enclosing one ends; a boilerplate element whose end tag is lost ends at the next element
of its own or its parent's kind, else at the next block; a cut-off tag at the end is markup; repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 80

# Element and attribute names: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title xmp iframe noframes svg math head".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog object audio video canvas label input fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
# Names of furniture wherever they stand in a class or id, and names that are also plain words: these count alone, or with parts that say where or how a block stands.
SURE_NAMES = frozenset(
    "ads adsense advert adverts advertisement advertising adbox breadcrumb breadcrumbs commentlist disqus footer gdpr masthead nav navbar navigation pager pagination "
    "sidebar sidenav sponsored toolbar topbar widget widgets".split()
)
LIKELY_NAMES = frozenset(
    "ad banner comment comments consent cookie cookies header menu modal newsletter notice notices popup promo promoted related respond share sharing signup skip social sponsor subscribe tags".split()
)
BESIDE_NAMES = frozenset(
    "above accept actions after alert all area article articles aside asides bar bars before below block blocks body bottom box btn button buttons card cards carousel center cloud col column "
    "container content count desktop dismiss div entry external fixed floating follow form frame global google grid group home icon icons image inline inner item items js large layout leaderboard left "
    "link links list lower main media meta middle mobile module nested node open outer overlay page pages panel post posts primary print reader readers reply rail right row rss secondary section "
    "site slot small sticky stories stream strip sub text thread title toggle top topic unit upper user users view wide wrap wrapper".split()
)
FURNITURE_NAMES = frozenset("breadcrumb breadcrumbs footer header masthead menu nav navbar navigation sidebar sidenav toolbar topbar widget widgets".split())
ARTICLE_NAMES = frozenset("ad advert comment comments promo promoted related reply response sponsored teaser".split())
LAYOUT = frozenset("has is no with without".split())
CONTENT = frozenset(("article", "main"))
# Start tags that end an open element of the second set, unless one of the third stands between.
TABLE = frozenset(("table", "caption", "html"))
SCOPE = TABLE | frozenset(("td", "th", "button", "object"))
PARAGRAPH_ENDS = BLOCK - frozenset("body caption html legend tbody td tfoot th thead tr".split())
LISTS = (BLOCK - frozenset("address div p li dd dt".split())) | SCOPE
CELLS, ROWS, GROUPS = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("tbody", "thead", "tfoot"))
IMPLIED = {
    "li": (frozenset(("li",)), LISTS), "dd": (frozenset(("dd", "dt")), LISTS), "dt": (frozenset(("dd", "dt")), LISTS),
    **dict.fromkeys(CELLS, (CELLS, TABLE | ROWS)), "tr": (CELLS | ROWS, TABLE | GROUPS), **dict.fromkeys(GROUPS, (CELLS | ROWS | GROUPS, TABLE)),
}
OPTIONAL_END = frozenset(("p", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(raw):
        out.setdefault(key.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _names(attrs: dict[str, str]) -> Iterator[list[str]]:
    """The parts of each class and of the id, without those that describe a layout (``has-sidebar``)."""
    for token in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        parts = re.split("[-_]", token)
        if parts[0] not in LAYOUT:
            yield parts


def _named_boilerplate(parts: list[str]) -> bool:
    if not SURE_NAMES.isdisjoint(parts):
        return True
    return not LIKELY_NAMES.isdisjoint(parts) and all(p in LIKELY_NAMES or p in BESIDE_NAMES or not p.isalpha() for p in parts)


def _is_boilerplate(name: str, raw: str) -> bool:
    if name in BOILERPLATE:
        return True
    if name in ("html", "body", "main") or not raw:
        return False
    attrs = _attributes(raw)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if name == "article":
        return any(parts[0] in ARTICLE_NAMES and all(p in ARTICLE_NAMES or p in BESIDE_NAMES or not p.isalpha() for p in parts) for parts in _names(attrs))
    return attrs.get("role", "").lower() in BOILERPLATE_ROLES or any(map(_named_boilerplate, _names(attrs)))


def _is_furniture(name: str, raw: str) -> bool:
    """Whether a boilerplate element stands between texts rather than inside one."""
    return name in FURNITURE or any(not FURNITURE_NAMES.isdisjoint(parts) for parts in _names(_attributes(raw)))


class _Lines:
    """Collects one line for each block: text, length of its link text, whether it stands in an article."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.link = 0
        self.inside = 0

    def text(self, raw: str, in_link: bool) -> None:
        self.parts.append(raw)
        if in_link:
            self.link += len(SPACE.sub(" ", html.unescape(raw)).strip())

    def close(self) -> None:
        line = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if line:
            self.rows.append((line, self.link, self.inside > 0))
        self.parts, self.link = [], 0

    def gap(self, lines: int) -> None:
        self.close()
        self.rows.extend([("", 0, self.inside > 0)] * lines)


def _markup(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, without those in raw text; comments have an empty name, raw elements are one tag."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        at = m.end()
        name, closing, attrs = (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in RAW and not closing and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif name not in ("head", "title"):
                at = len(page)
        out.append((m.start(), at, name, closing, attrs))
    return out


def _boilerplate_ends(tags: list[tuple[int, int, str, bool, str]], size: int) -> dict[int, int]:
    """Where each boilerplate element ends, by the number of its start tag."""
    ends: dict[int, int] = {}
    lost: dict[int, tuple[str, str]] = {}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()  # names on the stack, so that it is only searched for what is there

    def pop(depth: int, at: int, closed: bool) -> None:
        while len(stack) > depth:
            name, k = stack.pop()
            held[name] -= 1
            if k < 0:
                continue
            ends[k] = at
            if not (closed and len(stack) == depth) and (name not in OPTIONAL_END or at == size):
                lost[k] = (name, stack[-1][0] if stack else "")

    def end_open(names: frozenset, barrier: frozenset, at: int) -> None:
        if not any(held[n] for n in names):
            return
        for j in range(len(stack) - 1, -1, -1):
            if stack[j][0] in names:
                pop(j, at, True)
            elif stack[j][0] in barrier:
                break

    paragraph = frozenset(("p",))
    for k, (at, _, name, closing, attrs) in enumerate(tags):
        if not name or name in VOID or name in RAW:
            continue
        if closing:
            barrier = frozenset() if name in TABLE or name in CONTENT or name == "body" else TABLE if name in CELLS | ROWS | GROUPS else SCOPE if name in BLOCK else BLOCK
            for j in range(len(stack) - 1, -1, -1) if held[name] else ():
                if stack[j][0] == name:
                    pop(j, at, True)
                    break
                if stack[j][0] in barrier:
                    break
        else:
            if name in PARAGRAPH_ENDS:
                end_open(paragraph, SCOPE, at)
            if name in IMPLIED:
                end_open(*IMPLIED[name], at)
            held[name] += 1
            stack.append((name, k if _is_boilerplate(name, attrs) else -1))
    pop(0, size, False)
    for k, (own, parent) in lost.items():
        block = None
        for i in range(k + 1, len(tags)):
            at, _, name, closing, _ = tags[i]
            if at >= ends[k]:
                ends[k] = ends[k] if block is None else block
                break
            if not closing and (name in CONTENT or name in (own, parent)):
                ends[k] = at
                break
            if not closing and name in BLOCK and block is None:
                block = at
        else:
            ends[k] = block if block is not None else tags[k][1]
    return ends


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    out, at, links, breaks = _Lines(), 0, 0, 0
    skip = 0  # where the boilerplate element being passed over ends
    tags = _markup(page)
    ends = _boilerplate_ends(tags, len(page))
    for k, (start, stop, name, closing, attrs) in enumerate(tags):
        between = page[at:start]
        if between and at >= skip:
            out.text(between, links > 0)
            if not between.isspace():
                breaks = 0
        at = stop
        if not name:
            continue
        if name in RAW:
            if start >= skip and name in BLOCK:
                out.close()
            continue
        if start < skip:
            continue
        if name == "br":
            breaks += 1
            if breaks == 2:
                out.close()
            else:
                out.text(" ", False)
            continue
        breaks = 0
        if k in ends:
            if name in BLOCK:
                out.gap(WINDOW if _is_furniture(name, attrs) else 1)
            skip = ends[k]
            continue
        if name in CONTENT:
            out.close()
            out.inside = max(0, out.inside + (-1 if closing else 1))
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCK:
            out.close()
    if at >= skip and at < len(page):
        out.text(page[at:].rpartition("<")[0] if re.search(r"<[/!a-zA-Z]?[^<>]*\Z", page[at:]) else page[at:], False)
    out.close()
    return out.rows


def line_weights(rows: list[tuple[str, int, bool]]) -> list[int]:
    """Characters of each line without those of links; a page of nothing but links is weighed with them."""
    weights = [len(line) if inside else max(0, len(line) - link) for line, link, inside in rows]
    return weights if any(weights) else [len(line) for line, _, _ in rows]


def main_blocks(page: str) -> list[str]:
    rows = page_lines(page)
    weights = line_weights(rows)
    stretches: list[tuple[int, int, int]] = []  # first line, end, heaviest window
    at = 0
    while at < len(rows):
        inside, end = rows[at][2], at
        while end < len(rows) and rows[end][2] == inside:
            end += 1
        weight = weights[at:end] + [0] * WINDOW
        first, last, total, top = -1, -1, 0, 0  # first and last line with weight since the surge
        for i, w in enumerate(weight):
            total += w - (weight[i - WINDOW] if i >= WINDOW else 0)
            if w:
                first, last = i if first < 0 else first, i
            top = max(top, total)
            if total == 0 and first >= 0:
                stretches.append((at + first, at + last + 1, top + (SURGE if inside else 0)))
                first, top = -1, 0
        at = end
    keep = [s for s in stretches if s[2] >= SURGE] or sorted(stretches, key=lambda s: (-s[2], s[0]))[:1]
    return [rows[i][0] for a, b, _ in keep for i in range(a, b) if rows[i][0]]


def extract_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract_text(p) for p in batch.column(2).to_pylist()]
        cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
