"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A linear classifier over a block's containers, tag, links and
wording gives its cost as boilerplate and as content; these are the capacities of its edges to the two terminals. Page
order and nearness in the element tree tie blocks together with smoothness edges, and the minimum cut of that graph is
the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|(?=<)|\Z)",
    re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
BREAKS = set("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template textarea title svg math iframe object canvas audio video select button head datalist".split())
RAW = set("script style textarea title iframe noscript".split())  # no tags inside
CLOSES_P = BREAKS - {"body", "html", "head", "title", "caption", "col", "colgroup", "legend", "option", "optgroup", "frame", "frameset"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AROUND = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"datalist"}}

# What containers say, by tag, role and the words of class and id.
ASIDE_TAGS = set("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = {"article", "main"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NEVER = set("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation
menu breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices
newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations pagination
pager search toolbar tags toc skip widget widgets captcha survey""".split())
USUALLY_NOT = set("sidebar header footer banner masthead aside rail bottom top legal copyright disclaimer meta byline".split())
CONTENT_NAMES = set("article post entry content story main text body".split())

# Log-odds of content. A page gives no labels, so these are set by hand.
BIAS, IN_CONTENT, IN_ASIDE, HEADING, PARAGRAPH, LIST_ITEM, LINKS, LENGTH, SENTENCE = -0.4, 4.0, -10.0, 1.0, 1.2, 0.0, -4.0, 0.6, 1.0
NEXT_EDGE, NEAR_EDGE = 0.8, 0.8


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    aside: bool = False
    content: bool = False
    skipped: bool = False
    last_blocks: dict[str, int] = field(default_factory=dict)


@dataclass
class Block:
    """Text between two block-level tags, the element that holds it and the code points of it inside links."""

    holder: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _opened(tag: str, rest: str, parent: Element | None) -> Element:
    up = parent or Element("", None)
    aside = content = hidden = False
    if rest and tag not in ("html", "body"):
        for name, value in NAMES.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                aside |= value in ASIDE_ROLES
                content |= value in CONTENT_TAGS
            elif name in ("class", "id"):
                for one in value.split() if name == "class" else [value]:
                    words = set(WORD.findall(one))
                    own = bool(words & CONTENT_NAMES)
                    aside |= bool(words & NEVER) or bool(words & USUALLY_NOT) and not own
                    content |= own
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or value == "true"
    aside |= tag in ASIDE_TAGS or tag == "header" and not up.content
    content |= tag in CONTENT_TAGS
    return Element(tag, parent, up.aside or aside, up.content or content, up.skipped or hidden or tag in SKIPPED)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, white space normalised, without empty ones and without scripts, styles and other data."""
    root = Element("", None)
    here, found, now, links = root, [], Block(root), 0

    def text(raw: str) -> None:
        nonlocal now
        if not here.skipped and raw:
            if not now.parts:
                now.holder = here
            now.parts.append(raw)
            if links:
                now.linked += len(raw)

    def flush() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join(unescape("".join(now.parts)).split())
            if now.text:
                found.append(now)
            now = Block(root)

    at, size = 0, len(html)
    while at < size:
        hit = MARKUP.search(html, at)
        if hit is None:
            text(html[at:])
            break
        text(html[at : hit.start()])
        at = max(hit.end(), hit.start() + 1)
        if hit["tag"] is None:
            continue
        tag = hit["tag"].lower()
        if tag in BREAKS:
            flush()
        if hit["end"]:
            level = here
            while level is not root and level.tag != tag:
                level = level.parent
            if level is not root:
                while here is not level:
                    links -= here.tag == "a"
                    here = here.parent
                links -= tag == "a"
                here = here.parent
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        closes, stop = SAME.get(tag), AROUND.get(tag, set())
        if tag in CLOSES_P:
            closes = (closes or set()) | {"p"}
        if closes:
            level, last = here, None
            while level is not root and level.tag not in stop and (level.tag in closes or level.tag not in CLOSES_P or level.tag == "p"):
                if level.tag in closes:
                    last = level
                level = level.parent
            if last is not None:
                while here is not last:
                    links -= here.tag == "a"
                    here = here.parent
                here = here.parent
        rest = hit["rest"]
        if rest.rstrip().endswith("/") and tag in ("svg", "math", "iframe", "object"):
            continue
        here = _opened(tag, rest, here)
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            at = close.start() if close else size
    flush()
    return found


def log_odds(block: Block) -> float:
    """The classifier: how much likelier the block is content than boilerplate, as a logarithm."""
    holder, tag = block.holder, ""
    level = holder
    while level is not None and not tag:
        tag = level.tag if level.tag in BREAKS else ""
        level = level.parent
    size = len(block.text)
    score = BIAS + IN_CONTENT * holder.content + IN_ASIDE * holder.aside + LINKS * min(1.0, block.linked / size)
    score += LENGTH * log1p(size / 20) + SENTENCE * (block.text[-1] in ".!?:;…。！？")
    if tag in ("p", "pre", "blockquote"):
        return score + PARAGRAPH
    return score + (HEADING if tag[:1] == "h" and tag[1:].isdigit() else LIST_ITEM if tag in ("li", "td", "th", "dt", "dd") else 0.0)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next, the stronger the nearer they are in the tree, and with the last one like it under its parent."""
    edges, above = [], []
    for i, block in enumerate(blocks):
        level, chain = block.holder, []
        while level is not None and len(chain) < 5:
            chain.append(level)
            level = level.parent
        if i:
            steps = next((n for n, e in enumerate(chain) if e in above), 5) + next((n for n, e in enumerate(above) if e in chain), 5)
            edges.append((i - 1, i, NEXT_EDGE / (1 + steps / 2)))
        if len(chain) > 1:
            last = chain[1].last_blocks
            if block.holder.tag in last:
                edges.append((last[block.holder.tag], i, NEAR_EDGE))
            last[block.holder.tag] = i
        above = chain
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's (content) side of the minimum cut; ties go to the other side.

    The costs of a node's labels are minus the logarithms of its probabilities. Flow through one node alone is taken off
    at once; the rest goes along shortest paths from nodes with spare source capacity to nodes with spare sink capacity.
    """
    def cost(x: float) -> float:
        return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))

    spare = [cost(z) - cost(-z) for z in odds]  # capacity from the source, less that to the sink
    near: list[dict[int, float]] = [{} for _ in odds]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    tiny = 1e-9
    while True:
        came = {i: -1 for i, s in enumerate(spare) if s > tiny}
        queue, end = deque(came), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > tiny and j not in came:
                    came[j] = i
                    if spare[j] < -tiny:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(len(odds))]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(spare[path[-1]], -spare[end], *(near[a][b] for b, a in zip(path, path[1:], strict=False)))
        spare[path[-1]] -= flow
        spare[end] += flow
        for b, a in zip(path, path[1:], strict=False):
            near[a][b] -= flow
            near[b][a] += flow


def labelled(html: str | None) -> list[tuple[str, bool]]:
    """Each block's text with whether it is content."""
    blocks = blocks_of(html or "")
    return [(b.text, c) for b, c in zip(blocks, minimum_cut([log_odds(b) for b in blocks], edges_of(blocks)), strict=True)]


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of `pages`: the columns of `keep`, text, n_blocks, n_content.

    `text` joins the content blocks in page order with one line feed; it is empty where the page is null, empty or holds
    no content. Broken markup, repeated pages and pages of any length are read whole; an empty table gives an empty
    result, and other columns are not read.
    """
    source = pages.select(*keep, F.col(html_col).alias("_html"))
    kinds = dict(source.dtypes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [labelled(h) for h in part.columns[-1].to_pylist()]
                content = [[t for t, c in own if c] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(["\n".join(c) for c in content], pa.string()),
                     pa.array(map(len, found), pa.int32()), pa.array(map(len, content), pa.int32())],
                    [*keep, "text", "n_blocks", "n_content"])

    return source.mapInArrow(extract, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_blocks int, n_content int")
