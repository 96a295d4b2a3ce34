"""Main text of web pages by tag-path ratios.

A text node's path is the chain of open elements from the root, with their classes. Over a page, every path's text length and
punctuation marks are summed and divided by its nodes: running text gives long, punctuated nodes, menus and notices don't. The
two ratios are smoothed along the page, so that a short paragraph between long ones isn't lost, fused by multiplication and
averaged per path again; paths above a share of the spread of all scores are content paths. They decide what stays:

* The content region is the deepest element that holds most of the content paths' text, an article or main element if one holds half.
* In it, blocks of content paths stay, whatever they are. Other blocks stay only beside content: headings, lists, tables and the like
  that aren't mere links, and what shares a child of the region with a content path. Nothing outside the region stays.

Before the ratios, parts that are marked as menus, notices, adverts, forms, comments and the like are left out, as their text may
run like an article's. Paths are numbers, and regions are found in one pass from the root, so time and memory follow the page's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm.html import Block, Element, Reader

#: Elements, roles and words of class or id attributes that mark parts other than the main text.
BAD_TAGS = frozenset("nav aside footer form button dialog menu fieldset input label legend head frameset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
BAD_WORDS = frozenset(
    """ad ads adv adsense adslot adunit advert banner billboard breadcrumb breadcrumbs byline carousel consent cookie cookies copyright disclaimer
    disqus dropdown feedback foot footer footers gdpr header headers hidden legal login masthead menu menus meta modal nav navbar navi navigation
    newsletter notice notices notification notifications outbrain overlay pager paginate pagination paywall popup popups privacy promo promos
    promoted promotion rail recommendations recommended registration related replies reply respond responses search share sharing shares sidebar
    sidebars sidenav signin signup site-header skip social sponsor sponsored subscribe subscription taboola tags teaser toast toolbar topbar
    tracking trending warning widget widgets""".split()
)
BAD_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "promot", "sidebar", "sponsor", "subscri")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure center".split())
_KERNEL = (0.06, 0.24, 0.4, 0.24, 0.06)
THRESHOLD, REGION = 0.35, 0.6
_PLAIN = 0.05  #: so that text without punctuation has a ratio too


def _marked(e: Element, inside: bool) -> int:
    """2 if the element is never main text, 1 if its class or id says so, 0 else; inside: it is within an article or main element."""
    if e.name in BAD_TAGS or e.name == "header" and not inside:
        return 2
    if not e.attrs or e.attrs.isspace():
        return 0
    found = e.attributes()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return 2
    if found.get("role", "").lower() in BAD_ROLES:
        return 2
    named = f"{found.get('class', '')} {found.get('id', '')}"
    if named == " ":
        return 0
    words = {x.lower() for x in _WORDS.findall(named)}
    if any(x.startswith("comment") for x in words):
        return 2
    if e.name in ("html", "body", "main", "article") or e.name in ("h1", "h2"):
        return 0
    return int(not words.isdisjoint(BAD_WORDS) or any(x.startswith(BAD_STARTS) for x in words))


def _smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_KERNEL, -2):
            if 0 <= i + k < n:
                total += w * values[i + k]
                weight += w
        out.append(total / weight)
    return out


def _upward(elements: list[Element], sums: list[int]) -> None:
    """Adds each element's sum to its parent's; children come after their parents."""
    for e in reversed(elements):
        if (up := e.parent.order) >= 0:
            sums[up] += sums[e.order]


def content_paths(blocks: list[Block], threshold: float = THRESHOLD) -> set[int]:
    """Paths of content nodes: those with a fused, smoothed ratio of at least `threshold` of the nodes' standard deviation, and the best one."""
    if not blocks:
        return set()
    sums: dict[int, list[float]] = {}
    for b in blocks:
        own = sums.setdefault(b.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(b.text) - b.links
        own[2] += len(PUNCTUATION.findall(b.text))
    ratio = {p: (length / n, marks / n) for p, (n, length, marks) in sums.items()}
    length = _smooth([ratio[b.path][0] for b in blocks])
    marks = _smooth([ratio[b.path][1] for b in blocks])
    fused = [x * math.log1p(y + _PLAIN) for x, y in zip(length, marks)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)) or mean
    total: dict[int, float] = {}
    for b, x in zip(blocks, fused):
        total[b.path] = total.get(b.path, 0) + x
    # a path of its own small ratios isn't carried by its neighbours alone
    score = {p: min(total[p] / sums[p][0], x * math.log1p(y + _PLAIN) * 4) for p, (x, y) in ratio.items()}
    best = max(score.values())
    return {p for p, x in score.items() if x > 0 and (x >= threshold * spread or x == best)}


def _paths(elements: list[Element]) -> list[int]:
    """A number for each element's path; equal paths share it. 0 is the root's."""
    known: dict[tuple[int, str, str], int] = {}
    out = []
    for e in elements:
        named = " ".join(sorted(e.attributes().get("class", "").split())) if "class" in e.attrs else ""
        key = (out[e.parent.order] if e.parent.order >= 0 else 0, e.name, named)
        out.append(known.setdefault(key, len(known) + 1))
    return out


def _left_out(elements: list[Element], plain: list[int], whole: int) -> list[bool]:
    """Whether an element is in a marked part. One marked by words alone counts unless it holds most of the page or of an article."""
    inside, marked, holds = [False] * len(elements), [0] * len(elements), [0] * len(elements)
    for e in elements:
        up = e.parent.order
        inside[e.order] = e.name in ("article", "main") or up >= 0 and inside[up]
        marked[e.order] = _marked(e, up >= 0 and inside[up])
    for e in reversed(elements):
        if e.name in ("article", "main") and not marked[e.order]:
            holds[e.order] = max(holds[e.order], plain[e.order])
        if (up := e.parent.order) >= 0:
            holds[up] = max(holds[up], holds[e.order])
    bad = [False] * len(elements)
    for e in elements:
        i, up = e.order, e.parent.order
        own = marked[i] == 2 or marked[i] == 1 and plain[i] < 0.6 * whole and holds[i] < 0.3 * whole
        bad[i] = own or up >= 0 and bad[up]
    return bad


def _region(elements: list[Element], paths: list[int], bad: list[bool], weight: list[int], total: int) -> int:
    """The content region's element, -1 for the whole page. weight: text of content paths in each element, total: in the page.

    An element whose siblings of the same path hold such text too is one node of several, so the region is their parent.
    """
    named = region = None
    for e in elements:  # in page order, so the last of equal depth wins
        if bad[e.order] or not weight[e.order]:
            continue
        if weight[e.order] >= 0.5 * total and (e.name in ("article", "main") or "articlebody" in e.attrs.lower()):
            named = e
        if weight[e.order] >= REGION * total and e.name not in _FLOW and e.name != "li" and (region is None or e.depth > region.depth):
            region = e
    if named is not None or region is None:
        return -1 if named is None else named.order
    alike: dict[tuple[int, int], int] = {}
    for e in elements:
        if weight[e.order] and not bad[e.order]:
            key = (e.parent.order, paths[e.order])
            alike[key] = alike.get(key, 0) + weight[e.order]
    while region.order >= 0 and alike[region.parent.order, paths[region.order]] > weight[region.order]:
        region = region.parent
    return region.order


def main_blocks(page: str | None, threshold: float = THRESHOLD) -> list[str]:
    """Texts of the main text's blocks, in page order."""
    if not page:
        return []
    reader = Reader(page)
    elements, blocks = reader.elements, reader.blocks
    paths, plain = _paths(elements), [0] * len(elements)
    for b in blocks:
        if b.at.order >= 0:
            b.path = paths[b.at.order]
            plain[b.at.order] += len(b.text) - b.links
    _upward(elements, plain)
    bad = _left_out(elements, plain, sum(len(b.text) - b.links for b in blocks) or 1)
    good = [b for b in blocks if b.at.order < 0 or not bad[b.at.order]]
    chosen = content_paths(good, threshold)
    weight, total = [0] * len(elements), 0
    for b in good:
        if b.path in chosen:
            total += len(b.text)
            if b.at.order >= 0:
                weight[b.at.order] += len(b.text)
    if not total:
        return []
    _upward(elements, weight)
    at = _region(elements, paths, bad, weight, total)
    branch = [-1] * len(elements)  # the region's child that an element is in; the region is in itself, what is outside in none
    for e in elements:
        up = e.parent.order
        branch[e.order] = e.order if e.order == at or up == at else branch[up] if up >= 0 else -1
    out = []
    for b in good:
        own = branch[b.at.order] if b.at.order >= 0 else -1
        if own < 0 and (at >= 0 or b.at.order >= 0):
            continue
        if b.path not in chosen:
            if b.links > 0.5 * len(b.text):
                continue
            if own >= 0 and own != at and not weight[own] and elements[own].name not in _FLOW:
                continue
        out.append(b.text)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (main_blocks joined by two newlines) and n_chars (its code points).

    Null, empty and textless pages give an empty text; pages of any length are read whole. Repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows. A single narrow pass: nothing moves between tasks.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(x.as_py())) for x in batch.column(2)]
            made = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
