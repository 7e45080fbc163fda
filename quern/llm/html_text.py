"""Main text of web pages by tag-path ratios.

Each page is parsed into blocks of text with their root-to-leaf tag path. Per
path the text length outside links and the punctuation are aggregated and divided
by the path's number of blocks; the two ratios are smoothed along the page with a
Gaussian kernel, fused by their geometric mean, and paths above a share of the
standard deviation are content paths. Selected are the blocks of all content paths (of
those inside the article or main element, where one holds content), and the blocks
between them: those of weaker paths, such as headings and short items, in the subtree
that holds the content paths. Page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts, styles) takes no part in any of it.

Furniture is known by element, role, ``hidden``, or a class or id that is a furniture
word, alone or with one qualifier (``site-footer``) that does not name content
(``article-header``) or say that it lies elsewhere (``with-sidebar``).

Null html is an empty page; a page without text gives an empty text. Unclosed
and misnested tags are closed as browsers do for paragraphs, list items, table
cells and the like. Pages are independent: no shuffle, and repeated rows are
extracted one by one. Extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_batches

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption".split())
FURNITURE = frozenset("nav header footer aside form button select option menu dialog svg canvas object audio video map fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "sidebar aside rail widget related recommended notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login form search "
    "comment comments reply replies disqus discussion responses share sharing social toolbar pagination pager copyright legal".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("ul ol dl table select html body td th".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[-_]+")
#: Qualifiers of a furniture word that name content, or say that furniture lies elsewhere.
CONTENT = frozenset("article post entry content main story text body with has no without is not".split())
_PUNCT = re.compile(r"[,.;:!?…、。，！？¿¡\"'()—–]")
_GAP = re.compile(r"\s+")

#: Share of the standard deviation that a content path has to reach.
THRESHOLD = 0.5
#: Gaussian kernel of the smoothing.
KERNEL = [math.exp(-0.5 * k * k) for k in range(-2, 3)]


class Block:
    __slots__ = ("path", "bad", "text", "linked")

    def __init__(self, path, bad, text, linked):
        self.path, self.bad, self.text, self.linked = path, bad, text, linked


def _marked(name: str) -> bool:
    """Whether a class or id names furniture."""
    if name in MARKS:
        return True
    parts = [x for x in _PARTS.split(name) if x]
    return len(parts) == 2 and not MARKS.isdisjoint(parts) and CONTENT.isdisjoint(parts)


def _furniture(tag: str, attributes: str) -> int:
    """2: furniture by element, role or ``hidden``; 1: by a class or id; 0: none."""
    if tag in FURNITURE:
        return 2
    marked = 0
    for m in _ATTR.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "role" and value.strip() in ROLES) or (name == "aria-hidden" and value == "true"):
            return 2
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and any(map(_marked, value.split())):
            marked = 1
    return marked


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order, with white space turned into single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, label in the path, furniture
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _GAP.sub(" ", "".join(parts)).strip()
            if text:
                path = tuple(label for tag, label, _ in stack if tag not in INLINE)
                out.append(Block(path, max((bad for *_, bad in stack), default=0), text, linked))
            parts.clear()
        linked = 0

    def pop_to(tags, stop=_SCOPE) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    here, n = 0, len(page)
    while here < n:
        m = _TAG.search(page, here)
        raw = page[here : m.start()] if m else page[here:]
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(tag == "a" for tag, *_ in stack):
                linked += len(text.strip())
        if not m:
            break
        here = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                pop_to({tag}, frozenset() if tag not in ("p", "li", "dt", "dd") else _SCOPE)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if stack[k][2]:
                            flush()
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, here)
            here = end.end() if end else n
            continue
        bad = _furniture(tag, attributes)
        if tag in INLINE:
            if bad:
                flush()
            if not attributes.rstrip().endswith("/"):
                stack.append((tag, tag, bad))
            continue
        flush()
        if tag in CLOSES_P:
            pop_to({"p"})
        if tag in _SAME:
            pop_to(_SAME[tag], _SCOPE - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "tfoot") else _SCOPE)
        stack.append((tag, tag, bad))
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(KERNEL):
            j = i + k - 2
            if 0 <= j < len(values):
                total += w * values[j]
                weight += w
        out.append(total / weight)
    return out


def content_paths(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose smoothed and fused ratios reach the threshold."""
    stats: dict[tuple[str, ...], list[int]] = {}
    for b in found:
        s = stats.setdefault(b.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(_PUNCT.findall(b.text)) if b.linked < len(b.text) / 2 else 0
        s[2] += 1
    text = _smooth([stats[b.path][0] / stats[b.path][2] for b in found])
    marks = _smooth([(stats[b.path][1] + 1) / stats[b.path][2] for b in found])
    fused = [math.sqrt(a * b) for a, b in zip(text, marks)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    best: dict[tuple[str, ...], float] = {}
    for b, x in zip(found, fused):
        best[b.path] = max(best.get(b.path, 0.0), x)
    top = max(best.values())
    return {p for p, x in best.items() if stats[p][0] and (x >= THRESHOLD * deviation and x >= 0.1 * top)}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not page:
        return ""
    every = blocks(page)
    for worst in (0, 1):  # if words of classes exclude all content, they mean something else on this page
        found = [b for b in every if b.bad <= worst]
        chosen = content_paths(found) if found else set()
        if chosen:
            break
    else:
        return ""
    for tag in ("article", "main"):  # a marked article that holds content is the container
        inside = [p for p in chosen if tag in p]
        if inside:
            at = min(p.index(tag) for p in inside)
            root = next(p for p in inside if p.index(tag) == at)[: at + 1]
            return "\n".join(b.text for b in found if b.path[: len(root)] == root)
    weight: dict[tuple[str, ...], int] = {}
    for b in found:
        if b.path in chosen:
            weight[b.path] = weight.get(b.path, 0) + len(b.text) - b.linked
    first = max(weight, key=weight.get)
    root = first
    for p in weight:
        if len(weight) > 1:
            k = 0
            while k < min(len(root), len(p)) and root[k] == p[k]:
                k += 1
            if k > 2 or root[:k] == first[:k] and k >= len(first) - 1:
                root = root[:k]
    while root and root[-1] in LEAF:
        root = root[:-1]
    return "\n".join(b.text for b in found if b.path in chosen or b.path[: len(root)] == root)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text and its number of code points."""
    ids, urls = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    arrow_batches(pages.sparkSession)
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {ids}, url {urls}, text string, n_chars bigint")
