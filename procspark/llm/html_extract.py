"""Main text of web pages by tag-path ratios.

A page is cut into blocks; a block's path is the chain of block elements above it. Text length and punctuation are
summed per path, divided by the path's blocks, smoothed along the page, fused with what the element names say, and
paths over a threshold are content. From the smallest element that holds most of the content one climbs to the article,
main or content-named element around it (without any, to the smallest element that holds all content): its other
blocks (headings, leads, short sections) belong to it unless they are mostly links or stand in a rejected element. Content
in a further article, main or content-named element is kept as well.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procspark.llm.common import arrow_map, only

# Element roles of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select datalist button".split())
RAW = frozenset("script style title textarea noscript template iframe svg".split())
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address hr form fieldset legend details summary dialog center hgroup search textarea".split())
APART = frozenset("nav footer aside form dialog menu search textarea fieldset".split())
ENDS_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body"}
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|"
    r"subscri\w+|popup|modal|overlay|sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|toolbar|comments?|"
    r"commentlist|disqus|respond|replies|share|sharing|social|related|recommend\w*|widget|login|signup|pagination|pager|copyright|skip)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text|body)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())

COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|related|recommend\w*)(?=$|[\s_-])", re.I)
TELLS = re.compile(r"(?:has|no|with|without|hide|show)[_-]", re.I)  # such a token says what stands beside the element, not what it is

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_BETWEEN = re.compile(r"[\s/]*+")
_PART = re.compile(r"""[\s/]*+([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>"'][^\s>]*+))?)?""")


def _attributes(page: str, at: int, missing: set[str]) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on, the first of each name, and the place behind the tag (-1: it never ends).

    A value ends at its closing quote, however far; a quote without one counts as a letter (``missing`` keeps which have none left).
    """
    found: dict[str, str] = {}
    while m := _PART.match(page, at):
        at, value = m.end(), m[3] or ""
        if m[2]:
            close = -1 if m[2] in missing else page.find(m[2], at)
            if close < 0:
                missing.add(m[2])
            else:
                value, at = page[at:close], close + 1
        found.setdefault(m[1].lower(), value)
    at = _BETWEEN.match(page, at).end()
    return found, at + 1 if at < len(page) else -1


class _Element:
    """``off``: no content by its kind or attributes. ``named``: so by its class or id, unless most of the page is in it."""

    __slots__ = ("name", "path", "depth", "off", "named", "comments", "good", "own_good", "parent", "article", "place")

    def __init__(self, name, attrs, parent, paths, place):
        self.name, self.parent, self.place = name, parent, place
        self.depth = parent.depth + 1 if parent else 0
        self.good = parent.good if parent else False
        self.article = parent.article if parent else False
        self.named = self.comments = self.own_good = False
        label = name
        self.off = name in APART or name in HIDDEN or (name == "header" and not self.article)
        if attrs:
            words = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
            if words and name not in ("html", "body", "main"):
                label = f"{name}.{words[0]}"
                said = " ".join(w for w in words if not TELLS.match(w))
                heads_article = name == "header" and self.article
                self.named = any(m[0].strip(" _-").lower() != "header" or not heads_article for m in NAMES.finditer(said))
                self.comments = bool(COMMENTS.search(said))
                self.own_good = bool(GOOD.search(said))
                if self.own_good and not self.named:
                    self.good = True
            self.off |= (attrs.get("role", "") in ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs
                         or "display:none" in attrs.get("style", "").replace(" ", ""))
        if name in ("article", "main") and not self.off:
            self.good = self.article = True
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))


def blocks_of(page: str) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """All elements, parents first, and ``(element, text, characters inside links)`` of every block with text, in page order."""
    paths: dict[tuple[int, str], int] = {}
    root = _Element("", {}, None, paths, 0)
    stack: list[_Element] = [root]
    elements, opened, missing = [root], Counter(), set()
    out, buf = [], []
    links = [0]
    in_link = 0

    def flush():
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            buf.clear()
            if text:
                owner = stack[-1]
                while owner.name and owner.name not in BLOCK and owner.name not in HIDDEN:
                    owner = owner.parent
                out.append((owner, text, min(links[0], len(text))))
        links[0] = 0

    def put(piece):
        if piece:
            buf.append(piece)
            if in_link:
                links[0] += len(piece)

    def pop_to(k):
        nonlocal in_link
        if any(e.name in BLOCK for e in stack[k:]):
            flush()
        in_link -= sum(e.name == "a" for e in stack[k:])
        opened.subtract(e.name for e in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # <!--> and <!---> are comments, too
            at = n if end < 0 else end + 3
            continue
        m = _OPEN.match(page, lt)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                put("<")
                at = lt + 1
            continue
        closing, name = m[1], m[2].lower()
        attrs, at = _attributes(page, m.end(), missing)
        if at < 0:  # a tag cut off by the end of the page
            break
        if closing:
            if name == "br":
                put(" ")
                continue
            if not opened[name]:
                continue
            limit = name in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop_to(k)
                    break
                if not limit and stack[k].name in BLOCK:
                    break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                put(" ")
            continue
        if name in RAW:
            if page[at - 2] != "/":
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop_to(k)
                    break
                if stack[k].name in BLOCK:
                    break
        if name in CLOSES:
            ends, within = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends.split():
                    pop_to(k)
                    break
                if stack[k].name in within:
                    break
        if name in BLOCK:
            flush()
        stack.append(_Element(name, attrs, stack[-1], paths, len(elements)))
        elements.append(stack[-1])
        opened[name] += 1
        in_link += name == "a"
    flush()
    return elements, out


def _held(elements: list[_Element], sizes: list[tuple[_Element, int]]) -> list[int]:
    """Per element what it and the elements in it hold."""
    held = [0] * len(elements)
    for e, size in sizes:
        held[e.place] += size
    for e in reversed(elements[1:]):
        held[e.parent.place] += held[e.place]
    return held


def _within(elements: list[_Element], own: list[bool]) -> list[bool]:
    """Whether an element or one around it is marked."""
    inside = list(own)
    for e in elements[1:]:
        inside[e.place] = inside[e.place] or inside[e.parent.place]
    return inside


def _apart(elements: list[_Element], blocks: list[tuple[_Element, str, int]]) -> list[bool]:
    """Elements that are no content. A class or id says so, but not of an element with at least half of the text that
    is a content element by another of its names or has an article or main element in it; comments are apart at any size."""
    off = _within(elements, [e.off for e in elements])
    held = _held(elements, [(e, len(text)) for e, text, _ in blocks if not off[e.place]])
    articles = _held(elements, [(e, 1) for e in elements if e.name in ("article", "main") and not off[e.place]])
    spared = [2 * held[e.place] >= held[0] > 0 and not e.comments and (e.own_good or articles[e.place] > 0) for e in elements]
    for e in elements[1:]:
        e.good = e.good or e.parent.good or (e.own_good and spared[e.place])
    return _within(elements, [off[e.place] or (e.named and not spared[e.place]) for e in elements])


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    padded = np.concatenate([x[:1], x, x[-1:]])
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def _article_of(core: _Element, held: list[int]) -> _Element:
    """The outermost article around ``core``, else the nearest main, else the outermost content-named element, else what holds all chosen text."""
    chain = [core]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    for found in ([e for e in chain if e.name == "article"][-1:], [e for e in chain if e.name == "main"][:1], [e for e in chain if e.good][-1:]):
        if found:
            return found[0]
    return next(e for e in chain if held[e.place] == held[0])


def main_text(page: str | None, share: float = 0.1, link_share: float = 0.5) -> str:
    """The article's blocks, one per line. ``share``: a path is content from this part of the best fused ratio on."""
    elements, blocks = blocks_of(page or "")
    apart = _apart(elements, blocks)
    found = [b for b in blocks if not apart[b[0].place]]
    if not found:
        return ""
    totals: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for element, text, linked in found:
        t = totals[element.path]
        t[0] += len(text) - linked
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += 1
        t[3] += len(text)
    text_ratio = _smooth(np.array([totals[e.path][0] / totals[e.path][2] for e, _, _ in found]))
    mark_ratio = _smooth(np.array([totals[e.path][1] / totals[e.path][2] for e, _, _ in found]))
    named = np.array([4.0 if e.good else 1.0 for e, _, _ in found])
    fused = text_ratio * (1 + mark_ratio) * named
    by_path: dict[int, float] = defaultdict(float)
    for (e, _, _), score in zip(found, fused):
        by_path[e.path] += score / totals[e.path][2]
    best = max(by_path.values())
    chosen = {p for p, score in by_path.items() if score >= share * best and totals[p][3] - totals[p][0] <= link_share * totals[p][3]}
    # the smallest element that holds most of the chosen text
    held = _held(elements, [(e, len(text)) for e, text, _ in found if e.path in chosen])
    if not held[0]:
        return ""
    article = max((e for e in elements if held[e.place] >= 0.8 * held[0]), key=lambda e: e.depth)
    if article.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre", "blockquote"):
        article = article.parent
    article = _article_of(article, held)
    inside = _within(elements, [e is article for e in elements])
    keep = [text for e, text, linked in found if (inside[e.place] and (e.path in chosen or linked <= link_share * len(text))) or (e.good and e.path in chosen)]
    return "\n".join(keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), share: float = 0.1) -> DataFrame:
    """``keep`` columns, ``text``, ``n_chars`` (code points): one row for every page, as often as it is there.

    Null or empty html, and pages without an article, give an empty text. A page is handled whole, whatever its
    length; the work is linear in it and needs no shuffle. Columns besides ``keep`` and the html are not read.
    """
    source = only(pages, *keep, html_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, share) for p in batch.column(len(keep)).to_pylist()]
        cols = [batch.column(i) for i in range(len(keep))]
        cols += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(source, run, f"{types}, text string, n_chars bigint")
