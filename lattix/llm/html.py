"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text runs, each with the path of tags from the root to it. Runs
of one path are taken together: their characters, their punctuation and how many they are. A
path's ratio is (characters + 8 * punctuation) / runs; it is smoothed over the paths next to it
in page order, and fused with the share of the page's text that its container holds, so that
headings and short paragraphs are judged with the article around them.

What the markup says goes into the fused score: a path in an article or main element scores
``INSIDE`` at least; what lies outside of one, on a page that has one, and what a class, id or role
calls an advert, a sidebar, comments, a notice, ... is scaled down. A class counts if all of it says
so: ``sidebar``, ``ad-box-2``, but neither ``has-sidebar`` nor ``social-sciences``; and an element that
holds most of the page's text, and its article if it has one, is not scaled. Paths under a fixed share of the best are dropped. Only runs under elements that cannot
hold main text (scripts, menus, page headers and footers, asides, forms), and hidden ones, take no part.

Each page is its own unit of work: no shuffle, and a task holds one batch of pages.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names, and words of class, id and role values.
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "title", "iframe", "object", "canvas", "xmp")
NEVER = {"head", "script", "style", "noscript", "template", "svg", "textarea", "title", "iframe", "object", "canvas", "audio", "video", "map", "xmp", "nav", "footer", "aside", "form", "button", "select", "option", "input", "fieldset", "dialog", "menu", "datalist"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mroot", "mrow", "ms", "msqrt", "msub", "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th", "tr", "figcaption", "caption", "tbody", "thead", "ul", "ol", "dl", "table"} | INLINE
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "nav", "footer", "header", "form", "body", "td", "th", "blockquote", "figure", "details", "fieldset"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "related", "recommended", "share", "sharing", "social", "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "comment", "comments", "disqus", "replies", "respond", "complementary", "contentinfo"}
WEAK = {"notice", "notices", "alert", "side", "widget", "reply", "disclaimer", "copyright", "legal", "tags", "search", "skip"}
#: Words beside which the words above keep their meaning: ad-box, comment-list.
AROUND = {"area", "bar", "block", "box", "column", "container", "content", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "module", "outer", "panel", "right", "section", "slot", "site", "the", "top", "bottom", "unit", "wrap", "wrapper", "page", "post", "article"}
#: The share of a page's text that an element holds if its class is not believed.
MOST = 0.5
PUNCTUATION = frozenset(".,;:!?…。，、")
SHARE = 0.2
#: The least score of a path in an article or main element; what scales scores down: a weak and a strong word, and lying outside.
INSIDE, WEAK_FACTOR, STRONG_FACTOR, OUTSIDE = 0.5, 0.35, 0.1, 0.15

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<(?![a-zA-Z/!?])", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _judged(tag: str, attrs: str, stack: list) -> tuple[bool, float]:
    """Whether an element takes no part, and the factor that its class, id and role give."""
    if tag in NEVER or tag == "header" and not any(s[0] in MAIN for s in stack):
        return True, 0.0
    factor = 1.0
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, 0.0
            if name in ("class", "id", "role") and tag not in MAIN:
                for token in value.split():
                    words = set(re.split(r"[^a-z]+", token)) - {""}
                    if words <= STRONG | WEAK | AROUND:
                        factor = min(factor, STRONG_FACTOR if STRONG & words else WEAK_FACTOR if WEAK & words else 1.0)
    return False, factor


def runs(page: str) -> list[tuple[str, str, int, str, bool, float]]:
    """(path, container path, block number, text, under main?, factor) of the text runs that may be main text."""
    found = _read(page)
    total, held = 0, {}  # characters of the page, and of each element that its class would scale
    for stack, _, text in found:
        if stack:
            total += len(text.strip())
            for tag in stack:
                if tag[2] < 1:
                    held[tag[3]] = held.get(tag[3], 0) + len(text.strip())
    # on a page with an article or main element, only what holds it
    around = [{tag[3] for tag in stack} for stack, _, _ in found if any(tag[0] in MAIN for tag in stack)]
    void = {e for e, n in held.items() if n > MOST * total and (not around or any(e in own for own in around))}
    out = []
    for stack, block, text in found:
        if not stack:  # white space between runs, or text outside of all elements
            out.append(("", "", block, text, False, 1.0))
            continue
        factors, least = [], 1.0
        for tag in stack:
            least = min(least, 1.0 if tag[3] in void else tag[2])
            factors.append(least)
        tags = [f"{s[0]}{f:g}" if f < 1 else s[0] for s, f in zip(stack, factors, strict=True)]  # what is judged apart has a path of its own
        k = len(tags)
        while k and stack[k - 1][0] in LEAVES:
            k -= 1
        out.append(("/".join(tags), "/".join(tags[:k]), block, text, any(s[0] in MAIN for s in stack), least))
    return out


def _read(page: str) -> list[tuple[list[tuple[str, bool, float, int]], int, str]]:
    """(elements around it, block number, text) of the text runs that may be main text; an element is (tag, unwanted so far, own factor, number)."""
    out, stack = [], []
    block, at, n, number = 0, 0, len(page), 0
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # a quote that never closes: the tag ends at the next >
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        token, at = m[0], m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag not in INLINE:
                block += 1
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            if tag in SAME:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SAME[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE - SAME[tag]:
                        break
            unwanted, factor = _judged(tag, m[3], stack)
            number += 1
            stack.append((tag, unwanted or bool(stack and stack[-1][1]), factor, number))
        elif m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                block += 1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif token[0] != "<" or token == "<" or token.startswith("<![CDATA["):
            if not (stack and stack[-1][1]) and token.strip():
                out.append((list(stack), block, token[9:-3] if token.startswith("<![CDATA[") else html.unescape(token)))
            elif not (stack and stack[-1][1]):
                out.append(([], block, token))  # white space between runs
    return out


def main_text(page: str | None, share: float = SHARE) -> str:
    """The main text: blocks in page order, joined by one space; empty if the page has none."""
    got = runs(page or "")
    main = any(r[4] for r in got)
    totals: dict[str, list[float]] = {}
    inside: dict[str, list[float]] = {}
    for path, container, _, text, _, _ in got:
        if path or text.strip():
            values = (len(text), sum(c in PUNCTUATION for c in text), 1)
            for store, key in ((totals, path), (inside, container)):
                have = store.setdefault(key, [0.0, 0.0, 0.0])
                for k in range(3):
                    have[k] += values[k]
    if not totals:
        return ""
    weigh = lambda v: math.log1p((v[0] + 8 * v[1]) / v[2])
    paths = list(totals)
    own = [weigh(totals[p]) for p in paths]
    # smoothed over the neighbours in page order
    smooth = {p: (own[max(0, k - 1)] + 2 * own[k] + own[min(len(own) - 1, k + 1)]) / 4 for k, p in enumerate(paths)}
    mass = {c: v[0] + 8 * v[1] for c, v in inside.items()}
    most = max(mass.values())
    of = {r[0]: r for r in got if r[0] in totals}
    high = max(smooth.values())
    fused = {}
    for p in paths:
        _, container, _, _, inside_main, factor = of[p]
        own = 0.5 * smooth[p] / high + 0.5 * mass[container] / most
        fused[p] = factor * (max(own, INSIDE) if inside_main else own * OUTSIDE if main else own)
    best = max(fused.values())
    blocks, last = [], None
    for path, _, block, text, _, _ in got:
        if path in fused and fused[path] < share * best:
            continue
        if block != last:
            blocks.append(" ")
            last = block
        blocks.append(text)
    return " ".join("".join(blocks).split())


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    A null or empty page has an empty text; broken markup is read as far as its tags go; equal
    pages get equal texts. Other columns are ignored.
    """

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, share) for p in column.to_pylist()], pa.string())

    return pages.select("page_id", "url", text_of(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
