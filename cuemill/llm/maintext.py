"""Main text of raw pages by composite text density.

Each node of the page's tree gets its characters per tag, discounted by the share of its characters and tags that
are links. The subtree whose children's densities add up to the most holds the article; the smallest density on its
path from the body is the threshold that other subtrees must reach to belong to it. Tags and names say only what is left
out before (menus, forms, adverts, comments), never which subtree is the article; a name that a subtree merely shares a
part of ("has-sidebar", "share-price") leaves it out only where it is small or mostly links.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# possessive, and stopped by the next tag: one look at each character, however broken the page
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
#: Elements whose content is not markup, up to their end tag.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp", "nobr",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
#: Elements that stand in an article's text beside its paragraphs.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "figure", "table", "section", "article", "hgroup", "details", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Never part of an article's text.
DROPPED = {"head", "script", "style", "title", "textarea", "noscript", "iframe", "template", "nav", "footer", "aside", "form", "button", "select", "option", "object", "svg", "canvas", "menu", "dialog", "audio", "video", "datalist", "xmp", "noembed"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "promo",
    "promotion", "sponsor", "sponsored", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login",
    "pagination", "pager", "widget", "masthead", "header", "disclaimer", "topbar", "toolbar", "copyright", "replies", "reply", "respond", "skip", "alert", "paywall",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Shares of a page's text up to which a subtree goes by part of a name, and as comments.
SMALL, MOST = 0.3, 0.8
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hidden(tag: str, attributes: str) -> bool:
    """Whether the markup itself says that the element is no text of the page."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role name something beside the article: by a whole name, by part of one, and as comments.
    Names of what an element has or lacks ("has-sidebar") name something else."""
    whole = part = comments = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            whole = whole or value.strip().lower() in ROLES
        elif name in ("class", "id"):
            for token in value.split():
                words = [x.lower() for x in PARTS.findall(token)]
                if not words or words[0] in ("has", "with", "without", "no", "is", "not"):
                    continue
                found = WORDS.intersection(words)
                whole = whole or bool(found) and len([w for w in words if not w.isdigit()]) == 1
                part = part or bool(found)
                comments = comments or not COMMENTS.isdisjoint(words)
    return whole, part, comments


class Page:
    """The page's tree in arrays: a node's number is larger than its parent's."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str]] = []  # (node, text) in page order; (node, " ") where a block begins or ends
        self.open: Counter = Counter()  # names on the stack, and None for its blocks
        stack, at = [0], 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._end(stack, name)
                continue
            self._begin(stack, name, m[3])
            if name in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._pop(stack)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.texts.append((node, text))

    def _pop(self, stack: list[int]) -> str:
        name = self.tag[stack.pop()]
        self.open[name] -= 1
        return name

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            if self._pop(stack) not in INLINE:
                self.texts.append((stack[-1], " "))

    def _begin(self, stack: list[int], name: str, attributes: str) -> None:
        ends = CLOSES.get(name, ())
        paragraph = name not in INLINE and name != "br" and self.open["p"]
        if paragraph or any(self.open[x] for x in ends):
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in ends or tag == "p" and paragraph:
                    self._close(stack, depth)
                    if not ends:
                        break
                elif tag not in INLINE and tag != "p" and not (ends and tag not in SCOPES):
                    break
        if name not in INLINE:
            self.texts.append((stack[-1], " "))
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.attributes.append(attributes or "")
        if name not in VOID:
            stack.append(len(self.tag) - 1)
            self.open[name] += 1

    def _end(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1) if self.open[name] else ():
            if self.tag[stack[depth]] == name:
                self._close(stack, depth)
                return
            if name in INLINE and self.tag[stack[depth]] not in INLINE and self.tag[stack[depth]] != "p":
                return
        if name in ("p", "br"):
            self.texts.append((stack[-1], " "))


def _totals(page: Page, off: list[bool], kept: list[tuple[int, str]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, tags, and those of both in links, of every subtree without what is off."""
    n, tag, parent = len(page.tag), page.tag, page.parent
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tag[i] == "a"
    for i, text in kept:
        if not off[i]:
            size = len(text) - text.count(" ")
            chars[i] += size
            link_chars[i] += size if linked[i] else 0
    for i in range(n - 1, 0, -1):
        if not off[i]:
            up = parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tag[i] == "a")
    return chars, tags, link_chars, link_tags


def _left_out(page: Page, texts: list[tuple[int, str]], under: list[set]) -> list[bool]:
    """Nodes that are not the page's text: by their markup, then by their names, whole ones unless nothing else is left."""
    n, tag, parent = len(page.tag), page.tag, page.parent
    hard = [False] * n
    for i in range(1, n):
        hard[i] = hard[parent[i]] or tag[i] != "form" and _hidden(tag[i], page.attributes[i])
    chars, _, link_chars, _ = _totals(page, hard, texts)
    for i in range(1, n):  # a form with paragraphs that holds nearly all text is a wrapper round the page
        hard[i] = hard[i] or hard[parent[i]] or tag[i] == "form" and not (under[i] and chars[i] > MOST * chars[0])
    chars, _, link_chars, _ = _totals(page, hard, texts)
    total = max(1, chars[0])
    for by_whole_names in (True, False):
        off = hard[:]
        for i in range(1, n):
            off[i] = off[i] or off[parent[i]]
            if off[i]:
                continue
            links = link_chars[i] * 2 > chars[i]
            if page.attributes[i] and tag[i] not in ("html", "body", "main"):
                whole, part, comments = _named(page.attributes[i])
                # a wrapper named after something it contains is kept if it holds the headline or the article as well
                holds = under[i] & {"article", "main", "h1"} - {tag[i]} if tag[i] != "article" else under[i] & {"h1"}
                if part and (not holds or comments and "h1" not in under[i]):
                    share = chars[i] / total
                    off[i] = whole and by_whole_names or share <= SMALL or links or comments and share <= MOST
                elif whole and not part and not holds:  # a role
                    off[i] = True
            if not off[i] and tag[i] == "header":
                inside, up = False, parent[i]
                while up > 0 and not inside:
                    inside, up = tag[up] in ("article", "main", "section"), parent[up]
                off[i] = not inside and (links or tag[parent[i]] in ("body", "html", "#root") or not under[i] & HEADINGS)
        if any(not off[i] and text.strip() for i, text in texts):
            break
    return off


def main_text(source: str | None) -> str:
    """Text of the article in a page; empty for a page without one. Character references are decoded, white space
    within a block is one space, blocks are joined by one space in page order.

    The subtree with the largest sum of densities is taken with: subtrees beside its path that reach the smallest density
    on that path and are not mostly links; paragraphs, headings, lists and the like beside its path within the smallest
    step that holds half of the text; and the first headline beside its path. Lists of links inside are left out."""
    page = Page(source or "")
    n, tag, parent = len(page.tag), page.tag, page.parent
    under: list[set] = [set() for _ in range(n)]
    for i in range(n - 1, 0, -1):
        if tag[i] in ("article", "main", "p", *HEADINGS):
            under[i].add(tag[i])
        if under[i]:
            under[parent[i]] |= under[i]
    texts = [(i, entities.unescape(t)) for i, t in page.texts]
    off = _left_out(page, texts, under)
    for _ in range(2):
        chars, tags, link_chars, link_tags = _totals(page, off, texts)
        # lists of links inside the text, by their own share of links: no part of it, and no weight in any density
        for i in range(1, n):
            listed = tag[i] not in INLINE and tag[i] not in ("p", "body", "html") and tag[i] not in HEADINGS and link_tags[i] > 2 and link_chars[i] * 10 > chars[i] * 7
            off[i] = off[i] or off[parent[i]] or listed
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    density, sums = [0.0] * n, [0.0] * n
    share = link_chars[body] / max(1, chars[body])
    for i in range(n):
        if chars[i] and not off[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(math.log(base), 1e-3)
    for i in range(1, n):
        sums[parent[i]] += density[i]
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]] and not off[i]
    best = max((i for i in range(n) if inside[i] and chars[i]), key=lambda i: (sums[i] or density[i], -i), default=body)
    path = [best]
    while path[-1] != body and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    boxes = [tag[i] not in INLINE and (tag[i] not in TEXTUAL or tag[i] in ("section", "article")) and tag[i] not in ("li", "dt", "dd", "tr", "td", "th", "tbody") for i in path]
    region = next((k for k, i in enumerate(path) if boxes[k] and chars[i] * 2 >= chars[body]), len(path) - 1)
    least, steps, near = min(density[i] for i in path), set(path), set(path[: region + 1])
    chosen, headline = [False] * n, "h1" in under[best]
    chosen[best] = True
    for i in range(n):
        if inside[i] and i not in steps and parent[i] in steps:
            few_links = link_chars[i] * 3 < chars[i] or not chars[i]
            dense = density[i] >= least and few_links
            beside = parent[i] in near and few_links and (tag[i] in TEXTUAL or tag[i] in INLINE)
            titled = not headline and i < best and "h1" in under[i] and few_links
            headline = headline or titled
            chosen[i] = dense or beside or titled
    # text that stands directly in a step of the path, between its elements
    own = near - {body} if tag[best] != "body" else near
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[parent[i]]
    return " ".join("".join(t for i, t in texts if not off[i] and (chosen[i] or i in own or t.isspace())).split())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page row. A null or empty page, and one without an article, has the
    text ''; ids and urls pass through, null or not; repeated rows stay; an empty table stays empty."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInPandas(run, "page_id long, url string, text string, n_chars long")
