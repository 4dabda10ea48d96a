"""Main text of web pages by consensus paths per host.

Pass 1 scores the containers of each page by the running text that stands in
them, and votes for their generalised paths (tags with their classes, numbers
struck out).  Spark sums the votes per host and path; a path whose text is the
same on page after page loses weight.  Pass 2 re-extracts every page from the
container at its host's winning path, so that a page with little text, or with
one long aside, is cut like the other pages of its host.  A page without that
container, or without text in it, falls back on its own best one.

Menus, footers and hidden parts are left out by their tags, roles and visibility.  A name (a class or id) that sounds
like page furniture only weighs against its container: one that holds nearly all running text of the page, or
its article, is a wrapper and stays.  Markup is read in one pass whose time is linear in the page, however broken it is.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted, written
from .url_filter import host_of

# fixed values of HTML: how elements nest and break lines
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
SKIPPED = frozenset("template svg math object select".split())  # they nest, may close themselves, and have no running text
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul caption".split()
)
CLOSES_PARAGRAPH = BLOCK - {"html", "body"}
CLOSED_BY_SIBLING = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table body html article main section div aside td".split())
MOST_DEPTH = 256
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

ASIDE_TAGS = frozenset("nav aside footer button menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal overlay "
    "comment comments discussion disqus replies reply respond share sharing social related recommended newsletter subscribe "
    "signup login search pagination pager toolbar copyright skip".split()
)
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
WRAPS = 0.8  # share of a page's running text from which a container is a wrapper, whatever its name
BODY_NAMES = frozenset("content article post entry story main body text".split())
NEGATIONS = frozenset("no not without with has have".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    """An element with what extraction asks of it."""

    __slots__ = ("tag", "path", "hard", "soft", "comments", "aside", "parent", "depth", "inside", "score", "blocks", "held", "article")

    def __init__(self, tag: str, path: str, parent: Node | None):
        self.tag, self.path, self.parent = tag, path, parent
        self.hard = self.soft = self.comments = self.aside = self.article = False
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)  # of an article
        self.score, self.held, self.blocks = 0.0, 0.0, []  # held: running text below; blocks: numbers of the text blocks below


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _names(attributes: dict[str, str]) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower())


def _is_furniture(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is page furniture by its tag, role or visibility."""
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return attributes.get("role", "").lower() in ASIDE_ROLES


def _aside_names(tag: str, attributes: dict[str, str]) -> list[str]:
    """The words of an element's names that sound like page furniture."""
    if tag in ("html", "body", "article", "main"):
        return []
    names = _names(attributes)
    return [n for i, n in enumerate(names) if n in ASIDE_NAMES and (i == 0 or names[i - 1] not in NEGATIONS)]


def _step(tag: str, attributes: dict[str, str]) -> str:
    """One step of a generalised path; numbers in class names, and the page's own classes, do not count."""
    if tag in ("html", "body"):
        return tag
    classes = sorted({re.sub(r"\d+", "0", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


class Page:
    """Text blocks of a page in order, and the containers that they stand in."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self._blocks: list[tuple[Node, float]] = []  # where each text stands, and how much of it is no link
        self._parts: list[str] = []
        self._linked = 0
        self._in_link = False
        self._root = self._open = self._push("html", {}, None)
        self._read(source)
        self._break()
        self._settle()

    def _push(self, tag: str, attributes: dict[str, str], parent: Node | None) -> Node:
        if parent and parent.depth >= MOST_DEPTH:
            return parent  # as browsers do: what is nested deeper stands beside
        inside = bool(parent and parent.inside)
        named = _aside_names(tag, attributes)
        headed = tag == "header" or (inside and named[:1] == ["header"])
        header = headed or (parent is not None and parent.tag == "header" and tag not in HEADINGS)
        node = Node("header" if header else tag, f"{parent.path}>{_step(tag, attributes)}" if parent else tag, parent)
        node.hard = bool(parent and parent.hard) or _is_furniture(tag, attributes) or (tag == "header" and not inside)
        node.soft = tag == "form" or (bool(named) and not headed)
        node.comments = not COMMENT_NAMES.isdisjoint(named)
        self.nodes.append(node)
        return node

    def _break(self) -> None:
        """End the block in progress."""
        text = " ".join("".join(self._parts).split())
        linked, self._parts, self._linked = self._linked, [], 0
        if text and not self._open.hard and self._open.tag != "header":
            self.texts.append(text)
            self._blocks.append((self._open, max(0.0, float(len(text) - linked))))

    def _settle(self) -> None:
        """Decide which containers are asides, now that all text is known, and score the others."""
        for node, weight in self._blocks:
            node.held += weight
        for node in reversed(self.nodes):  # parents come before what they hold
            if node.parent:
                node.parent.held += node.held
                node.parent.article |= node.article or node.tag in ("article", "main")
        total = self._root.held
        for node in self.nodes:
            wraps = (node.article and not node.comments) or (total > 0 and node.held >= WRAPS * total)
            node.aside = bool(node.parent and node.parent.aside) or node.hard or (node.soft and not wraps)
        for number, (node, weight) in enumerate(self._blocks):
            if node.aside:
                continue
            share = 1.0
            holder = node.parent if node.tag in ("p", "pre", "li", "blockquote", *HEADINGS) and node.parent else node
            while node:
                node.blocks.append(number)
                node = node.parent
            for _ in range(3):  # the container itself, the one around it, and that around both
                if holder is None:
                    break
                holder.score += share * weight
                share, holder = share / 2, holder.parent

    def _text(self, text: str) -> None:
        if text:
            plain = html_module.unescape(text) if "&" in text else text
            self._parts.append(plain)
            if self._in_link:
                self._linked += len(plain.strip())

    def _close(self, tag: str, scopes: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of the name, if one is open in scope."""
        node = self._open
        while node and node is not self._root:
            if node.path.rpartition(">")[2].split(".")[0] == tag:
                self._break()
                self._open = node.parent or self._root
                return
            if node.path.rpartition(">")[2].split(".")[0] in scopes:
                return
            node = node.parent

    def _read(self, source: str) -> None:
        at, last, quotes = 0, source.rfind(">"), True
        ends: dict[str, dict[int, int]] = {}
        while True:
            start = source.find("<", at)
            if start < 0 or start > last:  # no tag can end behind the last >
                break
            self._text(source[at:start])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(source)
                continue
            if source[start + 1] in "!?":
                at = source.find(">", start) + 1
                continue
            found = _TAG.match(source, start)
            if not found:
                self._text("<")
                at = start + 1
                continue
            close = _QUOTED_END.match(source, found.end()) if quotes else None
            quotes = close is not None  # an open quote: from here on tags end at the next >
            at = close.end() if close else source.find(">", found.end()) + 1
            tag, inner = found[2].lower(), source[found.end() : at - 1]
            if found[1]:
                if tag == "a":
                    self._in_link = False
                elif tag in BLOCK or tag in ("td", "th"):
                    self._close(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._parts.append(" ")
            elif tag in SKIPPED:
                if tag not in ends:
                    ends[tag] = _nested_ends(source, tag)
                at = max(at, ends[tag].get(start, at))
                self._parts.append(" ")
            elif tag == "a":
                self._in_link = True
            elif tag in ("br", "td", "th", "wbr", "img", "input", "hr"):
                if tag == "hr":
                    self._break()
                elif tag != "wbr":
                    self._parts.append(" ")
            elif tag == "html":
                continue
            elif tag in BLOCK:
                self._break()
                if tag in CLOSES_PARAGRAPH:
                    self._close("p", SCOPES)
                for sibling in CLOSED_BY_SIBLING.get(tag, ()):
                    self._close(sibling, SCOPES - {"div"} if sibling == tag else SCOPES)
                self._open = self._push(tag, _attributes(inner), self._open)
        self._text(source[at:])

    def votes(self) -> dict[str, tuple[float, int]]:
        """Share of the page's score and digest of the text, for each path of a container."""
        scored: dict[str, float] = {}
        blocks: dict[str, list[int]] = {}
        for node in self.nodes:
            if node.blocks and not node.aside:
                names = set(node.path.rpartition(">")[2].split(".")[1:])
                bonus = 1.25 if node.tag in ("article", "main") or names & BODY_NAMES else 1.0
                scored[node.path] = scored.get(node.path, 0.0) + bonus * node.score
                blocks.setdefault(node.path, []).extend(node.blocks)
        total = sum(scored.values())
        return {
            path: (score / total if total else 0.0, xxhash.xxh64_intdigest("\n".join(self.texts[b] for b in blocks[path]).encode("utf-8", "replace")) >> 1)
            for path, score in scored.items()
        }

    def best(self) -> str | None:
        votes = self.votes()
        return min(votes, key=lambda p: (-votes[p][0], p)) if votes else None

    def text_at(self, path: str | None) -> str:
        """Blocks of all containers at the path, in page order."""
        numbers = sorted({b for node in self.nodes if node.path == path and not node.aside for b in node.blocks})
        return "\n".join(self.texts[b] for b in numbers)


def _nested_ends(source: str, tag: str) -> dict[int, int]:
    """Where each element of the name ends, by its start; elements that close themselves or are never closed have no end."""
    ends, open_ = {}, []
    for found in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*+>", source, re.I):
        if found[1]:
            if open_:
                ends[open_.pop()] = found.end()
        elif not found[0].endswith("/>"):
            open_.append(found.start())
    return ends


def main_text(source: str | None, path: str | None = None) -> str:
    """Text of a page from the container at ``path``, or else from its own best one."""
    if not source:
        return ""
    page = Page(source)
    return page.text_at(path) or page.text_at(page.best())


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path, pages, votes)``: the winning path of every host.

    Votes are the pages' shares, times the share of different texts at the path;
    ties go to the path that sorts first.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, p, s, d) for h, source in zip(frame["host"], frame["html"]) if source for p, (s, d) in Page(source).votes().items()]
            yield pd.DataFrame(rows, columns=["host", "path", "share", "digest"])

    located = pages.select(host_of(quoted(url)).alias("host"), quoted(html).cast("string").alias("html"))
    votes = map_frames(located, batches, "host string, path string, share double, digest bigint")
    # whole thousandths add up to the same sum in any order
    whole = F.round(F.col("share") * 1000).cast("bigint")
    tally = votes.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(whole).alias("sum"), F.approx_count_distinct("digest").alias("texts")
    )
    weight = F.col("sum") * F.least(F.lit(1.0), F.col("texts") / F.col("pages"))
    ranked = tally.select("host", "path", "pages", weight.alias("votes"))
    best = ranked.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "path", "pages")).alias("best"))
    return best.select("host", "best.path", "best.pages", (-F.col("best.minus")).alias("votes"))


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, path)`` for every row of ``pages``.

    A null or empty page, and one without running text, has the empty text.  A null url is
    a host of its own (the empty one).  Rows that repeat are extracted alike and vote as often as they come; equal
    votes go to the path that sorts first.  Pages of any length are read whole, in time linear in their length.  Columns other
    than the three named ones take no part, whatever their names.  An empty table gives an empty result.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(source, path) for source, path in zip(frame["html"], frame["path"])]
            yield pd.DataFrame(
                {"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": frame["path"]}
            )

    winners = written(host_paths(pages, url=url, html=html).select(F.col("host").alias("h"), "path"), "html-paths")
    rows = pages.select(
        quoted(page_id).alias("page_id"), quoted(url).cast("string").alias("url"), quoted(html).cast("string").alias("html"), host_of(quoted(url)).alias("host")
    )
    met = rows.join(winners, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "path")
    kind = met.schema["page_id"].dataType.simpleString()
    return map_frames(met, batches, f"page_id {kind}, url string, text string, n_chars bigint, path string")
