"""Main-text extraction with consensus host paths.

Pass 1 parses each page, scores its containers by the prose directly in them, and emits them all as generalised
tag-class paths (digits become N). Spark sums the votes of a host's pages per path. Pass 2 extracts each page again
from the elements at its host's winning path; a page without that path, or where it holds next to nothing of the
page's prose, uses its own best container. An article that lies in several containers is taken whole: from the elements
found, the nearest <article> or <main> around them, or the outermost container below the body that holds other prose, takes their place. The body (or the
page itself, where prose stands in no container) takes it with what prose stands in it directly and with its containers that hold a real share,
unless the host's pages have voted for less.

A tag is found in one pass, whatever its quotes; a "<" that begins no tag is text, and so is a tag that doesn't end. Elements nest
MOST_DEPTH deep; deeper ones stand beside each other. Inside the chosen container menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments go: by their tag or role, or by a class or id that names such a part. A class that only says that a part is there
(has-sidebar, no-header) doesn't count, nor does one of an element that holds nearly all of the page's prose. A block's white space turns into single spaces; blocks are joined in page order by newlines.

Null html is empty; an empty page, or one without prose, has an empty text. A null url votes as host "". Long pages
are parsed whole. Repeated rows vote and are extracted each. Other columns are ignored. Ties go to the smaller path.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches

#: Hosts and bytes of winning paths up to which they are broadcast; more are joined by salted host.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 8 << 20
#: An element is no boilerplate by its class if it holds this share of the page's prose, and the page's titles or paragraphs with all but this rest.
MOST_PROSE, ALONE_REST = 0.9, 0.02
#: A page's own best container is used if the winner holds less than this share of its score.
LEAST_SHARE = 0.1
#: A container beside the article, directly in the body, belongs to it if its prose, without links, is at least this share of the article's.
OTHER_SHARE = 0.1
#: Elements that nest in each other, at most.
MOST_DEPTH = 512

#: The quantifiers give nothing back, so a tag is read once; BROKEN reads one whose quotes don't close.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?![^>]*+\Z))*+)>")
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: What else begins with "<", and how it ends.
ENDS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">"))
ATTRIBUTE = re.compile(r"(class|id|role|aria-hidden|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DIGITS = re.compile(r"\d+")
HIDDEN_STYLE = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
#: Fixed word lists of the HTML standard and of common page templates.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
DROPPED = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "select", "button", "svg", "object", "embed", "canvas", "audio", "video", "map", "search"} | RAW
CONTAINERS = {"article", "main", "section", "div", "td", "body", "blockquote", "center"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"table", "ul", "ol", "dl", "body", "html", "article", "section", "div", "main", "aside", "nav", "footer", "header", "form", "select"}
NOT_MAIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus",
    "footer", "foot", "gdpr", "header", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion",
    "recommend", "recommended", "recommendations", "related", "replies", "reply", "responses", "share", "sharing", "shares", "sidebar", "sidebars", "signup", "skip", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets", "alert", "login", "reviews", "rail", "copyright",
}
#: Words before, and after, one of these that make a class a state or layout (fixed values).
STATES = {"has", "have", "with", "without", "no", "not", "non", "is", "hide", "show", "under", "below", "beside", "over", "after", "before", "when", "if"}
LAYOUTS = {"layout", "enabled", "disabled", "visible", "invisible", "open", "opened", "closed", "collapsed", "expanded", "template", "theme", "grid"}
TITLES = {"article", "main", "h1"}
#: Elements that hold an article whole, and such as are filled in by a reader.
CLOSED, FIELDS = {"article", "main"}, {"input", "textarea", "select", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status", "tooltip"}


class Node:
    """An element; items are its texts and elements in order."""

    __slots__ = ("tag", "label", "parent", "items", "dropped", "named", "score", "length", "linked", "depth")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool):
        self.tag, self.label, self.parent, self.dropped = tag, label, parent, dropped
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.named, self.score, self.length, self.linked = False, 0.0, 0, 0

    def path(self) -> str:
        out, node = [], self
        while node.parent is not None:
            if node.tag != "html":
                out.append(node.label)
            node = node.parent
        return "/".join(reversed(out))


def words_of(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+", name)]


def is_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element's tag or role says that it isn't the article, or that it isn't shown."""
    return tag in DROPPED or attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true" or "hidden" in attributes


def is_named_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a class or id names a part that isn't the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = words_of(name)
        for i, w in enumerate(words):
            if w in NOT_MAIN and STATES.isdisjoint(words[:i]) and LAYOUTS.isdisjoint(words[i + 1 :]):
                return True
    return False


def drop_named(root: Node) -> None:
    """Drops the elements that a class names as boilerplate, with what is in them, unless one holds nearly all of the page's prose."""
    order = list(walk(root))
    prose: dict[int, int] = {}
    titles: dict[int, int] = {}
    written: dict[int, bool] = {}
    for x in reversed(order):
        inner = [k for k in x.items if not isinstance(k, str) and not k.dropped]
        titles[id(x)] = (x.tag in TITLES) + sum(titles[id(k)] for k in inner)
        written[id(x)] = x.tag in PROSE or any(written[id(k)] for k in inner)
        prose[id(x)] = 0 if x.tag == "a" else sum(len(k.strip()) for k in x.items if isinstance(k, str)) + sum(prose[id(k)] for k in inner)
    total, all_titles = prose[id(root)], titles[id(root)]
    for x in order:
        if x.parent is not None and x.parent.dropped:
            x.dropped = True
        elif x.named:
            n = prose[id(x)]
            alone = all_titles and titles[id(x)] == all_titles or written[id(x)] and total - n <= ALONE_REST * total
            x.dropped = not (alone and n >= MOST_PROSE * total)


def tokens(page: str) -> Iterator[str | re.Match]:
    """Texts and tags in order, in time that grows with the page's length; comments and declarations go."""
    at, n, text, last, pattern = 0, len(page), 0, page.rfind(">"), TAG
    while 0 <= (at := page.find("<", at)) < last:
        start, found = at, None
        if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3].isalpha():
            found = pattern.match(page, at)
            if not found:  # quotes that don't close: from here on they are letters
                pattern = BROKEN
                found = pattern.match(page, at)
            at = found.end() if found else at + 1
            if not found:
                continue
        else:
            end = next((e for begin, e in ENDS if page.startswith(begin, at)), None)
            if end is None:
                at += 1
                continue
            at = page.find(end, at)
            at = n if at < 0 else at + len(end)
        if start > text:
            yield page[text:start]
        text = at
        if found:
            raw = found.group(2).lower()
            if raw in RAW and not found.group(1):
                close = re.compile(f"</{re.escape(raw)}\\b[^>]*>?", re.I).search(page, at)
                text = at = close.end() if close else n
            yield found
    if text < n:
        yield page[text:]


def parse(page: str) -> Node:
    """The element tree; forgiving: unclosed and misnested tags are closed by what follows."""
    root = Node("", "", None, False)
    top, depth, named = root, 0, False
    for found in tokens(page):
        if isinstance(found, str):
            top.items.append(found)
            continue
        tag = found.group(2).lower()
        if found.group(1):
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
                depth = top.depth
            continue
        if tag in BLOCK:
            closes = CLOSES.get(tag)
            node, stop = top, SCOPE - closes if closes else SCOPE
            while node is not root and node.tag not in stop:
                if node.tag == "p" or (closes and node.tag in closes) or (tag in HEADINGS and node.tag in HEADINGS):
                    top = node.parent
                node = node.parent
        depth = top.depth
        rest = found.group(3)
        attributes = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(rest)} if rest else {}
        label = tag
        if "class" in attributes:
            label = ".".join([tag, *sorted(DIGITS.sub("N", c) for c in attributes["class"].split())])
        node = Node(tag, label, top, top.dropped or is_boilerplate(tag, attributes) or bool(rest and HIDDEN_STYLE.search(rest)))
        if tag == "header" and not node.dropped:
            node.dropped = not any(x in ("article", "main") for x in ancestors(node))
        node.named = not node.dropped and is_named_boilerplate(tag, attributes)
        named |= node.named
        top.items.append(node)
        if depth < MOST_DEPTH and tag not in RAW and tag not in VOID and not (rest.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span")):
            top = node
    if named:
        drop_named(root)
    return root


def ancestors(node: Node) -> Iterator[str]:
    while node.parent is not None:
        node = node.parent
        yield node.tag


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def blocks(node: Node) -> list[str]:
    """The node's texts by block, without dropped elements."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            if text := squeeze("".join(held)):
                out.append(text)
            held.clear()

    stack = [iter(node.items)]
    ends = [True]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            if ends.pop():
                end()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag in ("br", "wbr"):
            held.append(" " if item.tag == "br" else "")
        elif item.dropped:
            if item.tag in BLOCK:
                end()
        else:
            if block := item.tag in BLOCK:
                end()
            stack.append(iter(item.items))
            ends.append(block)
    return out


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str) and not x.dropped)


def score(root: Node, links: bool = False) -> list[Node]:
    """Containers with prose, best first; the page itself is one too. A text scores for its nearest container, and a third for the one above;
    text in links scores only if asked for, and in articles."""
    order = list(walk(root))
    for node in order:
        size = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if not size:
            continue
        at, linked = node, False
        while at.parent is not None and at.tag not in CONTAINERS:
            linked |= at.tag == "a"
            at = at.parent
        if linked and links and (at.tag in CLOSED or not CLOSED.isdisjoint(ancestors(at))):
            linked = False
        at.length += size
        if linked:
            at.linked += size
            continue
        in_text = node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "li", "b", "i", "em", "strong", "span", "dd", "td") or node is at
        at.score += size if in_text else size / 2
    held = [x for x in order if x.tag in CONTAINERS or x is root]
    found = [x for x in held if x.score]
    for x in found:
        x.score *= 1 - x.linked / max(1, x.length)
    gains = [(x.parent, x.score / 3) for x in found if x is not root]
    for above, gain in gains:
        while above.parent is not None and above.tag not in CONTAINERS:
            above = above.parent
        if above is not root:
            above.score += gain
    best = sorted((x for x in held if x.score > 0), key=lambda x: -x.score)
    if best or links:
        return best
    for x in order:
        x.score, x.length, x.linked = 0.0, 0, 0
    return score(root, True)


def prose_of(root: Node) -> dict[int, int]:
    """By element, the characters of prose in it, without links. Needs score()."""
    prose: dict[int, int] = {}
    for x in reversed(list(walk(root))):
        prose[id(x)] = x.length - x.linked + sum(prose[id(k)] for k in x.items if not isinstance(k, str) and not k.dropped)
    return prose


def candidates(page: str) -> list[tuple[str, float]]:
    """(path, share of the page's score) of all containers with prose; the body alone, where the article is spread over it."""
    root = parse(page)
    found = score(root)
    if found and (spread := outer(root, found[:1])[1]) is not None:
        return [(spread.path(), 1.0)]
    total = sum(x.score for x in found)
    shares: dict[str, float] = {}
    for x in found:
        path = x.path()
        shares[path] = shares.get(path, 0.0) + x.score / total
    return sorted(shares.items())


def outer(root: Node, chosen: list[Node]) -> tuple[list[Node], Node | None]:
    """The elements to extract, in page order: the chosen ones, or in their place the containers that hold the rest of their article; and the
    body, or the page, if it holds a part of the article too. Needs score()."""
    wanted, prose = set(map(id, chosen)), prose_of(root)
    held: dict[int, tuple[int, int, bool]] = {}  # prose and number of wanted elements within, and whether they are in an article
    order = list(walk(root))
    spread = None
    for x in reversed(order):
        inner = [k for k in x.items if not isinstance(k, str) and not k.dropped]
        parts = [held[id(k)] for k in inner if id(k) in held]
        size, taken, n, closed = prose[id(x)], sum(p[0] for p in parts), sum(p[1] for p in parts), any(p[2] for p in parts)
        if n and not closed and x.tag in CONTAINERS and x.tag != "body" and size > taken:
            wanted.add(id(x))
        if n and not closed and (x.tag == "body" or x is root) and (size > taken or n > 1) and id(x) not in wanted and len(article_parts(x, prose, wanted)) > n:
            spread = x
        if id(x) in wanted:
            taken, n = size, 1
        if n:
            held[id(x)] = taken, n, closed or x.tag in CLOSED or x is spread
    found = []
    for x in order:  # page order, outermost first
        if id(x) in wanted:
            above = x.parent
            while above is not None and id(above) not in wanted:
                above = above.parent
            if above is None:
                found.append(x)
    return found, spread


def article_parts(body: Node, prose: dict[int, int], wanted: set[int] | None = None) -> list:
    """What of the body's texts and elements belongs to the article: the elements that hold what is wanted, what stands in no container, and containers
    with a real share of prose; link lists and what holds form fields don't. Without ``wanted``, the largest element is."""
    inner = [k for k in body.items if not isinstance(k, str) and not k.dropped]
    if wanted is None:
        wanted = {id(max(inner, key=lambda k: prose[id(k)]))} if inner else set()
    within = {id(k): list(walk(k)) for k in inner}
    main = {id(k) for k in inner if any(id(x) in wanted for x in within[id(k)])}
    least = OTHER_SHARE * sum(prose[i] for i in main)

    def belongs(k: Node) -> bool:
        if id(k) in main:
            return True
        texts = [x for x in within[id(k)] if any(isinstance(t, str) and t.strip() for t in x.items)]
        linked = [x for x in texts if x.tag == "a" or "a" in ancestors(x)]
        if not texts or 2 * len(linked) > len(texts) or any(x.tag in FIELDS for x in within[id(k)]):
            return False
        return prose[id(k)] >= max(1, least) if any(x.tag in CONTAINERS for x in within[id(k)]) else True

    return [k for k in body.items if isinstance(k, str) and k.strip() or not isinstance(k, str) and not k.dropped and belongs(k)]


def spread_text(body: Node, prose: dict[int, int], wanted: set[int] | None = None) -> list[str]:
    """The blocks of an article that is spread over the body."""
    parts, own = {id(k) for k in article_parts(body, prose, wanted) if not isinstance(k, str)}, Node(body.tag, body.label, None, False)
    own.items = [k for k in body.items if isinstance(k, str) or id(k) in parts or k.tag in ("br", "wbr", "hr") or k.dropped]
    return blocks(own)


def extract(page: str, path: str | None) -> str:
    """The text of the article around the elements at ``path``, or around the page's own best container."""
    root = parse(page)
    found = score(root)
    if not found:
        return ""
    chosen = [x for x in found if path is not None and x.label == path.rsplit("/", 1)[-1] and x.path() == path]
    if sum(x.score for x in chosen) < LEAST_SHARE * found[0].score:
        chosen, path = found[:1], None
    if len(chosen) == 1 and (chosen[0].tag == "body" or chosen[0] is root):
        return "\n".join(spread_text(chosen[0], prose_of(root)))
    elements, spread = outer(root, chosen)
    if path is None and spread is not None:
        return "\n".join(spread_text(spread, prose_of(root), set(map(id, elements))))
    return "\n".join(b for x in elements for b in blocks(x))


def host_of(url) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def vote(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of each host."""
    small_batches(pages.sparkSession)
    source = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, p, s) for h, page in zip(batch["host"], batch["html"], strict=True) for p, s in candidates(page or "")]
            yield pd.DataFrame(rows, columns=["host", "path", "share"]).groupby(["host", "path"], as_index=False)["share"].sum()

    votes = source.mapInPandas(run, "host string, path string, share double")
    votes = votes.groupBy("host", "path").agg(F.sum(F.round("share", 6)).alias("votes"))
    best = F.min_by("path", F.struct(-F.round("votes", 3), F.col("path")))
    return votes.groupBy("host").agg(best.alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    winners = materialize(vote(pages, url_col, html_col), "winners")
    hosts, size = winners.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("host")), F.lit(0))).first()
    source = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    if hosts <= BROADCAST_HOSTS and size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(winners), "host", "left")
    else:
        salts = partitions(pages.sparkSession)  # one host may hold most pages
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64(id_col, "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    source = joined.select(id_col, "url", "html", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [extract(page or "", path if isinstance(path, str) else None) for page, path in zip(batch["html"], batch["path"], strict=True)]
            yield batch[[id_col, "url", "text"]]

    kinds = dict(pages.dtypes)
    return source.mapInPandas(run, f"`{id_col}` {kinds[id_col]}, url {kinds[url_col]}, text string")
