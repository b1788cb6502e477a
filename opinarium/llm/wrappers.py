"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of block elements whose leaves are text slots. Sibling
groups that repeat are folded into repeated groups; the trees of a host's
pages are then aligned one after another: what only some pages have becomes
optional, text that differs becomes a slot. The result is a union-free
regular expression over tokens, the host's wrapper. Alignment is associative
enough to run in each partition first, so what is gathered for a host is one
small wrapper for each partition, however many pages it has.

The wrapper says where the article is: all articles and main elements whose
text isn't mostly links, or else all elements named like one, or else the
region with the most text of its own. Pages give the text of their blocks
there, without the elements that menus, headers, footers, sidebars, notices,
adverts, forms and comments are made of. Of names that articles' own sections
may have, too, those within an article count only for what is mostly links. A
text is the template's, and left out, if nearly all of the host's pages that
have the region share it at the region's edge, before or after all texts that
differ; in a region that is an article by its name it must also read like a
footer. That takes two pages that differ, and no other number matters: of
siblings, of pages, or of characters. A page that lacks its host's region is
judged by its own tree.

Null html counts as empty; a page without such blocks has an empty text;
null URLs, and such without a host, share the wrapper of the empty host;
repeated rows get equal results; an empty table gives an empty table; columns
of df named like a result column are replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, importable, slices, written
from .urls import host_of

# Kinds of elements, and the names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title xmp iframe noembed noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NOT_ARTICLE = frozenset("nav footer aside form script style noscript template svg math select button dialog menu iframe object canvas audio video head fieldset".split())
NOT_ARTICLE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer footnav copyright sidebar aside widget rail notice notices cookie cookies consent gdpr alert popup modal overlay banner toast newsletter subscribe subscription paywall "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion form search login signup comment comments commentlist discussion replies reply disqus share sharing social related recommended skip pagination pager toolbar masthead feedback responses".split()
)
# Those of them that sections of an article have as well.
WEAK_NAMES = frozenset("menu widget rail notice notices alert banner promotion form search discussion social responses feedback skip".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE_NAMES = frozenset("article articlebody content post entry story main text".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY_NEXT = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FOOTER = re.compile(r"\W*(©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)

#: The share of a region's pages that have a template's text.
TEMPLATE_SHARE = 0.9
#: Siblings in a wrapper beyond which those of one label are taken together. Regions are sought by label, and template texts only in elements whose label no
#: sibling has, so this changes neither.
SIBLINGS = 64
#: Levels that a wrapper tells apart; what lies deeper counts to the last of them, but is judged by all elements around it.
LEVELS = 200


def _label(tag: str, attributes: str, within: bool) -> tuple[str, bool, bool, bool]:
    """The element's label, whether it is no part of an article, whether it is none if it is mostly links, and whether it is named like one."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes and len(attributes) > 3 else {}
    names = {x.lower() for k in ("class", "id") for x in NAME.findall(found.get(k, ""))}
    telling = names & NOT_ARTICLE_NAMES
    weak = within and bool(telling) and telling <= WEAK_NAMES
    out = tag in NOT_ARTICLE or (tag == "header" and not within) or (bool(telling) and not weak) or found.get("role", "").lower() in NOT_ARTICLE_ROLES
    if {"header", "head"} & names and not within and tag not in ("body", "html", "main", "article") and not re.fullmatch("h[1-6]", tag):
        out = True
    if tag in ("html", "body") or (tag in ("article", "main") and not names & {"comment", "comments", "ad", "ads", "related", "reply", "replies", "promo", "sponsored"}):
        out = False
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        out = True
    main = tag in ("article", "main") or found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower()
    return tag + "".join(sorted(f".{n}" for n in names)), out, weak, main or (tag in ("div", "section", "td") and bool(names & ARTICLE_NAMES))


class Block:
    __slots__ = ("path", "text", "linked", "out")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, out: bool):
        self.path, self.text, self.linked, self.out = path, text, linked, out


def blocks(html: str) -> tuple[list[Block], dict[tuple[str, ...], int]]:
    """Blocks with text in page order, and the paths of elements named like articles with their rank (0: article or main)."""
    stack: list[tuple[str, tuple[str, ...], bool, bool, bool]] = [("", (), False, False, False)]  # tag, path, out, out if mostly links, within an article
    found: list[Block] = []
    named: dict[tuple[str, ...], int] = {}
    parts: list[str] = []
    links = linked = 0  # open links, characters in them
    open_: dict[str, int] = {}  # how often each tag is on the stack

    def close(i: int) -> None:
        for tag, *_ in stack[i:]:
            open_[tag] -= 1
        del stack[i:]

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                _, path, out, weak, _ = stack[-1]
                found.append(Block(path, text, min(linked, len(text)), out or (weak and 2 * linked > len(text))))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(html):
        tag, text = m[3], m[5]
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif open_.get(tag):
                flush()
                links = 0
                close(max(i for i in range(len(stack)) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in INLINE or (tag in VOID and tag != "hr"):
            pass
        else:
            flush()
            if tag in CLOSES_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if any(map(open_.get, PEERS.get(tag, (tag,)))) and tag in CLOSED_BY_NEXT:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in PEERS.get(tag, (tag,)):
                        close(i)
                        break
                    if stack[i][0] in CLOSED_BY_NEXT[tag]:
                        break
            if tag == "hr" or (m[4] or "").rstrip().endswith("/") and tag not in CLOSES_P:
                continue
            links = 0
            _, path, out, weak, within = stack[-1]
            label, no, weaker, main = _label(tag, m[4], within)
            deeper = len(path) < LEVELS
            path += (label,) if deeper else ()
            if main and deeper and not (out or no) and path not in named:
                named[path] = 0 if tag in ("article", "main") or "main" in (m[4] or "").lower() or "articlebody" in (m[4] or "").lower() else 1
            stack.append((tag, path, out or no, weak or weaker, within or (main and tag in ("article", "main"))))
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return found, named


# --- wrappers: [label, optional, repeated, pages, chars, linked, text, rank, out, children] ---

LABEL, OPTIONAL, REPEATED, PAGES, CHARS, LINKED, TEXT, RANK, OUT, CHILDREN = range(10)
SLOT = "#"


def tree(html: str) -> list:
    """The page's wrapper: its own tokens, with repeats folded."""
    found, named = blocks(html)
    root = ["", False, False, 1, 0, 0, None, -1, False, []]
    open_ = [root]
    for b in found:
        depth = 0
        while depth < len(b.path) and depth + 1 < len(open_) and open_[depth + 1][LABEL] == b.path[depth]:
            depth += 1
        # Leaves don't share an element: blocks of equal paths come from siblings.
        if depth == len(b.path) and depth:
            depth -= 1
        del open_[depth + 1 :]
        for i in range(depth, len(b.path)):
            node = [b.path[i], False, False, 1, 0, 0, None, named.get(b.path[: i + 1], -1), b.out if i == len(b.path) - 1 else False, []]
            open_[-1][CHILDREN].append(node)
            open_.append(node)
        open_[-1][CHILDREN].append([SLOT, False, False, 1, len(b.text), b.linked, b.text, -1, b.out, []])
    return fold(root)


def fold(node: list) -> list:
    """Repeats among the children (of up to four siblings in a row) become repeated ones."""
    children = [fold(c) for c in node[CHILDREN]]
    for period in (1, 2, 3, 4):
        out: list = []
        i = 0
        while i < len(children):
            labels = [c[LABEL] for c in children[i : i + period]]
            j = i + period
            while len(labels) == period and [c[LABEL] for c in children[j : j + period]] == labels:
                j += period
            if j > i + period and (period == 1 or len(set(labels)) > 1):
                for k in range(period):
                    first = children[i + k]
                    for other in children[i + k + period : j : period]:
                        first = merged(first, other, again=True)
                    first[REPEATED] = True
                    out.append(first)
                i = j
            else:
                out.append(children[i])
                i += 1
        children = out
    node[CHILDREN] = few(children)
    return node


def few(children: list) -> list:
    """Of very many siblings those of one label become one repeat, so that wrappers stay small."""
    if len(children) <= SIBLINGS:
        return children
    out: dict[str, list] = {}
    for c in children:
        if c[LABEL] in out:
            out[c[LABEL]] = merged(out[c[LABEL]], c, again=True)
            out[c[LABEL]][REPEATED] = True
        else:
            out[c[LABEL]] = c
    return list(out.values())


def merged(a: list, b: list, again: bool = False) -> list:
    """The alignment of two wrappers of one label. again: both are parts of one page."""
    same = a[TEXT] is not None and a[TEXT] == b[TEXT] and not again
    return [
        a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], max(a[PAGES], b[PAGES]) if again else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED],
        a[TEXT] if same else None, max(a[RANK], b[RANK]) if min(a[RANK], b[RANK]) < 0 else min(a[RANK], b[RANK]), a[OUT] and b[OUT], aligned(a[CHILDREN], b[CHILDREN], again),
    ]


def aligned(a: list, b: list, again: bool = False) -> list:
    x, y = [n[LABEL] for n in a], [n[LABEL] for n in b]
    if x == y:
        return [merged(p, q, again) for p, q in zip(a, b)]
    out = []
    optional = lambda nodes: [[n[LABEL], True, *n[2:]] for n in nodes]
    for what, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if what == "equal":
            out += [merged(p, q, again) for p, q in zip(a[i:j], b[k:m])]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    # A mismatch that an iteration resolves: neighbours of one label are a repeat.
    folded: list = []
    for n in out:
        if folded and folded[-1][LABEL] == n[LABEL]:
            folded[-1] = merged(folded[-1], n, again=True)
            folded[-1][REPEATED] = True
        else:
            folded.append(n)
    return few(folded)


def expression(node: list) -> str:
    """The wrapper as a regular expression over tokens."""
    inner = "".join(map(expression, node[CHILDREN]))
    body = (json.dumps(node[TEXT], ensure_ascii=False) if node[TEXT] is not None else SLOT) if node[LABEL] == SLOT else f"<{node[LABEL]}>{inner}</{node[LABEL]}>" if node[LABEL] else inner
    return f"({body})+" if node[REPEATED] else f"({body})?" if node[OPTIONAL] else body


class Slot:
    __slots__ = ("path", "node", "once", "inside")

    def __init__(self, path: tuple[str, ...], node: list, once: bool, inside: list[tuple[str, ...]]):
        self.path, self.node, self.once, self.inside = path, node, once, inside


def edges(slots: list[Slot], pages: int, named: bool) -> list[list]:
    """[path, text] of the template's texts at the edges of a region that so many pages have, of its slots in page order."""
    if not any(s.node[TEXT] is None and s.node[PAGES] > 1 for s in slots):
        return []  # one page, or copies of one

    def shared(s: Slot) -> bool:
        told = s.once and s.node[TEXT] is not None and s.node[PAGES] >= max(2, TEMPLATE_SHARE * pages) and not re.match(r"h[1-6]\b", s.path[-1] if s.path else "")
        return told and (not named or FOOTER.match(s.node[TEXT]) is not None)

    out = []
    for run in (slots, slots[::-1]):
        for s in run:
            if not shared(s):
                break
            out.append([list(s.path), s.node[TEXT]])
    return out


def region(wrapper: list) -> tuple[list[list[str]], list[list], list[list[str]]]:
    """The paths of the article, [path, text] of the template's texts in it, and the paths at which links are menus."""
    regions: dict[tuple[str, ...], list] = {}  # rank, characters, those of links, pages
    slots: list[Slot] = []

    def walk(node: list, path: tuple[str, ...], inside: list[tuple[str, ...]], once: bool) -> None:
        count = Counter(c[LABEL] for c in node[CHILDREN])
        for child in node[CHILDREN]:
            alone = once and count[child[LABEL]] == 1 and not child[REPEATED]
            if child[LABEL] == SLOT:
                if not child[OUT]:
                    slots.append(Slot(path, child, alone, inside))
                    for p in inside:
                        regions[p][1] += child[CHARS]
                        regions[p][2] += child[LINKED]
            else:
                at = path + (child[LABEL],)
                here = inside
                if child[RANK] >= 0:
                    regions.setdefault(at, [child[RANK], 0, 0, 0])[3] += child[PAGES]
                    here = inside + [at]
                walk(child, at, here, alone)

    walk(wrapper, (), [], True)
    for rank in (0, 1):
        told = {p: r for p, r in regions.items() if r[0] == rank and r[1] > r[2]}
        told = {p: r for p, r in told.items() if r[1] >= 2 * r[2]} or told
        if told:
            outer = {p: r for p, r in told.items() if not any(p[:n] in told for n in range(len(p)))}
            return [list(p) for p in told], [t for p, r in outer.items() for t in edges([s for s in slots if p in s.inside], r[3], True)], []
    # No element is named like an article: the one whose own blocks have the most text. What is mostly links on the host's pages is a menu.
    own: dict[tuple[str, ...], int] = {}
    menus: list[list[str]] = []

    def text_of(node: list, path: tuple[str, ...]) -> None:
        for child in node[CHILDREN]:
            if child[LABEL] == SLOT:
                if 2 * child[LINKED] > child[CHARS]:
                    menus.append(list(path))
                elif not child[OUT]:
                    holder = path[:-1] if path and re.match(r"(p|h[1-6]|li|ul|ol|blockquote|pre|td|tr|table|tbody|dd|dt|dl)\b", path[-1]) else path
                    own[holder] = own.get(holder, 0) + child[CHARS] - child[LINKED]
            else:
                text_of(child, path + (child[LABEL],))

    text_of(wrapper, ())
    if not own:
        return [], [], menus
    best = max(own, key=lambda p: (own[p], -len(p)))
    links = set(map(tuple, menus))
    return [list(best)], edges([s for s in slots if s.path[: len(best)] == best and s.path not in links], wrapper[PAGES], False), menus


def extracted(html: str, regions: list[list[str]], template: list[list], menus: Sequence[list[str]] = ()) -> str:
    """The text of the blocks in the regions; where there are none, by the page's own regions."""
    found, _ = blocks(html)
    drop = {(tuple(p), t) for p, t in template}

    def within(where: list[list[str]], menus: Sequence[list[str]]) -> list[str]:
        paths, links = [tuple(p) for p in where], set(map(tuple, menus))
        return [b.text for b in found if not b.out and any(b.path[: len(p)] == p for p in paths) and (b.path, b.text) not in drop and not (2 * b.linked > len(b.text) and b.path in links)]

    out = within(regions, menus)
    if not out:
        where, _, menus = region(tree(html))
        out = within(where, menus)
    return "\n".join(out)


def _inferred(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one for each host in each partition, then one for each host."""
    importable(pages.sparkSession)
    made = "host string, wrapper string"

    def told(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w, ensure_ascii=False) for w in held.values()], pa.string())], names=["host", "wrapper"])

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = tree(html or "")
                    held[host] = merged(held[host], page) if host in held else page
                if len(held) > 2000:
                    yield told(held)
                    held = {}
        yield told(held)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, None
        for batch in batches:
            for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                other = json.loads(text)
                if name != host:
                    if wrapper is not None:
                        yield told({host: wrapper})
                    host, wrapper = name, other
                else:
                    wrapper = merged(wrapper, other)
        if wrapper is not None:
            yield told({host: wrapper})

    return pages.mapInArrow(infer, made).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join, made)


#: Hosts' regions up to this size are broadcast; beyond it pages are joined by host.
BROADCAST_BYTES = 8 << 20


def wrappers(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) of all hosts in df."""
    return _inferred(df.select(host_of(url).alias("host"), F.col(html).alias("html")))


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """df with text, the main text of html, in place of html."""
    found = T.StructType([T.StructField("region", T.StringType())])
    regions = add_columns(wrappers(df, url, html), found, lambda texts: [[json.dumps(region(json.loads(t))) for t in texts]], ["wrapper"]).drop("wrapper")
    regions = written(regions.withColumnsRenamed({"host": "_host", "region": "_region"}), "regions")
    size = regions.agg(F.coalesce(F.sum(F.length("_region") + F.length("_host")), F.lit(0)), F.count("*")).first()
    if size[0] + 64 * size[1] <= BROADCAST_BYTES:
        regions = F.broadcast(regions)
    pages = df.withColumn("_host", host_of(url)).join(regions, "_host", "left")

    def make(texts, told):
        return [[extracted(t or "", *json.loads(r or "[[], [], []]")) for t, r in zip(texts, told)]]

    return add_columns(pages, T.StructType([T.StructField("text", T.StringType())]), make, [html, "_region"], sliced=html).select(*(c for c in df.columns if c not in (html, "text")), "text")
