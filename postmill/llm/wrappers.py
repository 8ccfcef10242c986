"""HTML extraction by wrappers inferred from the pages of a host.

A page becomes a tree of block elements with text slots.  Consecutive siblings
(or groups of up to three) with the same labels are one repeated group.  The
trees of a host are aligned with each other: equal labels are merged, what one
side lacks becomes optional, texts become slots that remember whether they ever
differ.  The result is a union-free regular expression over tags, the host's
wrapper.  Equal skeletons are counted before they are aligned, and a host's
skeletons are aligned in two steps, so a frequent host is no bottleneck.

A slot is main text by where it stands in the wrapper and by whether it varies.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.hosts import host_of
from postmill.session import written

BLOCKS = frozenset(
    "html body article main section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary hr menu dialog head center option".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg select button object xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are never article text wherever they stand; a header is, unless it belongs to an article.
OUTSIDE = frozenset("head nav footer aside form menu dialog".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu sidebar side footer ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "reply replies respond discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar "
    "masthead skip search complementary contentinfo topbar copyright".split()
)
#: Marks that are also topics: in an id, or on a section or paragraph, they name what the text is about.
TOPICS = frozenset("side discussion search notice notices alert promotion advertising subscription copyright".split())
#: Words that say where or in what form a marked element stands; a name of marks and these is a mark too.
PLACES = frozenset("box bar list area wrapper wrap container block slot links link buttons button icons site page top bottom left right primary secondary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks of an article element that is not the page's own.
OTHERS = frozenset("comment comments ad ads advert related promo".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z]+")
TEXT, LINK = "#", "#a"
#: Distinct pages on which a slot without other texts is a template's; copies of a page count once.
PAGES = 3
#: An element closed by another one that begins in the same parent.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}


class Node:
    """An element: label, children (elements, or [slot label, text])."""

    __slots__ = ("label", "tag", "kids")

    def __init__(self, label: str, tag: str):
        self.label, self.tag, self.kids = label, tag, []


def _marked(name: str, marks: frozenset) -> bool:
    """Whether a class or id as a whole is a mark; ``with-sidebar`` and ``side-effects`` are none."""
    words = [w for w in _SPLIT.split(name) if w]
    return any(w in marks for w in words) and all(w in marks or w in PLACES for w in words)


def _label(tag: str, attributes: str) -> str:
    """Tag, with ``!`` if class, id or role mark it as no article text, ``!!`` if it is hidden, ``*`` if it is main text."""
    if not attributes or not attributes.strip():
        return tag
    if _HIDDEN.search(attributes):
        return tag + "!!"
    mark = ""
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind == "role" and value.strip() == "main":
            return tag + "*"
        if tag in HEADINGS or tag in ("html", "body", "main"):
            continue
        marks = OTHERS if tag == "article" else MARKS - TOPICS if kind == "id" or kind == "class" and tag in ("section", "p") else MARKS
        if any(_marked(name, marks) for name in value.split()):
            mark = "!"
    return tag + mark


def parse(page: str | None) -> Node:
    """Block tree of a page; broken markup is read as browsers do in the usual cases."""
    root = Node("", "")
    stack = [root]
    text: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        joined = " ".join(html.unescape("".join(t for t, _ in text)).split()) if text else ""
        if joined:
            linked = all(inside or not t.strip() for t, inside in text)
            stack[-1].kids.append([LINK if linked else TEXT, joined])
        text.clear()

    page = page or ""
    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                text.append((page[at:], links > 0))
            break
        if m.start() > at:
            text.append((page[at : m.start()], links > 0))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        links = 0
                        break
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            text.append((" ", True))
        elif tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        elif tag in BLOCKS:
            flush()
            if stack[-1].tag == "p":
                stack.pop()
            if tag in _CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _SCOPE[tag]:
                        break
                    if stack[k].tag in _CLOSED_BY[tag]:
                        del stack[k:]
                        break
            if tag == "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        del stack[k:]
                        break
            if tag not in VOID:
                node = Node(_label(tag, m[3]), tag)
                stack[-1].kids.append(node)
                stack.append(node)
    flush()
    return root


# A wrapper element is [label, flags, children] with flags "?" (optional) and "+" (repeated);
# a slot is [label, flags, [smallest text hash, largest text hash, hashes of up to PAGES distinct pages]].


def skeleton(node: Node) -> list:
    """The page as a wrapper of its own, without texts; slots are numbered in page order by ``None``."""
    kids = [[k[0], "", None] if isinstance(k, list) else skeleton(k) for k in node.kids]
    return [node.label, "", folded(kids)]


def folded(kids: list) -> list:
    """Tandem repeats of one to three siblings with equal labels become one repeated copy."""
    for width in (1, 2, 3):
        out: list = []
        at = 0
        while at < len(kids):
            group = kids[at : at + width]
            labels = [k[0] for k in group]
            at += len(group)
            if len(group) == width:
                again = False
                while [k[0] for k in kids[at : at + width]] == labels:
                    group = [_merge(a, b) for a, b in zip(group, kids[at : at + width])]
                    at += width
                    again = True
                if again:
                    group = [[g[0], _flags(g[1], "+"), g[2]] for g in group]
                elif width > 1:
                    at -= width - 1
                    group = group[:1]
            out += group
        kids = out
    return kids


def _flags(a: str, b: str) -> str:
    return "".join(sorted(set(a + b)))


def _merge(a: list, b: list) -> list:
    """Two wrappers of one label as one."""
    flags = _flags(a[1], b[1])
    if a[0] in (TEXT, LINK):
        if a[2] is None or b[2] is None:
            return [a[0], flags, a[2] or b[2]]
        return [a[0], flags, [min(a[2][0], b[2][0]), max(a[2][1], b[2][1]), sorted({*a[2][2], *b[2][2]})[:PAGES]]]
    return [a[0], flags, aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Two sibling lists as one: equal labels in order are merged, the others become optional."""
    if [k[0] for k in a] == [k[0] for k in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], _flags(a[i][1], "?"), a[i][2]])
            i += 1
        else:
            out.append([b[j][0], _flags(b[j][1], "?"), b[j][2]])
            j += 1
    return folded(out)


def _labels(kids: list) -> set[str]:
    return {k[0] if isinstance(k, list) else k.label for k in kids}


def _place(kid: Node | list, kids: list, at: int) -> int | None:
    """Where a page's element or text belongs among a wrapper's children, the last one having been at ``at``.

    Of several children of its label an element goes to the one that knows most
    of what it holds; then the next one counts, then the first one: a repeated
    group begins anew.
    """
    label = kid[0] if isinstance(kid, list) else kid.label
    fit = [k for k in range(len(kids)) if kids[k][0] == label]
    if len(fit) > 1 and not isinstance(kid, list):
        held = _labels(kid.kids)
        known = {k: len(held & _labels(kids[k][2])) for k in fit}
        fit = [k for k in fit if known[k] == max(known.values())]
    return next((k for k in fit if k >= at), fit[0] if fit else None)


def located(node: Node, wrapper: list | None, outside: int = 0, main: int = 0, out: list | None = None) -> list[tuple[list | None, str, int]]:
    """(wrapper slot, text, decision by position alone) of every text of a page, in page order.

    Every text comes back: one that the wrapper has no place for has no slot.
    """
    out = [] if out is None else out
    at = 0
    for kid in node.kids:
        here = None if wrapper is None else _place(kid, wrapper[2], at)
        at = at if here is None else here
        inner = None if here is None else wrapper[2][here]
        if isinstance(kid, list):
            out.append((inner, kid[1], _by_place(kid[0] == LINK, outside, main)))
        else:
            located(kid, inner, *_inside(kid.label, outside, main), out)
    return out


#: Decisions on slots: article text; other text that varies, or an article in a marked box; and all else.
MAIN, LOOSE, NEVER = 2, 1, 0
#: What leaves an element out: nothing, a mark (up to the next article or main element), its tag or being hidden.
IN, MARKED, OUT = 0, 1, 2


def _inside(label: str, outside: int, main: int) -> tuple[int, int]:
    """What leaves out the children of an element, and the decision on article text there, if it is any."""
    tag = label.rstrip("!*")
    article = (tag in ("article", "main") or label.endswith("*")) and not label.endswith("!")
    off = max(outside, OUT if label.endswith("!!") or tag in OUTSIDE or tag == "header" and not main else MARKED if label.endswith("!") else IN)
    main = (LOOSE if off == MARKED else main or MAIN) if article else main
    return IN if article and off == MARKED else off, main


def _by_place(template: bool, outside: int, main: int) -> int:
    return NEVER if outside else main if main else NEVER if template else LOOSE


def decide(wrapper: list, outside: int = IN, main: int = NEVER, found: dict | None = None) -> dict[int, int]:
    """Decision on every slot of a wrapper, by the identity of the slot; ``main`` is that of article text here, if it is any."""
    found = {} if found is None else found
    for kid in wrapper[2]:
        if kid[0] in (TEXT, LINK):
            low, high, pages = kid[2] or (0, 1, ())
            found[id(kid)] = _by_place(len(pages) >= PAGES and low == high or kid[0] == LINK, outside, main)
        else:
            decide(kid, *_inside(kid[0], outside, main), found)
    return found


def _slots(wrapper: list) -> Iterator[list]:
    for kid in wrapper[2]:
        if kid[0] in (TEXT, LINK):
            yield kid
        else:
            yield from _slots(kid)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def infer(pages: DataFrame, partial_groups: int = 16) -> DataFrame:
    """``host, wrapper`` (JSON) from pages ``host, html``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, dict[int, list]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            keys = [(host, shape, slot, *found) for (host, shape), slots in by.items() for slot, found in slots.items()]
            cols = list(zip(*keys)) if keys else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "shape", "slot", "low", "high", "pages"])

        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                tree = parse(page)
                shape = skeleton(tree)
                order = {id(s): i for i, s in enumerate(_slots(shape))}
                text, whole = json.dumps(shape), _hash(page)
                slots = by.setdefault((host, text), {})
                for slot, words, _ in located(tree, shape) or [(None, "", NEVER)]:
                    at, h = order[id(slot)] if slot else -1, _hash(words)
                    known = slots.get(at)
                    if known is None:
                        slots[at] = [h, h, [whole]]
                        size += len(text) + 200
                        continue
                    known[0], known[1] = min(known[0], h), max(known[1], h)
                    if whole not in known[2]:
                        known[2] = sorted([*known[2], whole])[:PAGES]
                if size > 16_000_000:
                    yield rows()
                    by.clear()
                    size = 0
        yield rows()

    slots = pages.mapInArrow(read, "host string, shape string, slot int, low long, high long, pages array<long>")
    some = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))), 1, PAGES)
    counted = slots.groupBy("host", "shape", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), some.alias("pages"))
    shapes = counted.groupBy("host", "shape").agg(F.collect_list(F.struct("slot", "low", "high", "pages")).alias("slots"))

    def filled(shape: str, slots) -> list:
        wrapper = json.loads(shape)
        by = {s["slot"]: s for s in slots}
        for i, slot in enumerate(_slots(wrapper)):
            s = by.get(i)
            slot[2] = [int(s["low"]), int(s["high"]), [int(x) for x in s["pages"]]] if s else None
        return wrapper

    def first(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for shape, slots in sorted(zip(group["shape"], group["slots"]), key=lambda x: x[0]):
            one = filled(shape, slots)
            wrapper = one if wrapper is None else _merge(wrapper, one)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    def second(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for text in sorted(group["wrapper"]):
            one = json.loads(text)
            wrapper = one if wrapper is None else _merge(wrapper, one)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    part = F.pmod(F.xxhash64("shape"), F.lit(partial_groups))
    partial = shapes.withColumn("part", part).groupBy("host", "part").applyInPandas(first, "host string, wrapper string")
    return written(partial.groupBy("host").applyInPandas(second, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text``: the article of each page, blocks joined by newlines.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments are left out.  If the page has an article or main element with
    text, only that counts; otherwise such elements in a box marked as something
    else, and all other slots that vary among the host's pages.  White space in a block is one space; character references
    are decoded.

    Null or empty html gives an empty text.  Pages without a host share one
    wrapper.  Repeated rows each get a row.  An empty table gives an empty
    result; further columns are ignored.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    wrappers = infer(pages.select("host", "html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, text in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                if text not in known:
                    if len(known) > 2000:
                        known.clear()
                    wrapper = json.loads(text)
                    known[text] = wrapper, decide(wrapper)
                wrapper, decision = known[text]
                found = [(decision[id(slot)] if slot else place, words) for slot, words, place in located(parse(page), wrapper)]
                level = MAIN if any(d == MAIN for d, _ in found) else LOOSE
                texts.append("\n".join(words for d, words in found if d == level))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = pages.schema["id"].dataType.simpleString()
    out = pages.join(wrappers, "host").select("id", "url", "html", "wrapper").mapInArrow(read, f"id {kind}, url string, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
