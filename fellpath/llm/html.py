"""Main text of web pages through wrappers: union-free regular expressions over the token streams of a host's pages.

A page is a stream of tags and texts. Every open element has a *position*: the chain of labels (tag, classes, role) from the root
down to it. The streams of one host are aligned position by position, page after page, and each mismatch is resolved as in a
union-free expression:

* a label that a parent has on some pages only becomes optional, one that comes several times under a parent becomes repeated,
  and repeated labels that stand among each other become one repeated group;
* a text that is the same on ``SHARE`` of a host's pages stays template, however its siblings fold; any other text is a slot.

The wrapper, such as ``body(div(ul(li(#)+)) div(h1(#) p(#)+) p("))``, decides what is main text once ``TEMPLATE`` different
pages of a host were aligned (copies count once: a page is known by the first heading in its main part, else by its text):

* template texts go, inside an article as well (if the host has slots at all);
* repeated positions that all pages have and that are mostly links are menus and go;
* where pages mark no ``article`` or ``main``, the main part is the deepest single container with more than half of the slots'
  text; of what stands outside only headings before it stay;
* a weak class word (``related``, ``legal``, ...) inside an article counts only for positions that all pages have.

A main part inside an element that is boilerplate by its class words only (``no-sidebar``) counts where a page has no other.

Names decide only what no alignment can: the elements of the page's frame (nav, footer, form, ...), telling class words
(ads and reader comments differ from page to page as articles do), and ``article`` and ``main`` themselves.

Alignment keeps nothing but sums, maxima and counts for each position and text, so that it does not matter in which order or
partition pages come: Spark adds them up (a hot host is summed where it lies). Decisions of a host are made from the
positions that a tenth of its pages have, which are no more than ten pages' worth, in one small group for each host.
Parsing takes time in proportion to the page; nothing recurses.

Defined results: null html has the text ''; a page whose url is null or has no host shares the host ''; broken markup is read
leniently (open elements end with their parent, an unclosed script runs to the end); ``br`` is white space; a ``header`` inside an
article gives its headings only. Columns of pages keep their names; a column ``text`` is replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small_batches, written
from .urls import url_host

#: Elements by their role in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "xmp", "noembed", "noframes", "template", "svg", "math"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILERPLATE_TAGS = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "search", "select", "option", "optgroup"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "skip", "pagination", "pager", "login", "toolbar"}
#: Words that say boilerplate outside an article, and inside only together with the wrapper or with links.
WEAK_WORDS = {"notice", "notices", "share", "sharing", "social", "related", "recommended", "copyright", "legal", "disclaimer"}
HEADER_WORDS = {"header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What ends an open element implicitly, up to which parent.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Different pages of a host that must be aligned before its wrapper decides, and the share of its pages that template is on.
TEMPLATE, SHARE = 5, 0.9
#: Share of a host's pages that a position must be on to count when the main part is sought.
COMMON = 0.1
_OPEN = re.compile(r"""<([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_MASK = 2**64 - 1


def _mixed(a: int, b: int) -> int:
    """Two 64-bit numbers as one (the finaliser of splitmix64)."""
    x = (a * 0x9E3779B97F4A7C15 + b) & _MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


ROOT = _digest("page")


class Frame:
    """An open element: its position, what it is, and sums over its texts."""

    __slots__ = ("block", "blocks", "boiler", "chars", "depth", "header", "heading", "hidden", "holder", "label", "links", "main", "node", "order", "ranks", "soft", "tag", "weak")

    def __init__(self, tag: str, label: str, node: int, up: Frame | None, block: bool = True):
        self.tag, self.label, self.node, self.block = tag, label, node, block
        self.depth, self.blocks = (up.depth + 1, up.blocks + block) if up else (0, 1)
        self.holder = self if block else up.holder  # the innermost block element
        self.boiler, self.main, self.header, self.heading, self.weak = False, False, False, False, None
        self.soft = self.hidden = False  # boilerplate by words only; a main part inside of that
        self.chars = self.links = self.order = 0
        self.ranks: dict[int, list[int]] = {}


class Block:
    """A text outside the page's frame, with its innermost element."""

    __slots__ = ("frame", "text")

    def __init__(self, frame: Frame, text: str):
        self.frame, self.text = frame, text

    @property
    def key(self) -> int:
        """The text at its position."""
        return _mixed(self.frame.node, _digest(self.text))


class Position:
    """Sums of a position over the pages aligned so far."""

    __slots__ = ("chars", "depth", "first", "instances", "label", "last", "links", "main", "most", "pages", "parent", "parents", "texts")

    def __init__(self, parent: int, label: str, depth: int, main: bool):
        self.parent, self.label, self.depth, self.main = parent, label, depth, int(main)
        self.pages = self.instances = self.parents = self.first = self.last = self.most = self.chars = self.links = self.texts = 0

    def add(self, other: Position) -> None:
        for name in ("pages", "instances", "parents", "first", "last", "chars", "links", "texts"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.most, self.main = max(self.most, other.most), max(self.main, other.main)


def _described(tag: str, attributes: str) -> tuple[str, set[str], str]:
    """Label, class and id words, and role of a start tag."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    own, role = set(_WORD.findall(found.get("class", ""))), found.get("role", "").strip()
    label = tag + ("." + ".".join(sorted(own)) if own else "") + (f"@{role}" if role else "")
    return label, own | set(_WORD.findall(found.get("id", ""))), role


def read(page: str) -> tuple[list[Block], dict[int, Position]]:
    """The blocks outside a page's frame, in page order, and its positions; one pass with a stack."""
    blocks: list[Block] = []
    positions = {ROOT: Position(0, "page", 0, False)}
    positions[ROOT].instances = 1
    root = Frame("page", "page", ROOT, None)
    stack, where = [root], {}
    at, last_end, linked = 0, page.rfind(">"), 0  # linked: height of the stack where a link was opened
    buffer: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1].holder
                top.chars += len(text)
                top.links += min(link_chars, len(text))
                if not top.boiler:
                    blocks.append(Block(top, text))
                positions[top.node].texts += 1
        link_chars = 0

    def close(height: int) -> None:
        nonlocal linked
        if stack[-1].blocks > stack[height - 1].blocks:
            flush()
        while len(stack) > height:
            frame = stack.pop()
            where[frame.tag].pop()
            _fold(frame, positions)
            stack[-1].chars += frame.chars
            stack[-1].links += frame.links
        if linked > len(stack):
            linked = 0

    def add(text: str) -> None:
        nonlocal link_chars
        top = stack[-1]
        if top.boiler and not top.block:
            return  # a notice inside a block: the block goes on after it
        text = entities.unescape(text)
        buffer.append(text)
        if linked:
            link_chars += len(text.strip())

    while True:
        start = page.find("<", at)
        while start >= 0 and start < last_end and not (page[start + 1].isascii() and (page[start + 1].isalpha() or page[start + 1] in "!?/")):
            start = page.find("<", start + 1)
        if start < 0 or (start > last_end and page[start : start + 4] != "<!--"):
            if at < len(page):
                add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _OPEN.match(page, start) or _LOOSE.match(page, start)
        if not m:  # a declaration, or an end tag without a name
            at = page.find(">", start) + 1
            continue
        at = m.end()
        closing, tag, attributes = ("", m[1], m[2]) if m.re is _OPEN else (m[1], m[2], m[3])
        tag = tag.lower()
        if closing:
            if tag == "a":
                linked = 0
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                end = _RAW_END[tag].search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            linked = linked or len(stack)
            continue
        label, words, role = _described(tag, attributes)
        block = tag in BLOCKS
        own = tag in ("article", "main") or role in ("main", "article")
        named = tag not in ("html", "body", "main") and role != "main"
        boiler = role in BOILERPLATE_ROLES or (named and bool(words & BOILERPLATE_WORDS))
        up = stack[-1]
        if not block and not boiler and (up.main or not words & (WEAK_WORDS | HEADER_WORDS)):
            continue
        if block:
            flush()
            if up.holder.tag == "p":
                close(where["p"][-1])
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            border = max((where[t][-1] for t in within if where.get(t)), default=0)
            over = [where[t][-1] for t in ends if where.get(t) and where[t][-1] > border]
            if over:
                close(min(over))
        up = stack[-1]
        frame = Frame(tag, label, _mixed(up.node, _digest(label)), up, block)
        hidden = own and not boiler and up.boiler and up.soft  # <div class="no-sidebar"><article>
        frame.main = up.main or (own and not boiler and (not up.boiler or hidden))
        frame.hidden = up.hidden or (hidden and not up.main)
        head = tag == "header" or (named and bool(words & HEADER_WORDS) and tag not in HEADINGS)
        weak = named and bool(words & WEAK_WORDS) and tag not in HEADINGS
        by_tag = role in BOILERPLATE_ROLES or (tag in BOILERPLATE_TAGS and tag != "header") or (tag == "header" and not up.main)
        frame.boiler = (up.boiler and not hidden) or boiler or by_tag or (not up.main and (head or weak) and not hidden)
        frame.soft = frame.boiler and not by_tag and (up.soft or not up.boiler)
        frame.header = up.header or (up.main and head)
        frame.weak = up.weak or (frame if up.main and weak else None)
        frame.heading = up.heading or tag in HEADINGS
        if block:
            rank = up.ranks.setdefault(frame.node, [0, up.order, 0])
            rank[0], rank[2] = rank[0] + 1, up.order
            up.order += 1
            if frame.node not in positions:
                positions[frame.node] = Position(up.node, label, frame.depth, frame.main)
            positions[frame.node].instances += 1
        if not attributes.endswith("/") or block:
            where.setdefault(tag, []).append(len(stack))
            stack.append(frame)
    close(1)
    flush()
    _fold(root, positions)
    for p in positions.values():
        p.pages = 1
    return blocks, positions


def _fold(frame: Frame, positions: dict[int, Position]) -> None:
    """The children of a closed element into their positions."""
    for node, (count, first, last) in frame.ranks.items():
        p = positions[node]
        p.parents += 1
        p.most = max(p.most, count)
        p.first += first
        p.last += last
    if frame.block:
        positions[frame.node].chars += frame.chars
        positions[frame.node].links += frame.links


def expression(positions: dict[int, Position], template: set[int]) -> str:
    """The wrapper as text: ``label(children)`` with ? for optional and + for repeated parts; # is a slot, " a template text."""
    children: dict[int, list[int]] = {}
    for node, p in positions.items():
        children.setdefault(p.parent, []).append(node)
    out: list[str] = []
    todo: list = [ROOT]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        own = positions[x]
        parts: list[list] = [['"' if x in template else "#"]] if own.texts else []
        groups: list[list[int]] = []
        end = -1.0
        for node in sorted(children.get(x, []), key=lambda n: (positions[n].first / positions[n].parents, positions[n].label)):
            p = positions[node]
            if groups and p.first / p.parents < end:
                groups[-1].append(node)
            else:
                groups.append([node])
            end = max(end, p.last / p.parents)
        for group in groups:
            held: list = []
            for node in group:
                p = positions[node]
                optional = p.parents < own.instances
                sign = ("?" if optional else "") if len(group) > 1 else {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, p.most > 1]
                held += [" "] * bool(held) + [node, sign]
            parts.append(["(", *held, ")+"] if len(group) > 1 else held)
        flat: list = [own.label] + (["("] if parts else [])
        for k, part in enumerate(parts):
            flat += [" "] * bool(k) + part
        flat += [")"] if parts else []
        todo += reversed(flat)
    return "".join(out)


# --- what a wrapper decides -------------------------------------------------------------------------------------------


def decide(pages: int, different: int, slots: bool, positions: dict[int, Position], slot_chars: dict[int, int]) -> tuple[int, list[int]]:
    """(main part or 0, positions that go) of a host, from the positions that COMMON of its pages have."""
    if different < TEMPLATE or not slots:
        return 0, []
    always = {n for n, p in positions.items() if p.pages >= SHARE * pages}
    menus = {n for n in always if (p := positions[n]).instances >= 2 * p.parents and p.links * 3 >= 2 * p.chars > 0}
    weak = {n for n in always if positions[n].main and set(_WORD.findall(positions[n].label.partition(".")[2])) & WEAK_WORDS}
    if any(p.main for p in positions.values()):
        return 0, sorted(menus | weak)
    below = {n: 0 if n in menus else slot_chars.get(n, 0) for n in positions}
    for n in sorted(positions, key=lambda n: -positions[n].depth):
        if positions[n].parent in below:
            below[positions[n].parent] += below[n]
    whole = sum(v for n, v in below.items() if positions[n].parent not in below)
    best, at = 0, -1
    for n in sorted(always):
        p = positions[n]
        if p.most == 1 and p.depth > at and 2 * below[n] > whole and 2 * slot_chars.get(n, 0) < below[n]:
            best, at = n, p.depth
    return best, sorted(menus | weak)


def extract(page: str | None, main: int = 0, gone: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page; main and gone (positions, and texts at positions) come from its host's wrapper."""
    if not page:
        return ""
    blocks, positions = read(page)
    shown = any(b.frame.main and not b.frame.hidden for b in blocks)
    marked = shown or any(b.frame.main for b in blocks)
    inside: set[int] = set()
    if main and not marked and main in positions:
        inside = {main}
        for n, p in positions.items():  # parents come before their children
            if p.parent in inside:
                inside.add(n)
    out, begun = [], not inside
    for b in blocks:
        f = b.frame
        if marked and not f.main or shown and f.hidden:
            continue
        if f.node in gone or (gone and b.key in gone):
            continue
        if f.header and not f.heading:
            continue
        if f.weak is not None and (f.weak.node in gone or f.weak.links * 2 >= f.weak.chars):
            continue
        if inside:
            if f.node in inside:
                begun = True
            elif begun or not f.heading:
                continue
        out.append(b.text)
    return "\n".join(out)


def mark(blocks: list[Block]) -> int:
    """What tells different pages apart: the first heading in the main part, else all text."""
    heading = next((b.text for b in blocks if b.frame.main and b.frame.heading), None)
    return _digest("\n".join(b.text for b in blocks) if heading is None else "h " + heading)


# --- in Spark ---------------------------------------------------------------------------------------------------------

#: Positions that a task adds up before it sends them on.
HELD = 100_000
_SUMS = ("pages", "instances", "parents", "first", "last", "chars", "links", "texts")
#: One row for each text of a page (text, mark; chars), and one for each position of many pages (label and sums).
_ROW = pa.schema([("host", pa.string()), ("node", pa.int64()), ("text", pa.int64()), ("mark", pa.int64()), ("label", pa.string()), ("parent", pa.int64()), ("depth", pa.int64()), ("main", pa.int64()), ("most", pa.int64()), *[(n, pa.int64()) for n in _SUMS]])
_ROW_SQL = "host string, node long, text long, mark long, label string, parent long, depth long, main long, most long, " + ", ".join(f"{n} long" for n in _SUMS)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], Position] = {}

    def positions() -> pa.RecordBatch:
        rows = [{"host": h, "node": _signed(n), "label": p.label, "parent": _signed(p.parent), "depth": p.depth, "main": p.main, "most": p.most} | {s: getattr(p, s) for s in _SUMS} for (h, n), p in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_ROW)

    for batch in batches:
        texts = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            blocks, own = read(page)
            name = _signed(mark(blocks))
            texts.append({"host": host, "node": 0, "text": 0, "mark": name})
            seen: dict[int, list] = {}
            for b in blocks:
                seen.setdefault(_signed(b.key), [_signed(b.frame.node), 0])[1] += len(b.text)
            texts += [{"host": host, "node": node, "text": key, "mark": name, "chars": n} for key, (node, n) in seen.items()]
            for node, p in own.items():
                if (host, node) in held:
                    held[host, node].add(p)
                else:
                    held[host, node] = p
        yield pa.RecordBatch.from_pylist(texts, schema=_ROW)
        if len(held) > HELD:
            yield positions()
    if held:
        yield positions()


def _decided(frame: pd.DataFrame) -> pd.DataFrame:
    first = frame.iloc[0]
    positions, slot_chars, template = {}, {}, set()
    for r in frame[frame["node"] != 0].itertuples():
        p = Position(r.parent & _MASK, r.label, int(r.depth), bool(r.main))
        p.most = int(r.most)
        for s in _SUMS:
            setattr(p, s, int(getattr(r, s)))
        positions[r.node & _MASK] = p
        slot_chars[r.node & _MASK] = max(0, int(r.slot_chars))
        if not r.slot_chars and first["different"] >= TEMPLATE:
            template.add(r.node & _MASK)
    main, gone = decide(int(first["host_pages"]), int(first["different"]), bool(first["slots"]), positions, slot_chars)
    return pd.DataFrame({"host": [first["host"]], "main": [_signed(main)], "gone": [[_signed(n) for n in gone]], "wrapper": [expression(positions, template)]})


def _hosts(pages: DataFrame):
    return F.coalesce(url_host(F.col("url").cast("string")), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, main, gone, wrapper) for every host of pages (url, html): what its wrapper decides, and the wrapper as an expression."""
    small_batches(pages.sparkSession)
    rows = written(pages.select(_hosts(pages).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_aligned, _ROW_SQL), "aligned")
    hosts = rows.where("node = 0").groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"), F.count_distinct("mark").alias("different"))
    texts = rows.where("text <> 0").groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("mark").alias("marks"), F.sum("chars").alias("chars"))
    fixed = (F.col("pages") >= SHARE * F.col("host_pages")) & (F.col("marks") >= TEMPLATE)
    judged = texts.join(hosts, "host").withColumn("fixed", fixed)
    at = written(judged.groupBy("host", "node").agg(F.sum(F.when(~F.col("fixed"), F.col("chars")).otherwise(0)).alias("slot_chars"), F.collect_list(F.when(F.col("fixed"), F.col("text"))).alias("template")), "wrapper-texts")
    slots = at.groupBy("host").agg(F.max(F.col("slot_chars") > 0).alias("slots"), F.flatten(F.collect_list(F.when(F.size("template") > 0, F.col("template")))).alias("template"))
    nodes = rows.where("label is not null").groupBy("host", "node").agg(F.min("label").alias("label"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("main").alias("main"), F.max("most").alias("most"), *[F.sum(n).alias(n) for n in _SUMS])
    known = hosts.join(slots, "host", "left").select("host", "host_pages", "different", F.coalesce("slots", F.lit(False)).alias("slots"), F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))
    common = nodes.join(known.drop("template"), "host").where(F.col("pages") >= COMMON * F.col("host_pages")).join(at.select("host", "node", "slot_chars"), ["host", "node"], "left").withColumn("slot_chars", F.coalesce("slot_chars", F.lit(-1)))
    decided = common.groupBy("host").applyInPandas(_decided, "host string, main long, gone array<long>, wrapper string")
    out = known.join(decided, "host", "left").select("host", F.coalesce("main", F.lit(0)).alias("main"), F.concat(F.when(F.col("slots"), F.col("template")).otherwise(F.array().cast("array<bigint>")), F.coalesce("gone", F.array().cast("array<bigint>"))).alias("gone"), F.coalesce("wrapper", F.lit("page")).alias("wrapper"))
    return written(out, "wrappers")


def _extract_rows(html: str, main: str, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rest = [i for i, n in enumerate(names) if n not in (main, gone)]
            column = lambda n: batch.column(names.index(n)).to_pylist()  # noqa: B023, E731
            texts = [extract(page, (part or 0) & _MASK, {x & _MASK for x in without or ()}) for page, part, without in zip(column(html), column(main), column(gone), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(texts, type=pa.string())], names=[*[names[i] for i in rest], "text"])

    return run


def main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """pages (any columns, url and html among them) with text; a column of that name is replaced."""
    small_batches(pages.sparkSession)
    wrappers = host_wrappers(pages) if wrappers is None else wrappers
    pages = pages.drop("text").withColumn("html", F.col("html").cast("string"))
    host, main, gone = fresh(pages, "host"), fresh(pages, "main"), fresh(pages, "gone")
    known = wrappers.select(F.col("host").alias(host), F.col("main").alias(main), F.col("gone").alias(gone))
    rows = pages.withColumn(host, _hosts(pages)).join(known, host, "left").drop(host)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "text string"])
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], main, gone).mapInArrow(_extract_rows("html", main, gone), schema)
