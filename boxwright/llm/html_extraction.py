"""Operator 3: main text of HTML pages by boosted trees over DOM nodes, decoded over the hierarchy.

A page is read into a tree of elements. Each element gets features: kind of tag, tokens of its class, id and role,
depth, place and number among its siblings, size, link share and density of its subtree, what its ancestors are. The
trees are fitted on pages made here from templates whose main text is known (`training_pages`; their number, TRAIN_PAGES,
bounds the sample). Decoding takes the labelling with the best total over text in which no element of a rejected
subtree is kept: an element is kept with its ancestors or not at all.

Defined cases: null and empty pages have empty text; unclosed and stray tags are repaired as browsers do for
paragraphs, list items and cells; very long and broken pages are read whole, in time that grows as their length; a null page_id stays null; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxwright.llm.boosting import BoostedTrees
from boxwright.llm.common import dedupe_columns

TRAIN_PAGES = 400
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
EDGE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe object select option button".split())
UNREAD = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - {"br", "option", "body", "html", "head"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that no paragraph, item or cell is closed across, and those that no inline end tag reaches across.
WALLS = frozenset("td th button article section div body li blockquote".split())
INLINE_WALLS = frozenset("article td th table body".split())
#: What authors call the parts of a page.
BAD_NAMES = frozenset("ad ads advert advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header head masthead topbar toolbar comment comments reply replies discussion disqus respond share sharing social cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login form search related recommended recommend more widget tags tag pagination pager meta byline copyright legal disclaimer skip toc".split())
GOOD_NAMES = frozenset("article content main post entry story body text page blog news maincontent articlebody".split())
KINDS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "a", "table", "form", "blockquote", "pre", "figure")


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "children", "own", "hidden", "total", "linked", "count", "paragraphs", "stops")

    def __init__(self, tag: str, names: frozenset, parent: int, depth: int, hidden: bool):
        self.tag, self.names, self.parent, self.depth, self.hidden = tag, names, parent, depth, hidden
        self.children: list[int] = []
        self.own = self.total = self.linked = self.count = self.paragraphs = self.stops = 0


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end (of scripts and the like, after their content), slash, name and attributes of tags; comments have no name. Linear in the page: where a quote is
    never closed, quotes count no more from there on, and without a further > the rest is text."""
    at, close, quotes = page.find("<"), 0, True
    while at >= 0:
        end, slash, name, rest = -1, "", "", ""
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(mark, at + 4)
            end = len(page) if end < 0 else end + 3
        else:
            close = page.find(">", at) if close <= at else close
            if close < 0:
                return
            if page[at + 1] in "!?":
                end = close + 1
            elif m := NAME.match(page, at + 1):
                slash, name = m[1], m[2].lower()
                stop = EDGE.search(page, m.end()) if quotes else None
                while stop and stop[0] != ">":
                    shut = page.find(stop[0], stop.end())
                    stop = EDGE.search(page, shut + 1) if shut >= 0 else None
                quotes = quotes and stop is not None
                close = stop.start() if stop else close
                rest, end = page[m.end() : close], close + 1
        if name in UNREAD and not slash:
            shut = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            end = shut.end() if shut else len(page)
        if end >= 0:
            yield at, end, slash, name, rest
        at = page.find("<", max(end, at + 1))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order, parents first, and the events (element, text), text None for a block's edge."""
    nodes = [Node("#root", frozenset(), -1, 0, False)]
    events: list[tuple[int, str | None]] = []
    stack, at = [0], 0
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    last = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            tag = nodes[stack[-1]].tag
            if tag in BLOCKS:
                events.append((stack[-1], None))
            places[tag].pop()
            stack.pop()

    for start, end, slash, tag, rest in markup(page):
        if start > at:
            events.append((stack[-1], page[at:start]))
        at = end
        if not tag:
            continue
        if slash:
            mine, wall = last((tag,)), 0 if tag in BLOCKS else last(INLINE_WALLS)
            if mine and mine >= wall:
                pop_to(mine)
            elif not wall and tag in ("p", "br"):
                events.append((stack[-1], None))
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            closed = CLOSED_BY.get(tag, set())
            mine = last(closed | {"p"} if tag in CLOSES_P else closed)
            if mine > last((WALLS - closed) | SCOPE.get(tag, set())):
                pop_to(mine)
        names, hidden = [], False
        for a in ATTRIBUTE.finditer(rest):
            name, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
            if name in ("class", "id", "role"):
                names += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", (a[2] or "")).lower())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
        node = Node(tag, frozenset(names), stack[-1], nodes[stack[-1]].depth + 1, hidden)
        nodes.append(node)
        me = len(nodes) - 1
        nodes[node.parent].children.append(me)
        if tag in BLOCKS:
            events.append((me, None))
        if tag in VOID:
            continue
        if tag not in UNREAD and (not rest.rstrip().endswith("/") or tag in BLOCKS):
            places[tag].append(len(stack))
            stack.append(me)
    if at < len(page):
        events.append((stack[-1], page[at:]))
    for who, said in events:
        if said and (size := len(said) - said.count(" ")) and not said.isspace():
            nodes[who].own += size
            nodes[who].stops += said.count(".") + said.count(",")
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        x.total += x.own
        x.linked = x.total if x.tag == "a" else x.linked
        if i:
            up = nodes[x.parent]
            up.total += x.total
            up.linked += x.linked
            up.stops += x.stops
            up.count += x.count + 1
            up.paragraphs += x.paragraphs + (x.tag == "p")
    return nodes, events


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element."""
    whole = max(1, nodes[0].total)
    rows, above = [], [(0.0, 0.0, 0.0)] * len(nodes)
    place = [0] * len(nodes)
    tags = [Counter(nodes[c].tag for c in x.children) for x in nodes]
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c] = k
    for i, x in enumerate(nodes):
        up = nodes[x.parent] if i else x
        bad, good = len(x.names & BAD_NAMES), len(x.names & GOOD_NAMES)
        around = above[x.parent] if i else (0.0, 0.0, 0.0)
        fenced = x.tag in ("nav", "footer", "aside", "form", "header")
        above[i] = (around[0] + (bad > 0), around[1] + (good > 0 or x.tag in ("article", "main")), around[2] + fenced)
        same = tags[x.parent if i else 0][x.tag]
        rows.append(
            [
                *(float(x.tag == k) for k in KINDS),
                float(x.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
                float(x.tag in BLOCKS),
                float(x.tag in RAW or x.hidden),
                float(x.depth), float(bad), float(good), *around,
                float(place[i]), float(len(up.children)), float(same), (place[i] + 1) / max(1, len(up.children)),
                math.log1p(x.total), x.total / whole, x.total / max(1, up.total), x.linked / max(1, x.total),
                math.log1p(x.total / (x.count + 1)), float(x.paragraphs), x.stops / max(1, x.total), math.log1p(x.own),
                float(up.tag in ("article", "main")), up.linked / max(1, up.total),
            ]
        )
    return np.array(rows)


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """Keep or reject each element so that the sum over text of the kept ones' log odds is greatest and no element is
    kept inside a rejected one."""
    gain = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        barred = x.hidden or x.tag in RAW or x.tag == "head"
        own = float(np.clip(score[i], -6, 6)) * x.own
        gain[i] = -math.inf if barred else own + sum(max(0.0, gain[c]) for c in x.children)
    kept = [False] * len(nodes)
    for i, x in enumerate(nodes):
        kept[i] = True if not i else kept[x.parent] and gain[i] > 0
    return kept


def text_of(events: list[tuple[int, str | None]], kept: list[bool]) -> str:
    blocks, run = [], []
    for who, said in [*events, (0, None)]:
        if said is None:
            if run and (block := " ".join("".join(run).split())):
                blocks.append(block)
            run = []
        elif kept[who]:
            run.append(entities.unescape(said))  # a reference does not go on in the next element
    return " ".join(blocks)


def training_pages(n: int = TRAIN_PAGES, seed: int = 11) -> Iterator[str]:
    """Pages from random templates; elements with data-main="1" (and all in them) are main, data-main="0" not."""
    r = random.Random(seed)
    syllables = "ta ri on el sa mi no ke du la re in er th an ou".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    said = lambda a, b: " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, b))) + r.choice([".", ".", ""])
    link = lambda: f'<a href="/{word()}">{said(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"

    def named(tag: str, names: str, body: str, main: int | None = None) -> str:
        how = r.random()
        attribute = "" if how < 0.25 else f' class="{r.choice(names.split())}"' if how < 0.7 else f' id="{r.choice(names.split())}"'
        return f"<{tag}{attribute}{'' if main is None else f' data-main={chr(34)}{main}{chr(34)}'}>{body}</{tag}>"

    def always(tag: str, names: str, body: str) -> str:
        return f'<{tag} class="{r.choice(names.split())}" data-main="0">{body}</{tag}>'

    def prose() -> str:
        parts = [f"<h1>{said(2, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            how = r.random()
            text = said(*r.choice([(1, 4), (5, 25), (20, 90), (60, 200)]))
            if how < 0.6:
                parts.append(f"<p>{text}</p>")
            elif how < 0.7:
                parts.append(f"<p><b>{text}<br>" + (said(3, 20) if r.random() < 0.5 else ""))
            elif how < 0.78:
                parts.append(f"<p>{text} {link()} <em>{said(1, 4)}</em> {said(2, 9)}</p>")
            elif how < 0.84:
                parts.append("<ul>" + "".join(f"<li>{said(3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif how < 0.9:
                parts.append(f"<h{r.choice('23')}>{said(2, 6)}</h2>")
            elif how < 0.95:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif r.random() < 0.5:
                parts.append(f"<table><tr><td>{said(1, 4)}</td><td>{said(1, 4)}</td></tr></table>")
            else:
                parts.append(always("div", "ad ads advert promo sponsored banner", said(2, 12)))
        return "".join(parts)

    for _ in range(n):
        top, bottom = [], []
        if r.random() < 0.5:
            top.append(named("header", "header masthead site-header top", f"<h2>{said(1, 4)}</h2>" + (links(2, 5) if r.random() < 0.5 else f"<p>{said(2, 8)}</p>"), 0))
        if r.random() < 0.8:
            top.append(named("nav", "nav menu main-menu", links(3, 9), 0) if r.random() < 0.7 else always("div", "nav menu navbar navigation breadcrumb", links(2, 7)))
        if r.random() < 0.7:
            top.append("<!-- ad -->" + always("div", "ad ads advert banner promo ad-slot", r.choice([said(2, 14), f"<p>{said(3, 20)}</p>"])))
        if r.random() < 0.35:
            top.append(always("div", "cookie-notice cookie consent notice alert gdpr", f"<p>{said(5, 25)}</p><button>{said(1, 2)}</button>"))
        if r.random() < 0.35:
            bottom.append(named("aside", "sidebar related side widget", f"<h3>{said(1, 4)}</h3>" + r.choice([links(2, 6), f"<p>{said(5, 30)}</p>"]), 0) if r.random() < 0.6 else always("div", "sidebar related widget recommended", f"<h3>{said(1, 3)}</h3><p>{said(4, 30)}</p>" + links(1, 4)))
        if r.random() < 0.4:
            one = lambda: f"<div class='comment'><p>{said(3, 60)}</p></div>" if r.random() < 0.6 else f"<p>{said(3, 50)}</p>"
            bottom.append(always(r.choice(["div", "section"]), "comments comment-list replies discussion comments-area", f"<h3>{said(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))))
        if r.random() < 0.25:
            bottom.append(f'<form data-main="0"><label>{said(1, 4)}</label><p>{said(2, 9)}</p><input name="q"></form>')
        if r.random() < 0.25:
            bottom.append(always("div", "share social newsletter subscribe", said(2, 10)))
        foot = f"&copy; {word()} &middot; {said(2, 14)}" if r.random() < 0.6 else f"<p>{said(3, 20)}</p>" + links(1, 5)
        last = named("footer", "footer foot", foot, 0) if r.random() < 0.7 else always("div", "footer copyright site-footer", foot)
        how = r.random()
        body = prose()
        if how < 0.5:
            main = f'<article data-main="1">{body}</article>'
        elif how < 0.65:
            main = f'<main data-main="1">{body}</main>'
        elif how < 0.9:
            main = f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story", "main"])}" data-main="1">{body}</div>'
        else:
            main = f'<div data-main="1">{body}</div>'
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["container", "wrapper", "row", "layout"])}">{main}{"".join(bottom[:1])}</div>'
            bottom = bottom[1:]
        r.shuffle(bottom)
        yield f"<!DOCTYPE html><html><head><title>{said(2, 8)}</title></head><body>{''.join(top)}{main}{''.join(bottom)}{last}" + ("</body></html>" if r.random() < 0.6 else "")


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements whose label the template gives: in or out of main text; marks are not seen by the features."""
    marks = [m[1] for m in re.finditer(r'<[a-z][^>]*?(?:data-main="([01])")?>', page)]
    nodes, _ = parse(page)
    label: list[int | None] = [None] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        own = marks[i - 1] if i - 1 < len(marks) else None
        before = label[x.parent]
        label[i] = before if before == 0 else int(own) if own is not None else before
    keep = [i for i, v in enumerate(label) if v is not None and nodes[i].total]
    return features(nodes)[keep], np.array([label[i] for i in keep], float)


@cache
def trained(n: int = TRAIN_PAGES) -> BoostedTrees:
    pairs = [labelled(p) for p in training_pages(n)]
    return BoostedTrees().fit(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))


def extract_pages(pages: list[str | None], model: BoostedTrees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    table = [features(nodes) for nodes, _ in parsed]
    score = model.score(np.concatenate(table))
    out, at = [], 0
    for (nodes, events), x in zip(parsed, table, strict=True):
        out.append(text_of(events, decode(nodes, score[at : at + len(x)])))
        at += len(x)
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                text = extract_pages(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = dedupe_columns(pages, ["page_id", "url", html])
    return read.mapInArrow(run, f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
