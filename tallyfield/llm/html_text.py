"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at its block-level tags. A logistic classifier over tag, name, link and length features gives
each block the cost of calling it content or boilerplate; these become the capacities to source and sink. Blocks that
follow each other are joined by an edge that is the weaker the more steps lie between their containers in the tree, and
blocks that follow each other inside one container by a further one. The minimum cut (max-flow) is the labelling of
least total cost; source-side blocks are the text, in page order.

The classifier is fitted on seeded pages that `sample_pages()` spells out, so nothing is learned from the input.

Defined cases: null html is empty; an empty page or one without content gives an empty text; unclosed tags end with
their container, a head without end tag before the body holds only what shows nothing (titles, scripts, links), a script or
style without end tag runs to the end of the page, a `<` without `>` after it is text, quotes count no more once a tag's run
to the end of the page, other elements that are left out (`HIDDEN`) without one hold nothing, self-closed ones
are empty, unmatched end tags are ignored, `<` that opens no tag is text; a block whose gain is 0 after its neighbours are
settled is left out; pages of any length are read whole; repeated rows give equal results; columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table

FOLLOW = 0.6
SHARED = 1.2
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag; a `>` in quotes doesn't end it.
_QUOTED = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+>")
#: Elements whose content holds no tags.
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title")}
#: Elements that are left out with all they hold.
HIDDEN = frozenset("noscript template svg iframe select textarea object canvas".split())
_NAME = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Tags that run on inside a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Flags that a tag sets for all that it holds, by tag and by words in its names.
TAG_FLAGS = {"nav": 1, "menu": 1, "footer": 2, "header": 4, "aside": 8, "form": 16, "button": 16, "option": 16, "dialog": 32, "article": 64, "main": 128}
NAME_FLAGS = (
    (re.compile(r"\b(?:nav\w*|menu\w*|breadcrumbs?|toolbar|pagination|pager|tabs?|toc)\b", re.I), 1),
    (re.compile(r"\b(?:footer|foot|copyright|legal|colophon|contentinfo)\b", re.I), 2),
    (re.compile(r"\b(?:header|masthead|banner|topbar|logo)\b", re.I), 4),
    (re.compile(r"\b(?:sidebar|aside|related|widget|recommended|popular|trending|share|social|author-?box|tags?)\b", re.I), 8),
    (re.compile(r"\b(?:form|search|login|signup|subscribe|newsletter)\b", re.I), 16),
    (re.compile(r"\b(?:cookies?|consent|notice|alert|popup|modal|gdpr|overlay)\b", re.I), 32),
    (re.compile(r"\b(?:content|post|entry|story|body|text|article\w*)\b", re.I), 128),
    (re.compile(r"\b(?:ads?|advert\w*|sponsor\w*|promo\w*|banner-?ad|adsense)\b", re.I), 256),
    (re.compile(r"\b(?:comments?|comment-?list|replies|reply|disqus|discussion|responses)\b", re.I), 512),
)
BITS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)


#: Tags of blocks inside lists of terms, tables and figures.
CELLS = frozenset("td th dt dd caption figcaption pre".split())
#: Steps in the tree beyond which containers are equally far apart.
FAR = 16


class Block(NamedTuple):
    text: str
    flags: int
    tag: str
    box: int
    link_chars: int
    steps: int


class Token(NamedTuple):
    """A tag, or with an empty name a comment, a declaration or a whole element without tags in it."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    attrs: str = ""
    raw: bool = False


def tokens(page: str) -> Iterator[Token]:
    """The tags of a page from left to right, in time that grows with its length: a search that reaches the end of the page
    in vain is not made again. That holds for `>` at all, for `</title>`, and for a `>` outside quotes: once a tag's quotes run
    to the end of the page, quotes count no more."""
    at, last, quotes, titles = 0, page.rfind(">"), True, True
    while (at := page.find("<", at)) >= 0:
        if page[at + 1 : at + 2] in ("!", "?"):
            mark = "-->" if page.startswith("<!--", at) else ">"
            found = page.find(mark, at + (4 if mark == "-->" else 1))
            end = found + len(mark) if found >= 0 else len(page)
            yield Token(at, end)
        elif (m := _OPEN.match(page, at)) and m.end() <= last:
            rest = _QUOTED.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            name, closes = m[2].lower(), bool(m[1])
            if not closes and name in _RAW_END and page[end - 2] != "/" and (titles or name != "title"):
                stop = _RAW_END[name].search(page, end)
                if stop or name != "title":
                    end = stop.end() if stop else len(page)
                    yield Token(at, end, raw=True)
                    at = end
                    continue
                titles = False
            yield Token(at, end, name, closes, page[m.end() : end - 1])
        else:
            end = at + 1
        at = end


def hidden(found: list[Token]) -> dict[int, int]:
    """Start of each HIDDEN element that has an end tag -> where it ends. An end tag closes the nearest open one of its name,
    and what is open inside that one holds nothing more."""
    out: dict[int, int] = {}
    opened: list[Token] = []
    places: dict[str, list[int]] = {t: [] for t in HIDDEN}  # of the open ones of each name in `opened`
    for t in found:
        if t.name not in HIDDEN:
            continue
        if t.closes:
            if places[t.name]:
                k = places[t.name][-1]
                out[opened[k].start] = t.end
                for gone in reversed(opened[k:]):
                    places[gone.name].pop()
                del opened[k:]
        elif t.attrs.endswith("/"):
            out[t.start] = t.end
        else:
            places[t.name].append(len(opened))
            opened.append(t)
    return out


def heads(found: list[Token], gone: dict[int, int]) -> dict[int, int]:
    """Start of each head that has an end tag before the body -> where it ends."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    until = 0
    for t in found:
        if t.start < until:
            continue
        if t.name in HIDDEN:
            until = gone.get(t.start, 0)
        elif t.name == "head" and not t.closes:
            waiting.append(t.start)
        elif t.name == "body" and not t.closes:
            waiting.clear()
        elif t.name == "head":
            out |= dict.fromkeys(waiting, t.end)
            waiting.clear()
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. box numbers the container that directly holds the block; steps counts those in the tree
    from the last block's container to this one's."""
    out: list[Block] = []
    above = [0]  # container -> the one that holds it
    depth_of = [0]
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, flags, number
    standing: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    boxes = linked = depth = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, flags, own = stack[-1]
                held = stack[-2][2] if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "blockquote", "pre") and len(stack) > 1 else own
                a, b, steps = (out[-1].box if out else held), held, 0
                while a != b and steps < FAR:
                    if depth_of[a] >= depth_of[b]:
                        a = above[a]
                    else:
                        b = above[b]
                    steps += 1
                out.append(Block(text, flags, tag, held, linked, steps))
            parts.clear()
        linked = 0

    found = list(tokens(page))
    gone = hidden(found)
    head_ends = heads(found, gone)
    at = until = 0
    for t in found:
        if t.start < until:
            continue
        if t.start > at:
            parts.append(page[at : t.start])
            if depth:
                linked += t.start - at
        at, tag, end = t.end, t.name, t.closes
        if not tag:
            if t.raw:
                close()
            continue
        if tag == "head":
            close()
            at = until = head_ends.get(t.start, at) if not end else at
            continue
        if tag in HIDDEN:
            at = until = max(at, gone.get(t.start, at))
            if tag not in ("svg", "iframe"):
                close()
            continue
        if tag == "a":
            depth = 0 if end else 1
        if tag in INLINE:
            continue
        close()
        depth = 0
        if tag in VOID:
            continue
        if end:
            while standing[tag]:  # down to the nearest one of its name
                name = stack.pop()[0]
                standing[name] -= 1
                if name == tag:
                    break
            continue
        if stack[-1][0] == "p" or (tag in ("li", "dd", "dt", "tr", "td", "option") and stack[-1][0] == tag):
            standing[stack.pop()[0]] -= 1  # a new block ends an open paragraph
        flags = stack[-1][1] | TAG_FLAGS.get(tag, 0)
        attrs = t.attrs
        if attrs and tag not in ("body", "html"):
            for name in _NAME.finditer(attrs):
                value = re.sub(r"[_]+|(?<=[a-z])(?=[A-Z])", "-", name[1] or name[2] or name[3] or "")
                for pattern, bit in NAME_FLAGS:
                    if not flags & bit and pattern.search(value):
                        flags |= bit
        boxes += 1
        above.append(stack[-1][2])
        depth_of.append(depth_of[stack[-1][2]] + 1)
        stack.append((tag, flags, boxes))
        standing[tag] += 1
    parts.append(page[at:])
    close()
    return out


def numbers(found: list[Block]) -> np.ndarray:
    """A row of features for each block."""
    out = np.zeros((len(found), len(BITS) + 9))
    for i, b in enumerate(found):
        out[i, : len(BITS)] = [bool(b.flags & bit) for bit in BITS]
        n = len(b.text)
        out[i, len(BITS) :] = (
            1.0,
            b.tag == "p",
            b.tag[:1] == "h" and len(b.tag) == 2,
            b.tag == "li",
            b.tag in CELLS,
            min(1.0, b.link_chars / n),
            min(1.0, math.log1p(n) / 7),
            b.text[-1] in ".!?…\"”»:",
            not b.flags & (64 | 128),
        )
    return out


def sample_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """(page, texts of its content blocks): templates with and without telling tags and names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "ou", "ti", "st", "la", "de"]) for _ in range(rng.randint(1, 4)))
    line = lambda a, b: (" ".join(word() for _ in range(rng.randint(a, b))) + rng.choice([".", ".", "!", "?"])).capitalize()
    short = lambda: " ".join(word() for _ in range(rng.randint(1, 3)))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{short()}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>"
    out = []
    for _ in range(n):
        good: list[str] = []

        def content(good: list[str] = good) -> str:
            body = []
            for k in range(rng.randint(3, 12)):
                tag = "h1" if k == 0 else rng.choice(["p", "p", "p", "p", "p", "p", "h2", "li", "li", "blockquote", "pre", "table", "figure"])
                if tag == "table":
                    cells = [rng.choice([short(), str(rng.randint(1, 999)), rng.choice(["kg", "cm", "%"])]) for _ in range(rng.randint(2, 8))]
                    good += cells
                    body.append("<table><tr>" + "".join(f"<{(c := rng.choice(['td', 'td', 'td', 'th']))}>{x}</{c}>" for x in cells) + "</tr></table>")
                    continue
                text = line(2, 8) if tag in ("h1", "h2", "figure") else line(3, 60)
                good.append(text)
                body.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<figure><img src=x><figcaption>{text}</figcaption></figure>" if tag == "figure" else f"<{tag}>{text}</{tag}>")
            return "".join(body)

        box = lambda tag, name, inner: f"<{tag}>{inner}</{tag}>" if rng.random() < 0.5 else f'<div class="{name}">{inner}</div>'
        extras = [
            box("nav", rng.choice(["menu", "navbar", "nav-main"]), menu()),
            box("header", rng.choice(["site-header", "masthead", "logo"]), f"<div>{short()}</div>" + menu()),
            box("aside", rng.choice(["sidebar", "related", "widget"]), f"<h3>{short()}</h3>" + "".join(f"<p>{line(3, 14)}</p>" for _ in range(rng.randint(1, 3)))),
            f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{line(3, 15)}</div>',
            f'<div class="{rng.choice(["cookie-notice", "consent", "alert", "popup"])}"><p>{line(5, 20)}</p></div>',
            f"<form><label>{short()}</label><p>{line(2, 6)}</p></form>",
        ]
        tail = [
            f'<div id="{rng.choice(["comments", "comment-list", "replies"])}">' + "".join(f"<p>{line(4, 30)}</p>" for _ in range(rng.randint(1, 5))) + "</div>",
            box("footer", rng.choice(["footer", "legal", "copyright"]), f"&copy; {short()} &middot; {line(3, 10)}" + menu() * rng.randrange(2)),
        ]
        main = content()
        form = rng.random()
        main = f"<article>{main}</article>" if form < 0.5 else f'<div class="{rng.choice(["content", "post-body", "entry", "article-text"])}">{main}</div>' if form < 0.8 else f"<main>{main}</main>" if form < 0.9 else f"<div>{main}</div>"
        inner = rng.random()
        if inner < 0.3:  # something inside the article that isn't part of it
            at = main.rindex("</")
            main = main[:at] + rng.choice(extras[2:5] + tail[:1]) + main[at:]
        page = "".join(rng.sample(extras, rng.randint(1, 5))) + main + "".join(rng.sample(tail, rng.randint(0, 2)))
        out.append((f"<html><head><title>{short()}</title></head><body>{page}</body></html>", set(good)))
    return out


@lru_cache(maxsize=1)
def fitted() -> tuple[float, ...]:
    """Weights of the logistic classifier, by Newton's method with a ridge."""
    xs, ys = [], []
    for page, good in sample_pages():
        found = blocks(page)
        xs.append(numbers(found))
        ys += [float(b.text in good) for b in found]
    x, y = np.vstack(xs), np.array(ys)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return tuple(w)


def source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut of nodes with terminal capacities max(gain, 0) from the source and max(-gain, 0) to the sink, and
    undirected edges. Returns which nodes stay with the source (content).

    First, a node whose gain outweighs all its edges is settled, which moves its edges' weight into its neighbours'
    gains; what is left over is cut by max-flow (shortest augmenting paths in levels).
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    if None not in side:
        return side
    left = [i for i in range(n) if side[i] is None]
    s, t = n, n + 1
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {s: {}, t: {}}
    for i in left:
        if gain[i] > 0:
            cap[s][i], cap[i][s] = gain[i], 0.0
        elif gain[i] < 0:
            cap[i][t], cap[t][i] = -gain[i], 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            for i in left:
                side[i] = i in level
            return side
        ways, tried = {u: list(cap[u]) for u in level}, dict.fromkeys(level, 0)
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                links = list(zip(path, path[1:], strict=False))
                flow = min(cap[a][b] for a, b in links)
                for a, b in links:
                    cap[a][b] -= flow
                    cap[b][a] += flow
                path = path[: 1 + next(k for k, (a, b) in enumerate(links) if cap[a][b] <= 1e-12)]
                continue
            while tried[u] < len(ways[u]) and not (cap[u][v := ways[u][tried[u]]] > 1e-12 and level.get(v) == level[u] + 1):
                tried[u] += 1
            if tried[u] < len(ways[u]):
                path.append(v)
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(page: str | None, weights: tuple[float, ...]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    gain = (numbers(found) @ np.array(weights)).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, FOLLOW * 2.0 ** (-max(0, b.steps - 1) / 2)))
        if b.box in last:
            edges.append((last[b.box], i, SHARED))
        last[b.box] = i
    return " ".join(b.text for b, keep in zip(found, source_side(gain, edges), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars; page by page, no shuffle."""
    weights = fitted()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, weights) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_min_cut_html": op2_min_cut_html}
ORACLE: dict[str, str] = {}
