"""Main text of web pages (operator 4).

A page is read into flat text blocks: runs of text that no block element interrupts. A block is described by its words
and link density, by those of its neighbours, by the elements around it, and by how the words of class, id and role around
it were used on the pages of a small labelled table; a decision tree, grown on the same table, keeps or drops it.

White space inside a block becomes one space; kept blocks are joined by two newlines. Null or empty html, or a page without
kept blocks: "". Any string is read, in time linear in its length: stray ends are passed over, a tag that never ends is
text, comments, declarations and the contents of scripts, styles, forms' fields and hidden elements are no text. Pages of
any length are handled whole. Repeated rows are read each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sorbus.llm.common import map_arrow, prepare, table, texts_of

# What the elements are, by their names in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("template head select option button svg math object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ITEMS = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt", "dd", "dl"), "dd": ("dt", "dd", "dl"), "tr": ("tr", "table"), "td": ("td", "th", "tr", "table"), "th": ("td", "th", "tr", "table")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = ("nav", "header", "footer", "aside", "form", "article", "main")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in their order; linear."""
    at, text_from, n = 0, 0, len(html)
    last = html.rfind(">")
    quotes = True  # until a quoted value turns out to leave its tag without an end
    gone = {'"': False, "'": False}  # no such quote further on
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end = end + 3 if end >= 0 else html.find(">", lt) + 1
            kind = None
        elif html[lt + 1 : lt + 2] in ("!", "?"):
            end, kind = html.find(">", lt) + 1, None
        else:
            name_at = lt + 2 if html.startswith("/", lt + 1) else lt + 1
            if not html[name_at : name_at + 1].isalpha():
                at = lt + 1
                continue
            pos, end = name_at, 0
            while True:
                gt = html.find(">", pos)
                if gt < 0:
                    break
                nearest = None
                for q in ('"', "'") if quotes else ():
                    if not gone[q]:
                        k = html.find(q, pos, gt)
                        if k >= 0 and (nearest is None or k < nearest):
                            nearest = k
                if nearest is None:
                    end = gt + 1
                    break
                close = html.find(html[nearest], nearest + 1)
                if close < 0:
                    gone[html[nearest]] = True
                    continue
                pos = close + 1
            if not end:  # the quoted values reach beyond the last ">"
                quotes, end = False, html.find(">", name_at) + 1
            kind = "end" if name_at == lt + 2 else "start"
        if lt > text_from:
            yield "text", html[text_from:lt], ""
        if kind:
            m = re.compile(r"[^\s/>]+").match(html, name_at)
            name = m[0].lower()
            yield kind, name, html[m.end() : end - 1] if kind == "start" else ""
            if kind == "start" and name in RAW and html[end - 2] != "/":
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, end)
                if stop is None:
                    return
                end = stop.start()
        at = text_from = end
    if text_from < n:
        yield "text", html[text_from:], ""


@dataclass(slots=True)
class Element:
    """An open element; what it passes on to those inside, and where the nearest open ones of some kinds are."""

    tag: str
    silent: bool
    inside: frozenset  # of KINDS and headings around, itself included
    marks: tuple  # (least, largest) of what is known about the words of class, id and role
    block: int  # place of the nearest element that is not inline, or -1
    item: dict  # for each of ITEMS the place of the nearest element in its list
    inline: dict = field(default_factory=dict)  # open inline elements in this one's run


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    inside: frozenset
    marks: tuple
    names: frozenset = frozenset()


def names_of(attributes: str) -> tuple[list[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    if not attributes:
        return [], False
    found, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            found += [p.lower() for p in PARTS.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return found, hidden


def blocks_of(html: str, known: dict[str, float] | None = None, keep_names: bool = False) -> list[Block]:
    """The blocks of a page; known: per word of class, id and role how it was used (above 0: around main text)."""
    known = known or {}
    root = Element("", False, frozenset(), (0.0, 0.0), -1, {})
    stack, count, out = [root], {}, []
    names_around = [frozenset()]
    text, linked, links = [], [], 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = stack[-1]
                out.append(Block(joined, len(joined.split()), len(unescape("".join(linked)).split()), top.inside, top.marks, names_around[-1]))
        text, linked = [], []

    def close_to(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            count[e.tag] -= 1
            links -= e.tag == "a"
            if e.tag in INLINE:
                run = stack[e.block] if e.block >= 0 else root
                run.inline[e.tag] -= 1
        del stack[k:], names_around[k:]

    for kind, name, rest in tokens(html):
        if kind == "text":
            if not stack[-1].silent:
                text.append(name)
                if links:
                    linked.append(name)
            continue
        top = stack[-1]
        if kind == "start":
            if name not in INLINE:
                flush()
                at = top.block
                if name in CLOSES_P and at >= 0 and stack[at].tag == "p":
                    close_to(at)
                elif name in ITEMS and (at := top.item.get(name, -1)) >= 0 and stack[at].tag in ("li", "dt", "dd", "tr", "td", "th") and not (name in ("td", "th") and stack[at].tag == "tr"):
                    close_to(at)
                top = stack[-1]
            if name == "br":
                text.append(" ")
            if name in VOID:
                continue
            words, hidden = names_of(rest)
            weights = [known[w] for w in words if w in known]
            marks = (min(top.marks[0], *weights), max(top.marks[1], *weights)) if weights else top.marks
            inside = top.inside
            if name in KINDS and name not in inside:
                inside = inside | {name if name != "header" or not inside & {"article", "main"} else "own header"}
            elif name in HEADINGS:
                inside = inside | {"heading"}
            elif name in ("li", "td", "th", "dd"):
                inside = inside | {"item"}
            place = len(stack)
            item = top.item
            if any(name in scope for scope in ITEMS.values()):
                item = item | {i: place for i, scope in ITEMS.items() if name in scope}
            silent = (top.silent or name in SILENT or hidden) and name != "body"
            stack.append(Element(name, silent, inside, marks, place if name not in INLINE else top.block, item))
            names_around.append(names_around[-1] | set(words) if keep_names and words else names_around[-1])
            count[name] = count.get(name, 0) + 1
            links += name == "a"
            if name in INLINE:
                run = stack[top.block] if top.block >= 0 else root
                run.inline[name] = run.inline.get(name, 0) + 1
        else:
            if name not in INLINE:
                flush()
            if not count.get(name):
                continue
            if name in INLINE and not (stack[top.block] if top.block >= 0 else root).inline.get(name):
                continue  # open, but outside of the block that is open
            k = len(stack) - 1
            while stack[k].tag != name:
                k -= 1
            close_to(k)
    flush()
    return out


#: Columns of `features`. Link densities are shares of the words; a missing neighbour has no words and no links.
NAMES = (
    "words", "links", "words before", "links before", "words after", "links after", "words two before", "words two after", "least mark", "largest mark",
    "heading", "item", "in article", "in main", "in nav", "in header", "in footer", "in aside", "in form", "page has article", "largest mark of the page", "share of the page", "share of the page before",
)


def features(blocks: list[Block]) -> np.ndarray:
    """One row of NAMES per block."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked / max(1, b.words) for b in blocks], float)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n)
        if by > 0:
            out[by:] = x[: max(0, n - by)]
        else:
            out[:by] = x[-by:]
        return out

    marks = np.array([b.marks for b in blocks], float).reshape(n, 2)
    inside = [np.array([k in b.inside for b in blocks], float) for k in ("heading", "item", "article", "main", "nav", "header", "footer", "aside", "form")]
    page = np.full(n, float((inside[2] + inside[3]).any()))
    total = np.cumsum(words)
    cols = [words, links, shifted(words, 1), shifted(links, 1), shifted(words, -1), shifted(links, -1), shifted(words, 2), shifted(words, -2), marks[:, 0], marks[:, 1], *inside, page]
    if not n:
        return np.zeros((0, len(NAMES)))
    return np.stack([*cols, np.full(n, marks[:, 1].max()), words / total[-1], (total - words) / total[-1]], 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 8) -> tuple | float:
    """A tree of (feature, threshold, at most, above), by the least Gini impurity; leaves are shares of label 1."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones, n = x[order, f], np.cumsum(y[order]), len(y)
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (n - cut - 1 >= least)]
        if not len(cut):
            continue
        low, a = cut + 1.0, ones[cut]
        high, b = n - low, ones[-1] - a
        cost = a * (1 - a / low) + b * (1 - b / high)
        k = int(cost.argmin())
        if best is None or cost[k] < best[0] - 1e-9:
            best = (cost[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree: tuple | float, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_pages(n: int = 1600, seed: int = 3) -> list[str]:
    """Pages of many layouts, a quarter of them with names that say nothing. What belongs to the article is marked: its words begin with "m", those of all else with "b"."""
    rng = np.random.default_rng(seed)

    def some(kind: str, lo: int, hi: int) -> str:
        return " ".join(f"{kind}{i}" for i in rng.integers(0, 999, int(rng.integers(lo, hi + 1))))

    def pick(*of: str) -> str:
        return of[int(rng.integers(len(of)))]

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    def link(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/x">{some("b", lo, hi)}</a>'

    def named(*of: str) -> str:
        if nameless:  # names that say nothing, or none
            return pick("", "", f' class="c{int(rng.integers(99))}"', f' id="{pick("x", "y", "z")}{int(rng.integers(99))}"')
        return f' {pick("class", "class", "id")}="{pick(*of)}"'

    def paragraph() -> str:
        # Articles have short paragraphs too, some links, and classes that sound like something else.
        words = [some("m", 1, 9), some("m", 6, 30), some("m", 20, 90), some("m", 60, 200)][int(rng.integers(4))]
        if chance(0.12):
            words += f' <a href="/y">{some("m", 1, 3)}</a> {some("m", 8, 20)}'
        odd = ""
        if len(words.split()) >= 25 and chance(0.15):
            odd = named("share-price", "notice-board", "social-history", "related-work", "comment-on-law", "header-text", "ad-hoc")
        return f"<p{odd}>{words}</p>"

    def body() -> str:
        parts = []
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.72:
                parts.append(paragraph())
            elif kind < 0.82:
                parts.append(f"<h2{pick('', '', named('section-title', 'subhead', 'heading'))}>{some('m', 1, 8)}</h2>{paragraph()}")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{some('m', 2, 25)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{some('m', 8, 50)}</p></blockquote>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{some('m', 3, 15)}</figcaption></figure>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{some('m', 1, 4)}</td><td>{some('m', 1, 6)}</td></tr>" for _ in range(3)) + "</table>")
        if not nameless and chance(0.15):  # without a name it could not be told apart
            parts.insert(int(rng.integers(len(parts) + 1)), f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{some('b', 3, 18)}</div>")
        if chance(0.2):
            parts.append(f"<div{named('share', 'social', 'sharing', 'share-buttons')}>{' '.join(link() for _ in range(4))}</div>")
        if chance(0.12):
            parts.append(f"<div{named('related', 'related-posts', 'recommended')}><h3>{some('b', 1, 3)}</h3><ul>{''.join(f'<li>{link(3, 9)}</li>' for _ in range(4))}</ul></div>")
        return "".join(parts)

    def title() -> str:
        h = f"<h1{pick('', '', named('title', 'post-header', 'entry-title', 'headline', 'post-title'))}>{some('m', 1, 14)}</h1>"
        return [h, h, f"<header>{h}</header>", f"<div{named('entry-header', 'post-header', 'article-header')}>{h}</div>"][int(rng.integers(4))]

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(3, 9))))
        return pick(f"<nav><ul>{items}</ul></nav>", f"<ul{named('menu', 'nav', 'navbar', 'navigation', 'main-menu')}>{items}</ul>", f"<div{named('nav', 'topbar', 'navbar', 'menu')}>{' | '.join(link() for _ in range(5))}</div>", f"<ul>{items}</ul>")

    def top() -> str:
        site = pick(f"<h1>{some('b', 1, 4)}</h1>", f"<div{named('logo', 'brand', 'site-title')}>{some('b', 1, 4)}</div>", f"<p>{some('b', 2, 9)}</p>")
        return pick(f"<header>{site}{menu()}</header>", f"<header>{site}</header>{menu()}", f"<div{named('header', 'site-header', 'masthead', 'top-header')}>{site}</div>{menu()}", menu(), "")

    def advert() -> str:
        words = some("b", 3, 30) + (f" {link()}" if chance(0.4) else "")
        return f"<{pick('div', 'div', 'section', 'aside')}{named('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'promo', 'banner', 'sponsor')}>{pick(words, f'<p>{words}</p>')}</{pick('div', 'section', 'aside')}>"

    def notice() -> str:
        words = f"<p>{some('b', 6, 40)}</p>"
        return f"<div{named('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr-banner', 'alert', 'popup', 'modal')}>{words}{pick('', f'<p>{link()}</p>', '<button>b1</button>')}</div>"

    def aside() -> str:
        inner = f"<h3>{some('b', 1, 3)}</h3>" + pick(f"<ul>{''.join(f'<li>{link(2, 9)}</li>' for _ in range(5))}</ul>", f"<p>{some('b', 8, 40)}</p>", f"<p>{some('b', 8, 25)} {link()}</p>")
        return pick(f"<aside>{inner}</aside>", f"<div{named('sidebar', 'widget', 'side', 'related', 'rail', 'newsletter', 'trending')}>{inner}</div>")

    def form() -> str:
        inner = f"<label>{some('b', 1, 4)}</label><input><p>{some('b', 3, 25)}</p>"
        return pick(f"<form>{inner}</form>", f"<form{named('search', 'newsletter', 'login', 'signup', 'subscribe')}>{inner}</form>", f"<div{named('newsletter', 'subscribe', 'signup')}><p>{some('b', 5, 25)}</p><form>{inner}</form></div>")

    def comments() -> str:
        one = lambda: pick(f"<p>{some('b', 2, 70)}</p>", f"<div><b>{some('b', 1, 2)}</b><p>{some('b', 3, 60)}</p></div>")
        many = "".join(pick(f"<li>{one()}</li>", f"<div{named('comment', 'reply', 'comment-body')}>{one()}</div>") for _ in range(int(rng.integers(1, 6))))
        return f"<{pick('section', 'div', 'ol')}{named('comments', 'commentlist', 'disqus', 'respond', 'replies', 'discussion', 'comment-list')}><h3>{some('b', 1, 3)}</h3>{many}</div>"

    def foot() -> str:
        words = pick(f"&copy; {some('b', 2, 20)}", f"<p>{some('b', 3, 30)}</p>", f"{' '.join(link() for _ in range(4))} {some('b', 2, 9)}", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul><p>&copy; {some('b', 3, 9)}</p>")
        return pick(f"<footer>{words}</footer>", f"<footer>{words}</footer>", f"<div{named('footer', 'site-footer', 'copyright', 'colophon')}>{words}</div>")

    def cell(inner: str) -> str:
        return f"<td{pick('', ' valign=top', ' width=200')}>{inner}</td>"

    def plain() -> str:
        runs = [some("m", 1, 9), *(some("m", 5, 120) for _ in range(int(rng.integers(0, 5))))]
        return pick("\n\n".join(runs), "<br><br>".join(runs), f"<pre>{' '.join(runs)}</pre>", "".join(f"<p>{r}" for r in runs))

    told_by_name = (notice, advert, comments)  # sentences like any others
    out, nameless = [], False
    for _ in range(n):
        nameless = chance(0.25)
        if chance(0.04):
            out.append(pick("{}", "<html><body>{}</body></html>", "<div>{}</div>").format(plain()))
            continue
        inner = title() + body()
        if chance(0.06):  # laid out by a table
            sides = [cell("<br>".join(link() for _ in range(int(rng.integers(3, 8))))), cell(inner), cell(pick(some("b", 3, 18), f"<p>{some('b', 3, 18)}</p>", f"{some('b', 2, 12)} {link()}"))]
            if chance(0.4):
                del sides[int(rng.choice([0, 2]))]
            rows = [f"<tr>{''.join(sides)}</tr>"]
            if chance(0.5):
                rows.insert(0, f"<tr><td colspan={len(sides)}>{some('b', 1, 4)} {' | '.join(link() for _ in range(4))}</td></tr>")
            if chance(0.5):
                rows.append(f"<tr><td colspan={len(sides)}>&copy; {some('b', 2, 9)}</td></tr>")
            out.append(f"<html><body><table>{''.join(rows)}</table></body></html>")
            continue
        shell = rng.random()
        if shell < 0.45:
            held = f"<article{pick('', '', named('post', 'entry', 'article'))}>{inner}</article>"
            held = pick(held, f"<main>{held}</main>")
        elif shell < 0.6:
            held = f"<main>{inner}</main>"
        elif shell < 0.7:
            held = pick(inner, f"<div>{inner}</div>", f"<div><div>{inner}</div></div>")
        else:
            held = f"<div{named('content', 'post', 'entry-content', 'article-body', 'story', 'post-content', 'main-content', 'text')}>{inner}</div>"
        if chance(0.15):  # nothing but the article
            out.append(pick(held, f"<html><head><title>b</title></head><body>{held}</body></html>", inner))
            continue
        before = [f() for f, p in ((top, 0.9), (notice, 0.3), (advert, 0.5), (aside, 0.15)) if chance(p) and not (nameless and f in told_by_name)]
        after = [f() for f, p in ((advert, 0.25), (aside, 0.4), (form, 0.25), (comments, 0.45), (notice, 0.15), (foot, 0.9)) if chance(p) and not (nameless and f in told_by_name)]
        out.append(f"<html><head><title>b</title></head><body>{''.join(before)}{held}{''.join(after)}</body></html>")
    return out


@functools.cache
def trained() -> tuple[dict[str, float], tuple | float]:
    """What is known of the words of class, id and role, and the tree."""
    pages = labelled_pages()
    good, bad = {}, {}
    for html in pages:
        for b in blocks_of(html, keep_names=True):
            for w in b.names:
                side = good if b.text.lstrip("© |")[:1] == "m" else bad
                side[w] = side.get(w, 0) + 1
    known = {}
    for w in good.keys() | bad.keys():
        g, b = good.get(w, 0), bad.get(w, 0)
        if g + b >= 5:
            known[w] = float(np.log((g + 0.5) / (b + 0.5)))
    xs, ys = [], []
    for html in pages:
        held = blocks_of(html, known)
        xs.append(features(held))
        ys += [float(b.text.lstrip("© |")[:1] == "m") for b in held]
    return known, grow(np.vstack(xs), np.array(ys))


def main_text(html: str, model: tuple) -> str:
    known, tree = model
    blocks = blocks_of(html, known)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks).tolist(), strict=True) if decide(tree, row) >= 0.5)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text and its length in code points, without the html; other columns pass through."""
    prepare(pages.sparkSession)
    pages = pages.drop(*[c for c in (out, "n_chars") if c != html])
    model = trained()
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string, n_chars long"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [main_text(h, model) for h in texts_of(part.column(html))]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f.name for f in kept], out, "n_chars"])

    return map_arrow(pages, run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
