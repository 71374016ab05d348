"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, tidy

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)[^>]*>?|<[!?/][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose whole content is no text.
RAW = frozenset("script style noscript template svg math iframe object select textarea button option title canvas audio video".split())
#: Elements that start and end a block.
BLOCK = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre form "
    "fieldset legend label header footer nav aside figure figcaption address hr details summary dialog menu center".split()
)
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
HOLDS = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "hr", "html", "body"} | {"a"}
#: Class, id and role tokens of boxes beside a text, and words of notices.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list commentlist consent contentinfo complementary cookie cookies "
    "cookie-notice disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related reply respond "
    "search share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe tagcloud toolbar widget".split()
)
NOTICE = re.compile(r"©|\b(?:copyright|all rights reserved|cookies?|newsletter|subscribe|sign up|log in|advertisement|sponsored|privacy policy|terms of use|powered by|print this|share this)\b", re.I)
TALK = re.compile(r"\b(?:comments?|replies|responses|letters|readers|discussion|what others say)\b", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler", "hint", "notice", "after_talk")


def labelled_pages(n: int = 90, seed: int = 3) -> list[str]:
    """The labelled table: small pages made by rule, in which data-main marks the main text's blocks.

    Layouts differ in what they tell: some have an article, some a main element, some only divisions or table cells in
    which nothing but a block's words and links and those beside it tell text from menus. Short paragraphs stand within
    the text, short labels within menus, and long notices, teasers and readers' letters beside it.
    """
    rng, vowels = random.Random(seed), "aeiou"
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + "."
    link = lambda: f"<a href='/{word()}'>{words(1, 3)}</a>"

    def links(tag: str) -> str:
        kind = rng.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        items = [f"<{tag}>{link()} {link() if rng.random() < 0.5 else ''}</{tag}>" for _ in range(rng.randint(2, 5))]
        if kind == 1:  # labels among the links
            items.insert(rng.randint(1, len(items) - 1), f"<{tag}>{words(1, 3)}</{tag}>")
        return "".join(items)

    def text(tag: str, most: int) -> list[str]:
        parts = [f"<{tag} data-main>{sentence(*rng.choice([(12, 40), (12, 40), (5, 11), (1, 4)]))}</{tag}>" for _ in range(rng.randint(2, most))]
        if rng.random() < 0.4:
            parts.append(f"<{tag} data-main>{sentence(10, 20)} {link()} {sentence(8, 20)}</{tag}>")
        rng.shuffle(parts)
        return [f"<{tag} data-main>{sentence(14, 40)}</{tag}>", *parts, f"<{tag} data-main>{sentence(8, 30)}</{tag}>"]

    notice = lambda: rng.choice(["Copyright 2019 {}", "© {}", "{} All rights reserved", "We use cookies to {}", "Subscribe to our newsletter {}", "Powered by {}"]).format(words(2, 12))
    letters = lambda tag: f"<{tag}>{rng.choice(['Comments', 'Letters from readers', '12 comments', 'Responses'])}</{tag}>" + "".join(f"<{tag}>{sentence(4, 30)}</{tag}>" for _ in range(rng.randint(1, 3)))
    shell = lambda: rng.choice(["", "", " class='layout has-sidebar'", " class='content with-comments'", " id='page-header-image'", " class='overflow-hidden'"])
    title = lambda tag: f"<{tag} data-main>{words(2, 8)}</{tag}>"

    def page(layout: int) -> str:
        if layout == 0:
            inside = [title("h1"), *text("p", 6)]
            if rng.random() < 0.5:
                inside.insert(rng.randint(2, len(inside)), f"<div class='{rng.choice(['ad', 'share', 'related', 'newsletter'])}'>{sentence(2, 25)}</div>")
            if rng.random() < 0.5:
                inside.append(links("p"))
            if rng.random() < 0.3:
                inside.append("<div class='comments'>" + "".join(f"<p>{sentence(3, 20)}</p>" for _ in range(2)) + "</div>")
            before = rng.choice([f"<nav>{links('div')}</nav>", f"<header>{words(2, 8)}</header>", f"<div>{words(3, 9)}</div>{links('div')}"])
            after = rng.choice([f"<footer>{sentence(4, 30)}</footer>", f"<div>{notice()}</div>", f"<aside>{sentence(8, 30)}</aside>", letters("div"), f"<form>{sentence(5, 20)}</form>"])
            return f"<div{shell()}>{before}<article{shell()}>{''.join(inside)}</article>{after}</div>"
        tag = rng.choice(["p", "div"]) if layout < 3 else "td"
        body = "".join([title(rng.choice(["h1", "h2", tag])) if rng.random() < 0.6 else "", *text(tag, 7)])
        top = links(tag) + (f"<{tag}>{notice()}</{tag}>" if rng.random() < 0.3 else "") + (links(tag) if rng.random() < 0.3 else "")
        end = rng.choice([links(tag), links(tag) + f"<{tag}>{notice()}</{tag}>", f"<{tag}>{notice()}</{tag}>" + links(tag), letters(tag) + links(tag)])
        if layout == 1:
            return f"<div{shell()}>{top}</div><main{shell()}>{body}</main><div>{end}</div>"
        if layout == 2:
            side = rng.choice(["", f"<aside>{sentence(6, 30)}</aside>", f"<div class='sidebar'>{sentence(6, 30)}</div>"])
            return f"<div>{top}</div><div{shell()}>{body}</div>{side}<div>{end}</div>"
        return f"<table{shell()}><tr>{top}</tr><tr>{body}</tr><tr>{end}</tr></table>"

    return [page(k % 4) for k in range(n)]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    hint: bool
    marked: bool


@dataclass(frozen=True)
class Element:
    name: str
    boiler: bool = False
    hint: bool = False
    marked: bool = False


def element(name: str, attributes: str) -> Element:
    """What an element's tag says of it: a box beside the text by its kind, or not shown; by whole tokens of its class, id
    or role; marked in the labelled table."""
    boiler, hint, marked = name in BOILER, False, False
    if attributes.strip():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        hint = any(t in HINTS for k in ("class", "id", "role", "aria-label") for t in found.get(k, "").lower().split())
        hidden = found.get("hidden", "false" if "hidden" not in found else "").lower() != "false" or found.get("aria-hidden", "").lower() == "true"
        boiler, marked = boiler or hidden or bool(NOT_SHOWN.search(found.get("style", ""))), "data-main" in found
    return Element(name, boiler, hint, marked)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, with where they stand. Unclosed and stray tags, an unclosed comment or script
    and a cut-off tag are taken as browsers take them: up to the end of what holds them. What an element says counts for
    the blocks in it, except for those inside an article that it holds."""
    page, out, stack, parts, at = page or "", [], [], [], 0
    own = Element("")
    #: By depth: boiler and hint of the elements down to there since the last article, and whether one is open.
    state: list[tuple[bool, bool, bool, bool, bool]] = [(False, False, False, False, False)]

    def push(e: Element) -> None:
        boiler, hint, article, marked, link = state[-1]
        if e.name in ("article", "main"):
            boiler, hint, article = False, False, True
        stack.append(e)
        state.append((boiler or e.boiler and not (e.name == "header" and article), hint or e.hint, article, marked or e.marked, link or e.name == "a"))

    def end() -> None:
        if parts:
            text = [(html.unescape(t), link) for t, link in parts]
            whole = " ".join("".join(t for t, _ in text).split())
            if whole:
                linked = sum(len(t.split()) for t, link in text if link)
                boiler, hint, article, marked, _ = state[-1]
                out.append(Block(whole, len(whole.split()), linked, article, boiler or own.boiler, hint or own.hint, marked or own.marked))
            parts.clear()

    while at < len(page):
        tag = TAG.search(page, at)
        piece = page[at : tag.start() if tag else len(page)]
        if piece:
            parts.append((piece, state[-1][4]))
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if name in RAW and not tag[1]:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            parts.append((" ", False))
        elif name == "br":
            parts.append((" ", False))
        elif name in BLOCK or name == "a":
            if name in BLOCK:
                end()
                own = Element("")
            if tag[1]:
                if any(e.name == name for e in stack):
                    while True:
                        state.pop()
                        if stack.pop().name == name:
                            break
            elif name in HOLDS:
                if not tag[3].rstrip().endswith("/") and not (name == "a" and state[-1][4]):
                    push(element(name, tag[3] if name != "a" else ""))
            else:
                own = element(name, tag[3])
    end()
    return out


def feature_rows(found: list[Block]) -> np.ndarray:
    """``FEATURES`` of each block. article: 1 inside one, -1 outside on a page that has one, 0 on a page without. What a
    block's words say (notice, after_talk) counts outside of articles alone."""
    own = np.array([[b.words, b.linked / b.words] for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    has, text, talk, flags = any(b.article for b in found), False, False, []
    for b in found:
        talk = talk or text and b.words <= 5 and bool(TALK.search(b.text))  # a heading over what readers say, below some text
        text = text or b.words > 7 and not b.linked
        flags.append([1 if b.article else -1 if has else 0, b.boiler, b.hint, not b.article and b.words < 30 and bool(NOTICE.search(b.text)), talk and not b.article])
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], np.array(flags, dtype=float).reshape(-1, 5)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3) -> tuple:
    """A decision tree as (share of label 1) or (feature, limit, tree for at most the limit, tree for more), by Gini impurity."""
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return (float(y.mean()),)
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= limit
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(limit), low)
    if best is None:
        return (float(y.mean()),)
    _, k, limit, low = best
    return (k, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def trained(pages: list[str] | None = None, without: tuple[str, ...] = ()) -> tuple:
    """The tree grown from labelled pages (``labelled_pages`` by default); ``without``: features it may not use."""
    found = [blocks(p) for p in (labelled_pages() if pages is None else pages)]
    x = np.vstack([feature_rows(b) for b in found])
    x[:, [FEATURES.index(f) for f in without]] = 0
    return grow(x, np.array([float(b.marked) for bs in found for b in bs]))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, feature_rows(found), strict=True) if is_main(tree, row))


def extract_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page and a page without main text give an empty text. Null ids and urls and repeated rows are
    passed on; other columns are not looked at. A page is one task's matter, whatever its length.
    """
    tree = trained(labelled)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield rows_of(schema, page_id=batch.column(0), url=batch.column(1), text=texts, n_chars=[len(t) for t in texts])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return some.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
