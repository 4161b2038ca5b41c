"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags, each with its
ancestors (tag, class, id, role). The field labels each block as article or other; its features
are the ancestors' tags and attribute words, the block's own tag and counts of its text (words,
share of link text, punctuation, symbols), and it knows how labels follow each other. It is
trained by gradient ascent on the exact log likelihood (forward and backward sums) of a
generated set of labelled pages, a bounded set fixed by its seed, and decoded by Viterbi. The
weights are a small table sent to all tasks; pages are independent, so nothing is shuffled.

Scripts, styles, templates, comments and form controls are no text and never become blocks.
Character references are decoded; white space inside a block becomes one space; kept blocks are
joined by one space in page order.

Defined results: a null or empty page has an empty text; broken markup is read as browsers do
in the cases that matter here (unclosed and stray tags, attributes without quotes, an unclosed
comment or script takes the rest); repeated rows are extracted each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HASH_BITS = 12
TRAIN_PAGES = 240
EPOCHS = 30
SEED = 7

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements without text of the page, without an end tag, and inside a line of text.
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
#: An open p or li ends where one of these starts.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@lru_cache(maxsize=100_000)
def _feature(name: str) -> int:
    value = 2166136261
    for b in name.encode():
        value = (value ^ b) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) & ((1 << HASH_BITS) - 1)


@lru_cache(maxsize=20_000)
def _tag_features(name: str, words: tuple[str, ...]) -> frozenset[int]:
    return frozenset(map(_feature, (f"tag={name}", *(f"word={w}" for w in words))))


@lru_cache(maxsize=20_000)
def _own_features(seen: frozenset[int], name: str, words: tuple[str, ...], above: str) -> tuple[int, ...]:
    names = [f"own={name}", *(f"own-word={w}" for w in dict.fromkeys(words))] + ([f"parent={above}>{name}"] if above else [])
    return (*sorted(seen), *map(_feature, names))


class Block:
    """A leaf block: its text, the number of its characters inside links, and the features of its ancestors."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, linked: int, path: tuple[int, ...]) -> None:
        self.text, self.linked, self.path = text, linked, path


class Node:
    """An open element. ``seen`` has the features of its and its ancestors' tags and words.

    There are at most 2**HASH_BITS features, and an element that adds none shares its parent's
    set, so the work for a block doesn't grow with the depth of the page.
    """

    __slots__ = ("name", "path", "seen")

    def __init__(self, name: str, words: tuple[str, ...], parent: Node | None, above: str) -> None:
        self.name = name
        names = _tag_features(name, words)
        known = parent.seen if parent else frozenset()
        self.seen = known if names <= known else known | names
        self.path = _own_features(self.seen, name, words, above)



def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    # Open elements by name and, but for inline ones, by their node; how many of each name are open.
    stack: list[tuple[str, Node | None]] = []
    nodes: list[Node] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    links, linked, hidden, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, linked, nodes[-1].path if nodes else ()))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    def pop() -> None:
        nonlocal links, hidden
        name, node = stack.pop()
        opened[name] -= 1
        if node is not None:
            nodes.pop()
        links -= name == "a"
        hidden -= name in NO_TEXT

    # No tag ends behind the last bracket, so none is looked for there; only a comment can begin, and is open.
    end, last = len(page), page.rfind(">") + 1
    while at < end:
        token = _TOKEN.search(page, at, last)
        if token is None:
            open_comment = page.find("<!--", at)
            add(page[at : open_comment if open_comment >= 0 else end])
            break
        add(page[at : token.start()])
        at = token.end()
        if page.startswith("<!--", token.start()) and page.find("-->", token.start() + 4, at) != at - 3:
            at = end
        name = token.group(2)
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE and not hidden:
            close()
        if token.group(1):
            if opened[name]:
                # An inline end tag doesn't close blocks around it.
                if name in INLINE:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            links -= name == "a"
                            opened[name] -= 1
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                else:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            continue
        if name in _ENDS_P and opened["p"]:
            while stack[-1][0] != "p":
                pop()
            pop()
        if name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
            pop()
        if name == "body":
            while stack and stack[-1][0] in ("head", *NO_TEXT):
                pop()
        if name in ("script", "style"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            continue
        words: list[str] = []
        for m in _ATTRIBUTE.finditer(token.group(3) or ""):
            words += _WORD.findall((m.group(2) or m.group(3) or m.group(4) or "").lower())
        node = None
        if name not in INLINE:
            node = Node(name, tuple(words), nodes[-1] if nodes else None, nodes[-1].name if nodes else "")
            nodes.append(node)
        stack.append((name, node))
        opened[name] += 1
        links += name == "a"
        hidden += name in NO_TEXT
    close()
    return out


def features(page: list[Block]) -> list[tuple[int, ...]]:
    """Hashed binary features of each block."""
    out = []
    last = len(page) - 1
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        size = "1" if n < 2 else "5" if n < 6 else "15" if n < 16 else "40" if n < 41 else "more"
        names = ["bias", f"words={size}", f"links={4 * min(b.linked, len(b.text)) // max(1, len(b.text))}", f"stop={b.text[-1] in '.!?'}"]
        if i == 0:
            names.append("first")
        if i == last:
            names.append("last")
        if "©" in b.text:
            names.append("copyright")
        out.append((*b.path, *map(_feature, names)))
    return out


class Crf:
    """Two labels (0 other, 1 article): weights of features and of label pairs; start weights."""

    def __init__(self) -> None:
        self.state = np.zeros((1 << HASH_BITS, 2))
        self.pair = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, page: list[tuple[int, ...]]) -> np.ndarray:
        """Sums of the state weights of each block."""
        sizes = [len(f) for f in page]
        flat = self.state[np.fromiter((i for f in page for i in f), np.int64, sum(sizes))]
        return np.add.reduceat(flat, np.cumsum([0, *sizes[:-1]]), axis=0)

    def viterbi(self, page: list[tuple[int, ...]]) -> list[int]:
        """The likeliest labels."""
        if not page:
            return []
        scores = self.scores(page).tolist()
        (aa, ab), (ba, bb) = self.pair.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for sa, sb in scores[1:]:
            from_a, from_b = int(b + ba > a + aa), int(b + bb >= a + ab)
            back.append((from_a, from_b))
            a, b = sa + (b + ba if from_a else a + aa), sb + (b + bb if from_b else a + ab)
        label = int(b >= a)
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]

    def step(self, page: list[tuple[int, ...]], labels: list[int], rate: float, decay: float) -> None:
        """One gradient step on the log likelihood of a labelled page."""
        n = len(page)
        s = self.scores(page)
        s[0] += self.start
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = s[0]
        for i in range(1, n):
            forward[i] = s[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.pair, axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.pair + (s[i + 1] + backward[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        wrong = np.eye(2)[labels] - np.exp(forward + backward - total)
        np.add.at(self.state, np.fromiter((i for f in page for i in f), np.int64), np.repeat(rate * wrong, [len(f) for f in page], axis=0))
        self.start += rate * wrong[0]
        if n > 1:
            joint = np.exp(forward[:-1, :, None] + self.pair[None] + (s[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
            np.add.at(joint, (labels[:-1], labels[1:]), -1.0)
            self.pair -= rate * joint
        self.state *= 1 - decay


def labelled_page(r: random.Random) -> tuple[str, str]:
    """A generated page and its main text. Layouts, tags and attribute names vary; words are random."""

    def word() -> str:
        return "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        words = [word() for _ in range(r.randint(low, high))]
        return " ".join(words).capitalize() + r.choice(["."] * 8 + ["!", "?", "", ":"])

    def wrap(tag: str, names: list[str], inner: str) -> str:
        kind = r.choice(["class", "class", "id"])
        plain = tag in ("nav", "aside", "header", "footer", "article", "main", "form") and r.random() < 0.6
        return f"<{tag}>{inner}</{tag}>" if plain else f'<{tag} {kind}="{r.choice(names)}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{prose(1, 2).rstrip(".!?:")}</a></li>' for _ in range(n)) + "</ul>"

    menu = lambda: wrap(r.choice(["nav", "nav", "div", "ul"]), ["menu", "nav", "navbar", "main-menu", "breadcrumbs", "navigation", "breadcrumb", "topnav"], links(r.randint(3, 8)))
    header = lambda: wrap(r.choice(["header", "header", "div"]), ["header", "site-header", "masthead", "top", "banner"], f"<{(h := r.choice(['p', 'div', 'h2', 'span']))}>{prose(1, 5)}</{h}>" + (menu() if r.random() < 0.3 else ""))
    footer = lambda: wrap(r.choice(["footer", "footer", "div"]), ["footer", "site-footer", "bottom", "colophon", "copyright"], r.choice([f"&copy; {word()}.example {prose(0, 4)}", f"<p>{prose(2, 15)}</p>" + links(2), f"<p>&copy; 2024 {word()}</p>"]))
    side = lambda: wrap(r.choice(["aside", "aside", "div"]), ["sidebar", "side", "related", "widget", "recommended", "right-column", "newsletter", "share", "social", "tags"], f"<h3>{prose(1, 4)}</h3>" + r.choice([links(r.randint(2, 6)), f"<p>{prose(5, 40)}</p>", f"<p>{prose(5, 20)}</p><p>{prose(5, 20)}</p>"]))
    notice = lambda: wrap(r.choice(["div", "div", "section", "aside", "p"]), ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "disclaimer", "cookie-notice", "message"], r.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(prose(5, 40)))
    advert = lambda: wrap(r.choice(["div", "div", "aside", "section", "p"]), ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "ad-slot", "sponsor"], r.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(prose(3, 40)))
    form = lambda: f"<form>{r.choice(['', '<label>' + prose(1, 3) + '</label>'])}<p>{prose(2, 10)}</p><input type=text><button>{prose(1, 2)}</button></form>"
    comments = lambda: wrap(r.choice(["section", "div", "div"]), ["comments", "comment-list", "discussion", "responses", "reader-comments", "disqus", "replies"], f"<h3>{prose(1, 3)}</h3>" + "".join(wrap(r.choice(["div", "article", "li"]), ["comment", "reply", "comment-body", "response"], f"<p>{prose(3, 50)}</p>") for _ in range(r.randint(1, 4))))
    hidden = lambda: r.choice(["<script>var a='<p>no</p>';</script>", "<style>p{margin:0}</style>", "<!-- note -->", "<noscript>no</noscript>"])

    main: list[str] = []

    def article_block(tag: str) -> str:
        text = prose(1, 9) if tag[0] == "h" else prose(1, 90)
        if r.random() < 0.15:
            text = text.replace(" ", " &amp; ", 1)
        main.append(entities.unescape(text))
        if r.random() < 0.2 and " " in text:
            a, _, b = text.partition(" ")
            text = f"<{(t := r.choice(['b', 'em', 'a', 'span', 'strong']))}>{a}</{t}> {b}"
        return f"<{tag}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>")

    body = [article_block(r.choice(["h1", "h1", "h2", "p"]))]
    for _ in range(r.randint(1, 12)):
        roll = r.random()
        if roll < 0.72:
            body.append(article_block("p"))
        elif roll < 0.8:
            body.append(article_block(r.choice(["h2", "h3", "blockquote", "pre"])))
        elif roll < 0.86:
            body.append("<ul>" + "".join(article_block("li") for _ in range(r.randint(1, 4))) + "</ul>")
        elif roll < 0.89:
            body.append("<table><tr>" + "".join(article_block("td") for _ in range(r.randint(1, 3))) + "</tr></table>")
        else:
            body.append(r.choice([advert, side, notice, hidden, form])())
    inner = "".join(body)
    names = ["content", "post", "article", "entry-content", "main", "post-body", "story", "text", "article-body", "page-content", "main-content"]
    around = r.choice(["article", "article", "main", "div", "section", "both"])
    inner = f"<main>{wrap('article', names, inner)}</main>" if around == "both" else wrap(around, names, inner) if around != "article" else f"<article>{inner}</article>"
    before = [f() for f in (header, menu, notice, advert, side, hidden, form) if r.random() < 0.4]
    after = [f() for f in (side, comments, form, advert, notice, footer, menu, hidden) if r.random() < 0.4]
    r.shuffle(before)
    page = "".join(before) + inner + "".join(after) + (footer() if r.random() < 0.5 else "")
    if r.random() < 0.3:
        page = wrap("div", ["wrapper", "container", "page", "site", "layout"], page)
    head = f"<head><meta charset=utf-8><title>{prose(2, 6)}</title>{hidden()}</head>"
    return f"<!DOCTYPE html><html lang=en>{head}<body>{page}" + ("</body></html>" if r.random() < 0.9 else ""), " ".join(" ".join(main).split())


def _labels(page: list[Block], text: str) -> list[int]:
    """The blocks that make up the main text, in order."""
    out, at = [], 0
    for b in page:
        hit = text.startswith(b.text, at) and (at + len(b.text) == len(text) or text[at + len(b.text)] == " ")
        out.append(int(hit))
        at += (len(b.text) + 1) * hit
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Crf:
    """The field, fitted to the generated labelled pages."""
    r = random.Random(seed)
    rows = []
    for _ in range(pages):
        page, text = labelled_page(r)
        found = blocks(page)
        rows.append((features(found), _labels(found, text)))
    crf = Crf()
    for epoch in range(epochs):
        r.shuffle(rows)
        for page, labels in rows:
            crf.step(page, labels, 0.15 / (1 + epoch / 4), 1e-5)
    return crf


def main_text(page: str, crf: Crf) -> str:
    """The article's text."""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, crf.viterbi(features(found)), strict=True) if label)


def extracted(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", shared.value) for page in batch.column("html")]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_crf_extract": op7_crf_extract}
#: A reader of the given pages by their rule, without a model: the text is that of their one article.
_RULE = r"""WITH own AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h1|p|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM own),
decoded AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded"""
ORACLES = {"op7_crf_extract": _RULE}
