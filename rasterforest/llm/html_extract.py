"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (text between block-level boundaries), each
with the tags and name words of its ancestors and some measures of its text. The chain's
weights come from labelled pages; Viterbi decoding says which blocks are the article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, returning_memory

# Elements by their part in the layout.
BLOCKS = frozenset("html head body title article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address hr details summary dialog menu center option select button label textarea noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
SILENT = frozenset("script style template iframe".split())
#: A start tag of a key closes an open element of its values, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "body": ("head",)}
STOPS = frozenset("ul ol dl table select body html article section div main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Leaf:
    """A leaf block: its text, the words of its ancestors, and how much of it is links."""

    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int = 0
    hidden: bool = False


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


def leaves(page: str | None) -> list[Leaf]:
    """Leaf blocks in page order. Unclosed, misnested and unknown tags are tolerated."""
    page = (page or "").replace("\x00", "")
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked, inside_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            tags = tuple(t for t, *_ in stack)
            out.append(Leaf(text, tags, tuple(n for _, names, _ in stack for n in names), linked, any(h for *_, h in stack)))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(html.unescape(text))
            linked += len(parts[-1].strip()) if inside_link else 0

    def pop_to(i: int) -> None:
        if any(t in BLOCKS for t, *_ in stack[i:]):
            flush()
        del stack[i:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        end, start, attrs = m.groups()
        if end:
            tag = end.lower()
            inside_link = 0 if tag == "a" else inside_link
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
        elif start:
            tag = start.lower()
            if tag in SILENT or tag == "textarea":
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if not attrs.rstrip().endswith("/") or tag in ("script", "style"):
                    at = close.end() if close else len(page)
                if tag in BLOCKS:
                    flush()
                continue
            if tag in ("br", "wbr", "img", "input"):
                parts.append(" " if tag != "wbr" else "")
                continue
            if tag in BLOCKS:
                flush()
                inside_link = 0
                for i in range(len(stack) - 1, -1, -1):
                    # A block element ends an open paragraph, and with it what is open inside.
                    if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                        pop_to(i)
                        if tag not in CLOSES:
                            break
                    elif stack[i][0] in STOPS:
                        break
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
                continue
            got = attributes(attrs) if attrs.strip() else {}
            names = tuple(w.lower() for k in ("class", "id", "role", "itemprop") for w in NAME_WORD.findall(got.get(k, "")))
            hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
            stack.append((tag, names, hidden))
            inside_link = 1 if tag == "a" else inside_link
    flush()
    return out


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Names of each block's active features."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        last = b.text[-1]
        f = ["bias", f"size:{min(int(math.log2(size + 1)), 10)}", f"links:{min(4, 5 * b.linked // max(size, 1))}", f"end:{'stop' if last in '.!?…' else 'other'}"]
        f += [f"tag:{t}" for t in set(b.tags)] + [f"own:{next((t for t in reversed(b.tags) if t in BLOCKS), '')}"]
        f += [f"name:{w}" for w in set(b.names)]
        f += [f"at:{5 * i // n}", f"words:{min(5, b.text.count(' ') // 4)}"]
        f += ["hidden"] * b.hidden
        f += ["sign"] * any(c in b.text[:40] for c in "©®|»")
        out.append(f)
    return out


@dataclass(frozen=True)
class Chain:
    """Weights: of features for the article state, of the first block's state, and of steps between states."""

    weights: dict[str, float]
    steps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    first: tuple[float, float] = (0.0, 0.0)

    def potentials(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([[0.0, sum(self.weights.get(f, 0.0) for f in row)] for row in rows]).reshape(-1, 2)

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The most probable states; 0 is boilerplate and wins ties."""
        if not rows:
            return []
        e, steps = self.potentials(rows), np.array(self.steps).reshape(2, 2)
        best, back = e[0] + np.array(self.first), []
        for x in e[1:]:
            paths = best[:, None] + steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + x
        state = int(best.argmax())
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Maximum likelihood by adaptive gradient steps; expectations by forward-backward."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    w, g2 = np.zeros(len(index) + 6), np.full(len(index) + 6, 1e-2)
    coded = [([np.array([index[f] for f in row]) for row in rows], np.array(states)) for rows, states in pages if rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(coded)):
            rows, y = coded[k]
            n, steps, first = len(rows), w[-6:-2].reshape(2, 2), w[-2:]
            e = np.array([[0.0, w[r].sum()] for r in rows])
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = first + e[0]
            for i in range(1, n):
                a[i] = np.logaddexp(a[i - 1, 0] + steps[0], a[i - 1, 1] + steps[1]) + e[i]
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp(steps[:, 0] + e[i + 1, 0] + b[i + 1, 0], steps[:, 1] + e[i + 1, 1] + b[i + 1, 1])
            z = np.logaddexp(*a[-1])
            p = np.exp(a + b - z)
            grad = np.zeros(len(w))
            np.add.at(grad, np.concatenate(rows), np.repeat(y - p[:, 1], [len(r) for r in rows]))
            if n > 1:
                pair = np.exp(a[:-1, :, None] + steps[None] + (e + b)[1:, None, :] - z)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                grad[-6:-2] = (seen - pair.sum(axis=0)).ravel()
            grad[-2:] = np.eye(2)[y[0]] - p[0]
            grad -= decay * w
            g2 += grad * grad
            w += rate * grad / np.sqrt(g2)
    return Chain({f: float(w[i]) for f, i in index.items()}, tuple(w[-6:-2].tolist()), tuple(w[-2:].tolist()))


# Containers that label the training pages. Article containers hold the main
# text; the others hold what surrounds it, wherever they stand.
ARTICLE = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-text"', 'section class="story"', 'div class="main-text"', 'div role="main"', "div", "section", 'div itemprop="articleBody"')
AROUND = ("nav", "header", "footer", "aside", "form", 'div class="ad"', 'div class="ads banner"', 'div class="sidebar"', 'div id="menu"', 'ul class="menu"', 'div class="nav-bar"', 'div class="cookie-notice"', 'div id="cookie-consent"', 'div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="reader-comments"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored promo"', 'div class="newsletter signup"', 'div class="related"', 'div class="share social"', 'div class="breadcrumbs"', 'div class="footer"', 'div class="page-header"', 'div class="notice"', 'div class="popup modal"', 'div class="widget"', 'div role="navigation"', 'aside class="sidebar"', 'div class="login-form"', 'div class="copyright legal"', 'div class="tags"', 'div class="alert banner"', "noscript", 'div class="subscribe"', 'div class="skip-links"')
SURROUNDING = frozenset("nav header footer aside form noscript head title button select option label".split())
AROUND_NAMES = frozenset(w.lower() for a in AROUND for v in re.findall(r'"([^"]*)"', a) for w in NAME_WORD.findall(v)) - {"page", "list", "reader", "text", "bar", "links"}


def marked(block: Leaf) -> int:
    """A labelled page's own mark: inside its article element, outside what surrounds it."""
    return int(("article" in block.tags or "main" in block.tags) and not SURROUNDING.intersection(block.tags) and not AROUND_NAMES.intersection(block.names) and not block.hidden)


def rebuilt(blocks: list[Leaf], rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """A labelled page of the same texts in other containers, some of them inside the article's."""
    text = [html.escape(b.text) for b in blocks if marked(b)]
    other = [html.escape(b.text) for b in blocks if not marked(b)] or ["Home", "Contact"]

    def around() -> str:
        box = AROUND[rng.integers(len(AROUND))]
        inner = "".join(f"<{t}>{other[rng.integers(len(other))] if rng.random() < 0.6 or not text else text[rng.integers(len(text))]}</{t}>" for t in rng.choice(["p", "li", "div", "span", "a", "h3", "button", "p"], size=rng.integers(1, 5)))
        return f"<{box}>{inner}</{box.split()[0]}>"

    box = ARTICLE[rng.integers(len(ARTICLE))]
    body = []
    for i, t in enumerate(text):
        tag = "h1" if i == 0 and rng.random() < 0.6 else rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div"])
        body.append((f"<{tag}>{t}</{tag}>", 1))
        if rng.random() < 0.15:
            body.append((around(), 0))
    page = [(around(), 0) for _ in range(rng.integers(1, 4))] + [(f"<{box}>", None), *body, (f"</{box.split()[0]}>", None)] + [(around(), 0) for _ in range(rng.integers(1, 4))]
    # Marks by parsing: every surrounding box carries an element that only the labels see.
    source = "".join(p if mark != 0 else f"<x-out>{p}</x-out>" for p, mark in page)
    found = leaves(f"<html><head><title>{text[0] if text else ''}</title></head><body>{source}</body></html>")
    states = [int("x-out" not in b.tags and "title" not in b.tags) for b in found]
    for b in found:
        b.tags = tuple(t for t in b.tags if t != "x-out")
    return features(found), states


def fit(pages: DataFrame, sample: int = 400, variants: int = 2, seed: int = 3, longest: int = 1 << 18) -> Chain:
    """A chain from at most `sample` pages (by a hash of their ids) that mark their article, and variants of each.

    Pages without an article element only tell what surrounds one. If no page is marked,
    the variants are built from a few words. Pages of more than `longest` characters aren't
    learned from, so that the driver holds sample * longest characters at most.
    """
    # The ids are chosen first, so that tasks send ids and not pages to be compared.
    known = pages.where((F.length("html") <= longest) & F.col("page_id").isNotNull())
    ids = known.select(F.col("page_id").alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(sample)
    rows = known.join(F.broadcast(ids), F.col("page_id") == F.col("_chosen")).select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample).collect()
    rows.sort(key=lambda r: (r["page_id"], r["html"]))
    rng, labelled = np.random.default_rng(seed), []
    for r in rows:
        blocks = leaves(r["html"])
        if not any(map(marked, blocks)):
            continue
        labelled.append((features(blocks), [marked(b) for b in blocks]))
        labelled += [rebuilt(blocks, rng) for _ in range(variants)]
    if not labelled:
        few = leaves("<nav><a>Home</a></nav><article><h1>One title</h1><p>Some words of a first sentence, then more of them.</p><p>A second sentence.</p></article><footer>© Us</footer>")
        labelled = [(features(few), [marked(b) for b in few])] + [rebuilt(few, rng) for _ in range(200)]
    return train(labelled)


def extract(pages: DataFrame, chain: Chain, keep_html: bool = True) -> DataFrame:
    """The columns of pages with text and n_chars (code points), the article's blocks joined by newlines.

    pages: html and any others (text and n_chars of the same name are replaced). Null, empty
    and text-free pages give '' and 0; repeated rows give repeated results; an empty table
    gives no rows. Whole pages are parsed, of any length. Without keep_html the column html
    isn't returned, so it needn't leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, texts = batch.slice(begin, 256), []
                for source in part.column("html").to_pylist():
                    blocks = leaves(source)
                    texts.append("\n".join(b.text for b, s in zip(blocks, chain.viterbi(features(blocks))) if s))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string()), sizes], [*names, "text", "n_chars"])

    kept = pages.drop("text", "n_chars")
    names = [n for n in kept.columns if keep_html or n != "html"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names)
    return in_small_batches(kept).mapInArrow(returning_memory(run), f"{fields}, text string, n_chars long")
