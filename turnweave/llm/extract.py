"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block is described by the word count and link density
of itself and of both neighbours; by whether a button or field stands beside it; and by marks of its tag path: a side part
by its element (menu, footer, ...) or by what its class, id or role says of it, a main part, a heading, a list item. Names
may mislead or mean nothing, so they are features like the others: the share of the page's words that a so-called side part
holds, whether its name says main part as well, and whether another element is marked as the main part, go with them. A CART tree over these features says which blocks are the
article.

The tree is trained on ``labelled_pages``, a small table labelled by hand, from which ``TRAINING_PAGES`` pages are put
together: the article of one page among side parts of several, also with meaningless names, without semantic elements, with
the article's element named after a side part, and with other lengths of texts. The table does not depend on the input.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .labelled_pages import PAGES

# Element names and hint words.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = _BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr html body option optgroup title tr td th tbody thead tfoot dd dt caption legend summary".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_DROPPED = frozenset("head noscript template svg select button object canvas audio video map math datalist".split())
_SIDE_TAGS = frozenset("nav aside footer form dialog menu fieldset search".split())
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs commentlist cookie cookies consent copyright "
    "disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion promotions recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets alert overlay contentinfo complementary form werbung anzeige publicidad publicite".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies responses kommentare commentaires comentarios".split())
_MAIN_WORDS = frozenset("article content main post entry story body text artikel".split())
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_](?:left[-_]|right[-_])?[a-z]+", re.I)

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_SIDE, _HARD, _MAIN, _HEADING, _ITEM, _MIXED = 1, 2, 4, 8, 16, 32
_CONTROLS = frozenset("button input textarea select".split())

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "controls",
    "side", "hard", "mixed", "share", "main", "elsewhere", "heading", "item",
)
TRAINING_PAGES, DEPTH, LEAF = 1500, 8, 30
_ARTICLE = "¶"


@lru_cache(1 << 14)
def _hints(tag: str, attributes: str) -> int:
    """What an element says of itself: side part (or a firm one), main part."""
    found, words = 0, ""
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found |= _SIDE | _HARD
        elif name in ("class", "id", "role", "itemprop"):
            words += " " + value
    parts = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", _LAYOUT.sub(" ", words)).lower()))
    main = parts & _MAIN_WORDS
    side = parts & _SIDE_WORDS
    if parts & _COMMENT_WORDS:
        found |= _SIDE | _HARD
    elif side and not (main and side <= {"header"}):
        found |= _SIDE | _MIXED * bool(main)
    elif main and not side:
        found |= _MAIN
    if tag in _SIDE_TAGS:
        found |= _SIDE | _HARD
    elif tag in ("article", "main") and not found & _SIDE:
        found |= _MAIN
    return found


def _inherited(tag: str, attributes: str, above: int) -> int:
    own = _hints(tag, attributes)
    if tag == "header" and not above & _MAIN:
        own |= _SIDE
    state = above & (_SIDE | _HARD | _MAIN | _MIXED)
    if tag == "main" and own & _MAIN:
        state = _MAIN
    elif own & _MAIN and (tag == "article" and not state & _HARD or not state & _SIDE):
        state = _MAIN
    if own & _SIDE:
        state = state & ~_MAIN | own & (_SIDE | _HARD | _MIXED if not above & _SIDE else _SIDE | _HARD)
    return state


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The page's text blocks in order, white space squeezed, and their features (one row each)."""
    texts: list[str] = []
    counts: list[tuple] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # open containers: tag, and the state, side part and number around them
    parents = [0]  # of each container by number; 0 is the page
    controls: set[int] = set()
    dropped: list[str] = []
    state = leaf = side_part = n_parts = here = 0
    link, link_depth, words_linked = False, 0, 0

    def flush():
        nonlocal parts, words_linked
        if parts:
            words = "".join(parts).split()
            if words:
                texts.append(" ".join(words))
                mark = leaf if leaf & _SIDE else state | leaf
                counts.append((len(words), min(words_linked, len(words)), mark, here, side_part))
            parts, words_linked = [], 0

    def text(a: int, b: int):
        nonlocal words_linked
        if a < b and not dropped:
            piece = page[a:b]
            if "&" in piece:
                piece = unescape(piece)
            parts.append(piece)
            if link:
                words_linked += len(piece.split())

    def close(k: int):
        nonlocal state, side_part, here
        _, state, side_part, here = stack[k]
        del stack[k:]

    at = 0
    while m := _TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if tag in _DROPPED:
                if tag in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
            elif tag == "a":
                link = False
            elif tag in _BLOCKS:
                flush()
                leaf = 0
                if tag in _CONTAINERS:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            close(k)
                            link = link and link_depth <= k
                            break
            continue
        if tag in _CONTROLS:
            controls.add(here)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in _DROPPED and not attributes.endswith("/"):
            if tag == "head" or not dropped:
                flush()
            dropped.append(tag)
        elif tag == "body":
            dropped.clear()
            flush()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            link, link_depth = True, len(stack)
        elif tag in _BLOCKS:
            flush()
            leaf = 0
            if tag in _CONTAINERS:
                if tag == "li":
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in ("ul", "ol", "menu", "dir"):
                            break
                        if stack[k][0] == "li":
                            close(k)
                            break
                stack.append((tag, state, side_part, here))
                parents.append(here)
                here = len(parents) - 1
                inner = _inherited(tag, attributes, state)
                if inner & _SIDE and not state & _SIDE:
                    n_parts += 1
                    side_part = n_parts
                state = inner | (_ITEM if tag == "li" else state & _ITEM if tag not in ("article", "main", "section") else 0)
            else:
                leaf = (_hints(tag, attributes) & (_SIDE | _MIXED) if attributes else 0) | (_HEADING if tag[0] == "h" and tag[1:].isdigit() else 0)
    text(at, len(page))
    flush()
    return texts, _features(counts, parents, controls)


def _features(counts: list[tuple], parents: list[int], controls: set[int]) -> np.ndarray:
    n = len(counts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if n:
        words, linked, mark, box, part = np.array(counts, np.int64).T
        parent = np.array(parents)
        out[:, 0], out[:, 1] = words, linked / words
        out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
        beside = np.zeros(len(parents), bool)
        beside[list(controls)] = True
        beside[0] = False
        out[:, 6] = beside[box] | beside[parent[box]]
        for name, bit in (("side", _SIDE), ("hard", _HARD), ("mixed", _MIXED), ("main", _MAIN), ("heading", _HEADING), ("item", _ITEM)):
            out[:, FEATURES.index(name)] = mark & bit > 0
        free, inside = words - linked, mark & _MAIN > 0
        held = np.bincount(part, free)[part] / max(1, int(free.sum()))
        out[:, FEATURES.index("elsewhere")] = ~inside & inside.any()
        out[:, FEATURES.index("share")] = np.where((mark & _SIDE > 0) & (part > 0), held, 0)
    return out


class Tree:
    """Binary CART tree by Gini impurity. Rows with feature <= cut go left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
        self.feature, self.cut, self.left, self.right, self.share = [], [], [], [], []
        self._grow(x, y.astype(np.float64), depth, leaf)
        self.feature, self.left, self.right = (np.array(v, np.int64) for v in (self.feature, self.left, self.right))
        self.cut, self.share = np.array(self.cut, np.float32), np.array(self.share)

    def _grow(self, x, y, depth, leaf) -> int:
        me = len(self.feature)
        for v, first in ((self.feature, -1), (self.cut, 0), (self.left, me), (self.right, me), (self.share, y.mean() if len(y) else 0)):
            v.append(first)
        best = self._split(x, y, leaf) if depth and 0 < y.sum() < len(y) else None
        if best:
            f, c = best
            low = x[:, f] <= c
            self.feature[me], self.cut[me] = f, c
            self.left[me] = self._grow(x[low], y[low], depth - 1, leaf)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, leaf)
        return me

    @staticmethod
    def _split(x, y, leaf):
        n, best, found = len(y), 2 * y.mean() * (1 - y.mean()) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, up = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= leaf) & (n - k >= leaf)
            if ok.any():
                p, q = up[:-1] / k, (up[-1] - up[:-1]) / (n - k)
                gini = np.where(ok, (2 * k * p * (1 - p) + 2 * (n - k) * q * (1 - q)) / n, 9)
                i = int(gini.argmin())
                if gini[i] < best:
                    best, found = gini[i], (f, (v[i] + v[i + 1]) / 2)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while len(x) and (inner := self.feature[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(x[inner, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.share[node] >= 0.5


_NAMED = re.compile(r"""\b(class|id|role)="([^"]*)\"""")
_SEMANTIC = re.compile(r"<(/?)(?:nav|aside|footer|header|main|article|section|form)\b")
_OWN = re.compile(f"<p>({_ARTICLE}[^<]+)</p>")
_PROSE = re.compile(r"(?<!</a)>(?<!<a>)([^<]+)(?!</a>)(?=<)")


def variant(page: str, rng: random.Random, opaque: bool = False, plain: bool = False, misnamed: bool = False, lengths: int = 0) -> str:
    """A labelled page with meaningless names (``opaque``), without semantic elements (``plain``), with the element around the
    article's first block named after a side part (``misnamed``), or with longer and shorter texts (``lengths`` 1: somewhat, 2: of
    any length from a word on)."""
    if plain:
        page = _SEMANTIC.sub(lambda m: f"<{m[1]}div", page)
    if opaque:
        names: dict[str, str] = {}
        page = _NAMED.sub(lambda m: f'class="{names.setdefault(m[2], "".join(rng.choice("bcdghjklqvxz") for _ in range(5)))}"', page)
    if misnamed:
        before = list(re.finditer(r"<(div|section)\b[^>]*>", page[: page.index(_ARTICLE)]))
        if before and "article" not in page and "<main" not in page:
            m = before[-1]
            page = f'{page[: m.start()]}<{m[1]} class="{rng.choice(sorted(_SIDE_WORDS))}">{page[m.end() :]}'
    if lengths:

        def scaled(m):
            words = m[1].split()
            if not words or rng.random() < 0.3:
                return m[0]
            mark, words = (_ARTICLE, [words[0][1:], *words[1:]]) if words[0][0] == _ARTICLE else ("", words)
            n = round(2 ** rng.uniform(0, 7)) if lengths > 1 else max(1, round(len(words) * rng.choice((0.4, 0.7, 1.5, 3))))
            return f">{mark}{' '.join(words[k % len(words)] for k in range(n))}"

        page = _PROSE.sub(scaled, page)
    if lengths > 1:  # where marks tell the article, a block of it may also be one link or a word
        page = _OWN.sub(lambda m: m[0] + rng.choice(("", "", "", f'<p><a href="/x">{m[1]}</a></p>', f"<p>{' '.join(m[1].split()[:2])}</p>", f"<blockquote>{m[1]}</blockquote>")), page)
    return f"<html><body>{page}</body></html>"


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled page's blocks; the marks are taken off first."""
    texts, _ = blocks(page)
    _, x = blocks(page.replace(_ARTICLE, ""))
    return x, np.array([t.startswith(_ARTICLE) for t in texts], bool)


def elements(page: str) -> tuple[list[str], list[str], list[str]]:
    """A labelled page's outermost elements: those before its article, the article's, and those behind it."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(r"<(/?)([a-z0-9]+)[^>]*>", page):
        if m[2] not in ("br", "input", "hr", "img"):
            depth += -1 if m[1] else 1
        if not depth:
            out.append(page[begin : m.end()].strip())
            begin = m.end()
    own = [k for k, e in enumerate(out) if _ARTICLE in e]
    return out[: own[0]], [out[k] for k in own], [e for k, e in enumerate(out) if k > own[0] and k not in own]


def training_table(n: int = TRAINING_PAGES, seed: int = 0, pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``n`` pages, each the article of one labelled page among side parts of several."""
    rng, found = random.Random(seed), []
    parts = [elements(p) for p in pages]
    before, behind = ([e for p in parts for e in p[k]] for k in (0, 2))
    for _ in range(n):
        k = rng.randrange(len(pages))
        page = pages[k]
        if rng.random() < 0.8:
            page = "\n".join(rng.sample(before, rng.randint(0, 4)) + parts[k][1] + rng.sample(behind, rng.randint(0, 5)))
        marks = rng.random()  # where names and elements tell the parts, lengths may be any
        told = 0.4 < marks < 0.9
        found.append(labelled(variant(page, rng, opaque=marks < 0.25, plain=0.15 < marks < 0.35, misnamed=marks > 0.9, lengths=2 if told else rng.choice((0, 1)))))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


@lru_cache(1)
def trained(n: int = TRAINING_PAGES, seed: int = 0) -> Tree:
    return Tree(*training_table(n, seed))


def extract(pages: DataFrame, html: str = "html", columns: tuple[str, ...] | None = None, tree: Tree | None = None) -> DataFrame:
    """``columns`` (all but ``html`` if not named) with ``text``, the article's blocks joined by blank lines, and ``n_chars``, its code points.

    Columns that clash get a trailing ``_`` for the results. Null or empty html: empty text. Broken markup is read as far
    as it goes: what isn't closed ends with what holds it. Repeated rows stay. Empty table: no rows. No shuffle.
    """
    ship(pages.sparkSession)
    tree = tree or trained()
    kept = [c for c in pages.columns if c != html] if columns is None else list(columns)
    taken = {c.lower() for c in kept}
    names = [n + "_" * (n in taken) for n in ("text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("__html"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(names[0]), F.lit(0).cast("long").alias(names[1])).schema

    def read(batches):
        for batch in batches:
            out = []
            for page in batch.column(batch.num_columns - 1):
                texts, x = blocks(page.as_py() or "")
                out.append("\n\n".join(t for t, keep in zip(texts, tree.predict(x).tolist(), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*kept, *names])

    return source.mapInArrow(read, schema)
