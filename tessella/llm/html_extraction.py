"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with
its open elements. Binary features come from the ancestor tags, from words in
their class, id and role, and from the text itself; a two-label chain (main, not)
is trained by stochastic gradient on labelled pages and decoded by Viterbi. The
blocks labelled main, in page order, make the text.

Scripts, styles, comments, the head and markup never reach a block; a head that
is not closed ends at the first tag or text that can't stand in it. Character
references are decoded, white space in a block is one space, blocks are joined
by an empty line; nothing else is dropped, and no page is cut short. Reading takes
time in proportion to the page, however deep its elements and broken its markup.

Defined cases: null or blank html gives the empty text; broken markup is read
like a browser would where that is cheap (unclosed and stray tags, comments
without end); repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.html_pages import labelled_pages

#: Bound of the training set.
TRAINING_PAGES, EPOCHS = 900, 8
#: HTML elements by how they are read.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript template svg canvas object textarea title".split())
_HEAD = frozenset("html head base basefont bgsound link meta".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
_SELF_CLOSERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("table ul ol dl td th div section article main aside body".split())
_BLOCKS = frozenset("html body thead tbody tfoot caption colgroup tr td th li dt dd option select button legend summary".split()) | _P_CLOSERS
#: Quoted values of a tag that are looked past for its end; one with more ends at its first >.
QUOTED = 100
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Words that name parts of a page.
_HINTS = frozenset(
    "ad ads advert advertisement alert article aside banner body bottom breadcrumb breadcrumbs comment comments consent content cookie copyright dialog disclaimer discussion disqus entry footer form gdpr google header main masthead menu modal most nav navbar navigation newsletter node notice notification page pager pagination paywall popup post promo promotion reader recommended related replies reply responses share side sidebar site social sponsor sponsored story subscribe tags text toolbar top topnav trending widget".split()
)
_TEXT_WORDS = re.compile(r"cookie|subscribe|newsletter|sign up|log ?in|all rights reserved|copyright|©|privacy|terms of|advert|accept", re.I)


class Block:
    __slots__ = ("text", "own", "tags", "hints", "linked", "at")

    def __init__(self, text: str, own: str, tags: frozenset, hints: frozenset, linked: int, at: int):
        self.text, self.own, self.tags, self.hints, self.linked, self.at = text, own, tags, hints, linked, at


def _hints(attributes: str) -> frozenset:
    if not attributes or "=" not in attributes:
        return frozenset()
    return frozenset(p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "") if p.lower() in _HINTS)


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place after the tag whose attributes begin at `at`, past > in quoted values; -1 if the tag has no end."""
    start = at
    for _ in range(QUOTED):
        if at > last[">"]:
            break
        at = _PLAIN.match(page, at).end()
        if at >= len(page):
            break
        mark = page[at]
        if mark == ">":
            return at + 1
        if at >= last[mark]:  # no closing quote
            break
        at = page.index(mark, at + 1) + 1
    return page.index(">", start) + 1 if start <= last[">"] else -1


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, stop, "/" of an end tag, name, attributes) of tags; what holds no text of the page (comments, scripts) has no name."""
    at, last = page.find("<"), {x: page.rfind(x) for x in ">\"'"}
    while at >= 0:
        stop = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            stop = len(page) if end < 0 else end + 3
            yield at, stop, "", "", ""
        elif m := _TAG.match(page, at):
            stop = _tag_end(page, m.end(), last)
            if stop > 0:
                slash, name, attributes = m[1], m[2].lower(), page[m.end() : stop - 1]
                if name in _RAW and not slash:
                    if not (name == "svg" and attributes.endswith("/")):
                        end = _RAW_END[name].search(page, stop)
                        stop = end.end() if end else len(page)
                    name = ""
                yield at, stop, slash, name, attributes
        elif page[at + 1 : at + 2] in ("!", "?", "/") and at < last[">"]:
            stop = page.index(">", at) + 1
            yield at, stop, "", "", ""
        at = page.find("<", stop if stop > 0 else at + 1)


class _Open:
    """The open elements, with where each name is open and what the path to each says."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[tuple[str, frozenset, frozenset]] = [("none", frozenset(), frozenset())]  # innermost block, known blocks, hints
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, name: str, attributes: str) -> None:
        own, tags, hints = self.paths[-1]
        if name not in _INLINE:
            self.blocks.append(len(self.names))
            own = name if name in _BLOCKS else "other"
            tags = tags if own in tags else tags | {own}
        more = _hints(attributes)
        self.where[name].append(len(self.names))
        self.names.append(name)
        self.paths.append((own, tags, hints if more <= hints else hints | more))

    def cut(self, depth: int) -> None:
        """Close all but the outermost `depth` elements."""
        while len(self.names) > depth:
            self.where[self.names.pop()].pop()
            self.paths.pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def last(self, names) -> int:
        return max((self.where[x][-1] for x in names if self.where[x]), default=-1)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    if not page:
        return []
    out: list[Block] = []
    now, parts = _Open(), []
    linked = begun = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, *now.paths[-1], min(linked, len(text)), begun))
            parts.clear()
        linked = 0

    def head() -> int:
        """Depth of a head that is open at the top of the page, or -1."""
        at = now.last(("head",))
        return at if 0 <= at < 3 and now.names[0] in ("html", "head") else -1

    def keep(text: str, at: int) -> None:
        nonlocal linked, begun
        if now.where["head"] and head() >= 0:
            if not text.strip():
                return
            now.cut(head())
        if text:
            if not parts:
                begun = at
            parts.append(text)
            if now.where["a"]:
                linked += len(text.strip())

    def close(names, scopes=()) -> None:
        at = now.last(names)
        if at >= 0 and at > now.last(scopes):
            flush()
            now.cut(at)

    last = 0
    for start, stop, slash, name, attributes in tokens(page):
        if start > last:
            keep(page[last:start], last)
        last = stop
        if not name:
            continue
        if not slash and name not in _HEAD and now.where["head"] and head() >= 0:
            now.cut(head())
        if name == "br":
            keep(" ", start)
        elif slash:
            at = now.last((name,))
            if name in _INLINE:  # an end tag closes no block around it
                if at >= 0 and (not now.blocks or at > now.blocks[-1]):
                    now.cut(at)
            else:
                flush()
                if at >= 0:
                    now.cut(at)
        elif name in _INLINE:
            if name not in _VOID and not attributes.endswith("/"):
                now.push(name, attributes)
        else:
            flush()
            if name in _P_CLOSERS:
                close(("p",), _SCOPES)
            if name in _SELF_CLOSERS:
                close(_SELF_CLOSERS[name], ("ul", "ol", "dl", "table"))
            if name not in _VOID and not attributes.endswith("/"):
                if name in _P_CLOSERS:  # formatting left open does not reach into the next block
                    while now.names and now.names[-1] in _INLINE and now.names[-1] != "a":
                        now.cut(len(now.names) - 1)
                now.push(name, attributes)
    keep(page[last:], last)
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    anchors = {t for b in found for t in b.tags} & {"article", "main"}
    rows = []
    for i, b in enumerate(found):
        tags, own = b.tags, b.own
        inside = "article" if "article" in tags else "main" if "main" in tags else "none"
        row = [f"own={own}", f"in={inside}", f"page={'+'.join(sorted(anchors)) or 'none'}", f"in={inside}|page={len(anchors)}"]
        row += [f"tag={t}" for t in tags] + [f"hint={h}" for h in b.hints]
        row += [f"tag={t}|in={inside}" for t in tags & {"header", "footer", "section", "aside", "form", "nav"}]
        n, linked = len(b.text), b.linked / len(b.text)
        row.append("size=" + ("0" if n < 25 else "1" if n < 80 else "2" if n < 200 else "3"))
        row.append("links=" + ("0" if linked == 0 else "1" if linked < 0.4 else "2" if linked < 0.8 else "3"))
        if b.text[-1] in ".!?":
            row.append("ends")
        if n < 200 and _TEXT_WORDS.search(b.text):
            row.append("phrase")
        if i == 0:
            row.append("first")
        if i == len(found) - 1:
            row.append("last")
        rows.append(row)
    return rows


class ChainField:
    """Two-label linear-chain CRF with binary features; label 1 is main text."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adaptive stochastic gradient on the log likelihood, with weight decay."""
        for rows, _ in pages:
            for row in rows:
                for name in row:
                    self.index.setdefault(name, len(self.index))
        self.weight = np.zeros((len(self.index), 2))
        coded = [([np.array([self.index[x] for x in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
        past = [np.full_like(x, 1e-2) for x in (self.weight, self.move, self.start)]
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(coded)):
                rows, labels = coded[k]
                scores = np.array([self.weight[r].sum(0) for r in rows])
                single, pair = self._marginals(scores)
                truth = np.eye(2)[labels]
                diff = truth - single
                grads = [np.zeros_like(self.weight), np.zeros((2, 2)), diff[0]]
                flat = np.concatenate(rows)
                np.add.at(grads[0], flat, np.repeat(diff, [len(r) for r in rows], axis=0))
                if len(rows) > 1:
                    np.add.at(grads[1], (labels[:-1], labels[1:]), 1)
                    grads[1] -= pair.sum(0)
                for param, grad, seen in zip((self.weight, self.move, self.start), grads, past, strict=True):
                    grad -= 1e-4 * param
                    seen += grad * grad
                    param += 0.3 * grad / np.sqrt(seen)

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(scores)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + scores[0]
        for i in range(1, n):
            ahead[i] = scores[i] + np.logaddexp(ahead[i - 1, 0] + self.move[0], ahead[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            x = self.move + scores[i + 1] + back[i + 1]
            back[i] = np.logaddexp(x[:, 0], x[:, 1])
        total = np.logaddexp(*ahead[-1])
        pair = ahead[:-1, :, None] + self.move + (scores[1:] + back[1:])[:, None, :] - total
        return np.exp(ahead + back - total), np.exp(pair)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels."""
        if not rows:
            return []
        known, table = self.index, self._table()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start.tolist()
        came = []
        for i, row in enumerate(rows):
            x = y = 0.0
            for name in row:
                at = known.get(name)
                if at is not None:
                    x += table[at][0]
                    y += table[at][1]
            if i:
                f0, f1 = a + m00 < b + m10, a + m01 < b + m11
                a, b = (b + m10 if f0 else a + m00), (b + m11 if f1 else a + m01)
                came.append((int(f0), int(f1)))
            a, b = a + x, b + y
        label = int(b > a)
        out = [label]
        for step in reversed(came):
            label = step[label]
            out.append(label)
        return out[::-1]

    def _table(self) -> list[list[float]]:
        if getattr(self, "_cached", None) is None:
            self._cached = self.weight.tolist()
        return self._cached


def training_set(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of labelled pages."""
    out = []
    for runs in labelled_pages(n, seed):
        page, spans = "", []
        for markup, label in runs:
            spans.append((len(page), len(page) + len(markup), label))
            page += markup
        found = blocks(page)
        out.append((features(found), [next(v for a, b, v in spans if a <= x.at < b) for x in found]))
    return out


@lru_cache(maxsize=2)
def trained(n: int = TRAINING_PAGES, seed: int = 11) -> ChainField:
    field = ChainField()
    field.fit(training_set(n, seed))
    return field


def main_text(page: str | None, field: ChainField) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, field.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, field: ChainField | None = None, html_col: str = "html") -> DataFrame:
    """`pages` without its html, with text and n_chars; columns of these names in `pages` are replaced."""
    field = field or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), field) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"]
            )

    rows = pages.select(*kept, F.col(html_col))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != html_col)
    return rows.mapInArrow(run, schema + ", text string, n_chars long")
