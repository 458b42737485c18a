"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks: runs of text between block-level tags, each with its open
ancestors.  Features of a block are its tag, its ancestors' tags and class words, and
its text's length, links and punctuation.  A chain of two labels (article or not) is trained on
labelled pages by maximum likelihood and decoded by Viterbi, so a block is judged with its
neighbours.

Null, empty and text-free pages have the empty text.  Malformed mark-up is read leniently:
open paragraphs end at the next block, unknown end tags are passed over, an unfinished tag at
the end is dropped.  Comments and attribute values end where they do in HTML; an attribute whose quote
is never closed ends with its tag.  Drawings and formulas end at their end tag, and before it, as in HTML, at
a closing slash or at a tag that cannot stand in them.  Templates may hold templates.  An open drawing, formula,
template or ``noscript`` takes no text of the page; any other open raw element (a script, say) takes the
rest, as in HTML.  Rows are kept as they are, and a column with the name of the result is replaced;
the whole page is read, in time near its length however deep it nests.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

#: Labelled pages of the fit; bounds the work on the driver.
TRAINING_PAGES = 800

#: An empty comment may end early; others end at the first of two ends, or with the page.
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_TOKEN = re.compile(
    _COMMENT + r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attr>(?:[\s/]++"
    # A name, and a value: in quotes, or up to the next white space.
    r"|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attr2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[A-Za-z][^>]*\Z"
    r"|[^<]+|<",
    re.DOTALL,
)
#: An attribute list whose last slash belongs to a value.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile("[a-z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
#: Of those, the ones that count as not there if nothing ends them.
_OPTIONAL = {"noscript"}
_TEMPLATE = re.compile(
    _COMMENT + r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?</(?P=raw)(?=[\s/>])[^>]*>|<(?P<end>/?)template(?=[\s/>])[^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
#: Drawings and formulas end at ``end`` or before ``out``: tags that cannot stand in them, but in a ``label``.
_FOREIGN = {
    t: re.compile(
        _COMMENT + r"|<!\[CDATA\[.*?\]\]>|<(?P<raw>script|style)(?=[\s/>])[^>]*(?<!/)>.*?</(?P=raw)(?=[\s/>])[^>]*>"
        rf"|(?P<end></{t}(?=[\s/>])[^>]*(?:>|\Z))"
        r"|<(?P<close>/?)(?P<label>foreignobject|desc|title|annotation-xml|mtext|mi|mo|mn|ms)(?=[\s/>])[^>]*?(?P<slash>/?)>"
        r"|(?P<out><(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta"
        r"|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var|article|aside|footer|header|main|nav"
        r"|section)(?=[\s/>])|</(?:article|aside|body|br|div|footer|header|html|main|nav|p|section)(?=[\s/>]))",
        re.IGNORECASE | re.DOTALL,
    )
    for t in ("svg", "math")
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that do not end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var br img wbr".split()
)
#: What an opening tag ends, up to the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def _foreign_end(html: str, tag: str, at: int) -> int | None:
    """Where a drawing or formula that is open at ``at`` ends; None if nothing ends it."""
    inside = 0
    for m in _FOREIGN[tag].finditer(html, at):
        if m["end"]:
            return m.end()
        if m["label"]:
            inside = max(0, inside - 1 if m["close"] else inside + (not m["slash"]))
        elif m["out"] and not inside:
            return m.start()
    return None


def _template_end(html: str, at: int) -> int | None:
    """Where a template that is open at ``at`` ends; None if nothing ends it."""
    depth = 1
    for m in _TEMPLATE.finditer(html, at):
        if m["end"] is not None:
            depth += -1 if m["end"] else 1
            if not depth:
                return m.end()
    return None


class _Stack:
    """Open elements: tags, which are blocks, and the features of all of them."""

    def __init__(self) -> None:
        self.tags: list[str] = ["html"]
        self.names: list[set[str]] = [set()]
        self.blocks: list[int] = [0]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.active: Counter[str] = Counter()
        self._features: frozenset[str] | None = frozenset()

    def push(self, tag: str, names: set[str], block: bool) -> None:
        if block:
            self.blocks.append(len(self.tags))
        self.places[tag].append(len(self.tags))
        self.tags.append(tag)
        self.names.append(names)
        if names:
            self.active.update(names)
            self._features = None

    def last(self, tag: str) -> int:
        """Place of the innermost open ``tag``; 0 if there is none."""
        return self.places[tag][-1] if self.places[tag] else 0

    def first_after(self, tags: set[str], limits: set[str]) -> int:
        """Place of the outermost of ``tags`` inside the innermost of ``limits``; 0 if there is none."""
        limit = max(self.last(t) for t in limits)
        inside = [self.places[t][k] for t in tags if (k := bisect_right(self.places[t], limit)) < len(self.places[t])]
        return min(inside, default=0)

    def pop_to(self, place: int) -> None:
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            if names := self.names.pop():
                self.active.subtract(names)
                self._features = None
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def features(self) -> frozenset[str]:
        if self._features is None:
            self.active = +self.active
            self._features = frozenset(self.active)
        return self._features


def leaf_blocks(html: str | None) -> list[tuple[str, str, frozenset[str], int]]:
    """``(text, block tag, ancestor features, characters in links)`` of every block with text."""
    blocks: list[tuple[str, str, frozenset[str], int]] = []
    stack = _Stack()
    text: list[str] = []
    linked: list[str] = []

    def finish() -> None:
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            inside = len(" ".join(unescape("".join(linked)).split()))
            blocks.append((joined, stack.tags[stack.blocks[-1]], stack.features(), inside))
        text.clear()
        linked.clear()

    at, html = 0, html or ""
    endless: set[str] = set()
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            token = m[0]
            if token[0] != "<" or token == "<":
                text.append(token)
                if stack.places["a"]:
                    linked.append(token)
            continue
        tag = tag.lower()
        attributes = m["attr"] or m["attr2"] or ""
        closed = attributes.endswith("/") and not _VALUE_SLASH.search(attributes)
        if m["end"] or m["end2"]:
            k = stack.last(tag)
            if tag == "p" or stack.blocks[-1] >= k if k else tag not in INLINE:
                finish()
            if k:
                stack.pop_to(k)
            continue
        if tag in _FOREIGN or tag == "template":
            if (not closed or tag == "template") and tag not in endless:
                end = _template_end(html, at) if tag == "template" else _foreign_end(html, tag, at)
                if end is None:
                    endless.add(tag)  # no later one ends either
                else:
                    at = end
            continue
        if tag in RAW:
            if tag not in endless:
                end = _RAW_END[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in _OPTIONAL:
                    endless.add(tag)
                else:
                    at = len(html)
            continue
        names = {w for x in _NAMES.finditer(attributes) for w in _WORD.findall((x[1] or x[2] or x[3] or "").lower())}
        block = tag not in INLINE or (bool(names) and tag == "ins")
        if block:
            finish()
            if tag not in VOID:
                if k := stack.last("p"):
                    stack.pop_to(k)
                if tag in CLOSES and (k := stack.first_after(*CLOSES[tag])):
                    stack.pop_to(k)
        elif tag == "br":
            text.append(" ")
        if tag not in VOID and not closed:
            own = {f"a:{tag}"} if block else set()
            stack.push(tag, own | {f"c:{w}" for w in names}, block)
        elif tag not in INLINE and tag not in VOID:
            finish()
    finish()
    return blocks


_SIZES = (20, 50, 100, 200, 400)


def features(blocks: list[tuple[str, str, frozenset[str], int]]) -> list[list[str]]:
    """Names of the features that each block of a page has."""
    out, titled = [], False
    for k, (text, tag, above, inside) in enumerate(blocks):
        share = inside / len(text)
        own = [
            "bias",
            f"t:{tag}",
            *above,
            f"size:{sum(len(text) > s for s in _SIZES)}",
            f"links:{(share > 0) + (share > 0.3) + (share > 0.8)}",
            f"stop:{text[-1] in '.!?…:\"”»)'}",
            f"comma:{', ' in text}",
        ]
        if "©" in text or "(c)" in text.lower():
            own.append("copyright")
        if titled:
            own.append("titled")
        titled = titled or tag == "h1"
        if k == 0:
            own.append("first")
        if k == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


def labelled_blocks(parts: list[tuple[str, bool]]) -> tuple[list, list[int]]:
    """Blocks of a labelled page and their labels, told by a private mark in each part's text."""
    marks = ("", "")
    html = "".join(re.sub(r">([^<]*\w)", lambda m: f">{marks[main]}{m[1]}", part) if "<" in part else marks[main] + part for part, main in parts)
    blocks, labels = [], []
    for text, tag, above, inside in leaf_blocks(html):
        if text[0] not in marks and not any(x in text for x in marks):
            continue
        label = int(text.count(marks[1]) > text.count(marks[0]))
        plain = text.replace(marks[0], "").replace(marks[1], "")
        if plain.strip():
            blocks.append((plain, tag, above, min(inside, len(plain))))
            labels.append(label)
    return blocks, labels


class ChainCrf:
    """A linear chain of two labels.  Label 0 has emission 0; ``step[a, b]`` follows a by b."""

    def __init__(self, weights: dict[str, float], step: np.ndarray, start: np.ndarray):
        self.weights, self.step, self.start = weights, step.tolist(), start.tolist()

    def decode(self, page: list[list[str]]) -> list[int]:
        """Labels of the best path (Viterbi)."""
        if not page:
            return []
        get, ((s00, s01), (s10, s11)) = self.weights.get, self.step
        back = []
        a, b = self.start[0], self.start[1] + sum(get(f, 0.0) for f in page[0])
        for own in page[1:]:
            emit = sum(get(f, 0.0) for f in own)
            back.append((a + s00 < b + s10, a + s01 < b + s11))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + emit
        label = int(b > a)
        labels = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            labels.append(label)
        return labels[::-1]

    @classmethod
    def fit(cls, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = 300, ridge: float = 1e-5) -> ChainCrf:
        """Maximum likelihood by Adam; forward and backward passes over all pages at once."""
        names = {f: k for k, f in enumerate(sorted({f for p in pages for own in p for f in own}))}
        n, longest = len(pages), max(map(len, pages))
        real = np.zeros((n, longest), bool)
        gold = np.zeros((n, longest), int)
        rows, cols = [], []
        for p, (page, own) in enumerate(zip(pages, labels)):
            real[p, : len(page)] = True
            gold[p, : len(page)] = own
            for k, found in enumerate(page):
                rows += [p * longest + k] * len(found)
                cols += [names[f] for f in found]
        rows, cols = np.array(rows), np.array(cols)
        theta = np.zeros(len(names) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        both = real[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        blocks = real.sum()
        for t in range(1, rounds + 1):
            w, step, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            emit = np.zeros((n, longest, 2))
            emit[..., 1] = np.bincount(rows, w[cols], n * longest).reshape(n, longest)
            ahead = np.zeros((n, longest, 2))
            ahead[:, 0] = start + emit[:, 0]
            for k in range(1, longest):
                reach = np.logaddexp(ahead[:, k - 1, 0, None] + step[0], ahead[:, k - 1, 1, None] + step[1]) + emit[:, k]
                ahead[:, k] = np.where(real[:, k, None], reach, ahead[:, k - 1])
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            behind = np.zeros((n, longest, 2))
            for k in range(longest - 2, -1, -1):
                go = behind[:, k + 1] + emit[:, k + 1]
                reach = np.logaddexp(step[:, 0] + go[:, :1], step[:, 1] + go[:, 1:])
                behind[:, k] = np.where(real[:, k + 1, None], reach, 0)
            # Alpha stays behind the end of a page, so mask before use.
            node = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
            pair = np.exp(
                ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
            ) * both[..., None, None]
            slope = np.empty_like(theta)
            off = ((gold == 1) & real) - node[..., 1]
            slope[:-6] = np.bincount(cols, off.ravel()[rows], len(names))
            slope[-6:-2] = (seen - pair.sum((0, 1))).ravel()
            slope[-2:] = np.bincount(gold[:, 0], minlength=2) - node[:, 0].sum(0)
            slope = slope / blocks - ridge * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return cls({f: float(theta[k]) for f, k in names.items()}, theta[-6:-2].reshape(2, 2), theta[-2:])


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 0) -> ChainCrf:
    """The tagger fitted on ``pages`` labelled pages."""
    known = [labelled_blocks(p) for p in labelled_pages(pages, seed)]
    known = [(b, y) for b, y in known if b]
    return ChainCrf.fit([features(b) for b, _ in known], [y for _, y in known])


def main_text(html: str | None, tagger: ChainCrf) -> str:
    """Article blocks of a page in order, joined by an empty line."""
    blocks = leaf_blocks(html)
    labels = tagger.decode(features(blocks))
    return "\n\n".join(block[0] for block, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, tagger: ChainCrf | None = None, html: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with the main text of each.  The tagger goes to the workers with the function;
    its size is that of the feature names of the training pages."""
    own = tagger or trained()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, own) for x in batch], dtype=object)

    return pages.withColumn(column, run(F.col(html)))
