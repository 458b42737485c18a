"""Units of BLEU and chrF: as column expressions, and of many texts at once."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ENTITIES_13A, SPACE_CHARS, TOKENIZER_13A
from .text import drop_spaces, squeeze_spaces


def tokens_13a(c: Column) -> Column:
    """Published 13a tokenization as text: tokens joined by single spaces."""
    c = F.rtrim(F.coalesce(c, F.lit("")), F.lit(SPACE_CHARS))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    plain = c
    for old, new in ENTITIES_13A:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    c = F.when(F.contains(c, F.lit("&")), plain).otherwise(c)
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, replacement in TOKENIZER_13A[:-1]:
        c = F.regexp_replace(c, pattern, replacement)
    pattern, replacement = TOKENIZER_13A[-1]
    c = F.when(F.contains(c, F.lit("-")), F.regexp_replace(c, pattern, replacement)).otherwise(c)
    return squeeze_spaces(c)


def chrf_text(c: Column) -> Column:
    return drop_spaces(F.coalesce(c, F.lit("")))


# Classes of characters for the 13a rules; characters beyond the table are of no class.
_STANDS_ALONE, _MARK, _DIGIT, _HYPHEN, _SPACE = range(1, 6)
_CLASS = np.zeros(max(map(ord, SPACE_CHARS)) + 2, np.uint8)
_CLASS[[i for i in range(128) if re.match(TOKENIZER_13A[0][0], chr(i))]] = _STANDS_ALONE
for _characters, _class in ((".,", _MARK), ("0123456789", _DIGIT), ("-", _HYPHEN), (SPACE_CHARS, _SPACE)):
    _CLASS[list(map(ord, _characters))] = _class


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Texts:
    """The characters of many texts in a row, with a space before each and some after the last.

    ``units`` are code points, ``kind`` their classes, ``ends`` where each text ends and ``words`` where the
    characters are that are no white space.
    """

    def __init__(self, texts: list[str] | pa.Array):
        self.texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        row = pa.ListArray.from_arrays(pa.array([0, len(self.texts)], pa.int32()), self.texts)
        self.whole = f" {pc.binary_join(row, ' ')[0].as_py()}  "
        self.units = code_points(self.whole)
        self.kind = _CLASS.take(self.units, mode="clip")
        self.ends = np.cumsum(pc.utf8_length(self.texts).to_numpy() + 1, dtype=np.int64)
        self.words = np.flatnonzero(self.kind != _SPACE)

    @cached_property
    def numbers(self) -> tuple[np.ndarray, int]:
        """A number from 1 for each different character of ``words``, and how many there are."""
        return numbered(self.units.take(self.words))

    def count(self, at: np.ndarray) -> np.ndarray:
        """How many of the ascending positions ``at`` are in each text."""
        return np.diff(np.searchsorted(at, self.ends), prepend=0)


def numbered(units: np.ndarray) -> tuple[np.ndarray, int]:
    top = int(units.max(initial=0))
    if top >= 1 << 16:
        number, found = pd.factorize(units)
        return (number + 1).astype(np.uint64), len(found)
    seen = np.zeros(top + 1, bool)
    seen[units] = True
    rank = np.cumsum(seen, dtype=np.uint64)
    return rank.take(units), int(rank[-1]) if len(units) else 0


def _prepared(texts: pa.Array) -> pa.Array:
    texts = pc.utf8_rtrim(texts, SPACE_CHARS)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES_13A):
        texts = pc.replace_substring(texts, old, new)
    return texts


def windows(units: np.ndarray, width: int, bits: int) -> np.ndarray:
    """All windows of ``width`` units below ``2**bits``, each in one machine word."""
    out, have = units, 1
    for digit in bin(width)[3:]:
        out = out[:-have] << np.uint64(bits * have) | out[have:]
        have *= 2
        if digit == "1":
            out = out[:-1] << np.uint64(bits) | units[have:]
            have += 1
    return out


def _cut_13a(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Texts to cut, where tokens start among ``words``, and how many tokens each text has.

    Each rule puts spaces on both sides of single characters, so all that is asked is which ones.
    """
    if any(x in texts.whole for x in ("\n", "&", "<skipped>")):
        texts = Texts(_prepared(texts.texts))
    kind = texts.kind
    # Of marks in a row a rule takes every other one: it uses up the character before, which is no digit.
    # What it leaves stands alone too, unless a digit follows.
    mark = np.flatnonzero(kind == _MARK)
    number = np.arange(len(mark))
    first = np.maximum.accumulate(np.where(np.diff(mark, prepend=-1) > 1, number, 0))
    taken = ((number - first) % 2 == 0) ^ (kind[mark[first] - 1] == _DIGIT)
    hyphen = np.flatnonzero(kind == _HYPHEN)
    parts = kind == _STANDS_ALONE
    parts[mark[taken | (kind[mark + 1] != _DIGIT)]] = True
    parts[hyphen[kind[hyphen - 1] == _DIGIT]] = True
    # A token starts at what stands alone or is white space, and after it.
    parts |= kind == _SPACE
    parts[1:] |= parts[:-1].copy()
    at = np.flatnonzero(parts.take(texts.words))
    return texts, at, texts.count(texts.words.take(at))


def _strings(texts: Texts, start: np.ndarray, size: np.ndarray) -> list[str]:
    start = texts.words.take(start)
    return [texts.whole[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]


def split_13a(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The tokens of ``tokens_13a`` of all texts in a row, and how many each has."""
    cut, start, counts = _cut_13a(Texts(texts))
    return _strings(cut, start, np.diff(start, append=len(cut.words))), counts


def number_13a(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Like ``split_13a``, with a number from 1 for each different token.

    Tokens that fit a machine word are numbered as words; only longer ones become strings.
    """
    cut, start, counts = _cut_13a(texts)
    character, found = cut.numbers
    bits = max(1, found.bit_length())
    width = 64 // bits
    size = np.diff(start, append=len(cut.words))
    unused = (bits * (width - np.minimum(size, width))).astype(np.uint64)
    word = windows(np.concatenate([character, np.zeros(width - 1, np.uint64)]), width, bits).take(start) >> unused
    long = np.flatnonzero(size > width)
    word[long] = 0
    number, words = pd.factorize(word)
    if len(long):
        number[long] = len(words) + pd.factorize(np.array(_strings(cut, start[long], size[long]), object))[0]
    return (number + 1).astype(np.uint64), counts
