"""Words of many texts at a time, as arrays.

A text is cut at white space; what a token is made of is found once for each distinct token of some
``SIZE`` bytes of text.  Letters, cases and punctuation are those of the JVM's regular expressions, whose
Unicode version may be another one than Python's, so both cut the same words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are arrays at a time; rows of one key are kept together up to ``MOST`` times that.
SIZE, MOST = 1 << 22, 8
#: Bits of a set of hashes.
BITS = 1 << 26
#: Kinds of characters: capital, small and other letters, punctuation; what ends a sentence or joins two letters
#: to one word; ends of lines that ``$`` of the JVM's expressions passes over, other than ASCII white space.
UPPER, LOWER, LETTER, PUNCTUATION, END, LINK, LAST = 1, 2, 3, 4, 5, 6, 7
ENDS, LINKS, LASTS = ".!?:", "-'’", "\u0085\u2028\u2029"

_CLASSES: dict[str, Classes] = {}


@dataclass(frozen=True)
class Classes:
    """The kind of every character, and characters that Python lower-cases otherwise than the JVM."""

    kinds: np.ndarray
    lowered: dict[int, str]


def classes(spark: SparkSession) -> Classes:
    """The character classes of the JVM: one small job in a session."""
    app = spark.sparkContext.applicationId
    if app not in _CLASSES:
        is_a = lambda name: F.rlike("c", F.lit(rf"^\p{{{name}}}$"))
        kind = F.when(is_a("Lu"), UPPER).when(is_a("Ll"), LOWER).when(is_a("L"), LETTER).when(is_a("P"), PUNCTUATION).otherwise(0)
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        every = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", char.alias("c"))
        rows = every.select("id", kind.alias("kind"), F.lower("c").alias("low")).filter("kind > 0").toPandas()
        kinds = np.zeros(0x110000, np.uint8)
        kinds[rows["id"].to_numpy()] = rows["kind"].to_numpy()
        for some, own in ((ENDS, END), (LINKS, LINK), (LASTS, LAST)):
            kinds[list(map(ord, some))] = own
        _CLASSES[app] = Classes(kinds, {i: c for i, c in zip(rows["id"], rows["low"]) if chr(i).lower() != c})
    return _CLASSES[app]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", key: str | None = None) -> Iterator[pa.Table]:
    """The rows in tables of about ``SIZE`` bytes of ``text``; rows of a key that are side by side stay so."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(batch):
            past = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, past + max(SIZE - size, SIZE // 4), "right")))
            held.append(batch.slice(start, end - start))
            size, start = size + int(ends[end - 1] - past), end
            if size >= SIZE or start < len(batch):
                table, cut = pa.Table.from_batches(held).combine_chunks(), None
                if key is not None and size < MOST * SIZE:
                    cut = int(np.flatnonzero(np.append(True, changes(table.column(key))))[-1])
                if cut == 0:
                    continue
                rest = [] if cut is None else table.slice(cut).combine_chunks().to_batches()
                held, size = rest, sum(pc.sum(pc.binary_length(b.column(text))).as_py() or 0 for b in rest)
                yield table if cut is None else table.slice(0, cut).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a row has another value than the row before it, from the second row on."""
    return np.diff(coded(column)[0]) != 0


def coded(column) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values, null being one, and the values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_nested(whole.type):
        numbers = pd.factorize(np.array([repr(x) for x in whole.to_pylist()], object))[0]
        first = np.unique(numbers, return_index=True)[1]
        return numbers, whole.take(pa.array(first))
    found = whole.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def groups(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and the first row of each group."""
    code = np.zeros(len(table), np.int64)
    for c in columns:
        own, values = coded(table.column(c))
        code = pd.factorize(code * (len(values) + 1) + own)[0]
    return code, np.unique(code, return_index=True)[1]


@dataclass(frozen=True)
class Tokens:
    """Tokens of rows: the row of each, its number among the distinct tokens, and these."""

    row: np.ndarray
    code: np.ndarray
    values: pa.Array


def tokens(texts) -> Tokens:
    """What stands between ASCII white space in each text; null is empty."""
    whole = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    cut = pc.ascii_split_whitespace(pc.fill_null(whole.cast(pa.string()), ""))
    flat = cut.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    return Tokens(row, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary)


class _Chars:
    """The characters of tokens in a row, each token with a space behind it."""

    def __init__(self, values: pa.Array, c: Classes):
        whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        self.text = pc.binary_join(whole, " ")[0].as_py() + " "
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.kind = c.kinds[points]
        self.end = np.flatnonzero(points == 32)
        self.start = np.append(0, self.end[:-1] + 1)
        self.letter = (self.kind > 0) & (self.kind <= LETTER)

    def count(self, which: np.ndarray) -> np.ndarray:
        """How many of the marked characters a token has."""
        return np.add.reduceat(which.view(np.uint8), self.start, dtype=np.int32)

    def cut(self, start: np.ndarray, end: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(start.tolist(), end.tolist())]


def case_facts(values: pa.Array, c: Classes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of tokens: the word between punctuation, empty if it is none; whether that is capitalised, and
    whether a sentence ends."""
    if not len(values):
        return pa.array([], pa.string()), np.zeros(0, bool), np.zeros(0, bool)
    t = _Chars(values, c)
    mark = (t.kind >= PUNCTUATION) & (t.kind <= LINK)
    last = (t.end > t.start) & (t.kind[t.end - 1] == LAST)
    letters = t.count(t.letter)
    begins = t.letter & ~np.append(False, t.letter[:-1])
    bare = (t.count(begins) == 1) & (letters + t.count(mark) + last == t.end - t.start)
    # Where the first letter is, if there is one.
    first = np.flatnonzero(begins)
    first = np.append(first, 0)[np.searchsorted(first, t.start)]
    word = np.full(len(values), "", object)
    word[bare] = t.cut(first[bare], (first + letters)[bare])
    capital = bare & (letters > 1) & (t.kind[first] == UPPER)
    capital[capital] = (t.count(t.kind == LOWER) == letters - 1)[capital]
    # A mark that ends a sentence, and behind it marks only.
    at = np.flatnonzero(t.kind == END)
    of = np.searchsorted(t.end, at)
    newest = np.append(of[1:] != of[:-1], True)[: len(of)]
    at, of = at[newest], of[newest]
    marks = np.append(0, np.cumsum(mark, dtype=np.int32))
    end = t.end[of] - last[of]
    stop = np.zeros(len(values), bool)
    stop[of[marks[end] - marks[at] == end - at]] = True
    return pa.array(word, pa.string()), capital, stop


@dataclass(frozen=True)
class Words:
    """Lower-cased words of rows: the row of each, its number among the distinct words, and these."""

    row: np.ndarray
    code: np.ndarray
    values: pa.Array


def words(cut: Tokens, c: Classes) -> Words:
    """Letters, with single hyphens or apostrophes inside, lower-cased.  No word goes over white space."""
    if not len(cut.values):
        return Words(cut.row, cut.code, pa.array([], pa.string()))
    t = _Chars(cut.values, c)
    inside = t.letter.copy()
    inside[1:-1] |= (t.kind[1:-1] == LINK) & t.letter[:-2] & t.letter[2:]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = " ".join(t.cut(start, end))
    lower = (own.translate(c.lowered) if c.lowered else own).lower()
    names = pa.array(lower.split(" ") if own else [], pa.string()).dictionary_encode()
    parts = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.searchsorted(start, t.start)
    sizes = np.searchsorted(start, t.end) - starts
    n = sizes[cut.code]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return Words(np.repeat(cut.row, n), parts[np.repeat(starts[cut.code], n) + place], names.dictionary)


def bit_set(positions: list[tuple[int, bytes]]) -> np.ndarray:
    """Bits of ``bitmap_construct_agg`` by bucket, as an array of whether a hash is there."""
    bits = np.zeros(BITS // 8, np.uint8)
    for bucket, part in positions:
        start = (bucket - 1) * 4096
        bits[start : start + len(part)] = np.frombuffer(part, np.uint8)
    return bits


def has_bits(bits: np.ndarray, keys: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Whether the hash of a key of two parts is in the set; it may be there by chance."""
    at = np.array([zlib.crc32(b, zlib.crc32(a)) for a, b in keys], np.int64) % BITS
    return (bits[at >> 3] >> (at & 7)) & 1 == 1
