"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Items and texts become words (A-Z lower-cased, everything else in ASCII but digits and
letters separates); a window is ``WINDOW`` consecutive words of an item, or all words of a
shorter one.  The automaton reads word numbers, so a text is scanned once whatever the number
of windows, and found words are mapped back to offsets of the original text.

The automaton is broadcast, so its size is bounded: windows are dealt into blocks of at most
``BLOCK`` windows by a hash, and each block is a pass of its own over the texts.  Which words are
hit and which items occur come back per row and pass, and are joined in the next pass.  Item ids go with the
windows while all windows together name at most ``MOST_IDS`` of them; beyond that the automaton has the
windows' numbers only, and Spark joins the ids to the rows that hold a window, so one that very many items
share is in no broadcast.

Null texts and texts without words have no words and no hits.  Items without words have no
windows, items without an id no part.  Rows are kept as they are (repeated rows, null ids, extra
columns; one named ``found`` is replaced).  An empty table or benchmark is no special case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 10
#: Windows of one automaton: at most some 100 MB in a worker.
BLOCK = 200_000

#: Item ids that are broadcast with their windows.
MOST_IDS = 1_000_000

#: Bytes to bytes: A-Z in lower case, ASCII separators to a space, the rest as it is.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Normalised words of a whole text as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split(b" ") if text else []


def _windows(size: int):
    """Windows of items as space-joined text; an item's repeated window once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                own = [w for w in words(text) if w]
                ends = range(min(size, len(own)), len(own) + 1) if own else ()
                rows += [(item, w) for w in {b" ".join(own[max(0, e - size) : e]).decode() for e in ends}]
            yield pd.DataFrame(rows, columns=["item_id", "window"]).astype({"window": "string"})

    return run


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(window, items)``: every distinct window with the sorted ids of its items as strings."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item_id"), F.col(text).alias("text"))
    found = items.filter("item_id is not null").mapInPandas(_windows(size), "item_id string, window string")
    return found.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


class Automaton:
    """The automaton of one block, built once per worker from its windows."""

    def __init__(self, windows: list[str]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(windows):
            own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" "))
            self.machine.add_word(own, (k, len(own)))
        self.machine.make_automaton()

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words in any occurrence (start, end), and the windows that occur."""
        if not self.numbers:
            return [], set()
        get = self.numbers.get
        # Number 0 is in no window; empty strings between separators are no words.
        found = list(self.machine.iter(tuple([get(w, 0) for w in own])))
        return [(end + 1 - n, end + 1) for end, (_, n) in found], {k for _, (k, _) in found}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word as code points of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
    word = np.concatenate([[False], raw != 32, [False]])
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    return point[start], point[end - 1] + 1


_BUILT: dict = {}


def _scan_udf(windows, key: str):
    """Merged word spans and item ids of one block, added to those of the blocks before.

    ``windows`` is the broadcast of the block's window texts and items.
    """

    @F.pandas_udf("words: long, hits: long, hit: array<int>, spans: array<int>, items: array<string>")
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton([w for w, _ in windows.value])
        machine, items = _BUILT[key], [i for _, i in windows.value]
        for texts, hits, before in batches:
            rows = []
            for text, hit, known in zip(texts, hits, before):
                own = [w for w in words(text) if w]
                spans, occurring = machine.scan(own)
                if hit is not None and len(hit):
                    spans += list(zip(hit[::2].tolist(), hit[1::2].tolist()))
                ids = set(known) if known is not None else set()
                for k in occurring:
                    ids.update(items[k])
                spans = _merged(spans)
                offsets: list[int] = []
                if spans:
                    start, end = _offsets(text)
                    offsets = [int(x) for a, b in spans for x in (start[a], end[b - 1])]
                rows.append((len(own), sum(b - a for a, b in spans), [x for span in spans for x in span], offsets, sorted(ids)))
            yield pd.DataFrame(rows, columns=["words", "hits", "hit", "spans", "items"])

    return scan


def _with_ids(out: DataFrame, items: DataFrame) -> DataFrame:
    """``found.items`` from window numbers to the ids of ``(number, item)``.

    Rows of equal windows share one list of ids; rows without any stay out of the join.
    """
    key = F.struct(F.xxhash64("found.items").alias("h1"), F.xxhash64(F.lit(1), F.col("found.items")).alias("h2"))
    rows = saved(out.withColumn("_key", key), "numbered")
    hit = rows.filter(F.size("found.items") > 0)
    ids = (
        hit.select("_key", F.explode("found.items").alias("number"))
        .distinct()
        .join(items, "number")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_set("item")).alias("_ids"))
    )
    named = hit.join(saved(ids, "ids"), "_key").withColumn("found", F.col("found").withField("items", F.col("_ids")))
    return named.select(*out.columns).unionByName(rows.filter(F.size("found.items") == 0).select(*out.columns))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block: int = BLOCK,
    most_ids: int = MOST_IDS,
) -> DataFrame:
    """``docs`` with a struct ``found``: ``words`` (count), ``hits`` (words hit), ``hit`` (merged word spans, start and
    end in turn), ``spans`` (the same as code points of the text) and ``items`` (sorted ids)."""
    spark = docs.sparkSession
    windows = saved(benchmark_windows(benchmark, item_id, item_text, size), "windows")
    n, ids = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    blocks = max(1, -(-n // block))
    items = None
    if ids > most_ids:
        # A window's number: 96 bits of hashes, so that no table has to be numbered.
        number = F.concat(F.xxhash64("window").cast("string"), F.lit(":"), F.crc32(F.col("window").cast("binary")).cast("string"))
        items = windows.select(number.alias("number"), F.explode("items").alias("item"))
        windows = windows.select("window", F.array(number).alias("items"))
    empty = {"hit": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")}
    out = docs
    for k in range(blocks):
        # Dealt by hash; a block over its size only by chance, by a few per cent.
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        held = [(r["window"], r["items"]) for r in own.toLocalIterator()]
        scan = _scan_udf(spark.sparkContext.broadcast(held), uuid.uuid4().hex)
        before = [out["found"][c] if k else e for c, e in empty.items()]
        out = out.withColumn("found", scan(F.col(text), *before))
        if k + 1 < blocks:
            out = saved(out, f"scanned-{k}")  # so that one automaton is in memory at a time
    return out if items is None else _with_ids(out, items)
