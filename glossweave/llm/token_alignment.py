"""Alignment of two tokenizers' tokens by interval coalescing.

A is a byte-level BPE tokenizer, B a piece model.  Both give the bytes of the text with a space
in front, cut differently.

1. ``align``: tokens are byte intervals.  Those of all documents of a batch are put one after
   another, A's and B's are sorted together by start, and the running maximum of their ends is
   taken.  A group breaks where a start reaches that maximum: no token of either side
   crosses there.  Within a group every A token is linked to every B token.
2. ``linked``: of every document its distinct id pairs and how many links each has, written once.
   ``score`` counts from it in how many documents each pair is linked.
3. ``score``: the ``FREQUENT`` most frequent pairs (their number is the bound of the broadcast) are
   looked up where the document is; the others are joined by pair.  A pair outside the table is in few
   documents: its count is at most the sum of all counts over ``FREQUENT``.

Defined cases: null and empty texts have no tokens.  Nor have texts whose pieces do not give the
text back (U+2581 in a text reads as a space, for instance); their counts are zero and their digest
is empty.  Texts are encoded whole.  Repeated rows are documents of their own; ids may be null or
repeated; an empty table gives no rows.  Only the columns in ``keep`` are carried; a result of
the same name replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import default_tokenizer, tokenizer
from .common import saved, small_batches
from .pretokens import LONGEST_CACHED, checked_model, default_model, pre_tokens, processor

#: Pairs in the broadcast table, 16 bytes each.
FREQUENT = 500_000
#: Documents worked on at once in a worker, and links of their groups expanded at once.
SLICE, LINKS = 256, 1 << 20
#: Documents in a batch for a Python worker.
BATCH = 1000
#: Pre-tokens whose pieces a worker remembers.
CACHED = 400_000
#: How pieces write a space.
SPACE = "▁"


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """Bytes of every piece."""
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]


@dataclass
class Side:
    """One side's tokens of several documents, one after another."""

    ids: np.ndarray
    counts: np.ndarray  # tokens of each document
    lengths: np.ndarray  # bytes of each token

    @staticmethod
    def of(ids: list[np.ndarray], table: list[bytes]) -> Side:
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        return Side(flat, np.array([len(x) for x in ids], np.int64), lengths[flat])

    def sizes(self) -> np.ndarray:
        """Bytes of each document's tokens."""
        ends = np.append(0, np.cumsum(self.lengths))[np.append(0, np.cumsum(self.counts))]
        return np.diff(ends)


def coalesce(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of every A token, of every B token, and the first group of each document.

    The documents' bytes follow one another, so a group never reaches into the next one.
    """
    starts = np.concatenate([np.cumsum(s.lengths) - s.lengths for s in (a, b)])
    ends = starts + np.concatenate([a.lengths, b.lengths])
    order = np.lexsort((np.arange(len(starts)), starts))
    reached = np.maximum.accumulate(ends[order])
    # A first token opens a group; another one does where all before it have ended.
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    of_a, of_b = group[: len(a.ids)], group[len(a.ids) :]
    # A document's first group is that of its first token; one without tokens has none.
    at = np.cumsum(a.counts) - a.counts
    bound = np.append(of_a, opens.sum())
    return of_a, of_b, bound[at]


@lru_cache(maxsize=2)
def _pieces(path: str) -> dict[str, list[int]]:
    """A worker's pieces of pre-tokens seen before."""
    return {}


def encode_pieces(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The library's ids of whole texts, put together from those of their pre-tokens."""
    model, cut, known = processor(path), [pre_tokens(t) for t in texts], _pieces(path)
    if len(known) > CACHED:
        known.clear()
    new = [k for k in {k for doc in cut for k in doc} if k not in known]
    ids = model.encode(new, num_threads=1) if new else []
    # The library puts a space in front, which is no part of the text before a line feed.
    found = {k: x[1:] if k[:1] == "\n" else x or [model.piece_to_id(SPACE)] for k, x in zip(new, ids)}
    long = {k: found.pop(k) for k in new if len(k) > LONGEST_CACHED}
    known.update(found)
    look = (lambda k: long[k] if k in long else known[k]) if long else known.__getitem__
    return [np.fromiter(chain.from_iterable(map(look, doc)), np.int32) for doc in cut]


def encode(texts: list[str | None], path_a: str, path_b: str) -> tuple[Side, Side]:
    """Tokens of both sides; none where a side does not give the bytes of the text."""
    words = tokenizer(path_a)
    spaced = [f" {t}" if t else "" for t in texts]
    whole = [t.encode() for t in spaced]
    size = np.array([len(t) for t in whole])
    tables = (words.token_bytes, piece_bytes(path_b))
    given = [words.encode(spaced, plain=True), encode_pieces(texts, path_b)]
    sides = [Side.of(ids, table) for ids, table in zip(given, tables)]
    # All texts at once; one by one only if one differs.
    if not all(
        np.array_equal(side.sizes(), size) and b"".join([table[i] for i in side.ids.tolist()]) == b"".join(whole)
        for side, table in zip(sides, tables)
    ):
        for k, t in enumerate(whole):
            if any(b"".join([table[i] for i in ids[k].tolist()]) != t for ids, table in zip(given, tables)):
                given[0][k] = given[1][k] = np.zeros(0, np.int32)
        sides = [Side.of(ids, table) for ids, table in zip(given, tables)]
    return sides[0], sides[1]


@lru_cache(maxsize=2)
def _written(size: int) -> np.ndarray:
    """Decimal ids with what may follow them: nothing, a comma, a bar, a semicolon."""
    return np.array([[f"{i}{mark}" for mark in ("", ",", "|", ";")] for i in range(size)], object)


def digests(a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray, size: int) -> list[str]:
    """SHA-256 of the groups of each document, written ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    side = np.repeat([0, 1], [len(of_a), len(of_b)])
    group = np.concatenate([of_a, of_b])
    order = np.lexsort((side, group))  # stable: tokens of a group and side stay in order
    group, side = group[order], side[order]
    mark = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
    ends = np.cumsum(a.counts + b.counts)
    mark = np.append(mark, 0)
    mark[ends[ends > 0] - 1] = 0
    text = _written(size)[np.concatenate([a.ids, b.ids])[order], mark].tolist()
    return [
        hashlib.sha256("".join(text[lo:hi]).encode()).hexdigest() if hi > lo else ""
        for lo, hi in zip((ends - a.counts - b.counts).tolist(), ends.tolist())
    ]


ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, groups_sha256 string"
PAIRED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _links array<int>"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "a_ids", "b_ids", "a_sizes", "b_sizes")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(values))


@dataclass
class Block:
    """The aligned documents of one slice; group sizes of all its groups, and groups of each document."""

    a: Side
    b: Side
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    groups: np.ndarray
    digests: list[str]


def _blocks(texts: pa.Array, path_a: str, path_b: str) -> Block:
    a, b = encode(texts.to_pylist(), path_a, path_b)
    of_a, of_b, first = coalesce(a, b)
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    size = max(len(tokenizer(path_a).token_bytes), len(piece_bytes(path_b)))
    return Block(
        a, b, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.diff(np.append(first, n)),
        digests(a, b, of_a, of_b, size),
    )


def _per_slice(docs: DataFrame, names: list[str], text: str, schema: str, path_a: str, path_b: str, columns) -> DataFrame:
    """``names`` and what ``columns`` makes of each slice's block, in the order of ``schema``."""
    ready = docs.select(*names, F.col(text).cast("string").alias("_text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema[:-1]]
    results = [c.split()[0] for c in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                made = columns(_blocks(batch.column(len(names)), path_a, path_b))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *results])

    return ready.mapInArrow(apply, ", ".join([*own, schema]))


def align(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """``keep`` with the ids of both sides, the tokens of each group on each side, and a digest.

    Row-local: group g of a document holds the next ``a_sizes[g]`` A tokens and ``b_sizes[g]`` B tokens.
    """

    def columns(x: Block) -> list[pa.Array]:
        sizes = [_lists(s.astype(np.int32), x.groups) for s in (x.a_sizes, x.b_sizes)]
        return [_lists(x.a.ids, x.a.counts), _lists(x.b.ids, x.b.counts), *sizes, pa.array(x.digests, pa.string())]

    names = [c for c in keep if c not in RESULTS]
    return _per_slice(docs, names, text, ALIGNED, path_a or default_tokenizer(), checked_model(path_b or default_model()), columns)


def linked_pairs(x: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) of a block with their links, sorted: document, pair, links.

    A pair is ``a * width + b``.  Links are expanded in blocks of groups, about LINKS at once; a group
    beyond that is counted by distinct ids instead.
    """
    a_ids, b_ids = x.a.ids.astype(np.int64), x.b.ids.astype(np.int64)
    doc = np.repeat(np.arange(len(x.groups)), x.groups)
    a_at, b_at = np.cumsum(x.a_sizes) - x.a_sizes, np.cumsum(x.b_sizes) - x.b_sizes
    links = x.a_sizes * x.b_sizes
    none = np.zeros(0, np.int64)
    parts = [(none, none, none)]
    for g in np.flatnonzero(links > LINKS).tolist():
        a, n_a = np.unique(a_ids[a_at[g] : a_at[g] + x.a_sizes[g]], return_counts=True)
        b, n_b = np.unique(b_ids[b_at[g] : b_at[g] + x.b_sizes[g]], return_counts=True)
        pair = (a[:, None] * width + b).ravel()
        parts.append((np.full(len(pair), doc[g]), pair, (n_a[:, None] * n_b).ravel()))
    small = np.flatnonzero(links <= LINKS)
    cuts = np.flatnonzero(np.diff(np.cumsum(links[small]) // LINKS)) + 1
    for own in np.split(small, cuts):
        n = links[own]
        group = np.repeat(own, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        pair = a_ids[a_at[group] + k // x.b_sizes[group]] * width + b_ids[b_at[group] + k % x.b_sizes[group]]
        parts.append(_distinct(doc[group], pair, np.ones(len(group), np.int64)))
    if len(parts) == 2:
        return parts[1]
    # A document may lie in two blocks.
    return _distinct(*(np.concatenate(p) for p in zip(*parts)))


def _distinct(doc: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair), sorted, and the sums of ``n``."""
    if not len(doc):
        return doc, pair, n
    # The documents of a slice and their pairs fit one long together.
    span = int(pair.max()) + 1
    code = doc * span + pair
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first] // span, code[first] % span, np.add.reduceat(n[order], first)


def linked(docs: DataFrame, names: list[str], text: str, path_a: str, path_b: str) -> DataFrame:
    """``names`` with counts and digest of each document, and its distinct pairs with their links."""
    width = len(piece_bytes(path_b))

    def columns(x: Block) -> list[pa.Array]:
        doc, pair, links = linked_pairs(x, width)
        per_doc = np.bincount(doc, minlength=len(x.groups))
        total = np.bincount(doc, links, len(x.groups)).astype(np.int64)
        counts = [pa.array(v.astype(np.int64)) for v in (x.a.counts, x.b.counts, x.groups, total)]
        return [*counts, pa.array(x.digests, pa.string()), _lists(pair, per_doc), _lists(links.astype(np.int32), per_doc)]

    return _per_slice(docs, names, text, PAIRED, path_a, path_b, columns)


def score(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """``keep`` with tokens, groups and links of every document, and what the corpus says of its links.

    A pair's count is in how many documents it is linked; ``n_best`` are the links whose count no
    other pair of their A id exceeds, ``count_sum`` adds up the counts of all links.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or default_tokenizer(), checked_model(path_b or default_model())
    names = [c for c in keep if c not in RESULTS]
    width = len(piece_bytes(path_b))
    with small_batches(spark, BATCH):
        rows = saved(linked(docs, names, text, path_a, path_b), "linked")
        pairs = rows.select(F.explode("_pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
        counts = saved(pairs.withColumn("a", F.expr(f"pair div {width}")), "pairs")
        # One number per A id.
        counts = counts.join(counts.groupBy("a").agg(F.max("docs").alias("best")), "a")
        scored = saved(_look_up(rows.withColumn("_row", F.monotonically_increasing_id()), counts, names), "scored")
    rare = scored.filter(F.size("_pairs") > 0).select("_row", F.explode(F.arrays_zip("_pairs", "_links")).alias("x"))
    rest = (
        rare.select("_row", F.col("x._pairs").alias("pair"), F.col("x._links").alias("links"))
        .join(counts, "pair")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("docs") == F.col("best"), F.col("links")).otherwise(0)).alias("_best"),
            F.sum(F.col("links") * F.col("docs")).alias("_sum"),
        )
    )
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return scored.join(rest, "_row", "left").select(
        *names, "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256"
    )


def _look_up(rows: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """``n_best`` and ``count_sum`` over the frequent pairs; the pairs beside the table stay in the lists."""
    table = counts.orderBy(F.desc("docs"), "pair").limit(FREQUENT).select("pair", "docs", "best").toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast([table[c].to_numpy()[order].copy() for c in ("pair", "docs", "best")])
    plain = ["_row", *names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    ready = rows.select(*plain, "_pairs", "_links")
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema[: len(plain)]]
    results = ["n_best", "count_sum", "_pairs", "_links"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_of, best_of = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sizes = batch.column(len(plain)).value_lengths().to_numpy()
                pair = batch.column(len(plain)).flatten().to_numpy()
                links = batch.column(len(plain) + 1).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at_key = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at_key] == pair if len(keys) else np.zeros(len(pair), bool)
                n_best, sums = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                docs_hit = docs_of[at_key[hit]]
                best = docs_hit == best_of[at_key[hit]]
                np.add.at(n_best, doc[hit][best], links[hit][best])
                np.add.at(sums, doc[hit], links[hit] * docs_hit)
                left = np.bincount(doc[~hit], minlength=len(sizes))
                made = [pa.array(n_best), pa.array(sums), _lists(pair[~hit], left), _lists(links[~hit], left)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *made], names=[*plain, *results])

    return ready.mapInArrow(apply, ", ".join([*own, "n_best long, count_sum long, _pairs array<long>, _links array<long>"]))
