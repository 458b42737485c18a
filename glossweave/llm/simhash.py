"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are distinct first: a group of copies is one fingerprint from here on.  Then
pairs within ``BUDGET`` differing bits are found by walking a binary trie against itself:
a pair of nodes carries the bits in which their prefixes differ, goes on to the pairs of
their children, and is dropped as soon as the bits exceed the budget.

For Spark the trie is cut up.  The 64 bits are ``BLOCKS`` blocks, and of any pair within the
budget at least ``EXACT`` blocks agree.  For each choice of ``EXACT`` blocks there is a trie
that has those blocks' bits on top and in which node pairs go down the top along equal
bits only, so its subtrees below the top are independent of each other: the key of the one
shuffle.  Fingerprints of one subtree differ in the remaining bits only.

Only components are wanted, so a node pair is also dropped when all leaves of both nodes
are in one component already (found from neighbours in trie order and from earlier links),
and a task gives one link per linked fingerprint.  No link between different
fingerprints is lost: each is either found or between members of one found component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

SHINGLE = 4
BUDGET = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
EXACT = len(BLOCKS) - BUDGET
TRIES = list(combinations(range(len(BLOCKS)), EXACT))
#: Shingles hashed at once; bounds the memory for a long text.
AT_ONCE = 1 << 16
#: Node pairs that a walk takes on at once.
PAIRS = 1 << 19
#: Leaves that a walk takes on at once, beyond the last subtree's.
LEAVES = 1 << 17


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of all shingles of a text, repeats included; 0 without words."""
    import xxhash

    # Of bytes, lower() changes A-Z only and split() cuts at space and the controls 9 to 13.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), AT_ONCE):
        hashes = [digest(joined[a:b], 42) for a, b in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first)).view(">u8")[0])


def with_fingerprint(docs: DataFrame, size: int = SHINGLE, text: str = "text", column: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, size) for x in batch], np.uint64).view(np.int64))

    return docs.withColumn(column, prints(F.col(text)))


def _on_top(values: np.ndarray, trie: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits in the order of one trie, and the bits of its top."""
    order = [*TRIES[trie], *(b for b in range(len(BLOCKS)) if b not in TRIES[trie])]
    left = np.concatenate([[64], 64 - np.cumsum(BLOCKS)])  # bits below the start of each block
    path, at = np.zeros(len(values), np.uint64), 64
    for b in order:
        at -= BLOCKS[b]
        bits = (values >> np.uint64(left[b + 1])) & np.uint64((1 << BLOCKS[b]) - 1)
        path |= bits << np.uint64(at)
    top = sum(BLOCKS[b] for b in TRIES[trie])
    return path, path >> np.uint64(64 - top)


def _from_path(path: np.ndarray, trie: np.ndarray) -> np.ndarray:
    """Fingerprints back from the bit order of their tries."""
    left = np.concatenate([[64], 64 - np.cumsum(BLOCKS)])
    values = np.zeros(len(path), np.uint64)
    for t in np.unique(trie):
        own, at = trie == t, 64
        for b in [*TRIES[t], *(b for b in range(len(BLOCKS)) if b not in TRIES[t])]:
            at -= BLOCKS[b]
            bits = (path[own] >> np.uint64(at)) & np.uint64((1 << BLOCKS[b]) - 1)
            values[own] |= bits << np.uint64(left[b + 1])
    return values


def _roots(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each element's component: hook to the smaller root, then jump."""
    root = np.arange(n) if labels is None else labels.copy()
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        high, low = np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def linked(paths: np.ndarray, subtree: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Component (smallest position) of every leaf, by walking each subtree against itself.

    ``paths`` are sorted within equal ``subtree`` numbers, which are not decreasing.
    """
    n = len(paths)
    same = subtree[1:] == subtree[:-1]
    near = same & (_differing(paths[1:], paths[:-1]) <= budget)
    root = _roots(n, np.flatnonzero(near), np.flatnonzero(near) + 1)
    # Neighbours in a second order: bits reversed, so that late bits sort first.
    back = np.zeros(n, np.uint64)
    for k in range(64):
        back |= ((paths >> np.uint64(k)) & np.uint64(1)) << np.uint64(63 - k)
    order = np.lexsort((back, subtree))
    a, b = order[:-1], order[1:]
    near = (subtree[a] == subtree[b]) & (_differing(paths[a], paths[b]) <= budget)
    root = _roots(n, a[near], b[near], root)

    def changes(root: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    ones_at: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in ones_at:
            set_ = (paths >> np.uint64(bit)) & np.uint64(1)
            ones_at[bit] = np.concatenate([[0], np.cumsum(set_.astype(np.int64))])
        return ones_at[bit]

    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    ends = np.concatenate([starts[1:], [n]])
    some = ends - starts > 1
    change = changes(root)
    found: list[np.ndarray] = []
    waiting = 0
    stack = [(63, starts[some], ends[some], starts[some], ends[some], np.zeros(int(some.sum()), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        # Linked already: both nodes lie in one component.
        keep = (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo]) | (root[alo] != root[blo])
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > PAIRS:
            half = len(alo) // 2
            stack.append((bit, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
            stack.append((bit, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]))
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = _differing(paths[a], paths[b]) <= budget
            found.append(np.stack([a[near], b[near]]))
            waiting += int(near.sum())
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if waiting and (waiting > 4096 or not stack):
            pairs = np.concatenate(found, axis=1)
            root, found, waiting = _roots(n, pairs[0], pairs[1], root), [], 0
            change = changes(root)
        if not len(alo) or bit < 0:
            continue
        c = ones(bit)
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        pairs = [
            (alo, amid, blo, bmid, err, np.ones(len(alo), bool)),
            (amid, ahi, bmid, bhi, err, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, err + 1, np.ones(len(alo), bool)),
            (amid, ahi, blo, bmid, err + 1, ~own),
        ]
        children = []
        for x0, x1, y0, y1, e, on in pairs:
            on = on & (x1 > x0) & (y1 > y0) & (e <= budget) & ((x0 != y0) | (x1 - x0 > 1))
            children.append([z[on] for z in (x0, x1, y0, y1, e)])
        stack.append((bit - 1, *(np.concatenate(z) for z in zip(*children))))
    if found:
        pairs = np.concatenate(found, axis=1)
        root = _roots(n, pairs[0], pairs[1], root)
    return root


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in every trie: the key of its subtree and its bits in trie order."""
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for trie in range(len(TRIES)):
            path, top = _on_top(values, trie)
            key = (np.uint64(trie) << np.uint64(32) | top).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(path.view(np.int64))], names=["key", "path"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the subtrees of one task, whose rows come sorted by subtree and bits."""

    def links(keys: np.ndarray, paths: np.ndarray) -> pa.RecordBatch:
        root = linked(paths, keys)
        own = np.flatnonzero(root != np.arange(len(root)))
        trie = keys >> 32
        ends = [_from_path(paths[x], trie[x]).view(np.int64) for x in (own, root[own])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append(
            (
                batch.column(0).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
            )
        )
        size += batch.num_rows
        if size < LEAVES or not batch.num_rows:
            continue
        keys, paths = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1]))  # the last subtree may go on
        if cut:
            yield links(keys[:cut], paths[:cut])
        held, size = [(keys[cut:], paths[cut:])], len(keys) - cut
    if size:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the distinct fingerprints ``fp`` to their components."""
    spread = prints.select("fp").mapInArrow(_spread, "key long, path long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        spread.repartition(parts, "key").sortWithinPartitions("key", "path").mapInArrow(_walk, "a long, b long")
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``; the component is its smallest id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Repeated
    rows stay repeated.  A row with a null id is grouped but never names its component, which
    is null only if no member has an id.  An empty table gives an empty result.
    """
    rows = saved(
        with_fingerprint(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")), size, "_text", "fp")
        .drop("_text"),
        "fingerprints",
    )
    # One row per fingerprint; sorted path order needs no sign, as a subtree shares its top bit.
    prints = saved(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "prints")
    roots = saved(connected_components(near_links(prints)), "roots")
    named = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_least"
    )
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    labels = saved(named.join(least, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(F.col("_id").alias(id_column), "fp", "component_id")
