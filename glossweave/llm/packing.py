"""Packing of documents into sequences along a space-filling curve.

1. ``place``: each document becomes token ids (and an end id), a hashed vector of them, that
   vector's projection to ``DIMENSIONS`` numbers, and their key on the Hilbert curve.  Near
   documents have near vectors, and what is near on the curve is near in space.
2. ``order``: ids stay where they are; a row of three numbers a document (row, key, length) is
   sorted by ranges of the key.  Running lengths inside a range and one total per range give
   every document its place in the one long row of all tokens.
3. ``pack``: that row is cut every ``length`` tokens.  A document meets its place in one join on
   unique rows, and each of its pieces follows from the two.

So neighbours on the curve share a sequence, every sequence but the last is full, and the padding of
the whole corpus is less than one sequence.  Equal documents have equal keys; the row number
tells them apart in the sort, so a group of copies is spread over ranges like any others.

Defined cases: null and empty texts have the end id only.  A text is encoded whole by one task.
Repeated rows are documents of their own; ids may be null or repeated; an empty table gives
no rows.  Only the columns in ``keep`` are carried; a result of the same name replaces them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import default_tokenizer, tokenizer
from .common import saved

LENGTH = 2048
END_ID = 1
#: Hashed vectors have BUCKETS entries; the curve has DIMENSIONS axes of AXIS_BITS bits, 60 in all.
BUCKETS, DIMENSIONS, AXIS_BITS = 256, 4, 15
SEED = 7
#: Documents worked on at once in a worker.
SLICE = 256


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (rows) of unsigned ``bits``-bit coordinates.

    Skilling's transform (2004): from the top bit down, undo the turns and mirrors of the
    sub-cubes a point lies in, then read the bits of all axes interleaved as a Gray code.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(axes):
            mirrored = (x[axis] >> bit) & 1 == 1
            swapped = np.where(mirrored, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0] ^ swapped)
            if axis:
                x[axis] ^= swapped
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turned
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[axis] >> bit) & 1
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Hilbert keys of documents given by their ids one after another.

    An id adds a fixed sign to a fixed entry of its document's vector; repeats count by the
    logarithm.  Unit vectors are projected on fixed unit directions, so that every axis
    lies in -1 to 1.
    """
    fixed = np.random.default_rng(SEED)
    bucket, sign = fixed.integers(0, BUCKETS, size), fixed.choice([-1.0, 1.0], size)
    directions = fixed.standard_normal((BUCKETS, DIMENSIONS))
    directions /= np.linalg.norm(directions, axis=0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    cells, counts = np.unique(owner * size + ids, return_counts=True)
    token = cells % size
    hashed = np.bincount(
        cells // size * BUCKETS + bucket[token], sign[token] * np.log1p(counts), len(lengths) * BUCKETS
    ).reshape(-1, BUCKETS)
    norm = np.linalg.norm(hashed, axis=1, keepdims=True)
    axes = (hashed / np.where(norm > 0, norm, 1)) @ directions
    grid = np.clip((axes + 1) * (1 << (AXIS_BITS - 1)), 0, (1 << AXIS_BITS) - 1).astype(np.int64)
    return hilbert_key(grid, AXIS_BITS)


def id_kind(path: str) -> str:
    """Little-endian unsigned integers that hold every id of the vocabulary."""
    return "<u2" if len(tokenizer(path).token_bytes) <= 1 << 16 else "<u4"


def place(docs: DataFrame, keep: list[str], text: str, path: str) -> DataFrame:
    """``keep``, ``_row``, ``_key``, ``_n`` and ``_ids`` (with the end id) of every document, written once.

    Ids are bytes of ``id_kind``: half the size where the vocabulary allows it.
    """
    kind = id_kind(path)
    ready = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "_text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                encoded = [np.append(x, np.int32(END_ID)) for x in words.encode(batch.column(len(own)).to_pylist(), plain=False)]
                lengths = np.array([len(x) for x in encoded])
                keys = curve_keys(np.concatenate(encoded).astype(np.int64), lengths, len(words.token_bytes))
                ids = pa.array([x.astype(kind).tobytes() for x in encoded], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(own)], pa.array(keys), pa.array(lengths), ids],
                    names=[*batch.schema.names[: len(own)], "_key", "_n", "_ids"],
                )

    return saved(ready.mapInArrow(apply, ", ".join([*own, "_key long", "_n long", "_ids binary"])), "placed")


def order(placed: DataFrame, parts: int) -> tuple[DataFrame, np.ndarray]:
    """Tokens before each document: (``_row``, ``_part``, ``_before``) and the tokens before each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=["_row", "_part", "_n", "_before"])
            before = int(ends[-1]) if len(ends) else before

    light = placed.select("_row", "_key", "_n")
    ranges = light.repartitionByRange(parts, "_key", "_row").sortWithinPartitions("_key", "_row")
    rows = ranges.select("_row", F.spark_partition_id().alias("_part"), "_n").mapInArrow(
        run, "_row long, _part int, _n long, _before long"
    )
    # Written, because a range sort done anew may draw other bounds.
    starts = saved(rows, "order")
    # One total for each of ``parts`` ranges.
    totals = np.zeros(parts + 1, np.int64)
    for r in starts.groupBy("_part").agg(F.sum("_n").alias("n")).toLocalIterator():
        totals[r._part + 1] = r.n
    return starts.select("_row", "_part", "_before"), np.cumsum(totals)


RESULTS = ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    parts: int | None = None,
) -> DataFrame:
    """A row per piece: ``keep``, where it stands in its document and in its sequence, and its ids.

    ``parts`` ranges (by default as many as shuffles have partitions) are sorted side by side; their
    totals are the only thing that comes to the driver.
    """
    spark = docs.sparkSession
    names = [c for c in keep if c not in RESULTS]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or default_tokenizer()
    kind = id_kind(path)
    placed = place(docs, names, text, path)
    starts, first = order(placed, parts)
    ready = placed.join(starts, "_row").select(*names, "_ids", "_n", "_part", "_before")
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name in names]
    schema = ", ".join([*own, "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, n, part, before = batch.columns[len(names) :]
                n = n.to_numpy()
                flat = np.frombuffer(b"".join(ids.to_pylist()), kind).astype("<u4")
                place = first[part.to_numpy()] + before.to_numpy()
                # Sequences that a document touches; the first piece may start inside one.
                pieces = (place + n - 1) // length - place // length + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = place[doc] // length + number
                start = np.maximum(sequence * length - place[doc], 0)
                end = np.minimum((sequence + 1) * length - place[doc], n[doc])
                base = (np.cumsum(n) - n)[doc]
                crc = [zlib.crc32(flat[a:b]) for a, b in zip((base + start).tolist(), (base + end).tolist())]
                # The pieces of a slice are its ids in order.
                bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                cols = [
                    pa.array(start),
                    pa.array(end - start),
                    pa.ListArray.from_arrays(bounds, flat.view(np.int32)),
                    pa.array(crc, pa.int64()),
                    pa.array(n[doc]),
                    pa.array(sequence),
                    pa.array(place[doc] + start - sequence * length),
                ]
                kept = [c.take(pa.array(doc)) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*names, *RESULTS])

    return ready.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of whole sequences; a group is one sequence, so it is bounded."""
    part = F.struct("offset", "ids")
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("ids")
    )
