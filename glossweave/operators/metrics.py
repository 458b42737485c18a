"""BLEU and chrF where the row is.

A pair has both texts in one row, so its statistics need no shuffle: the row's texts go through
one Arrow-batched kernel that decodes them once, cuts them into units and counts clipped grams of
all segments of a slice at once.  Where a gram of the highest order fits a machine word, one sort brings equal grams
of all orders together.  Else grams get numbers order by order (number of the gram without its
last unit, then the last unit); a gram that one side lacks cannot be part of a longer match, so
only the rest goes on to the next order.  Corpus
scores are partial aggregates over the segments' statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..functions.fixed import BLEU_ORDER, CHRF_BETA, CHRF_ORDER
from ..functions.labels import bleu_label, chrf_label
from ..functions.text import round2

BLEU_COLUMNS = (
    "sys_len",
    "ref_len",
    *[f"correct_{n}" for n in range(1, BLEU_ORDER + 1)],
    *[f"total_{n}" for n in range(1, BLEU_ORDER + 1)],
)
CHRF_COLUMNS = tuple(
    f"{side}_{n}" for side in ("hyp", "ref", "match") for n in range(1, CHRF_ORDER + 1)
)


#: Units of both sides that the kernel takes at once, beyond one segment's.
SLICE = 1 << 16


def _characters(texts: list[str] | grams.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts in a row without white space, as numbers from 1, and how many each has."""
    texts = texts if isinstance(texts, grams.Texts) else grams.Texts(texts)
    return texts.numbers[0], texts.count(texts.words)


def clipped_matches(units: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """Matches of every order per segment.

    ``units`` holds all hypotheses, then all references; ``sizes`` their lengths (2 x segments).
    """
    if units.dtype != np.uint64:
        units = grams.numbered(units)[0]
    bits = (int(units.max(initial=0)) + 1).bit_length()
    if bits * order + (len(sizes) // 2).bit_length() + 1 <= 64:
        return _matches_in_words(units, sizes, order, bits)
    return _matches_by_order(units.astype(np.int64), sizes, order)


def _matches_in_words(number: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A gram of the highest order fits a machine word, after its segment: one sort is that of all orders."""
    segments = len(sizes) // 2
    out = np.zeros((segments, order), np.int64)
    if not len(number):
        return out
    # After each text stand units that it does not have, other ones in the hypotheses than in the references.
    past = (order - 1) * np.arange(len(sizes))
    at = np.arange(len(number)) + np.repeat(past, sizes)
    padded = np.zeros(len(number) + (order - 1) * len(sizes), np.uint64)
    padded[int(sizes[:segments].sum()) + (order - 1) * segments :] = (1 << bits) - 1
    padded[at] = number
    segment = np.arange(segments, dtype=np.uint64) << np.uint64(bits * order + 1)
    word = grams.windows(padded, order, bits)[at] << np.uint64(1)
    word |= np.repeat(np.concatenate([segment, segment | np.uint64(1)]), sizes)
    word.sort()
    refs = np.cumsum((word & np.uint64(1)).view(np.int64))
    word >>= np.uint64(1)
    # Where grams begin, by how much each differs from the one before, and windows of the references (high half)
    # and hypotheses before it.  A gram of a lower order begins where one of a higher order does.
    apart = word[1:] ^ word[:-1]
    start = np.flatnonzero(apart != 0)
    ends = np.array([np.iinfo(np.uint64).max])
    apart = np.concatenate([ends, apart[start], ends])
    start += 1
    before = np.concatenate([[0], refs[start - 1] * ((1 << 32) - 1) + start, [refs[-1] * ((1 << 32) - 1) + len(word)]])
    first = np.flatnonzero(apart[:-1] >= np.uint64(1 << bits * order))
    owner = (word[np.append(0, start)[first]] >> np.uint64(bits * order)).astype(np.int64)
    for n in range(order, 0, -1):
        if n < order:
            kept = np.flatnonzero(apart >= np.uint64(1 << bits * (order - n)))
            apart, before = apart.take(kept), before.take(kept)
            first = np.searchsorted(kept, first)
        sides = np.diff(before).view(np.int32)
        out[owner, n - 1] = np.add.reduceat(np.minimum(sides[::2], sides[1::2]), first)
    return out


def _matches_by_order(units: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """For many different units: grams get numbers order by order."""
    segments = len(sizes) // 2
    out = np.zeros((segments, order), np.int64)
    base = units.max(initial=0) + 1
    at = np.arange(len(units))
    left = np.repeat(np.cumsum(sizes), sizes) - at
    text = np.repeat(np.arange(len(sizes)), sizes)
    is_ref = text >= segments
    segment = text - segments * is_ref
    gram = segment
    for n in range(1, order + 1):
        if n > 1:
            fits = left[at] >= n
            at, gram = at[fits], gram[fits]
        if not len(at):
            break
        number, found = pd.factorize(gram * base + units[at + (n - 1)])
        in_ref = np.bincount(number[is_ref[at]], minlength=len(found))
        common = np.minimum(np.bincount(number, minlength=len(found)) - in_ref, in_ref)
        owner = np.empty(len(found), np.int64)
        owner[number] = segment[at]
        out[:, n - 1] = np.bincount(owner, common, segments)
        shared = common[number] > 0
        at, gram = at[shared], number[shared]
    return out


def _slices(hyp: pa.Array, ref: pa.Array) -> Iterator[slice]:
    past = np.cumsum(pc.utf8_length(hyp).to_numpy() + pc.utf8_length(ref).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(past):
        before = past[start - 1] if start else 0
        end = min(int(np.searchsorted(past, before + SLICE)) + 1, len(past))
        yield slice(start, end)
        start = end


def _counts(*kinds) -> Column:
    """UDF from ``(hyp, ref)`` to ``[hyp units, ref units, matches of every order]`` of each of ``kinds``.

    A kind is the highest order and what cuts texts into units.
    """

    @F.arrow_udf("array<bigint>")
    def count(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        hyp, ref = (pc.fill_null(side, "") for side in (hyp, ref))
        width = sum(order + 2 for order, _ in kinds)
        rows = [np.zeros((0, width), np.int64)]
        for part in _slices(hyp, ref):
            texts = grams.Texts(pa.concat_arrays([hyp[part], ref[part]]))
            n, columns = part.stop - part.start, []
            for order, units in kinds:
                numbers, sizes = units(texts)
                columns += [sizes[:n], sizes[n:], clipped_matches(numbers, sizes, order)]
            rows.append(np.column_stack(columns))
        ends = np.arange(len(hyp) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).ravel()))

    return count("hyp", "ref")


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _windows_of(length: Column, n: int) -> Column:
    return F.greatest(length - (n - 1), F.lit(0)).cast("bigint")


_BLEU, _CHRF = (BLEU_ORDER, grams.number_13a), (CHRF_ORDER, _characters)


def _bleu_columns(counts: str) -> list[Column]:
    c = F.col(counts)
    return [
        c[0].alias("sys_len"),
        c[1].alias("ref_len"),
        *[c[n + 1].alias(f"correct_{n}") for n in range(1, BLEU_ORDER + 1)],
        *[_windows_of(c[0], n).alias(f"total_{n}") for n in range(1, BLEU_ORDER + 1)],
    ]


def _chrf_columns(counts: str, at: int = 0) -> list[Column]:
    """Hypothesis counts of an order the reference does not have are zero, per segment.

    The statistics of chrF begin at ``at``.
    """
    c = F.col(counts)
    hyp, ref = c[at], c[at + 1]
    orders = range(1, CHRF_ORDER + 1)
    return [
        *[
            F.when(ref >= n, _windows_of(hyp, n)).otherwise(F.lit(0).cast("bigint")).alias(f"hyp_{n}")
            for n in orders
        ],
        *[_windows_of(ref, n).alias(f"ref_{n}") for n in orders],
        *[c[at + n + 1].alias(f"match_{n}") for n in orders],
    ]


def bleu_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of BLEU, a row per row of ``pairs``."""
    return pairs.select(*keys, _counts(_BLEU).alias("_b")).select(*keys, *_bleu_columns("_b"))


def chrf_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of chrF, a row per row of ``pairs``."""
    return pairs.select(*keys, _counts(_CHRF).alias("_c")).select(*keys, *_chrf_columns("_c"))


def total_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Statistics summed over segments; the corpus score is computed from these sums."""
    columns = [c for c in stats.columns if c in BLEU_COLUMNS or c in CHRF_COLUMNS]
    return stats.groupBy(*by).agg(
        F.count("*").alias("n_evaluated"), *[F.sum(c).alias(c) for c in columns]
    )


def with_bleu(stats: DataFrame, score: str = "bleu", keep_parts: bool = False) -> DataFrame:
    """Add unrounded BLEU with effective order to rows of statistics.

    The parts (``precision_1..4`` in per cent, smoothed, and ``bp``) are columns of their
    own, so that each is computed once.
    """
    orders = range(1, BLEU_ORDER + 1)
    precisions = [f"precision_{n}" for n in orders]
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    parts = stats.withColumns(
        {
            "_any": F.greatest(*[F.col(f"correct_{n}") for n in orders]) > 0,
            "bp": F.when(sys_len >= ref_len, F.lit(1.0))
            .when(sys_len > 0, F.exp(1 - ref_len / sys_len))
            .otherwise(F.lit(0.0)),
            **{
                f"_zero_{n}": F.when(
                    (F.col(f"total_{n}") > 0) & (F.col(f"correct_{n}") == 0), 1
                ).otherwise(0)
                for n in orders
            },
        }
    )
    smooth: Column = F.lit(0)
    columns = {}
    for n in orders:
        smooth = smooth + F.col(f"_zero_{n}")
        correct, total = F.col(f"correct_{n}"), F.col(f"total_{n}")
        columns[f"precision_{n}"] = (
            F.when(~F.col("_any") | (total == 0), F.lit(0.0))
            .when(correct == 0, F.lit(100.0) / (F.pow(F.lit(2.0), smooth) * total))
            .otherwise(F.lit(100.0) * correct / total)
        )
    scored = parts.withColumns(columns)
    logs = _add(F.when(F.col(p) > 0, F.log(p)).otherwise(0.0) for p in precisions)
    used = _add(F.when(F.col(p) > 0, 1).otherwise(0) for p in precisions)
    scored = scored.withColumn(
        score, F.when(F.col("_any"), F.col("bp") * F.exp(logs / used)).otherwise(F.lit(0.0))
    ).drop("_any", *[f"_zero_{n}" for n in orders])
    return scored if keep_parts else scored.drop("bp", *precisions)


def bleu_detail(score: Column) -> Column:
    """One-line account of a corpus score, from a row with its BLEU parts."""
    ratio = F.when(F.col("ref_len") > 0, F.col("sys_len") / F.col("ref_len")).otherwise(F.lit(0.0))
    return F.format_string(
        "BLEU = %.2f %.1f/%.1f/%.1f/%.1f (BP = %.3f ratio = %.3f hyp_len = %d ref_len = %d)",
        score,
        *[F.col(f"precision_{n}") for n in range(1, BLEU_ORDER + 1)],
        F.col("bp"),
        ratio,
        F.col("sys_len"),
        F.col("ref_len"),
    )


def with_chrf(stats: DataFrame, score: str = "chrf") -> DataFrame:
    """Add unrounded chrF to rows of statistics."""
    zero = F.lit(0.0)
    precision, recall, used = [], [], []
    for n in range(1, CHRF_ORDER + 1):
        hyp, ref, match = F.col(f"hyp_{n}"), F.col(f"ref_{n}"), F.col(f"match_{n}")
        both = (hyp > 0) & (ref > 0)
        precision.append(F.when(both, match / hyp).otherwise(zero))
        recall.append(F.when(both, match / ref).otherwise(zero))
        used.append(F.when(both, 1).otherwise(0))
    means = stats.withColumns({"_p": _add(precision), "_r": _add(recall), "_n": _add(used)})
    p, r = F.col("_p") / F.col("_n"), F.col("_r") / F.col("_n")
    weight = CHRF_BETA**2
    value = 100 * (1 + weight) * p * r / (weight * p + r)
    return means.withColumn(
        score, F.when(F.col("_p") + F.col("_r") > 0, value).otherwise(zero)
    ).drop("_p", "_r", "_n")


def segment_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics and rounded scores of every segment, one row each, in one pass."""
    both = pairs.select(*keys, _counts(_BLEU, _CHRF).alias("_c")).select(
        *keys, *_bleu_columns("_c"), *_chrf_columns("_c", BLEU_ORDER + 2)
    )
    scored = with_chrf(with_bleu(both))
    return scored.withColumns({"bleu": round2(F.col("bleu")), "chrf": round2(F.col("chrf"))})


def corpus_scores(scored: DataFrame, by: list[str], mode: str = "reference") -> DataFrame:
    """One row per group: rounded corpus scores, labels and detail.

    Scores come from summed statistics, not from a mean of segment scores.  A global
    result (``by=[]``) over no segments has count 0 and null scores.
    """
    some = F.col("n_evaluated") > 0
    raw = with_chrf(with_bleu(total_stats(scored, by), keep_parts=True))
    rounded = raw.withColumns(
        {
            "detail": F.when(some, bleu_detail(F.col("bleu"))),
            "bleu": F.when(some, round2(F.col("bleu"))),
            "chrf": F.when(some, round2(F.col("chrf"))),
        }
    )
    return rounded.select(
        *by,
        F.lit(mode).alias("mode"),
        "n_evaluated",
        "bleu",
        "chrf",
        bleu_label(F.col("bleu")).alias("bleu_label"),
        chrf_label(F.col("chrf")).alias("chrf_label"),
        "detail",
    )


def score_spread(scored: DataFrame, by: list[str]) -> DataFrame:
    """Lowest, mean and highest rounded segment chrF per group."""
    return scored.groupBy(*by).agg(
        F.min("chrf").alias("chrf_min"),
        round2(F.avg("chrf")).alias("chrf_mean"),
        F.max("chrf").alias("chrf_max"),
    )
