"""Lookup expressions: score bands and quality tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import BLEU_BANDS, CHRF_BANDS, DEFAULT_QUALITY, QUALITY_NOTES


def _band(score: Column, bands: tuple) -> Column:
    first, *rest = bands
    label = F.when(score >= first[0], first[1])
    for cutoff, text in rest:
        label = label.when(score >= cutoff, text)
    return F.when(score.isNull(), F.lit(None)).otherwise(label.otherwise(F.lit("")))


def bleu_label(rounded_score: Column) -> Column:
    return _band(rounded_score, BLEU_BANDS)


def chrf_label(rounded_score: Column) -> Column:
    return _band(rounded_score, CHRF_BANDS)


def quality_note(tier: Column) -> Column:
    """Instruction text of a tier column; unknown and null tiers get the default."""
    notes = F.create_map(*[F.lit(x) for pair in QUALITY_NOTES.items() for x in pair])
    return F.coalesce(F.try_element_at(notes, tier), F.lit(QUALITY_NOTES[DEFAULT_QUALITY]))
