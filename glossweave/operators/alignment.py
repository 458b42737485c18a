"""Joins that bring replies, references and originals together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MISMATCH_ERROR_SHARE
from ..functions.replies import align_items, parse_items
from ..functions.text import is_blank, percent, strip


def align_responses(batches: DataFrame) -> DataFrame:
    """Add ``aligned`` items to batches that carry their reply in ``raw``.

    A null ``raw`` (failed call, or no call because all items are blank) gives the inputs.
    """
    return batches.withColumn("aligned", align_items(F.col("items"), parse_items(F.col("raw"))))


def zip_segments(hyps: DataFrame, refs: DataFrame, pos: str | list[str] = "pos") -> DataFrame:
    """Pair hypotheses ``(system, pos, hyp)`` with shared references ``(pos, ref)``.

    With ``pos=["doc_id", "pos"]`` every document has references of its own.

    Surplus rows of either side drop out.  Positions are unique per system, so no key is hot.
    """
    return hyps.join(refs, pos)


def length_report(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Per system: how many segments a positional zip drops, and how serious that is."""
    counts = hyps.groupBy("system").agg(F.count("*").alias("n_hyp"))
    return length_severity(counts.withColumn("n_ref", refs.agg(F.count("*")).scalar()), ["system"])


def length_severity(counts: DataFrame, keys: list[str]) -> DataFrame:
    """What a positional zip of ``n_hyp`` and ``n_ref`` segments drops."""
    h, r = F.col("n_hyp"), F.col("n_ref")
    longer, shorter = F.greatest(h, r), F.least(h, r)
    dropped = longer - shorter
    return counts.select(
        *keys,
        "n_hyp",
        "n_ref",
        dropped.alias("n_dropped"),
        F.when(h > r, "hypotheses").when(r > h, "references").alias("dropped_side"),
        F.when(dropped > 0, shorter).alias("first_dropped"),
        F.when(dropped > 0, longer - 1).alias("last_dropped"),
        F.when(dropped > 0, percent(dropped, longer)).alias("dropped_share"),
        F.when(dropped == 0, F.lit("none"))
        .when(dropped / longer > MISMATCH_ERROR_SHARE, F.lit("error"))
        .otherwise(F.lit("warning"))
        .alias("severity"),
    )


def merge_by_index(original: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Original paragraphs with their translations put in, untranslated ones unchanged.

    ``original`` holds every paragraph, also those that were never sent for translation.
    """
    new = translated.select(*keys, strip("text").alias("_new"))
    return (
        original.join(new, keys, "left")
        .withColumn("text", _unless_blank(F.col("_new"), F.col("text")))
        .drop("_new")
    )


def _unless_blank(new: Column, old: Column) -> Column:
    return F.when(F.coalesce(new, F.lit("")) == "", old).otherwise(new)


def lookup_cells(cells: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with their translation at the same coordinates, else with their own text."""
    new = translated.select(*keys, F.col("text").alias("_new"))
    return (
        cells.join(new, keys, "left")
        .withColumn("text", F.coalesce("_new", "text"))
        .drop("_new")
    )


def sentence_detail(bitext: DataFrame, ours: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Source, our translation, optionally another system's, and the reference."""
    rows = bitext.join(ours.select("seg_id", F.col("hyp").alias("ours")), "seg_id")
    if other is not None:
        rows = rows.join(other.select("seg_id", F.col("hyp").alias("other")), "seg_id", "left")
    else:
        rows = rows.withColumn("other", F.lit(None).cast("string"))
    return rows.select("seg_id", "source", "ours", "other", "reference")


def with_brief(docs: DataFrame, briefs: DataFrame) -> DataFrame:
    """Attach each document's brief to the document row, before batches are made.

    One row per key on both sides; the batches then inherit the brief inside their row.
    """
    return docs.join(briefs.select("doc_id", strip("brief").alias("brief")), "doc_id", "left")


def non_blank(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.filter(~is_blank(text))
