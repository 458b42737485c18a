"""Inline runs: choosing the run that carries a translation, and writing it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .positions import spread_join


def dominant_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run without picture of each paragraph; the first one wins a tie."""
    return (
        runs.filter(~F.col("has_picture"))
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("run_no", "text"),
                F.struct(F.length("text"), -F.col("run_no")),
            ).alias("_run")
        )
        .select(*keys, F.col("_run.run_no").alias("run_no"), F.col("_run.text").alias("text"))
    )


def _carriers(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per paragraph: picture flag, last run number and the number of its carrier run.

    The carrier is the first picture-free run with text if the paragraph has a picture,
    else the dominant run; it is null if there is none.
    """
    plain = ~F.col("has_picture")
    rank = F.struct(F.length("text"), -F.col("run_no"))
    facts = runs.groupBy(*keys).agg(
        F.bool_or("has_picture").alias("_has_image"),
        F.max("run_no").alias("_last"),
        F.min(F.when(plain & ~is_blank("text"), F.col("run_no"))).alias("_first_text"),
        F.max_by("run_no", F.when(plain, rank)).alias("_dominant"),
    )
    return facts.select(
        *keys,
        "_has_image",
        "_last",
        F.when(F.col("_has_image"), F.col("_first_text")).otherwise(F.col("_dominant")).alias("_carrier"),
    )


def write_runs(runs: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after the paragraph translations ``(*keys, text)`` are put in.

    With a picture: the carrier gets the whole text and the other runs keep theirs, or a
    new run with a leading space is added.  Without: the carrier gets it and the others
    become empty, or a new run is added.  A blank translation changes nothing.
    """
    new = translations.select(*keys, strip("text").alias("_new")).filter(~is_blank("_new"))
    facts = new.join(_carriers(runs, keys), keys, "left")
    plain = ~F.col("has_picture")
    changed = (
        F.when(F.col("_new").isNull() | ~plain, F.col("text"))
        .when(F.col("run_no") == F.col("_carrier"), F.col("_new"))
        .when(F.col("_has_image") | F.col("_carrier").isNull(), F.col("text"))
        .otherwise(F.lit(""))
    )
    known = facts.filter(F.col("_last").isNotNull())
    kept = spread_join(runs, known, keys, "run_no", "_last").select(
        *runs.columns[: runs.columns.index("text")],
        changed.alias("text"),
        *runs.columns[runs.columns.index("text") + 1 :],
    )
    lead = F.when(F.coalesce(F.col("_has_image"), F.lit(False)), F.lit(" ")).otherwise(F.lit(""))
    values = {
        "run_no": F.coalesce(F.col("_last") + 1, F.lit(0)),
        "text": F.concat(lead, F.col("_new")),
        "has_picture": F.lit(False),
    }
    added = facts.filter(F.col("_carrier").isNull()).select(
        *[
            F.col(f.name)
            if f.name in keys
            else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in runs.schema.fields
        ]
    )
    return kept.unionByName(added)


def paragraph_texts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Text of every paragraph: all its runs in order.  A group is one paragraph."""
    part = F.struct("run_no", F.coalesce("text", F.lit("")).alias("text"))
    return (
        runs.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(part)).alias("_runs"))
        .select(*keys, F.array_join(F.transform("_runs", lambda r: r["text"]), "").alias("text"))
    )


def plain_rebuild(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs of a document built without its original: one run with the flags.

    An ``alignment`` column is carried.  Blank paragraphs stay as empty ones; pictures cannot be kept.
    """
    has_text = ~is_blank("text")
    return paragraphs.select(
        *keys,
        F.when(has_text, F.col("text")).otherwise(F.lit("")).alias("text"),
        (has_text & F.coalesce("is_bold", F.lit(False))).alias("is_bold"),
        (has_text & F.coalesce("is_italic", F.lit(False))).alias("is_italic"),
        F.coalesce("has_image", F.lit(False)).alias("lost_image"),
        *[c for c in ("alignment",) if c in paragraphs.columns],
    )
