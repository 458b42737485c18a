"""Score tables on top of segment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, preview
from .metrics import corpus_scores
from .positions import head


def worst_segments(scored: DataFrame, by: list[str], ties: list[str], k: int = 5) -> DataFrame:
    """The ``k`` lowest segment chrF per group; ties keep the segment order."""
    return head(scored, by, ["chrf", *ties], k, rank="rank")


def flagged_report(
    scored: DataFrame, texts: DataFrame, by: list[str], ties: list[str], k: int = 5
) -> DataFrame:
    """Worst segments as report lines: their keys, 1-based number of at least four digits,
    score and preview.

    Only the few worst segments are joined with their texts (``hyp``).
    """
    keys = [*by, *ties]
    worst = worst_segments(scored.select(*keys, "chrf"), by, ties, k)
    return worst.join(texts.select(*keys, "hyp"), keys).select(
        *keys,
        "rank",
        F.format_string("%04d", F.col(ties[-1]) + 1).alias("number"),
        "chrf",
        preview("hyp", 70, "…").alias("preview"),
    )


def compare_systems(scored: DataFrame, elapsed: DataFrame | None = None) -> DataFrame:
    """One row per system; ``elapsed(system, seconds)`` adds inference times if measured."""
    scores = corpus_scores(scored, ["system"])
    if elapsed is None:
        return scores
    return scores.join(elapsed.select("system", "seconds"), "system", "left")


def run_summary(
    documents: DataFrame,
    counts: DataFrame,
    translated: DataFrame,
    target: str,
    briefs: DataFrame | None = None,
) -> DataFrame:
    """One row per document.  Fallbacks count as translated rows, and are shown as well."""
    done = translated.groupBy("doc_id").agg(
        F.count("*").alias("n_translated"),
        F.count_if("is_fallback").alias("n_fallback"),
    )
    rows = documents.select("doc_id").join(counts, "doc_id", "left").join(done, "doc_id", "left")
    if briefs is None:
        rows = rows.withColumn("has_brief", F.lit(False))
    else:
        present = briefs.filter(~is_blank("brief")).select("doc_id", F.lit(True).alias("has_brief"))
        rows = rows.join(present, "doc_id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "doc_id",
        F.lit("completed").alias("status"),
        F.lit(target).alias("target_language"),
        F.coalesce("n_translated", zero).alias("paragraphs_translated"),
        F.coalesce("n_fallback", zero).alias("n_fallback"),
        F.coalesce("n_paragraphs", zero).alias("total_paragraphs"),
        F.coalesce("n_tables", zero).alias("tables_translated"),
        F.coalesce("n_images", zero).alias("images_preserved"),
        F.coalesce("has_brief", F.lit(False)).alias("translation_brief"),
    )
