"""Compare translation systems on a shared set of references."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignment import align_responses, zip_segments
from ..operators.batching import batch_rows, unbatch
from ..operators.metrics import segment_scores
from ..operators.positions import dense_position
from ..operators.requests import translation_requests
from ..operators.scoring import compare_systems
from .translate import Options


def score_systems(hyps: DataFrame, bitext: DataFrame) -> DataFrame:
    """Segment scores of ``(system, seg_id, hyp)`` against ``(seg_id, source, reference)``."""
    refs = bitext.select("seg_id", F.col("reference").alias("ref"))
    return segment_scores(zip_segments(hyps, refs, "seg_id"), ["system", "seg_id"])


def run_benchmark(
    hyps: DataFrame, bitext: DataFrame, elapsed: DataFrame | None = None
) -> DataFrame:
    """One comparison row per system."""
    return compare_systems(score_systems(hyps, bitext), elapsed)


def system_hypotheses(bitext: DataFrame, translator, options: Options = Options()) -> DataFrame:
    """``(seg_id, hyp, seconds)`` of ``(seg_id, source)``, translated in batches in the order of ``seg_id``.

    ``seconds`` is what the translator measured around its calls, shared by the segments of a request;
    it is null for translators that do not call a model.
    """
    rows = bitext.select("seg_id", F.col("source").alias("text"), F.lit(0).alias("_all"))
    placed = dense_position(rows, ["_all"], "seg_id").withColumn("index", F.col("seg_id"))
    batches = batch_rows(placed, [], options.batch_size)
    requests = translation_requests(batches, options.target_language, options.translation_quality, None, options.source_language)
    replies = translator.respond(requests, ["batch_id"])
    spent = F.col("seconds") if "seconds" in replies.columns else F.lit(None).cast("double")
    share = align_responses(replies).withColumn("_share", spent / F.size("items"))
    return unbatch(share, ["_share"]).select(F.col("index").alias("seg_id"), F.col("text").alias("hyp"), F.col("_share").alias("seconds"))


def timed_hypotheses(
    spark: SparkSession, systems: dict[str, Callable[[], DataFrame]], folder: str
) -> tuple[DataFrame, DataFrame]:
    """``(system, seg_id, hyp)`` of all systems, each written once, and ``(system, seconds)``.

    A system is a frame ``(seg_id, hyp, seconds)``, as ``system_hypotheses`` makes it.  Its time is the sum of
    its ``seconds``, so reading, planning and writing are no part of it; without that column it is null.
    """
    frames = []
    for k, (name, make) in enumerate(systems.items()):
        own = make()
        spent = F.col("seconds").cast("double") if "seconds" in own.columns else F.lit(None).cast("double")
        path = f"{folder}/system-{k}"
        own.select("seg_id", "hyp", spent.alias("seconds")).write.mode("overwrite").parquet(path)
        frames.append(spark.read.parquet(path).select(F.lit(name).alias("system"), "seg_id", "hyp", "seconds"))
    every = reduce(DataFrame.unionByName, frames)
    elapsed = every.groupBy("system").agg(F.round(F.sum("seconds"), 2).alias("seconds"))
    return every.drop("seconds"), elapsed
