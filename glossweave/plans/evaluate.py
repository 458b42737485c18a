"""Score translations against references, or against the source through back-translation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.alignment import align_responses, length_severity, zip_segments
from ..operators.batching import batch_rows
from ..operators.metrics import corpus_scores, score_spread, segment_scores
from ..operators.positions import head
from ..operators.requests import back_translation_requests
from ..operators.scoring import flagged_report
from ..operators.segmentation import explode_rows
from ..session import saved
from ..sources.references import read_references
from .translate import Options


@dataclass(frozen=True)
class Evaluation:
    """Result tables: a row per segment, then a few rows per group."""

    segments: DataFrame
    corpus: DataFrame
    spread: DataFrame
    flagged: DataFrame


def evaluate(
    pairs: DataFrame,
    keys: list[str],
    by: list[str],
    mode: str = "reference",
    k: int = 5,
    folder: str | None = None,
) -> Evaluation:
    """Score ``(*keys, hyp, ref)``.  ``keys`` must contain ``by`` and end with the position.

    Segment scores feed three tables; with a ``folder`` they are written once.
    """
    scored = saved(segment_scores(pairs, keys), folder, "segments")
    ties = [c for c in keys if c not in by]
    return Evaluation(
        segments=scored,
        corpus=corpus_scores(scored, by, mode),
        spread=score_spread(scored, by),
        flagged=flagged_report(scored, pairs, by, ties, k),
    )


def translation_sample(translations: DataFrame, n: int) -> DataFrame:
    """First ``n`` non-blank translated paragraphs of each document, with dense ``pos``."""
    live = translations.filter(~is_blank("text")).drop("is_fallback")
    ranked = head(live, ["doc_id"], "pos", n, rank="_rank")
    return ranked.withColumn("pos", F.col("_rank") - 1).drop("_rank")


def proxy_pairs(translations: DataFrame, back_translator, options: Options = Options()) -> DataFrame:
    """``(doc_id, index, hyp, ref)``: the sample translated back, and its source texts.

    The whole sample of a document is one request; a failed request gives its inputs.  The
    source texts travel inside the batch, so the translations are read only once.
    """
    n = options.eval_back_translate_sample
    batches = batch_rows(
        translation_sample(translations, n), ["doc_id"], n, carry=("source_text",)
    )
    requests = back_translation_requests(batches, options.target_language, options.source_language)
    replies = align_responses(back_translator.respond(requests, ["doc_id", "batch_id"]))
    rows = explode_rows(replies, ["doc_id", "items"], F.col("aligned"), "_n", "_a")
    return rows.select(
        "doc_id",
        F.col("_a.index").alias("index"),
        F.col("_a.text").alias("hyp"),
        F.get("items", F.col("_n"))["source_text"].alias("ref"),
    )


def choose_pairs(
    translations: DataFrame, references: DataFrame | None, back_translator, options: Options = Options()
) -> tuple[DataFrame, str]:
    """Pairs and mode: references ``(doc_id, index, ref)`` if given, else back-translation."""
    if references is not None:
        hyps = translations.select("doc_id", "index", F.col("text").alias("hyp"))
        return hyps.join(references.select("doc_id", "index", "ref"), ["doc_id", "index"]), "reference"
    return proxy_pairs(translations, back_translator, options), "back_translation"


@dataclass(frozen=True)
class FilePairs:
    """Pairs to score, how they were made, how lengths differ, and the files whose names are no document's.

    Without references the last two are None.
    """

    pairs: DataFrame
    mode: str
    lengths: DataFrame | None
    ignored: DataFrame | None = None


def file_pairs(
    translations: DataFrame, path: str, back_translator, options: Options = Options()
) -> FilePairs:
    """Pairs ``(doc_id, pos, hyp, ref)`` from reference files, or proxy pairs if there are none.

    The file named by a document's id holds its references, a line for each paragraph; several
    files of one name (``7.txt``, ``7.md``) follow one another.  Files with other names are left out
    and listed in ``ignored``, as ``(path, n_lines)``.
    """
    spark = translations.sparkSession
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    key = stem.try_cast(translations.schema["doc_id"].dataType)
    try:
        # Files that belong to no document are numbered each on its own.
        named = F.struct(key.alias("doc_id"), F.when(key.isNull(), F.col("path")).alias("path"))
        files = read_references(spark, path, named, "file")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        pairs = proxy_pairs(translations, back_translator, options)
        return FilePairs(pairs.withColumnRenamed("index", "pos"), "back_translation", None)
    known = translations.select("doc_id").distinct()
    refs = files.filter("file.doc_id is not null").select("file.doc_id", "pos", "ref")
    hyps = translations.select("doc_id", "pos", F.col("text").alias("hyp"))
    sides = [
        side.groupBy("doc_id").agg(F.count("*").alias(n)) for side, n in ((hyps, "n_hyp"), (refs, "n_ref"))
    ]
    counts = sides[0].join(sides[1].join(known, "doc_id"), "doc_id", "full").fillna(0, ["n_hyp", "n_ref"])
    foreign = files.filter("file.path is not null").groupBy("file.path").agg(F.count("*").alias("n_lines"))
    strange = sides[1].join(known, "doc_id", "left_anti").select(F.col("doc_id").cast("string").alias("path"), F.col("n_ref").alias("n_lines"))
    return FilePairs(
        zip_segments(hyps, refs, ["doc_id", "pos"]),
        "reference",
        length_severity(counts, ["doc_id"]),
        foreign.unionByName(strange),
    )
