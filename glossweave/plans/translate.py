"""Translate a corpus: documents to paragraphs, requests, replies and documents again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..operators.alignment import align_responses, merge_by_index, with_brief
from ..operators.batching import batch_documents, unbatch
from ..operators import statistics
from ..operators.positions import head
from ..operators.requests import BRIEF_SECTIONS, brief_requests, review_requests, translation_requests
from ..operators.segmentation import all_paragraphs, paragraph_array, segment_documents
from ..operators.translators import ResumingTranslator
from ..session import saved
from ..sinks.documents import reassemble


@dataclass(frozen=True)
class Options:
    """Settings of a run; the defaults are those of a plain translation job."""

    target_language: str = "Hindi"
    source_language: str = "English"
    translation_quality: str = "high"
    batch_size: int = 3
    analysis_sample_size: int = 15
    eval_back_translate_sample: int = 20


@dataclass(frozen=True)
class CountedAnalyst:
    """Stands in for a model that writes briefs: fills the sections that can be counted.

    ``by`` are columns of the documents (their language) inside which case statistics are taken;
    ``limit`` is the number of entries of a section.
    """

    by: tuple[str, ...] = ()
    limit: int = 10


#: Sections of a brief, by number, that statistics fill: key terms, names and phrases.
COUNTED_SECTIONS = (3, 4, 5)


def brief_entries(documents: DataFrame, analyst: CountedAnalyst = CountedAnalyst()) -> DataFrame:
    """``(doc_id, section, rank, entry)``: key terms by TF-IDF, names and closed phrases by frequency."""
    paragraphs = segment_documents(documents.select("doc_id", *analyst.by, "text"))
    terms = statistics.key_terms(paragraphs, analyst.limit).select("doc_id", "rank", F.col("term").alias("text"), "n")

    def most(counted: DataFrame, text: str) -> DataFrame:
        order = counted.select("doc_id", F.col(text).alias("text"), "n").withColumns({"_few": -F.col("n"), "_short": -F.length("text")})
        return head(order, ["doc_id"], ["_few", "_short", "text"], analyst.limit, rank="rank").drop("_few", "_short")

    tables = {
        3: terms,
        4: most(statistics.document_names(paragraphs, list(analyst.by)), "name"),
        5: most(statistics.maximal_phrases(documents, most=analyst.limit), "phrase"),
    }
    entry = F.format_string("%s (%d)", F.col("text"), F.col("n"))
    rows = [t.select("doc_id", F.lit(k).alias("section"), F.col("rank").cast("int").alias("rank"), entry.alias("entry")) for k, t in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def counted_briefs(
    documents: DataFrame, options: Options = Options(), analyst: CountedAnalyst = CountedAnalyst()
) -> DataFrame:
    """``(doc_id, brief)`` without a model; documents with nothing to count have no brief.

    A group holds at most ``limit`` entries of each section.
    """
    line = F.struct("section", "rank", "entry")
    gathered = brief_entries(documents, analyst).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_e"))

    def section(k: int) -> Column:
        own = F.transform(F.filter("_e", lambda x: x["section"] == k), lambda x: x["entry"])
        title = f"{BRIEF_SECTIONS[k - 1].format(target=options.target_language)}:\n"
        return F.when(F.size(own) > 0, F.concat(F.lit(title), F.array_join(own, ", ")))

    parts = [section(k) for k in COUNTED_SECTIONS]
    return gathered.select("doc_id", F.concat_ws("\n\n", *parts).alias("brief"))


def make_briefs(documents: DataFrame, analyst, options: Options, folder: str | None = None) -> DataFrame:
    """``(doc_id, brief)``; a failed call gives a null brief and the run goes on."""
    if isinstance(analyst, CountedAnalyst):
        return saved(counted_briefs(documents, options, analyst), folder, "briefs")
    requests = brief_requests(
        documents,
        paragraph_array("text"),
        options.target_language,
        options.analysis_sample_size,
        options.source_language,
    )
    return saved(analyst.respond(requests, ["doc_id"]), folder, "briefs").select(
        "doc_id", F.col("raw").alias("brief")
    )


def translate_paragraphs(
    documents: DataFrame,
    translator,
    options: Options = Options(),
    reviewer=None,
    briefs: DataFrame | None = None,
    folder: str | None = None,
    kept: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, *carry, pos, index, source_text, text, is_fallback)`` of ``(doc_id, text)``.

    ``kept`` is an array of kept paragraphs for documents that are not plain text; ``carry`` are further
    columns of the documents that every paragraph keeps.

    From document row to aligned paragraph everything stays inside the row: nothing is
    shuffled unless the translator itself joins or spreads its requests.
    """
    docs = documents.select("doc_id", *carry, (F.col("text") if kept is None else kept).alias("text"))
    brief = None
    if briefs is not None:
        docs, brief = with_brief(docs, briefs), "brief"
    batches = batch_documents(docs, options.batch_size, kept=None if kept is None else F.col("text"))
    requests = translation_requests(
        batches, options.target_language, options.translation_quality, brief, options.source_language
    )
    keys = ["doc_id", "batch_id"]
    replies = saved(translator.respond(requests, keys), folder, "drafts")
    if reviewer is not None:
        second = review_requests(replies, options.target_language)
        replies = saved(reviewer.respond(second, keys), folder, "reviews")
    return unbatch(align_responses(replies), ["doc_id", *carry])


def translated_paragraphs(documents: DataFrame, translations: DataFrame) -> DataFrame:
    """Every original paragraph with its translation in place."""
    return merge_by_index(
        all_paragraphs(documents.select("doc_id", "text")), translations, ["doc_id", "index"]
    )


def translated_documents(documents: DataFrame, translations: DataFrame) -> DataFrame:
    """Documents from the translations of all their kept paragraphs, in one shuffle.

    Blank paragraphs were never sent; they are the only rows taken from the originals again.
    """
    new = F.when(strip("text") != "", strip("text")).otherwise(F.col("source_text"))
    done = translations.select("doc_id", "index", new.alias("text"))
    gaps = all_paragraphs(documents.select("doc_id", "text")).filter(F.col("text").isNull() | is_blank("text"))
    return reassemble(done.unionByName(gaps), ["doc_id"])


def translate_corpus(
    documents: DataFrame,
    translator,
    options: Options = Options(),
    reviewer=None,
    analyst=None,
    folder: str | None = None,
    resume: bool = False,
    rounds: int = 1,
) -> DataFrame:
    """Whole translated documents ``(doc_id, text)``.

    With ``resume`` every answer of a model is kept in ``folder`` when its round is written, and a run that is
    started again with the same ``folder`` asks only what has no answer yet.
    """
    if resume:
        if folder is None:
            raise ValueError("a run can only be resumed in a folder")
        keep = lambda t: t if t is None or isinstance(t, CountedAnalyst) else ResumingTranslator(t, folder, rounds)
        translator, reviewer, analyst = keep(translator), keep(reviewer), keep(analyst)
    briefs = None if analyst is None else make_briefs(documents, analyst, options, folder)
    translations = saved(
        translate_paragraphs(documents, translator, options, reviewer, briefs, folder),
        folder,
        "translations",
    )
    return translated_documents(documents, translations)
