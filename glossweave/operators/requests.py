"""Prompt columns of the four model steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import quality_note
from ..functions.text import is_blank
from .batching import has_text, numbered

BRIEF_SECTIONS = (
    "Kind of document and subject area",
    "Register and tone",
    "Key terms with recommended {target} equivalents",
    "Proper nouns: transliterate, or use the established {target} form",
    "Recurring phrases and idioms to render the same way throughout",
    "Cultural background the translator should know",
)


def _sections(*parts: Column | str) -> Column:
    """Non-null parts separated by blank lines."""
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def numbered_text(items: Column) -> Column:
    return F.array_join(numbered(items), "\n\n")


def brief_requests(
    docs: DataFrame, kept: Column, target: str, sample_size: int = 15, source: str = "English"
) -> DataFrame:
    """One brief request per document from its first ``sample_size`` non-empty paragraphs.

    ``kept`` is the document's array of kept paragraphs.  Documents without text get none.
    """
    sample = F.slice(F.filter(kept, lambda p: ~is_blank(p["text"])), 1, sample_size)
    listing = "\n".join(f"{i}. {s}" for i, s in enumerate(BRIEF_SECTIONS, 1)).format(target=target)
    prompt = _sections(
        f"Read this excerpt of a document that is to be translated from {source} into {target} "
        "and write a TRANSLATION BRIEF with labelled sections.",
        F.concat(F.lit("EXCERPT:\n"), numbered_text(F.col("sample"))),
        f"Sections:\n{listing}",
    )
    return (
        docs.withColumn("sample", sample)
        .filter(F.size("sample") > 0)
        .select("doc_id", F.lit("brief").alias("step"), prompt.alias("prompt"))
    )


def translation_requests(
    batches: DataFrame,
    target: str,
    quality: str = "high",
    brief: str | None = None,
    source: str = "English",
) -> DataFrame:
    """Add the translation prompt; batches without any text have a null one, which no
    translator sends, and so come back unchanged.

    ``brief`` names a column; a null or blank brief leaves its section out.
    """
    context = F.lit(None).cast("string")
    if brief is not None:
        context = F.when(
            ~is_blank(brief), F.concat(F.lit("TRANSLATION BRIEF (keep to it):\n"), F.col(brief))
        )
    rules = F.concat(
        F.lit(
            "Rules:\n"
            "- Translate each numbered paragraph on its own.\n"
            "- Put each translation on its own line under the same number.\n"
            f"- Write {target} only, without remarks.\n"
            "- Quality: "
        ),
        quality_note(F.lit(quality)),
    )
    prompt = _sections(
        f"Translate this {source} text into {target}.", numbered_text(F.col("items")), context, rules
    )
    return batches.withColumns(
        {"step": F.lit("translate"), "prompt": F.when(has_text(F.col("items")), prompt)}
    )


def review_requests(responses: DataFrame, target: str) -> DataFrame:
    """Review prompts over the draft replies of the translation step.

    The draft moves to ``draft``, ``draft_error`` and ``draft_seconds``; a failed draft gets no prompt.
    """
    prompt = _sections(
        f"Review this {target} translation.",
        F.coalesce("draft", F.lit("")),
        "Rules:\n"
        "- The meaning of every sentence must be kept.\n"
        f"- The {target} must read naturally, without grammar mistakes.\n"
        "- Terms must suit the culture and stay consistent.\n"
        "- Keep the numbering exactly as it is.\n"
        "- Return an accurate and fluent translation unchanged.\n"
        f"- Write the final {target} text only.",
    )
    earlier = {"raw": "draft", "error": "draft_error", "seconds": "draft_seconds"}
    return responses.withColumnsRenamed(earlier).withColumns(
        {"step": F.lit("review"), "prompt": F.when(F.col("draft_error").isNull(), prompt)}
    )


def back_translation_requests(batches: DataFrame, spoken: str, original: str = "English") -> DataFrame:
    """Prompts that translate ``spoken`` text back into the ``original`` language."""
    prompt = _sections(
        f"Translate this {spoken} text into {original}.",
        numbered_text(F.col("items")),
        "Rules:\n"
        "- Translate each numbered item on its own.\n"
        "- Keep the numbering.\n"
        f"- Write {original} only, without remarks.",
    )
    return batches.filter(has_text(F.col("items"))).withColumns(
        {"step": F.lit("back"), "prompt": prompt}
    )
