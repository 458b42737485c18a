"""Ordered batches and their numbered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .segmentation import explode_rows, paragraph_array


def batch_documents(
    docs: DataFrame, batch_size: int, text: str = "text", kept: Column | None = None
) -> DataFrame:
    """Batches straight from document rows; no shuffle.

    ``kept`` replaces the paragraphs of ``text`` by an array of kept paragraphs, whose
    column is then named ``text``.  Other columns (a brief, for instance) are carried to every batch of the document.
    """
    others = [c for c in docs.columns if c != text]
    items = F.transform(
        F.col("_kept"),
        lambda p, pos: F.struct(pos.alias("pos"), p["index"].alias("index"), p["text"].alias("text")),
    )
    # A row of the explode holds its own batch only, not all paragraphs of the document.
    starts = F.sequence(F.lit(1), F.greatest(F.size("_items"), F.lit(1)), F.lit(batch_size))
    batches = F.transform(starts, lambda start: F.slice("_items", start, batch_size))
    rows = docs.select(*others, (paragraph_array(text) if kept is None else kept).alias("_kept")).select(
        *others, items.alias("_items")
    )
    return explode_rows(rows, others, batches, "batch_id", "items").filter(F.size("items") > 0)


def batch_rows(rows: DataFrame, keys: list[str], batch_size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Batches from rows that already have a dense ``pos`` (and ``index``, ``text``).

    A group is one batch, so it holds at most ``batch_size`` rows.
    """
    item = F.struct("pos", "index", "text", *carry)
    return (
        rows.withColumn("batch_id", F.floor(F.col("pos") / batch_size))
        .groupBy(*keys, "batch_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )


def numbered(items: Column) -> Column:
    """``n. text`` of the non-blank items; blank items use up their number."""
    labelled = F.transform(
        items, lambda item, i: F.struct((i + 1).alias("n"), item["text"].alias("text"))
    )
    return F.transform(
        F.filter(labelled, lambda x: ~is_blank(x["text"])),
        lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["text"]),
    )


def has_text(items: Column) -> Column:
    return F.exists(items, lambda item: ~is_blank(item["text"]))


def unbatch(aligned: DataFrame, keys: list[str], items: str = "aligned") -> DataFrame:
    """Aligned batches back to one row per paragraph.

    Order is carried by ``index``; nothing has to be gathered in order before the sink.
    """
    return explode_rows(aligned, keys, F.col(items), "_n", "_i").select(*keys, "_i.*")
