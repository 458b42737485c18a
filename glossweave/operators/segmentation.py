"""Documents, runs, grids and assets to ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, lines
from .positions import dense_position


def paragraph_array(text: Column | str) -> Column:
    """Kept paragraphs of one document text as ``array<struct<index, text>>``.

    ``index`` counts the dropped (blank) paragraphs too.
    """
    text = F.col(text) if isinstance(text, str) else text
    every = F.transform(lines(text), lambda t, i: F.struct(i.alias("index"), t.alias("text")))
    return F.filter(every, lambda p: ~is_blank(p["text"]))


def explode_rows(
    rows: DataFrame, keep: list[str], array: Column, position: str, element: str
) -> DataFrame:
    """``posexplode`` that computes ``array`` once per row.

    For a plain explode Spark adds the filter ``size(array) > 0`` below it, which repeats
    the whole expression.  Rows with an empty array come out once, with null values.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(position, element))


def segment_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per kept paragraph; no shuffle.

    ``index`` is the position in the document, ``pos`` the dense position among the kept
    paragraphs.  All other columns of ``docs`` are carried along.
    """
    others = [c for c in docs.columns if c != text]
    return (
        explode_rows(docs, others, paragraph_array(text), "pos", "p")
        .filter(F.col("p").isNotNull())
        .select(*others, F.col("p.index").alias("index"), "pos", F.col("p.text").alias("text"))
    )


def all_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph of the original, blank ones included."""
    others = [c for c in docs.columns if c != text]
    return explode_rows(docs, others, lines(text), "index", "text")


def roll_up_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraph flags from its runs; the last picture run with an id names the image.

    Only partial aggregates travel, so a paragraph with very many runs is no hot spot.
    """
    named = F.col("image_id").isNotNull()
    return runs.groupBy(*keys).agg(
        F.coalesce(F.bool_or("bold"), F.lit(False)).alias("is_bold"),
        F.coalesce(F.bool_or("italic"), F.lit(False)).alias("is_italic"),
        F.coalesce(F.bool_or("has_picture"), F.lit(False)).alias("has_image"),
        F.max_by("image_id", F.when(named, F.col("run_no"))).alias("image_id"),
    )


def keep_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with text or with a picture."""
    return paragraphs.filter(~is_blank("text") | F.col("has_image"))


def flatten_columns(
    wide: DataFrame, ids: list[str], values: list[str], row: Column
) -> DataFrame:
    """A wide frame as table cells: one grid row per input row, one cell per column."""
    number = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return (
        wide.select(*ids, row.cast("bigint").alias("row_idx"), *values)
        .unpivot([*ids, "row_idx"], values, "col_name", "text")
        .select(*ids, "row_idx", number[F.col("col_name")].cast("int").alias("col_idx"), "text")
    )


def flatten_grid(tables: DataFrame, grid: str, ids: list[str]) -> DataFrame:
    """``array<array<string>>`` grids as cells; ragged rows stay ragged."""
    rows = tables.select(*ids, F.posexplode(grid).alias("row_idx", "r"))
    return rows.select(*ids, "row_idx", F.posexplode("r").alias("col_idx", "text"))


def table_shapes(cells: DataFrame, ids: list[str]) -> DataFrame:
    """Row count and width of the first row.

    Grid rows are numbered from 0 without gaps, so the count is the highest number plus one.
    """
    return cells.groupBy(*ids).agg(
        (F.max("row_idx") + 1).cast("bigint").alias("n_rows"),
        F.count_if(F.col("row_idx") == 0).alias("n_cols"),
    )


def image_catalogue(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Image parts numbered from 0 in part order, with their file names."""
    images = parts.filter(F.contains("content_type", F.lit("image")))
    subtype = F.element_at(F.split("content_type", "/"), -1)
    return dense_position(images, keys, "part_no", "image_no").withColumn(
        "filename", F.concat(F.lit("image_"), F.col("image_no"), F.lit("."), subtype)
    )


def document_counts(
    documents: DataFrame,
    paragraphs: DataFrame,
    cells: DataFrame | None = None,
    images: DataFrame | None = None,
) -> DataFrame:
    """Kept paragraphs, tables and images per document; one pass of partial counts."""
    parts = [
        documents.select("doc_id", *[F.lit(0).cast("bigint").alias(n) for n in _COUNTS]),
        _count(paragraphs.groupBy("doc_id"), "n_paragraphs", F.count("*")),
    ]
    if cells is not None:
        parts.append(_count(cells.groupBy("doc_id"), "n_tables", F.count_distinct("table_index")))
    if images is not None:
        parts.append(_count(images.groupBy("doc_id"), "n_images", F.count("*")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in _COUNTS])


_COUNTS = ("n_paragraphs", "n_tables", "n_images")


def _count(grouped, name: str, measure: Column) -> DataFrame:
    counted = grouped.agg(measure.alias(name))
    return counted.select(
        "doc_id",
        *[F.col(n) if n == name else F.lit(0).cast("bigint").alias(n) for n in _COUNTS],
    )
