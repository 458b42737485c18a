"""Translating table cells and putting them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .alignment import align_responses, non_blank
from .batching import batch_rows
from .distinct import translate_distinct
from .positions import dense_position, spread_join
from .requests import translation_requests
from .segmentation import explode_rows, flatten_columns, table_shapes

TABLE = ["doc_id", "table_index"]
CELL = [*TABLE, "row_idx", "col_idx"]


def number_cells(cells: DataFrame) -> DataFrame:
    """Row-major position of each non-empty cell in its table."""
    return dense_position(non_blank(cells), TABLE, "row_idx", ties=("col_idx",))


def batch_cells(cells: DataFrame, batch_size: int) -> DataFrame:
    """Batches of non-empty cells; the batch count restarts in each table."""
    rows = number_cells(cells).withColumn("index", F.col("pos"))
    return batch_rows(rows, TABLE, batch_size, carry=("row_idx", "col_idx"))


def translate_cells(
    cells: DataFrame, translator, target: str, batch_size: int = 3, quality: str = "high"
) -> DataFrame:
    """Cells with translated text; empty cells and failed batches keep theirs."""
    batches = batch_cells(cells, batch_size)
    requests = translation_requests(batches, target, quality)
    replied = align_responses(translator.respond(requests, [*TABLE, "batch_id"]))
    # Aligned items keep the order of the batch, so coordinates come from the same place.
    moved = explode_rows(replied, [*TABLE, "items"], F.col("aligned"), "_n", "a").select(
        *TABLE,
        F.get("items", F.col("_n"))["row_idx"].alias("row_idx"),
        F.get("items", F.col("_n"))["col_idx"].alias("col_idx"),
        F.col("a.text").alias("text"),
    )
    # Every other cell is in some batch, with its own text if the call failed.
    blank = cells.filter(F.col("text").isNull() | is_blank("text"))
    return moved.unionByName(blank.select(*CELL, "text"))


def cells_inside_grid(cells: DataFrame) -> DataFrame:
    """Cells within rows x width of the first row; ragged surplus is dropped."""
    shapes = table_shapes(cells, TABLE).withColumn("_last", F.col("n_rows") - 1)
    return (
        spread_join(cells, shapes, TABLE, "row_idx", "_last", how="inner")
        .filter((F.col("row_idx") < F.col("n_rows")) & (F.col("col_idx") < F.col("n_cols")))
        .drop("_last")
    )


def widen(cells: DataFrame, ids: list[str], names: list[str], text: str = "text") -> DataFrame:
    """Cells back to a wide frame ``(*ids, row_idx, *names)``: the inverse of ``flatten_columns``.

    Cell ``i`` of a grid row becomes column ``names[i]``, null if the row lacks it; cells beyond the
    last name are left out.  A group is one grid row.
    """
    own = F.array_sort(F.collect_list(F.struct("col_idx", F.struct(F.col(text).alias("text")).alias("cell"))))
    rows = cells.filter(F.col("col_idx") < len(names)).groupBy(*ids, "row_idx").agg(own.alias("_cells"))
    value = lambda i: F.get(F.filter("_cells", lambda c: c["col_idx"] == i), F.lit(0))["cell"]["text"]
    return rows.select(*ids, "row_idx", *[value(i).alias(n) for i, n in enumerate(names)])


def translate_wide(
    wide: DataFrame,
    key: str,
    names: list[str],
    translator,
    target: str,
    batch_size: int = 3,
    quality: str = "high",
    folder: str | None = None,
) -> DataFrame:
    """``(key, *names)`` with the text columns ``names`` translated, each distinct text once.

    ``key`` is a unique number of the row, such as its number in the table.
    """
    cells = flatten_columns(wide, [], names, F.col(key))
    done = translate_distinct(cells, translator, target, batch_size, quality, folder=folder)
    return widen(done, [], names).withColumnRenamed("row_idx", key)
