"""Putting documents back together and writing them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import BLOCK, block_of


def reassemble(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Document texts from ordered paragraphs, one row ``(*keys, text)`` per document.

    A group is one document, whose text was one value on the way in.
    """
    ordered = F.array_sort(F.collect_list(F.struct("index", F.coalesce("text", F.lit("")).alias("text"))))
    return (
        paragraphs.groupBy(*keys)
        .agg(ordered.alias("_rows"))
        .select(*keys, F.array_join(F.transform("_rows", lambda r: r["text"]), "\n").alias("text"))
    )


def rebuild_tables(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Cells to nested rows ``(*keys, part_no, rows array<struct<row_idx, row>>)``.

    Each row carries its number in the table, whatever part it is in.
    """
    cell_row = (
        cells.groupBy(*keys, "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("_cells"))
        .select(*keys, "row_idx", F.transform("_cells", lambda c: c["text"]).alias("row"))
    )
    return (
        cell_row.groupBy(*keys, block_of("row_idx", block).alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "row"))).alias("rows"))
    )


def write_ordered(paragraphs: DataFrame, folder: str, keys: list[str], fmt: str = "parquet") -> None:
    """Write paragraphs range-partitioned by document and index.

    Range partitioning splits a document that is larger than a partition.
    """
    (
        paragraphs.repartitionByRange(*keys, "index")
        .sortWithinPartitions(*keys, "index")
        .write.mode("overwrite")
        .format(fmt)
        .save(folder)
    )
