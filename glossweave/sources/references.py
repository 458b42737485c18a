"""Reference translations from plain text.

Files are read in splits, so one of any size is read by many tasks.  A line knows its file and
the byte at which its split starts; inside a split Spark hands lines out in order.  Numbering
them takes no shuffle of lines: one row per split says how many lines it holds, and running sums of
those, ordered by file and byte offset, are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, universal_lines
from ..operators.positions import dense_position
from ..operators.segmentation import explode_rows
from ..session import written


def reference_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Stripped non-empty lines of each text with dense positions; no shuffle.

    Lines end at every Unicode line boundary.
    """
    kept = F.filter(F.transform(universal_lines(text), strip), lambda x: x != "")
    return explode_rows(texts, keys, kept, "pos", "ref").filter(F.col("ref").isNotNull())


def read_references(spark: SparkSession, path: str, by: Column | None = None, name: str = "path") -> DataFrame:
    """Reference files, one row per line: ``(path, pos, ref)``.

    With ``by``, a column made from ``path``, all files of one value are numbered together in the order
    of their paths, and the value stands in the column ``name``.  A byte order mark is no text.
    """
    split = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value"
    )
    lines = reference_lines(split, ["path", "_start"], "value").drop("pos")
    # Consecutive inside a task, which reads its splits one after another.  Written once, since
    # another reading might be cut into other splits.
    kept = written(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    return number_lines(kept, F.col("path") if by is None else by, name)


def number_lines(lines: DataFrame, by: Column, name: str) -> DataFrame:
    """``(name, pos, ref)`` from lines ``(path, _start, _at, ref)`` of which ``_at`` counts inside a split."""
    splits = lines.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_by").orderBy("path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split; as a table it is small enough to be broadcast, or is joined by split.
    offsets = written(
        splits.withColumn("_by", by)
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
        .drop("_n", "_first"),
        "splits",
    )
    return lines.join(offsets, ["path", "_start"]).select(
        F.col("_by").alias(name), (F.col("_at") + F.col("_before")).alias("pos"), "ref"
    )


def corpus_references(rows: DataFrame, order: str, text: str = "text", block: int | None = None) -> DataFrame:
    """References whose texts are table rows: lines numbered over all rows in order.

    Rows are numbered first, in blocks; lines get the offset of the rows before theirs.
    """
    lines = reference_lines(rows.select(order, text), [order], text)
    lines = lines.withColumnRenamed("pos", "line_no")
    one = lines.withColumn("_all", F.lit(0))
    size = {} if block is None else {"block": block}
    return dense_position(one, ["_all"], order, "pos", ties=("line_no",), **size).select("pos", "ref")
