"""Removal of lines that many documents share.

Lines are exploded with their position, normalised and hashed to 128 bits; the documents of
a hash are counted as distinct ids (Spark counts them in two partial aggregations, so a line
that a third of all documents hold is spread by document first).  Hashes over the threshold
are a written table that is joined back to the lines; what a document loses comes back as
positions, and its other lines are put together in their order.

A line shorter than ``min_chars`` after normalising never counts and always stays.  A null or
empty text is one empty line.  Rows with a null id take no part: they neither count nor lose
lines.  Repeated rows of one id are one document.  Extra columns are kept, but for those with
the name of a result or of a working column (``_row``, ``_lost*``).  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, saved

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """A line without white space at both ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    kept: str = "kept_text",
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the kept text.

    A line found in ``min_docs`` documents stays only in the largest id that holds it.
    """
    docs = docs.drop("_row", "_lost_id", "_lost_row", "_lost", "_lost_lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = (
        docs.filter(F.col(id_column).isNotNull())
        # A second hash of the text keeps apart rows that share an id but not a text.
        .select(F.col(id_column).alias("_id"), F.xxhash64(whole).alias("_row"), F.posexplode(F.split(whole, "\n")))
        .select("_id", "_row", "pos", line_key(F.col("col")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("_id", "_row", "pos", *_hash(F.col("key")))
    )
    common = saved(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("_id").alias("n"), F.max("_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "common-lines",
    )
    lost = (
        lines.join(common, ["h1", "h2"])
        .filter(F.col("_id") != F.col("keeper"))
        .groupBy("_id", "_row")
        .agg(F.collect_set("pos").alias("_lost"))
    )
    joined = docs.withColumn("_row", F.xxhash64(whole)).join(
        lost.withColumnRenamed("_id", "_lost_id").withColumnRenamed("_row", "_lost_row"),
        (F.col(id_column) == F.col("_lost_id")) & (F.col("_row") == F.col("_lost_row")),
        "left",
    )
    # A column of its own, so that the text is split once and not for every kept line.
    cut = joined.withColumn("_lost_lines", F.split(whole, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lost_lines") - 1), F.col("_lost"))
    return cut.withColumns(
        {
            "n_lines": F.size("_lost_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long"),
            kept: F.when(F.col("_lost").isNull(), whole).otherwise(
                F.array_join(F.transform(stay, lambda i: F.get("_lost_lines", i)), "\n")
            ),
        }
    ).drop("_row", "_lost_id", "_lost_row", "_lost", "_lost_lines")
