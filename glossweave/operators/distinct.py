"""Translate every distinct text once and bring the answers back to all rows that hold it.

Corpora of table cells repeat few texts very often.  The texts are made distinct by a partial
aggregate, so a hot text is one row before the shuffle; only these are batched and sent.  On
the way back the translations are a shuffled table of unique texts, joined from the rows: Spark's skew
join splits the partition of a hot text and reads its one translation again in each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import saved
from .alignment import align_responses
from .batching import batch_rows, unbatch
from .requests import translation_requests

#: Blank texts are never sent; their rows are spread over this many join keys that match nothing.
SPREAD = 1024


def distinct_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``(text, n)``: each text that is not blank, and how many rows hold it."""
    return (
        rows.select(F.col(text).alias("text"))
        .filter(~is_blank("text"))
        .groupBy("text")
        .agg(F.count("*").alias("n"))
    )


def batch_distinct(texts: DataFrame, batch_size: int, buckets: int) -> DataFrame:
    """Batches ``(bucket, batch_id, items)`` of unique texts, in text order inside hash buckets.

    A text's batch depends on the texts and ``buckets`` only, so a repeated task builds the same requests.
    """
    placed = texts.select("text", F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int").alias("bucket"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("text")) - 1
    dense = placed.withColumn("pos", number).withColumn("index", F.col("pos"))
    return batch_rows(dense, ["bucket"], batch_size)


def translate_texts(
    texts: DataFrame,
    translator,
    target: str,
    batch_size: int = 3,
    quality: str = "high",
    buckets: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``(source_text, text, is_fallback)`` of unique texts; with a ``folder`` answers are written."""
    buckets = buckets or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = batch_distinct(texts, batch_size, buckets)
    requests = translation_requests(batches, target, quality)
    replies = saved(translator.respond(requests, ["bucket", "batch_id"]), folder, "distinct")
    return unbatch(align_responses(replies), []).select("source_text", "text", "is_fallback")


def join_translations(rows: DataFrame, translations: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the translation of their text; blank texts, and those without one, stay.

    ``translations`` has unique ``source_text``.
    """
    blank = F.col(text).isNull() | is_blank(text)
    others = [c for c in rows.columns if c != text]
    apart = F.when(blank, 1 + F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0)
    asked = rows.withColumns({"_key": F.coalesce(F.col(text), F.lit("")), "_apart": apart})
    new = translations.select(
        F.col("source_text").alias("_key"), F.lit(0).cast("bigint").alias("_apart"), F.col("text").alias("_new")
    )
    return (
        asked.join(new, ["_key", "_apart"], "left")
        .withColumn(text, F.coalesce("_new", text))
        .select(*rows.columns)
    )


def translate_distinct(
    rows: DataFrame,
    translator,
    target: str,
    batch_size: int = 3,
    quality: str = "high",
    text: str = "text",
    buckets: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``rows`` with ``text`` translated, each distinct text having reached the translator once."""
    new = translate_texts(distinct_texts(rows, text), translator, target, batch_size, quality, buckets, folder)
    return join_translations(rows, new, text)
