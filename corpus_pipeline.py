"""The corpus pipeline: five stages over ``documents``, each a written table.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept.
All but the last return the columns of ``documents``; the last adds the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import decontaminate, line_dedup, quality_rules, sentencepiece_fst, simhash
from glossweave.llm.common import table
from glossweave.llm.queries import TEXTS_PER_BATCH
from glossweave.session import new_folder, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality(docs, COLUMNS).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold too; a document left blank goes."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return (
        kept.filter((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
        .withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
        .select(*COLUMNS)
    )


def _texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents; texts are long, so fewer of them make a batch for Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return docs.select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the smallest id of every near-duplicate group, one row where ids are unique.

    Kept by id, not by row: repeated rows of the smallest id all stay, so do rows whose id is
    smallest in another group, and all rows without an id.
    """
    docs = _texts(spark, docs)
    groups = simhash.near_duplicates(docs)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    # Rows without an id are in no group of their own and stay.
    return docs.join(first, docs.doc_id == first._first, "left").filter("_first is not null or doc_id is null").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    found = decontaminate.find_benchmark(_texts(spark, docs), table(spark, sf_dir, "benchmark"))
    return found.filter("found.hits = 0").select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, checked by decoding."""
    coded = sentencepiece_fst.decode(sentencepiece_fst.encode(_texts(spark, docs)))
    plain = F.translate(F.coalesce("text", F.lit("")), sentencepiece_fst.SPACE, " ")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == plain).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    What a stage writes for itself is deleted when its rows are written.  The rows of the stages stay until
    ``drop_intermediates``, since the result reads the last of them.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the bit-distance components nor the piece encoding.
ORACLE_SQL = None
