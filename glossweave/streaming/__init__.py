"""The translation plan on documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.translate import Options, translate_paragraphs

DOCUMENTS = "doc_id long, text string"


def read_documents(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Document files as they appear in ``folder``."""
    return (
        spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def write_translations(
    documents: DataFrame, translator, folder: str, checkpoint: str, options: Options = Options()
) -> StreamingQuery:
    """Append aligned paragraphs; the plan is stateless, so no watermark is needed.

    Works with translators that stay inside the row (``ModelTranslator`` and dict glossaries).
    """
    return (
        translate_paragraphs(documents, translator, options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
