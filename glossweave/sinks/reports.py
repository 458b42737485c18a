"""Evaluation and benchmark reports as text, made by column expressions where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BLEU_BANDS, CHRF_BANDS
from ..operators.positions import join_null_safe

_PROXY = "back_translation"


def _guide(name: str, bands: tuple) -> list[str]:
    (high, top), (low, middle), (_, bottom) = bands
    return [
        f"  {name} >= {high}: {top}",
        f"  {name} {low}-{high}: {middle}",
        f"  {name} < {low}: {bottom}",
    ]


def _show(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.2f", value))


def _mismatch(lengths: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _mismatch)``: what pairing by position dropped, for groups where it dropped anything."""
    said = F.format_string(
        "  Length mismatch: %d hypotheses and %d references; the last %d %s were dropped (%d to %d, %s)",
        "n_hyp", "n_ref", "n_dropped", "dropped_side", "first_dropped", "last_dropped", "dropped_share",
    )
    error = F.when(F.col("severity") == "error", ": scores are not reliable").otherwise("")
    return lengths.filter("severity <> 'none'").select(*by, F.concat(said, error, F.lit(".")).alias("_mismatch"))


def report_texts(corpus: DataFrame, spread: DataFrame, flagged: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """``(*by, report)``: the text of an evaluation for every group, made where the group is.

    Groups are the columns that corpus and spread share.  A group's flagged segments are at most k.
    ``lengths`` is the length report of the groups, if pairs were made by position.
    """
    by = [c for c in spread.columns if c in corpus.columns]
    names = [c for c in flagged.columns if c not in (*by, "rank", "number", "chrf", "preview")][:-1]
    keys = F.concat(F.lit(""), *[F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(", ")) for c in names])
    line = F.concat(F.lit("  ["), keys, "number", F.lit("] chrF "), _show("chrf"), F.lit("  "), F.coalesce("preview", F.lit("")))
    worst = flagged.select(*by, F.struct("rank", line.alias("line")).alias("_l")).groupBy(*by).agg(F.array_sort(F.collect_list("_l")).alias("_worst"))
    bounds = spread.select(*by, "chrf_min", "chrf_mean", "chrf_max")

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        # One group without keys is a group of one constant key.
        if not by:
            return left.withColumn("_all", F.lit(0)).join(right.withColumn("_all", F.lit(0)), "_all", "left").drop("_all")
        return join_null_safe(left, right, by, "left")

    rows = join(join(corpus, bounds), worst)
    if lengths is None:
        rows = rows.withColumn("_mismatch", F.lit(None).cast("string"))
    else:
        rows = join(rows, _mismatch(lengths, by))
    proxy = F.col("mode") == _PROXY
    scored = F.col("n_evaluated") > 0
    of = lambda label, value: F.concat(F.lit(label), value)
    lines = [
        F.lit("TRANSLATION EVALUATION REPORT"),
        *[of(f"  {c} : ", F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in by],
        of("  Mode       : ", F.col("mode")),
        of("  Paragraphs : ", F.col("n_evaluated").cast("string")),
        F.col("_mismatch"),
        F.concat(F.when(proxy, "  BLEU (proxy) : ").otherwise("  BLEU : "), _show("bleu"), F.lit("  "), F.coalesce("bleu_label", F.lit(""))),
        F.concat(F.lit("  chrF : "), _show("chrf"), F.lit("  "), F.coalesce("chrf_label", F.lit(""))),
        *map(F.lit, ["Score guide", *_guide("BLEU", BLEU_BANDS), *_guide("chrF", CHRF_BANDS)]),
        F.when(scored, "Segment chrF"),
        *[F.when(scored, of(f"  {n:<4} : ", _show(c))) for n, c in (("Min", "chrf_min"), ("Mean", "chrf_mean"), ("Max", "chrf_max"))],
        F.when(scored, "Segments to review (lowest chrF)"),
        F.when(scored & (F.size("_worst") > 0), F.array_join(F.transform("_worst", lambda x: x["line"]), "\n")),
        F.when(scored, of("  Detail : ", F.coalesce("detail", F.lit("")))),
        F.when(proxy, "Scores are back-translation proxies; give references for true scores."),
    ]
    # Lines that do not apply are null and left out.
    return rows.select(*by, F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("report"))


def evaluation_report(corpus: DataFrame, spread: DataFrame, flagged: DataFrame, lengths: DataFrame | None = None) -> str:
    """The texts of all groups as one, for a few groups; ``write_reports`` takes any number."""
    texts = report_texts(corpus, spread, flagged, lengths)
    by = texts.columns[:-1]
    return "\n".join(r["report"] for r in (texts.orderBy(*by) if by else texts).toLocalIterator())


def write_reports(texts: DataFrame, folder: str) -> None:
    """Reports of all groups in the order of their keys, as text files written by Spark."""
    by = texts.columns[:-1]
    ordered = texts.repartitionByRange(*by).sortWithinPartitions(*by) if by else texts
    ordered.select(F.col("report").alias("value")).write.mode("overwrite").text(folder)


def benchmark_report(comparison: DataFrame, title: str) -> str:
    """Head of a benchmark report: a row per system."""
    out = ["BENCHMARK REPORT", f"  Corpus : {title}"]
    for row in comparison.orderBy("system").collect():
        out.append(f"{row['system']}: BLEU {row['bleu']} {row['bleu_label']}; chrF {row['chrf']} {row['chrf_label']}")
        seconds = row.asDict().get("seconds")
        if seconds is not None:
            out.append(f"  Inference time : {seconds}s")
    return "\n".join(out) + "\n"


def write_sentences(detail: DataFrame, folder: str) -> None:
    """The sentences of a benchmark in order, as text files written by Spark."""
    line = lambda label, c: F.concat(F.lit(f"     {label:<10}: "), F.col(c))
    entry = F.concat_ws(
        "\n",
        F.concat(F.format_string("[%02d] Source    : ", F.col("seg_id") + 1), F.col("source")),
        line("Ours", "ours"),
        line("Other", "other"),
        line("Reference", "reference"),
    )
    (
        detail.repartitionByRange("seg_id")
        .sortWithinPartitions("seg_id")
        .select(entry.alias("value"))
        .write.mode("overwrite")
        .text(folder)
    )


def save_text(spark, text: str, folder: str) -> None:
    """Write a rendered report through Spark, so that any supported file system works."""
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(text.split("\n"))], "n int, value string")
    lines.coalesce(1).sortWithinPartitions("n").select(F.col("value")).write.mode("overwrite").text(folder)
