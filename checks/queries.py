"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import replies
from glossweave.functions.labels import bleu_label, chrf_label, quality_note
from glossweave.functions.text import is_blank, percent, preview, round2
from glossweave.operators import alignment, batching, metrics, positions, requests, runs, scoring
from glossweave.operators import distinct, segmentation, statistics, tables
from glossweave.operators.translators import (
    GlossaryTranslator,
    MemoryTranslator,
    ModelTranslator,
    ResumingTranslator,
    build_glossary,
    build_memory,
    glossary_column,
)
from glossweave.plans import benchmark as bench_plan
from glossweave.plans import evaluate as eval_plan
from glossweave.plans import translate as plan
from glossweave.sinks import documents as sink
from glossweave.session import new_folder
from glossweave.sources.references import corpus_references, read_references

WORDS = {
    "the": "le", "and": "et", "of": "de", "in": "dans", "le": "der", "la": "die", "les": "den",
    "de": "von", "et": "und", "der": "el", "die": "ella", "und": "y", "el": "the", "y": "and",
}
BACK = {"le": "the", "et": "and", "de": "of", "der": "le", "die": "la", "von": "de", "und": "et"}
PART_WORDS = {"small": "klein", "red": "rot", "blue": "blau", "ECONOMY": "SPAR", "bolt": "Bolzen"}

SYSTEMS = ("same", "lowercase", "unpunctuated", "glossary")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def paragraphs(spark, sf) -> DataFrame:
    return segmentation.segment_documents(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def document_pairs(spark, sf) -> DataFrame:
    return paragraphs(spark, sf).select(
        "doc_id", "lang", "index",
        glossary_column(F.col("text"), WORDS).alias("hyp"), F.col("text").alias("ref"),
    )


def translations(spark, sf) -> DataFrame:
    return plan.translate_paragraphs(documents(spark, sf), GlossaryTranslator(WORDS))


def raw_replies(spark, sf) -> DataFrame:
    """Replies with lead-ins, metadata, headings, lost heads and surplus items, by language."""
    def numbered(start, between, end=""):
        return F.concat(F.lit(start), F.replace("text", F.lit("\n"), F.lit(between)), F.lit(end))

    raw = (
        F.when(F.col("lang") == "fr", numbered("Translation: 1. ", "\nUsed_Tools=0\n१. "))
        .when(F.col("lang") == "de", numbered("intro\n1. ", "\n# note\ncontinued\n"))
        .when(
            F.col("lang") == "es",
            numbered("OUTPUT:\n1.\nlost\n2. ", "\n[Translation of item 3]\n3. ", "\n4. extra"),
        )
        .otherwise(numbered("1. ", "\n2. "))
    )
    return table(spark, sf, "documents").select("doc_id", "text", raw.alias("raw"))


def whole_batches(spark, sf) -> DataFrame:
    """One batch per document, with its reply."""
    kept = F.transform(
        segmentation.paragraph_array("text"),
        lambda p, i: F.struct(i.alias("pos"), p["index"].alias("index"), p["text"].alias("text")),
    )
    return raw_replies(spark, sf).withColumn("items", kept)


def run_rows(spark, sf) -> DataFrame:
    """Conversations as paragraphs, turns as runs; system turns stand for pictures."""
    picture = F.col("role") == "system"
    return table(spark, sf, "conversations").select(
        "conv_id",
        F.col("turn").cast("int").alias("run_no"),
        (F.col("role") == "assistant").alias("bold"),
        F.contains("text", F.lit("\n")).alias("italic"),
        picture.alias("has_picture"),
        F.when(picture, F.concat(F.lit("image"), "turn")).alias("image_id"),
        "text",
    )


def cells(spark, sf) -> DataFrame:
    part = segmentation.flatten_columns(
        table(spark, sf, "part"), [], ["p_name", "p_brand", "p_type"], F.col("p_partkey")
    )
    nation = segmentation.flatten_columns(table(spark, sf, "nation"), [], ["n_name"], F.col("n_nationkey"))
    number = lambda df, n: df.select(
        F.lit(0).cast("bigint").alias("doc_id"), F.lit(n).alias("table_index"), "row_idx", "col_idx", "text"
    )
    return number(part, 0).unionByName(number(nation, 1))


def hypotheses(spark, sf) -> DataFrame:
    """Four systems over the benchmark texts: deterministic edits of the references."""
    text = F.col("text")
    edits = (
        text,
        F.lower(text),
        F.regexp_replace(text, "[.,]", ""),
        glossary_column(text, WORDS),
    )
    systems = F.array(*[F.struct(F.lit(n).alias("system"), e.alias("hyp")) for n, e in zip(SYSTEMS, edits)])
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("seg_id"), F.explode(systems).alias("s")
    ).select("s.system", "seg_id", "s.hyp")


def bitext(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("seg_id"), F.lower("text").alias("source"), F.col("text").alias("reference")
    )


def system_scores(spark, sf) -> DataFrame:
    return bench_plan.score_systems(hypotheses(spark, sf), bitext(spark, sf))


def role_hypotheses(spark, sf) -> DataFrame:
    """Turns as hypotheses, one system per role, numbered over all conversations."""
    turns = table(spark, sf, "conversations").select(
        F.col("role").alias("system"), "conv_id", "turn", F.col("text").alias("hyp")
    )
    return positions.dense_position(turns, ["system"], "conv_id", ties=("turn",)).select("system", "pos", "hyp")


def briefs(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").groupBy("doc_id").agg(
        F.concat(F.lit(" quality "), F.max("quality"), F.lit(" ")).alias("brief")
    )


# --- sources and segmentation -------------------------------------------------------------


def s1_paragraphs(spark, sf):
    return paragraphs(spark, sf).drop("lang")


def s2_run_flags(spark, sf):
    return segmentation.roll_up_runs(run_rows(spark, sf), ["conv_id"])


def s3_table_cells(spark, sf):
    return cells(spark, sf)


def s3_table_shapes(spark, sf):
    return segmentation.table_shapes(cells(spark, sf), tables.TABLE)


def s4_image_catalogue(spark, sf):
    kind = (
        F.when(F.col("lang") == "fr", "image/png")
        .when(F.col("lang") == "de", "image/jpeg")
        .when(F.col("lang") == "es", "image/gif")
        .otherwise("text/xml")
    )
    parts = table(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("part_no"), kind.alias("content_type")
    )
    return segmentation.image_catalogue(parts, ["source"])


def s5_references(spark, sf):
    return corpus_references(table(spark, sf, "benchmark"), "item_id")


def s5_reference_files(spark, sf):
    """Text files, a folder for each language; lines are numbered over all files of a folder."""
    folder = new_folder(spark, "references")
    lines = paragraphs(spark, sf).repartitionByRange("lang", "doc_id", "index")
    ordered = lines.sortWithinPartitions("lang", "doc_id", "index")
    ordered.select("lang", F.concat(F.lit(" "), "text").alias("value")).write.partitionBy("lang").text(folder)
    return read_references(spark, folder, F.regexp_extract("path", "lang=([^/]+)/", 1), "lang")


def s6_document_counts(spark, sf):
    labels = table(spark, sf, "labels")
    return segmentation.document_counts(
        documents(spark, sf),
        paragraphs(spark, sf),
        labels.select("doc_id", F.col("quality").alias("table_index")),
        labels.filter(F.col("toxic") == 1),
    )


# --- projections --------------------------------------------------------------------------


def p1_non_blank(spark, sf):
    rows = segmentation.all_paragraphs(documents(spark, sf))
    return alignment.non_blank(rows).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("index").alias("index_sum")
    )


def p2_lead_in(spark, sf):
    return raw_replies(spark, sf).select("doc_id", replies.drop_lead_in(F.col("raw")).alias("cleaned"))


def p3_reply_lines(spark, sf):
    return raw_replies(spark, sf).select("doc_id", replies.clean_reply(F.col("raw")).alias("cleaned"))


def p4_quality_note(spark, sf):
    tier = (
        F.when(F.col("lang") == "en", "high")
        .when(F.col("lang") == "fr", "medium")
        .when(F.col("lang") == "de", "low")
        .otherwise("other")
    )
    return table(spark, sf, "documents").select("doc_id", quality_note(tier).alias("note"))


def p5_bands(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        "p_partkey", bleu_label(size).alias("bleu_label"), chrf_label(size * 2 - 10).alias("chrf_label")
    )


def p6_preview(spark, sf):
    return documents(spark, sf).select(
        "doc_id", preview("text", 100, "...").alias("log_line"), preview("text", 70, "…").alias("report_line")
    )


def p7_rounding(spark, sf):
    several = F.contains("text", F.lit("\n"))
    return table(spark, sf, "documents").groupBy("lang").agg(
        percent(F.count_if(several), F.count("*")).alias("share"),
        round2(F.avg("n_chars")).alias("mean_chars"),
    )


# --- order and limits ---------------------------------------------------------------------


def o1_head_sample(spark, sf):
    return paragraphs(spark, sf).filter(F.col("pos") < 15).select("doc_id", "index", "text")


def o2_translation_sample(spark, sf):
    return eval_plan.translation_sample(translations(spark, sf), 20).select("doc_id", "index", "text")


def o3_batches(spark, sf):
    return batching.batch_documents(documents(spark, sf), 3).select(
        "doc_id", "batch_id", F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("texts"),
    )


def o3_batches_of_rows(spark, sf):
    rows = segmentation.all_paragraphs(documents(spark, sf)).filter(~is_blank("text"))
    placed = positions.dense_position(rows, ["doc_id"], "index")
    return batching.batch_rows(placed, ["doc_id"], 3).select(
        "doc_id", "batch_id", F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("texts"),
    )


def o4_numbering(spark, sf):
    return batching.batch_documents(documents(spark, sf), 5).select(
        "doc_id", "batch_id", requests.numbered_text(F.col("items")).alias("numbered")
    )


def o5_ordered_gather(spark, sf):
    return translations(spark, sf).select("doc_id", "pos", "index", "text")


def o6_worst_segments(spark, sf):
    return scoring.worst_segments(system_scores(spark, sf), ["system"], ["seg_id"]).select(
        "system", F.col("rank"), "seg_id", "chrf"
    )


def o7_dominant_run(spark, sf):
    return runs.dominant_runs(run_rows(spark, sf), ["conv_id"])


# --- joins --------------------------------------------------------------------------------


def j1_zip(spark, sf):
    return alignment.zip_segments(role_hypotheses(spark, sf), s5_references(spark, sf))


def j2_align(spark, sf):
    aligned = alignment.align_responses(whole_batches(spark, sf))
    return batching.unbatch(aligned, ["doc_id"]).select("doc_id", "pos", "index", "text", "is_fallback")


def j3_cell_lookup(spark, sf):
    grid = cells(spark, sf)
    some = grid.filter(F.contains("text", F.lit("e"))).withColumn("text", F.upper("text"))
    return alignment.lookup_cells(grid, some, tables.CELL)


def j4_index_merge(spark, sf):
    some = translations(spark, sf).filter(F.contains("text", F.lit(",")))
    return plan.translated_paragraphs(documents(spark, sf), some)


def j5_sentence_detail(spark, sf):
    hyps = hypotheses(spark, sf)
    other = hyps.filter((F.col("system") == "unpunctuated") & F.contains("hyp", F.lit("\n")))
    return alignment.sentence_detail(bitext(spark, sf), hyps.filter(F.col("system") == "glossary"), other)


def j6_brief_context(spark, sf):
    docs = alignment.with_brief(documents(spark, sf), briefs(spark, sf))
    return batching.batch_documents(docs, 3).select("doc_id", "batch_id", "brief")


def j7_length_report(spark, sf):
    return alignment.length_report(role_hypotheses(spark, sf), s5_references(spark, sf))


# --- model stages -------------------------------------------------------------------------


def m1_brief_request(spark, sf):
    return requests.brief_requests(
        documents(spark, sf), segmentation.paragraph_array("text"), "Hindi", 15
    ).select("doc_id", "prompt")


def m1_counted_brief(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return plan.counted_briefs(docs, plan.Options(), plan.CountedAnalyst(("lang",)))


def m2_translation_request(spark, sf):
    docs = alignment.with_brief(documents(spark, sf), briefs(spark, sf))
    asked = requests.translation_requests(batching.batch_documents(docs, 3), "Hindi", "medium", "brief")
    return asked.select("doc_id", "batch_id", "prompt")


def m3_review_request(spark, sf):
    asked = requests.translation_requests(batching.batch_documents(documents(spark, sf), 3), "Hindi")
    drafts = GlossaryTranslator(WORDS).respond(asked, ["doc_id", "batch_id"])
    return requests.review_requests(drafts, "Hindi").select("doc_id", "batch_id", "prompt")


def m4_back_request(spark, sf):
    sample = eval_plan.translation_sample(translations(spark, sf), 20)
    one = batching.batch_rows(sample.select("doc_id", "pos", "index", "text"), ["doc_id"], 20)
    return requests.back_translation_requests(one, "Hindi").select("doc_id", "prompt")


def echo_model():
    """Stands in for a model: returns the numbered part of a prompt with another letter.

    A nested function travels to the workers by value.
    """

    def reply(prompts: list[str]) -> list[str]:
        bodies = [p.split("\n\nRules:")[0].split("\n\n", 1)[1] for p in prompts]
        return ["Answer: " + b.replace("e", "E") for b in bodies]

    return reply


def m5_model_run(spark, sf):
    done = plan.translate_paragraphs(documents(spark, sf), ModelTranslator(echo_model()))
    return done.select("doc_id", "index", "text", "is_fallback")


def m6_parallel_run(spark, sf):
    done = plan.translate_paragraphs(documents(spark, sf), ModelTranslator(echo_model(), workers=5))
    return done.select("doc_id", "index", "text", "is_fallback")


def m6_calls_in_flight(spark, sf):
    done = plan.translate_paragraphs(documents(spark, sf), ModelTranslator(echo_model(), calls_per_batch=8, in_flight=8))
    return done.select("doc_id", "index", "text", "is_fallback")


def failing_model(word: str):
    """A model that is down for every prompt with ``word``."""
    reply = echo_model()

    def fail(prompts: list[str]) -> list[str]:
        if any(word in p for p in prompts):
            raise RuntimeError("down")
        return reply(prompts)

    return fail


def m5_resumed_run(spark, sf):
    """A run with a failing model, then one that asks again what failed."""
    folder = new_folder(spark, "resumed")
    first = ResumingTranslator(ModelTranslator(failing_model(" la ")), folder)
    plan.translate_paragraphs(documents(spark, sf), first).write.format("noop").mode("overwrite").save()
    again = ResumingTranslator(ModelTranslator(echo_model()), folder, rounds=2)
    done = plan.translate_paragraphs(documents(spark, sf), again)
    return done.select("doc_id", "index", "text", "is_fallback")


def m5_memory_run(spark, sf):
    known = table(spark, sf, "conversations").select(F.explode(F.split("text", "\n")).alias("source"))
    texts = paragraphs(spark, sf).filter(F.col("lang") != "en").select(F.col("text").alias("source"))
    memory = build_memory(
        known.unionByName(texts).filter(~is_blank("source")).withColumn("target", F.concat(F.lit("* "), "source"))
    )
    done = plan.translate_paragraphs(documents(spark, sf), MemoryTranslator(memory))
    return done.select("doc_id", "index", "text")


def m5_glossary_table_run(spark, sf):
    pairs = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("source"))
    glossary = build_glossary(pairs.filter(F.length("source") > 2).withColumn("target", F.reverse("source")))
    done = plan.translate_paragraphs(documents(spark, sf), GlossaryTranslator(glossary))
    return done.select("doc_id", "index", "text")


def m7_parse_items(spark, sf):
    parsed = replies.parse_items(F.col("raw"))
    rows = segmentation.explode_rows(raw_replies(spark, sf), ["doc_id"], parsed, "item_no", "text")
    return rows.filter(F.col("text").isNotNull())


def m8_table_translation(spark, sf):
    return tables.translate_cells(cells(spark, sf), GlossaryTranslator(PART_WORDS), "German")


def m8_distinct_translation(spark, sf):
    """Every line of the documents, each distinct one sent once."""
    return distinct.translate_distinct(
        segmentation.all_paragraphs(documents(spark, sf)), GlossaryTranslator(WORDS), "French"
    )


def m8_wide_table(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return tables.translate_wide(part, "p_partkey", ["p_name", "p_brand", "p_type"], GlossaryTranslator(PART_WORDS), "German")


def m9_key_terms(spark, sf):
    return statistics.key_terms(paragraphs(spark, sf))


def m9_names(spark, sf):
    return statistics.name_candidates(paragraphs(spark, sf))


def m9_phrases(spark, sf):
    return statistics.recurring_phrases(paragraphs(spark, sf))


def m9_maximal_phrases(spark, sf):
    return statistics.maximal_phrases(documents(spark, sf))


def m9_corpus_names(spark, sf):
    return statistics.corpus_names(paragraphs(spark, sf), ["lang"])


def m9_name_pairs(spark, sf):
    return statistics.name_pairs(paragraphs(spark, sf), ["lang"])


def m9_document_names(spark, sf):
    return statistics.document_names(paragraphs(spark, sf), ["lang"])


def m10_review_counts(spark, sf):
    return statistics.review_counts(translations(spark, sf), "Latin")


def m10_inconsistent_sources(spark, sf):
    both = bitext(spark, sf).join(hypotheses(spark, sf), "seg_id")
    return statistics.inconsistent_sources(both.select(F.col("source").alias("source_text"), F.col("hyp").alias("text")))


def renderings(spark, sf):
    """Every paragraph of the documents, by two systems; the languages stand for translators."""
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lower("text")).otherwise(glossary_column(F.col("text"), WORDS))
    return paragraphs(spark, sf).select("doc_id", "index", F.lower("text").alias("source_text"), text.alias("text"))


def m10_majority_renderings(spark, sf):
    return statistics.majority_renderings(renderings(spark, sf)).select("source", "target", "n", "n_all")


def m10_deviating_segments(spark, sf):
    return statistics.deviating_segments(renderings(spark, sf), ["doc_id", "index"])


# --- metrics ------------------------------------------------------------------------------

SEGMENT = ["doc_id", "lang", "index"]


def a1_bleu_stats(spark, sf):
    return metrics.bleu_stats(document_pairs(spark, sf), SEGMENT)


def a2_segment_bleu(spark, sf):
    scored = metrics.with_bleu(metrics.bleu_stats(document_pairs(spark, sf), SEGMENT))
    return scored.select("doc_id", "index", round2(F.col("bleu")).alias("bleu"))


def a3_corpus_bleu(spark, sf):
    totals = metrics.total_stats(metrics.bleu_stats(document_pairs(spark, sf), SEGMENT), ["lang"])
    return metrics.with_bleu(totals).select("lang", "n_evaluated", round2(F.col("bleu")).alias("bleu"))


def a4_chrf_stats(spark, sf):
    return metrics.chrf_stats(document_pairs(spark, sf), SEGMENT)


def a5_segment_chrf(spark, sf):
    scored = metrics.with_chrf(metrics.chrf_stats(document_pairs(spark, sf), SEGMENT))
    return scored.select("doc_id", "index", round2(F.col("chrf")).alias("chrf"))


def a6_corpus_chrf(spark, sf):
    totals = metrics.total_stats(metrics.chrf_stats(document_pairs(spark, sf), SEGMENT), ["lang"])
    return metrics.with_chrf(totals).select("lang", "n_evaluated", round2(F.col("chrf")).alias("chrf"))


def a7_score_spread(spark, sf):
    return metrics.score_spread(system_scores(spark, sf), ["system"])


def a8_corpus_row(spark, sf):
    return metrics.corpus_scores(system_scores(spark, sf), ["system"])


def a9_run_summary(spark, sf):
    return scoring.run_summary(
        documents(spark, sf), s6_document_counts(spark, sf), translations(spark, sf), "Hindi", briefs(spark, sf)
    )


def a10_compare_systems(spark, sf):
    return bench_plan.run_benchmark(hypotheses(spark, sf), bitext(spark, sf)).select(
        "system", "n_evaluated", "bleu", "chrf", "bleu_label", "chrf_label"
    )


def a11_proxy_evaluation(spark, sf):
    pairs = eval_plan.proxy_pairs(translations(spark, sf), GlossaryTranslator(BACK))
    scored = metrics.segment_scores(pairs, ["doc_id", "index"])
    return metrics.corpus_scores(scored, [], "back_translation").select("mode", "n_evaluated", "bleu", "chrf")


def a12_mode_choice(spark, sf):
    refs = paragraphs(spark, sf).select("doc_id", "index", F.lower("text").alias("ref"))
    pairs, mode = eval_plan.choose_pairs(translations(spark, sf), refs, None)
    scored = metrics.segment_scores(pairs, ["doc_id", "index"])
    return metrics.corpus_scores(scored, [], mode).select("mode", "n_evaluated", "bleu", "chrf")


def a12_mode_fallback(spark, sf):
    """No reference file: back-translation of the sample."""
    found = eval_plan.file_pairs(translations(spark, sf), f"{sf}/no-references", GlossaryTranslator(BACK))
    scored = metrics.segment_scores(found.pairs, ["doc_id", "pos"])
    return metrics.corpus_scores(scored, [], found.mode).select("mode", "n_evaluated", "bleu", "chrf")


# --- sinks --------------------------------------------------------------------------------


def k1_translated_documents(spark, sf):
    return plan.translate_corpus(documents(spark, sf), GlossaryTranslator(WORDS))


def k2_written_runs(spark, sf):
    rows = run_rows(spark, sf)
    new = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id",
        F.when(F.col("n") > 8, F.lit(" ")).otherwise(F.concat(F.lit(" conversation "), "conv_id")).alias("text"),
    )
    return runs.write_runs(rows, new, ["conv_id"]).select("conv_id", "run_no", "has_picture", "text")


def k3_plain_rebuild(spark, sf):
    flags = s2_run_flags(spark, sf).select("conv_id", "is_bold", "is_italic", "has_image")
    text = runs.paragraph_texts(run_rows(spark, sf), ["conv_id"])
    return runs.plain_rebuild(flags.join(text, "conv_id"), ["conv_id"])


def k3_grid_cells(spark, sf):
    ragged = cells(spark, sf).filter((F.col("row_idx") > 0) | (F.col("col_idx") < 2))
    return tables.cells_inside_grid(ragged).select(*tables.CELL, "text", "n_rows", "n_cols")


def k3_rebuilt_rows(spark, sf):
    rows = sink.rebuild_tables(cells(spark, sf), tables.TABLE)
    return rows.select("table_index", F.explode("rows").alias("r")).select(
        "table_index", "r.row_idx", F.array_join("r.row", "|").alias("row")
    )


def k4_flagged_report(spark, sf):
    scored, texts = system_scores(spark, sf), hypotheses(spark, sf)
    return scoring.flagged_report(scored, texts, ["system"], ["seg_id"]).select(
        "system", F.col("rank"), "number", "chrf", "preview"
    )


def k5_benchmark_tables(spark, sf):
    detail = j5_sentence_detail(spark, sf)
    scores = system_scores(spark, sf).filter(F.col("system") == "glossary")
    return detail.join(scores.select("seg_id", "bleu", "chrf"), "seg_id")


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if callable(fn) and len(name) > 3 and name[0] in "spojmak" and name[1].isdigit()
}


def flagship(spark, sf):
    """Segment, translate by glossary, translate back, and score every paragraph per language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    done = plan.translate_paragraphs(docs, GlossaryTranslator(WORDS), carry=("lang",))
    pairs = done.select(
        "doc_id", "index", "lang", glossary_column(F.col("text"), BACK).alias("hyp"), F.col("source_text").alias("ref")
    )
    stats = metrics.chrf_stats(pairs, ["doc_id", "index", "lang"])
    return metrics.with_chrf(metrics.total_stats(stats, ["lang"])).select(
        "lang", "n_evaluated", round2(F.col("chrf")).alias("chrf")
    )
