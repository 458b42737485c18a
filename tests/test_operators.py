import re

import pytest
from pyspark.sql import functions as F

from glossweave.functions import replies
from glossweave.functions.labels import bleu_label, chrf_label, quality_note
from glossweave.functions.text import is_blank, preview, strip
from glossweave.operators import alignment, batching, positions, requests, runs, scoring
from glossweave.operators import distinct, segmentation, tables, translators
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
from glossweave.plans import evaluate as ev
from glossweave.plans import translate as plan
from glossweave.sinks import documents as sink
from glossweave.sinks import reports
from glossweave.sources.references import corpus_references, read_references

ITEMS = "array<struct<pos:int,index:int,text:string>>"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_strip_is_unicode_strip(spark):
    texts = ["\t a\n", "\xa0　b ", "", " \x85 ", "c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(strip("t"), is_blank("t")).collect()]
    assert got == [(t.strip(), not t.strip()) for t in texts]


def test_segmentation_keeps_original_indexes(spark):
    docs = spark.createDataFrame([(1, "a\n \t\n\nb"), (2, ""), (3, None)], "doc_id long, text string")
    got = rows(segmentation.segment_documents(docs), "doc_id", "pos")
    assert got == [(1, 0, 0, "a"), (1, 3, 1, "b")]
    assert segmentation.all_paragraphs(docs).count() == 6


PARSER = [
    ("TRANSLATION: 1. un\nsuite\n\n2. deux", ["one", "two"], ["un suite", "deux"], ["un suite", "deux"]),
    ("intro\n१. un\n# note\n2. deux", ["one", "two"], ["un", "deux"], ["un", "deux"]),
    ("1. un", ["one", " ", "two"], ["un"], ["un", " ", "two"]),
    ("1.\nperdu\n2. deux", ["one", "two"], ["deux"], ["deux", "two"]),
    ("1. vaut\n3.14 pi\n2. deux", ["one", "two"], ["vaut", "14 pi", "deux"], ["vaut", "14 pi"]),
    ("1. un\n2. deux\n3. trois", ["one", "two"], ["un", "deux", "trois"], ["un", "deux"]),
    ("Used_Tools=0\n[Translation of item 1]\n1. un", ["one"], ["un"], ["un"]),
    ("sans numero", ["one"], [], ["one"]),
    (None, ["one", "two"], [], ["one", "two"]),
]


@pytest.mark.parametrize("raw,inputs,parsed,aligned", PARSER)
def test_parser_and_alignment(spark, raw, inputs, parsed, aligned):
    items = [(i, i * 2, t) for i, t in enumerate(inputs)]
    df = spark.createDataFrame([(raw, items)], f"raw string, items {ITEMS}")
    row = alignment.align_responses(df.withColumn("p", replies.parse_items(F.col("raw")))).first()
    assert row.p == parsed
    assert [a.text for a in row.aligned] == aligned
    assert [a["index"] for a in row.aligned] == [i * 2 for i in range(len(inputs))]
    kept = iter(parsed)
    flags = [bool(t.strip()) and next(kept, None) is None for t in inputs]
    assert [a.is_fallback for a in row.aligned] == flags


def test_numbering_skips_blanks(spark):
    df = spark.createDataFrame([([(0, 0, "x"), (1, 1, " "), (2, 2, "y")],)], f"items {ITEMS}")
    assert df.select(requests.numbered_text(F.col("items")).alias("t")).first().t == "1. x\n\n3. y"


def test_labels(spark):
    df = spark.createDataFrame([(40.0, 60.0), (39.99, 40.0), (20.0, 0.0), (0.0, -1.0)], "b double, c double")
    got = [tuple(r) for r in df.select(bleu_label(F.col("b")), chrf_label(F.col("c"))).collect()]
    assert [g[0].split()[0] for g in got] == ["High", "Understandable", "Understandable", "Low"]
    assert [g[1] for g in got] == ["High quality", "Acceptable", "Needs improvement", ""]
    tiers = spark.createDataFrame([("medium",), ("odd",), (None,)], "t string")
    notes = [r[0] for r in tiers.select(quality_note(F.col("t"))).collect()]
    assert notes[0].startswith("Ensure") and notes[1] == notes[2] and notes[1].startswith("Preserve")
    long = spark.createDataFrame([("x" * 101,)], "t string")
    assert long.select(preview("t", 100, "...")).first()[0] == "x" * 100 + "..."


def test_worst_segments_keep_order_on_ties(spark):
    df = spark.createDataFrame(
        [("s", i, c) for i, c in enumerate([5.0, 1.0, 1.0, 3.0, 1.0, 2.0])], "system string, seg_id long, chrf double"
    )
    assert [r[1] for r in rows(scoring.worst_segments(df, ["system"], ["seg_id"]), "rank")] == [1, 2, 4, 5, 3]


def test_runs(spark):
    schema = "p int, run_no int, bold boolean, italic boolean, has_picture boolean, image_id string, text string"
    data = [
        (1, 0, False, False, False, None, "ab"), (1, 1, True, False, False, None, "cde"),
        (1, 2, None, False, False, None, "fgh"),
        (2, 0, False, False, True, "r1", ""), (2, 1, False, False, False, None, "t"),
        (2, 2, False, True, True, "r2", ""), (2, 3, False, False, False, None, "u"),
        (3, 0, False, False, True, None, ""),
        (4, 0, False, False, False, None, "keep"),
    ]
    df = spark.createDataFrame(data, schema)
    flags = rows(segmentation.roll_up_runs(df, ["p"]), "p")
    assert flags == [(1, True, False, False, None), (2, False, True, True, "r2"),
                     (3, False, False, True, None), (4, False, False, False, None)]
    assert rows(runs.dominant_runs(df, ["p"]), "p")[0] == (1, 1, "cde")
    new = spark.createDataFrame([(1, " N1 "), (2, "N2"), (3, "N3"), (4, " "), (5, "N5")], "p int, text string")
    got = rows(runs.write_runs(df, new, ["p"]).select("p", "run_no", "text"), "p", "run_no")
    assert got == [(1, 0, ""), (1, 1, "N1"), (1, 2, ""), (2, 0, ""), (2, 1, "N2"), (2, 2, ""), (2, 3, "u"),
                   (3, 0, ""), (3, 1, " N3"), (4, 0, "keep"), (5, 0, "N5")]


def test_positions_do_not_depend_on_the_block(spark):
    data = [(g, i * 3) for g, n in (("hot", 500), ("cold", 7)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i int").repartition(7)
    want = [(g, i, i // 3) for g, i in sorted(data)]
    for block in (1, 10, 65536):
        assert rows(positions.dense_position(df, ["g"], "i", block=block).select("g", "i", "pos"), "g", "i") == want
    facts = df.groupBy("g").agg(F.max("i").alias("last"), F.count("*").alias("n"))
    joined = positions.spread_join(df, facts, ["g"], "i", "last", block=16)
    assert joined.count() == len(data) and joined.filter("n is null").count() == 0


def test_image_catalogue(spark):
    df = spark.createDataFrame([(1, 0, "image/png"), (1, 1, "text/xml"), (1, 2, "image/jpeg")],
                               "doc_id long, part_no int, content_type string")
    assert [r.filename for r in segmentation.image_catalogue(df, ["doc_id"]).orderBy("image_no").collect()] == [
        "image_0.png", "image_1.jpeg"]


@pytest.mark.parametrize("n_ref,want", [(8, (2, 8, 9, "20%", "warning")), (7, (3, 7, 9, "30%", "error")),
                                        (10, (0, None, None, None, "none"))])
def test_length_report(spark, n_ref, want):
    hyps = spark.range(10).select(F.lit("s").alias("system"), F.col("id").alias("pos"), F.lit("h").alias("hyp"))
    r = alignment.length_report(hyps, spark.range(n_ref)).first()
    assert (r.n_dropped, r.first_dropped, r.last_dropped, r.dropped_share, r.severity) == want


def documents(spark):
    return spark.createDataFrame(
        [(1, "the cat\n\nthe dog\nsat\nthere"), (2, "one"), (3, " \n")], "doc_id long, text string"
    )


@pytest.fixture
def shout():
    """A model; nested functions reach the workers by value."""
    cut = lambda p: p.split("\n\nRules:")[0].split("\n\n", 1)[1]
    return lambda prompts: [cut(p).upper() for p in prompts]


def test_model_workers_do_not_change_results(spark, shout):
    results = [
        rows(plan.translate_paragraphs(documents(spark), ModelTranslator(shout, workers=w)), "doc_id", "pos")
        for w in (None, 1, 8)
    ]
    assert results[0] == results[1] == results[2]
    assert [r[4] for r in results[0]] == ["THE CAT", "THE DOG", "SAT", "THERE", "ONE"]


def test_failed_calls_fall_back_to_the_source(spark, shout):
    def broken(prompts):
        if any("dog" in p for p in prompts):
            raise RuntimeError("down")
        return shout(prompts)

    options = plan.Options(batch_size=2)
    got = rows(plan.translate_paragraphs(documents(spark), ModelTranslator(broken), options), "doc_id", "pos")
    assert [(r[4], r[5]) for r in got] == [
        ("the cat", True), ("the dog", True), ("SAT", False), ("THERE", False), ("ONE", False)]


def test_review_replaces_the_draft_and_skips_failed_ones(spark, shout):
    def review(prompts):
        return [p.split("\n\n", 1)[1].split("\n\nRules:")[0].replace("THE", "A") for p in prompts]

    def draft(prompts):
        if any("one" in p for p in prompts):
            raise ValueError
        return shout(prompts)

    got = rows(plan.translate_paragraphs(documents(spark), ModelTranslator(draft), reviewer=ModelTranslator(review)),
               "doc_id", "pos")
    assert [r[4] for r in got] == ["A CAT", "A DOG", "SAT", "ARE", "one"]


def test_memory_and_glossary(spark):
    memory = build_memory(spark.createDataFrame([(" The CAT", "die Katze"), ("the cat", "zzz")], "source string, target string"))
    got = rows(plan.translate_paragraphs(documents(spark), MemoryTranslator(memory)), "doc_id", "pos")
    assert [r[4] for r in got] == ["die Katze", "the dog", "sat", "there", "one"]
    pairs = {"the": "der", "dog": "Hund"}
    table = build_glossary(spark.createDataFrame(list(pairs.items()), "source string, target string"))
    by_table = rows(plan.translate_paragraphs(documents(spark), GlossaryTranslator(table)), "doc_id", "pos")
    by_dict = rows(plan.translate_paragraphs(documents(spark), GlossaryTranslator(pairs)), "doc_id", "pos")
    assert by_table == by_dict and by_dict[1][4] == "der Hund"
    many = {f"w{i}": f"t{i}" for i in range(300)}
    assert spark.range(1).select(glossary_column(F.lit("w7 w299 x"), many)).first()[0] == "t7 t299 x"


def test_round_trip_keeps_every_paragraph(spark, tmp_path):
    def echo_of(prompts):
        cut = [p.split("\n\nRules:")[0].split("\n\nTRANSLATION BRIEF")[0] for p in prompts]
        return [p.split("\n\n", 1)[1] for p in cut]

    echo = ModelTranslator(echo_of)
    analyst = ModelTranslator(lambda ps: ["be brief"] * len(ps))
    out = rows(plan.translate_corpus(documents(spark), echo, analyst=analyst, folder=str(tmp_path)), "doc_id")
    assert out == rows(documents(spark), "doc_id")
    sent = spark.read.parquet(f"{tmp_path}/drafts")
    assert sent.filter(~F.contains("prompt", F.lit("be brief"))).count() == 0
    whole = sink.reassemble(segmentation.all_paragraphs(documents(spark)), ["doc_id"])
    assert rows(whole, "doc_id") == rows(documents(spark), "doc_id")


def test_tables(spark):
    grid = spark.createDataFrame(
        [(1, 0, [["the", ""], ["dog", "b", "extra"]]), (1, 1, [["the"]])],
        "doc_id long, table_index int, g array<array<string>>",
    )
    cells = segmentation.flatten_grid(grid, "g", tables.TABLE)
    assert rows(segmentation.table_shapes(cells, tables.TABLE), "table_index") == [(1, 0, 2, 2), (1, 1, 1, 1)]
    done = tables.translate_cells(cells, GlossaryTranslator({"the": "der", "dog": "Hund"}), "German", 2)
    assert [r[4] for r in rows(done, *tables.CELL)] == ["der", "", "Hund", "b", "extra", "der"]
    assert "extra" not in [r.text for r in tables.cells_inside_grid(done).collect()]
    rebuilt = rows(sink.rebuild_tables(done, tables.TABLE), "table_index")
    assert [tuple(r) for r in rebuilt[0][3]] == [(0, ["der", ""]), (1, ["Hund", "b", "extra"])]


def test_proxy_and_reports(spark):
    pairs = {"the": "der", "dog": "Hund"}
    done = plan.translate_paragraphs(documents(spark), GlossaryTranslator(pairs))
    back, mode = ev.choose_pairs(done, None, GlossaryTranslator({"der": "the"}))
    result = ev.evaluate(back, ["doc_id", "index"], [], mode)
    text = reports.evaluation_report(result.corpus, result.spread, result.flagged)
    assert "back_translation" in text and "0003]" in text
    assert result.corpus.first().n_evaluated == 5
    refs = done.select("doc_id", "index", F.col("text").alias("ref"))
    same, mode = ev.choose_pairs(done, refs, None)
    assert mode == "reference" and ev.evaluate(same, ["doc_id", "index"], []).corpus.first().bleu == 100.0


def test_reference_files(spark, tmp_path):
    (tmp_path / "refs.txt").write_text(" one  \n\x0btwo\r\n\n three", encoding="utf-8")
    got = read_references(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.ref) for r in got] == [(0, "one"), (1, "two"), (2, "three")]
    texts = spark.createDataFrame([(i, f"a{i}\nb{i}") for i in range(9)], "k long, text string")
    got = rows(corpus_references(texts, "k", block=2), "pos")
    assert got == [(2 * i + j, f"{c}{i}") for i in range(9) for j, c in enumerate("ab")]


def test_streaming_equals_batch(spark, tmp_path):
    from glossweave import streaming

    folders = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    documents(spark).write.parquet(folders[0])
    translator = GlossaryTranslator({"the": "der"})
    stream = streaming.read_documents(spark, folders[0])
    streaming.write_translations(stream, translator, folders[1], folders[2]).awaitTermination()
    want = plan.translate_paragraphs(documents(spark), translator)
    assert rows(spark.read.parquet(folders[1]), "doc_id", "pos") == rows(want, "doc_id", "pos")


def test_plans(spark, sf):
    from checks import queries as q

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    # From scan to aligned paragraph nothing is shuffled, and only two columns are read.
    rows_plan = plan_of(q.translations(spark, sf))
    assert "Exchange" not in rows_plan and "ReadSchema: struct<doc_id:bigint,text:string>" in rows_plan
    # Ranks are limited inside each task before the shuffle.
    scored = spark.range(100).selectExpr("string(id div 30) system", "id seg_id", "rand() chrf")
    assert plan_of(scoring.worst_segments(scored, ["system"], ["seg_id"])).count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan_of(scoring.worst_segments(scored, [], ["seg_id"]))
    assert plan_of(ev.translation_sample(q.translations(spark, sf), 20)).count("WindowGroupLimit") >= 2
    # No join is a nested loop.
    for name in ("j7_length_report", "a9_run_summary", "k2_written_runs", "k4_flagged_report"):
        text = plan_of(q.QUERIES[name](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_rebuilt_rows_do_not_depend_on_the_block(spark):
    cells = spark.range(225).select(F.lit(1).alias("doc_id"), F.lit(0).alias("table_index"), (F.col("id") * 2).alias("row_idx"),
                                    F.lit(0).alias("col_idx"), F.col("id").cast("string").alias("text"))
    flat = lambda df: sorted((x.row_idx, x.row) for r in df.collect() for x in r.rows)
    assert flat(sink.rebuild_tables(cells, tables.TABLE, block=50)) == flat(sink.rebuild_tables(cells, tables.TABLE))


def test_batches_without_text_come_back(spark, shout):
    """Paragraphs kept for their pictures only are counted and returned unchanged."""
    kept = [(i, t) for i, t in enumerate(["a", "b", " ", ""])]
    docs = spark.createDataFrame([(1, kept)], "doc_id long, text array<struct<index: int, text: string>>")
    for translator in (ModelTranslator(shout), GlossaryTranslator({"a": "x"}), MemoryTranslator(spark.createDataFrame([("a", "x")], "key string, target string"))):
        done = plan.translate_paragraphs(docs, translator, plan.Options(batch_size=2), kept=F.col("text"))
        assert [r.text for r in done.orderBy("pos").collect()][2:] == [" ", ""]
    summary = scoring.run_summary(docs, spark.createDataFrame([(1, 4, 0, 0)], "doc_id long, n_paragraphs long, n_tables long, n_images long"), done, "Hindi")
    assert summary.first().paragraphs_translated == 4


def test_large_k_is_ranked_in_parts(spark):
    scored = spark.range(20_000).select(F.lit("a").alias("system"), F.col("id").alias("seg_id"), (F.col("id") * 7 % 1000 / 10).alias("chrf"))
    worst = scoring.worst_segments(scored, ["system"], ["seg_id"], 5000)
    want = sorted((i * 7 % 1000 / 10, i) for i in range(20_000))[:5000]
    assert [(r.chrf, r.seg_id) for r in worst.orderBy("rank").collect()] == want
    assert "_salt" in worst._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_never_cut(spark):
    scored = spark.createDataFrame([("a", 12_344, 1.0), ("b", 4, 2.0)], "system string, seg_id long, chrf double")
    texts = spark.createDataFrame([("a", 12_344, "x"), ("b", 4, "y")], "system string, seg_id long, hyp string")
    got = {r.number for r in scoring.flagged_report(scored, texts, ["system"], ["seg_id"]).collect()}
    assert got == {"12345", "0005"}


def test_evaluation_of_files_and_systems(spark, tmp_path):
    docs = documents(spark)
    done = plan.translate_paragraphs(docs, GlossaryTranslator({"the": "der"}))
    texts = {}
    for r in done.orderBy("doc_id", "pos").collect():
        texts.setdefault(r.doc_id, []).append(r.text.replace("\n", " "))
    (tmp_path / "refs").mkdir()
    for doc, own in texts.items():
        (tmp_path / "refs" / f"{doc}.txt").write_text("\n".join(own[:-1] if doc == 1 else own), encoding="utf-8")
    found = ev.file_pairs(done, str(tmp_path / "refs"), None)
    assert found.mode == "reference" and found.pairs.count() == done.count() - 1
    assert {r.doc_id: r.n_dropped for r in found.lengths.collect()}[1] == 1
    missing = ev.file_pairs(done, str(tmp_path / "none"), GlossaryTranslator({"der": "the"}))
    assert missing.mode == "back_translation" and missing.lengths is None and missing.pairs.count() > 0
    refs = spark.createDataFrame([(0, "s", "one two three four"), (1, "s", "five six seven eight")], "seg_id long, source string, reference string")
    cut = lambda p: p.split("\n\nRules:")[0].split("\n\n", 1)[1]
    models = {"same": lambda ps: [cut(p) for p in ps], "upper": lambda ps: [cut(p).upper() for p in ps]}
    same_source = refs.withColumn("source", F.col("reference"))
    make = lambda f: lambda: bench_plan.system_hypotheses(same_source, ModelTranslator(f))
    hyps, seconds = bench_plan.timed_hypotheses(spark, {n: make(f) for n, f in models.items()}, str(tmp_path / "hyps"))
    scored = bench_plan.score_systems(hyps, refs)
    table = scoring.compare_systems(scored, seconds)
    assert {r.system: r.bleu for r in table.collect()} == {"same": 100.0, "upper": 0.0}
    assert reports.benchmark_report(table, "t").count("Inference time") == 2
    pairs = hyps.join(refs.select("seg_id", F.col("reference").alias("ref")), "seg_id")
    result = ev.evaluate(pairs, ["system", "seg_id"], ["system"], folder=str(tmp_path / "eval"))
    text = reports.evaluation_report(result.corpus, result.spread, result.flagged)
    assert text.count("TRANSLATION EVALUATION REPORT") == 2 and "system : upper" in text
    detail = alignment.sentence_detail(refs, hyps.filter("system = 'same'"))
    reports.write_sentences(detail, str(tmp_path / "sentences"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "sentences")).collect()]
    assert lines[0] == "[01] Source    : s" and sum("Ours" in x for x in lines) == 2


def test_plain_rebuild_takes_all_runs(spark):
    rows_ = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 1, None), (2, 5, "z")], "p long, run_no int, text string")
    text = runs.paragraph_texts(rows_, ["p"])
    assert {r.p: r.text for r in text.collect()} == {1: "ac", 2: "z"}
    flags = text.withColumns({"is_bold": F.lit(True), "is_italic": F.lit(None).cast("boolean"), "has_image": F.lit(False), "alignment": F.lit("center")})
    assert {r.alignment for r in runs.plain_rebuild(flags, ["p"]).collect()} == {"center"}


def test_positions_of_sparse_ids_and_ties(spark):
    """Hash-like 64-bit ids: no window holds more than its block, whatever the ids."""
    rows_ = spark.range(3000).select(F.lit(0).alias("k"), F.xxhash64("id").alias("order"), F.explode(F.array(F.lit(2), F.lit(1))).alias("tie"))
    placed = positions.dense_position(rows_, ["k"], "order", ties=("tie",))
    got = [(r.order, r.tie) for r in placed.orderBy("pos").collect()]
    assert got == sorted((r.order, r.tie) for r in rows_.collect())
    assert [r.pos for r in placed.orderBy("pos").collect()] == list(range(6000))
    tagged = rows_.withColumn("_block", positions.block_of("order"))
    levels = positions._offsets(tagged.groupBy("k", "_block").agg(F.count("*").alias("_n")), ["k"], positions.LEVELS)
    windows = [x for x in levels._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert sum("_outer" in x for x in windows) == positions.LEVELS


def test_positions_read_rows_once_and_shuffle_them_once(spark, sf):
    """The plan of the numbered rows; offsets come from a written table of few rows."""
    text = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows_ = segmentation.all_paragraphs(docs)
    for block in (2, positions.BLOCK):
        placed = positions.dense_position(rows_, ["doc_id"], "index", block=block)
        plan_ = text(placed)
        assert plan_.count("documents.parquet") == 1
        assert plan_.count("Exchange") <= 2
    ties = spark.range(100_000).select(F.lit(None).cast("string").alias("k"), (F.col("id") % 2).alias("o"), F.col("id").alias("t"))
    got = positions.dense_position(ties, ["k"], "o", ties=("t",), block=1)
    assert got.filter("pos <> t div 2 + o * 50000").count() == 0 and got.count() == 100_000


def plan_after(df):
    """The adaptive plan once it has run."""
    df.write.format("noop").mode("overwrite").save()
    frame = df.select("*")
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_each_distinct_text_is_sent_once(spark, tmp_path):
    """Repeated, blank, null and failing texts; requests are read back from the written table."""
    texts = ["N/A"] * 3000 + [f"text {i}" for i in range(40)] * 3 + [" ", "", None, "bad one", "bad one"]
    cells = spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], "doc_id long, table_index int, row_idx int, col_idx int, text string")

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        return [p.split("\n\nRules:")[0].split("\n\n", 1)[1].upper() for p in prompts]

    done = distinct.translate_distinct(cells.repartition(5), ModelTranslator(model), "German", 1, folder=str(tmp_path))
    assert done.columns == cells.columns
    got = [r.text for r in done.orderBy("row_idx").collect()]
    assert got == [t if not t or not t.strip() or t == "bad one" else t.upper() for t in texts]
    sent = [i.text for r in spark.read.parquet(f"{tmp_path}/distinct").collect() for i in r["items"]]
    assert sorted(sent) == sorted({t for t in texts if t and t.strip()})
    plain = tables.translate_cells(cells, ModelTranslator(model), "German", 1)
    assert rows(done, "row_idx") == rows(plain, "row_idx")
    assert distinct.translate_distinct(cells.limit(0), ModelTranslator(model), "German").count() == 0


def test_a_hot_text_is_split_in_the_join_back(spark):
    """A third of all rows hold one text: its partition is dealt to several tasks."""
    rows_ = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 999)).alias("text"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        done = distinct.translate_distinct(rows_.repartition(6), GlossaryTranslator({"hot": "cold"}), "German", buckets=4)
        assert "skew=true" in plan_after(done)
        assert done.filter("text = 'cold'").count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_wide_tables_come_back(spark):
    wide = spark.createDataFrame([(7, "the dog", None, " "), (9, "the dog", "dog", "x")], "k long, a string, b string, c string")
    done = tables.translate_wide(wide, "k", ["a", "b", "c"], GlossaryTranslator({"the": "der", "dog": "Hund"}), "German")
    assert done.columns == wide.columns
    assert rows(done, "k") == [(7, "der Hund", None, " "), (9, "der Hund", "Hund", "x")]
    ragged = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 3, "d"), (2, 5, 0, "a")], "t int, row_idx int, col_idx int, text string")
    assert rows(tables.widen(ragged, ["t"], ["x", "y", "z"]), "t") == [(1, 0, None, "b", None), (2, 5, "a", None, None)]


def test_one_reference_file_over_several_splits(spark, tmp_path):
    """Every split length gives the same numbers, in a folder with other files too."""
    marks = ["\n", "\r\n", "\r", "\u2028", "\x0b", "\x85", "\n \t\n"]
    lines = [f"line {i} é{'x' * (i % 37)}" for i in range(400)]
    whole = "".join(f" {t}{marks[i % len(marks)]}" for i, t in enumerate(lines))
    (tmp_path / "7.txt").write_bytes(whole.encode())
    (tmp_path / "8.txt").write_bytes(b"one\ntwo")
    (tmp_path / "8.zz").write_bytes(b"three\n")
    (tmp_path / "readme.txt").write_bytes(b"not\nreferences\n\n")
    (tmp_path / "9.txt").write_bytes(b"\n \n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    done = spark.createDataFrame(
        [(7, i, i, t, t.upper(), False) for i, t in enumerate(lines)] + [(8, i, i, t, t, False) for i, t in enumerate(["one", "two"])],
        "doc_id long, pos int, index int, source_text string, text string, is_fallback boolean")
    try:
        for size in ("400", "128m"):
            spark.conf.set(name, size)
            got = {}
            for r in read_references(spark, str(tmp_path)).orderBy("path", "pos").collect():
                got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.pos, r.ref))
            assert got == {"7.txt": list(enumerate(lines)), "8.txt": [(0, "one"), (1, "two")], "8.zz": [(0, "three")],
                           "readme.txt": [(0, "not"), (1, "references")]}
            found = ev.file_pairs(done, str(tmp_path), None)
            assert found.mode == "reference" and found.pairs.count() == 402
            assert found.pairs.filter("lower(hyp) <> ref").count() == 0
            assert [r.n_lines for r in found.ignored.collect() if r.path.endswith("readme.txt")] == [2]
            assert {r.doc_id: (r.n_hyp, r.n_ref) for r in found.lengths.collect()} == {7: (400, 400), 8: (2, 3)}
        spark.conf.set(name, "400")
        assert spark.read.text(str(tmp_path / "7.txt")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set(name, before)


def test_calls_of_a_task_run_side_by_side(spark):
    """Answers carry how many calls were running; order and one failure do not depend on it."""

    def model(sleep=0.05):
        state = {}

        def call(prompts):
            import threading
            import time

            lock = state.setdefault("lock", threading.Lock())
            with lock:
                state["now"] = state.get("now", 0) + 1
                state["peak"] = max(state.get("peak", 0), state["now"])
            time.sleep(sleep)
            with lock:
                state["now"] -= 1
            if any(p == "p13" for p in prompts):
                raise RuntimeError("down")
            return [f"{p} {state['peak']}" for p in prompts]

        return call

    asked = spark.range(60).coalesce(1).select("id", F.when(F.col("id") % 10 != 7, F.concat(F.lit("p"), "id")).alias("prompt"))
    conf, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):
            spark.conf.set(conf, size)
            got = {}
            for width in (1, 4):
                answers = ModelTranslator(model(), calls_per_batch=2, in_flight=width).respond(asked, ["id"]).collect()
                assert [r.id for r in answers] == list(range(60))
                got[width] = [(r.raw and r.raw.split()[0], r.error) for r in answers]
                assert max(int(r.raw.split()[1]) for r in answers if r.raw) == width
                assert all(0.02 < r.seconds < 0.5 for r in answers if r.raw) and all((r.seconds is None) == (r.prompt is None) for r in answers)
            assert got[1] == got[4]
            assert got[4] == [(None, "no prompt") if i % 10 == 7 else (None, "RuntimeError: down") if i == 13 else (f"p{i}", None) for i in range(60)]
    finally:
        spark.conf.set(conf, before)


def test_a_second_run_asks_only_what_failed(spark, shout, tmp_path):
    """Prompts that reach the model are written by it."""
    log = tmp_path / "asked"
    log.mkdir()

    def model(down):
        def call(prompts):
            import uuid

            (log / f"{down or 'up'}-{uuid.uuid4().hex}").write_text("\0".join(prompts))
            if down and any(down in p for p in prompts):
                raise RuntimeError("down")
            return shout(prompts)

        return call

    def asked(name):
        return sorted({p.split("\n\n")[1] for f in log.glob(f"{name}-*") for p in f.read_text().split("\0")})

    options = plan.Options(batch_size=1)
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "no id\nthe dog")], "doc_id long, text string"))
    run = lambda down, d=docs, **k: plan.translate_paragraphs(
        d, ResumingTranslator(ModelTranslator(model(down)), str(tmp_path / "run"), **k), options)
    first = rows(run("dog"), "doc_id", "pos")
    assert [(r[4], r[5]) for r in first] == [("NO ID", False), ("the dog", True), ("THE CAT", False), ("the dog", True), ("SAT", False), ("THERE", False), ("ONE", False)]
    second = rows(run("", rounds=3), "doc_id", "pos")
    assert asked("up") == ["1. the dog"]
    assert [r[4] for r in second] == ["NO ID", "THE DOG", "THE CAT", "THE DOG", "SAT", "THERE", "ONE"] and not any(r[5] for r in second)
    third = rows(run("none", spark.createDataFrame([(1, "the cat\nnew")], "doc_id long, text string")), "doc_id", "pos")
    assert asked("none") == ["1. new"] and [r[4] for r in third] == ["THE CAT", "NEW"]
    # A whole run with all three models, twice: nothing is asked again.
    whole = lambda name: rows(plan.translate_corpus(
        documents(spark), ModelTranslator(model(name)), reviewer=ModelTranslator(lambda ps: [p.split("\n\n")[1] for p in ps]),
        analyst=ModelTranslator(lambda ps: ["brief"] * len(ps)), folder=str(tmp_path / "whole"), resume=True, rounds=2), "doc_id")
    assert whole("zz1") == whole("zz2") and asked("zz1") and not asked("zz2")


def test_time_of_calls_is_independent_of_scan_and_write(spark, tmp_path):
    import time

    def slow(prompts):
        time.sleep(0.2 * len(prompts))
        return ["1. a\n2. b\n3. c"] * len(prompts)

    bitext = spark.range(30).select(F.col("id").alias("seg_id"), F.concat(F.lit("s"), "id").alias("source"))
    hyps, seconds = bench_plan.timed_hypotheses(
        spark,
        {"slow": lambda: bench_plan.system_hypotheses(bitext, ModelTranslator(slow, in_flight=2)),
         "free": lambda: bitext.select("seg_id", F.col("source").alias("hyp"))},
        str(tmp_path))
    took = {r.system: r.seconds for r in seconds.collect()}
    assert took["free"] is None and 2.0 <= took["slow"] <= 2.6
    assert hyps.filter("system = 'slow'").count() == 30 and [r.hyp for r in hyps.filter("system = 'slow'").orderBy("seg_id").limit(4).collect()] == ["a", "b", "c", "a"]


def test_reports_of_many_groups(spark, tmp_path):
    """A report for every document, written by Spark; length mismatches are in it."""
    rows_ = [(d, i, f"one two three four {d}", f"one two three {'four' if i else 'five'} {d}") for d in range(40) for i in range(3)] + [(None, 0, "a b", "a b")]
    pairs = spark.createDataFrame(rows_, "doc_id long, pos int, hyp string, ref string")
    result = ev.evaluate(pairs, ["doc_id", "pos"], ["doc_id"], k=2)
    counts = spark.createDataFrame([(0, 3, 3), (1, 3, 4), (2, 9, 3)], "doc_id long, n_hyp long, n_ref long")
    texts = reports.report_texts(result.corpus, result.spread, result.flagged, alignment.length_severity(counts, ["doc_id"]))
    got = {r.doc_id: r.report for r in texts.collect()}
    assert set(got) == {*range(40), None}
    assert "mismatch" not in got[0] and "the last 1 references were dropped (3 to 3, 25%): scores are not reliable." in got[1]
    assert "9 hypotheses and 3 references; the last 6 hypotheses were dropped (3 to 8, 67%)" in got[2]
    assert got[5].split("\n")[:4] == ["TRANSLATION EVALUATION REPORT", "  doc_id : 5", "  Mode       : reference", "  Paragraphs : 3"]
    assert got[5].count("] chrF") == 2 and "  [0001] chrF" in got[5] and "Detail : " in got[5]
    reports.write_reports(texts, str(tmp_path / "reports"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "reports")).collect()]
    assert lines.count("TRANSLATION EVALUATION REPORT") == 41


def test_intermediates_are_deleted(spark):
    from glossweave import session

    kept = session.written(spark.range(3), "kept")
    with session.scratch(spark):
        assert session.written(spark.range(5), "gone").count() == 5
        gone = session._WRITTEN[spark.sparkContext.applicationId][-1]
    place = spark._jvm.org.apache.hadoop.fs.Path(gone)
    assert kept.count() == 3 and not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    assert session.drop_intermediates(spark) > 0 and session.drop_intermediates(spark) == 0


def test_workers_get_a_bounded_part_of_the_prompts(spark, shout, monkeypatch):
    asked = spark.range(200).selectExpr("id doc_id", "repeat('x', 100) prompt")
    model = ModelTranslator(shout, workers=3)
    assert model.respond(asked, ["doc_id"]).rdd.getNumPartitions() == 3
    monkeypatch.setattr(translators, "TASK_BYTES", 1000)
    assert model.respond(asked, ["doc_id"]).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_answers_leave_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(translators, "PIECE", piece)

    def upper(prompts):
        return [p.upper() for p in prompts]

    asked = spark.range(0, 300, 1, 2).selectExpr("id", "if(id % 7 < 2 or id > 250, null, concat('a', id)) prompt")
    for width in (1, 4):
        got = ModelTranslator(upper, calls_per_batch=5, in_flight=width).respond(asked, ["id"]).collect()
        assert len(got) == 300
        for r in got:
            want = (None, "no prompt") if r.prompt is None else (r.prompt.upper(), None)
            assert (r.raw, r.error) == want


def test_batches_are_cut_once_and_alone(spark):
    """A document is split once, and no batch carries the paragraphs of the others."""
    docs = spark.createDataFrame([(1, "a\n\nb\nc\nd"), (2, " \n"), (3, None), (4, "e")], "doc_id long, text string")
    batches = batching.batch_documents(docs, 3)
    got = [(r.doc_id, r.batch_id, [tuple(i) for i in r["items"]]) for r in batches.orderBy("doc_id", "batch_id").collect()]
    assert got == [
        (1, 0, [(0, 0, "a"), (1, 2, "b"), (2, 3, "c")]), (1, 1, [(3, 4, "d")]), (4, 0, [(0, 0, "e")])
    ]
    assert dict(batches.dtypes)["batch_id"] == "int"
    text = batches._jdf.queryExecution().executedPlan().toString()
    assert text.count("split(") == 1
    assert re.search(r"posexplode.*, \[doc_id#\d+L\], true", text)
    kept = spark.createDataFrame([(1, None), (2, [])], "doc_id long, text array<struct<index:int,text:string>>")
    assert batching.batch_documents(kept, 3, kept=F.col("text")).count() == 0


def test_lines_of_a_reply_are_stripped_as_a_whole_reply_is(spark):
    space = "\t\x0b\x0c\r\x1c\x85\xa0 　 "
    texts = ["", " ", "\n\n", f"{space}Translation:{space}\n1. a{space}\n{space}\n2.{space}b{space}", "output: \n 1. x\n\n y \n", f"1. a{space}"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for plain, quick in [
        (F.array_join(F.filter(F.transform(F.split(replies.drop_lead_in(F.col("t")), "\n"), strip), lambda x: x != ""), "\n"),
         replies.clean_reply(F.col("t"))),
    ]:
        assert df.filter(~plain.eqNullSafe(quick)).count() == 0


def test_only_words_of_the_glossary_are_looked_up(spark):
    df = spark.createDataFrame([("the cat of  the\tthe of",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(glossary_column(F.col("t"), {"the": "le", "of": None})).collect()]
    assert got == ["le cat of  the\tthe of", "", None]
    plan = df.select(glossary_column(F.col("t"), {str(k): "x" for k in range(20)}))._jdf.queryExecution().optimizedPlan().toString()
    assert " INSET " in plan or " IN (" in plan
