import random

import pytest
from pyspark.sql import functions as F

from glossweave.functions import grams
from glossweave.operators import metrics as M

import plain_scorer as plain

GOLDEN = [
    # seg, hypothesis, reference, bleu, chrf
    (1, "the cat sat on the mat", "the cat is on the mat", 37.99, 64.58),
    (2, "Hello, world!", "Hello world.", 19.00, 51.58),
    (3, "a", "a", 100.00, 100.00),
    (4, "yes", "no", 0.00, 0.00),
    (5, "", "empty", 0.00, 0.00),
    (6, "It costs 3.50, not 4-5.", "It costs 3.50 not 4-5.", 59.69, 81.39),
    (7, "सभी मनुष्य समान हैं।", "सभी लोग समान हैं।", 35.36, 51.54),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seg_id long, hyp string, ref string")


def test_golden_segments_and_corpus(spark):
    pairs = frame(spark, [r[:3] for r in GOLDEN])
    scored = M.segment_scores(pairs, ["seg_id"]).cache()
    got = {r.seg_id: (r.bleu, r.chrf) for r in scored.collect()}
    assert got == {r[0]: r[3:] for r in GOLDEN}
    corpus = M.corpus_scores(scored, []).first()
    assert (corpus.n_evaluated, corpus.bleu, corpus.chrf) == (7, 39.46, 61.36)
    assert corpus.bleu_label.startswith("Understandable")
    assert corpus.chrf_label == "High quality"
    totals = M.total_stats(scored, []).first()
    assert [totals[c] for c in M.BLEU_COLUMNS] == [25, 24, 19, 10, 5, 2, 25, 19, 15, 11]
    orders = [(totals[f"hyp_{n}"], totals[f"ref_{n}"], totals[f"match_{n}"]) for n in range(1, 7)]
    assert orders == [(69, 67, 55), (63, 60, 45), (57, 54, 37), (53, 49, 29), (49, 44, 22), (45, 39, 15)]


def test_tokens(spark):
    row = spark.range(1).select(grams.tokens_13a(F.lit("It costs 3.50, not 4-5.")).alias("t")).first()
    assert row.t == "It costs 3.50 , not 4 - 5 ."


def random_pairs(n, seed):
    rng = random.Random(seed)
    alphabet = "aab bc .,-39&\n 　é\U0001f600\U0001f601<>é"
    text = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
    rows = []
    for i in range(n):
        ref = text()
        hyp = ref if i % 7 == 0 else (ref[:20] + text() if i % 2 else text())
        rows.append((i, hyp, ref))
    rows += [(n, "a" * 3000, "a" * 2000), (n + 1, "ab" * 500, "ba" * 400), (n + 2, "", ""), (n + 3, " ", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_scorer(spark, seed):
    rows = random_pairs(300, seed)
    scored = M.segment_scores(frame(spark, rows), ["seg_id"])
    got = {r.seg_id: r for r in scored.collect()}
    assert len(got) == len(rows)
    for seg, hyp, ref in rows:
        b, c = plain.bleu_stats(hyp, ref), plain.chrf_stats(hyp, ref)
        assert [got[seg][k] for k in M.BLEU_COLUMNS] == b, (hyp, ref)
        assert [got[seg][k] for k in M.CHRF_COLUMNS] == c, (hyp, ref)
        assert got[seg].bleu == pytest.approx(plain.bleu(b), abs=0.00501)
        assert got[seg].chrf == pytest.approx(plain.chrf(c), abs=0.00501)


def test_nothing_is_shuffled(spark):
    pairs = frame(spark, [r[:3] for r in GOLDEN])
    for make in (M.bleu_stats, M.chrf_stats, M.segment_scores):
        plan = make(pairs, ["seg_id"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_slices_do_not_change_results(spark, monkeypatch):
    rows = random_pairs(50, 3)
    texts = [r[1] for r in rows] + [r[2] for r in rows]
    whole = M.clipped_matches(*M._characters(texts), 6)
    for k, (_, hyp, ref) in enumerate(rows):
        assert (M.clipped_matches(*M._characters([hyp, ref]), 6)[0] == whole[k]).all()


def test_empty_corpus(spark):
    scored = M.segment_scores(frame(spark, []), ["seg_id"])
    row = M.corpus_scores(scored, []).first()
    assert row.n_evaluated == 0 and row.bleu is None and row.chrf is None and row.bleu_label is None


def test_units_are_cut_in_the_kernel(spark):
    """No regular expression runs over the texts of a pair, and each side is computed once."""
    pairs = frame(spark, []).withColumn("hyp", F.reverse("hyp"))
    for make in (M.bleu_stats, M.chrf_stats, M.segment_scores):
        plan = make(pairs, ["seg_id"])._jdf.queryExecution().executedPlan().toString()
        assert "regexp_replace" not in plan and plan.count("reverse(") == 1


def test_kernel_tokens_are_those_of_the_expression(spark):
    rng = random.Random(9)
    alphabet = "ab .,,..-193&;\n　é\U0001f600<>-'\"_/(){}~`!@#$%^*+=|\\\x1c\xa0quot"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "&amp;quot; x", "<skip<skipped>ped>-\n1..2,.3.", "1.,.,2", ".,.5", "3.5-4", "٣.٣-٣"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = [r.t.split() for r in rows.select("k", grams.tokens_13a(F.col("t")).alias("t")).orderBy("k").collect()]
    tokens, sizes = grams.split_13a(texts)
    assert sizes.tolist() == list(map(len, want)) and tokens == [t for w in want for t in w]


@pytest.mark.parametrize("order", [1, 4, 6])
def test_both_ways_of_counting_agree(order):
    rng = random.Random(order)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    units, sizes = M._characters(texts)
    assert (M.clipped_matches(units, sizes, order) == M._matches_by_order(units.astype(int), sizes, order)).all()
    wide = units.astype(int) + 5000 * (1 + len(units) * (units % 2))
    assert (M.clipped_matches(wide, sizes, order) == M._matches_by_order(wide, sizes, order)).all()


def test_both_scores_cut_a_pair_once(spark):
    """The texts of a pair go to Python, are decoded and are classified once for both scores."""
    plan = M.segment_scores(frame(spark, []), ["seg_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("count(hyp#") == 1


def test_tokens_are_numbered_without_strings():
    """Equal tokens have equal numbers, also those longer than a machine word and those of many characters."""
    rng = random.Random(4)
    few, many = "abc", "".join(map(chr, [*range(0x4E00, 0x5100), 0x1F600, 0x10FFFF]))
    for alphabet in (few, many, few + " .,3-&\n" + "b" * 9):
        texts = [" ".join("".join(rng.choices(alphabet, k=rng.choice((1, 2, 9, 10, 40)))) for _ in range(30)) for _ in range(20)]
        texts += ["", " ", "\x00 \x00\x00", "a&amp;b -\nc <skipped>"]
        number, sizes = grams.number_13a(grams.Texts(texts))
        tokens, want = grams.split_13a(texts)
        assert sizes.tolist() == want.tolist() and len(number) == len(tokens)
        assert len(set(zip(number.tolist(), tokens))) == len(set(tokens)) == len(set(number.tolist()))


def test_slices_of_the_kernel_cover_all_rows(spark, monkeypatch):
    rows = [(k, h, None if k % 5 == 0 else r) for k, h, r in random_pairs(60, 5)]
    want = M.segment_scores(frame(spark, rows), ["seg_id"]).orderBy("seg_id").collect()
    monkeypatch.setattr(M, "SLICE", 40)
    parts = list(M._slices(*[M.pc.fill_null(M.pa.array([r[k] for r in rows], M.pa.string()), "") for k in (1, 2)]))
    assert len(parts) > 10 and [k for p in parts for k in range(p.start, p.stop)] == list(range(len(rows)))
    assert M.segment_scores(frame(spark, rows), ["seg_id"]).orderBy("seg_id").collect() == want
