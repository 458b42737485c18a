"""Statistics of briefs and reviews, against plain Python."""

import math
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from glossweave.operators import segmentation, statistics, words

WORD = regex.compile(statistics.WORD)


def closed_phrases(text, least=2):
    """Level by level: phrases of n + 1 words from those of n, less those that a longer one covers."""
    paragraphs = [[w.lower() for w in WORD.findall(p)] for p in (text or "").split("\n")]
    out, shorter, n = {}, {}, 2
    while True:
        counts = Counter(tuple(p[i : i + n]) for p in paragraphs for i in range(len(p) - n + 1))
        longer = {k: c for k, c in counts.items() if c >= least}
        covered = {part for k, c in longer.items() for part in (k[:-1], k[1:]) if shorter.get(part) == c}
        out.update({" ".join(k): c for k, c in shorter.items() if k not in covered})
        if not longer:
            return out
        shorter, n = longer, n + 1


@pytest.mark.parametrize("least", [2, 3])
def test_maximal_phrases_of_the_whole_table(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.phrase): r.n for r in statistics.maximal_phrases(docs, least).collect()}
    assert got == {(r.doc_id, k): c for r in docs.collect() for k, c in closed_phrases(r.text, least).items()}


def test_maximal_phrases_of_awkward_texts(spark):
    texts = [None, "", "one", "a a a a a", "a b\na b", "a b c. A b c, x b c", "a b a b a b\nb a b", "Don't stop. don't stop",
             "\n".join(["the whole long line comes again and again"] * 3 + ["long line comes"]), "x y " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in statistics.maximal_phrases(docs).collect():
        got.setdefault(r.doc_id, {})[r.phrase] = r.n
    for k, text in enumerate(texts[:-1]):
        assert got.get(k, {}) == closed_phrases(text), text
    # "x y" once to 3,999 times, each one time less often.
    assert sorted(got[9].values()) == list(range(2, 4001))
    assert statistics.maximal_phrases(docs.limit(0)).count() == 0


def paragraphs(spark, texts):
    docs = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(texts)], "doc_id long, lang string, text string")
    return segmentation.segment_documents(docs)


def test_german_nouns_do_not_all_pass_as_names(spark):
    """Nouns follow articles, which are mostly followed by capitals; names follow verbs."""
    nouns = ["Haus", "Baum", "Tisch", "Wagen", "Hund", "Garten", "Fluss", "Berg"]
    verbs = ["sieht", "kennt", "fragt", "nennt"]
    texts = [("de", f"dort steht das {n} und das {m} bei dem {n}") for n in nouns for m in nouns]
    texts += [("de", f"morgen {v} Marlene das {n} und heute {v} Anton den {n}") for v in verbs for n in nouns]
    texts += [("de", f"gestern {v} man oft und gern {w} etwas") for v in verbs for w in verbs]
    texts += [("en", "later we saw Marlene near the house and the old tree") for _ in range(6)]
    texts += [("en", "Then the old house was sold. The tree was not") for _ in range(6)]
    names = statistics.corpus_names(paragraphs(spark, texts), ["lang"])
    got = {(r.lang, r.name): r for r in names.collect()}
    assert {k for k in got if k[0] == "de"} == {("de", "Marlene"), ("de", "Anton")}
    assert {k for k in got if k[0] == "en"} == {("en", "Marlene")}
    assert got["de", "Marlene"].n == got["de", "Marlene"].n_uses == 32


def test_names_of_several_words(spark):
    texts = [("en", f"we met Anna Maria Berg near {p} and spoke") for p in ("Ulm", "Rom", "Ulm", "here", "there")]
    texts += [("en", "they like the water and the long walk by the lake there") for _ in range(20)]
    texts += [("en", "Anna Maria Berg came. Maybe we saw Anna Maria Berg")]
    own = paragraphs(spark, texts)
    pairs = {(r["first"], r["second"]): r.n for r in statistics.name_pairs(own, ["lang"]).collect()}
    assert pairs == {("Anna", "Maria"): 7, ("Maria", "Berg"): 7}
    got = {(r.doc_id, r.name): r.n for r in statistics.document_names(own, ["lang"]).collect()}
    assert got[0, "Anna Maria Berg"] == 1 and got[25, "Anna Maria Berg"] == 2
    assert {name for _, name in got} <= {"Anna Maria Berg", "Ulm"}
    assert statistics.corpus_names(own.limit(0), ["lang"]).count() == 0
    assert {r.name for r in statistics.corpus_names(own, []).collect()} >= {"Berg"}


def test_majority_rendering(spark):
    rows = [(d, i, s, t) for d, (s, ts) in enumerate([("cat", ["Katze"] * 3 + ["Kater"]), ("dog", ["Hund", "Köter"]), ("tree", ["Baum"] * 2)])
            for i, t in enumerate(ts)] + [(9, 0, " cat ", "Katze "), (9, 1, "cat", " "), (9, 2, None, "x"), (9, 3, "cat", None)]
    done = spark.createDataFrame(rows, "doc_id long, index int, source_text string, text string")
    best = {r.source: (r.target, r.n, r.n_all) for r in statistics.majority_renderings(done).collect()}
    assert best == {"cat": ("Katze", 4, 5), "dog": ("Hund", 1, 2), "tree": ("Baum", 2, 2)}
    odd = statistics.deviating_segments(done, ["doc_id", "index"])
    assert sorted((r.doc_id, r["index"], r.target, r.majority, r.share) for r in odd.collect()) == [
        (0, 3, "Kater", "Katze", 0.8), (1, 1, "Köter", "Hund", 0.5)]


def test_a_brief_from_counts(spark):
    text = "Old Berta sees the red boat. the red boat waits for old men\nthe harbour is near the harbour. harbour"
    docs = spark.createDataFrame([(1, "en", text), (2, "en", None), (3, "en", "one line"), (4, "en", "the harbour of another town")], "doc_id long, lang string, text string")
    from glossweave.plans import translate as plan

    briefs = {r.doc_id: r.brief for r in plan.counted_briefs(docs, plan.Options(target_language="German")).collect()}
    assert set(briefs) == {1, 3, 4}
    assert "the red boat (2)" in briefs[1] and "German" in briefs[1]
    asked = plan.translate_paragraphs(docs, Listener(), briefs=plan.counted_briefs(docs)).collect()
    assert any("the red boat (2)" in r.text for r in asked)


class Listener:
    """Answers every request with its prompt on one line."""

    def respond(self, requests, keys):
        return requests.withColumns({"raw": F.concat(F.lit("1. "), F.translate("prompt", "\n", " ")), "error": F.lit(None).cast("string")})


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    """Ids that repeat and are null, empty and repeated lines."""
    texts = ["a b c d. a b c d", "Don't stop don't stop", "", "a b c d a b", "x", None, "der Mann sah Anna Bell, dann sah er Anna Bell"] * 6
    rows = [(None if i % 5 == 0 else i % 4, "en", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, lang string, index int, text string")


@pytest.mark.parametrize("long", [10, 10**9])
def test_grams_are_counted_by_document(spark, lines, monkeypatch, long):
    monkeypatch.setattr(statistics, "LONG", long)
    want = Counter()
    for r in lines.collect():
        words = [w.lower() for w in WORD.findall(r.text or "")]
        want.update((r.doc_id, " ".join(words[i : i + n])) for n in (2, 3, 4) for i in range(len(words) - n + 1))
    found = statistics.recurring_phrases(lines)
    assert {(r.doc_id, r.phrase): r.n for r in found.collect()} == {k: n for k, n in want.items() if n >= 2}
    if long > 10:
        keys = regex.findall(r"hashpartitioning\(([^)]*)\)", plan_of(found))
        assert keys and all(regex.fullmatch(r"doc_id#\d+L?, \d+", k) for k in keys), keys


def test_common_words_make_no_difference(spark, lines, monkeypatch):
    want = statistics.key_terms(lines, 2, 1).orderBy("doc_id", "rank").collect()
    monkeypatch.setattr(statistics, "COMMON", 2)
    assert statistics.key_terms(lines, 2, 1).orderBy("doc_id", "rank").collect() == want
    assert "_salt" not in plan_of(statistics.key_terms(lines, 2, 1))


def test_words_of_texts_are_taken_once(spark, lines):
    assert plan_of(statistics.name_candidates(lines)).count("regexp_extract") == 1
    for counted in (statistics.name_pairs, statistics.corpus_names):
        assert "regexp_extract" not in plan_of(counted(lines, ["lang"]))


def test_few_texts_are_objects_at_a_time(monkeypatch):
    monkeypatch.setattr(statistics, "SLICE", 8)
    element = pa.struct([("gram", pa.string()), ("n", pa.int64())])
    of = lambda texts: (texts, [len(t) for t in texts], [1] * len(texts))
    texts = ["abc", "de", None, "f" * 20, "", "gh", "i" * 7]
    got = list(statistics._by_slices(of, element)(iter([pa.array(texts)])))
    assert len(got) > 2 and [x[0]["gram"] for a in got for x in a.to_pylist()] == [t or "" for t in texts]


#: Spaces of all kinds, ends of lines, marks, letters beyond Python's or Java's tables, cases that depend on neighbours.
ODD = ["a\u00a0b c", "\u00a0 Anna Bell \u2003", "er sah\u2028 Anna\u2028 Bell\u2029", "so\x1cAnna \x1d sah\x0bBell\x85 x", "ab-cd--ef 'gh' i'j’k- l-", "ΟΔΟΣ ΟΔΟΣ.ΑΒ Σ", "İstanbul IĞDIR ẞ",
       "x1y2 «Größe», (\U0001d400\U0001d401) \U00020000", "a\u0870b \U00010d50c \U00011f04", "e\u0301tait na\u00efve", "end. (Next) end.) Next end!» Then? \"Now\" no: Yes . Alone", "", "  ", None, "\t\r", "Ab aB AB ab Ǆa ǅa ʰa Aʰ", "don't Anna's O'Neil"]


def test_words_are_those_of_the_regular_expressions(spark, monkeypatch):
    """Words and cases as the JVM finds them text by text, however the texts are dealt out."""
    own = spark.createDataFrame(list(enumerate(ODD * 3)), "doc_id long, text string").repartition(2)
    c = words.classes(spark)
    want = {r.doc_id: r.words for r in statistics._word_lines(own).collect()}
    texts = pa.array(ODD * 3)
    found = words.words(words.tokens(texts), c)
    names, got = found.values.to_pylist(), {}
    for row, code in zip(found.row.tolist(), found.code.tolist()):
        got.setdefault(row, []).append(names[code])
    assert {k: " ".join(v) for k, v in got.items()} == want

    bare, stop = r"^\p{P}*(\p{L}+)\p{P}*$", r"[.!?:]\p{P}*$"
    tokens = own.select("doc_id", F.split(statistics.strip("text"), r"\s+").alias("t")).select("doc_id", F.posexplode("t").alias("at", "t"))
    rows = tokens.select("doc_id", "at", F.regexp_extract("t", bare, 1).alias("w"), F.rlike("t", F.lit(stop)).alias("stop"), F.rlike(F.regexp_extract("t", bare, 1), F.lit(statistics.CAPITALISED)).alias("up")).collect()
    by = {(r.doc_id, r.at): r for r in rows}
    want = Counter((k, at, r.w, by[k, at - 1].w, r.up) for (k, at), r in by.items() if at and r.w and not by[k, at - 1].stop)
    stripped = own.select("doc_id", statistics.strip("text").alias("text")).orderBy("doc_id").toArrow()
    row, at, word, before, forms, capital = statistics._cases(stripped, c)
    forms = forms.to_pylist()
    assert Counter((i, a, forms[w], forms[b], bool(capital[w])) for i, a, w, b in zip(row.tolist(), at.tolist(), word.tolist(), before.tolist())) == want

    monkeypatch.setattr(words, "SIZE", 16)
    batches = pa.table({"k": [1, 1, 1, 2, 2, None, None, 3] * 3, "text": ["some words"] * 24}).to_batches(5)
    cut = list(words.chunks(iter(batches), "text", "k"))
    assert len(cut) > 3 and pa.concat_tables(cut).equals(pa.Table.from_batches(batches))
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(cut, cut[1:]))


def test_most_frequent_phrases_of_a_row(spark, monkeypatch):
    texts = ["a b c a b c a b", "x y " * 3000, "a a a a a a", "the line again and again\n" * 4 + "line again", "one", None, "u v w " * 30 + "\n" + "v w u " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {}
    for r in statistics.maximal_phrases(docs).collect():
        every.setdefault(r.doc_id, []).append((-r.n, -len(r.phrase), r.phrase))
    for k, text in enumerate(texts):
        if k != 1:
            assert {p: -n for n, _, p in every.get(k, [])} == closed_phrases(text)
    for free in (statistics.FREE, 0):
        monkeypatch.setattr(statistics, "FREE", free)
        monkeypatch.setattr(statistics, "DEEP", 0 if free == 0 else 1)
        got = {}
        for r in statistics.maximal_phrases(docs, most=3).collect():
            got.setdefault(r.doc_id, []).append((-r.n, -len(r.phrase), r.phrase))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in every.items()}


def test_key_terms_of_repeated_ids(spark, lines, monkeypatch):
    """Against plain counts, with few hashes and few terms at a time; ids come again and are null."""
    monkeypatch.setattr(statistics, "HASHES", 4)
    monkeypatch.setattr(statistics, "TERMS", 3)
    monkeypatch.setattr(statistics, "COMMON", 2)
    more = spark.createDataFrame([(100 + i, "en", 0, f"word{chr(97 + i)} common other other x{chr(97 + i % 3)}") for i in range(9)], lines.schema)
    own = lines.unionByName(more)
    counts = {}
    for r in own.collect():
        counts.setdefault(r.doc_id, Counter()).update(w.lower() for w in WORD.findall(r.text or ""))
    df = Counter(t for c in counts.values() for t in c)
    total = len([k for k in counts if k is not None])
    want = {}
    for k, c in counts.items():
        best = sorted((-round(n * math.log(total / df[t]), 6), t, n) for t, n in c.items())[:3]
        want[k] = [(t, n, df[t]) for _, t, n in best]
    got = {}
    for r in statistics.key_terms(own, 3, 1).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.term, r.n, r.n_docs))
    assert got == {k: v for k, v in want.items() if v}


def test_only_what_may_count_travels(spark, monkeypatch):
    """Pairs are counted for words that may be names, and terms are joined that may be among the best."""
    tables = {}

    def kept(frame, name, of=statistics.written):
        tables[name] = of(frame, name)
        return tables[name]

    monkeypatch.setattr(statistics, "written", kept)
    texts = [("en", "we met Anna Bell by the old mill and then the river took all of the small boats we had") for _ in range(9)]
    own = paragraphs(spark, texts)
    assert {r.name for r in statistics.document_names(own, ["lang"]).collect()} == {"Anna Bell"}
    assert {r.word for r in tables["word-pairs"].collect()} == {"Anna", "Bell"}
    rare = paragraphs(spark, [("en", f"common words of all and rare{chr(97 + i)} rare{chr(97 + i)}") for i in range(20)])
    counted = statistics._document_counts(statistics._term_runs(rare, 3)).groupBy("term").agg(F.sum("n_docs").alias("n_docs"))
    likely = statistics._likely_terms(statistics._term_runs(rare, 3), counted, 20, 1)
    assert sorted(r.term for r in likely.collect()) == sorted(f"rare{chr(97 + i)}" for i in range(20))
