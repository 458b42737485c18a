"""Quality rules whose cutoffs come from the corpus, per language and source.

Every rule is an integer measure of a whole text.  Its values are gathered in a mergeable
quantile sketch per language and source: a histogram with exact buckets up to 2**SUB_BITS and
then 2**(SUB_BITS-1) buckets per power of two (a relative error of at most 2**-(SUB_BITS-1); the
family of Masson et al. 2019).  Adding sketches is adding counts, so Spark combines them before
its shuffle, a hot source costs no more than its buckets, and the result does not depend on
the order of rows.  The sketches of a language and of the corpus are sums of those of its groups.

A cutoff is the median plus ``fence`` times the distance from the quartile on the other side of it,
counted with one bucket more, so that a rule on which all texts agree still has a width.  Nothing
above the median takes part in the upper cutoff, so it holds while less than half of a source is junk.
Rules that are zero for most texts take the quantiles of the texts where they are not.

A group's cutoff is the mean of its own, weighted by the square of its texts, and its language's, weighted by
the square of ``PRIOR``; the language's leans to the corpus's in the same way.  So small groups follow their
language, large ones themselves, and no size changes a verdict by a step.
The cutoffs are joined back and documents outside any of them are rejected.

Main path: DataFrame functions only.  A null text has no words and fails the base rules.
Null languages and sources form groups of their own; repeated rows are kept and counted as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, WHITE, saved

SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUB_BITS = 6
#: A group of so many texts follows itself and its language by halves.
PRIOR = 50
#: Weights are squares of at most so many texts, by which nothing of the other cutoff is left.
MOST = 10**6
#: Rule: its fence, whether low values are rejected too, and whether zeros stay out of its quantiles.
RULES = {
    "symbols": (16, False, True),  # symbols per 1,000 characters of words
    "marks": (8, False, False),  # characters of words that are punctuation or symbols, per 1,000
    "capitals": (8, False, False),  # A-Z per 1,000 characters of words
    "dup_lines": (4, False, True),  # repeated lines per 1,000 lines with a word
    "repeats": (16, False, True),  # repeated words per 1,000 words
    "word_length": (8, True, False),  # hundredths of characters per word
}
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~" + SYMBOLS


def text_words(text: Column) -> Column:
    """Words of a text; an empty array for null or blank."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base numbers and the rules' values.

    Words inside repeated 3-word windows: the windows are hashed, packed with their place
    into longs and sorted.  Places whose hash has an equal neighbour are candidates, and only
    for those the words themselves are compared, so the number is exact.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    letters = F.translate(whole, WHITE, "")
    step = docs.withColumns({"_words": text_words(F.col(text)), "_dense": letters})
    n = F.size("_words")
    words = F.col("_words")
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        .bitwiseAND(F.lit(-(1 << 30)))
        .bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    step = step.withColumn("_packed", F.when(n >= 4, F.sort_array(hashes)).otherwise(none))
    packed = F.col("_packed")
    prefix = lambda x: F.shiftright(x, 30)
    near = lambda x, j: F.coalesce(prefix(F.get(packed, j)) == prefix(x), F.lit(False))
    step = step.withColumn("_some", F.filter(packed, lambda x, i: near(x, i + 1) | near(x, i - 1)))
    place = lambda x: x.bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    grams = F.sort_array(
        F.transform(
            "_some",
            lambda x: F.struct(F.array_join(F.slice(words, place(x) + 1, 3), " ").alias("gram"), place(x).alias("at")),
        )
    )
    step = step.withColumn("_grams", F.when(F.size("_some") > 0, grams))
    same = lambda x, j: F.coalesce(F.get(F.col("_grams"), j)["gram"] == x["gram"], F.lit(False))
    places = F.sort_array(
        F.transform(F.filter("_grams", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["at"])
    )
    step = step.withColumn("_places", places)
    at = F.col("_places")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    count_of = lambda chars: F.length("_dense") - F.length(F.translate("_dense", chars, ""))
    step = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length("_dense").cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_marks": count_of(MARKS).cast("long"),
            "_capitals": count_of(UPPER).cast("long"),
        }
    )
    step = step.withColumns(
        {
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    floor = lambda x, of, unit: F.expr(f"CASE WHEN {of} > 0 THEN ({x} * {unit}) DIV {of} ELSE 0 END")
    return step.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
            "_rules": F.struct(
                floor("n_symbols", "word_chars", 1000).alias("symbols"),
                floor("_marks", "word_chars", 1000).alias("marks"),
                floor("_capitals", "word_chars", 1000).alias("capitals"),
                floor("n_dup_lines", "_n_lines", 1000).alias("dup_lines"),
                floor("n_repeat_words", "n_words", 1000).alias("repeats"),
                floor("word_chars", "n_words", 100).alias("word_length"),
            ),
        }
    ).drop("_words", "_dense", "_packed", "_some", "_grams", "_places", "_lines", "_n_lines", "_marks", "_capitals")


def bucket(value: str) -> Column:
    """Lower end of the sketch's bucket of a value that is not negative."""
    shift = f"greatest(length(bin({value})) - {SUB_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, rule, bucket, n)``: the quantile sketch of every rule and group."""
    values = measured.select(
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("rule"), F.col("_rules")[r].alias("value")) for r in RULES])
        ).alias("v"),
    )
    return values.groupBy("lang", "source", "v.rule", bucket("v.value").alias("bucket")).agg(
        F.count("*").alias("n")
    )


def cutoffs(sketch: DataFrame, prior: int = PRIOR, rules: dict | None = None) -> DataFrame:
    """One row per language and source: ``low_<rule>`` and ``high_<rule>`` (inclusive), null for no cutoff."""
    rules = rules or RULES
    # Level 0: the group, 1: its language, 2: the corpus.
    level = lambda k, lang, source: (
        sketch.groupBy(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "rule", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    none = F.lit(None).cast("string")
    own, lang, corpus = level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none)
    merged = saved(own.unionAll(lang).unionAll(corpus), "sketch-levels")
    sparse = [r for r, (_, _, positive) in rules.items() if positive]
    counted = merged.filter((F.col("bucket") > 0) | ~F.col("rule").isin(sparse))
    # A window holds the buckets of one sketch, whose number is bounded.
    whole = Window.partitionBy("level", "lang", "source", "rule")
    rows = counted.withColumns(
        {"below": F.sum("n").over(whole.orderBy("bucket")), "total": F.sum("n").over(whole)}
    )
    quantile = lambda k: F.min(F.when(F.col("below") * 4 >= F.col("total") * k, F.col("bucket")))
    quartiles = rows.groupBy("level", "lang", "source", "rule").agg(
        quantile(1).alias("q1"), quantile(2).alias("q2"), quantile(3).alias("q3"), F.max("total").alias("total")
    )
    width = F.expr(f"shiftleft(1L, greatest(length(bin(q2)) - {SUB_BITS}, 0))")
    fence = F.create_map(*[F.lit(x) for r, (f, _, _) in rules.items() for x in (r, f)])[F.col("rule")]
    high = F.col("q2") + fence * (F.col("q2") - F.col("q1") + width)
    low = F.greatest(F.lit(0), F.col("q2") - fence * (F.col("q3") - F.col("q2") + width))
    both = quartiles.withColumns({"_high": high, "_low": low})
    of = lambda r, c, name: F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{name}_{r}")
    parts = (("total", "n"), ("_high", "high"), ("_low", "low"))
    # Groups in which no value of a sparse rule is positive come from the sketch itself.
    table = both.groupBy("level", "lang", "source").agg(*[of(r, c, name) for r in rules for c, name in parts])
    top = table.filter("level = 2").first()

    def blend(r: str, side: str, outer: Column) -> Column:
        """Own cutoff by the square of the texts it comes from, the outer one by that of ``prior``."""
        n, mine = F.least(F.coalesce(f"n_{r}", F.lit(0)), F.lit(MOST)), F.coalesce(f"{side}_{r}", F.lit(0))
        sum_ = n * n * mine + prior * prior * F.coalesce(outer, F.lit(0))
        mixed = F.call_function("div", sum_, n * n + prior * prior)
        return F.when(outer.isNotNull(), mixed)

    names = [(side, r) for r in rules for side in ("low", "high")]
    corpus = {x: F.lit(top[f"{x[0]}_{x[1]}"] if top else None).cast("long") for x in names}
    langs = table.filter("level = 1").select(
        F.col("lang").alias("_lang"), *[blend(r, side, corpus[side, r]).alias(f"_{side}_{r}") for side, r in names]
    )
    groups = merged.filter("level = 0").select("lang", "source").distinct()
    mine = table.filter("level = 0").drop("level").withColumnsRenamed({"lang": "_l", "source": "_s"})
    return (
        groups.join(mine, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
        .join(langs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .select("lang", "source", *[blend(r, side, F.coalesce(f"_{side}_{r}", corpus[side, r])).alias(f"{side}_{r}") for side, r in names])
    )


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``kept``: the base rules hold and no value is beyond its cutoff."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for rule, (_, two_sided, _) in RULES.items():
        value = F.col("_rules")[rule]
        inside = inside & F.coalesce(value <= F.col(f"high_{rule}"), F.lit(True))
        if two_sided:
            inside = inside & F.coalesce(value >= F.col(f"low_{rule}"), F.lit(True))
    return (
        measured.join(
            limits,
            F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")),
            "left",
        )
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop("_lang", "_source", "_rules", *[f"{side}_{r}" for r in RULES for side in ("low", "high")])
    )


def quality(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with its base numbers and ``kept``.

    A column of ``keep`` with the name of a result is replaced by it.
    """
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = [c for c in keep if c not in (*numbers, "kept")]
    columns = list(dict.fromkeys([*keep, lang, source]))
    own = measures(docs.select(*columns, text) if text not in columns else docs.select(*columns), text)
    rows = saved(own.select(*columns, *numbers, "_rules"), "measures")
    limits = saved(cutoffs(saved(sketches(rows, lang, source), "sketches")), "cutoffs")
    return judge(rows, limits, lang, source).select(*keep, *numbers, "kept")
