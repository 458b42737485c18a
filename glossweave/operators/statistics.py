"""Countable contents of a translation brief and countable rules of a review.

All counts are partial aggregates, so a frequent word or source text is no hot spot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..session import written
from . import words
from .positions import anti_join_null_safe, head, join_null_safe

#: A word: letters, with hyphens or apostrophes inside.
WORD = r"\p{L}+(?:[-'’]\p{L}+)*"
PHRASE_SIZES = (2, 3, 4)
#: A capitalised word.
CAPITALISED = r"^\p{Lu}\p{Ll}+$"
#: A name: capitalised in at least this share of its uses, and a log-likelihood ratio of 1 in 1000.
NAME_SHARE, NAME_SCORE = 0.5, 10.83
#: The language's rate of capitals counts as so many uses of every word before.
SHRINK = 20
#: Characters of a document that one task may count, words in a table that is joined in place, and
#: bytes of texts that are Python objects at a time.
LONG, COMMON, SLICE = 1 << 24, 10_000, 1 << 18
#: Terms of rows that are arrays at a time, and hashes of words whose numbers of documents are bounded.
TERMS, HASHES = 1 << 20, 1 << 22
#: Sequences that are counted to find longer ones, for each word of some documents and besides.
DEEP, FREE = 1, 100_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _word_lines(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, words)``: the lower-cased words of every paragraph that has any, space-joined."""
    words = F.lower(F.array_join(_words(F.col("text")), " "))
    return paragraphs.select("doc_id", words.alias("words")).filter("words <> ''")


def _gram_counts(paragraphs: DataFrame, sizes: tuple[int, ...], least: int) -> DataFrame:
    """``(doc_id, gram, n)``: word sequences of ``sizes`` words that a document has ``least`` times or more.

    Words travel once, to their document, and are counted there.  Documents of more than ``LONG``
    characters, as many rows of one id may make, are counted gram by gram in all tasks instead.
    """
    total = paragraphs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("_size"))
    long = written(total.filter(F.col("_size") > LONG).select("doc_id"), "long-documents")
    lines = _word_lines(paragraphs)
    some = not long.isEmpty()
    short = anti_join_null_safe(lines, long, ["doc_id"]) if some else lines
    whole = short.groupBy("doc_id").agg(F.array_join(F.collect_list("words"), "\n").alias("words"))
    found = whole.select("doc_id", F.explode_outer(_counted(sizes, least)("words")).alias("g")).filter("g is not null")
    counts = found.select("doc_id", "g.gram", "g.n")
    if not some:
        return counts
    cut = join_null_safe(lines, long, ["doc_id"], "inner").select("doc_id", F.explode_outer(_counted(sizes, 1)("words")).alias("g"))
    spread = cut.filter("g is not null").groupBy("doc_id", F.col("g.gram").alias("gram")).agg(F.sum("g.n").alias("n"))
    return counts.unionByName(spread.filter(F.col("n") >= least))


def _by_slices(of, element: pa.DataType):
    """A function of texts as an iterator UDF; few texts at a time are Python objects, at least one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(batch):
                past = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, past + SLICE, "right")))
                texts = [t or "" for t in batch.slice(start, end - start).to_pylist()]
                grams, counts, sizes = of(texts)
                pairs = pa.StructArray.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], fields=list(element))
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pairs)
                start = end

    return run


def _counted(sizes: tuple[int, ...], least: int):
    """A function of word lines: grams with their counts."""

    def of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        cut = [[*t.replace("\n", " \n ").split(" "), "\n"] if t else ["\n"] for t in texts]
        words = [w for c in cut for w in c]
        code = pd.factorize(np.array(words, object))[0]
        base, stop = code.max() + 1, code[-1]
        text = np.repeat(np.arange(len(cut)), list(map(len, cut)))
        at = np.flatnonzero(code != stop)
        number = text[at]
        starts, lengths, counts = [], [], []
        for n in range(1, max(sizes) + 1):
            inside = code[at + (n - 1)] != stop
            at, number = at[inside], number[inside]
            number, found = pd.factorize(number * base + code[at + (n - 1)])
            count = np.bincount(number, minlength=len(found))
            if n in sizes:
                first = np.empty(len(found), np.int64)
                first[number] = at
                often = count >= least
                starts.append(first[often])
                lengths.append(np.full(often.sum(), n))
                counts.append(count[often])
            # A longer gram is not more frequent.
            often = count[number] >= least
            at, number = at[often], number[often]
        starts, lengths, counts = map(np.concatenate, (starts, lengths, counts))
        order = np.argsort(text[starts], kind="stable")
        grams = [" ".join(words[i : i + n]) for i, n in zip(starts[order].tolist(), lengths[order].tolist())]
        return grams, counts[order], np.bincount(text[starts], minlength=len(texts))

    element = pa.struct([("gram", pa.string()), ("n", pa.int64())])
    return F.arrow_udf(_by_slices(of, element), "array<struct<gram string, n bigint>>")


def _types(frame: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in columns)


def _term_runs(paragraphs: DataFrame, least_length: int) -> DataFrame:
    """``(doc_id, terms, counts)``: words and their counts, for rows of a document that a task reads side by side.

    Words are one string, with spaces between, and counts bytes, as Spark moves few large values faster.
    """
    c = words.classes(paragraphs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.chunks(batches, "text", "doc_id"):
            found = words.words(words.tokens(table.column("text")), c)
            row = np.append(0, np.cumsum(words.changes(table.column("doc_id"))))
            long = (pc.utf8_length(found.values).to_numpy(zero_copy_only=False) >= least_length)[found.code]
            base = len(found.values) + 1
            keys, counts = np.unique(row[found.row[long]] * base + found.code[long], return_counts=True)
            ends = np.searchsorted(keys, np.arange(row[-1] + 2) * base)
            every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.values.take(pa.array(keys % base, pa.int64())))
            places, numbers = pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(counts.astype(np.int32))
            first = pa.array(np.flatnonzero(np.diff(row, prepend=-1)))
            own = table.column("doc_id").combine_chunks().take(first)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(own), [None, places, numbers])
            yield pa.RecordBatch.from_arrays([own, pc.binary_join(every, " "), bytes_], ["doc_id", "terms", "counts"])

    schema = f"{_types(paragraphs, ['doc_id'])}terms string, counts binary"
    return paragraphs.select("doc_id", "text").mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Rows of ``_term_runs``, few at a time: their ids, and of their terms the row, the term and the count."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("counts")).to_numpy(zero_copy_only=False) // 4
        batch, sizes = batch.filter(pa.array(sizes > 0)), sizes[sizes > 0]
        ends, start = np.cumsum(sizes), 0
        while start < len(batch):
            past = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, past + TERMS, "right")))
            part = batch.slice(start, end - start)
            flat = pc.split_pattern(part.column("terms"), " ").flatten().dictionary_encode()
            n = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.int32).astype(np.int64)
            yield part.column("doc_id"), np.repeat(np.arange(len(part)), sizes[start:end]), flat, n
            start = end


def _term_rows(runs: DataFrame) -> DataFrame:
    """``(doc_id, term, n)`` of ``_term_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, row, term, n in _pieces(batches):
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(row)), term.dictionary_decode(), pa.array(n)], ["doc_id", "term", "n"])

    return runs.mapInArrow(run, f"{_types(runs, ['doc_id'])}term string, n bigint")


def _document_counts(runs: DataFrame) -> DataFrame:
    """``(term, n_docs)``: rows that have each term, as tasks count them, so not all rows of terms travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, term, _ in _pieces(batches):
            n = np.bincount(term.indices.to_numpy(zero_copy_only=False), minlength=len(term.dictionary))
            yield pa.RecordBatch.from_arrays([term.dictionary, pa.array(n, pa.int64())], ["term", "n_docs"])

    return runs.mapInArrow(run, "term string, n_docs bigint")


def _likely_terms(runs: DataFrame, df: DataFrame, total: int, k: int) -> DataFrame:
    """``(doc_id, term, n)``: terms that may be among the ``k`` best of their row, and surely those that are.

    The documents of the ``COMMON`` words are known, those of the others to be between the least and the most
    of the words of a hash; a word whose score cannot reach what ``k`` others of its row have for sure is left out.
    """
    common = df.orderBy(F.desc("n_docs"), "term").limit(COMMON).toArrow()
    least = pc.min(common["n_docs"]).as_py() or 0
    steps = lambda f, c: f(F.log2(c) * 4).cast("tinyint")
    rest = df.filter(F.col("n_docs") <= least).groupBy((F.crc32("term") % HASHES).cast("int").alias("hash"))
    bounds = rest.agg(steps(F.floor, F.min("n_docs")).alias("low"), steps(F.ceil, F.max("n_docs")).alias("high")).toArrow()
    low, high = np.zeros((2, HASHES), np.int8)
    low[bounds["hash"].to_numpy()], high[bounds["hash"].to_numpy()] = bounds["low"].to_numpy(), bounds["high"].to_numpy()
    known, n_known = common["term"].combine_chunks(), np.append(common["n_docs"].to_numpy(), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, row, term, n in _pieces(batches):
            at = np.array([zlib.crc32(t) for t in term.dictionary.cast(pa.binary()).to_pylist()], np.int64) % HASHES
            exact = n_known[pc.fill_null(pc.index_in(term.dictionary, known), -1).to_numpy(zero_copy_only=False)]
            of = term.indices.to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore"):
                worst, best = (n * np.log(total / np.where(exact > 0, exact, 2.0 ** (b[at] / 4)))[of] for b in (high, low))
            order = np.lexsort((-worst, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            need = np.full(len(doc_id), -np.inf)
            need[row[order][place == k - 1]] = worst[order][place == k - 1]
            kept = pa.array(np.flatnonzero(best >= need[row] - 1e-5))
            rows = pa.array(row).take(kept)
            taken = [doc_id.take(rows), term.dictionary.take(term.indices.take(kept)), pa.array(n).take(kept)]
            yield pa.RecordBatch.from_arrays(taken, ["doc_id", "term", "n"])

    return runs.mapInArrow(run, f"{_types(runs, ['doc_id'])}term string, n bigint")


def key_terms(paragraphs: DataFrame, k: int = 10, least_length: int = 3) -> DataFrame:
    """The ``k`` words of each document with the highest TF-IDF; ties in word order.

    The counts are a written table, one row for rows of a document that stand side by side; only ids that
    come again elsewhere are counted over all tasks.  Of the other documents only words that may be among
    the best meet the number of their documents by a join between tables.
    """
    runs = written(_term_runs(paragraphs, least_length), "term-counts")
    again = runs.groupBy("doc_id").agg(F.count("*").alias("_runs")).filter("_runs > 1").select("doc_id")
    again = written(again, "documents-in-parts")
    some = not again.isEmpty()
    once = anti_join_null_safe(runs, again, ["doc_id"]) if some else runs
    counts = _document_counts(once)
    if some:
        parts = _term_rows(join_null_safe(runs, again, ["doc_id"], "inner"))
        parts = written(parts.groupBy("doc_id", "term").agg(F.sum("n").alias("n")), "term-sums")
        counts = counts.unionByName(parts.select("term", F.lit(1).cast("bigint").alias("n_docs")))
    df = written(counts.groupBy("term").agg(F.sum("n_docs").alias("n_docs")), "document-counts")
    total = runs.agg(F.count_distinct("doc_id")).first()[0]
    tf = _likely_terms(once, df, total, k)
    score = F.round(F.col("n") * F.log(F.lit(total) / F.col("n_docs")), 6)
    scored = (tf.unionByName(parts) if some else tf).join(df, "term")
    scored = scored.withColumn("score", score).withColumn("_low", -F.col("score"))
    return head(scored, ["doc_id"], ["_low", "term"], k, rank="rank").select(
        "doc_id", "rank", "term", "n", "n_docs", "score"
    )


def name_candidates(paragraphs: DataFrame, least: int = 2) -> DataFrame:
    """Capitalised words that do not start a sentence, with their counts per document."""
    cut = paragraphs.select("doc_id", F.split(strip("text"), r"\s+").alias("_t"))
    inside = F.filter(
        F.transform("_t", lambda t, i: F.struct(t.alias("token"), F.get("_t", i - 1).alias("before"))),
        lambda x: x["before"].isNotNull() & ~F.rlike(x["before"], F.lit(r"[.!?:]$")),
    )
    bare = F.transform(inside, lambda x: F.regexp_extract(x["token"], r"^\p{P}*(\p{Lu}\p{Ll}+)\p{P}*$", 1))
    # The filter of a plain explode would repeat the whole expression, for every token the split as well.
    names = cut.select("doc_id", F.explode_outer(F.filter(bare, lambda t: t != "")).alias("name")).filter("name is not null")
    return names.groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def recurring_phrases(paragraphs: DataFrame, sizes: tuple[int, ...] = PHRASE_SIZES, least: int = 2) -> DataFrame:
    """Word sequences that a document has ``least`` times or more."""
    return _gram_counts(paragraphs, sizes, least).select("doc_id", F.col("gram").alias("phrase"), "n")


def maximal_phrases(documents: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """``(doc_id, phrase, n)``: word sequences of any length that a document has ``least`` times or more.

    A phrase that a longer one covers, by containing it and being as frequent, is left out.  Phrases
    lie inside one paragraph.  With ``most`` a row gives that many of its phrases: the most frequent, of
    these the longest, of these the first in text order.  A document is one row and stays so.  A text that is one
    word over and over has that word at every length as a phrase, so what it gives is quadratic in it.
    """
    c = words.classes(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.chunks(batches):
            lines = pc.split_pattern(pc.fill_null(table.column("text").combine_chunks().cast(pa.string()), ""), "\n")
            document = np.repeat(np.arange(len(lines)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
            found = words.words(words.tokens(lines.flatten()), c)
            row, phrase, n = _closed(document[found.row], found.row, found.code, found.values, least, most)
            own = table.column("doc_id").combine_chunks().take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["doc_id", "phrase", "n"])

    return documents.select("doc_id", "text").mapInArrow(run, f"{_types(documents, ['doc_id'])}phrase string, n bigint")


def _closed(
    document: np.ndarray, line: np.ndarray, word: np.ndarray, names: pa.Array, least: int, most: int | None
) -> tuple[list[int], list[str], list[int]]:
    """Closed repeats of documents: the document, phrase and count of each.

    Sequences of n + 1 words are counted where both of their parts of n words recur, and with ``most`` as often
    as a document's phrases found so far ask; none is more frequent than its parts.  Documents whose repeats
    are so long that this is not in proportion to their length are left to ``_long_repeats``.
    """
    size = len(word)
    found, spent, deep = [], 0, np.zeros(0, np.int64)
    # What a longer sequence's count must reach in its document, which may have ``most`` better ones already.
    enough, best = np.full(document[-1] + 1 if size else 0, least), np.zeros((2, 0), np.int64)
    gram = pd.factorize(document * (len(names) + 1) + word)[0]
    counts = np.bincount(gram)
    gram[counts[gram] < least] = -1
    at = np.flatnonzero(gram >= 0)
    for length in range(1, size + 1):
        # Where a recurring sequence goes on inside its line with another.
        longer = at[at + length < size]
        longer = longer[(line[longer + length] == line[longer]) & (gram[longer + 1] >= 0)]
        number, above = _counted_keys(gram[longer] * size + gram[longer + 1])
        often = above[number] >= enough[document[longer]]
        longer, number = longer[often], number[often]
        if length > 1:
            first = np.full(len(counts), size, np.int64)
            first[gram[at[::-1]]] = at[::-1]
            covered = np.zeros(len(counts), bool)
            for part in (longer, longer + 1):
                whole = counts[gram[part]] == above[number]
                covered[gram[part[whole]]] = True
            closed = np.flatnonzero((first < size) & ~covered)
            found.append((first[closed], np.full(len(closed), length), counts[closed]))
            if most is not None and len(closed):
                best = np.append(best, [document[first[closed]], counts[closed]], axis=1)
                best = best[:, np.lexsort((-best[1], best[0]))]
                place = np.arange(best.shape[1]) - np.searchsorted(best[0], best[0])
                enough[best[0][place == most - 1]] = best[1][place == most - 1]
                best = best[:, place < most]
        if not len(longer):
            break
        spent += len(longer) + 2000
        if spent > DEEP * size + FREE:
            deep = np.unique(document[longer])
            break
        gram[at] = -1
        gram[longer] = number
        at, counts = longer, above
    start, length, n = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    kept = ~np.isin(document[start], deep)
    start, length, n = start[kept], length[kept], n[kept]
    parts = [(start, length, n)]
    for a, b in zip(np.searchsorted(document, deep).tolist(), np.searchsorted(document, deep, "right").tolist()):
        own = _long_repeats(word[a:b], line[a:b], least)
        parts.append((a + own[0], own[1], own[2]))
    start, length, n = map(np.concatenate, zip(*parts))
    chars = np.append(0, np.cumsum(pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[word] + 1))
    order = np.lexsort((start, chars[start] - chars[start + length], -n, document[start]))
    if most is not None and len(order):
        # Of the documents' phrases the first ``most`` and all that are as frequent and long as the last of these.
        d, c = document[start[order]], (chars[start + length] - chars[start])[order]
        same = (np.diff(d) == 0) & (np.diff(n[order]) == 0) & (np.diff(c) == 0)
        place = np.arange(len(order)) - np.searchsorted(d, d)
        level = np.append(0, np.cumsum(~same))
        order = order[place[np.unique(level, return_index=True)[1]][level] < most]
    names = names.to_pylist()
    text = [" ".join([names[w] for w in word[i : i + k].tolist()]) for i, k in zip(start[order].tolist(), length[order].tolist())]
    row, n = document[start[order]].tolist(), n[order].tolist()
    if most is None:
        return row, text, n
    ranked = sorted(zip(row, [-x for x in n], [-len(x) for x in text], text))
    best = [x for _, own in groupby(ranked, lambda x: x[0]) for x in islice(own, most)]
    return [x[0] for x in best], [x[3] for x in best], [-x[1] for x in best]


def _counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct keys and their counts; sorting is faster for few of them."""
    if len(keys) < 10_000:
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return number, counts
    number = pd.factorize(keys)[0]
    return number, np.bincount(number)


def _long_repeats(word: np.ndarray, line: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and count of the closed repeats of a document, by its sorted suffixes.

    The time is near its length, however long its repeats are.
    """
    # Every line ends with a number of its own, so no repeat crosses it.
    ends = np.flatnonzero(np.append(line[1:] != line[:-1], True)) + 1
    s = np.insert(word, ends, -1 - np.arange(len(ends)))
    n, step = len(s), 1
    rank = np.unique(s, return_inverse=True)[1]
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        order = np.lexsort((after, rank))
        changed = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(changed))
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    # Words that each suffix shares with the one sorted before it.
    shared, h, at, by_rank, seq = [0] * (n + 1), 0, rank.tolist(), order.tolist(), s.tolist()
    for i in range(n):
        if at[i]:
            j = by_rank[at[i] - 1]
            while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
                h += 1
            shared[at[i]], h = h, max(h - 1, 0)
        else:
            h = 0
    # Neighbours that differ in the word before; without it a longer phrase covers them all.
    before = np.append(-n - 2, s[:-1])[order]
    differs = np.append(0, np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))).tolist()
    out, stack = [], []
    for hi in range(1, n + 1):
        lo = hi - 1
        while stack and stack[-1][0] > shared[hi]:
            length, lo = stack.pop()
            if length > 1 and hi - lo >= least and differs[hi - 1] > differs[lo]:
                out.append((by_rank[lo], length, hi - lo))
        if shared[hi] and (not stack or stack[-1][0] < shared[hi]):
            stack.append((shared[hi], lo))
    found = np.array(out, np.int64).reshape(-1, 3)
    # Less the ends of lines before each start.
    start = found[:, 0] - np.searchsorted(ends + np.arange(len(ends)), found[:, 0])
    return start, found[:, 1], found[:, 2]


def _cases(table: pa.Table, c: words.Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words inside sentences: row, place, word and word before; the words, and which are capitalised."""
    cut = words.tokens(table.column("text"))
    word, capital, stop = words.case_facts(cut.values, c)
    forms = word.dictionary_encode()
    number = forms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    is_capital = np.zeros(len(forms.dictionary), bool)
    is_capital[number] = capital
    no_word = pc.equal(forms.dictionary, "").to_numpy(zero_copy_only=False)
    of = number[cut.code]
    starts = np.flatnonzero(np.diff(cut.row, prepend=-1))
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    i = np.flatnonzero((place > 0) & ~no_word[of] & ~np.append(False, stop[cut.code[:-1]])[: len(of)])
    return cut.row[i], place[i], of[i], of[i - 1], forms.dictionary, is_capital


def _word_facts(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, form, n, uses, up)``: uses of a word inside sentences, words after it, and capitalised ones.

    Tasks count some texts at a time, so what travels are distinct words.  Written.
    """
    c = words.classes(paragraphs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.chunks(batches):
            row, _, word, before, forms, capital = _cases(table, c)
            group, first = words.groups(table, by)
            base = len(forms) + 1
            number, keys = pd.factorize(np.append(group[row] * base + word, group[row] * base + before))
            count = lambda x, w=None: pa.array(np.bincount(x, w, len(keys)).astype(np.int64))
            after = number[len(row) :]
            own = table.select(by).take(pa.array(first[keys // base], pa.int64())).columns if by else []
            yield pa.RecordBatch.from_arrays(
                [*(x.combine_chunks() for x in own), forms.take(pa.array(keys % base)), count(number[: len(row)]), count(after), count(after, capital[word])],
                [*by, "form", "n", "uses", "up"],
            )

    schema = f"{_types(paragraphs, by)}form string, n bigint, uses bigint, up bigint"
    facts = paragraphs.select(*by, strip("text").alias("text")).mapInArrow(run, schema)
    return written(facts.groupBy(*by, "form").agg(*[F.sum(x).alias(x) for x in ("n", "uses", "up")]), "word-facts")


def _group_key(by: list[str]) -> Column:
    return F.concat_ws("\0", *[F.col(c).cast("string") for c in by], F.lit(""))


def _candidates(facts: DataFrame, by: list[str], least: int) -> DataFrame:
    """``(*by, word)``: lower-cased words that are capitalised often enough for a name."""
    up = F.when(_is_capital("form"), F.col("n")).otherwise(0)
    words_ = facts.groupBy(*by, F.lower("form").alias("word")).agg(F.sum(up).alias("n"), F.sum("n").alias("n_uses"))
    return written(words_.filter((F.col("n") >= least) & (F.col("n") >= NAME_SHARE * F.col("n_uses"))).select(*by, "word"), "name-candidates")


def _candidate_bits(facts: DataFrame, candidates: DataFrame, by: list[str]) -> np.ndarray:
    """Hashes of all forms of the candidates.  However many there are, these are ``words.BITS`` bits."""
    forms = facts.filter("n > 0").withColumn("word", F.lower("form")).join(candidates, [*by, "word"])
    place = F.crc32(F.concat(_group_key(by), "form")) % words.BITS + 1
    marked = forms.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    return words.bit_set([(r.b, bytes(r.m)) for r in marked.collect()])


def _case_uses(paragraphs: DataFrame, by: list[str], bits: np.ndarray | None, rows: bool) -> DataFrame:
    """``(*by, doc_id, index, at, before, word, n)``: capitalised words inside sentences and all uses of
    words in ``bits``, with the word before.

    With ``rows`` each capitalised word is a row; all others are counts of some texts, without ``at``.
    """
    c = words.classes(paragraphs.sparkSession)
    keys = [*by, "doc_id", "index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.chunks(batches):
            row, place, word, before, forms, capital = _cases(table, c)
            group, first = words.groups(table, by)
            base = len(forms) + 1
            counted = capital[word] if not rows else np.zeros(len(word), bool)
            if bits is not None:
                number, uses = pd.factorize(group[row] * base + word)
                names = [x.encode() for x in table.column("_by").take(pa.array(first)).to_pylist()]
                of = forms.take(pa.array(uses % base)).cast(pa.binary()).to_pylist()
                known = words.has_bits(bits, [(names[g], w) for g, w in zip((uses // base).tolist(), of)])
                counted |= known[number] & ~capital[word] if rows else known[number]
            some = np.flatnonzero(capital[word]) if rows else np.zeros(0, np.int64)
            own, pairs = pd.factorize((group[row[counted]] * base + before[counted]) * base + word[counted])
            n = np.bincount(own, minlength=len(pairs))
            at_row = np.append(row[some], first[pairs // base // base])
            gone = np.arange(len(at_row)) >= len(some)
            taken = table.select(keys).take(pa.array(at_row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(taken.column(x).combine_chunks() for x in keys),
                    pa.array(np.append(place[some], np.zeros(len(pairs), np.int64)), pa.int64(), mask=gone),
                    forms.take(pa.array(np.append(before[some], pairs // base % base), pa.int64())),
                    forms.take(pa.array(np.append(word[some], pairs % base), pa.int64())),
                    pa.array(np.append(np.ones(len(some), np.int64), n), pa.int64()),
                ],
                [*keys, "at", "before", "word", "n"],
            )

    schema = f"{_types(paragraphs, keys)}at bigint, before string, word string, n bigint"
    return paragraphs.select(*keys, _group_key(by).alias("_by"), strip("text").alias("text")).mapInArrow(run, schema)


def _pair_counts(uses: DataFrame, by: list[str]) -> DataFrame:
    return written(uses.groupBy(*by, "before", "word").agg(F.sum("n").alias("n")), "word-pairs")


def _is_capital(word: str) -> Column:
    return F.rlike(word, F.lit(CAPITALISED))


def corpus_names(paragraphs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """``(*by, name, n, n_uses, score)``: words that the case statistics of the corpus make names.

    What counts is being capitalised more often than the words before make likely: where nouns are
    capitalised, an article is mostly followed by a capital, so a noun after articles is no
    surprise, a name after a verb is.  ``score`` is the log-likelihood ratio of the capitalised uses
    ``n`` against those expected from what other words do after the same words, whose rates lean to that
    of the group.  Pairs of words are counted only for words that are capitalised often enough.
    """
    facts = _word_facts(paragraphs, by)
    candidates = _candidates(facts, by, least)
    uses = _case_uses(paragraphs, by, _candidate_bits(facts, candidates, by), False)
    return _corpus_names(_pair_counts(uses, by), facts, candidates, by, least)


def _corpus_names(counted: DataFrame, facts: DataFrame, candidates: DataFrame, by: list[str], least: int) -> DataFrame:
    """``corpus_names`` of counted pairs, whose uses of candidates are complete."""
    up = F.when(_is_capital("word"), F.col("n")).otherwise(0)
    cases = counted.select(*by, F.lower("before").alias("before"), F.lower("word").alias("word"), "n", up.alias("_up"))
    uses = cases.join(candidates, [*by, "word"]).groupBy(*by, "before", "word").agg(F.sum("n").alias("n_uses"), F.sum("_up").alias("n"))
    total = lambda *keys: facts.groupBy(*keys).agg(F.sum("up").alias("_n"), F.sum("uses").alias("_uses"))
    rate = (F.col("_n") / F.col("_uses")).alias("_rate")
    before = total(*by, F.lower("form").alias("before")).filter("_uses > 0")
    before = before.join(total(*by).select(*by, rate), by) if by else before.withColumn("_rate", total().select(rate).scalar())
    # Without the word's own uses.
    likely = (F.col("_n") - F.col("n") + SHRINK * F.col("_rate")) / (F.col("_uses") - F.col("n_uses") + SHRINK)
    words_ = (
        uses.join(before, [*by, "before"])
        .withColumn("_p", likely)
        .groupBy(*by, "word")
        .agg(F.sum("n").alias("n"), F.sum("n_uses").alias("n_uses"), F.sum(F.col("n_uses") * F.col("_p")).alias("_e"))
    )
    n, e = F.col("n"), F.col("_e")
    score = F.round(2 * (n * F.log(n / e) - (n - e)), 4)
    return (
        words_.filter((n >= least) & (n > e) & (n >= NAME_SHARE * F.col("n_uses")))
        .withColumn("score", score)
        .filter(F.col("score") >= NAME_SCORE)
        .select(*by, F.initcap("word").alias("name"), "n", "n_uses", "score")
    )


def name_pairs(paragraphs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """``(*by, first, second, n, score)``: capitalised words that follow each other more than by chance.

    ``score`` is the log-likelihood ratio of the table of both words over all words inside sentences.
    """
    facts = _word_facts(paragraphs, by)
    return _name_pairs(_pair_counts(_case_uses(paragraphs, by, None, False), by), facts, by, least)


def _name_pairs(counted: DataFrame, facts: DataFrame, by: list[str], least: int) -> DataFrame:
    """``name_pairs`` of counted pairs, whose uses of capitalised words are complete."""
    side = lambda c, uses, name: facts.filter(_is_capital("form") & (F.col(uses) > 0)).select(*by, F.col("form").alias(c), F.col(uses).alias(name))
    total = facts.groupBy(*by).agg(F.sum("uses").alias("_all"))
    both = counted.filter((F.col("n") >= least) & _is_capital("before") & _is_capital("word"))
    both = both.select(*by, F.col("before").alias("first"), F.col("word").alias("second"), "n")
    joined = both.join(side("first", "uses", "_f"), [*by, "first"]).join(side("second", "n", "_s"), [*by, "second"])
    joined = joined.join(total, by) if by else joined.withColumn("_all", total.scalar())
    n, f, s, every = (F.col(c) for c in ("n", "_f", "_s", "_all"))
    cell = lambda o, row, column: F.when(o > 0, o * F.log(o * every / (row * column))).otherwise(0.0)
    ratio = 2 * (
        cell(n, f, s) + cell(f - n, f, every - s) + cell(s - n, every - f, s) + cell(every - f - s + n, every - f, every - s)
    )
    return (
        joined.filter(n * every > f * s)
        .withColumn("score", F.round(ratio, 4))
        .filter(F.col("score") >= NAME_SCORE)
        .select(*by, "first", "second", "n", "score")
    )


def document_names(paragraphs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """``(doc_id, name, n)``: names of one word or several, as a document has them.

    Words whose pairs are names are joined to one name as far as the pairs go on; a single word counts
    if it is a name of the corpus and not part of a longer one there.
    """
    facts = _word_facts(paragraphs, by)
    candidates = _candidates(facts, by, least)
    every = written(_case_uses(paragraphs, by, _candidate_bits(facts, candidates, by), True), "case-uses")
    counted = _pair_counts(every, by)
    linked = _name_pairs(counted, facts, by, least).select(*by, F.col("first").alias("before"), F.col("second").alias("word"), F.lit(True).alias("_linked"))
    single = _corpus_names(counted, facts, candidates, by, least).select(*by, F.col("name").alias("word"), F.lit(True).alias("_single"))
    # Written, so Spark knows how small they are before it shuffles the tokens.
    linked, single = written(linked, "linked-words"), written(single, "single-names")
    tokens = every.filter("at is not null").drop("n")
    marked = tokens.join(linked, [*by, "before", "word"], "left").join(single, [*by, "word"], "left")
    # A linked token follows its first word, which may start the sentence; then it is no token itself.
    place = Window.partitionBy("doc_id", "index").orderBy("at")
    new = ~(F.coalesce("_linked", F.lit(False)) & (F.lag("at").over(place) == F.col("at") - 1))
    runs = marked.withColumn("_new", F.coalesce(new, F.lit(True))).withColumn("_run", F.sum(F.col("_new").cast("int")).over(place))
    parts = F.array_sort(F.collect_list(F.struct("at", "word", "before", "_linked", "_single")))
    names = runs.groupBy("doc_id", "index", "_run").agg(parts.alias("_w")).select(
        "doc_id",
        F.when(F.col("_w")[0]["_linked"], F.concat(F.col("_w")[0]["before"], F.lit(" "))).otherwise("").alias("_head"),
        F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("_tail"),
        ((F.size("_w") > 1) | F.coalesce(F.col("_w")[0]["_linked"], F.col("_w")[0]["_single"], F.lit(False))).alias("_ok"),
    )
    return names.filter("_ok").groupBy("doc_id", F.concat("_head", "_tail").alias("name")).agg(F.count("*").alias("n"))


def review_counts(translations: DataFrame, script: str) -> DataFrame:
    """Per document: items in and out, items equal to their source, and letters of ``script``.

    ``script`` is the name of a Unicode script.
    """
    letters = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return translations.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(~is_blank("text")).alias("n_answered"),
        F.count_if((strip("text") == strip("source_text")) & ~is_blank("text")).alias("n_unchanged"),
        F.sum(letters(r"[^\p{L}]").cast("bigint")).alias("n_letters"),
        F.sum(letters(rf"[^\p{{Is{script}}}]").cast("bigint")).alias("n_in_script"),
    )


def inconsistent_sources(translations: DataFrame) -> DataFrame:
    """Source texts that were rendered in more than one way."""
    pairs = translations.select(strip("source_text").alias("source"), strip("text").alias("target"))
    return (
        pairs.groupBy("source", "target")
        .agg(F.count("*").alias("n"))
        .groupBy("source")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_targets"))
        .filter(F.col("n_targets") > 1)
    )


def majority_renderings(translations: DataFrame) -> DataFrame:
    """``(source, target, n, n_all, n_targets)``: the most frequent rendering of each source text.

    Of equally frequent ones the first in text order.  Two partial aggregates; blank texts do not vote.
    """
    votes = (
        translations.select(strip("source_text").alias("source"), strip("text").alias("target"))
        .filter(~is_blank("source") & ~is_blank("target"))
        .groupBy("source", "target")
        .agg(F.count("*").alias("n"))
    )
    first = F.min(F.struct((-F.col("n")).alias("_less"), "target"))
    return votes.groupBy("source").agg(first.alias("_best"), F.sum("n").alias("n_all"), F.count("*").alias("n_targets")).select(
        "source", F.col("_best.target").alias("target"), (-F.col("_best._less")).alias("n"), "n_all", "n_targets"
    )


def deviating_segments(translations: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, source, target, majority, share)``: segments rendered otherwise than most of their source.

    ``share`` is the part of the source's renderings that agree with the majority.  Contested sources are
    a written table, so one with very many segments is split by Spark's skew join.
    """
    contested = written(majority_renderings(translations).filter("n_targets > 1"), "majorities")
    best = contested.select("source", F.col("target").alias("majority"), F.round(F.col("n") / F.col("n_all"), 4).alias("share"))
    own = translations.select(*keys, strip("source_text").alias("source"), strip("text").alias("target"))
    return (
        own.filter(~is_blank("source") & ~is_blank("target"))
        .join(best, "source")
        .filter("target <> majority")
        .select(*keys, "source", "target", "majority", "share")
    )
