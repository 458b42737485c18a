"""Queries without SQL against brute force over the small tables."""

import re
import sys
from collections import defaultdict
from html import unescape
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from glossweave.llm import html_crf, pii, pretokens, quality_rules  # noqa: E402
from glossweave.llm.common import table  # noqa: E402
from glossweave.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def library():
    return pretokens.processor(pretokens.default_model())


def article(html):
    """Text of the one article of the tables' pages, by their own mark-up."""
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", html or "")
    parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in parts]
    return "\n\n".join(x for x in texts if x)


def test_pages(spark, sf):
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op1_html_extraction"](spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == article(html[r.page_id]) and r.n_chars == len(r.text)


def test_pieces_and_counts(spark, sf, docs, library):
    want = {d: library.encode(t or "") for d, t, _, _ in docs}
    coded = QUERIES["op5_sentencepiece"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in coded} == {d: len(x) for d, x in want.items()}
    assert all(r.round_trip and r.decoded_sha256 == plain.sha(library.decode(want[r.doc_id])) for r in coded)
    for r in QUERIES["op9_token_counts"](spark, sf).collect():
        text = next(t for d, t, _, _ in docs if d == r.doc_id) or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(want[r.doc_id]), len(want[r.doc_id]) > 4096)


def test_near_duplicates(spark, sf, docs):
    got = [tuple(r) for r in QUERIES["op6_simhash"](spark, sf).collect()]
    assert sorted(got) == sorted(plain.near_duplicates([(d, t) for d, t, _, _ in docs]))


def plain_data(text):
    """Kind, start and end of all data in the forms that the tables hold, by a pattern for each kind."""
    patterns = {
        "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]+", "card": r"\b\d{16}\b", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}\b",
        "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]\d|\d)", "date": r"\b\d{4}-\d{2}-\d{2}\b",
        "iban": r"\b[A-Z]{2}\d{2}[A-Z\d]{11,30}\b",
    }
    valid = {
        "card": lambda x: pii.luhn(x[:-1]) == int(x[-1]),
        "ip": lambda x: all(int(n) < 256 and str(int(n)) == n for n in x.split(".")),
        "iban": lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1,
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text, re.ASCII):
            if valid.get(kind, lambda x: True)(m[0]):
                yield kind, m.start(), m.end()


def test_personal_data(spark, sf, docs):
    """Every valid datum is gone; equal ones have equal pseudonyms; the rest of the text is as it was."""
    named = {}
    texts = {d: t for d, t, _, _ in docs}
    for r in QUERIES["op7_pii"](spark, sf).collect():
        old, at, begin = texts[r.doc_id] or "", 0, 0
        for s in r.spans:
            assert old[at : s.start] == r.text[begin : s.new_start]
            value, new = old[s.start : s.end], r.text[s.new_start : s.new_end]
            assert value not in r.text and named.setdefault(value, new) == new
            at, begin = s.end, s.new_end
        assert old[at:] == (r.text or "")[begin:]
        assert sorted((s.kind, s.start, s.end) for s in r.spans) == sorted(plain_data(old))
    assert len(set(named.values())) == len(named)


def kept_by_rules(docs):
    """Base rules and cutoffs, from sorted lists of bucket values."""
    rules = {}
    for k, (_, text, _, _) in enumerate(docs):
        n, chars, symbols, dup, repeats, failed = plain.quality_numbers(text)
        dense = "".join(plain.white_words(text))
        lines = [x for x in (text or "").split("\n") if plain.white_words(x)]
        share = lambda x, of, unit: x * unit // of if of else 0
        rules[k] = (failed, {
            "symbols": share(symbols, chars, 1000),
            "marks": share(sum(c in quality_rules.MARKS for c in dense), chars, 1000),
            "capitals": share(sum("A" <= c <= "Z" for c in dense), chars, 1000),
            "dup_lines": share(dup, len(lines), 1000),
            "repeats": share(repeats, n, 1000),
            "word_length": share(chars, n, 100),
        })
    bucket = lambda v: v >> max(v.bit_length() - quality_rules.SUB_BITS, 0) << max(v.bit_length() - quality_rules.SUB_BITS, 0)
    pools = defaultdict(list)
    for k, (_, _, lang, source) in enumerate(docs):
        for key in ((lang, source), (lang,), ()):
            pools[key].append(k)

    def cut(key, rule):
        """(texts, high, low) of one sketch; no texts, no cutoffs."""
        fence, _, positive = quality_rules.RULES[rule]
        values = sorted(b for j in pools[key] if (b := bucket(rules[j][1][rule])) or not positive)
        if not values:
            return 0, 0, 0
        q1, q2, q3 = (values[-(-k * len(values) // 4) - 1] for k in (1, 2, 3))
        width = 1 << max(q2.bit_length() - quality_rules.SUB_BITS, 0)
        return len(values), q2 + fence * (q2 - q1 + width), max(0, q2 - fence * (q3 - q2 + width))

    out = []
    for k, (_, _, lang, source) in enumerate(docs):
        failed, own = rules[k]
        for rule, (_, two_sided, _) in quality_rules.RULES.items():
            n, high, low = cut((), rule)
            if not n:
                continue
            for key in ((lang,), (lang, source)):
                n, own_high, own_low = cut(key, rule)
                prior = quality_rules.PRIOR**2
                high, low = ((n * n * a + prior * b) // (n * n + prior) for a, b in ((own_high, high), (own_low, low)))
            failed = failed or own[rule] > high or (two_sided and own[rule] < low)
        out.append(not failed)
    return out


def test_quality_verdicts_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: r.kept for r in QUERIES["op2_quality_rules"](spark, sf).collect()}
    assert got == {d: kept for (d, _, _, _), kept in zip(docs, kept_by_rules(docs))}


def test_pipeline_equals_brute_force(spark, sf, docs, library):
    rows = [d for d, kept in zip(docs, kept_by_rules(docs)) if kept]
    lines = plain.kept_lines([(d, t) for d, t, _, _ in rows])
    rows = [(d, new) for (d, old, _, _), new in zip(rows, lines) if new == (old or "") or plain.white_words(new)]
    rows = [x for x, (d, _, first) in zip(rows, plain.near_duplicates(rows)) if d == first]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    rows = [x for x, hit in zip(rows, plain.benchmark_hits(rows, items)) if not hit[2]]
    got = {r.doc_id: list(r.token_ids) for r in cp.run(spark, sf).collect()}
    assert got == {d: library.encode(t) for d, t in rows}
    assert len(got) < len(docs)


def test_tagger_takes_named_places():
    tagger = html_crf.trained()
    for place in ("<nav>", "<div class='sidebar'>", "<footer>", "<div id=comments>", "<form>", "<div class='cookie-banner notice'>"):
        tag = place[1:].split(" ")[0].rstrip(">")
        page = f"<article><h1>Title</h1><p>Some long paragraph of the article, with words.</p></article>{place}<p>Other text of the page.</p></{tag}>"
        assert html_crf.main_text(page, tagger) == "Title\n\nSome long paragraph of the article, with words."
