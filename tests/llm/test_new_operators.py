"""Whitening, packing and token alignment against brute force and on awkward rows."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from decimal import Decimal, localcontext
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from glossweave.llm import byte_tokens, packing, pretokens, token_alignment, whitening  # noqa: E402
from glossweave.llm.common import table  # noqa: E402
from glossweave.llm.queries import QUERIES  # noqa: E402

AWKWARD = [
    (-1, None), (-2, ""), (-3, "a▁b c"), (-4, " x  y<|endoftext|>\n\tz é漢字😀 \x00"), (None, "same words"), (None, "same words"),
    (-5, "aaaa" * 5000 + "☃" * 1000), (-6, " \n \n"), (-7, "</s> [INST] <s>"), (-8, "word " * 30_000),
]


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokens.default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(AWKWARD, "doc_id long, text string"))


# --- whitening ------------------------------------------------------------------------------


def plain_white(vectors, limit=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:limit], u[:, ::-1][:, :limit]
    n, s = len(x), [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return (x - x.mean(0)) @ u / np.sqrt(e), e / np.trace(v), deviation


def test_whitening_of_the_whole_table(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    white, share, deviation = plain_white([r.embedding for r in rows])
    got = QUERIES["op11_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    assert [r.vec_id for r in got[::8]] == [r.vec_id for r in rows] and [r.component for r in got[:8]] == list(range(1, 9))
    found = np.array([r.whitened for r in got]).reshape(-1, 8)
    assert np.abs(found * np.sign((found * white).sum(0)) - white).max() < 1e-9
    assert np.abs(np.array([r.explained for r in got[:8]]) / share - 1).max() < 1e-10
    assert [r.deviation for r in got[::8]] == deviation and {r.n for r in got} == {len(rows)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_awkward_rows(spark):
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 0.25], [3.0, 2.5, -4.0], [1.5, 1.5, 1.5], [1.5, 1.5, 1.5]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [1.0, 2.0], [None, None, None]]
    rows = [(i % 4 if i else None, v, "x") for i, v in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    got = whitening.whiten(frame.repartition(3), keep=("vec_id", "n"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    white, share, deviation = plain_white(good)
    assert len(got) == 15 and {r.n for r in got} == {5}
    for k in range(3):
        own = sorted(round(abs(r.whitened), 8) for r in got if r.component == k + 1)
        assert own == sorted(round(abs(x), 8) for x in white[:, k].tolist())
        assert {round(r.explained, 10) for r in got if r.component == k + 1} == {round(float(share[k]), 10)}
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation)
    # Without variance there is nothing to whiten.
    for few in (frame.limit(0), spark.createDataFrame(rows[3:5], frame.schema), spark.createDataFrame(rows[5:9], frame.schema)):
        assert whitening.whiten(few).count() == 0


def test_whitening_with_equal_and_no_variances(spark):
    """Two axes of equal variance, one that follows from another, one that is constant; huge entries."""
    corners = [[a, b, 2.0 * a, 7.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for _ in range(3)]
    square = [[a, b, 7.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0)]
    for vectors, count in ((corners, 2), (square, 2), ([[1e300, 1.0], [-1e300, 2.0], [0.0, 5.0]], 2)):
        frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
        got = whitening.whiten(frame).orderBy("vec_id", "component").collect()
        w = np.array([r.whitened for r in got]).reshape(-1, count)
        assert np.abs(np.cov(w.T, bias=True) - np.eye(count)).max() < 1e-9 and got[0].identity_error < 1e-9
    assert [r.deviation for r in got if r.component == 1][0] is None or got[0].deviation > 0


def test_exact_sums_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 5)) * [1, 1e3, 1e6, 1e9, 1e12]).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = [[int(np.floor(1024 * c)) for c in v] for v in vectors]
    for parts in (1, 7):
        total = whitening.scatter(frame.repartition(parts), "embedding")
        assert total.n == 300 and total.sums == [sum(c) for c in zip(*x)]
        assert total.products == [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]
    matrix = total.centred()
    got = whitening.characteristic_polynomial(spark, matrix)
    # By Faddeev and LeVerrier, in integers.
    power, want = np.zeros((5, 5), object), [1]
    for k in range(1, 6):
        power = np.array(matrix, object) @ power + np.eye(5, dtype=int).astype(object) * want[-1]
        want.append(-(np.array(matrix, object) @ power).trace() // k)
    assert got == want[::-1]
    for k in range(1, 6):
        a, shift, first, count = whitening.isolate(got, k)
        assert (first, count) == (k, 1) and a.bit_length() >= whitening.ROOT_BITS
        with localcontext() as digits:
            digits.prec = 300
            low, high = (sum(Decimal(c) * (Decimal(y) / Decimal(2) ** shift) ** i for i, c in enumerate(got)) for y in (a, a + 1))
        assert low * high <= 0


# --- packing --------------------------------------------------------------------------------


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2), (4, 3)])
def test_hilbert_curve_visits_every_cell_by_steps_of_one(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).tolist()) == {1}


def check_pieces(pieces, texts, words, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        want = np.array([*words.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(want)
        for r in own:
            assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    sizes = {}
    for k, own in by_sequence.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        sizes[k] = sum(r.length for r in own)
    # All are full but the last.
    assert sorted(sizes) == list(range(len(sizes))) and all(n == length for k, n in sizes.items() if k < len(sizes) - 1)
    return by_doc


def test_packing_of_the_whole_table(spark, sf, words):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    pieces = QUERIES["op12_packing"](spark, sf)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(pieces.collect(), texts, words, packing.LENGTH)


def test_packing_of_awkward_rows(spark, words):
    rows = [(i, t, "clash") for i, (_, t) in enumerate(AWKWARD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    for length, parts in ((16, 1), (100, 5), (2048, 40)):
        pieces = packing.pack(frame, keep=("doc_id", "start"), length=length, parts=parts)
        assert pieces.columns[:2] == ["doc_id", "start"]
        own = pieces.collect()
        check_pieces(own, {i: t or "" for i, t, _ in rows}, words, length)
        whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
        assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in own)
    # Rows without ids and repeated ids are documents of their own.
    again = spark.createDataFrame([(None, "x"), (None, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(again).collect()) == [(0, 2), (0, 2), (3, 2), (3, 2)]
    assert packing.pack(frame.limit(0)).count() == 0


def test_near_documents_lie_near_on_the_curve(spark):
    """Three kinds of text in a random order: most neighbours on the curve are of one kind."""
    rng = np.random.default_rng(5)
    kinds = [[f"{c}{i}" for i in range(60)] for c in ("stone", "water", "cloud")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 80))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(packing.pack(frame, length=64).filter("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))
    same = [a.doc_id % 3 == b.doc_id % 3 for a, b in zip(order, order[1:])]
    assert np.mean(same) > 0.8
    copies = spark.createDataFrame([(i, rows[i % 5][1]) for i in range(100)], "doc_id long, text string").repartition(6)
    order = sorted(packing.pack(copies, length=64).filter("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(a.doc_id % 5 != b.doc_id % 5 for a, b in zip(order, order[1:])) == 4


# --- token alignment ------------------------------------------------------------------------


def test_both_libraries_give_the_same_ids(words):
    """Every code point, between letters, digits, spaces, marks and apostrophes."""
    own = byte_tokens.tokenizer(byte_tokens.default_tokenizer())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a 1{c}1 {c}{c} !{c}! '{c}s  {c} {c}'x " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    want = words.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.array_equal(a.ids, b) for a, b in zip(want, own.encode(texts, plain=False)))
    special = "a<|endoftext|> b"
    assert own.encode([special], plain=False)[0].tolist() == words.encode(special, add_special_tokens=False).ids
    assert b"".join(own.token_bytes[i] for i in own.encode([special], plain=True)[0]) == special.encode()


def alignments(rows, words):
    """Groups between common ends, by walking both lists of ends."""
    model, letters = pretokens.processor(pretokens.default_model()), byte_tokens.byte_letters()
    words.encode_special_tokens = True
    out = []
    for doc, text in rows:
        a = words.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in words.id_to_token(i)) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        spelled_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if text and not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(t) for t in s]).tolist() for s in (spelled_a, spelled_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = i, j
            while i < len(a) and ends_a[i] <= cut:
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                j += 1
            groups.append((a[k:i], b[m:j]))
        out.append((doc, len(a), len(b), groups))
    words.encode_special_tokens = False
    return out


def wanted(rows, words):
    found = alignments(rows, words)
    links = [Counter() for _ in found]
    counts = Counter()
    for own, (_, _, _, groups) in zip(links, found):
        for x, y in groups:
            for p, m in Counter(x).items():
                for q, n in Counter(y).items():
                    own[p, q] += m * n
        counts.update(own.keys())
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    for own, (doc, a, b, groups) in zip(links, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc, a, b, len(groups), sum(own.values()), sum(n for k, n in own.items() if counts[k] == best[k[0]]),
               sum(n * counts[k] for k, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if a else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_whole_table(spark, sf, words):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"](spark, sf)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(wanted(rows, words))


@pytest.mark.parametrize("frequent,links", [(500_000, 1 << 20), (50, 3), (0, 64)])
def test_alignment_without_the_table_and_in_blocks(spark, docs, words, monkeypatch, frequent, links):
    """Pairs beside the table are joined, large groups counted by distinct ids: the same results."""
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    rows = [tuple(r) for r in docs.filter("doc_id is null or doc_id < 60").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    path_a, path_b = byte_tokens.default_tokenizer(), pretokens.default_model()
    key = lambda r: (str(r[0]), r)
    got = [tuple(r) for r in token_alignment.score(frame, keep=("doc_id", "n_a")).select(*COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(wanted(rows, words), key=key)
    if links < 1 << 20:
        block = token_alignment._blocks(__import__("pyarrow").array([t for _, t in rows]), path_a, path_b)
        whole = token_alignment.linked_pairs(block, 32_000)
        monkeypatch.setattr(token_alignment, "LINKS", links)
        assert all(np.array_equal(x, y) for x, y in zip(whole, token_alignment.linked_pairs(block, 32_000)))


def test_aligned_groups_and_empty_tables(spark, docs, words):
    rows = [tuple(r) for r in docs.filter("doc_id is null or doc_id < 20").collect()]
    want = Counter(str(r) for r in alignments(rows, words))
    got = Counter()
    for r in token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b, groups = list(r.a_ids), list(r.b_ids), []
        for x, y in zip(r.a_sizes, r.b_sizes):
            groups.append((a[:x], b[:y]))
            a, b = a[x:], b[y:]
        got[str((r.doc_id, len(r.a_ids), len(r.b_ids), groups))] += 1
    assert got == want
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5000")
    try:
        assert token_alignment.score(docs.limit(0)).count() == token_alignment.align(docs.limit(0)).count() == 0
        assert spark.conf.get(name) == "5000"
    finally:
        spark.conf.set(name, before)
