"""The pipeline's stages on the small tables and on awkward rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from glossweave.llm import decontaminate, quality_rules, simhash
from glossweave.llm.common import saved, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, docs, sf), "t")
        out.append(docs)
    return out


def test_each_stage_takes_effect(spark, sf, stages):
    before, rules, lines, near, clean, coded = stages
    kept = quality_rules.quality(before, ["doc_id"]).filter("kept").select("doc_id")
    assert {r.doc_id for r in rules.collect()} == {r.doc_id for r in kept.collect()}
    for frame in (rules, lines, near, clean):
        assert frame.columns == cp.COLUMNS
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0
    groups = simhash.near_duplicates(lines).select("component_id").distinct().count()
    assert near.count() == groups
    found = decontaminate.find_benchmark(near, table(spark, sf, "benchmark"))
    assert clean.count() == found.filter("found.hits = 0").count() < near.count()
    assert coded.count() == clean.count() and coded.filter("not round_trip").count() == 0
    assert cp.run(spark, sf).count() == coded.count()


def test_awkward_rows(spark, sf):
    body = " ".join(f"unlikely{k} words{k * 7}" for k in range(60))
    rows = [(1, body, "en", "s", 1, "x"), (1, body, "en", "s", 1, "x"), (2, body, None, None, None, "x"), (None, body + " more", "en", "s", 5, "x"),
            (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _first string"
    for docs, want in ((spark.createDataFrame(rows, schema), [None, 1, 1]), (spark.createDataFrame([], schema), [])):
        for name, stage in cp.STAGES:
            docs = saved(stage(spark, docs, sf), "t")
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: x or 0) == want


def test_queries_equal_sql(spark, sf):
    from checks.compare import compare, connect
    from glossweave.llm.queries import ORACLE, QUERIES

    con = connect(sf)
    for name, sql in ORACLE.items():
        assert compare(spark, con, sf, name, QUERIES[name], sql).startswith("ok"), name
