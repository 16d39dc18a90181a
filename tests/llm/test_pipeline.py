"""Stages on the small tables, each against the operator's own brute-force twin or its contract."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redactflow.session import cut_lineage
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_near_copies import plain_components
from tests.llm.test_pii import plain_spans

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], FOLDER), name))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert set(stages[0].columns) < set(stages[-1].columns)


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert not any(any(c.isalpha() for c in before[i]) for i in before.keys() - after.keys())


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(after) == set(plain_components(list(before.items())))


def test_no_benchmark_passage_is_left(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) == {i for i, _, n, _ in plain_hits(list(before.items()), items) if n == 0}


def test_no_personal_data_is_left(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, text in before.items():
        assert bool(plain_spans(text)) <= (after[i] != text)
        assert not plain_spans(after[i])


def test_mix(stages):
    mixed = stages[5]
    sizes = stages[4].select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    taken = mixed.agg(F.sum("taken")).first()[0]
    assert abs(taken - sizes) <= 21 and mixed.filter("taken > 3 * size or taken <= 0").isEmpty()


def test_hard_rows(spark):
    hard = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, 0), (None, "words words", "en", None, 11), (3, "words " * 100_000, "en", "b", 600_000), (4, "1 2 3", "fr", "b", 5)]
    docs = spark.createDataFrame(hard, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["_row", "label", "lang_pred", "score", "_n", "_id", "_key", "_first", "fp", "text_key", "_masked", "h_email", "size", "_extra", "_text"]
    docs = docs.withColumns({c: F.lit("mine") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER), name)
    left = docs.collect()
    assert {r["doc_id"] for r in left} == {3, None}
    assert all(r[c] == "mine" for r in left for c in clash if c != "size")
    none = docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        none = cut_lineage(stage(spark, none, FOLDER), name)
    assert none.count() == 0
