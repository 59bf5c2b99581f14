"""Stages of the pipeline on tables whose own columns have the names used inside: values, not only names, come through."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import exact, minhash, mixing

NAMES = ["_size", "_sha", "_kept_id", "_cut", "_repeats", "_copy", "id", "sha", "row", "whole", "cut", "key", "node", "label", "band", "source_size",
         "_target", "doc id.x", "kept", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven"] * 3 + ["One two three four five six Seven", "other words stand here in a row", None, "", "single"]
    rows = [(i if i != 5 else None, t, "ab"[i % 2], *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)] + [(0, texts[0], "a", *(f"{n}0" for n in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("stage", [exact.distinct_texts, minhash.distinct_documents, mixing.repeated])
def test_rows_come_through_whole(docs, stage):
    known = {tuple(r) for r in docs.collect()}
    out = stage(docs)
    rows = out.collect()
    assert out.schema == docs.schema and rows and all(tuple(r) in known for r in rows)


def test_what_is_kept(docs):
    assert Counter(r["doc_id"] for r in exact.distinct_texts(docs).collect()) == Counter([3, 4, 6, 7])
    assert {r["doc_id"] for r in minhash.distinct_documents(docs).collect()} == {0, 4, None, 6, 7}
    sizes = {r["doc_id"]: r["_size"] for r in mixing.mix(docs).collect()}
    assert sizes == {0: 7, 1: 7, 2: 7, 3: 7, 4: 7, None: 0, 6: 0, 7: 1}
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns) | {"_source_size"} and dict(mixed.dtypes)["_size"] == "bigint"
    assert {r["_cut"] for r in mixed.collect()} == {f"_cut{i}" for i in range(8)}


def test_stages_on_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter(F.lit(False)), str(tmp_path)).collect() == []
