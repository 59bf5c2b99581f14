"""The pipeline's stages on small documents, against plain versions."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import queries
from tests.llm.test_operators import babble, near_roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [babble(rng, rng.randint(5, 120)) for _ in range(150)]
    toxic = set(range(0, 150, 5))
    for i in toxic:
        texts[i] += " numskull worthless"
    texts += [texts[1], texts[1].upper(), texts[2] + " and more words", None, "", texts[3]]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, toxic


def test_stages(spark, folder, tmp_path):
    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in docs.collect()]
    assert set(seen["toxicity"]) == set(range(len(texts))) - toxic
    left = {}
    for i in sorted(seen["toxicity"]):
        left[(texts[i] or "").lower()] = i
    assert sorted(seen["exact_dedup"]) == sorted(left.values())
    ids = sorted(left.values())
    _, roots = near_roots([texts[i] for i in ids])
    assert sorted(seen["near_dedup"]) == [ids[r] for r in sorted(set(roots))]
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(Counter(seen["mixing"]).values()) <= 3
    assert Counter(seen["packing"]) == Counter(seen["mixing"])
    again = corpus_pipeline.run(spark, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for table in ("documents", "labels"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) == {"op4_chat_format", "op6_exact_dedup", "op10_mix_sources"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
