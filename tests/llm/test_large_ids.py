"""Ids beyond 2 to the 53 beside null ones stay whole in every operator, and very long texts are read whole."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from convolake.llm import queries

IDS = [2**60 + 1, 2**60 + 3, 2**53 + 1, -(2**60) - 1, 50 * (2**54 + 1), None]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    words = " ".join(f"w{k} of line\n" if k % 7 == 0 else f"w{k}" for k in range(400))
    docs = [(d, f"{words} number{k} " + ("long " * 60_000 if k == 1 else ""), "en", f"s{k % 2}") for k, d in enumerate(IDS)]
    docs += [(k, f"text {k} of the {k % 4} kind with some words more", "en", "s0") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(d, k % 2, k % 2) for k, (d, *_) in enumerate(docs)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(d, [k / 7, 1.0, -k / 3], 0) for k, d in enumerate(IDS)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


BY_DOCUMENT = [n for n in queries.QUERIES if n.split("_")[0] not in ("op2", "op12", "op13")]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_ids_stay_whole(spark, sf_dir, name):
    got = Counter(r["doc_id"] for r in queries.QUERIES[name](spark, sf_dir).select("doc_id").collect())
    assert got == Counter([*IDS, *range(40)])


def test_vector_ids_stay_whole(spark, sf_dir):
    rows = queries.QUERIES["op2_threshold"](spark, sf_dir).collect()
    assert {r["query_id"] for r in rows} == {50 * (2**54 + 1)} and len(rows) >= 4
    assert {r["vec_id"] for r in rows} <= set(IDS) - {50 * (2**54 + 1)}


def test_the_pipelines_last_stage_keeps_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.tokens(spark, docs, sf_dir).collect())
    assert got == Counter([*IDS, *range(40)])
