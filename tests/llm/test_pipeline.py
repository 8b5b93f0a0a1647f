"""The pipeline's stages: the columns they keep, tables they must bear, and that each one's decisions hold."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda: "\n".join(" ".join(rng.choices(vocab, k=12)) + "." for _ in range(8))
    rows = [(i, text(), "en", f"s{i % 2}") for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(5)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, "#### $$$$ " * 40, "en", "s1"), (5, rows[5][1], "en", "s1")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out = corpus_pipeline.stage(out, f"test-{name}")
        if name != "sentencepiece":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen[name], docs = [r["doc_id"] for r in out.select("doc_id").collect()], out
    assert set(seen["quality_rules"]) == set(range(80)) | {200, 201, 202, 203, 204}
    assert sorted(seen["line_dedup"]) == sorted(seen["quality_rules"])
    assert sorted(seen["simhash_near_dedup"]) == list(range(80))
    assert set(seen["mixing"]) <= set(range(80))
    assert sorted(seen["sentencepiece"]) == sorted(seen["mixing"])
    assert docs.where("NOT parity OR NOT round_trip OR size(ids) <> n_tokens").count() == 0


def test_run_and_empty_input(spark, tmp_path, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
