"""Registered queries against SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumeline.llm import decontaminate
from plumeline.llm.queries import ORACLES, QUERIES

from ..conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert same_rows(spark, QUERIES, ORACLES, name) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "encode":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert kept[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert kept["lines"] == kept["quality"]
    assert kept["encode"] == kept["decontaminate"] < kept["near_dedup"] < kept["lines"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality"] for i in clean) >= 0.97 * len(clean)
    items = [r.text.encode() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {w for t in items for w in decontaminate.windows(decontaminate.match_words(t), 10)}
    for r in spark.read.parquet(str(tmp_path / "decontaminate")).collect():
        w = decontaminate.match_words(r.text.encode())
        assert not any(tuple(w[k : k + 10]) in found for k in range(len(w) - 9))
    texts = spark.read.parquet(str(tmp_path / "near_dedup"))
    assert texts.count() == texts.select(F.lower("text")).distinct().count()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept["encode"])


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_with_null_and_repeated_rows(spark, sf_dir):
    """Ids may be null or repeat, texts may be null; a stage neither loses nor multiplies rows."""
    own = " ".join(f"word{i}" for i in range(80))
    rows = [(None, own, None, None, None), (None, own + " end", "en", "s", 1), (5, None, "en", "s", 0), (5, "other text here, plain prose.", "en", "s", 9), (5, "other text here, plain prose.", "en", "s", 9), (7, "third. " * 40, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.lines(spark, docs, sf_dir).count() == 6
    assert corpus_pipeline.decontaminate(spark, docs, sf_dir).count() == 6
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == 6
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("5", ""), ("5", "other text here, plain prose."), ("7", "third. " * 40), ("None", kept[0].text if kept[0].doc_id is None else next(r.text for r in kept if r.doc_id is None))]
    scored = corpus_pipeline.quality(spark, docs, sf_dir)
    assert scored.count() <= 6 and tuple(scored.columns) == corpus_pipeline.COLUMNS
