"""The pipeline's stages against what each promises, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import pii

from . import brute

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
M = 1 << 60


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        given = before.collect()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 1").collect()}
            kept = {r.doc_id for r in rows[name]}
            # the smallest tables have few labels, some of them wrong
            assert len(kept & toxic) <= 0.3 * len(toxic) and len({r.doc_id for r in given} - kept - toxic) <= 0.1 * len(given)
        if name == "near_dedup":
            groups = brute.near_duplicates([(r.doc_id, r.text) for r in given])
            assert {r.doc_id for r in rows[name]} == {d for d, (_, c) in groups.items() if c == d}
        if name == "pii":
            was = {r.doc_id: r.text for r in given}
            assert len(rows[name]) == len(given)
            for r in rows[name]:
                assert r.text == pii.masked(was[r.doc_id], pii.find(was[r.doc_id], pii.train())[1]) and r.n_chars == len(r.text)
        if name == "mixing":
            assert {tuple(r) for r in rows[name]} <= {tuple(r) for r in given}
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["mixing"]}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, long texts, ids of several texts, and extra columns with clashing names."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    extra = "row", "key", "k", "copies", "_key", "words", "score"
    rows = [(None, None, None, None, None), (5 + M, None, None, None, None), (5 + M, "", "en", "s", 0), (7 + M, "one two three four five six", "en", "s", 27), (7 + M, "one two three four five six", "en", "s", 27)]
    rows += [(7 + M, "quite another text under one id", "en", None, 31), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (11 + M, "long words " * 30_000, "en", "s", 330_000)]
    odd = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    labels = f"{tmp_path}/labels.parquet"
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(labels)
    now, names = odd, odd.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"odd-{name}"))
        now = spark.read.parquet(str(tmp_path / f"odd-{name}"))
        counts[name] = now.count()
        if name != "packing":
            assert now.columns == names
        if name == "near_dedup":
            texts = [r.text for r in now.filter(F.col("doc_id") == 7 + M).collect()]
            assert sorted(texts) == ["one two three four five six", "quite another text under one id"]
            assert now.filter("doc_id is null").count() == 3
    assert counts["packing"] >= counts["mixing"] > 0
