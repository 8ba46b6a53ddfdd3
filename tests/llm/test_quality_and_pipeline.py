"""The quality classifier on held-out rows, and the pipeline against its stages' plain forms."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SCHEMA, awkward, frame, prose, rows_of
from tests.llm.test_duplicates import norm, plain_near
from tsforge.llm import block_naming, odd_sketches, quality, queries
from tsforge.llm.common import table

SMALL = Path("/root/testdata/sf0.001")


def labelled(spark, n=300):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        text = prose(i, rnd.randint(5, 80))
        rows.append((i, text if good else " ".join(w + rnd.choice(["%%%", "###"]) for w in text.split())))
        labels.append((i, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    scored = quality.scored(docs, model).withColumn("held_out", quality.held_out())
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 30
    assert np.mean([(r["_score"] >= 0.3) == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["_score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 120)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.scored(docs, quality.train(docs, x)).select("doc_id", "_score") for x in (labels, flipped))
    assert rows_of(first) == rows_of(second)


def test_awkward_texts_and_labels(spark):
    docs = frame(spark)
    good, bad = spark.createDataFrame([(i, 1) for i in range(10, 30)], "doc_id long, quality int"), [(14, 0), (15, None), (16, 7), (None, 1), (999, 0)]
    for labels in (good, good.union(spark.createDataFrame(bad, good.schema)), good.limit(0)):
        model = quality.train(docs, labels)
        out = quality.scored(docs, model, score="own_score")
        assert out.columns == [*SCHEMA.names, "own_score"]
        assert out.filter("own_score between 0 and 1").count() == len(awkward())
        kept = quality.keep_good(docs, model)
        assert kept.columns == SCHEMA.names
        assert kept.filter("_Score = 'b'").count() == out.filter("own_score >= 0.3").count()
    assert quality.scored(frame(spark, []), quality.train(frame(spark, []), good), score="own_score").count() == 0


def test_descent_finds_the_separating_model():
    rnd = np.random.default_rng(3)
    rows = [np.flatnonzero(rnd.random(50) < 0.3).astype(np.int32) for _ in range(200)]
    labels = np.array([int(5 in r or 7 in r) for r in rows])
    values = [np.ones(len(r), np.float32) for r in rows]
    weights, bias = quality.dual_coordinate_descent(rows, values, labels, 50, 10.0, 200)
    assert np.mean([(weights[r].sum() + bias > 0) == y for r, y in zip(rows, labels)]) > 0.98


def test_features_do_not_depend_on_the_portions(monkeypatch):
    text = prose(2, 900)
    whole = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 100)
    assert quality.features(text).tolist() == whole.tolist()
    assert len(quality.features("")) == 0 and len(quality.features(None)) == 0


def test_each_stage_on_awkward_rows(spark):
    docs = frame(spark)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, docs, str(SMALL))
    assert sorted(norm(r["text"]) for r in exact.collect()) == sorted({norm(t) for _, t in awkward()})
    near = stages["near_dedup"](spark, docs, str(SMALL))
    assert near.columns == docs.columns
    spans = stages["passage_dedup"](spark, docs, str(SMALL))
    assert spans.columns == docs.columns
    packed = stages["packing"](spark, docs, str(SMALL))
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in awkward()}


def test_pipeline_stages_match_plain_versions(spark):
    """On the given documents, stage by stage."""
    docs = table(spark, str(SMALL), "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, str(SMALL)).cache()
    model = quality.train(docs, table(spark, str(SMALL), "labels"))
    expected = quality.scored(docs, model).filter("_score >= 0.3").select("doc_id")
    assert rows_of(good.select("doc_id")) == rows_of(expected)
    exact = stages["exact_dedup"](spark, good, str(SMALL)).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(norm(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values())
    near = stages["near_dedup"](spark, exact, str(SMALL)).cache()
    rows = [(r["doc_id"], r["text"]) for r in exact.collect()]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(r[0] for r in plain_near(rows, 5) if r[3])
    spans = stages["passage_dedup"](spark, near, str(SMALL)).cache()
    assert {r["doc_id"] for r in spans.collect()} <= {r["doc_id"] for r in near.collect()}
    assert spans.columns == docs.columns and spans.filter("trim(text) = ''").count() == 0
    packed = stages["packing"](spark, spans, str(SMALL))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in spans.collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, str(SMALL)).count()
    source = {"op4_exact_topk": "embeddings", "op6_url_filter": "pages"}.get(name, "documents")
    n = table(spark, str(SMALL), source).count()
    assert rows == (5 * 10 if name == "op4_exact_topk" else n) or (name == "op2_best_fit_packing" and rows >= n)


def test_helpers_used_by_the_stages_exist():
    assert block_naming.keep_first and odd_sketches.keep_one
