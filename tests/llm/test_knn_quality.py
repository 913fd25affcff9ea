"""Quality votes: held-out accuracy, defined cases, and votes against a plain computation."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from callrisk.llm import knn_quality, queries
from callrisk.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op3_quality"](spark, SF)
    labels = read_table(spark, SF, "labels")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    y = np.array([r.quality for r in rows])
    s = np.array([r.score for r in rows])
    better = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2
    assert better > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > max(y.mean(), 1 - y.mean())
    assert got.count() == read_table(spark, SF, "documents").count()
    for r in got.select("doc_id", "held_out").limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_edges_and_no_labels(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, 1), (12, None), (None, 0), (999, 0)], "doc_id long, quality int")
    model = knn_quality.fit(edge, labels)
    assert len(model.labels) == 4  # document 5 is there twice
    got = knn_quality.score(edge, model, keep=("label",)).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.label == "clash" for r in got)
    assert {r.score for r in got if r.doc_id in (0, 1, 2, 3)} == {round(float(np.mean(model.labels)), 6)}
    nothing = knn_quality.fit(edge, labels.where("false"))
    assert {r.score for r in knn_quality.score(edge, nothing).collect()} == {0.5}
    assert knn_quality.score(empty, model).count() == 0
    assert len(knn_quality.fit(empty, labels).labels) == 0


def test_votes_equal_a_plain_computation(documents, spark):
    labels = read_table(spark, "/root/testdata/sf0.001", "labels")
    model = queries.quality_model(documents, labels)
    got = {r.doc_id: r.score for r in knn_quality.score(documents, model).collect()}
    for r in documents.select("doc_id", "text").limit(20).collect():
        body = np.frombuffer(r.text.encode(), np.uint8)
        x = model.project(knn_quality.term_matrix(body, np.array([0, len(body)])))[0]
        cosine = sorted(((round(float(x @ v), 4), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        least = cosine[min(knn_quality.NEIGHBOURS, len(cosine)) - 1][0]
        votes = [(max(c, 0) ** knn_quality.POWER, y) for c, y in cosine if c >= least]
        assert abs(got[r.doc_id] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 0.02


def test_sample_is_bounded_where_a_labelled_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(knn_quality, "SAMPLE", 20)
    docs = spark.range(500).selectExpr("1L AS doc_id", "concat('word ', id % 100, ' text') AS text")
    labels = spark.createDataFrame([(1, 1)] * 3, "doc_id long, quality int")
    assert len(knn_quality.fit(docs, labels).labels) == 20
