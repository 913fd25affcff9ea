"""Toxicity: exact neighbours by brute force, held-out accuracy, calibration, defined cases."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrisk.llm import queries, toxicity
from callrisk.llm.arrays import offsets_of
from callrisk.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def random_vectors(rng, n, width, most):
    rows = [np.sort(rng.choice(width, rng.integers(0, most + 1), replace=False)) for _ in range(n)]
    flat = np.concatenate(rows).astype(np.int64)
    weight = rng.integers(1, 4, len(flat)).astype(float)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    length = np.sqrt(np.bincount(row, weight ** 2, n))
    return toxicity.Vectors(offsets_of(np.array([len(r) for r in rows])), flat, weight / np.where(length, length, 1)[row])


def dense(v, width):
    out = np.zeros((len(v.bounds) - 1, width))
    out[np.repeat(np.arange(len(out)), np.diff(v.bounds)), v.terms] = v.weights
    return out


@pytest.mark.parametrize("n,width,most", [(700, 40, 6), (130, 8, 3), (30, 5, 2), (1, 3, 2)])
def test_block_max_search_finds_every_neighbour_with_ties(n, width, most):
    rng = np.random.default_rng(n)
    examples, docs = random_vectors(rng, n, width, most), random_vectors(rng, 200, width, most)
    want = np.round(dense(docs, width) @ dense(examples, width).T, 9)
    k = min(toxicity.NEIGHBOURS, n)
    for skip in (None, rng.integers(0, n, 200)):
        if skip is not None:
            want[np.arange(200), skip] = 0
        found, least = toxicity.BlockIndex(examples, width).cosines(docs, skip)
        for row, value, limit in zip(want, found, least):
            kth = np.sort(row)[-k] if k == toxicity.NEIGHBOURS else 0.0
            assert abs(limit - kth) < 1e-8
            near = (row >= kth - 1e-9) & (row > 0)
            assert np.allclose(value[near], row[near], atol=2e-9) and ((value >= limit) & (value > 0))[near].all()


def test_far_blocks_are_not_measured():
    # examples of block b hold term b alone, documents hold one term: one block each is opened
    n, width = 64 * 30, 30
    bounds = np.arange(n + 1)
    examples = toxicity.Vectors(bounds, np.repeat(np.arange(width), 64), np.ones(n))
    docs = toxicity.Vectors(np.arange(31), np.arange(30), np.ones(30))
    index, opened = toxicity.BlockIndex(examples, width), []
    measure = index.block_cosines
    index.block_cosines = lambda d, rows, block: opened.extend(rows) or measure(d, rows, block)
    index.cosines(docs)
    assert sorted(opened) == list(range(30))


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, 300) / 30
    y = (rng.random(300) < x).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    assert abs(np.interp(x, at, value).mean() - y.mean()) < 0.05
    # every step is the mean of its rows: max-min formula of monotone regression
    levels = np.unique(x)
    for p in levels:
        fit = max(min(y[(x >= a) & (x <= b)].mean() for b in levels[levels >= p]) for a in levels[levels <= p])
        assert any(abs(fit - v) < 1e-9 for v in value)


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op13_toxicity"](spark, SF)
    rows = got.join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    caught = np.array([r.predicted for r in rows])
    assert caught[y == 1].mean() > 0.9 and caught[y == 0].mean() < 0.02
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert abs(s.mean() - y.mean()) < 0.03                                          # calibrated
    assert got.count() == read_table(spark, SF, "documents").count()


def test_scores_equal_a_plain_computation(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    examples = toxicity.examples_of(docs, labels, "toxic", None, "doc_id", "text", "doc_id")
    words = toxicity.vocabulary(examples)
    assert len(words) == toxicity.TERMS
    counts = toxicity.term_counts(docs, words, "doc_id", "text", ())
    model = toxicity.fit(examples, words, counts)
    rows = counts.select("id", "terms", "counts").collect()
    df = Counter(t for r in rows for t in r.terms)
    idf = {t: np.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(r):
        v = {t: (1 + np.log(c)) * idf[t] for t, c in zip(r.terms, r.counts)}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    vectors = {r.id: vector(r) for r in rows}
    label = dict(zip(model.ids, model.labels))
    got = {r.doc_id: r for r in toxicity.score(counts, model, "doc_id", ()).collect()}
    assert len(got) == len(rows) and len(label) <= toxicity.SAMPLE
    for i in sorted(vectors)[:150]:
        cosine = sorted(((round(sum(x * vectors[e].get(t, 0) for t, x in vectors[i].items()), 9), e) for e in label),
                        reverse=True)
        least = cosine[toxicity.NEIGHBOURS - 1][0]
        near = [(c, e) for c, e in cosine if c >= least - 1e-9 and c > 0]
        if not near:
            assert got[i].score == round(model.unknown, 6) and got[i].evidence == []
            continue
        vote = [(1 - min(c, 1) + toxicity.SOFT) ** -2 for c, _ in near]
        raw = sum(w * label[e] for w, (_, e) in zip(vote, near)) / sum(vote)
        assert abs(got[i].score - np.interp(raw, *model.steps)) < 1e-5
        assert abs(got[i].evidence[0].cosine - cosine[0][0]) < 1e-6
        assert all(label[e.id] == e.label for e in got[i].evidence)


def test_defined_cases(spark, edge, empty):
    for c in ("y", "rest", "terms", "counts", "body", "key", "h", "evidence", "held_out"):
        edge = edge.withColumn(c, F.lit("clash"))
    some = spark.createDataFrame([(5, 1), (5, 0), (8, 0), (9, 1), (12, None), (None, 0), (999, 0), (6, 1)],
                                 "doc_id long, toxic int")
    rows = toxicity.classify(edge, some, keep=("label", "terms")).collect()
    assert len(rows) == edge.count() and {(r.label, r.terms) for r in rows} == {("clash", "clash")}
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2, 3)}) == 1            # no text: one score
    assert {r.score for r in toxicity.classify(edge, some.where("false")).collect()} == {0.5}
    assert toxicity.classify(empty, some).count() == 0
    one = toxicity.classify(edge, some.where("toxic = 0 and doc_id <> 5")).collect()  # one class only
    assert {r.score for r in one} == {0.0}


def test_repeated_ids_stay_bounded(spark):
    """A labelled id that repeats many times is one example for each of its texts."""
    docs = spark.createDataFrame([(1, "you idiot")] * 500 + [(1, "other words")] + [(2, "fine words here")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.examples_of(docs, labels, "toxic", None, "doc_id", "text", "doc_id").count() == 3
