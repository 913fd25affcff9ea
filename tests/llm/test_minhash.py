"""One-permutation MinHash: estimates against true likeness, and the edited texts."""

import hashlib
import random

import numpy as np

from callrisk.llm import minhash, queries
from callrisk.llm.arrays import offsets_of

from .conftest import rows_of


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def sketches(texts):
    body = [t.encode() for t in texts]
    return minhash.sketch(np.frombuffer(b"".join(body), np.uint8),
                          offsets_of(np.array([len(b) for b in body])), 5)


def test_estimates_without_bias_also_for_few_shingles():
    rng = random.Random(3)
    errors, far = [], []
    for n in (8, 60, 3000):
        for _ in range(40):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = a[:n * 2 // 3] + [f"w{rng.randrange(10**6)}" for _ in range(n - n * 2 // 3)]
            c = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts = [" ".join(x) for x in (a, b, c)]
            low, some = sketches(texts)
            errors.append(minhash.likeness(low[:1], some[:1], low[1:2], some[1:2])[0] - jaccard(*texts[:2]))
            far.append(minhash.likeness(low[:1], some[:1], low[2:], some[2:])[0])
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors[40:]).max() < 0.15 and np.mean(far) < 0.03


def test_packing_round_trip_and_empty_texts():
    low, some = sketches(["a b c d e f", "", "x"])
    prints = minhash.packed(low, some)
    again, has = minhash.unpacked(prints)
    assert prints[1] == "" and has.tolist() == [True, False, True]
    assert (again[has] == low[has]).all()
    assert minhash.likeness(low[[1, 1]], some[[1, 1]], low[[1, 0]], some[[1, 0]]).tolist() == [1.0, 0.0]


def check(df, got):
    rows = sorted(((i, t or "") for i, t in rows_of(df)), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    by = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        by.setdefault(i, []).append((t, t[:len(t) - cut] + nxt[:cut], nxt))
    plain = {}
    assert len(got) == len(rows)
    for r in got:
        options = by[r.doc_id]
        if len(options) == 1:
            (t, edited, nxt), = options
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert plain.setdefault(t, r.fingerprint) == r.fingerprint
            assert abs(r.near_edited - jaccard(t, edited)) < 0.2
            assert abs(r.near_next - jaccard(t, nxt)) < 0.2


def test_documents(documents, spark):
    got = minhash.edited_fingerprints(documents).collect()
    check(documents, got)
    alone = {r.doc_id: r.fingerprint for r in minhash.fingerprints(documents).collect()}
    assert {r.doc_id: r.fingerprint for r in got} == alone


def test_edges(edge, empty, spark):
    check(edge, minhash.edited_fingerprints(edge).collect())
    assert minhash.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    check(one, minhash.edited_fingerprints(one).collect())


def test_query_columns(spark):
    from .conftest import SF
    df = queries.QUERIES["op7_minhash"](spark, SF)
    assert df.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                              "near_next"]
