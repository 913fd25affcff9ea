"""Each stage against brute force on what the stage before kept."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from callrisk.llm import knn_quality, queries
from callrisk.sources.tables import read_table

from .conftest import SF
from .test_inverted_index import brute as contamination
from .test_line_dedup import keys
from .test_simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
        out[-1].count()
    return out


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:5])


def test_quality(stages, spark):
    model = queries.quality_model(stages[0], read_table(spark, SF, "labels"))
    good = {r.doc_id for r in knn_quality.score(stages[0], model).where("score >= 0.3").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == good and all(after[i] == before[i] for i in after)
    assert 0 < len(after) < len(before)


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    owner = {}
    for i in sorted(before):
        for _, k in keys(before[i].text):
            if len(k) >= 10:
                owner.setdefault(k, i)
    assert set(before) == set(after)
    for i, r in before.items():
        kept = "\n".join(x for x, k in keys(r.text) if owner.get(k, i) == i)
        assert after[i].text == kept and after[i].n_chars == len(kept)
        assert (after[i].lang, after[i].source) == (r.lang, r.source)


def test_near_duplicates(stages):
    before, after = rows(stages[2]), rows(stages[3])
    fps = {i: fingerprint(r.text) for i, r in before.items()}
    left, firsts = set(before), set()
    while left:
        group, queue = set(), [min(left)]
        while queue:
            i = queue.pop()
            if i not in group:
                group.add(i)
                queue += [j for j in left - group if (fps[i] ^ fps[j]).bit_count() <= 4]
        firsts.add(min(group))
        left -= group
    assert set(after) == firsts and all(after[i] == before[i] for i in after)


def test_decontamination(stages, spark):
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    clean = {i for i, _, hit, _ in contamination([(i, r.text) for i, r in before.items()], items) if not hit}
    assert set(after) == clean and all(after[i] == before[i] for i in after)


def test_encoding(stages, vocab):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = rows(stages[4]), rows(stages[5])
    assert set(before) == set(after)
    for i, r in after.items():
        text = before[i].text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_stages(stages, spark):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(map(tuple, stages[5].drop("ids").collect()))


def test_edges_and_empty(edge, empty, spark):
    for df in (edge.select("doc_id", "text").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "5L AS n_chars"),
               empty.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "5L AS n_chars")):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
            if name != "bpe":
                assert docs.columns == COLUMNS
            if name == "simhash":
                seen = [fingerprint(r.text) for r in docs.collect()]
                assert all((a ^ b).bit_count() > 4 for k, a in enumerate(seen) for b in seen[:k])


CLASHES = ("id", "n_tokens", "fp", "bucket", "shard", "ids", "start", "n_lines", "score", "label", "a", "b", "kept",
           "n_dropped", "row_number", "row", "rest", "key", "component_id", "n_hit", "n_words", "item_ids", "decoded",
           "none", "lost", "y", "h", "batch")


def test_clashing_columns_pass_every_stage(edge, spark):
    """Columns named like the operators' own neither stop a stage nor get lost, and change nothing."""
    plain = edge.select("doc_id", "text")
    for name in CLASHES:
        edge = edge.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        after, bare = stage(spark, edge, SF), stage(spark, plain, SF)
        if name == "bpe":
            assert sorted(map(str, after.collect())) == sorted(map(str, bare.collect()))
            continue
        assert after.columns == edge.columns
        rows = after.collect()
        assert all(r[c] == "clash" for r in rows for c in CLASHES)
        as_sent = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
        assert as_sent(rows) == as_sent(bare.collect())
        edge, plain = after.cache(), bare.cache()
