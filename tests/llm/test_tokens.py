"""Token counts, the byte-level codec and token files against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import pytest
import regex

from callrisk.llm import bpe_codec, pretokens, queries, token_counts, token_files
from callrisk.llm.arrays import offsets_of

from .conftest import EDGE, rows_of


@pytest.fixture(params=["documents", "edge", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def key(i):
    return (i is not None, i or 0)


def test_splits_equal_the_patterns(vocab):
    import public_tokenizers

    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    whole = regex.compile(public_tokenizers.PATTERN)
    texts = [t or "" for t in EDGE] + ["''s 'sx  'll're", " 's\n's", "a\n\n b", "x'", "'", "  ", "1'd2"]
    joined = "".join(texts)
    points = pretokens.code_points(joined)
    head = np.zeros(len(points), bool)
    at = offsets_of(np.array([len(t) for t in texts]))[:-1]
    head[at[at < len(points)]] = True
    table = pretokens.classes("tiktoken")
    cut = [*np.flatnonzero(pretokens.byte_level_starts(points, head, table)).tolist(), len(points)]
    assert [joined[a:b] for a, b in zip(cut, cut[1:])] == [x for t in texts for x in whole.findall(t)]
    start, none = pretokens.word_starts(points, head, table)
    cut = [*np.flatnonzero(start).tolist(), len(points)]
    assert [joined[a:b] for a, b in zip(cut, cut[1:]) if not none[a]] == [x for t in texts for x in words.findall(t)]


def test_token_counts(table, vocab):
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table, path).collect())
    assert got == sorted((key(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                         for i, t in rows_of(table))


def test_merging_one_at_a_time_agrees(vocab):
    merges = token_counts.MergeTable(vocab("word_bpe_49k.json"))
    tokens = [t.encode() for t in ("a" * 100, "abab" * 20, "hello", "x", "ssssss")]
    assert merges.at_once
    fast = merges.counts(tokens)
    merges.at_once = False
    assert (merges.counts(tokens) == fast).all()


def test_codec(table, vocab):
    import base64

    import public_tokenizers
    import tiktoken

    path = vocab("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.codec_digest(bpe_codec.decode(bpe_codec.encode(table, path), path)).collect()
    want = []
    for i, t in rows_of(table):
        ids = library.encode_ordinary(t or "")
        want.append((key(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((key(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_one_stage_equals_encode_and_decode(table, vocab):
    path = vocab("byte_bpe_multi_50k.tiktoken")
    two, one = bpe_codec.decode(bpe_codec.encode(table, path), path), bpe_codec.transcode(table, path)
    assert one.schema == two.schema
    assert sorted((key(r.doc_id), *r[1:]) for r in one.collect()) == sorted((key(r.doc_id), *r[1:]) for r in two.collect())


def test_null_ids_decode_to_nothing(spark, vocab):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(bpe_codec.decode(df, vocab("byte_bpe_multi_50k.tiktoken")).first()["decoded"]) == b""


def test_token_files(table, vocab, spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocab("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = str(tmp_path / "files")
    token_files.write(table, folder, path, end_id=2)
    got = sorted((r.start, key(r.id), r.n_tokens, zlib.crc32(r.token_ids))
                 for r in token_files.read(spark, folder).collect())
    want, start = [], 0
    coded = sorted((key(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows_of(table))
    assert [g[1] for g in got] == [k for k, _ in coded]
    assert sorted(g[1:] for g in got) == sorted((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in coded)
    for g in got:
        assert g[0] == start
        start += g[2]


def test_one_document_is_read_by_its_index(documents, vocab, spark, tmp_path):
    path = vocab("byte_bpe_50k.json")
    folder = str(tmp_path / "files")
    token_files.write(documents, folder, path, end_id=2)
    every = {r.id: r for r in token_files.read(spark, folder).collect()}
    few = token_files.read(spark, folder, only=[3, 77]).collect()
    assert sorted(r.id for r in few) == [3, 77]
    assert all(every[r.id] == r for r in few)


@pytest.mark.parametrize("rows", [1, 2, 60, 1000])
def test_dictionary_at_every_size(vocab, spark, tmp_path, rows):
    """Every file set has a dictionary, frames need it, and reading checks its hash."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(rows)
    path, folder = vocab("byte_bpe_50k.json"), str(tmp_path / "files")
    body = token_files.train_dictionary(docs.selectExpr("doc_id AS id", "text"), path, 2)
    assert 0 < len(body) <= token_files.DICTIONARY_BYTES and (rows < 1000 or len(body) == token_files.DICTIONARY_BYTES)
    token_files.write(docs, folder, path, end_id=2)
    saved = spark.read.parquet(f"{folder}/dictionary").first()
    assert bytes(saved["body"]) == body and saved["hash"] == token_files.dictionary_hash(body)
    whole = {r.id: r.n_tokens for r in token_files.read(spark, folder).collect()}
    assert len(whole) == rows
    plain = sum(len(zstandard.ZstdCompressor(level=token_files.LEVEL).compress(bytes(r.token_ids)))
                for r in token_files.read(spark, folder).collect())
    packed = sum(len(r.frames) for r in spark.read.parquet(f"{folder}/segments").collect())
    assert packed < plain
    other = str(tmp_path / "other")
    spark.createDataFrame([(saved["hash"], bytearray(body + b"x"))], "hash long, body binary").write.parquet(f"{other}/dictionary")
    spark.read.parquet(f"{folder}/segments").write.parquet(f"{other}/segments")
    with pytest.raises(Exception, match="don't match the segment's hash"):
        token_files.read(spark, other).collect()
