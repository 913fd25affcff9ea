"""Token-id files: one zstandard frame per document under a shared dictionary.

A file set has two Parquet tables: ``dictionary`` (hash, bytes) and ``segments``.  A segment holds some
documents in ascending id order: their ids, an index of frame offsets, the frames back to back, the token
counts and the hash of the dictionary that reads them.  A short document is read by its index entry
alone.  The dictionary is trained on the whole serialised id arrays of a bounded sample: the
``SAMPLE_DOCUMENTS`` rows of least id hash among the documents of at most ``SAMPLE_CHARACTERS`` (short ones
are what a dictionary helps).  It has ``DICTIONARY_BYTES``, or an eighth of the sample where that is less; a
sample that the trainer finds too small is itself the dictionary (raw content).

Ids are stored with 2 bytes where the vocabulary allows, else 4.  Documents go to range buckets of the
document id, whose bounds come from a sort of the id column alone; within a bucket they are sorted and
packed, so no text is shuffled, only compressed frames.

Defined results: null text is empty text and has the end id alone; null ids sort first; repeated ids are
kept as documents of their own, ordered by token count and frame; extra columns are left out; an empty
table gives an empty file set.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .arrays import bound_batches, offsets_of, pieces, ragged_index, utf8
from .tasks import id_bounds, least_by_hash, map_arrow, partitions, texts

SAMPLE_DOCUMENTS = 400
SAMPLE_CHARACTERS = 8_000
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 256 << 10
LEVEL = 3


class Encoder:
    """Whole-text ids of a byte-level tokenizers file, through its own model pre-token by pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content.encode(): i for i, t in added.items()}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = pretokens.classes("tokenizers")
        self.characters = dict(enumerate(pretokens.byte_characters()))
        self.pool = pretokens.TokenPool(self._encode)

    def _encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        model, characters, special = self.tokenizer.model, self.characters, self.special
        return pretokens.concatenated(
            [[special[t]] if t in special else
             [x.id for x in model.tokenize(t.decode("latin-1").translate(characters))] for t in tokens])

    def rows(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by the end id, concatenated; ids per row."""
        piece = pretokens.Piece(data, offsets, self.table, list(self.special))
        entry = self.pool.lookup(piece.tokens)[piece.which] if len(piece.which) else piece.which
        size = np.diff(self.pool.offsets)[entry]
        count = np.bincount(piece.row, size, piece.rows).astype(np.int64)
        ids = np.full(int(count.sum()) + piece.rows, end, np.int64)
        inner = np.ones(len(ids), bool)
        inner[offsets_of(count + 1)[1:] - 1] = False
        ids[inner] = self.pool.flat[ragged_index(self.pool.offsets[entry], size)]
        return ids, count + 1


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _dtype(vocabulary: int):
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def dictionary_hash(body: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(body) & 0x7FFFFFFFFFFFFFFF


def train_dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """Dictionary from the serialised ids of a bounded sample; empty where no document is short."""
    import zstandard

    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARACTERS)
    least = least_by_hash(short, "id", SAMPLE_DOCUMENTS).select("text")
    rows = sorted((r[0] or "").encode() for r in least.collect())
    encoder = _encoder(tokenizer)
    ids, count = encoder.rows(np.frombuffer(b"".join(rows), np.uint8),
                              offsets_of(np.fromiter(map(len, rows), np.int64, len(rows))), end)
    kind = _dtype(encoder.size)
    samples = [x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(count)[:-1])] if rows else []
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too few bytes to train on
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encode every row of ``df`` and write the file set to ``folder`` (any store Spark writes)."""
    import zstandard

    spark = df.sparkSession
    docs = texts(df, id_col, text_col)
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = dictionary_hash(dictionary)
    n = partitions(spark)
    bounds = id_bounds(docs, n)
    kind = df.schema[id_col].dataType.simpleString()

    def compress(batch):
        encoder = _encoder(tokenizer)
        width = _dtype(encoder.size)
        squeeze = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_dict_id=False).compress
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            ids, count = encoder.rows(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], end_id)
            raw = ids.astype(width).tobytes()
            at = (offsets_of(count) * width.itemsize).tolist()
            own = batch.column(0).slice(a, b - a)
            yield {"bucket": pa.array([-1 if x is None else bisect_right(bounds, x) for x in own.to_pylist()],
                                      pa.int64()),
                   "id": own, "n_tokens": count, "frame": [squeeze(raw[x:y]) for x, y in zip(at, at[1:])]}

    frames = map_arrow(docs, compress, [("bucket", "long"), ("id", kind), ("n_tokens", "long"),
                                        ("frame", "binary")])
    ordered = (frames.repartition(n, "bucket")
               .sortWithinPartitions("bucket", "id", "n_tokens", "frame"))
    ordered.mapInArrow(_packer(digest), f"bucket long, seq long, start long, n_tokens long, dictionary long, "
                       f"ids array<{kind}>, counts array<long>, index array<long>, frames binary"
                       ).write.parquet(f"{folder}/segments")
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash long, body binary").coalesce(1) \
        .write.parquet(f"{folder}/dictionary")


def _packer(digest: int):
    """Sorted frames to segments: a new one at each bucket and after SEGMENT_BYTES of frames."""
    def run(batches):
        bucket, seq, start = None, 0, 0
        ids, counts, frames, size = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_pylist([{
                "bucket": bucket, "seq": seq, "start": start, "n_tokens": sum(counts), "dictionary": digest,
                "ids": ids, "counts": counts, "index": offsets_of(np.fromiter(map(len, frames), np.int64,
                                                                             len(frames))).tolist(),
                "frames": b"".join(frames)}], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                many = pa.list_(pa.int64())
                schema = pa.schema([("bucket", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()),
                                    ("n_tokens", pa.int64()), ("dictionary", pa.int64()),
                                    ("ids", pa.list_(batch.schema.field("id").type)), ("counts", many),
                                    ("index", many), ("frames", pa.binary())])
            for b, i, c, f in zip(*(x.to_pylist() for x in batch.columns)):
                if frames and (b != bucket or size >= SEGMENT_BYTES):
                    yield segment()
                    seq, start = seq + 1, start + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
                if b != bucket:
                    bucket, seq, start = b, 0, 0
                ids.append(i)
                counts.append(c)
                frames.append(f)
                size += len(f)
        if frames:
            yield segment()

    return run


def read(spark: SparkSession, folder: str, only: list | None = None) -> DataFrame:
    """(id, start, n_tokens, ids binary little-endian uint32) of every document of the file set, or of
    the documents named in ``only``: then just their frames are decompressed."""
    import zstandard

    bound_batches(spark, 64)
    segments = spark.read.parquet(f"{folder}/segments")
    kind = segments.schema["ids"].dataType.elementType
    known = {r["hash"]: bytes(r["body"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    bases, at = {}, 0
    for r in sorted(segments.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()):
        bases[r["bucket"]], at = at, at + r["n"]
    chosen = None if only is None else set(only)
    if chosen is not None:
        segments = segments.where(F.arrays_overlap("ids", F.array(*map(F.lit, only))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body = known[row["dictionary"]]
                if dictionary_hash(body) != row["dictionary"]:
                    raise ValueError("the dictionary's bytes don't match the segment's hash")
                expand = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(body) if body else None).decompress
                starts = (bases[row["bucket"]] + row["start"] + offsets_of(np.array(row["counts"], np.int64))).tolist()
                ids, first, count, out = [], [], [], []
                for k, (i, c) in enumerate(zip(row["ids"], row["counts"])):
                    if chosen is None or i in chosen:
                        raw = expand(row["frames"][row["index"][k]:row["index"][k + 1]])
                        ids.append(i)
                        first.append(starts[k])
                        count.append(c)
                        out.append(np.frombuffer(raw, f"<u{len(raw) // c}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(first, pa.int64()),
                     pa.array(count, pa.int64()), pa.array(out, pa.binary())],
                    names=["id", "start", "n_tokens", "token_ids"])

    return segments.mapInArrow(run, f"id {kind.simpleString()}, start long, n_tokens long, token_ids binary")
