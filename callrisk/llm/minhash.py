"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every shingle is hashed once; the hash picks one of ``BINS`` bins and competes for the bin's minimum.  An
empty bin copies a bin drawn by a hash of (bin, attempt), attempt after attempt until that bin is not
empty: the same draws for every document, so likeness survives.  The low ``BITS`` bits of each bin are
packed.  Bits agree by chance with probability 2 ** -BITS; the likeness estimate removes that bias.

Defined results: null text is empty text; a text without words has the empty fingerprint, alike (1.0) to
itself and to nothing else (0.0); fewer words than a shingle give one shingle of all; equal texts have
equal fingerprints; rows with equal ids follow each other in text-hash order, null ids come last; extra
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (NOT_SPACE, PIECE_BYTES, RangeHash, ascii_lower, mix, offsets_of, shingle_hashes, utf8,
                     word_ranges)
from .tasks import id_bounds, map_arrow, partitions, range_of, texts

BINS = 512
BITS = 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=4096)
def _draws(attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in one attempt."""
    seed = np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * attempt) + np.uint64(1)
    return (mix(seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


def sketch(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin (rows x BINS, uint8), and whether the row has any shingle."""
    rows = len(offsets) - 1
    body = ascii_lower(data)
    starts, ends, count = word_ranges(body, offsets, NOT_SPACE)
    hashes, n = shingle_hashes(RangeHash(body)(starts, ends), count, size)
    hashes = mix(hashes)
    bins = np.full(rows * BINS, _EMPTY)
    slot = np.repeat(np.arange(rows) * BINS, n) + (hashes >> np.uint64(55)).astype(np.int64)
    np.minimum.at(bins, slot, hashes & np.uint64((1 << 55) - 1))
    bins = bins.reshape(rows, BINS)
    some = n > 0
    filled = bins != _EMPTY
    alone = filled.sum(axis=1) == 1  # every draw ends in the one filled bin
    bins[alone] = bins[alone].min(axis=1, keepdims=True)
    r, b = np.nonzero(~filled & (some & ~alone)[:, None])
    attempt = 0
    while len(r):
        source = _draws(attempt)[b]
        good = filled[r, source]
        bins[r[good], b[good]] = bins[r[good], source[good]]
        r, b = r[~good], b[~good]
        attempt += 1
    # a bin's low bits come from its value and its number: copies of one value agree by chance in each
    # bin anew, not in all or none
    salted = bins ^ mix(np.arange(1, BINS + 1, dtype=np.uint64))
    return (mix(salted) & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, two bins a byte."""
    both = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(both, some.tolist())]


def unpacked(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    some = np.array([bool(f) for f in fingerprints])
    raw = np.frombuffer(bytes.fromhex("".join(f or "0" * BINS for f in fingerprints)), np.uint8)
    both = raw.reshape(len(fingerprints), BINS // 2)
    low = np.empty((len(fingerprints), BINS), np.uint8)
    low[:, 0::2], low[:, 1::2] = both >> 4, both & 15
    return low, some


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Share of agreeing bins without the agreement that chance gives, 0 to 1."""
    chance = 2.0 ** -BITS
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, share, (has_a == has_b).astype(float))


def fingerprints(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    def run(batch):
        data, offsets = utf8(batch.column(1))
        yield {id_col: batch.column(0), "fingerprint": packed(*sketch(data, offsets, shingle))}

    return map_arrow(texts(df, id_col, text_col), run,
                     [(id_col, df.schema[id_col].dataType), ("fingerprint", "string")])


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, ghost, range) sorted so that every document is followed by the next one in descending
    id order; after the last comes the first.

    Ids are cut into ranges, one task holds whole ranges, and the first document of a range is copied to
    the end of the range before it as a ghost.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select("id")
    bounds = id_bounds(ids, n)
    top = (ids.select("id", range_of(F.col("id"), bounds).alias("range"))
           .groupBy("range").agg(F.max("id").alias("head")).orderBy("range").collect())
    heads = [(r["range"], above["range"], r["head"]) for r, above in zip(top, [*top[1:], *top[:1]])]
    kind = docs.schema["id"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(heads, f"range int, above int, head {kind}"))  # a row per range
    copies = F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")),
                     F.struct(F.col("above").alias("range"), F.lit(True).alias("ghost")))
    own = F.slice(copies, F.lit(1), F.when(F.col("id").eqNullSafe(F.col("head")), 2).otherwise(1))
    return (docs.withColumn("range", range_of(F.col("id"), bounds)).join(table, "range")
            .select("id", "text", F.explode(own).alias("at")).select("id", "text", "at.range", "at.ghost")
            .withColumn("tie", F.xxhash64("text"))
            .repartition(n, "range")
            .sortWithinPartitions("range", "ghost", F.desc_nulls_last("id"), "tie", "text")
            .select("id", "text", "ghost", "range"))


def _edited(text: str, other: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + other[:cut]


def edited_fingerprints(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
                        ) -> DataFrame:
    """Fingerprints of every row's text and of its edited text: the last third of the code points
    replaced by as many from the start of the next document in descending id order."""
    docs = texts(df, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    schema = (f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, "
              "fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def piece(rows):
        """Rows of a piece; the last one only serves as the next of the one before it."""
        ids, plain, _, _ = zip(*rows)
        edit = [_edited(a, b).encode() for a, b in zip(plain, plain[1:])]
        body = [t.encode() for t in plain] + edit
        low, some = sketch(np.frombuffer(b"".join(body), np.uint8),
                           offsets_of(np.fromiter(map(len, body), np.int64, len(body))), shingle)
        real = [k for k in range(len(rows) - 1) if not rows[k][2]]
        own, nxt, new = np.array(real), np.array(real) + 1, np.array(real) + len(rows)
        return [ids[k] for k in real], [len(plain[k]) for k in real], \
            [hashlib.sha256(edit[k]).hexdigest() for k in real], packed(low[own], some[own]), \
            packed(low[new], some[new]), likeness(low[own], some[own], low[new], some[new]), \
            likeness(low[own], some[own], low[nxt], some[nxt])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # the first ghost closes its range, the others and the next range start anew
                held.append(row)
                size += len(row[1])
                if row[2] or size >= PIECE_BYTES // 2:
                    yield from made(held, batch)
                    held, size = [row], len(row[1])
        yield from made(held, batch) if held else ()

    def made(held, batch):
        if any(not r[2] for r in held[:-1]):
            i, n, sha, a, b, x, y = piece(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, batch.schema.field(0).type), pa.array(n, pa.int64()), pa.array(sha), pa.array(a),
                 pa.array(b), pa.array(x), pa.array(y)],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next"])

    return with_next(docs).mapInArrow(run, schema)
