"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms describe how a text is written and what with: word shapes and pairs of neighbouring shapes (runs of
one character class count once), words equal to one of the few words before them, word lengths, and
hashed words.  A text is its vector of square-rooted relative term frequencies, weighted by idf.  The
latent space is the span of the leading singular vectors of the labelled sample's matrix.  Every document
is projected, its exact cosines with all labelled vectors are computed in blocks, and the ``NEIGHBOURS``
nearest ones (with all ties) vote with their label, weighted by a power of their similarity.

Learning uses a bounded sample (``SAMPLE`` labelled rows of least id hash, and at most ``SAMPLE`` texts of
them, of least hash of their terms); its vectors, the idf weights
and the basis are a few megabytes of fixed bound and travel to the tasks with the function.  Only text
enters a score.

Defined results: null and empty texts, and texts without any known term, get the sample's mean label;
without labelled rows every score is 0.5; rows of the sample whose label or text row is missing are left
out, repeated label rows each vote; repeated rows are scored each; extra columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, RangeHash, ascii_lower, mix, pieces, utf8, word_ranges
from .tasks import least_by_hash, map_arrow, texts, written

SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 40
POWER = 4
#: Rows of a dense term matrix.
ROWS = 1024
#: Hashed dimensions: shapes, shape pairs, repeats, lengths, words.
SHAPES, PAIRS, REPEATS, LENGTHS, WORDS = 256, 512, 8, 32, 512
WIDTH = SHAPES + PAIRS + REPEATS + LENGTHS + WORDS

#: Character class of each byte: lower (also multi-byte characters), upper, digit; others are themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 0x78
_CLASS[0x41:0x5B] = 0x58
_CLASS[0x30:0x3A] = 0x39


def term_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term frequencies (rows x WIDTH, float32): square roots of counts per word."""
    rows = len(offsets) - 1
    starts, ends, n = word_ranges(data, offsets, NOT_SPACE)
    out = np.zeros((rows, WIDTH), np.float32)
    if not len(starts):
        return out
    owner = np.repeat(np.arange(rows), n)
    kinds = _CLASS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[starts] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(fresh, out=place[1:])
    shape = RangeHash(kinds[fresh])(place[starts], place[ends])
    word = RangeHash(ascii_lower(data))(starts, ends)
    same_row = owner[1:] == owner[:-1]
    pair = mix(shape[1:] * np.uint64(0x9E3779B97F4A7C15) + shape[:-1])[same_row]
    repeat = np.zeros(len(word), np.int64)
    for back in range(REPEATS - 1, 0, -1):
        equal = np.zeros(len(word), bool)
        equal[back:] = (word[back:] == word[:-back]) & (owner[back:] == owner[:-back])
        repeat[equal] = back
    base, columns = 0, []
    for who, column, width in (
            (owner, shape % np.uint64(SHAPES), SHAPES),
            (owner[1:][same_row], pair % np.uint64(PAIRS), PAIRS),
            (owner, repeat, REPEATS),
            (owner, np.minimum(ends - starts, LENGTHS - 1), LENGTHS),
            (owner, word % np.uint64(WORDS), WORDS)):
        columns.append(who * WIDTH + base + column.astype(np.int64))
        base += width
    counts = np.bincount(np.concatenate(columns), minlength=rows * WIDTH).reshape(rows, WIDTH)
    return np.sqrt(counts / np.maximum(n, 1)[:, None]).astype(np.float32)


@dataclass
class Model:
    """Term weights, latent basis, labelled vectors of unit length and their labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        x = (terms * self.weight) @ self.basis
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-6)

    def scores(self, terms: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        x, out = self.project(terms), np.empty(len(terms))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(x), block):
            # rounded, so that the block a row happens to be in decides no tie
            cosine = np.round(x[a:a + block] @ self.vectors.T, 4)
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
            vote = np.where(cosine >= least[:, None], np.maximum(cosine, 0) ** POWER + 1e-9, 0.0).astype(np.float64)
            out[a:a + block] = np.round(vote @ self.labels / vote.sum(axis=1), 6)
        return np.clip(out, 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Model:
    """Learn from at most ``SAMPLE`` labelled rows; ``train``: condition on the label table's rows."""
    rows = labels.where(F.col(label_id).isNotNull() & F.col(label).isNotNull())
    if train is not None:
        rows = rows.where(train)
    docs = texts(df, id_col, text_col)
    known = written(rows.select(F.col(label_id).alias("id"), F.col(label).cast("double").alias("y"))
                    .join(docs.select("id"), "id", "left_semi"), "labelled")
    sample = least_by_hash(known, "id", SAMPLE).drop("hash")  # the documented bound

    def run(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in _parts(offsets):
            terms = term_matrix(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield {"y": batch.column(2).slice(a, b - a), "x": [r.astype(np.float16).tobytes() for r in terms]}

    pairs = docs.join(F.broadcast(sample), "id").select("id", "text", "y")
    terms = map_arrow(pairs, run, [("y", "double"), ("x", "binary")])
    # an id that repeats has a row for each of its texts: the bound holds for the rows too
    found = least_by_hash(written(terms, "labelled-terms"), "x", SAMPLE).drop("hash").toArrow()
    y = found.column("y").to_numpy()
    raw = b"".join(found.column("x").to_pylist())
    x = np.frombuffer(raw, np.float16).reshape(len(y), WIDTH).astype(np.float32)
    order = np.lexsort((y, [hash_of(r) for r in x]))
    x, y = x[order], y[order]
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.5
    x = x * weight
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    model = Model(weight, basis, np.zeros((0, DIMENSIONS), np.float32), y)
    model.vectors = model.project(x / weight)
    return model


def _parts(offsets: np.ndarray):
    """Pieces of bounded size that have at most ROWS rows: short texts would make wide matrices."""
    for a, b in pieces(offsets):
        for x in range(a, b, ROWS):
            yield x, min(x + ROWS, b)


def hash_of(row: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(row.tobytes()) >> 1


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, the columns named in ``keep``) for every row; one pass without a shuffle."""
    rest = [F.col(c) for c in keep]
    texts(df, id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                     F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))

    def run(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in _parts(offsets):
            terms = term_matrix(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield {"id": batch.column(0).slice(a, b - a), "score": model.scores(terms),
                   "rest": batch.column(2).slice(a, b - a)}

    scored = map_arrow(rows, run, [("id", rows.schema["id"].dataType), ("score", "double"),
                                   ("rest", rows.schema["rest"].dataType)])
    return scored.select(F.col("id").alias(id_col), "score", *[F.col("rest")[c].alias(c) for c in keep])
