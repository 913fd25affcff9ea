"""Toxicity scores by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their beginnings of ``PREFIXES`` bytes (one stem has many endings).  The
vocabulary holds the ``TERMS`` terms that tell toxic examples best (chi-squared; of terms in the very same
examples one is kept).  Term frequencies are dampened, idf counts all documents of the corpus.

The examples lie in an inverted index in blocks of ``BLOCK``: postings by (block, term), and the greatest
weight of every term in every block.  For a document the block maxima give the greatest cosine any example
of a block may have; blocks are taken in the order of that bound, their postings give the exact cosines, and
a document is done when the next bound is below its ``NEIGHBOURS``-th best cosine (inclusive, so that ties
are all found).  The neighbours vote, weighted by their distance; isotonic regression on the examples' own
votes, each without itself, turns votes into calibrated scores; the nearest examples are the evidence.

Learning uses at most ``SAMPLE`` labelled texts (least hashes of id and text).  Only text enters a score.
One pass reads the texts; term counts per document stay in the shared folder for the idf and the scores.

Defined results: null and empty texts, and texts without a known term, get the calibrated share of such
examples; without labelled texts every score is 0.5; an id with several labels has the greatest; an id with
several texts is an example with each; labels without a text are left out; repeated rows are scored each;
named extra columns are carried along, others left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import WORD_BYTE, RangeHash, ascii_lower, mix, offsets_of, pieces, ragged_index, utf8, word_ranges
from .tasks import least_by_hash, map_arrow, texts, written

SAMPLE = 4000
TERMS = 256
LEAST_EXAMPLES = 5
PREFIXES = (4, 5, 6, 7, 8)
NEIGHBOURS = 40
#: A neighbour at cosine distance d votes with (d + SOFT) ** -2.
SOFT = 0.2
BLOCK = 64
EVIDENCE = 5
#: Documents searched side by side.
ROWS = 512


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the rows, and the row of each."""
    data = ascii_lower(data)
    starts, ends, n = word_ranges(data, offsets, WORD_BYTE)
    row, value = np.repeat(np.arange(len(n)), n), RangeHash(data)
    hashes, rows = [value(starts, ends)], [row]
    for size in PREFIXES:
        long = ends - starts > size
        hashes.append(mix(value(starts[long], starts[long] + size) + np.uint64(size)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def by_piece(column: pa.Array):
    """(first row, end row, term hashes, rows of the piece) of each piece of a text column."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        yield (a, b, *terms_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))


def examples_of(df: DataFrame, labels: DataFrame, label: str, train: Column | None, id_col: str, text_col: str,
                label_id: str) -> DataFrame:
    """(id, text, y): at most SAMPLE labelled texts, written to the shared folder."""
    rows = labels.where(F.col(label_id).isNotNull() & F.col(label).isNotNull())
    if train is not None:
        rows = rows.where(train)
    known = rows.groupBy(F.col(label_id).alias("id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    docs = texts(df, id_col, text_col).withColumn("body", F.xxhash64(F.coalesce("text", F.lit(""))))
    pairs = written(docs.select("id", "body").join(known, "id").distinct(), "labelled")
    sample = least_by_hash(pairs.withColumn("key", F.struct("id", "body")), "key", SAMPLE).drop("key", "hash")
    found = docs.join(F.broadcast(sample), ["id", "body"])  # at most SAMPLE rows: the documented bound
    return written(found.groupBy("id", "body").agg(F.min("text").alias("text"), F.max("y").alias("y")), "examples")


def vocabulary(examples: DataFrame) -> np.ndarray:
    """Hashes, in order, of the terms whose presence tells toxic examples best."""
    def run(batch):
        for a, b, hashes, rows in by_piece(batch.column(1)):
            pair = np.unique(np.stack([rows.astype(np.uint64), hashes]), axis=1)
            count = np.bincount(pair[0].astype(np.int64), minlength=b - a)
            yield {"id": batch.column(0).slice(a, b - a), "y": batch.column(2).slice(a, b - a),
                   "terms": pa.ListArray.from_arrays(pa.array(offsets_of(count).astype(np.int32)),
                                                     pa.array(pair[1].astype(np.int64)))}

    n, toxic = examples.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return np.zeros(0, np.uint64)
    rows = map_arrow(examples.select("id", "text", "y"), run,
                     [("id", examples.schema["id"].dataType), ("y", "double"), ("terms", "array<long>")])
    c, t = F.col("c"), F.col("t")
    expected = c * F.lit(toxic / n)
    chi = (t - expected) ** 2 / (expected * F.lit(1 - toxic / n) * (1 - c / F.lit(n + 1.0)))
    counted = (rows.select("y", F.xxhash64("id").alias("h"), F.explode("terms").alias("term")).groupBy("term")
               .agg(F.count("*").alias("c"), F.sum("y").alias("t"), F.bit_xor("h").alias("where"))
               .where((c >= LEAST_EXAMPLES) & (t > expected)))
    best = (counted.groupBy("c", "t", "where").agg(F.min("term").alias("term")).withColumn("chi", chi)
            .orderBy(F.desc("chi"), "term").limit(TERMS))
    return np.sort(np.array([r["term"] for r in best.collect()], np.int64).astype(np.uint64))  # at most TERMS rows


def term_counts(df: DataFrame, words: np.ndarray, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(id, rest, terms array<int>, counts array<int>) of every row: places in ``words`` that occur."""
    texts(df, id_col, text_col)  # bounds the rows of a batch
    rest = F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))

    def run(batch):
        for a, b, hashes, owner in by_piece(batch.column(1)):
            at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
            cell, count = np.unique(owner[known] * len(words) + at[known], return_counts=True)
            row, term = np.divmod(cell, max(len(words), 1))
            bounds = pa.array(offsets_of(np.bincount(row, minlength=b - a)).astype(np.int32))
            yield {"id": batch.column(0).slice(a, b - a), "rest": batch.column(2).slice(a, b - a),
                   "terms": pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))),
                   "counts": pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32)))}

    return map_arrow(rows, run, [("id", rows.schema["id"].dataType), ("rest", rows.schema["rest"].dataType),
                                 ("terms", "array<int>"), ("counts", "array<int>")])


@dataclass
class Vectors:
    """Rows of terms and weights of unit length: bounds of the rows, terms, weights."""

    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, terms: pa.Array, counts: pa.Array, idf: np.ndarray) -> Vectors:
        bounds = offsets_of(terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        weight = (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * idf[flat]
        row = np.repeat(np.arange(len(terms)), np.diff(bounds))
        length = np.sqrt(np.bincount(row, weight ** 2, len(terms)))
        return cls(bounds, flat, weight / length[row])

    def part(self, a: int, b: int) -> Vectors:
        x, y = self.bounds[a], self.bounds[b]
        return Vectors(self.bounds[a:b + 1] - x, self.terms[x:y], self.weights[x:y])


class BlockIndex:
    """Inverted index of the examples in blocks, with the greatest weight of each term in each block."""

    def __init__(self, examples: Vectors, width: int):
        self.n, self.width = len(examples.bounds) - 1, width
        self.blocks = -(-self.n // BLOCK)
        row = np.repeat(np.arange(self.n), np.diff(examples.bounds))
        order = np.lexsort((row, examples.terms, row // BLOCK))
        self.example, self.weight = row[order], examples.weights[order]
        #: postings of (block, term) are first[block * width + term] up to the next entry
        self.first = offsets_of(np.bincount(self.example // BLOCK * width + examples.terms[order],
                                            minlength=self.blocks * width))
        self.most = np.zeros((width, self.blocks))
        np.maximum.at(self.most, (examples.terms, row // BLOCK), examples.weights)

    def block_cosines(self, docs: Vectors, rows: np.ndarray, block: int) -> np.ndarray:
        """Exact cosines (rows x BLOCK) of some documents with a block's examples, from its postings."""
        size = docs.bounds[rows + 1] - docs.bounds[rows]
        entry = ragged_index(docs.bounds[rows], size)
        cell = block * self.width + docs.terms[entry]
        count = self.first[cell + 1] - self.first[cell]
        posting = ragged_index(self.first[cell], count)
        place = np.repeat(np.repeat(np.arange(len(rows)), size), count) * BLOCK + self.example[posting] % BLOCK
        value = np.repeat(docs.weights[entry], count) * self.weight[posting]
        return np.bincount(place, value, len(rows) * BLOCK).reshape(len(rows), BLOCK)

    def cosines(self, docs: Vectors, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents x examples) exact cosines of every block a document needed, 0 elsewhere, and the
        NEIGHBOURS-th best of each document; ``skip``: an example left out for each document."""
        n = len(docs.bounds) - 1
        found = np.zeros((n, self.blocks * BLOCK))
        best = np.zeros((n, NEIGHBOURS))
        row = np.repeat(np.arange(n), np.diff(docs.bounds))
        dense = np.zeros((n, self.width))
        dense[row, docs.terms] = docs.weights
        limit = dense @ self.most + 1e-9  # rounding margin
        limit[limit <= 2e-9] = 0.0
        order = np.argsort(-limit, axis=1, kind="stable")
        for step in range(self.blocks):
            block = order[:, step]
            most = limit[np.arange(n), block]
            open_ = np.flatnonzero((most > 0) & (most >= best[:, 0]))
            if not len(open_):
                break
            for b in np.unique(block[open_]).tolist():
                rows = open_[block[open_] == b]
                value = np.round(self.block_cosines(docs, rows, b), 9)
                if skip is not None:
                    mine = np.flatnonzero(skip[rows] // BLOCK == b)
                    value[mine, skip[rows[mine]] % BLOCK] = 0.0
                found[rows, b * BLOCK:(b + 1) * BLOCK] = value
                both = np.concatenate([best[rows], value], axis=1)
                best[rows] = np.partition(both, BLOCK, axis=1)[:, BLOCK:]
                best[rows] = np.sort(best[rows], axis=1)
        return found[:, :self.n], best[:, 0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone regression of y on x: positions and values of its steps, for linear interpolation."""
    where, inverse = np.unique(x, return_inverse=True)
    stack: list[list[float]] = []  # weight, sum of y, sum of x
    for w, s, p in zip(np.bincount(inverse), np.bincount(inverse, y), where):
        stack.append([float(w), float(s), float(w * p)])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top)]
    return np.array([s[2] / s[0] for s in stack]), np.array([s[1] / s[0] for s in stack])


@dataclass
class Model:
    """Vocabulary, idf, the examples' index, labels and ids, and the calibration."""

    words: np.ndarray
    idf: np.ndarray
    index: BlockIndex
    labels: np.ndarray
    ids: list
    steps: tuple[np.ndarray, np.ndarray] = field(default=(np.zeros(1), np.zeros(1)))
    unknown: float = 0.5

    def votes(self, docs: Vectors, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Share of the votes for label 1 (NaN without a neighbour), and the cosines of the voters (else 0)."""
        cosine, least = self.index.cosines(docs, skip)
        cosine = np.where((cosine >= least[:, None]) & (cosine > 0), cosine, 0.0)
        weight = np.where(cosine > 0, (1 - np.minimum(cosine, 1) + SOFT) ** -2, 0.0)
        total = weight.sum(axis=1)
        return np.divide(weight @ self.labels, total, out=np.full(len(total), np.nan), where=total > 0), cosine

    def calibrate(self, examples: Vectors) -> None:
        """Learn the calibration from the examples' own votes, each without itself."""
        raw = np.concatenate([self.votes(examples.part(a, min(a + ROWS, self.index.n)),
                                         np.arange(a, min(a + ROWS, self.index.n)))[0]
                              for a in range(0, self.index.n, ROWS)])
        none = np.isnan(raw)
        self.unknown = float((self.labels[none].sum() + self.labels.mean()) / (none.sum() + 1))
        if not none.all():
            self.steps = isotonic(raw[~none], self.labels[~none])

    def scores(self, docs: Vectors) -> tuple[np.ndarray, list[list[dict]]]:
        """Calibrated scores and the evidence of each row: its nearest examples."""
        n = len(docs.bounds) - 1
        if not len(self.labels):
            return np.full(n, 0.5), [[] for _ in range(n)]
        score, evidence = np.full(n, self.unknown), [[] for _ in range(n)]
        known = np.flatnonzero(np.diff(docs.bounds) > 0)
        if len(known):
            sub = Vectors(np.append(docs.bounds[known], docs.bounds[-1]), docs.terms, docs.weights)
            raw, cosine = self.votes(sub)
            some = ~np.isnan(raw)
            score[known[some]] = np.interp(raw[some], *self.steps)
            nearest = np.argsort(-cosine, axis=1, kind="stable")[:, :EVIDENCE]
            for k, places in zip(known.tolist(), nearest):
                row = cosine[np.searchsorted(known, k)]
                evidence[k] = [{"id": self.ids[p], "label": float(self.labels[p]), "cosine": float(row[p])}
                               for p in places.tolist() if row[p] > 0]
        return np.round(np.clip(score, 0, 1), 6), evidence


def fit(examples: DataFrame, words: np.ndarray, counts: DataFrame) -> Model:
    """``counts``: the term counts of the whole corpus, whose document frequencies weigh the terms."""
    n = counts.count()
    per = {r["term"]: r["n"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term")
           .agg(F.count("*").alias("n")).collect()}  # at most TERMS rows
    idf = np.log((1 + n) / (1 + np.array([per.get(k, 0) for k in range(len(words))], np.float64))) + 1
    rows = term_counts(examples, words, "id", "text", ("y",)).withColumn("h", F.xxhash64("id", "terms", "counts"))
    found = rows.select("id", F.col("rest.y").alias("y"), "terms", "counts", "h").toArrow()  # at most SAMPLE rows
    # examples that share their main terms lie in the same blocks
    found = found.take(pa.array(np.argsort(found.column("h").to_numpy(), kind="stable")))
    first = [min(t) if t else -1 for t in found.column("terms").to_pylist()]
    found = found.take(pa.array(np.argsort(first, kind="stable"))).combine_chunks()
    terms, counts_ = (pa.concat_arrays(found.column(c).chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
                      for c in ("terms", "counts"))
    vectors = Vectors.of(terms, counts_, idf)
    model = Model(words, idf, BlockIndex(vectors, max(len(words), 1)), found.column("y").to_numpy(),
                  found.column("id").to_pylist())
    if len(model.labels):
        model.calibrate(vectors)
    return model


def score(counts: DataFrame, model: Model, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    kind = counts.schema["id"].dataType.simpleString()

    def run(batch):
        vectors = Vectors.of(batch.column(2), batch.column(3), model.idf)
        for a in range(0, batch.num_rows, ROWS):
            b = min(a + ROWS, batch.num_rows)
            value, evidence = model.scores(vectors.part(a, b))
            shape = pa.list_(pa.struct([("id", batch.column(0).type), ("label", pa.float64()), ("cosine", pa.float64())]))
            yield {"id": batch.column(0).slice(a, b - a), "rest": batch.column(1).slice(a, b - a), "score": value,
                   "evidence": pa.array(evidence, shape)}

    scored = map_arrow(counts.select("id", "rest", "terms", "counts"), run,
                       [("id", counts.schema["id"].dataType), ("rest", counts.schema["rest"].dataType),
                        ("score", "double"), ("evidence", f"array<struct<id:{kind},label:double,cosine:double>>")])
    return scored.select(F.col("id").alias(id_col), "score", "evidence", *[F.col("rest")[c].alias(c) for c in keep])


def classify(df: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, evidence array<struct(id, label, cosine)>, the columns named in ``keep``) for every row;
    ``train``: condition on the label table's rows."""
    examples = examples_of(df, labels, label, train, id_col, text_col, label_id)
    words = vocabulary(examples)
    counts = written(term_counts(df, words, id_col, text_col, keep), "term-counts")
    return score(counts, fit(examples, words, counts), id_col, keep)
