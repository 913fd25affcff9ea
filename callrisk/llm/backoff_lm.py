"""Language-model scores from a weighted backoff automaton.

N-gram counts of the training documents are smoothed by interpolated absolute discounting.  States are
the histories seen in training, numbered; the root is the empty one.  An arc is a seen n-gram: from the state
of its history, by its last word, with its interpolated log probability, to the state of the longest known
history that it ends in.  A state's failure arc leads to the history without its first word and costs the mass
that discounting left over.  The root has an arc for every token: (c + 0.5) / (N + 0.5 (V + 1)).

The traversal reads a document left to right and carries nothing but its state: it takes failure arcs until
the token has an arc, takes that, and goes on in its target.  All documents of a shard are read side by side,
long ones in segments: as a state depends on the last order - 1 tokens alone, a segment reads these tokens
first, without counting them.

The model is as large as the corpus, so no task holds it whole.  Documents are cut into shards; a shard
sends its distinct n-grams with their training counts to the exchange and gets the corpus-wide counts of
just these, then the type and token counts of its histories, and builds the part of the automaton that its
own documents can reach.

Defined results: null and empty texts have one token, the end; without training tokens the root spreads
over V = 0 words; rows with null ids take the empty text's remainder; repeated rows count and score each;
extra columns are left out; an empty table gives no rows.  N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .arrays import (NOT_SPACE, RangeHash, ascii_lower, batch_rows, bound_batches, mix, offsets_of, pieces, utf8,
                     word_ranges)
from .tasks import gathered, written

ORDER = 2
DISCOUNT = 0.75
SHARD_BYTES = 4 << 20
#: Tokens that one lane of the traversal reads.
SEGMENT = 256
#: Hashes of the end and of the start of a document; words have other hashes (64 bits).
END, START = np.uint64(0xE5D0E5D0E5D0E5D1), np.uint64(0x57A5757A5757A57B)


class Shard:
    """Token sequences of some documents: word table, token numbers, and all their n-grams."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.words, self.tokens, self.lengths = words, tokens, lengths
        self.first = offsets_of(lengths)
        self.train = np.repeat(train, lengths)
        self.place = np.arange(len(tokens)) - np.repeat(self.first[:-1], lengths)

    @staticmethod
    def of_text(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> Shard:
        hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in pieces(offsets):
            body = ascii_lower(data[offsets[a]:offsets[b]])
            starts, ends, n = word_ranges(body, offsets[a:b + 1] - offsets[a], NOT_SPACE)
            own = np.full(len(starts) + len(n), END)
            inner = np.ones(len(own), bool)
            inner[offsets_of(n + 1)[1:] - 1] = False
            own[inner] = RangeHash(body)(starts, ends)
            hashes.append(own)
            lengths.append(n + 1)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return Shard(words, tokens.reshape(-1), np.concatenate(lengths), train)

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n tokens before each token (the start counts as one), and whether they exist."""
        hashes = self.words[self.tokens]
        out = np.full(len(hashes), np.uint64(n * 0xA24BAED4963EE407 % 2 ** 64))
        for back in range(n, 0, -1):
            word = np.empty_like(hashes)
            word[back:] = hashes[:-back]
            word[:back] = 0
            word[self.place == back - 1] = START
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
        return out, self.place >= n - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that end an n-gram, and their hashes."""
        if n == 1:
            return np.arange(len(self.tokens)), self.words[self.tokens]
        history, exists = self.histories(n - 1)
        at = np.flatnonzero(exists)
        return at, mix(history[at] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.tokens[at]])


def _state(df: DataFrame, id_col: str, text_col: str, train) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), train.alias("train"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(gathered(batches, SHARD_BYTES)):
            learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            shard = Shard.of_text(*utf8(batch.column(1)), learn)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | seq], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
                 pa.array([exchange.pack(learn)], pa.binary()), pa.array([exchange.pack(shard.lengths)], pa.binary()),
                 pa.array([exchange.pack(shard.words)], pa.binary()),
                 pa.array([exchange.pack(shard.tokens.astype("<u4"))], pa.binary()),
                 pa.array([int(shard.train.sum())], pa.int64())],
                names=["shard", "ids", "train", "lengths", "words", "tokens", "n_train"])

    return docs.mapInArrow(run, f"shard long, ids array<{kind}>, train binary, lengths binary, words binary, "
                                "tokens binary, n_train long")


def _shard(row: dict) -> Shard:
    return Shard(exchange.unpack(row["words"]), exchange.unpack(row["tokens"], "<u4").astype(np.int64),
                 exchange.unpack(row["lengths"], np.int64), exchange.unpack(row["train"], bool))


def _rows(batches):
    """Shard rows one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}


def score(df: DataFrame, train, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    ``train``: boolean column of ``df``, true for documents to learn from.
    """
    table = exchange.ShardTable(_state(df, id_col, text_col, train))
    try:
        with batch_rows(df.sparkSession, 2):
            return _scored(df, table, order, id_col)
    finally:
        table.drop()


def _scored(df: DataFrame, table: exchange.ShardTable, order: int, id_col: str) -> DataFrame:
    bits = exchange.bucket_bits(df.sparkSession)

    def ask_grams(batches):
        for row in _rows(batches):
            shard = _shard(row)
            for n in range(1, order + 1):
                at, keys = shard.grams(n)
                distinct, which = np.unique(keys, return_inverse=True)
                counts = np.bincount(which.reshape(-1), shard.train[at], len(distinct)).astype(np.int64)
                yield exchange.rows(exchange.request(row["shard"], n, distinct, counts, bits))

    needed = table.read().select("shard", "train", "lengths", "words", "tokens")
    grams = written(exchange.summed(needed.mapInArrow(ask_grams, exchange.REQUEST), "first"), "gram-counts")
    totals = table.read().agg(F.sum("n_train")).first()[0] or 0
    types = grams.where("level = 1").agg(F.sum("distinct")).first()[0] or 0

    def ask_histories(batches):
        for row in _rows(batches):
            shard = _shard(row)
            for n in range(2, order + 1):
                at, keys = shard.grams(n)
                found = exchange.answered(row["grams"], n, 2)
                _, one, which = np.unique(keys, return_index=True, return_inverse=True)
                history = shard.histories(n - 1)[0][at]
                # types: the n-grams that this shard counts as its own; tokens: its training tokens
                distinct, of = np.unique(history, return_inverse=True)
                own = np.bincount(of.reshape(-1)[one], found[:, 1], len(distinct))
                seen = np.bincount(of.reshape(-1), shard.train[at], len(distinct))
                counts = np.stack([seen, own], axis=1).astype(np.int64)
                yield exchange.rows(exchange.request(row["shard"], n, distinct, counts, bits))

    gram_answers = exchange.by_shard(grams, "grams")
    asked = table.join(gram_answers).select("shard", "train", "lengths", "words", "tokens", "grams")
    histories = written(exchange.summed(asked.mapInArrow(ask_histories, exchange.REQUEST)), "history-counts")

    def traverse(batches):
        for row in _rows(batches):
            shard = _shard(row)
            machine = Automaton(shard, row["grams"], row["histories"], order, totals, types)
            base, known = machine.base(shard)
            n = len(shard.lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], id_type), pa.array(exchange.unpack(row["train"], bool)),
                 pa.array(shard.lengths), pa.array(known), pa.array(np.full(n, totals, np.int64)), pa.array(base),
                 pa.array(machine.read(shard))],
                names=[id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    whole = table.join(gram_answers.join(exchange.by_shard(histories, "histories"), "shard", "left")).select(
        "shard", "ids", "train", "lengths", "words", "tokens", "grams", "histories")
    return whole.mapInArrow(traverse, f"{id_col} {kind.simpleString()}, train boolean, n_tokens long, n_known long, "
                                      "train_tokens long, base_score double, score double")


class Automaton:
    """States, arcs and failure arcs that the documents of a shard can reach.

    Arcs are sorted by (state, word): ``key`` = state * words + word, with ``weight`` (log10) and ``target``;
    ``fail_weight`` and ``fail_target`` belong to a state.  State 0 is the root, ``start`` that of a text's begin.
    """

    def __init__(self, shard: Shard, grams, histories, order: int, totals: int, types: int):
        self.order, self.words = order, max(len(shard.words), 1)
        n_tokens = len(shard.tokens)
        # known[m]: for each position the number of its m-token history as a state, -1 where it is none
        self.known = [np.zeros(n_tokens, np.int64)]
        self.fail_weight, self.fail_target = [np.zeros(1)], [np.zeros(1, np.int64)]
        left, tokens = [None], [None]
        states = 1
        for n in range(2, order + 1):
            at, _ = shard.grams(n)
            history = shard.histories(n - 1)[0][at]
            _, one, of = np.unique(history, return_index=True, return_inverse=True)
            seen, kinds = exchange.answered(histories, n, 2).T
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.where(seen > 0, DISCOUNT * kinds / seen, np.nan)
            number = np.where(seen > 0, np.cumsum(seen > 0) - 1 + states, -1)
            here = np.full(n_tokens, -1)
            here[at] = number[of.reshape(-1)]
            live = np.flatnonzero(seen > 0)
            self.fail_weight.append(np.log10(rest[live]))
            self.fail_target.append(self.known[n - 2][at[one[live]]])
            self.known.append(here)
            left.append((of.reshape(-1), rest))
            tokens.append(seen)
            states += len(live)
        self.fail_weight, self.fail_target = np.concatenate(self.fail_weight), np.concatenate(self.fail_target)
        # the state after each position: the longest known history that ends there
        after = np.zeros(n_tokens, np.int64)
        ends = shard.first[1:] - 1
        self.targets = [after.copy() for _ in range(order)]      # by the length of the arc's n-gram
        for n in range(1, order + 1):
            for m in range(1, min(n, order - 1) + 1):
                ahead = np.full(n_tokens, -1)
                ahead[:-1] = self.known[m][1:]
                ahead[ends] = -1
                self.targets[n - 1] = np.where(ahead >= 0, ahead, self.targets[n - 1])
        key, weight, target = [], [], []
        lower = None
        for n in range(1, order + 1):
            at, keys = shard.grams(n)
            _, one, which = np.unique(keys, return_index=True, return_inverse=True)
            which = which.reshape(-1)
            count = exchange.answered(grams, n, 2)[:, 0]
            if n == 1:
                p = (count + 0.5) / (totals + 0.5 * (types + 1))
                self.root, self.counted = np.log10(p), count > 0
                lower = p[which]
                arcs = np.arange(len(one))
            else:
                of, rest = left[n - 1]
                seen = tokens[n - 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    below = np.where(seen[of] > 0, rest[of], 1.0) * lower[at]
                    full = np.where(count[which] > 0, (count[which] - DISCOUNT) / seen[of] + below, below)
                lower = lower.copy()
                lower[at] = full
                p = full[one]
                arcs = np.flatnonzero(count > 0)
            place = at[one[arcs]]
            key.append(self.known[n - 1][place] * self.words + shard.tokens[place])
            weight.append(np.log10(p[arcs]))
            target.append(self.targets[n - 1][place])
        sort = np.argsort(np.concatenate(key), kind="stable")
        self.key, self.weight, self.target = (np.concatenate(x)[sort] for x in (key, weight, target))
        begin = self.known[1][shard.first[:-1]] if order > 1 else np.zeros(len(shard.lengths), np.int64)
        self.start = np.maximum(begin, 0)

    def base(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Base score and known tokens of each document, from the root's arcs."""
        first = shard.first[:-1]
        if not len(first):
            return np.zeros(0), np.zeros(0, np.int64)
        return (np.add.reduceat(self.root[shard.tokens], first),
                np.add.reduceat(self.counted[shard.tokens].astype(np.int64), first))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New state and log10 weight of reading one word in each state: failure arcs, then the word's arc."""
        state, total = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            wanted = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            done, at = open_[hit], at[hit]
            total[done] += self.weight[at]
            state[done] = self.target[at]
            open_ = open_[~hit]
            total[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_target[state[open_]]
        return state, total

    def read(self, shard: Shard) -> np.ndarray:
        """Score of every document: one left-to-right traversal, documents and segments side by side."""
        count = -(-shard.lengths // SEGMENT)
        doc = np.repeat(np.arange(len(count)), count)
        offset = (np.arange(len(doc)) - np.repeat(offsets_of(count)[:-1], count)) * SEGMENT
        warm = np.minimum(offset, self.order - 1)                      # tokens read before the segment's own
        size = np.minimum(shard.lengths[doc] - offset, SEGMENT) + warm
        begin = shard.first[doc] + offset - warm
        state = np.where(offset == warm, self.start[doc], 0)
        order = np.argsort(-size, kind="stable")
        doc, warm, size, begin, state = doc[order], warm[order], size[order], begin[order], state[order]
        score_ = np.zeros(len(shard.lengths))
        total = np.zeros(len(doc))
        for k in range(int(size.max(initial=0))):
            lanes = int(np.searchsorted(-size, -k, "left"))            # segments longer than k, which come first
            state[:lanes], gained = self.step(state[:lanes], shard.tokens[begin[:lanes] + k])
            total[:lanes] += np.where(warm[:lanes] > k, 0.0, gained)
        np.add.at(score_, doc, total)
        return score_
