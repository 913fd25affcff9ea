"""Exact repeated-substring removal by merging shard Burrows-Wheeler transforms.

Bytes are removed that lie in a string of ``length`` bytes that also starts anywhere else.

*Phrases.*  Winnowing cuts each document at content-defined anchors (the leftmost least k-gram hash of
every ``WINDOW`` k-gram positions), and a phrase is the text from one anchor to the next with the next
anchor's k-gram.  Two equal strings of ``length`` bytes have the same anchors except near their ends,
so they share at least ``depth(length)`` whole phrases in a row.

*Merge.*  Every shard sorts the suffixes of its phrase sequences once and keeps the Burrows-Wheeler
transform.  The shards' transforms are merged by interleave refinement: after round h the suffixes are
ordered across all shards by their first h phrases, each suffix knowing the rank of its block.  A round
extends every block to the left through the shard's own transform: (symbol, rank of the block) is the new
block, and only distinct pairs are exchanged to number them in order.  No suffix is sorted again.  A block
with one suffix is settled, and its length is the suffix's common prefix; the blocks that are left after
``depth`` rounds are the repeated intervals.

*Exact check.*  Only windows of ``length`` bytes that contain a repeated interval's phrases can repeat.  A
window belongs to the leftmost least k-gram in it, and the run of windows of one such anchor is compared
as one string; equal strings settle all their windows.  Where different strings meet at equal anchors
(the ends of a repeated passage) one copy of each sends the hashes of its windows, and those found twice
repeat.

All exchanges are packed distinct keys per shard, so a passage in a third of all documents is one entry per
shard.  Strings are compared by 128-bit hashes, phrases and single windows by 64-bit hashes.

Defined results: null text is empty; repeated rows are documents of their own (and remove each other's
text); documents shorter than ``length`` keep all; null ids are kept; extra columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from .arrays import RangeHash, batch_rows, bound_batches, mix, offsets_of, pieces, ragged_index, utf8
from .tasks import gathered, texts, written

GRAM = 16
WINDOW = 64
SHARD_BYTES = 3 << 20


def depth(length: int) -> int:
    """Whole phrases that two equal strings of ``length`` bytes share at least.

    Of their length - GRAM + 1 k-gram positions all but WINDOW - 1 at either end are anchors in both or in
    neither, and anchors are at most WINDOW apart.
    """
    inner = length - GRAM + 1 - 2 * (WINDOW - 1)
    return (inner - WINDOW) // WINDOW


def gram_keys(data: np.ndarray) -> np.ndarray:
    """For each k-gram position: 32 bits of the k-gram's hash, then the position, so that the least key of
    a stretch is its leftmost least k-gram."""
    n = max(len(data) - GRAM + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    low = np.ndarray((n,), "<u8", raw, 0, (1,))
    high = np.ndarray((n,), "<u8", raw, 8, (1,))
    hashed = high + np.uint64(0xA24BAED4963EE407)
    mix_in_place(hashed)
    hashed += low * np.uint64(0x9E3779B97F4A7C15)
    mix_in_place(hashed)
    hashed &= np.uint64(0xFFFFFFFF00000000)
    hashed |= np.arange(n, dtype=np.uint64)
    return hashed


def mix_in_place(x: np.ndarray) -> None:
    """``arrays.mix`` of a large array, with one array beside it."""
    beside = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=beside)
        x ^= beside
        if factor is not None:
            x *= np.uint64(factor)


def least_positions(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key in each stretch [i, i + width)."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n - width + 1], ahead[width - 1:n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _whole(offsets: np.ndarray, size: int, length: int) -> np.ndarray:
    """Starts of all stretches of ``size`` bytes inside documents of at least ``length`` bytes."""
    n = np.diff(offsets)
    return ragged_index(offsets[:-1], np.where(n >= length, n - size + 1, 0))


def cut(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of the phrases, and the runs of windows by their own anchor: first and last window
    start, anchor position, and the anchor's k-gram hash."""
    keys = gram_keys(data)
    starts = _whole(offsets, WINDOW + GRAM - 1, length)
    anchors = least_positions(keys, WINDOW)[starts] if len(starts) else starts
    anchors = anchors[np.append(True, anchors[1:] != anchors[:-1])] if len(anchors) else anchors
    starts = _whole(offsets, length, length)
    owner = least_positions(keys, length - GRAM + 1)[starts] if len(starts) else starts
    new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(owner) else new
    return anchors, starts[new], starts[last], owner[new], mix(_gram_hash(data, owner[new]))


def _gram_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    n = len(data) - GRAM + 1
    return np.ndarray((n,), "<u8", raw, 0, (1,))[at] * np.uint64(0xD6E8FEB86659FD93) \
        + mix(np.ndarray((n,), "<u8", raw, 8, (1,))[at])


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard's symbols (0 ends a document, all ends differ) by prefix doubling, and
    the Burrows-Wheeler transform: the symbol before each suffix, 0 at a document's first."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), symbols
    ends = np.flatnonzero(symbols == 0)
    order = np.argsort(symbols, kind="stable")
    # a rank is the first place of its group in the order; groups of one are settled, the others are sorted on
    new = np.append(True, symbols[order][1:] != symbols[order][:-1])
    new[:len(ends)] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied, step = order[~(new & np.append(new[1:], True))], 1
    while len(tied):
        ahead = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        sort = np.lexsort((ahead, rank[tied]))
        tied, ahead = tied[sort], ahead[sort]
        group = rank[tied]
        index = np.arange(len(tied))
        head = np.append(True, group[1:] != group[:-1])
        place = group + index - np.maximum.accumulate(np.where(head, index, 0))
        order[place] = tied
        new = head | np.append(True, ahead[1:] != ahead[:-1])
        rank[tied] = np.maximum.accumulate(np.where(new, place, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[0] = 0
    return order, before[order]


class Interleave:
    """One shard's part of the merge: for each suffix the rank of its block, and the phrases that it
    is known to share with another suffix."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.to = np.empty(len(bwt), np.int64)  # the suffix one symbol longer to the left
        self.to[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        self.rank = np.zeros(len(bwt), np.int64)
        self.alive = np.ones(len(bwt), bool)
        self.lcp = np.zeros(len(bwt), np.int64)
        self.round = 0

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that extend to the left, their new blocks in order, and which block each enters."""
        at = np.flatnonzero(self.alive & (self.bwt != 0))
        keys = np.stack([self.bwt[at], self.rank[at].astype(np.uint64)], axis=1)
        distinct, _, which = exchange.distinct_keys(keys)
        return at, distinct, which

    def refine(self, answer: np.ndarray) -> None:
        """Take over the corpus-wide size and rank of each new block."""
        at, _, which = self.blocks()
        rank = np.zeros_like(self.rank)
        rank[self.to[at]] = answer[which, 1]
        self.rank, self.alive = rank, rank > 0
        self.round += 1
        self.lcp[self.alive] = self.round


def _state(df: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    import xxhash

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(gathered(batches, SHARD_BYTES)):
            data, offsets = utf8(batch.column(1))
            starts, symbols, tables = [], [], []
            for a, b in pieces(offsets):
                body, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                anchors, first, last, owner, gram = cut(body, own, length)
                raw = body.tobytes()
                doc = np.searchsorted(own, anchors, "right")
                inner = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
                ends = np.append(anchors[1:], 0) + GRAM
                digest = xxhash.xxh3_64_digest
                phrase = np.zeros(len(anchors), np.uint64)
                phrase[inner] = np.frombuffer(b"".join(
                    [digest(raw[x:y]) for x, y in zip(anchors[inner].tolist(), ends[inner].tolist())]),
                    ">u8") | np.uint64(1)
                starts.append(anchors + offsets[a])
                symbols.append(phrase)
                digest = xxhash.xxh3_128_digest
                whole = np.frombuffer(b"".join(
                    [digest(raw[x:y + length], z - x) for x, y, z in
                     zip(first.tolist(), last.tolist(), owner.tolist())]), np.uint64).reshape(-1, 2)
                tables.append(np.column_stack([whole, gram, (first + offsets[a]).astype(np.uint64),
                                               (last + offsets[a]).astype(np.uint64)]))
            order, bwt = transform(np.concatenate(symbols))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | seq], pa.int64()),
                 pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
                 *(pa.array([exchange.pack(x)], pa.binary()) for x in (
                     offsets, data, np.concatenate(starts).astype("<u4" if len(data) < 1 << 32 else "<u8"),
                     order.astype("<u4"), bwt, np.concatenate(tables)))],
                names=["shard", "ids", "offsets", "body", "anchors", "suffixes", "bwt", "runs"])

    return texts(df, id_col, text_col).mapInArrow(
        run, f"shard long, ids array<{kind}>, offsets binary, body binary, anchors binary, suffixes binary, "
             "bwt binary, runs binary")


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}


def _merged(row: dict, rounds: int) -> Interleave:
    shard = Interleave(exchange.unpack(row["bwt"]))
    for level in range(1, rounds + 1):
        shard.refine(exchange.answered(row["blocks"], level, 2))
    return shard


class Runs:
    """A shard's window runs: those with a candidate window, and what the exchanges said of them."""

    def __init__(self, row: dict, length: int, rounds: int):
        self.length = length
        merged = _merged(row, rounds)
        table = exchange.unpack(row["runs"]).reshape(-1, 5)
        anchors = exchange.unpack(row["anchors"], "<u4").astype(np.int64)
        offsets = exchange.unpack(row["offsets"], np.int64)
        at = np.sort(exchange.unpack(row["suffixes"], "<u4").astype(np.int64)[merged.lcp >= rounds])
        # windows that contain the phrases of a repeated interval, inside the document
        low = anchors[at + rounds] + GRAM - length
        high = anchors[at]
        doc = np.searchsorted(offsets, high, "right") - 1
        low = np.maximum(low, offsets[doc])
        high = np.minimum(high, offsets[doc + 1] - length)
        size = int(offsets[-1]) + 2
        mark = np.bincount(low[low <= high], minlength=size) - np.bincount(high[low <= high] + 1, minlength=size)
        self.candidate = np.cumsum(mark, dtype=np.int32) > 0
        before = np.zeros(len(mark) + 1, np.int32)
        np.cumsum(self.candidate, out=before[1:])
        first, last = table[:, 3].astype(np.int64), table[:, 4].astype(np.int64)
        some = before[last + 1] > before[first]
        self.whole, self.gram = table[some, :2], table[some, 2]
        self.first, self.last = first[some], last[some]
        self.keys, self.one, self.which = exchange.distinct_keys(self.whole)

    def settle(self, answers) -> None:
        """``copies``: whole strings found anywhere else; ``own``: this shard speaks for the string."""
        found = exchange.answered(answers, 1, 2)
        self.copies = found[self.which, 0] > 1
        self.own = np.zeros(len(self.which), bool)
        self.own[self.one] = found[:, 1] > 0

    def windows(self, answers) -> np.ndarray:
        """Candidate windows of the runs that this shard speaks for and whose anchor also has another
        string, in order."""
        distinct, _, which = exchange.distinct_keys(self.gram)
        strings = exchange.answered(answers, 1, 1)[:, 0]
        speak = np.flatnonzero(self.own & (strings[which] > 1))
        at = ragged_index(self.first[speak], self.last[speak] - self.first[speak] + 1)
        return at[self.candidate[at]]


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row of ``df``."""
    rounds = depth(length)
    if rounds < 1:
        raise ValueError(f"strings must have at least {2 * WINDOW + GRAM + 2 * (WINDOW - 1) - 1} bytes")
    spark = df.sparkSession
    bound_batches(spark)
    bits = exchange.bucket_bits(spark)
    table = exchange.ShardTable(_state(df, length, id_col, text_col))
    try:
        with batch_rows(spark, 2):
            blocks = merge(table, rounds, bits)
            return _checked(table, blocks, length, rounds, bits, df.schema[id_col].dataType, id_col)
    finally:
        table.drop()


def merge(table: exchange.ShardTable, rounds: int, bits: int) -> DataFrame | None:
    """Interleave refinement of all shards' transforms; the answers of every round."""
    blocks = None
    for level in range(1, rounds + 1):
        def ask(batches, level=level):
            for row in _rows(batches):
                _, distinct, which = _merged(row, level - 1).blocks()
                counts = np.bincount(which, minlength=len(distinct))
                yield exchange.rows(exchange.request(row["shard"], level, distinct, counts, bits))

        needed = _with(table, ["bwt"], blocks=blocks)
        found = written(exchange.summed(needed.mapInArrow(ask, exchange.REQUEST), "rank", 2), "bwt-blocks")
        blocks = found if blocks is None else blocks.unionAll(found)
    return blocks


def _with(table: exchange.ShardTable, columns: list[str], **answers: DataFrame | None) -> DataFrame:
    """Shard rows with their answers, one column per exchange."""
    joined = None
    for name, found in answers.items():
        if found is not None:
            mine = exchange.by_shard(found, name)
            joined = mine if joined is None else joined.join(mine, "shard", "left")
    out = table.read() if joined is None else table.join(joined)
    return out.select("shard", *columns, *[n for n, f in answers.items() if f is not None])


def _checked(table, blocks, length, rounds, bits, id_type, id_col) -> DataFrame:
    merged = ["bwt", "runs", "anchors", "suffixes", "offsets"]

    def ask_strings(batches):
        for row in _rows(batches):
            runs = Runs(row, length, rounds)
            yield exchange.rows(exchange.request(row["shard"], 1, runs.keys, np.bincount(
                runs.which, minlength=len(runs.keys)), bits))

    needed = _with(table, merged, blocks=blocks)
    strings = written(exchange.summed(needed.mapInArrow(ask_strings, exchange.REQUEST), "first", 2), "bwt-strings")

    def ask_anchors(batches):
        for row in _rows(batches):
            runs = Runs(row, length, rounds)
            runs.settle(row["strings"])
            distinct, _, which = exchange.distinct_keys(runs.gram)
            own = np.bincount(which, runs.own, len(distinct)).astype(np.int64)
            yield exchange.rows(exchange.request(row["shard"], 1, distinct, own, bits))

    needed = _with(table, merged, blocks=blocks, strings=strings)
    anchors = written(exchange.summed(needed.mapInArrow(ask_anchors, exchange.REQUEST)), "bwt-anchors")

    def spoken(row):
        """The shard's runs, and the windows that it sends with their hashes."""
        runs = Runs(row, length, rounds)
        runs.settle(row["strings"])
        at = runs.windows(row["strings_by_anchor"])
        data = exchange.unpack(row["body"], np.uint8)
        offsets = exchange.unpack(row["offsets"], np.int64)
        hashes = np.zeros(len(at), np.uint64)
        for a, b in pieces(offsets):
            x, y = np.searchsorted(at, offsets[[a, b]])
            if y > x:
                own = at[x:y] - offsets[a]
                hashes[x:y] = RangeHash(data[offsets[a]:offsets[b]])(own, own + length)
        return runs, at, hashes, data

    def ask_windows(batches):
        for row in _rows(batches):
            *_, hashes, _ = spoken(row)
            distinct, _, which = exchange.distinct_keys(hashes)
            yield exchange.rows(exchange.request(row["shard"], 1, distinct, np.bincount(
                which, minlength=len(distinct)), bits))

    needed = _with(table, [*merged, "body"], blocks=blocks, strings=strings, strings_by_anchor=anchors)
    windows = written(exchange.summed(needed.mapInArrow(ask_windows, exchange.REQUEST)), "bwt-windows")

    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(id_type)

    def remove(batches):
        for row in _rows(batches):
            runs, at, hashes, data = spoken(row)
            _, _, which = exchange.distinct_keys(hashes)
            again = exchange.answered(row["windows"], 1, 1)[which, 0] > 1
            offsets = exchange.unpack(row["offsets"], np.int64)
            mark = np.zeros(len(data) + 1, np.int32)
            for low, high in ((runs.first[runs.copies], runs.last[runs.copies]), (at[again], at[again])):
                mark += np.bincount(low, minlength=len(mark)).astype(np.int32)
                mark -= np.bincount(high + length, minlength=len(mark)).astype(np.int32)
            gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
            yield _result(row["ids"], data, offsets, gone, kind, id_col)

    whole = _with(table, [*merged, "body", "ids"], blocks=blocks, strings=strings, strings_by_anchor=anchors,
                  windows=windows)
    return whole.mapInArrow(remove, f"{id_col} {id_type.simpleString()}, n_bytes long, n_removed long, "
                                    "n_spans long, kept binary")


def _result(ids, data, offsets, gone, kind, id_col) -> pa.RecordBatch:
    before = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = offsets[:-1][offsets[:-1] < len(gone)]
    begins[heads] = gone[heads]
    spans = np.concatenate([[0], np.cumsum(begins)])
    raw = data[~gone].tobytes()
    kept = offsets - before[offsets]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])),
         pa.array(np.diff(spans[offsets])),
         pa.array([raw[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())], pa.binary())],
        names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])
