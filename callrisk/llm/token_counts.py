"""Token counts by rank-synchronous merging of ragged symbol arrays.

The distinct pre-tokens of a piece of text are held as one flat array of symbols with sequence
offsets.  In each round every sequence finds its lowest-rank neighbouring pair and all of its
occurrences are merged at once, for all sequences together; a sequence without a mergeable pair is
done and its surviving symbols are counted.

Defined results: null and empty text have 0 tokens and 0 bytes; repeated rows and ids give one row
each; extra input columns are left out; an empty table gives an empty result.  Special strings inside a
text count as one token each (the library's default); text beside one is normalised on its own.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .arrays import offsets_of, pieces, utf8
from .tasks import map_arrow, texts

_NONE = np.int64(1 << 40)


class MergeTable:
    """Merge ranks of a word-level BPE with word ends, over symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(vocab) + len(self.special) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        # merging all occurrences at once equals one at a time as long as a merged symbol only
        # takes part in merges of higher rank
        first = np.full(self.width, _NONE)
        np.minimum.at(first, left, np.arange(len(merges)))
        np.minimum.at(first, right, np.arange(len(merges)))
        self.at_once = bool((first[made] > np.arange(len(merges))).all())
        chars = pretokens.byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.table = pretokens.classes("tokenizers")

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string after all merges."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = size.copy()
        data = np.frombuffer(b"".join(tokens), np.uint8)
        bounds = offsets_of(size)
        symbol = self.inner[data]
        symbol[bounds[1:] - 1] = self.final[data[bounds[1:] - 1]]
        who = np.arange(len(tokens))
        while len(who):
            seq = np.repeat(np.arange(len(size)), size)
            pair = np.full(len(symbol), -1, np.int64)
            same = seq[1:] == seq[:-1]
            pair[:-1][same] = (symbol[:-1] * self.width + symbol[1:])[same]
            slot = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where(self.key[slot] == pair, self.rank[slot], _NONE)
            best = np.minimum.reduceat(rank, bounds[:-1])
            hit = (rank == best[seq]) & (rank < _NONE)
            if self.at_once:  # of overlapping occurrences (a a a) every second one, from the left
                at = np.flatnonzero(hit)
                new_run = np.ones(len(at), bool)
                new_run[1:] = at[1:] != at[:-1] + 1
                begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - begin) % 2 == 1]] = False
            else:
                at = np.flatnonzero(hit)
                hit[at[1:][seq[at[1:]] == seq[at[:-1]]]] = False
            symbol = np.where(hit, self.made[slot], symbol)
            keep = np.ones(len(symbol), bool)
            keep[np.flatnonzero(hit) + 1] = False
            size = size - np.bincount(seq[hit], minlength=len(size))
            result[who] = size
            alive = best < _NONE
            keep &= alive[seq]
            symbol, who, size = symbol[keep], who[alive], size[alive]
            bounds = offsets_of(size)
        return result


_TABLES: dict[str, tuple[MergeTable, pretokens.TokenPool]] = {}


def _table(path: str):
    if path not in _TABLES:
        table = MergeTable(path)
        _TABLES[path] = table, pretokens.TokenPool(lambda tokens: (table.counts(tokens), np.ones(len(tokens), np.int64)))
    return _TABLES[path]


def _normalised(text: str) -> str:
    """Composed and lower-cased character by character (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _piece_counts(data, offsets, table: MergeTable, pool: pretokens.TokenPool) -> np.ndarray:
    raw = data.tobytes()
    parts, row = [], []
    extra = np.zeros(len(offsets) - 1, np.int64)
    split = re.compile("|".join(map(re.escape, table.special))).split if table.special else lambda x: [x]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        cut = split(raw[a:b].decode("utf-8"))
        extra[i] = len(cut) - 1
        for part in cut:
            if part:
                parts.append(_normalised(part))
                row.append(i)
    if not parts:
        return extra
    points = pretokens.code_points("".join(parts))
    head = np.zeros(len(points), bool)
    first = offsets_of(np.fromiter(map(len, parts), np.int64, len(parts)))
    head[first[:-1]] = True
    start, none = pretokens.word_starts(points, head, table.table)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(points))
    real = ~none[at]
    at, ends = at[real], ends[real]
    byte = pretokens.byte_offsets(points)
    flat = np.frombuffer("".join(parts).encode(), np.uint8)
    tokens, which = pretokens.distinct_ranges(flat, byte[at], byte[ends])
    if not tokens:
        return extra
    entry = pool.lookup(tokens)
    count = pool.flat[entry][which]
    owner = np.asarray(row)[np.searchsorted(first, at, "right") - 1]
    return extra + np.bincount(owner, count, len(extra)).astype(np.int64)


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long) for every row of ``df``; one pass without a shuffle.

    ``tokenizer``: path of a tokenizers JSON file holding a BPE model with a word-end suffix.
    """
    def run(batch):
        table, pool = _table(tokenizer)
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            own = offsets[a:b + 1] - offsets[a]
            yield {id_col: batch.column(0).slice(a, b - a), "n_bytes": np.diff(own),
                   "n_tokens": _piece_counts(data[offsets[a]:offsets[b]], own, table, pool)}

    return map_arrow(texts(df, id_col, text_col), run, [(id_col, df.schema[id_col].dataType),
                                                        ("n_bytes", "long"), ("n_tokens", "long")])


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Adds ``over_limit``: more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
