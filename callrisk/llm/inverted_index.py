"""Benchmark decontamination with a distributed positional inverted index.

The training documents are cut into shards of bounded text size.  A shard's index row holds its
documents' ids and word counts, the hashes of its terms in order, and for each term the ascending word
positions (postings) in the shard.  The index is sharded by document, so no posting list crosses a
shard and none grows with the corpus, however common its term.

A search turns the test items into phrases (windows of words).  In each shard the phrases whose terms
all occur are taken; the postings of a phrase's rarest term, shifted by the term's offset, are the
candidate starts, and the other terms' postings are intersected in order of rarity.  ``slack`` > 0
gives proximity matches: every term within that many words of its place in the phrase.

Defined results: null and empty texts have no words and match nothing; an item without words is no
item; items with equal text are reported each; repeated documents give one row each; extra columns are
left out; empty tables give an empty index or no hits.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import (WORD_BYTE, RangeHash, ascii_lower, offsets_of, pieces, ragged_index, utf8,
                     word_ranges)
from .tasks import map_arrow, texts, written

#: Text bytes of a shard; bounds the memory of building and of searching it.
SHARD_BYTES = 8 << 20
#: Text bytes of test items searched at once, and bytes of such blocks that are broadcast at once.
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and words per row."""
    data, offsets = utf8(column)
    hashes, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(offsets):
        body = ascii_lower(data[offsets[a]:offsets[b]])
        starts, ends, n = word_ranges(body, offsets[a:b + 1] - offsets[a], WORD_BYTE)
        hashes.append(RangeHash(body)(starts, ends))
        count.append(n)
    return np.concatenate(hashes), np.concatenate(count)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``df``, written to the shared folder: one row per shard."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch):
        from pyspark import TaskContext

        words, count = _words(batch.column(1))
        terms, term = np.unique(words, return_inverse=True)
        postings = np.argsort(term, kind="stable")
        first = batch.column(0).slice(0, 1)
        many = pa.list_(pa.int64())
        seen["n"] = seen.get("n", -1) + 1
        yield {"shard": np.array([TaskContext.get().partitionId() << 24 | seen["n"]], np.int64),
               "ids": pa.array([batch.column(0).to_pylist()], pa.list_(first.type)),
               "n_words": pa.array([count.tolist()], many),
               "terms": [terms.tobytes()],
               "postings": [postings.astype("<u4").tobytes()],
               "counts": [np.bincount(term.reshape(-1), minlength=len(terms)).astype("<u4").tobytes()]}

    seen: dict = {}
    index = map_arrow(texts(df, id_col, text_col), run,
                      [("shard", "long"), ("ids", f"array<{kind}>"), ("n_words", "array<long>"),
                       ("terms", "binary"), ("postings", "binary"), ("counts", "binary")], SHARD_BYTES)
    return written(index, "positional-index")


class Shard:
    """Posting lists of one shard, addressed by (term, position)."""

    def __init__(self, terms: bytes, postings: bytes, counts: bytes, n_words: list[int]):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.positions = np.frombuffer(postings, "<u4").astype(np.int64)
        self.first = offsets_of(self.counts)
        self.key = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions
        self.doc_first = offsets_of(np.asarray(n_words, np.int64))

    def find(self, phrases: np.ndarray, bounds: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of the phrases (flat term hashes, bounds): phrase number, start position (with slack it may
        lie before the document) and document."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(phrases):
            return none, none, none
        slot = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        known = self.terms[slot] == phrases
        size = np.diff(bounds)
        whole = np.flatnonzero(np.logical_and.reduceat(known, bounds[:-1]))
        if not len(whole):
            return none, none, none
        # terms of each phrase in order of rarity
        flat = ragged_index(bounds[whole], size[whole])
        of = np.repeat(np.arange(len(whole)), size[whole])
        term, offset = slot[flat], flat - bounds[whole][of]
        order = np.lexsort((offset, self.counts[term], of))
        term, offset = term[order], offset[order]
        begin = offsets_of(size[whole])
        rare, shift = term[begin[:-1]], offset[begin[:-1]]
        count = self.counts[rare]
        phrase = np.repeat(np.arange(len(whole)), count)
        start = self.positions[ragged_index(self.first[rare], count)] - np.repeat(shift, count)
        doc = np.searchsorted(self.doc_first, start + np.repeat(shift, count), "right") - 1
        length = size[whole]
        ok = (start >= self.doc_first[doc]) & (start + length[phrase] <= self.doc_first[doc + 1]) \
            if not slack else np.ones(len(start), bool)
        phrase, start, doc = phrase[ok], start[ok], doc[ok]
        for k in range(1, int(length.max())):
            has = length[phrase] > k
            at = begin[phrase[has]] + k
            place = start[has] + offset[at]
            low = np.maximum(place - slack, self.doc_first[doc[has]])
            high = np.minimum(place + slack, self.doc_first[doc[has] + 1] - 1)
            found = np.searchsorted(self.key, term[at] << 32 | low)
            good = (low <= high) & (found < len(self.key))
            good[good] = self.key[found[good]] <= (term[at[good]] << 32 | high[good])
            ok = np.ones(len(phrase), bool)
            ok[has] = good
            phrase, start, doc = phrase[ok], start[ok], doc[ok]
            if not len(phrase):
                break
        return whole[phrase], start, doc


def test_phrases(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Test items in blocks of bounded size: item ids, and their phrases as flat term hashes.

    A phrase is ``window`` consecutive words; an item of fewer words, but not none, is one phrase.
    """
    kind = items.schema[id_col].dataType.simpleString()

    def run(batch):
        words, count = _words(batch.column(1))
        first = offsets_of(count)[:-1]
        n = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        start = ragged_index(first, n)
        length = np.repeat(np.minimum(count, window), n)
        yield {"item_ids": pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
               "owner": [np.repeat(np.arange(len(count)), n).astype("<i8").tobytes()],
               "sizes": [length.astype("<i8").tobytes()],
               "phrases": [words[ragged_index(start, length)].tobytes()]}

    return map_arrow(texts(items, id_col, text_col), run,
                     [("item_ids", f"array<{kind}>"), ("owner", "binary"), ("sizes", "binary"),
                      ("phrases", "binary")], BLOCK_BYTES)


def _passes(blocks: DataFrame) -> list[list[int]]:
    """Block numbers in groups of at most BROADCAST_BYTES; one empty group where there are none."""
    sizes = blocks.select("block", (F.octet_length("phrases") + F.octet_length("owner") + F.octet_length("sizes"))
                          .alias("size")).orderBy("block").collect()      # one row per megabyte of test items
    out, room = [[]], BROADCAST_BYTES
    for r in sizes:
        if out[-1] and r["size"] > room:
            out.append([])
            room = BROADCAST_BYTES
        out[-1].append(r["block"])
        room -= r["size"]
    return out


def search(index: DataFrame, items: DataFrame, window: int = 10, slack: int = 0,
           item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Documents with matches: (shard, doc: place in the shard, ranges: word ranges [start, end) inside
    a match, relative to the document; item_ids).

    The stated set of test items is taken in blocks of bounded size against every shard; blocks travel to the
    shards in passes of at most ``BROADCAST_BYTES`` (a larger block is a pass of its own).
    """
    kind = T.ArrayType(items.schema[item_col].dataType)
    blocks = written(test_phrases(items, window, item_col, text_col).withColumn("block", F.monotonically_increasing_id()),
                     "test-phrases")
    ranges = "array<struct<start:long,end:long>>"
    arrow_ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch):
        shard, number = None, None
        for k in range(batch.num_rows):
            r = {n: batch.column(j)[k] for j, n in enumerate(batch.schema.names)}
            if shard is None or r["shard"].as_py() != number:  # a shard's blocks follow each other
                shard = Shard(*(r[c].as_py() for c in ("terms", "postings", "counts", "n_words")))
                number = r["shard"].as_py()
            owner = np.frombuffer(r["owner"].as_py(), "<i8")
            bounds = offsets_of(np.frombuffer(r["sizes"].as_py(), "<i8"))
            phrase, start, doc = shard.find(np.frombuffer(r["phrases"].as_py(), np.uint64), bounds, slack)
            if not len(phrase):
                continue
            size = np.diff(bounds)[phrase]
            low = np.maximum(start - slack, shard.doc_first[doc])
            high = np.minimum(start + size + slack, shard.doc_first[doc + 1])
            order = np.lexsort((low, doc))
            owner_of, ids = owner[phrase][order], r["item_ids"].as_py()
            doc, low, high = doc[order], low[order], high[order]
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out = {"doc": [], "ranges": [], "item_ids": []}
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)]):
                base = shard.doc_first[doc[a]]
                reach = np.maximum.accumulate(high[a:b])
                new = np.append(True, low[a + 1:b] > reach[:-1])
                ends = reach[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]
                out["doc"].append(int(doc[a]))
                out["ranges"].append([{"start": int(x), "end": int(y)}
                                      for x, y in zip(low[a:b][new] - base, ends - base)])
                out["item_ids"].append([ids[i] for i in np.unique(owner_of[a:b]).tolist()])
            yield {"shard": pa.array([r["shard"].as_py()] * len(out["doc"]), pa.int64()),
                   "doc": pa.array(out["doc"], pa.int64()), "ranges": pa.array(out["ranges"], arrow_ranges),
                   "item_ids": pa.array(out["item_ids"], pa.list_(batch.schema.field("item_ids").type.value_type))}

    found = None
    for numbers in _passes(blocks):
        some = blocks.where(F.col("block").isin(numbers)).drop("block")
        pairs = index.select("shard", "n_words", "terms", "postings", "counts").crossJoin(F.broadcast(some))
        part = map_arrow(pairs, run, [("shard", "long"), ("doc", "long"), ("ranges", ranges), ("item_ids", kind)], None)
        found = part if found is None else found.unionAll(part)
    return found.groupBy("shard", "doc").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))


def report(index: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for every indexed document: id, n_words, n_hit (words inside a match), item_ids."""
    at = F.col("at")
    docs = (index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "at"))
            .select("shard", F.col("doc").cast("long").alias("doc"), at["ids"].alias(id_col),
                    at["n_words"].alias("n_words")))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        "ranges", nothing,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["end"] - F.greatest(a["end"], r["start"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], r["end"]).alias("end")))["n"]
    return (docs.join(found, ["shard", "doc"], "left")
            .select(id_col, "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids")))
