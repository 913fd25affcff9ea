"""Training-corpus pipeline: five stages, each working on all that its predecessor kept.

quality -> line dedup -> SimHash near-dedup -> benchmark decontamination -> byte-level BPE.  A stage takes
(spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
returns the encoded documents.  Rows are numbered inside the stages that drop documents, so rows with null
or repeated ids are judged one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrisk.llm import bpe_codec, inverted_index, knn_quality, line_dedup, queries, simhash
from callrisk.llm.tasks import written
from callrisk.sources.tables import read_table

#: No SQL can express the votes and the fingerprints; tests check every stage by brute force.
ORACLE_SQL: str | None = None


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns, whatever their names, travel in one struct."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).alias("none")]).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, ``new`` ones in place of the old."""
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c)
                         for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, row_number): whole rows with a number that stays the same in every later read."""
    return written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_number")),
                   "numbered")


def _chosen(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    return rows.join(numbers, "row_number", how).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the nearest labelled ones vote for.

    Null and empty texts get the sample's mean label and are kept if that reaches the threshold; texts are
    scored whole; repeated rows, null ids and extra columns of any name are kept as they are.
    """
    model = queries.quality_model(docs, read_table(spark, sf_dir, "labels"))
    scored = knn_quality.score(_packed(docs), model, keep=("text", "rest"))
    return _unpacked(scored.where(F.col("score") >= queries.QUALITY_THRESHOLD), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; the text and its length change, no document goes.

    Null text becomes empty text; a text whose lines all go is empty; texts are handled whole; rows of equal
    id count as one document; null ids come last; extra columns of any name are kept as they are.
    """
    kept = line_dedup.dedup_lines(_packed(docs), min_chars=10, keep=("rest",))
    return _unpacked(kept, docs, text=F.col("kept"), n_chars=F.char_length("kept").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates (null ids come last).

    Null and empty texts are one group; of rows of equal least id one stays; texts are fingerprinted whole;
    extra columns of any name are kept as they are.
    """
    rows = _numbered(docs)
    doc_id = F.col("row.doc_id")
    keyed = rows.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "row_number").alias("key"),
                        F.col("row.text").alias("text"))
    groups = simhash.near_duplicates(keyed, shingle=4, radius=4, id_col="key")
    first = groups.where(F.col("key.row_number") == F.col("component_id.row_number"))
    return _chosen(rows, first.select(F.col("key.row_number").alias("row_number")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.

    Null and empty texts have no words and are kept; texts are searched whole; rows are judged one by one,
    also where ids repeat or are null; extra columns of any name are kept as they are.
    """
    rows = _numbered(docs)
    index = inverted_index.build_index(rows.select("row_number", F.col("row.text").alias("text")), id_col="row_number")
    found = inverted_index.search(index, read_table(spark, sf_dir, "benchmark"), window=10)
    hit = inverted_index.report(index, found, "row_number").where("n_hit > 0").select("row_number")
    return _chosen(rows, hit, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digests of ids and decoded bytes.

    Null and empty texts have no ids; texts are encoded whole; every row is encoded, also where ids repeat or
    are null; extra columns are left out.
    """
    coded = bpe_codec.transcode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates),
          ("decontamination", decontaminate), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
