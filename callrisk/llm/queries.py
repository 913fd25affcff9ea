"""Registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (backoff_lm, bpe_codec, bwt_dedup, chat_repair, inverted_index, knn_quality, line_dedup, minhash, simhash,
               token_counts, token_files, toxicity, vp_clusters)
from .oracles import ORACLE  # noqa: F401
from .tasks import held_out, shared_path

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.over_limit(counts, 2048)


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return codec_digest(bpe_codec.transcode(read_table(spark, sf_dir, "documents"), vocabulary))


def codec_digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "op2_token_files")
    token_files.write(read_table(spark, sf_dir, "documents"), folder,
                      public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Exact phrases of 10 words; item ids as a digest of their text order."""
    index = inverted_index.build_index(docs)
    found = inverted_index.report(index, inverted_index.search(index, items, window=10))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs, shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUALITY_THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> knn_quality.Model:
    """Learned from the labelled rows whose id's crc32 mod 5 is not 0."""
    return knn_quality.fit(docs, labels, "quality", train=~held_out(F.col("doc_id"), 0))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model(docs, read_table(spark, sf_dir, "labels"))
    return knn_quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(read_table(spark, sf_dir, "documents"), shingle=5)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_chars=10))


def line_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score(read_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 1))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query
def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(bwt_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), length=400))


def repeats_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_vp_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(vp_clusters.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5))


def cluster_digest(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


@query
def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(chat_repair.damaged(read_table(spark, sf_dir, "conversations")))


def repair_digest(rows: DataFrame) -> DataFrame:
    """Plans of all conversations with the digest of their repaired rows."""
    found, fixed = chat_repair.repair(rows)
    sums = chat_repair.digests(fixed).withColumnRenamed("id", "of")
    return found.join(sums, F.col("id").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


TOXIC_THRESHOLD = 0.3


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows whose id's crc32 mod 4 is not 2."""
    found = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic",
                              train=~held_out(F.col("doc_id"), 2, 4))
    return found.select("doc_id", held_out(F.col("doc_id"), 2, 4).alias("held_out"), "score",
                        F.when(F.col("score") >= TOXIC_THRESHOLD, 1).otherwise(0).alias("predicted"),
                        F.col("evidence.id").alias("evidence"))
