"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only.

Documents are taken in batches of ascending id.  ``LineRuns`` holds the hashes of all line keys seen so
far as runs: tables bucketed and sorted by the hash, so that a merge join reads them in order without a
shuffle.  A batch is merge-joined against the runs, its unseen keys become a new run of level 0, and when a
level holds ``FANOUT`` runs they are compacted into one run of the next level.  A key's lines stay in the
document of the least id that holds it: a later batch meets the key in a run, and inside a batch the
least id owns it.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; shorter keys than
``min_chars`` code points never drop.  Keys are compared by two independent 64-bit hashes.

A common line costs one row per map task before the shuffle that finds its owner, and its occurrences
are spread over ``SALTS`` salted copies of the owner row in the join that marks them.  Marked lines are line
numbers of a row, known by its id and the hash of its text, so that the texts are cut without hashing them
again and rows of equal or null id are spread out too.

Defined results: null and empty text is one empty line; rows of equal id count as one document and none
loses a line to the other; null ids count as one document after all others; named extra columns are
carried along, others left out; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tasks import discard, id_bounds, partitions, range_of, shared_path, written

FANOUT = 2
SALTS = 8
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(BLANKS))
    # lower() is the same for ASCII text and much cheaper than a character table
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)) \
        .otherwise(F.translate(stripped, UPPER, UPPER.lower()))


def key_hash(line: Column, min_chars: int) -> Column:
    """struct(h1, h2) of the line's key, null where the key is too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars,
                  F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


class LineRuns:
    """Levels of runs: tables of (h1, h2, owner, several, seen) in the shared folder, whose rows that are not
    ``seen`` are the run's hashes; no hash is in two runs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[list[str]] = []
        self.written: dict[str, str] = {}
        self.buckets = partitions(spark)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def hashes(self, name: str) -> DataFrame:
        return self.spark.table(name).where("NOT seen").select("h1", "h2")

    def write(self, marked: DataFrame) -> str:
        """A table bucketed and sorted by the hash (rows grouped or joined by it are in place already)."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.written[name] = shared_path(self.spark, "line-run")
        (marked.write.format("parquet").option("path", self.written[name])
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        return name

    def seen(self, hashes: DataFrame) -> DataFrame:
        """Adds ``seen``: whether any run holds the hash (merge join with every run)."""
        found = F.lit(False)
        for k, name in enumerate(self.runs()):
            run = self.hashes(name).withColumn(f"in_{k}", F.lit(True))
            hashes = hashes.join(run.hint("merge"), ["h1", "h2"], "left")
            found = found | F.coalesce(F.col(f"in_{k}"), F.lit(False))
        return hashes.withColumn("seen", found).drop(*[f"in_{k}" for k in range(len(self.runs()))])

    def add(self, name: str) -> None:
        """Take a written table as a run of level 0, then compact full levels into the next one."""
        k = 0
        while True:
            if len(self.levels) == k:
                self.levels.append([])
            self.levels[k].append(name)
            if len(self.levels[k]) < FANOUT:
                return
            full, self.levels[k] = self.levels[k], []
            merged = self.hashes(full[0])
            for other in full[1:]:
                merged = merged.unionAll(self.hashes(other))
            name = self.write(merged.withColumn("seen", F.lit(False)).repartition(self.buckets, "h1", "h2"))
            k += 1

    def close(self) -> None:
        for name, path in self.written.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)
        self.levels, self.written = [], {}


def dropped_lines(keys: DataFrame, batches: list[int]) -> DataFrame:
    """(id, body, pos) of the lines that a row loses; ``keys``: (id, body, pos, h1, h2, batch) of all lines
    whose key counts."""
    runs, shared = LineRuns(keys.sparkSession), None
    try:
        for batch in batches:
            first = (keys.where(F.col("batch") == batch).groupBy("h1", "h2")
                     .agg(F.min("id").alias("owner"), (F.min("id") != F.max("id")).alias("several")))
            marked = runs.seen(first)
            if batch != batches[-1]:  # nothing comes after the last batch that would read its run
                name = runs.write(marked)
                marked = runs.spark.table(name)
                runs.add(name)
            # what some document of the batch loses: keys of earlier batches, and keys of several documents
            own = marked.where("seen OR several").select("h1", "h2", "owner", "seen", F.lit(batch).alias("batch"))
            shared = own if shared is None else shared.unionAll(own)
        shared = written(shared, "line-shared")
    finally:
        runs.close()
    salted = shared.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    mine = keys.withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.lit(SALTS)).cast("int"))
    return (mine.join(salted, ["batch", "h1", "h2", "salt"])
            .where(F.col("seen") | ~F.col("id").eqNullSafe(F.col("owner"))).select("id", "body", "pos"))


def without(lines: Column, gone: Column) -> Column:
    """The lines between the line numbers of ``gone`` (ascending)."""
    cuts = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(
        lines, F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k) - 1)))


def dedup_lines(df: DataFrame, min_chars: int = 10, batches: int = 4, id_col: str = "doc_id",
                text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_dropped, kept text, the columns named in ``keep``) for every row of ``df``."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.struct(*[F.col(c) for c in keep] or [F.lit(None).alias("none")]).alias("rest"))
    bounds = id_bounds(docs, batches)
    body = F.xxhash64("text")
    keys = (docs.select("id", body.alias("body"), range_of(F.col("id"), bounds).alias("r"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("id", "body", "pos", "r", key_hash(F.col("line"), min_chars).alias("k")).where("k is not null")
            # null ids come after all others
            .select("id", "body", "pos", "k.h1", "k.h2",
                    F.when(F.col("r") < 0, len(bounds) + 1).otherwise(F.col("r")).alias("batch")))
    keys = written(keys, "line-keys")
    batches_in = sorted(r["batch"] for r in keys.select("batch").distinct().collect())
    lost = dropped_lines(keys, batches_in or [0])
    per_row = lost.groupBy("id", "body").agg(F.sort_array(F.collect_set("pos")).alias("gone")) \
        .withColumnsRenamed({"id": "lost_id", "body": "lost_body"})
    joined = docs.join(per_row, F.col("id").eqNullSafe(F.col("lost_id")) & (body == F.col("lost_body")), "left")
    gone, text = F.col("gone"), F.col("text")
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(without(F.split(text, "\n"), gone), "\n"))
    return joined.select(F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"),
                         F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"), kept.alias("kept"),
                         *[F.col("rest")[c].alias(c) for c in keep])
