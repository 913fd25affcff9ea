"""Versioned writes: a commit log of small files, and keyed tables that are upserted under it (SNK-8, SNK-9).

A log is a folder of numbered commits.  A commit is written aside and renamed to its number, which fails if
that number is taken; so a commit is there whole or not at all, and of two writers one fails loudly instead of
undoing the other.  Readers take the highest number.  Nothing is ever overwritten: what a reader has opened
stays, and a failure before the rename leaves only a folder that no commit names.

A keyed table keeps its rows in hash buckets of the key, one folder each; a commit names the folder of every
bucket, so an upsert rewrites only the buckets that its keys fall into.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import crm_upsert


class CommitLog:
    """Numbered commits, each a JSON value, in one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs_package = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.fs_package.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        folder = self.fs_package.Path(self.folder)
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> tuple[int, dict | None]:
        """Number and value of the newest commit; (-1, None) before the first."""
        numbers = self.numbers()
        if not numbers:
            return -1, None
        text = self.spark.read.text(f"{self.folder}/{numbers[-1]:020d}", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def commit(self, number: int, value: dict) -> None:
        """Add commit ``number``; raises if it is there already."""
        aside = self._path(f"_aside-{uuid.uuid4().hex}")
        out = aside.getFileSystem(self.conf).create(aside)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        files = self.fs_package.FileContext.getFileContext(self._path("_").getFileSystem(self.conf).getUri(), self.conf)
        no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(aside, self._path(f"{number:020d}"), no_overwrite)


class KeyedTable:
    """A table with one row per key, upserted by batches (SNK-8).

    ``schema``: the table's columns, the key and the time column among them.  A batch is known by its source and
    batch number: a batch that a source has committed already, or one before it, changes nothing when it comes
    again, as after a restart of a stream.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "customer_id",
                 ts: str = "risk_updated_at", buckets: int = 64):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.ts, self.buckets = key, ts, buckets
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the newest commit (only some buckets where named)."""
        _, value = self.log.latest()
        folders = {int(b): f for b, f in (value or {"folders": {}})["folders"].items()}
        wanted = [f for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def upsert(self, updates: DataFrame, batch: int, source: str = "load") -> bool:
        """Latest-wins upsert of one batch; False if the batch was committed before."""
        number, value = self.log.latest()
        value = value or {"folders": {}, "sources": {}, "buckets": self.buckets}
        if value["buckets"] != self.buckets:
            raise ValueError(f"the table has {value['buckets']} buckets, not {self.buckets}")
        if value["sources"].get(source, -1) >= batch:
            return False
        updates = updates.where(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in updates.select(self._bucket()).distinct().collect())     # at most ``buckets``
        folders = dict(value["folders"])
        if touched:
            target = f"{self.folder}/data/{number + 1:020d}-{uuid.uuid4().hex}"
            fresh = crm_upsert(self.read(touched), updates, self.key, self.ts).select(*self.schema.names)
            fresh.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket") \
                .write.partitionBy("_bucket").parquet(target)
            folders.update({str(b): f"{target}/_bucket={b}" for b in touched})
        self.log.commit(number + 1, {"folders": folders, "sources": {**value["sources"], source: batch},
                                     "buckets": self.buckets})
        return True


def upsert_stream(updates: DataFrame, table: KeyedTable, checkpoint: str, source: str = "live", trigger: dict | None = None):
    """SNK-8 in the live flow: every micro-batch of update records is upserted once, also when it is replayed."""
    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, source)

    return (updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
