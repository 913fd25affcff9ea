"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .arrays import PIECE_BYTES, bound_batches


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder named by spark.checkpoint.dir and read it back.

    Cuts the lineage: what follows reads committed files, also after an executor is lost.
    The folder belongs to the session's checkpoint folder and goes with it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named, once nothing reads it any more."""
    if not path.startswith(ensure_checkpoint_dir(spark)):
        raise ValueError(f"{path} is not in the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two input columns as (id, text); any other column, whatever its name, is left out."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def gathered(batches, limit=PIECE_BYTES):
    """Join small batches to about one piece of text, so that vectorised passes have enough rows."""
    kept, size = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield kept[0] if len(kept) == 1 else _joined(kept)
            kept, size = [], 0
    if kept:
        yield _joined(kept)


def _joined(batches):
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def map_arrow(df: DataFrame, fn: Callable, fields: list[tuple[str, T.DataType | str]],
              gather: int | None = PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn(RecordBatch) -> iterator of dict(name -> array)``.

    Batches are joined up to ``gather`` bytes first; None takes them as they come.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t)
                           for n, t in fields])
    names = [n for n, _ in fields]

    def run(batches):
        for batch in (batches if gather is None else gathered(batches, gather)):
            for made in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)],
                    names=names)

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(id_col: Column, remainder: int, folds: int = 5) -> Column:
    """crc32(id as text) mod ``folds`` = remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds) == remainder


def binary(offsets, body) -> pa.Array:
    """Arrow binary array from int64 offsets and a byte buffer."""
    import numpy as np

    offsets = np.asarray(offsets)
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                     [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
    raise ValueError("a batch holds more than 2 GB of bytes")


def id_bounds(docs: DataFrame, n: int) -> list:
    """Least ids of the second to last of up to n ranges of about equal size of the ``id`` column;
    only ids are sorted.  A session may deal the sort over more partitions than n: then neighbours are joined."""
    ranged = docs.select("id").where(F.col("id").isNotNull()).repartitionByRange(n, "id")
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id")).collect()
    least = sorted(r["id"] for r in found)
    return [least[k * len(least) // n] for k in range(1, n)] if len(least) > n else least[1:]


def range_of(id_col: Column, bounds: list) -> Column:
    """Number of the range an id falls in: 0, 1, ...; -1 for null."""
    if not bounds:
        return F.when(id_col.isNull(), -1).otherwise(0)
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= id_col)
    return F.when(id_col.isNull(), -1).otherwise(F.size(below))


def least_by_hash(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows of least hash of ``key``: a sample that depends on nothing else.

    Only rows below a threshold that leaves about four times as many are sorted, so the tasks together
    send a bounded number of rows however many tasks there are; should too few be left, all are sorted.
    """
    hashed = df.withColumn("hash", F.xxhash64(key))
    n = df.count()
    if n > 8 * size:
        few = hashed.where(F.col("hash") < F.lit(int(-2 ** 63 + 2 ** 64 * 4 * size / n)))
        if few.count() >= size:
            hashed = few
    return hashed.orderBy("hash").limit(size)
