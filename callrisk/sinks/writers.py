"""Sinks (SNK-1..11): table, result, metric and report writers, the CRM
upsert, model save / load, and the per-agent push of live results.

Writers are plain ``DataFrameWriter`` calls; every output is written by the
executors in parallel (no ``toPandas`` / driver-side file writing), and
overwrite-by-run-id keeps reruns idempotent after a failure.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def to_original_names(df: DataFrame, names: dict | None = None) -> DataFrame:
    """Exports carry the original column headers (e.g. the Japanese ones of the
    call table); physical names stay ASCII inside the engine."""
    from .. import schema as S
    m = names or S.ORIGINAL_NAMES
    return df.select(*[F.col(c).alias(m.get(c, c)) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, header: bool = True) -> str:
    """SNK-1 / SNK-4 / SNK-10: a table to parquet or CSV (header row)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
    return path


def export_risk_scores(results: DataFrame, base: str, run_id: str, fmt: str = "parquet") -> str:
    """SNK-2: the results table of one run, under ``run_id=<id>`` (dynamic
    partition overwrite replaces only this run)."""
    out = results.withColumn("run_id", F.lit(run_id))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").format(fmt).save(base))
    return os.path.join(base, f"run_id={run_id}")


def export_metrics(metrics: DataFrame, base: str, run_id: str) -> dict:
    """SNK-3: metrics (long form metric, value) as JSON lines and as a one-row
    CSV (metrics pivoted to columns)."""
    j = os.path.join(base, f"metrics_{run_id}.json")
    c = os.path.join(base, f"metrics_{run_id}.csv")
    metrics.coalesce(1).write.mode("overwrite").json(j)      # a handful of rows
    wide = metrics.groupBy().pivot("metric").agg(F.first("value"))
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(c)
    return {"json": j, "csv": c}


def report_row(spark: SparkSession, fields: dict) -> DataFrame:
    """SNK-5 / SNK-6: a one-row nested report (values may be dicts / lists)."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(fields, default=str)]))


def export_run(spark: SparkSession, base: str, run_id: str, results: DataFrame, metrics: DataFrame,
               importance: DataFrame, summary: DataFrame) -> DataFrame:
    """SNK-7: write results, metrics, importances and summary of one run;
    return the manifest (artefact, path)."""
    paths = {"risk_scores": export_risk_scores(results, os.path.join(base, "risk_scores"), run_id)}
    paths.update({f"metrics_{k}": v for k, v in export_metrics(metrics, os.path.join(base, "metrics"), run_id).items()})
    paths["feature_importance"] = write_table(importance, os.path.join(base, "importance", run_id), "csv")
    paths["summary"] = write_table(summary, os.path.join(base, "summary", run_id), "json")
    rows = [(k, v) for k, v in paths.items()]
    return spark.createDataFrame(rows, "artefact string, path string")


def crm_upsert(current: DataFrame, updates: DataFrame, key: str = "customer_id",
               ts: str = "risk_updated_at", event_id: str = "event_id") -> DataFrame:
    """SNK-8: latest-wins upsert.  Per key the row with the newest ``ts`` wins, on
    equal times the one of the highest ``event_id`` (stored records have none and
    lose), without event ids the greatest row; a row that was never updated has a
    null time and comes before all others.  ``max_by`` is a partial aggregate, so
    a key with many updates is reduced map-side before the shuffle."""
    both = current.unionByName(updates, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    rest = [c for c in cols if c not in (ts, event_id)]
    never = F.lit("0001-01-01 00:00:00").cast(both.schema[ts].dataType) \
        if both.schema[ts].dataType.typeName().startswith(("timestamp", "date")) else None
    when = F.col(ts) if never is None else F.coalesce(F.col(ts), never)
    order = [F.col(ts).isNotNull(), when, *([F.col(event_id)] if event_id in cols else []), *map(F.col, rest)]
    g = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
                              .alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != event_id or event_id in current.columns])


def risk_update_record(df: DataFrame) -> DataFrame:
    """SNK-8 field formats: factors joined with ', ', recommendations with a newline
    (the event id travels along where the input has one)."""
    return df.select("customer_id", "risk_score", "risk_level", "risk_updated_at",
                     *(["event_id"] if "event_id" in df.columns else []),
                     F.array_join("factors", ", ").alias("risk_factors_text"),
                     F.array_join("recommendations", "\n").alias("recommendations_text"))


def save_model(model, base: str, name: str, version: str, metadata: dict) -> str:
    """SNK-9: ``<base>/<name>/<version>`` (model + metadata JSON) and a commit in
    ``latest`` that names the newest version: readers see the old one or the new one, never a half."""
    from .versions import CommitLog

    path = os.path.join(base, name, version)
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    meta = dict(metadata, version=version, name=name)
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "metadata"))
    log = CommitLog(spark, os.path.join(base, name, "latest"))
    log.commit(max(log.numbers(), default=-1) + 1, {"version": version})
    return path


def has_model(spark: SparkSession, base: str, name: str, version: str) -> bool:
    """Whether a version was saved completely (its metadata, written last, is committed)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(base, name, version, "metadata", "_SUCCESS"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load_model(base: str, name: str, version: str | None = None, loader=None):
    """SRC-9: load a saved model (the ``latest`` version by default) with its metadata."""
    spark = SparkSession.getActiveSession()
    if version is None:
        from .versions import CommitLog
        _, newest = CommitLog(spark, os.path.join(base, name, "latest")).latest()
        if newest is None:
            raise FileNotFoundError(f"no model {name!r} in {base}")
        version = newest["version"]
    path = os.path.join(base, name, version)
    if loader is None:
        from pyspark.ml import PipelineModel
        loader = PipelineModel
    model = loader.load(os.path.join(path, "model"))
    meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
    return model, meta


def push_by_agent(results: DataFrame, base: str, checkpoint: str, agent: str = "agent_id", trigger=None):
    """SNK-11 for few agents: a streaming sink partitioned by agent (one folder per room), exactly-once via the
    checkpoint.  A trigger writes a file for every agent in it: for many agents use ``deliver_rooms``."""
    w = (results.writeStream.format("parquet").option("path", base).option("checkpointLocation", checkpoint)
         .partitionBy(agent).outputMode("append"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def deliver_rooms(results: DataFrame, base: str, checkpoint: str, agent: str = "agent_id", trigger=None,
                  files: int = 8):
    """SNK-11: deliver each live result to its agent's room.

    Each trigger writes one set of at most ``files`` files, sorted by agent, into the folder of its epoch, and
    then commits the epoch; the number of files does not depend on the number of agents, and an agent's rows
    are found by the files' own ranges (``read_room``).  A replayed epoch writes the same folder again and is
    committed once, so nothing is delivered twice.  A busy agent's rows are spread over several files.
    """
    from .versions import CommitLog

    def deliver(batch: DataFrame, epoch: int) -> None:
        log = CommitLog(batch.sparkSession, os.path.join(base, "_commits"))
        if epoch in log.numbers():
            return
        spread = F.pmod(F.xxhash64(*[c for c in batch.columns if c != agent]), F.lit(4))
        batch.repartition(files, F.col(agent), spread).sortWithinPartitions(agent) \
            .write.mode("overwrite").parquet(os.path.join(base, f"epoch={epoch}"))
        log.commit(epoch, {"epoch": epoch})

    return (results.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_room(spark: SparkSession, base: str, agent_id: str, agent: str = "agent_id") -> DataFrame | None:
    """What was delivered to one agent, of committed epochs alone; None before the first commit."""
    from .versions import CommitLog
    epochs = CommitLog(spark, os.path.join(base, "_commits")).numbers()
    if not epochs:
        return None
    return spark.read.option("basePath", base).parquet(*[os.path.join(base, f"epoch={e}") for e in epochs]) \
        .where(F.col(agent) == agent_id)


def room_name(agent_col: str = "agent_id") -> F.Column:
    return F.concat(F.lit("agent_"), F.col(agent_col))

