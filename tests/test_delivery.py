"""Delivery per epoch and incremental workbooks."""

import os
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrisk.sinks import versions as V
from callrisk.sinks import writers as W
from callrisk.sources import files as FS

from test_sources_sinks import _xlsx


def _results(spark, scratch, agents):
    src = os.path.join(scratch, "results")
    df = spark.range(agents * 3).select(F.concat(F.lit("a"), (F.col("id") % agents).cast("string")).alias("agent_id"),
                                        F.col("id").alias("call_id"), F.rand(1).alias("risk_score"))
    df.repartition(3).write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _files(base):
    return [f for d, _, names in os.walk(base) if "epoch=" in d for f in names if f.endswith(".parquet")]


def test_rooms_of_many_agents_in_few_files(spark, scratch):
    base = os.path.join(scratch, "rooms")
    stream = _results(spark, scratch, 500)
    W.deliver_rooms(stream, base, os.path.join(scratch, "ck"), files=4).awaitTermination(300)
    assert len(_files(base)) <= 3 * 4                                    # three triggers, whatever the agents
    assert spark.read.parquet(base).count() == 1500
    room = W.read_room(spark, base, "a7")
    assert sorted(r["call_id"] for r in room.collect()) == [7, 507, 1007]
    assert "PushedFilters: [IsNotNull(agent_id), EqualTo(agent_id,a7)]" in room._jdf.queryExecution().toString()


def test_replayed_epochs_deliver_once(spark, scratch, monkeypatch):
    base = os.path.join(scratch, "rooms")
    stream = _results(spark, scratch, 5)
    assert W.read_room(spark, base, "a1") is None
    real = V.CommitLog.commit
    monkeypatch.setattr(V.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        W.deliver_rooms(stream, base, os.path.join(scratch, "ck"), files=2).awaitTermination(300)
    assert W.read_room(spark, base, "a1") is None                        # written, not committed: not delivered
    monkeypatch.setattr(V.CommitLog, "commit", real)
    W.deliver_rooms(stream, base, os.path.join(scratch, "ck"), files=2).awaitTermination(300)
    assert spark.read.parquet(base).count() == 15
    assert sorted(r["call_id"] for r in W.read_room(spark, base, "a1").collect()) == [1, 6, 11]


def _rows(n):
    return [["no", "name", "value"]] + [[i, f"n{i % 50}", i / 4] if i % 7 else [i, None, i / 4] for i in range(n)]


def test_workbook_is_read_in_bounded_memory():
    small, large = (_xlsx(_rows(n)) for n in (2000, 60_000))
    peaks = []
    for content in (small, large):
        z = FS.sheet_rows(content)
        strings_free = 0
        tracemalloc.start()
        for number, _ in z:
            strings_free = number
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert strings_free > 0
    # 30 times the rows: only the shared strings (one per text cell in these files) grow
    strings = 60_000 * 70
    assert peaks[1] < peaks[0] + strings


@pytest.mark.parametrize("part_bytes", [8 << 20, 4000])
def test_large_workbook_is_dealt_over_tasks(spark, scratch, monkeypatch, part_bytes):
    monkeypatch.setattr(FS, "PART_BYTES", part_bytes)
    monkeypatch.setattr(FS, "ROW_BLOCK", 100)
    folder = os.path.join(scratch, "raw")
    os.makedirs(folder)
    for name, n in (("a.xlsx", 3000), ("b.xlsx", 1), ("c.xlsx", 0)):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(_xlsx(_rows(n)))
    schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    got = sorted((r["no"], r["name"] or "", r["value"])
                 for r in FS.read_workbooks(spark, os.path.join(folder, "*.xlsx"), schema).collect())
    want = sorted((i, (n or ""), v) for i, n, v in _rows(3000)[1:] + _rows(1)[1:])
    assert got == want
