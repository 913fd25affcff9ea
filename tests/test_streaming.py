"""Streams run with availableNow and agree with their batch twins."""

import os

from pyspark.sql import functions as F

from callrisk.operators import sessions as SE
from callrisk.sources import adapters as AD
from callrisk.sources import events as EV
from callrisk.streaming import sessions as ST

from conftest import SF_SMALL


def _write_in_time_slices(df, path, cuts):
    """Append the events in three time slices, oldest first, so the file
    source sees them in event-time order across micro-batches."""
    lo = None
    for hi in cuts + [None]:
        part = df
        if lo is not None:
            part = part.filter(F.col("ts") >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            part = part.filter(F.col("ts") < F.lit(hi).cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)   # one file per slice: arrival order = time order
        lo = hi


def _norm(rows):
    out = set()
    for r in rows:
        out.add((r["call_id"], r["session_no"], r["status"], r["started_at"], r["ended_at"], r["n_scores"],
                 None if r["final_score"] is None else round(r["final_score"], 6),
                 None if r["duration_s"] is None else round(r["duration_s"], 6)))
    return out


LIVE = dict(watermark="1 hour", keep_ms=10**12, timeout_ms=10**12)


def _shuffled(spark, df, path, files=3):
    """The events dealt to files at random, inside a watermark of 400 days all arrive in time; a last file
    far ahead moves the watermark past every event."""
    df.withColumn("_f", F.pmod(F.xxhash64("event_id"), F.lit(files))).repartition(files, "_f").drop("_f") \
        .write.mode("append").parquet(path)
    ahead = df.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("call_id", F.lit(-1).cast("long")) \
        .withColumn("kind", F.lit("SEGMENT")).select(*df.columns)
    for k in range(2):
        ahead.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {k} DAYS")).coalesce(1).write.mode("append").parquet(path)


def _live(spark, scratch, snaps, make, name, per_trigger=1, **kw):
    """The rows that a live stream gives for shuffled arrivals."""
    src = os.path.join(scratch, name)
    _shuffled(spark, snaps, src)
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", per_trigger).parquet(src)
    out = make(ST.score_events(stream, AD.crm(spark, SF_SMALL)), **{**LIVE, "watermark": "400 days", **kw})
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, f"ck_{name}")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return spark.table(name).filter("call_id >= 0")


def _hot(spark):
    """Live events in which one call holds a third of all rows, with bursts, sessions under 30 s and several
    scores per 10 seconds."""
    snaps = AD.snapshots(spark, SF_SMALL)
    fast = snaps.withColumn("call_id", F.lit(3).cast("long")).withColumn(
        "ts", F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") * 1.7)) \
        .withColumn("event_id", F.col("event_id") + 10_000_000).filter(F.pmod(F.col("event_id"), F.lit(2)) == 0)
    return snaps.unionByName(fast)


def test_session_stream_equals_batch_twin(spark, scratch):
    crm = AD.crm(spark, SF_SMALL)
    for name, snaps in (("sessions_out", AD.snapshots(spark, SF_SMALL)), ("sessions_hot", _hot(spark))):
        got = _live(spark, scratch, snaps, ST.session_stream, name).collect()
        twin = SE.session_summaries(snaps, crm).filter(F.col("status").isin("ENDED", "REPLACED")).collect()
        assert len(twin) > 0
        assert _norm(got) == _norm(twin) and len(got) == len(twin)


def test_outcomes_equal_batch_twin(spark, scratch):
    snaps = _hot(spark)
    crm = AD.crm(spark, SF_SMALL)
    got = _live(spark, scratch, snaps, lambda s, **kw: ST.live_results(s, crm, **kw), "live_out")
    want = SE.classify_events(snaps).select("event_id", "call_id", "session_no", "outcome")
    mine = got.filter(F.col("outcome").isin("OPENED", "SCORED", "CLOSED", "REJECTED"))
    assert mine.count() == want.count()
    assert mine.select(*want.columns).exceptAll(want).count() == 0
    scored = SE.scored_events(SE.classify_events(snaps), AD.crm(spark, SF_SMALL)).select("event_id", "risk_score")
    assert mine.filter("outcome = 'SCORED'").select("event_id", "risk_score").exceptAll(scored).count() == 0
    row = mine.filter("outcome = 'SCORED'").first()
    assert row["risk_category"] and len(row["recommendations"]) > 0 and row["factors"] is not None
    assert mine.filter("outcome = 'REJECTED' AND error IS NULL").count() == 0


def test_trigger_stream_equals_batch(spark, scratch):
    raw = EV.contact_events_json(AD.snapshots(spark, SF_SMALL))
    src = os.path.join(scratch, "events")
    raw.write.mode("overwrite").text(src)
    stream = spark.readStream.schema("value string").text(src).withColumnRenamed("value", "event")
    q = (ST.trigger_stream(stream).writeStream.format("memory").queryName("triggers_out")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("triggers_out")
    want = EV.contact_triggers(raw)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_rescoring_stream_equals_batch_twin(spark, scratch):
    snaps = _hot(spark)
    got = _live(spark, scratch, snaps, ST.rescoring_stream, "rescore_out")
    want = SE.periodic_rescoring(snaps, AD.crm(spark, SF_SMALL))
    scored = SE.classify_events(snaps).filter("outcome = 'SCORED'").count()
    assert got.count() == want.count() and 0 < want.count() < scored     # windows merged, young sessions left out
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_segment_buffer_stream_equals_batch(spark, scratch):
    from callrisk.operators import transcripts as TR
    seg = AD.segments(spark, SF_SMALL)
    src = os.path.join(scratch, "seg")
    # two arrivals: early turns first, later turns second
    seg.filter(F.col("segment_id") < 2000).write.mode("append").parquet(src)
    seg.filter(F.col("segment_id") >= 2000).write.mode("append").parquet(src)
    stream = spark.readStream.schema(seg.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.segment_buffer_stream(stream).writeStream.format("memory").queryName("buf_out").outputMode("update")
         .option("checkpointLocation", os.path.join(scratch, "ck4")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("buf_out")
    last = got.groupBy("contact_id").agg(F.max_by(F.struct(*[c for c in got.columns if c != "contact_id"]),
                                                  "segment_count").alias("r")).select("contact_id", "r.*")
    buf = TR.segment_buffer(seg)
    assert buf.count() < seg.count()                      # the buffer drops older segments
    view = TR.transcript_view(seg).select("contact_id", "segment_count", "latest_segment_id")
    sent = TR.overall_sentiment(buf).select("contact_id", "improvement_score")
    want = view.join(sent, "contact_id")
    mine = last.select("contact_id", "segment_count", "latest_segment_id",
                       (F.col("last_customer_pos") - F.col("first_customer_neg")).alias("improvement_score"))
    assert mine.count() == want.count() > 0
    assert mine.exceptAll(want).count() == 0


def _burst_events(spark):
    """Live events plus a burst after each start: two extra events 100 ms and
    300 ms later (the bursts the debounce must collapse)."""
    snaps = AD.snapshots(spark, SF_SMALL)
    starts = snaps.filter(F.col("kind") == "START")
    extra = [starts.withColumn("event_id", F.col("event_id") + off * 1_000_000)
             .withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {ms} MILLISECONDS"))
             .withColumn("kind", F.lit("SEGMENT")) for off, ms in ((1, 100), (2, 300))]
    return snaps.unionByName(extra[0]).unionByName(extra[1])


def test_debounce_stream_equals_batch(spark, scratch):
    ev = _burst_events(spark)
    src = os.path.join(scratch, "burst")
    _write_in_time_slices(ev, src, ["2024-01-10", "2024-01-20"])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = (ST.debounce_stream(stream).writeStream.format("memory").queryName("debounce_out")
         .option("checkpointLocation", os.path.join(scratch, "ck5")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("debounce_out")
    wm = ev.agg(F.max("ts")).first()[0]
    # batch twin; a burst is emitted once the watermark (max ts - 1 minute) passes its end
    want = SE.debounce(ev).filter(F.col("ts") + F.expr("INTERVAL 500 MILLISECONDS")
                                  <= F.lit(wm) - F.expr("INTERVAL 1 MINUTE"))
    assert want.count() < ev.count()                      # bursts were collapsed
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_presence_stream_equals_batch(spark, scratch):
    snaps = AD.snapshots(spark, SF_SMALL)
    src = os.path.join(scratch, "pres")
    _write_in_time_slices(snaps, src, ["2024-01-10", "2024-01-20"])
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.presence_stream(stream).writeStream.format("memory").queryName("presence_out").outputMode("update")
         .option("checkpointLocation", os.path.join(scratch, "ck6")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("presence_out")
    final = got.groupBy("agent_id").agg(F.max_by(F.struct("active", "last_seen"), "last_seen").alias("r")) \
        .select("agent_id", "r.active", "r.last_seen")
    want = SE.agent_presence(snaps, "2099-01-01 00:00:00")
    assert final.count() == want.count() > 0
    assert final.exceptAll(want).count() == 0


def test_segment_stream_source(spark, scratch):
    from callrisk.sources.streams import segment_stream
    seg = AD.segments(spark, SF_SMALL)
    src = os.path.join(scratch, "segsrc")
    seg.write.parquet(src)
    stream = segment_stream(spark, src)
    q = (ST.latest_view_stream(stream).writeStream.format("memory").queryName("view_out").outputMode("complete")
         .option("checkpointLocation", os.path.join(scratch, "ck7")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    from callrisk.operators import transcripts as TR
    got = spark.table("view_out")
    want = TR.transcript_view(seg)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_session_timeout_closes_abandoned_call(spark, scratch):
    rows1 = [(1, 7, "2024-01-01 10:00:00", "START", None, "agent-1", None, -0.9, None, None),
             (2, 7, "2024-01-01 10:00:05", "SEGMENT", "CUSTOMER", "agent-1", None, -0.9, None, None),
             (3, 8, "2024-01-01 10:00:00", "START", None, "agent-2", None, 0.2, None, None),
             (4, 8, "2024-01-01 10:01:00", "END", None, "agent-2", None, 0.2, None, None)]
    rows2 = [(5, 9, "2024-01-01 14:00:00", "START", None, "agent-3", None, 0.1, None, None)]
    src = os.path.join(scratch, "timeout")
    for rows in (rows1, rows2):
        df = spark.createDataFrame(rows, "event_id long, call_id long, ts string, kind string, speaker string, "
                                         "agent_id string, agent_sentiment double, customer_sentiment double, "
                                         "confidence double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)      # one file per arrival, in time order
    crm = AD.crm(spark, SF_SMALL)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.session_stream(ST.score_events(stream, crm), watermark="1 hour", timeout_ms=3_600_000, keep_ms=3_600_000)
    q = (out.writeStream.format("memory").queryName("timeout_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck8")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["call_id"], r["status"]): r for r in spark.table("timeout_out").collect()}
    assert got[(8, "ENDED")]["duration_s"] == 60.0
    assert got[(7, "TIMED_OUT")]["n_scores"] == 1
    assert (9, "TIMED_OUT") not in got                   # still within its timeout


def test_score_cache_stream_equals_batch_twin_and_expires(spark, scratch):
    snaps = _hot(spark)
    got = _live(spark, scratch, snaps, ST.score_cache_stream, "cache_out")
    latest = got.filter("cached").groupBy("call_id").agg(
        F.max_by(F.struct("session_no", "scored_at", "risk_score"), F.struct("scored_at", "event_id")).alias("r")) \
        .select("call_id", "r.*")
    want = SE.score_cache(snaps, AD.crm(spark, SF_SMALL), "2029-01-01 00:00:00", ttl_s=10**9)
    assert latest.count() == want.count() > 0
    assert latest.select(*want.columns).exceptAll(want).count() == 0
    expired = {r["call_id"] for r in got.filter("NOT cached").collect()}
    assert expired == {r["call_id"] for r in want.collect()}             # the watermark is years ahead


def test_attribute_stream_equals_batch(spark, scratch):
    snaps = _hot(spark)
    got = _live(spark, scratch, snaps, ST.attribute_stream, "attr_out")
    want = SE.attribute_updates(snaps)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_late_start_inside_the_watermark_keeps_its_score(spark, scratch):
    kind = ("event_id long, call_id long, ts string, kind string, agent_id string, customer_sentiment double")
    rows = [[(2, 7, "2024-01-01 10:00:05", "SEGMENT", "a", -0.9)], [(1, 7, "2024-01-01 10:00:00", "START", "a", 0.0)],
            [(3, 7, "2024-01-01 10:00:30", "END", "a", 0.0)], [(9, -1, "2024-01-02 10:00:00", "START", "b", 0.0)],
            [(10, -1, "2024-01-02 11:00:00", "END", "b", 0.0)]]
    src = os.path.join(scratch, "late")
    for part in rows:
        df = spark.createDataFrame(part, kind).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.session_stream(ST.score_events(stream, AD.crm(spark, SF_SMALL)), keep_ms=3_600_000)
    q = (out.writeStream.format("memory").queryName("late_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckl")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    row = spark.table("late_out").filter("call_id = 7").collect()
    assert [(r["status"], r["n_scores"], r["duration_s"]) for r in row] == [("ENDED", 1, 30.0)]


def _short_calls(spark):
    """Live events of 40 calls within a few minutes: restarts, ends, rejected events and calls left open."""
    i = F.col("id")
    kind = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 2, "START").when(F.pmod(F.xxhash64("id"), F.lit(10)) < 3, "END") \
        .otherwise("SEGMENT")
    return spark.range(600).select(
        i.alias("event_id"), (i % 40).alias("call_id"),
        (F.lit("2024-03-01 09:00:00").cast("timestamp") + F.make_dt_interval(secs=i * 0.73 + (i % 7) * 0.01)).alias("ts"),
        kind.alias("kind"), F.concat(F.lit("agent-"), (i % 40 % 9).cast("string")).alias("agent_id"),
        (F.pmod(F.xxhash64("id"), F.lit(200)) / 100.0 - 1).alias("customer_sentiment"))


def test_attribute_ticks_stream_equals_batch_twin(spark, scratch):
    """Rows come from timers alone, also where no event of the call follows."""
    snaps = _short_calls(spark)
    until = "2024-03-01 09:20:00"
    got = _live(spark, scratch, snaps, ST.attribute_tick_stream, "tick_out", timeout_ms=7_200_000, keep_ms=7_200_000)
    want = SE.attribute_ticks(snaps, "2024-03-01 00:00:00", until)
    mine = got.filter(F.col("as_of") < F.lit(until).cast("timestamp"))
    assert mine.count() == want.count() > 3000
    assert mine.select(*want.columns).exceptAll(want).count() == 0
    assert got.count() > mine.count()                    # open calls go on until their time-out
    assert got.filter(F.col("queue_time") >= 7200 + 600).count() == 0
    later = SE.attribute_ticks(snaps, "2024-03-01 09:03:00", until)
    assert 0 < later.count() < want.count() and later.exceptAll(want).count() == 0


def test_gauge_stream_equals_live_gauges(spark, scratch):
    from callrisk.operators import aggregate as A
    for name, snaps in (("gauge_small", _short_calls(spark)), ("gauge_all", AD.snapshots(spark, SF_SMALL))):
        src = os.path.join(scratch, name)
        _shuffled(spark, snaps, src)
        stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(src)
        scored = ST.score_events(stream, AD.crm(spark, SF_SMALL))
        out = ST.gauge_stream(scored, **{**LIVE, "watermark": "400 days"})
        q = (out.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, f"ck_{name}")).trigger(availableNow=True).start())
        q.awaitTermination(600)
        got = ST.gauge_totals(spark.table(name)).first()
        want = A.live_gauges(SE.session_summaries(snaps, AD.crm(spark, SF_SMALL))).first()
        assert tuple(got) == (want["active_calls"], want["active_agents"]) and got["active_calls"] > 0


def test_time_out_between_events_of_one_batch(spark, scratch):
    """A gap longer than the time-out closes the session, also when both events arrive together."""
    kind = "event_id long, call_id long, ts string, kind string, agent_id string, customer_sentiment double"
    rows = [(1, 7, "2024-01-01 10:00:00", "START", "a", 0.0), (2, 7, "2024-01-01 10:00:04", "SEGMENT", "a", -0.9),
            (3, 7, "2024-01-01 12:30:00", "SEGMENT", "a", 0.0), (4, 7, "2024-01-01 12:31:00", "START", "a", 0.0),
            (9, -1, "2024-01-03 10:00:00", "START", "b", 0.0)]
    src = os.path.join(scratch, "gap")
    df = spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    crm = AD.crm(spark, SF_SMALL)
    out = ST.live_results(ST.score_events(stream, crm), crm, timeout_ms=3_600_000)
    q = (out.writeStream.format("memory").queryName("gap_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckg")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = [(r["outcome"], r["session_no"], str(r["ts"])[11:]) for r in
           spark.table("gap_out").filter("call_id = 7").orderBy("ts", "session_no", "outcome").collect()]
    assert got == [("OPENED", 1, "10:00:00"), ("SCORED", 1, "10:00:04"), ("TIMED_OUT", 1, "11:00:04"),
                   ("REJECTED", 1, "12:30:00"), ("OPENED", 2, "12:31:00"), ("TIMED_OUT", 2, "13:31:00")]


def test_a_batch_writes_its_own_events_alone(spark):
    """The cost of a batch does not depend on the events that wait already."""
    from types import SimpleNamespace

    from callrisk.streaming.calls import LiveCalls

    class Store(dict):
        writes = 0

        def getValue(self, k): return self[k]
        def containsKey(self, k): return k in self
        def exists(self): return bool(self)
        def get(self, *a): return super().get(*a) if a else self["v"]
        def updateValue(self, k, v): self[k] = v; Store.writes += 1       # noqa: E702
        def update(self, v): self["v"] = v; Store.writes += 1             # noqa: E702

    handle = SimpleNamespace(getValueState=lambda *a: Store(), getMapState=lambda *a: Store(), registerTimer=lambda t: None)
    machine = LiveCalls(10**9, 10**9, 10, 30, 3600, None)
    machine.init(handle)
    costs = []
    for k in range(50):
        Store.writes = 0
        rows = [SimpleNamespace(us=(k * 10 + j) * 1000, event_id=j, kind="SEGMENT", agent_id="a", customer_sentiment=0.0,
                                risk_score=1.0) for j in range(10)]
        list(machine.handleInputRows((1,), iter(rows), None))
        costs.append(Store.writes)
    assert set(costs) == {11} and len(machine.waiting) == 500
