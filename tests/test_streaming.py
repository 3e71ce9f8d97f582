"""Streams over file sources against their batch twins."""

from pyspark.sql import functions as F

from ticketweave.streaming import jobs

C, L = F.col, F.lit
ROOT = "/root/testdata/sf0.001"


def events(spark):
    return jobs.stream_table(spark, ROOT, "events"), spark.read.parquet(f"{ROOT}/events.parquet").withColumn("ts", C("ts").cast("timestamp"))


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def run(df, scratch, mode="append"):
    q = jobs.run_once(df, f"{scratch}/out", f"{scratch}/ck", mode)
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(f"{scratch}/out")


def test_stream_logs(spark, scratch):
    import os
    os.mkdir(f"{scratch}/in")
    with open(f"{scratch}/in/a.log", "w") as f:
        f.write("2024-01-01 00:00:00 ERROR code: 4002\nINFO fine\n")
    out = run(jobs.stream_logs(spark, f"{scratch}/in"), scratch)
    assert rows(out, "level", "error_code") == {("ERROR", "4002")}


def test_volume(spark, scratch):
    s, b = events(spark)
    got = rows(run(jobs.volume(s, "ts", "1 day", ["event_type"]), scratch), "window_start", "event_type", "volume")
    want = rows(jobs.volume(b, "ts", "1 day", ["event_type"]), "window_start", "event_type", "volume")
    last = max(w[0] for w in want)
    assert got <= want and {w for w in want if w[0] < last} <= got


def test_sessions(spark, scratch):
    s, b = events(spark)
    got = rows(run(jobs.sessions(s, "user_id", "ts"), scratch), "user_id", "session_start", "n_events")
    assert got and got <= rows(jobs.sessions(b, "user_id", "ts"), "user_id", "session_start", "n_events")


def test_signature_counters(spark, scratch):
    s, b = events(spark)
    jobs.stream_signatures(s, "event_type", "ts", f"{scratch}/store", f"{scratch}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{scratch}/store")
    assert rows(got, "event_type", "frequency", "last_seen") == rows(jobs.signatures(b, "event_type", "ts"), "event_type", "frequency", "last_seen")


def test_spikes(spark, scratch):
    s, b = events(spark)
    jobs.stream_spikes(s, "ts", f"{scratch}/store", f"{scratch}/alerts", f"{scratch}/ck").awaitTermination(120)
    assert rows(spark.read.parquet(f"{scratch}/alerts"), "window_start", "volume") == rows(jobs.score_spikes(jobs.sliding_volume(b, "ts")), "window_start", "volume")


def test_retry_loops(spark, scratch):
    s, b = events(spark)
    got = run(jobs.stream_retry_loops(s, "user_id", "event_type", "ts", threshold=2, window_seconds=86400), scratch)
    counts = {(r[0], r[1]): r[2] for r in b.groupBy("user_id", "event_type").count().collect()}
    found = got.collect()
    assert found and all(r.occurrences <= counts[(r.entity, r.kind)] for r in found)
    newest = b.groupBy("user_id", "event_type").agg(F.max(F.floor(F.unix_seconds("ts") / 60)).alias("m"))
    recent = (b.join(newest, ["user_id", "event_type"]).filter(F.floor(F.unix_seconds("ts") / 60) >= C("m") - 1440).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n >= 2"))
    assert {(r.entity, r.kind, r.occurrences) for r in found} == rows(recent, "user_id", "event_type", "n")


def batches_of(spark, scratch, schema, batches):
    """A stream that reads one file, in the order given, in each micro-batch."""
    import os
    os.mkdir(f"{scratch}/in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/part{k}")
        part = next(f for f in os.listdir(f"{scratch}/part{k}") if f.endswith(".parquet"))
        os.link(f"{scratch}/part{k}/{part}", f"{scratch}/in/{k:03d}.parquet")
        os.utime(f"{scratch}/in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")


def at(minute):
    import datetime
    return datetime.datetime(2024, 1, 5, 8, 0, 17, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minute)


def test_retry_loops_over_batches_with_late_rows(spark, scratch):
    """Late rows within the watermark's delay count, minutes out of the window do not, thresholds go by kind."""
    batches = [
        [(1, "timeout", at(m)) for m in (0, 1, 2)] + [(2, "other", at(m)) for m in range(4)] + [(3, "mq_send", at(0))] * 9 + [(4, "timeout", at(0))] * 4,
        [(1, "timeout", at(m)) for m in (40, 5)] + [(2, "other", at(m)) for m in (3, 30, 31, 32)] + [(4, "timeout", at(61))] * 4 + [(4, "timeout", at(20))],
        [(1, "timeout", at(m)) for m in (50, 62, 41)] + [(2, "other", at(33)), (2, "other", None), (None, "timeout", at(3))] + [(5, "timeout", at(200))] * 5,
        [(5, "timeout", at(m)) for m in (250, 199, 251)],
    ]
    src = batches_of(spark, scratch, "e long, k string, t timestamp", batches)
    got = {}
    for r in run(jobs.stream_retry_loops(src, "e", "k", "t"), scratch).collect():
        got[r.entity, r.kind] = max(got.get((r.entity, r.kind), (0, 0)), (r.last_minute, r.occurrences))
    want, all_rows = {}, [x for b in batches for x in b if x[0] is not None and x[2] is not None and x[1] != "mq_send"]
    for key in {(e, k) for e, k, _ in all_rows}:
        minutes = [int(t.timestamp()) // 60 for e, k, t in all_rows if (e, k) == key]
        n = sum(m >= max(minutes) - 60 for m in minutes)
        if n >= (5 if key[1] == "timeout" else 8):
            want[key] = (max(minutes), n)
    assert got == want and set(want) == {(1, "timeout"), (2, "other"), (4, "timeout"), (5, "timeout")}


def test_late_rows_are_counted_beyond_the_progress_kept(spark, scratch):
    """Spark is told to keep the progress of two batches; late rows of seven are counted."""
    batches = [[(100, at(300))]] + [[(10 * k + i, at(0)) for i in range(k)] + [(200 + k, at(300 + k))] for k in range(1, 8)]
    src = batches_of(spark, scratch, "id long, t timestamp", batches)
    late = jobs.LateRows()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    spark.streams.addListener(late)
    try:
        q = jobs.run_once(jobs.dedupe(src, ["id"], "t", "1 hour"), f"{scratch}/out", f"{scratch}/ck")
        q.awaitTermination(120)
        kept = spark.read.parquet(f"{scratch}/out").count()
        # The row of the second batch comes before the watermark is in force.
        assert late.count(q) == sum(range(2, 8)) == sum(map(len, batches)) - kept
        assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in q.recentProgress) < late.count(q)
    finally:
        spark.streams.removeListener(late)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_late_events_reach_the_signature_store(spark, scratch):
    """A late event raises the frequency and not the last time: the later batch wins."""
    src = batches_of(spark, scratch, "k string, t timestamp", [[("a", at(9)), ("b", at(1))], [("a", at(3))], [("a", at(2)), ("b", at(0))]])
    jobs.stream_signatures(src, "k", "t", f"{scratch}/store", f"{scratch}/ck").awaitTermination(120)
    got = rows(spark.read.parquet(f"{scratch}/store").withColumn("m", F.unix_seconds("last_seen") - F.unix_seconds("first_seen")), "k", "frequency", "m")
    assert got == {("a", 3, 420), ("b", 2, 60)}


def test_missing_followups(spark, scratch):
    s, b = events(spark)
    args = ("user_id", "event_type", "ts", "event_id", "view", "click", 30000)
    got = rows(run(jobs.missing_followups(s, *args), scratch), "trigger_id")
    assert got <= rows(jobs.missing_followups(b, *args), "trigger_id")


def test_dedupe(spark, scratch):
    s, b = events(spark)
    got = run(jobs.dedupe(s, ["user_id", "event_type"], "ts", "40 days"), scratch)
    assert got.count() == jobs.dedupe(b, ["user_id", "event_type"], "ts").count()


def test_late_policy_tags(spark, scratch):
    s, b = events(spark)
    as_of = L("2024-01-20").cast("timestamp")
    prep = lambda d: d.withColumn("tags", F.array().cast("array<string>"))
    out = run(jobs.late_policy(prep(s), "ts", "event_type", "tags", as_of), scratch)
    assert out.filter(F.array_contains("tags", "future_timestamp")).count() == b.filter(C("ts") > as_of).count()


def test_enrich(spark, scratch):
    s, b = events(spark)
    cat = spark.createDataFrame([("error", "high")], "event_type string, severity string")
    out = run(jobs.enrich(s, cat, "event_type", {"severity": "medium"}), scratch)
    assert out.filter("severity = 'high'").count() == b.filter("event_type = 'error'").count()
