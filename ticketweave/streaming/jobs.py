"""Structured Streaming versions of the event operators. Every stateful one carries a watermark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ticketweave.functions.logs import parse_lines
from ticketweave.operators.rules import tag_stale
from ticketweave.operators.windows import BENIGN_TYPES, RETRY_TYPES
from ticketweave.sources.sinks import upsert_keyed

_C, _L = F.col, F.lit


def stream_table(spark: SparkSession, folder: str, name: str, times: Sequence[str] = ("ts",), per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a file stream; zone-less times become UTC timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.parquet(folder)
    return df.withColumns({c: _C(c).cast("timestamp") for c in times})


def stream_logs(spark: SparkSession, folder: str, strategy: str = "generic", service: str = "api") -> DataFrame:
    """New log files parsed by the same parser as in batch; stateless."""
    return parse_lines(spark.readStream.text(folder).withColumnRenamed("value", "line"), "line", strategy, service)


def volume(df: DataFrame, ts: str, size: str = "1 day", by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window; works on batches and streams alike."""
    return (df.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("volume"))
            .select(_C("window.start").alias("window_start"), *by, "volume"))


def sliding_volume(df: DataFrame, ts: str, size: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return (df.withWatermark(ts, late).groupBy(F.window(ts, size, slide)).agg(F.count("*").alias("volume"))
            .select(_C("window.start").alias("window_start"), "volume"))


def score_spikes(counts: DataFrame, z: float = 1.8) -> DataFrame:
    """Windows whose volume lies ``z`` sample deviations off the mean of all windows given (one row per window)."""
    stats = counts.agg(F.avg("volume").alias("m"), F.stddev_samp("volume").alias("s"))
    m = stats.select("m").scalar()
    s = stats.select(F.when(F.coalesce("s", _L(0.0)) == 0, 1.0).otherwise(_C("s"))).scalar()
    score = (_C("volume") - m) / s
    return counts.filter(F.abs(score) >= z).select("window_start", "volume", F.when(score > 0, "spike").otherwise("drop").alias("direction"), F.round(score, 4).alias("z"))


def stream_spikes(df: DataFrame, ts: str, store: str, alerts: str, checkpoint: str, size: str = "1 day", slide: str = "6 hours"):
    """Keep window counts in a keyed store and rewrite the spike table after every micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_keyed(batch.withColumn("seen", _L(batch_id)), store, "window_start", "seen", buckets=8, batch_id=batch_id)
        spark = batch.sparkSession
        score_spikes(spark.read.parquet(store).select("window_start", "volume")).write.mode("overwrite").parquet(alerts)

    return sliding_volume(df, ts, size, slide).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(df: DataFrame, key: str, ts: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without a message."""
    return (df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events"))
            .select(key, _C("session_window.start").alias("session_start"), _C("session_window.end").alias("session_end"), "n_events"))


def signatures(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Frequency and span per signature."""
    return df.groupBy(key).agg(F.count("*").alias("frequency"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def stream_signatures(df: DataFrame, key: str, ts: str, store: str, checkpoint: str):
    """Running signature counters, upserted into a keyed store."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_keyed(batch, store, key, "last_seen", batch_id=batch_id)

    return signatures(df, key, ts).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _retry_processor(window_seconds: int):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    span = window_seconds // 60

    class RetryLoops(StatefulProcessor):
        """Arrivals of one key by minute and its newest minute; reports while the window before that holds enough.

        One timer stands at the end of the oldest minute held. When it fires, the minutes that no later row can share a
        window with go, and the timer moves to the next one.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.minutes = handle.getMapState("minutes", "minute long", "n long")
            self.newest = handle.getValueState("newest", "minute long")

        def _forget(self, before: int) -> dict[int, int]:
            held = {minute: n for (minute,), (n,) in self.minutes.iterator()}
            for minute in [m for m in held if m < before]:
                self.minutes.removeKey((minute,))
                del held[minute]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer((min(held) + span + 1) * 60_000)
            return held

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seen = self.newest.get()
            newest, least = (seen[0] if seen else None), 0
            for pdf in rows:
                minutes = pd.to_datetime(pdf["ts"]).dt.floor("min").astype("datetime64[s]").astype("int64") // 60
                least = int(pdf["least"].iloc[0])
                for minute, n in minutes.value_counts().items():
                    old = self.minutes.getValue((int(minute),))
                    self.minutes.updateValue((int(minute),), ((old[0] if old else 0) + int(n),))
                    newest = int(minute) if newest is None else max(newest, int(minute))
            if newest is None:
                return
            self.newest.update((newest,))
            held = self._forget(newest - span)
            if sum(held.values()) >= least:
                yield pd.DataFrame({"entity": [key[0]], "kind": pd.Series([key[1]], dtype="object"), "occurrences": [sum(held.values())], "first_minute": [min(held)], "last_minute": [newest]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # Rows to come are no older than the watermark.
            self._forget(timerValues.getCurrentWatermarkInMs() // 60_000 - span)
            return iter(())

        def close(self) -> None:
            pass

    return RetryLoops()


RETRY_SCHEMA = T.StructType([T.StructField("entity", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("occurrences", T.LongType()),
                             T.StructField("first_minute", T.LongType()), T.StructField("last_minute", T.LongType())])


def stream_retry_loops(
    df: DataFrame, entity: str, kind: str, ts: str, threshold: int | None = None, window_seconds: int = 3600, late: str = "1 hour",
    fast: Sequence[str] = tuple(RETRY_TYPES), benign: Sequence[str] = tuple(BENIGN_TYPES), fast_min: int = 5, slow_min: int = 8,
) -> DataFrame:
    """Repeats per entity and kind within a window before its newest event, one row whenever a batch finds enough.

    Thresholds go by kind as in the batch operator (``threshold`` sets one for all); benign kinds are left out. State per
    key is the counts by minute of one window and of the watermark's delay. Rows without an entity, kind or time are left out.
    """
    least = F.when(_C(kind).isin(list(fast)), fast_min).otherwise(slow_min) if threshold is None else _L(threshold)
    src = df.filter(~_C(kind).isin(list(benign)) & _C(entity).isNotNull() & _C(ts).isNotNull())
    src = src.select(_C(entity).cast("long").alias("entity"), _C(kind).alias("kind"), _C(ts).alias("ts"), least.alias("least")).withWatermark("ts", late)
    return src.groupBy("entity", "kind").transformWithStateInPandas(
        statefulProcessor=_retry_processor(window_seconds), outputStructType=RETRY_SCHEMA, outputMode="Append", timeMode="EventTime")


def missing_followups(df: DataFrame, entity: str, kind: str, ts: str, key: str, trigger: str, expected: str, max_seconds: int, late: str = "1 hour") -> DataFrame:
    """Triggers without the expected event in time; a row leaves once the watermark has passed its deadline."""
    a = df.filter(_C(kind) == trigger).select(_C(key).alias("trigger_id"), _C(entity).alias("entity"), _C(ts).alias("trigger_ts")).withWatermark("trigger_ts", late)
    b = df.filter(_C(kind) == expected).select(_C(entity).alias("b_entity"), _C(ts).alias("follow_ts")).withWatermark("follow_ts", late)
    on = (_C("entity") == _C("b_entity")) & (_C("follow_ts") >= _C("trigger_ts")) & (_C("follow_ts") <= _C("trigger_ts") + F.expr(f"INTERVAL {max_seconds} SECONDS"))
    return a.join(b, on, "left_outer").filter("follow_ts is null").select("trigger_id", "entity", "trigger_ts")


def dedupe(df: DataFrame, keys: Sequence[str], ts: str, within: str = "1 hour") -> DataFrame:
    """First event per key within the watermark delay; on a batch the first per key."""
    marked = df.withWatermark(ts, within)
    return marked.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def late_policy(df: DataFrame, ts: str, severity: str, tags: str, as_of: Column, late: str = "1 hour", hours: int = 48, name: str = "late_policy") -> DataFrame:
    """Tag future and stale rows and count both through an observation; truly late rows are dropped by the watermark."""
    tagged = tag_stale(df.withWatermark(ts, late), ts, severity, tags, as_of, hours)
    return tagged.observe(name, F.count(_L(1)).alias("rows"), F.count_if(F.array_contains(tags, "future_timestamp")).alias("future"), F.count_if(F.array_contains(tags, "stale")).alias("stale"))


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, by query id, over the whole run of each query.

    Spark keeps the progress of about the last hundred batches only; a listener hears of every batch. Register it with
    ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def count(self, query, wait_seconds: float = 30.0) -> int:
        """Rows dropped so far by a query. Of a query that has ended, all: events arrive in order, the end last."""
        until = time.monotonic() + wait_seconds
        while not query.isActive and str(query.id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.dropped.get(str(query.id), 0)


def enrich(df: DataFrame, catalog: DataFrame, key: str, fallbacks: dict[str, str]) -> DataFrame:
    """Left join with a static catalog, re-read per micro-batch, with fallbacks for unknown keys."""
    return df.join(catalog, key, "left").withColumns({c: F.coalesce(_C(c), _L(v)) for c, v in fallbacks.items()})


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process all available input into Parquet and stop."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    return df.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
