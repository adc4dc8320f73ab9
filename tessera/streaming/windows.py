"""Event-time windows over streams of events (event_id, ts, user_id, event_type, value), with bounded state.

All take and return DataFrames, streaming or not. The watermark bounds how long a window's state is kept; later rows
are dropped by it in a stream, as nothing can be kept for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; ts as a timestamp."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id that come within the watermark of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, total) of tumbling, or with a slide of sliding, windows."""
    g = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size, slide).alias("w") if slide else F.window("ts", size).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def presence(events: DataFrame, gap: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """(user_id, start, end, n): stretches of a user's events without a pause of the gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_after(log: DataFrame, after: int | None, most: int = 2048) -> DataFrame:
    """The next events of a log (event_id) after a place, in order; without a place none, as nothing is replayed."""
    return log.where(F.lit(False) if after is None else F.col("event_id") > after).orderBy("event_id").limit(most)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there by now to Parquet files, exactly once over restarts; the checkpoint has to be shared."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def resume(events: DataFrame, after: int | None, ring: int = 2048, key: str = "event_id") -> DataFrame:
    """Events after an id in their order, of the last `ring` that a bus keeps; `lost` says whether some after the id are gone
    already. Without an id nothing is replayed."""
    if after is None:
        return events.where("false").withColumn("lost", F.lit(False))
    kept = events.orderBy(F.desc(key)).limit(ring)
    first = kept.agg(F.min(key).alias("_first"))
    older = events.agg(F.min(key).alias("_oldest"))
    both = kept.where(F.col(key) > after).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(older))  # one row each
    lost = (F.col("_first") > after + 1) & (F.col("_oldest") < F.col("_first"))
    return both.withColumn("lost", lost).drop("_first", "_oldest").orderBy(key)


def in_order(stream: DataFrame, handle, by: str = "session", order: str = "seq", checkpoint: str | None = None):
    """Start a stream whose jobs a handler gets batch by batch, those of a session one after the other: handle(row) runs in
    the task that holds the session."""

    def batch(df: DataFrame, number: int) -> None:
        def run(rows):
            for r in rows:
                handle(r)

        df.repartition(by).sortWithinPartitions(by, order).foreachPartition(run)

    w = stream.writeStream.foreachBatch(batch)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def running_totals(stream: DataFrame, key: str, value: str, late: str, at: str = "ts") -> DataFrame:
    """(key, n, total) after each batch: state kept per key, dropped once a key had no event for `late` of event time."""
    import pandas as pd

    seconds = int(_seconds(late) * 1000)
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames, state) -> list:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + seconds)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    own = stream.withWatermark(at, late).select(key, value, at)
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", "EventTimeTimeout")


def _seconds(text: str) -> float:
    """Seconds of an interval such as `10 minutes`."""
    n, unit = text.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
