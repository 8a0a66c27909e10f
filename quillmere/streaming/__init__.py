"""Structured Streaming over the trace table: windows with watermarks, sessions, deduplication, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.observability import PENDING_MINUTES, conditions, window_stats
from .alerts import STATE, follow


def trace_stream(spark: SparkSession, path: str, schema: object, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; ts without a zone is read as UTC of the session."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(traces: DataFrame, length: str = "15 minutes", slide: str | None = "1 minute", late: str = "10 minutes", of: tuple[str, ...] = ()) -> DataFrame:
    return window_stats(traces.withWatermark("ts", late), length, slide, of)


def alert_states(stats: DataFrame, pending: int = PENDING_MINUTES, silence: int = 60, late: str = "1 minute", of: tuple[str, ...] = ()) -> DataFrame:
    """Windows that `windowed_stats` wrote, read as a stream -> (of..., alert, start, state), a row for each alert and window in
    order of time: inactive, pending (the condition holds, but not yet in every window of the last pending minutes) or firing.
    Where no window comes for silence minutes of event time there is a row expired, by a timer, and the alert begins anew.

    Spark allows no state of one's own after a windowed aggregate in one query, so the windows go through a sink, which
    hands on only whole batches. All of it that is there is read in one batch, as files within a batch have no order (no limit of files a trigger).
    A firing row is one that `observability.alerts` flags over the same windows. Kept for each key: the windows of the last pending minutes."""
    flags = [F.struct(F.lit(name).alias("alert"), F.coalesce(c, F.lit(False)).alias("holds"), F.lit(0 if name == "cost_spike" else 60 * pending).alias("wait")) for name, c in conditions().items()]
    rows = stats.withWatermark("start", late).select(*of, "start", F.explode(F.array(*flags)).alias("x")).select(*of, "start", "x.*")
    kinds = dict(stats.dtypes)
    states = ", ".join([*(f"{c} {kinds[c]}" for c in of), "alert string, start timestamp, state string"])
    return rows.groupBy(*of, "alert").applyInPandasWithState(follow(60 * silence, [*of, "alert"]), states, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(traces: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, events): runs of events without a pause of gap."""
    s = traces.withWatermark("ts", late) if traces.isStreaming else traces
    g = s.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_traces(traces: DataFrame, key: str = "trace_id", late: str = "10 minutes") -> DataFrame:
    return traces.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there to parquet files, once, exactly once over restarts."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
