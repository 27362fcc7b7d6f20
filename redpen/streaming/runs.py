"""State of runs and conversations, kept by Structured Streaming's own aggregation state.

The functions only declare the aggregation, so that the same code serves a stream (update or complete
mode, state in the checkpoint) and a batch. State grows with the number of keys; a watermark on the
event time bounds it where keys end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def latest_messages(messages: DataFrame, thread: str = "thread_id", message: str = "message_id", seq: str = "seq") -> DataFrame:
    """Messages of each thread; a later row replaces an earlier one with the same id and keeps its first position."""
    last = F.max_by(F.struct("role", "content"), F.col(seq)).alias("last")
    return messages.groupBy(thread, message).agg(F.min(seq).alias("position"), last).select(thread, message, "position", "last.*")


def run_states(rows: DataFrame, run: str = "run_id", ts: str = "ts", event: str = "event", limit_s: int = 900, steps: int = 100) -> DataFrame:
    """(run, n_events, status, over_cap): finished, cancelled, timeout or running; whether it went over its cap of steps."""
    seconds = F.unix_seconds(F.max(F.col(ts).cast("timestamp"))) - F.unix_seconds(F.min(F.col(ts).cast("timestamp")))
    out = rows.groupBy(run).agg(F.count("*").alias("n_events"), F.max(F.col(event) == "finished").alias("finished"), F.max(F.col(event) == "cancelled").alias("cancelled"), seconds.alias("seconds"))
    status = F.when(F.col("finished"), "finished").when(F.col("cancelled"), "cancelled").when(F.col("seconds") > limit_s, "timeout").otherwise("running")
    return out.select(run, "n_events", status.alias("status"), (F.col("n_events") > steps).alias("over_cap"))


def commands(requests: DataFrame, states: DataFrame, run: str = "run_id") -> DataFrame:
    """Answer to cancel requests: not_found, already_completed or cancelling."""
    answer = F.when(F.col("status").isNull(), "not_found").when(F.col("status").isin("finished", "cancelled"), "already_completed").otherwise("cancelling")
    return requests.select(run).join(states.select(run, "status"), run, "left").select(run, answer.alias("answer"))


def write_log(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to JSON Lines files until what is there now has been read."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
