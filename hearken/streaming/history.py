"""Session history from a stream of messages and clear events.

Messages are an append-only log and need no state. What is kept per session is one
number, the turn of its last clear, as the state of a streaming aggregate that
combines before the exchange. A session with a large part of all events is thus
never gathered. History is read back with ``clear_sessions`` and
``history_lookup``, as from any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearken.operators.sessions import clear_sessions
from hearken.sources import schemas

# Fixed value: the kind of an event that forgets the session so far.
CLEAR = "clear"


def last_clears(events: DataFrame) -> DataFrame:
    """Keyed state: the turn of the last clear of each session."""
    return (
        events.where(F.col("kind") == CLEAR)
        .groupBy("session_id")
        .agg(F.max("turn").alias("clear_turn"))
    )


def record_messages(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every message to the log; the file sink writes each batch once."""
    messages = events.where(F.col("kind") != CLEAR).select("session_id", "turn", "role", "text")
    return (
        messages.writeStream.format("parquet")
        .option("path", log)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def record_clears(events: DataFrame, clears: str, checkpoint: str) -> StreamingQuery:
    """Write the sessions whose last clear moved, one folder per batch.

    A batch that runs again overwrites its folder, and readers take the largest
    turn per session, so old folders do no harm.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{clears}/batch={batch_id}")

    return (
        last_clears(events)
        .writeStream.foreachBatch(run)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_history(spark: SparkSession, log: str, clears: str) -> DataFrame:
    """Messages after the last clear of their session."""
    messages = spark.read.schema(schemas.TURN).parquet(log)
    return clear_sessions(
        messages, spark.read.schema(schemas.CLEAR).parquet(clears), "session_id", "turn"
    )
