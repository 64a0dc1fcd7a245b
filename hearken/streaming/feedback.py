"""Feedback: the first vote on a message stands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "event_id long"


def first_votes(votes: DataFrame, forget_days: int | None = None) -> DataFrame:
    """The first vote of every message, as a stream of rows like ``votes``.

    A message is a key with one number of state: the event that was recorded. Within a
    batch the earliest vote by time, then event, wins; votes of later batches find the state
    and change nothing, and no recorded vote is read again. A key's votes pass in
    pieces, so a popular message needs no memory.

    Without ``forget_days`` state is kept for good. With it, a message's state goes that many
    days of event time after its first vote, and votes that come so late are dropped. A
    message whose first vote has no time keeps its state.
    """
    columns = votes.columns

    def first(
        key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        if not state.exists:
            for piece in pieces:
                if best is not None:
                    piece = pd.concat([best, piece])
                best = piece.sort_values(["ts", "event_id"], kind="stable").head(1)
        if best is not None and len(best):
            state.update((int(best["event_id"].iloc[0]),))
            given = best["ts"].iloc[0]
            if forget_days is not None and not pd.isna(given):
                at = max(state.getCurrentWatermarkMs(), int(given.timestamp() * 1000))
                state.setTimeoutTimestamp(at + forget_days * 86_400_000)
            yield best[columns]

    timeout = GroupStateTimeout.NoTimeout
    if forget_days is not None:
        votes = votes.withWatermark("ts", f"{forget_days} days")
        timeout = GroupStateTimeout.EventTimeTimeout
    return votes.groupBy("message_id").applyInPandasWithState(
        first, T.StructType(votes.schema.fields), _STATE, "append", timeout
    )


def vote_stream(
    votes: DataFrame, recorded: str, checkpoint: str, forget_days: int | None = None
) -> StreamingQuery:
    """Record the first vote of every message; a restart goes on where the last run ended."""
    return (
        first_votes(votes, forget_days)
        .writeStream.format("parquet")
        .option("path", recorded)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_votes(spark: SparkSession, recorded: str) -> DataFrame:
    return spark.read.parquet(recorded)
