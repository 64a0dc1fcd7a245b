"""Session history, turn pairs, clears and votes.

A session is cut into blocks of ``block_turns`` turn numbers, and windows run per
(session, block), so the turns of one very long session are spread over many
tasks. A table with one row per block carries what crosses a block edge. Turn
numbers are unique within a session.

History is never copied into each turn: a turn holds the length of its prefix of
the session log, which is one number instead of a list that grows with the turn.
Message lists are written as rows (request, position, role, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.operators.skew import ROWS_PER_SLICE, sliced_join

BLOCK_TURNS = 10_000
# The roles that make up history.
HISTORY_ROLES = ["user", "assistant"]

_BLOCK = "_block"


def is_history(role: Column | str = "role") -> Column:
    return (F.col(role) if isinstance(role, str) else role).isin(HISTORY_ROLES)


def _blocked(turns: DataFrame, turn: str, block_turns: int) -> DataFrame:
    return turns.withColumn(_BLOCK, F.floor(F.col(turn) / block_turns).cast("long"))


def history_index(
    turns: DataFrame,
    session: str = "conv_id",
    turn: str = "turn",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Add ``history_len``: how many user and assistant messages came before the turn.

    The history of a turn is the first ``history_len`` rows of its session's log.
    """
    rows = _blocked(turns, turn, block_turns)
    inside = Window.partitionBy(session, _BLOCK).orderBy(turn)
    before = Window.partitionBy(session).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(session, _BLOCK).agg(F.count_if(is_history()).alias("_in_block"))
    offsets = (
        counts.withColumn("_offset", F.sum("_in_block").over(before))
        # First blocks need no offset, so short sessions add nothing to the join.
        .where(F.col("_offset") > 0)
        .drop("_in_block")
    )
    earlier = F.count_if(is_history()).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
        .join(offsets, [session, _BLOCK], "left")
        .withColumn("history_len", F.col("_earlier") + F.coalesce("_offset", F.lit(0)))
        .drop(_BLOCK, "_earlier", "_offset")
    )


def session_log(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The history messages with their ``position`` in the session, from 0."""
    return (
        history_index(turns.where(is_history()), session, turn)
        .withColumnRenamed("history_len", "position")
    )


def open_requests(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last user turn of every session: the one that waits for an answer."""
    last = F.max_by(F.struct(turn, "text"), turn)
    return (
        turns.where(F.col("role") == "user")
        .groupBy(session)
        .agg(last.alias("last"))
        .select(session, F.col(f"last.{turn}").alias("request_turn"), F.col("last.text").alias("question"))
    )


def history_lookup(
    requests: DataFrame,
    turns: DataFrame,
    session: str = "conv_id",
    turn: str = "turn",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """History rows of each request, one open request per session; none if there are none.

    ``requests`` is (session, request_turn). The session's turns are sliced, so a
    long session does not meet its request in one task.
    """
    joined = sliced_join(
        turns.where(is_history()), requests, [session], [turn], "inner", rows_per_slice
    )
    return joined.where(F.col(turn) < F.col("request_turn"))


def history_of_requests(
    requests: DataFrame,
    turns: DataFrame,
    session: str = "conv_id",
    turn: str = "turn",
    request_id: str = "request_id",
    block_turns: int = BLOCK_TURNS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The history rows before each request, any number of requests a session.

    ``requests`` is (request_id, session, request_turn). An as-of join: a request meets the
    blocks of its session's turns up to its own block, one (session, block) key each, and
    turns are compared in its own block only. Requests of a key are sliced, so neither a long
    session nor one of many requests meets in one task. The result has a row for each
    request and earlier message, as a model's message list needs.
    """
    rows = _blocked(turns.where(is_history()), turn, block_turns)
    blocks = rows.select(session, _BLOCK).distinct()
    own = F.floor(F.col("request_turn") / block_turns).cast("long")
    asked = sliced_join(
        requests.select(request_id, session, "request_turn"),
        blocks.groupBy(session).agg(F.collect_list(_BLOCK).alias("_blocks")),
        [session], [request_id], "inner", rows_per_slice,
    )
    earlier = asked.select(
        request_id,
        session,
        "request_turn",
        F.explode(F.filter("_blocks", lambda b: b <= own)).alias(_BLOCK),
    )
    # turns of a block are few; a key's requests may be many
    limit = max(1, rows_per_slice // block_turns)
    joined = sliced_join(earlier, rows, [session, _BLOCK], [request_id], "inner", limit)
    return joined.where(F.col(turn) < F.col("request_turn")).drop(_BLOCK, "request_turn")


def answered_turns(
    answered: DataFrame,
    session: str = "session_id",
    turn: str = "turn",
    question: str = "pivot_text",
    answer: str = "pivot_answer",
) -> DataFrame:
    """(session, turn, role, text) of finished requests: the question keeps its turn, the
    answer takes the next. Requests without an answer add nothing."""
    both = F.array(
        F.struct(F.col(turn).alias("turn"), F.lit("user").alias("role"), F.col(question).alias("text")),
        F.struct(
            (F.col(turn) + 1).alias("turn"), F.lit("assistant").alias("role"), F.col(answer).alias("text")
        ),
    )
    done = answered.where(F.col(answer).isNotNull()).select(session, F.explode(both).alias("t"))
    return done.select(session, F.col("t.turn").alias(turn), "t.role", "t.text")


def with_answers(
    turns: DataFrame, finished: DataFrame, session: str = "session_id", turn: str = "turn"
) -> DataFrame:
    """The log and the finished turns that it does not hold yet, told by their numbers."""
    columns = [session, turn, "role", "text"]
    known = turns.select(session, turn).distinct()
    return turns.select(columns).unionByName(
        finished.select(columns).join(known, [session, turn], "left_anti")
    )


def turn_pairs(
    turns: DataFrame,
    session: str = "conv_id",
    turn: str = "turn",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """User turns directly followed by an assistant turn, with that reply."""
    rows = _blocked(turns.where(is_history()), turn, block_turns)
    inside = Window.partitionBy(session, _BLOCK).orderBy(turn)
    message = F.struct(F.col("role"), F.col("text"))
    heads = rows.groupBy(session, _BLOCK).agg(F.min_by(message, turn).alias("_head"))
    following = heads.select(
        session,
        _BLOCK,
        F.lead("_head").over(Window.partitionBy(session).orderBy(_BLOCK)).alias("_after"),
    ).where(F.col("_after").isNotNull())
    paired = (
        rows.withColumn("_next", F.lead(message).over(inside))
        .where(F.col("role") == "user")
        .join(following, [session, _BLOCK], "left")
        .withColumn("_next", F.coalesce("_next", "_after"))
    )
    return paired.where(F.col("_next.role") == "assistant").select(
        session, turn, F.col("text").alias("question"), F.col("_next.text").alias("reply")
    )


def clear_sessions(
    turns: DataFrame,
    clears: DataFrame,
    session: str = "conv_id",
    turn: str = "turn",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Drop turns at or before the last clear of their session.

    ``clears`` is (session, clear_turn); clearing an unknown session does nothing.
    """
    last = clears.groupBy(session).agg(F.max("clear_turn").alias("_cleared"))
    joined = sliced_join(turns, last, [session], [turn], "left", rows_per_slice)
    kept = F.col("_cleared").isNull() | (F.col(turn) > F.col("_cleared"))
    return joined.where(kept).drop("_cleared")


def clear_status(clears: DataFrame, session: str = "conv_id") -> DataFrame:
    """Every clear reports success, known session or not."""
    return clears.select(session).distinct().withColumn("status", F.lit("cleared"))


def first_vote(
    votes: DataFrame, message: str = "message_id", time: str = "ts", event: str = "event_id"
) -> DataFrame:
    """The earliest vote per message; a partial aggregate, so no message is sorted."""
    rest = [c for c in votes.columns if c != message]
    first = F.min_by(F.struct(*rest), F.struct(time, event))
    return votes.groupBy(message).agg(first.alias("first")).select(message, "first.*")


def answer_messages(
    requests: DataFrame,
    history: DataFrame,
    system: Column,
    request_id: str,
    question: str = "question",
    order: str = "turn",
) -> DataFrame:
    """(request, role, content, sort_key) rows: system, history oldest first, question.

    ``history`` rows carry the request id. ``sort_key`` orders the messages of a
    request; it need not be dense.
    """
    low, high = -(2**62), 2**62
    opening = requests.select(
        request_id, F.lit("system").alias("role"), system.alias("content"),
        F.lit(low).alias("sort_key"),
    )
    middle = history.select(
        request_id, "role", F.col("text").alias("content"), F.col(order).cast("long").alias("sort_key")
    )
    closing = requests.select(
        request_id, F.lit("user").alias("role"), F.col(question).alias("content"),
        F.lit(high).alias("sort_key"),
    )
    return opening.unionByName(middle).unionByName(closing)
