"""Requests, model replies, intents, routes and translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.labels import (
    ASKING,
    DEFAULT_EMOTION,
    DEFAULT_K,
    PIVOT,
    guard_label,
    intent_by_rules,
    needs_pivot,
)
from hearken.functions.prompts import intent_prompt, system_message, translation_prompt
from hearken.functions.text import is_blank, tidy_reply

GROUNDED, DIRECT = "grounded", "direct"

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    """Run stages in order; a stage adds columns and keeps the ones it was given."""
    for stage in stages:
        df = df.transform(stage)
    return df


# -- requests ----------------------------------------------------------------


def parse_requests(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Typed requests, and the rows that are not valid ones with a ``reason``.

    A request is a JSON object with a ``question``; ``session_id`` is optional and
    ``k`` defaults. A ``k`` that is no integer makes the request invalid.
    """
    parsed = raw.withColumn(
        "_r",
        F.from_json(
            payload,
            "question string, session_id string, k string, _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ),
    )
    k = F.col("_r.k")
    reason = (
        F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "malformed")
        .when(F.col("_r.question").isNull(), "no question")
        .when(k.isNotNull() & k.try_cast("int").isNull(), "k is not an integer")
    )
    marked = parsed.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).select(
        *[c for c in raw.columns if c != payload],
        F.col("_r.question").alias("question"),
        F.col("_r.session_id").alias("session_id"),
        F.coalesce(k.try_cast("int"), F.lit(DEFAULT_K)).alias("k"),
    )
    return good, marked.where(F.col("reason").isNotNull()).drop("_r")


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill language, emotion, ``k`` and session id where absent.

    A missing or empty session id gets a new one; a blank one is kept. New ids are
    random, so store the result before using it twice.
    """
    values = {"lang": F.lit(PIVOT), "emotion": F.lit(DEFAULT_EMOTION), "k": F.lit(DEFAULT_K)}
    for name, value in values.items():
        df = df.withColumn(name, F.coalesce(name, value) if name in df.columns else value)
    if "session_id" not in df.columns:
        return df.withColumn("session_id", F.uuid())
    given = F.coalesce("session_id", F.lit(""))
    return df.withColumn("session_id", F.when(given == "", F.uuid()).otherwise(given))


# -- model replies -----------------------------------------------------------


def join_replies(df: DataFrame, replies: DataFrame, key: str = "request_id") -> DataFrame:
    """Add ``reply``, null where none came.

    Several replies to one row count once, and an empty retry never hides a reply: of those
    that say something the one of the last ``attempt`` counts, if the replies have such a
    column, else the least.
    """
    says = F.trim("reply") != ""
    if "attempt" in replies.columns:
        last = F.struct("attempt", "reply")
        said, any_ = (F.max(F.when(when, last))["reply"] for when in (says, F.col("reply").isNotNull()))
    else:
        said, any_ = F.min(F.when(says, F.col("reply"))), F.min("reply")
    one = replies.groupBy(key).agg(F.coalesce(said, any_).alias("reply"))
    return df.join(one, key, "left")


def intent_requests(df: DataFrame, key: str = "request_id", text: str = "pivot_text") -> DataFrame:
    return df.select(key, intent_prompt(text).alias("prompt"))


def intent_from_replies(
    df: DataFrame, replies: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Add the guarded ``intent`` and where it came from; no reply is out of scope."""
    joined = join_replies(df, replies, key)
    status = F.when(F.col("reply").isNull(), "missing").otherwise("answered")
    return (
        joined.withColumn("intent", guard_label("reply"))
        .withColumn("intent_status", status)
        .drop("reply")
    )


def intent_from_rules(df: DataFrame, text: str = "pivot_text", lexicon=None) -> DataFrame:
    return df.withColumn("intent", intent_by_rules(text, lexicon))


# -- routes ------------------------------------------------------------------


def with_route(df: DataFrame) -> DataFrame:
    """Only a mental-health question is answered from retrieved pairs."""
    asks = F.coalesce(F.col("intent") == ASKING, F.lit(False))
    return df.withColumn("route", F.when(asks, GROUNDED).otherwise(DIRECT))


def branch(
    df: DataFrame, predicate: Column, then: Stage, otherwise: Stage
) -> DataFrame:
    """Rows that meet the predicate go through one stage, all others through the default."""
    chosen = F.coalesce(predicate, F.lit(False))
    return then(df.where(chosen)).unionByName(otherwise(df.where(~chosen)))


def merge_contexts(df: DataFrame, contexts: DataFrame, key: str = "request_id") -> DataFrame:
    """Join contexts back to the routed requests; the direct route has empty context."""
    return df.join(contexts, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def request_system_message(context: Column | str = "context") -> Column:
    return system_message(
        F.coalesce("lang", F.lit(PIVOT)), F.coalesce("emotion", F.lit(DEFAULT_EMOTION)), context
    )


# -- translation -------------------------------------------------------------


def _differs(source: Column, target: Column) -> Column:
    return F.lower(source) != F.lower(target)


def translation_requests(
    df: DataFrame,
    source: Column,
    target: Column,
    key: str = "request_id",
    text: str = "text",
) -> DataFrame:
    """(key, prompt) of the rows whose source and target language differ."""
    return df.where(_differs(source, target)).select(
        key, translation_prompt(source, target, text).alias("prompt")
    )


def translation_merge(
    df: DataFrame,
    replies: DataFrame,
    source: Column,
    target: Column,
    key: str = "request_id",
    text: str = "text",
    out: str = "translated",
) -> DataFrame:
    """Add the tidied translation. Same language keeps the text, and so does a missing
    reply; an empty reply stays empty."""
    joined = join_replies(df, replies, key)
    same = ~_differs(source, target)
    status = (
        F.when(same, "not_needed")
        .when(F.col("reply").isNull(), "fallback")
        .otherwise("translated")
    )
    value = F.when(same, F.col(text)).otherwise(F.coalesce(tidy_reply("reply"), F.col(text)))
    return joined.withColumn(out, value).withColumn(f"{out}_status", status).drop("reply")


def pivot_requests(df: DataFrame, key: str = "request_id", text: str = "question") -> DataFrame:
    """Prompts that bring foreign text to the pivot language."""
    return translation_requests(
        df.where(needs_pivot("lang") & ~is_blank(text)), F.col("lang"), F.lit(PIVOT), key, text
    )


def pivot_merge(
    df: DataFrame, replies: DataFrame, key: str = "request_id", text: str = "question"
) -> DataFrame:
    """Add ``pivot_text`` and keep the original text."""
    foreign = F.when(needs_pivot("lang"), F.col("lang")).otherwise(F.lit(PIVOT))
    return translation_merge(df, replies, foreign, F.lit(PIVOT), key, text, "pivot_text")


def finish_requests(df: DataFrame, key: str = "request_id", text: str = "pivot_answer") -> DataFrame:
    """Prompts that bring pivot-language answers back to the user's language."""
    return translation_requests(
        df.where(needs_pivot("lang")), F.lit(PIVOT), F.col("lang"), key, text
    )


def finish_answers(
    df: DataFrame, replies: DataFrame, key: str = "request_id", text: str = "pivot_answer"
) -> DataFrame:
    """Add ``answer`` in the user's language; unchanged for pivot-language users."""
    target = F.when(needs_pivot("lang"), F.col("lang")).otherwise(F.lit(PIVOT))
    return translation_merge(df, replies, F.lit(PIVOT), target, key, text, "answer")
