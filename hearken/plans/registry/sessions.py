"""Sessions, prompts, intents, translation and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import labels as lb
from hearken.functions import prompts as pr
from hearken.functions.text import word_pattern
from hearken.operators import routing, sessions
from hearken.operators.retrieval import format_context, hits_with_sources, top_k
from hearken.plans.answering import answer_prompts, direct_prompts, grounded_prompts
from hearken.plans.registry.base import clean, query, table
from hearken.plans.registry.vectors import _SOURCED, _nearest_sql, _pairs
from hearken.session import spread

# Words that occur in the test conversations, one set per intent.
SEEN_WORDS = {
    "asking_mental_health_question": ["the", "que"],
    "goodbye": ["and", "des"],
    "greeting": ["la", "of"],
    "gratitude": ["der", "to"],
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


# -- history -----------------------------------------------------------------


@query(
    """SELECT conv_id, turn, role, coalesce(count(*) FILTER (role IN ('user', 'assistant')) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS history_len FROM conversations"""
)
def history_as_of_turn(spark: SparkSession, sf: str) -> DataFrame:
    indexed = sessions.history_index(_turns(spark, sf))
    return indexed.select("conv_id", "turn", "role", "history_len")


@query(
    """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
        AS position FROM conversations WHERE role IN ('user', 'assistant')"""
)
def session_log(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_log(_turns(spark, sf))


_OPEN = """WITH open AS (SELECT conv_id, max(turn) AS request_turn, arg_max(text, turn) AS question
    FROM conversations WHERE role = 'user' GROUP BY conv_id)
"""


@query(_OPEN + "SELECT conv_id, request_turn, question FROM open")
def open_requests(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.open_requests(_turns(spark, sf))


_HISTORY = """, history AS (SELECT c.conv_id, request_turn, turn, role, text
    FROM conversations c JOIN open o ON o.conv_id = c.conv_id AND c.turn < o.request_turn
    WHERE role IN ('user', 'assistant'))
"""


@query(_OPEN + _HISTORY + "SELECT conv_id, request_turn, turn, role, text FROM history")
def history_lookup(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    requests = sessions.open_requests(turns).select("conv_id", "request_turn")
    return sessions.history_lookup(requests, turns)


@query(
    """SELECT conv_id, turn, text AS question, next_text AS reply FROM (
        SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
        FROM conversations WHERE role IN ('user', 'assistant')
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'"""
)
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.turn_pairs(_turns(spark, sf))


def _clears(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are cleared at their first long reply; one clear names no known session."""
    turns = _turns(spark, sf)
    long_reply = (F.col("role") == "assistant") & (F.char_length("text") > 800)
    known = turns.where(long_reply).groupBy("conv_id").agg(F.min("turn").alias("clear_turn"))
    unknown = turns.agg((-F.max("conv_id") - 1).alias("conv_id"), F.max("turn").alias("clear_turn"))
    return known.unionByName(unknown)


_CLEARS = """WITH clears AS (SELECT conv_id, min(turn) AS clear_turn FROM conversations
    WHERE role = 'assistant' AND length(text) > 800 GROUP BY conv_id
    UNION ALL SELECT -max(conv_id) - 1, max(turn) FROM conversations)
"""


@query(
    _CLEARS
    + """SELECT c.conv_id, turn, role FROM conversations c LEFT JOIN clears k
    ON k.conv_id = c.conv_id WHERE clear_turn IS NULL OR turn > clear_turn"""
)
def clear_sessions(spark: SparkSession, sf: str) -> DataFrame:
    kept = sessions.clear_sessions(_turns(spark, sf), _clears(spark, sf))
    return kept.select("conv_id", "turn", "role")


@query(_CLEARS + "SELECT DISTINCT conv_id, 'cleared' AS status FROM clears")
def clear_status(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.clear_status(_clears(spark, sf), "conv_id")


@query(
    """SELECT user_id AS message_id, event_id, event_type AS vote FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
)
def first_vote(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "events").select(
        F.col("user_id").alias("message_id"), "event_id", "ts", F.col("event_type").alias("vote")
    )
    return sessions.first_vote(votes).drop("ts")


# -- reply payloads ----------------------------------------------------------


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{"other":' || to_json(text) || '}'
        ELSE text END AS reply FROM conversations"""
)
def reply_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Replies under different fields, behind an empty first field, or under none."""
    payload = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("message"))))
        .when(
            F.col("role") == "assistant",
            F.to_json(F.struct(F.lit("").alias("answer"), F.col("text").alias("reply"))),
        )
        .otherwise(F.to_json(F.struct(F.col("text").alias("other"))))
    )
    return _turns(spark, sf).select("conv_id", "turn", lb.reply_field(payload).alias("reply"))


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN
        chr(10) || chr(10) || '*[joy • ' || role || ']*' ELSE '' END AS suffix FROM conversations"""
)
def display_suffix(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("role") == "user", "en").when(F.col("role") == "system", "")
    suffix = lb.display_suffix(lang, F.lit("joy"), "role")
    return _turns(spark, sf).select("conv_id", "turn", suffix.alias("suffix"))


# -- requests ----------------------------------------------------------------


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies made of events; three event types give the three kinds of bad ones."""
    body = F.concat(
        F.lit('{"question": "'), "event_type", F.lit('", "session_id": "'),
        F.col("user_id").cast("string"), F.lit('", '), F.expr("substring(props, 2)"),
    )
    payload = (
        F.when(F.col("event_type") == "error", F.rtrim(F.translate(body, "}", " ")))
        .when(F.col("event_type") == "signup", F.col("props"))
        .when(F.col("event_type") == "click", F.regexp_replace(body, '"k": ', '"k": 0.'))
        .when(F.col("event_type") == "view", F.regexp_replace(body, ', "k": [0-9]+', ""))
        .otherwise(body)
    )
    return table(spark, sf, "events").select("event_id", payload.alias("payload"))


@query(
    """SELECT event_id, CASE WHEN reason IS NULL THEN event_type END AS question,
        CASE WHEN reason IS NULL THEN user_id::VARCHAR END AS session_id,
        CASE WHEN reason IS NOT NULL THEN -1 WHEN event_type = 'view' THEN 4
            ELSE (props->>'k')::INTEGER END AS k, reason
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'no question'
        WHEN 'click' THEN 'k is not an integer' END AS reason FROM events)"""
)
def parse_requests(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = routing.parse_requests(_payloads(spark, sf))
    rejects = bad.select("event_id", "reason", F.lit(-1).alias("k"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejects, allowMissingColumns=True
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 4 ELSE (props->>'k')::INTEGER END AS k,
        'en' AS lang, CASE event_type WHEN 'click' THEN 'joy' ELSE 'neutral' END AS emotion,
        CASE WHEN event_type IN ('view', 'error') THEN 'new' ELSE user_id::VARCHAR END AS session
    FROM events"""
)
def request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(kind != "view", F.get_json_object("props", "$.k").cast("int")).alias("k"),
        F.when(kind == "click", "joy").alias("emotion"),
        F.when(kind == "view", F.lit(""))
        .when(kind != "error", F.col("user_id").cast("string"))
        .alias("session_id"),
    )
    # A new id is 36 characters long; its value differs from run to run.
    session = F.when(F.length("session_id") == 36, "new").otherwise(F.col("session_id"))
    return routing.with_defaults(raw).select("event_id", "k", "lang", "emotion", session.alias("session"))


# -- intents -----------------------------------------------------------------


def _sql_intent(lexicon: dict[str, list[str]], text: str) -> str:
    rules = " ".join(
        f"WHEN regexp_matches({clean(text)}, {_q(word_pattern(lexicon[intent]))}) THEN '{intent}'"
        for intent in lb.INTENT_PRIORITY
    )
    return f"CASE {rules} ELSE 'out_of_scope' END"


@query(f"SELECT conv_id, turn, {_sql_intent(SEEN_WORDS, 'text')} AS intent FROM conversations")
def intent_rules(spark: SparkSession, sf: str) -> DataFrame:
    intent = lb.intent_by_rules("text", SEEN_WORDS)
    return _turns(spark, sf).select("conv_id", "turn", intent.alias("intent"))


@query(f"SELECT doc_id, {_sql_intent(lb.INTENT_LEXICON, 'text')} AS intent FROM documents")
def intent_rules_default(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", lb.intent_by_rules("text").alias("intent"))


def _raw_label():
    return (
        F.when(F.col("role") == "user", F.lit(" Greeting\n"))
        .when(F.col("role") == "assistant", F.lit("goodbye."))
    )


_GUARDED = "CASE role WHEN 'user' THEN 'greeting' ELSE 'out_of_scope' END"


@query(f"SELECT conv_id, turn, {_GUARDED} AS intent FROM conversations")
def guard_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A spaced label is valid; one with a full stop or none at all is out of scope."""
    return _turns(spark, sf).select("conv_id", "turn", lb.guard_label(_raw_label()).alias("intent"))


@query(
    f"""SELECT conv_id || '/' || turn AS request_id,
        {_q(pr.INTENT_HEAD)} || text || {_q(pr.INTENT_TAIL)} AS prompt
    FROM conversations WHERE role = 'user'"""
)
def intent_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return routing.intent_requests(_user_turns(spark, sf), text="text")


def _user_turns(spark: SparkSession, sf: str) -> DataFrame:
    request_id = F.concat_ws("/", "conv_id", "turn")
    return _turns(spark, sf).where(F.col("role") == "user").withColumn("request_id", request_id)


@query(
    """SELECT conv_id || '/' || turn AS request_id,
        CASE WHEN turn = 0 THEN 'gratitude' ELSE 'out_of_scope' END AS intent,
        CASE WHEN turn = 0 THEN 'answered' ELSE 'missing' END AS intent_status
    FROM conversations WHERE role = 'user'"""
)
def intent_from_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Only opening turns were answered."""
    users = _user_turns(spark, sf)
    replies = users.where(F.col("turn") == 0).select("request_id", F.lit("GRATITUDE ").alias("reply"))
    return routing.intent_from_replies(users, replies).select(
        "request_id", "intent", "intent_status"
    )


# -- routes and prompts ------------------------------------------------------


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    requests = sessions.open_requests(_turns(spark, sf)).select(
        F.col("conv_id").alias("request_id"),
        "request_turn",
        F.col("question").alias("pivot_text"),
        F.lit("en").alias("lang"),
        F.lit("fear").alias("emotion"),
    )
    return routing.chain(
        requests,
        lambda df: routing.intent_from_rules(df, lexicon=SEEN_WORDS),
        routing.with_route,
    )


_ROUTED = (
    _OPEN
    + f""", routed AS (SELECT conv_id AS request_id, request_turn, question, intent,
        CASE intent WHEN 'asking_mental_health_question' THEN 'grounded' ELSE 'direct' END AS route
    FROM (SELECT *, {_sql_intent(SEEN_WORDS, 'question')} AS intent FROM open))"""
    + _HISTORY
)


@query(_ROUTED + "SELECT request_id, intent, route FROM routed")
def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("request_id", "intent", "route")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return history_lookup(spark, sf).withColumnRenamed("conv_id", "request_id")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Vector ``i`` stands in for the embedded question of conversation ``i``."""
    vectors = table(spark, sf, "embeddings")
    grounded = _routed(spark, sf).where(F.col("route") == routing.GROUNDED)
    asked = grounded.join(vectors, F.col("request_id") == F.col("vec_id")).select("vec_id", "embedding")
    hits = top_k(asked, vectors, 4, "vec_id", "vec_id")
    contexts = format_context(hits_with_sources(hits, _pairs(spark, sf)))
    return contexts.withColumnRenamed("query_id", "request_id")


_CONTEXTS = f""", contexts AS (
    {_nearest_sql('4')} {_SOURCED}
    SELECT query_id AS request_id, string_agg('Client: ' || coalesce(context, '') || chr(10)
        || 'Counselor: ' || response, chr(10) || chr(10) || '---' || chr(10) || chr(10)
        ORDER BY rank) AS context FROM sourced
    WHERE query_id IN (SELECT request_id FROM routed WHERE route = 'grounded')
    GROUP BY query_id),
merged AS (SELECT routed.*, coalesce(context, '') AS context
    FROM routed LEFT JOIN contexts USING (request_id))"""

_LOW, _HIGH = f"(-{2**62})::BIGINT", f"({2**62})::BIGINT"


def _messages_sql(rows: str) -> str:
    system = (
        f"{_q(pr.SYSTEM_LANG)} || 'en' || {_q(pr.SYSTEM_EMOTION)} || 'fear' ||"
        f" {_q(pr.SYSTEM_CONTEXT)} || context"
    )
    return f"""
    SELECT request_id, 'system' AS role, {system} AS content, {_LOW} AS sort_key FROM {rows}
    UNION ALL SELECT r.request_id, role, text, turn FROM history h JOIN {rows} r
        ON r.request_id = h.conv_id
    UNION ALL SELECT request_id, 'user', question, {_HIGH} FROM {rows}"""


@query(_ROUTED + _CONTEXTS + _messages_sql("merged"))
def answer_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt messages of every open request, both routes."""
    return answer_prompts(_routed(spark, sf), _contexts(spark, sf), _history(spark, sf))


@query(
    _ROUTED
    + ", d AS (SELECT *, '' AS context FROM routed WHERE route = 'direct')"
    + _messages_sql("d")
)
def direct_messages(spark: SparkSession, sf: str) -> DataFrame:
    return direct_prompts(_routed(spark, sf), _history(spark, sf))


@query(
    _ROUTED
    + _CONTEXTS
    + ", g AS (SELECT * FROM merged WHERE route = 'grounded')"
    + _messages_sql("g")
)
def grounded_messages(spark: SparkSession, sf: str) -> DataFrame:
    return grounded_prompts(_routed(spark, sf), _contexts(spark, sf), _history(spark, sf))


@query(_ROUTED + _CONTEXTS + "SELECT request_id, route, context FROM merged")
def merge_routes(spark: SparkSession, sf: str) -> DataFrame:
    merged = routing.merge_contexts(_routed(spark, sf), _contexts(spark, sf))
    return merged.select("request_id", "route", "context")


@query(
    _ROUTED
    + """SELECT request_id, CASE route WHEN 'grounded' THEN upper(question)
        ELSE lower(question) END AS question FROM routed"""
)
def branch_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A branch by predicate with a default, recombined as a bag union."""
    routed = _routed(spark, sf).select("request_id", "route", F.col("pivot_text").alias("question"))
    return routing.branch(
        routed,
        F.col("route") == routing.GROUNDED,
        lambda df: df.withColumn("question", F.upper("question")),
        lambda df: df.withColumn("question", F.lower("question")),
    ).select("request_id", "question")


# -- translation -------------------------------------------------------------


@query(
    """SELECT doc_id, 'Translate from ' || lang || ' to en. Return the translation alone.'
        || chr(10) || chr(10) || 'Text: ' || text || chr(10) || chr(10) || 'Translation:' AS prompt
    FROM documents WHERE lang <> 'en'"""
)
def translation_requests(spark: SparkSession, sf: str) -> DataFrame:
    return routing.pivot_requests(table(spark, sf, "documents"), "doc_id", "text")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """German texts got a quoted reply, Spanish ones an empty one, French ones none."""
    docs = table(spark, sf, "documents").where(F.col("lang").isin("de", "es"))
    quoted = F.concat(F.lit('\n"'), F.upper("source"), F.lit('" '))
    reply = F.when(F.col("lang") == "de", quoted).otherwise(F.lit(""))
    return docs.select("doc_id", reply.alias("reply"))


_TRANSLATED = """CASE lang WHEN 'de' THEN upper(source) WHEN 'es' THEN '' ELSE text END"""
_STATUS = """CASE lang WHEN 'en' THEN 'not_needed' WHEN 'fr' THEN 'fallback'
    ELSE 'translated' END"""


@query(
    f"""SELECT doc_id, {_TRANSLATED} AS pivot_text, {_STATUS} AS pivot_text_status
    FROM documents"""
)
def translation_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = routing.pivot_merge(
        table(spark, sf, "documents"), _replies(spark, sf), "doc_id", "text"
    )
    return merged.select("doc_id", "pivot_text", "pivot_text_status")


@query("SELECT doc_id, text AS translated, 'not_needed' AS translated_status FROM documents")
def same_language_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    merged = routing.translation_merge(
        table(spark, sf, "documents"), _replies(spark, sf), F.upper("lang"), F.col("lang"), "doc_id"
    )
    return merged.select("doc_id", "translated", "translated_status")


@query(f"SELECT doc_id, {_TRANSLATED} AS answer, {_STATUS} AS answer_status FROM documents")
def finish_answers(spark: SparkSession, sf: str) -> DataFrame:
    done = routing.finish_answers(
        table(spark, sf, "documents"), _replies(spark, sf), "doc_id", "text"
    )
    return done.select("doc_id", "answer", "answer_status")


@query(
    """SELECT doc_id, 'Translate from en to ' || lang || '. Return the translation alone.'
        || chr(10) || chr(10) || 'Text: ' || text || chr(10) || chr(10) || 'Translation:' AS prompt
    FROM documents WHERE lang <> 'en'"""
)
def finish_requests(spark: SparkSession, sf: str) -> DataFrame:
    return routing.finish_requests(table(spark, sf, "documents"), "doc_id", "text")
