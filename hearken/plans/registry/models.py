"""Trained models: language, emotion, outside scorers, and the flows around them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators import models, sessions
from hearken.operators.embedding import embed, embed_with, fit_embedder
from hearken.operators.profile import assign_split
from hearken.operators.retrieval import top_k
from hearken.plans.answering import Replies, answer_requests, enrich_requests
from hearken.plans.registry.base import query, table
from hearken.plans.registry.text import _BUCKETS, _SPLIT
from hearken.plans.training import train_emotion_model, train_language_model
from hearken.session import scratch_path, spread, store

QUALITY = {0: "low", 1: "high"}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return spread(assign_split(docs))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return _documents(spark, sf).join(labels, "doc_id")


def _of_split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def language_model(spark: SparkSession, sf: str) -> models.TextModel:
    return models.train_language(_of_split(_documents(spark, sf), "train"))


def emotion_model(spark: SparkSession, sf: str) -> models.TextModel:
    train = _of_split(_labelled(spark, sf), "train")
    return models.train_emotion(train, label="quality", names=QUALITY)


@query()
def language_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, from a model that saw the training split."""
    model = language_model(spark, sf)
    return models.score(model, _documents(spark, sf)).select(
        "doc_id",
        "lang",
        F.col("predicted.label").alias("predicted"),
        F.round("predicted.confidence", 3).alias("confidence"),
    )


@query()
def language_training(spark: SparkSession, sf: str) -> DataFrame:
    """Train on two languages, save, and report on the test split."""
    out = scratch_path(spark, "language")
    _, report = train_language_model(_documents(spark, sf), out, ["en", "fr"])
    return report


_SPLITS = f"SELECT *, {_SPLIT} AS split FROM ({_BUCKETS})"


def _held(scored: DataFrame, labels: list[str]) -> DataFrame:
    """What must hold for every prediction, from ``predicted`` and its probabilities."""
    p = F.col("predicted")
    values = F.map_values("predicted.probs")
    return scored.select(
        "doc_id",
        F.array_join(F.array_sort(F.map_keys("predicted.probs")), ",").alias("labels"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        (F.element_at(p["probs"], p["label"]) == F.array_max(values)).alias("label_is_likeliest"),
        (p["confidence"] == F.array_max(values)).alias("confidence_is_its_probability"),
        p["label"].isin(labels).alias("label_is_known"),
    )


_HELD = "1.0::DOUBLE AS total, true AS label_is_likeliest, true AS confidence_is_its_probability, true AS label_is_known"


@query(
    f"""SELECT doc_id, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM ({_SPLITS})
            WHERE split = 'train') AS labels, {_HELD} FROM documents"""
)
def language_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's probabilities are of the trained languages, add up and agree with the label."""
    model = language_model(spark, sf)
    return _held(models.score(model, _documents(spark, sf)), model.labels)


@query(f"SELECT doc_id, 'high,low' AS labels, {_HELD} FROM documents")
def emotion_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the class-weighted classifier, whose labels are given."""
    model = emotion_model(spark, sf)
    return _held(models.score(model, _documents(spark, sf)), model.labels)


@query(
    f"""WITH t AS ({_SPLITS}), test AS (SELECT lang, count(*) AS n FROM t
        WHERE split = 'test' AND lang IN ('en', 'fr') GROUP BY lang)
    SELECT lang AS label, n AS support FROM test
    UNION ALL SELECT unnest(['macro', 'weighted']), (SELECT sum(n)::BIGINT FROM test)"""
)
def training_support(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the test split behind every line of the saved language model's report."""
    return language_training(spark, sf).select("label", F.col("support").cast("long").alias("support"))


@query()
def emotion_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Label, confidence and all probabilities of every document."""
    model = emotion_model(spark, sf)
    scored = models.score_emotion(model, _documents(spark, sf), detail="all")
    return scored.select(
        "doc_id",
        "emotion",
        F.round("emotion_confidence", 3).alias("confidence"),
        *[F.round(F.col("all_probabilities")[x], 3).alias(x) for x in QUALITY.values()],
    )


@query()
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by validation weighted F1; the best one is saved and tested."""
    out = scratch_path(spark, "emotion")
    candidates = [{"c": c} for c in (1.0, 0.1)]
    _, tried, tested = train_emotion_model(
        _labelled(spark, sf), out, QUALITY, candidates, "quality"
    )
    measures = ["loss", "accuracy", "f1_weighted"]
    return tried.select("setting", *measures).unionByName(
        tested.select(F.lit("best, on test").alias("setting"), *measures)
    )


@query("SELECT doc_id, true AS same FROM documents")
def saved_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model read back scores like the one that was saved."""
    path = scratch_path(spark, "model")
    model = language_model(spark, sf)
    models.save_model(model, path)
    docs = _documents(spark, sf)
    now = models.score_language(model, docs, out="now")
    both = models.score_language(models.load_model(path), now, out="later")
    return both.select("doc_id", F.expr("now = later").alias("same"))


def _letter_scorer():
    """Stand-in for an outside model: scores from counts of three letters."""

    def run(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(x) / max(len(t), 1) * 10 for x in "aeo"] for t in texts])

    return run


def _letters(column: str) -> str:
    return ", ".join(
        f"(length({column}) - length(replace({column}, '{x}', '')))"
        f" / greatest(length({column}), 1) * 10.0" for x in "aeo"
    )


@query(
    f"""WITH s AS (SELECT doc_id, [{_letters('text')}] AS v FROM documents),
    e AS (SELECT doc_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s),
    p AS (SELECT doc_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
    SELECT doc_id, ['a', 'e', 'o'][list_position(p, list_max(p))] AS label,
        round(list_max(p), 6) AS confidence FROM p"""
)
def batched_scores(spark: SparkSession, sf: str) -> DataFrame:
    """An outside scorer, loaded once per task and called in mini-batches."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    scored = models.score_with(docs, _letter_scorer, ["a", "e", "o"])
    return scored.select(
        "doc_id",
        F.col("predicted.label").alias("label"),
        F.round("predicted.confidence", 6).alias("confidence"),
    )


@query(
    f"""WITH s AS (SELECT doc_id, [{_letters('text')}] AS v FROM documents)
    SELECT doc_id, round(v[1] / greatest(sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]), 1e-12), 4)
        AS first FROM s"""
)
def outside_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from an outside encoder, scaled to unit length."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    first = F.col("embedding")[0].cast("double")
    return embed_with(docs, _letter_scorer).select("doc_id", F.round(first, 4).alias("first"))


# -- flows -------------------------------------------------------------------


def requests_of(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn as a request."""
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("/", "conv_id", "turn").alias("request_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("text").alias("question"),
        (F.col("turn") % 3 + 1).cast("int").alias("k"),
        "conv_id",
        "turn",
    )


def pivot_replies_of(requests: DataFrame) -> DataFrame:
    """Pretended translations: the question in capitals, for even turns only."""
    return requests.where(F.col("turn") % 2 == 0).select(
        "request_id", F.upper("question").alias("reply")
    )


@query()
def enriched_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = requests_of(spark, sf)
    enriched = enrich_requests(
        requests, language_model(spark, sf), emotion_model(spark, sf), pivot_replies_of(requests)
    )
    return enriched.select(
        "request_id", "question", "lang", "pivot_text", "pivot_text_status", "emotion", "intent"
    )


def embedded_documents(spark: SparkSession, sf: str, embedder) -> DataFrame:
    """The collection that answers are drawn from, embedded once and stored."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return store(
        embed(embedder, docs).select(
            "doc_id", F.col("source").alias("context"), F.col("text").alias("response"), "embedding"
        ),
        "collection",
    )


def answer_all(
    spark: SparkSession, sf: str, requests: DataFrame, language, emotion, embedder, vectors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Messages and answers of ``requests`` over ``vectors``, with pretended model replies."""
    turns = table(spark, sf, "conversations")
    numbered = requests.select(
        "request_id",
        F.col("session_id").cast("long").alias("conv_id"),
        F.col("turn").alias("request_turn"),
    )
    history = sessions.history_of_requests(numbered, turns)
    ask = F.lit("asking_mental_health_question")
    replies = Replies(
        pivot=pivot_replies_of(requests),
        answer=requests.where(F.col("turn") < 4).select(
            "request_id", F.concat(F.lit("re: "), "question").alias("reply")
        ),
        finish=requests.select("request_id", F.concat(F.lit('"fin: '), "question", F.lit('"')).alias("reply")),
        intent=requests.select(
            "request_id", F.when(F.col("turn") % 4 == 0, ask).otherwise(F.lit("Thanks.")).alias("reply")
        ),
    )
    return answer_requests(
        requests, language, emotion, vectors, history, replies,
        lambda df: embed(embedder, df, "pivot_text"),
    )


_TURN_OF = "c.conv_id = r.conv_id AND c.turn < r.turn AND c.role IN ('user', 'assistant')"


@query(
    f"""SELECT r.conv_id || '/' || r.turn AS request_id, r.conv_id::VARCHAR AS session_id,
        CASE WHEN r.turn < 4 THEN 'answered' ELSE 'waiting' END AS status,
        CASE WHEN r.turn % 4 = 0 THEN 'asking_mental_health_question' ELSE 'out_of_scope' END AS intent,
        CASE WHEN r.turn % 4 = 0 THEN r.turn % 3 + 1 ELSE 0 END::INTEGER AS n_sources,
        2 + (SELECT count(*) FROM conversations c WHERE {_TURN_OF}) AS n_messages,
        (SELECT coalesce(sum(length(c.text)), 0) FROM conversations c WHERE {_TURN_OF})::BIGINT AS history_chars
    FROM conversations r WHERE r.role = 'user'"""
)
def answered_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each request with its messages, sources and answer; those not answered yet wait."""
    embedder = fit_embedder(table(spark, sf, "documents"))
    prompts, answers = answer_all(
        spark, sf, requests_of(spark, sf), language_model(spark, sf), emotion_model(spark, sf),
        embedder, embedded_documents(spark, sf, embedder),
    )
    middle = F.abs("sort_key") < 2**62
    messages = prompts.groupBy("request_id").agg(
        F.count("*").alias("n_messages"),
        F.coalesce(F.sum(F.when(middle, F.char_length("content"))), F.lit(0)).alias("history_chars"),
    )
    return answers.join(messages, "request_id", "left").select(
        "request_id", "session_id", "status", "intent", F.size("sources").alias("n_sources"),
        "n_messages", "history_chars",
    )


@query(
    """SELECT r.conv_id || '/' || r.turn AS request_id, c.turn, c.role, c.text
    FROM conversations r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn < r.turn
    WHERE r.role = 'user' AND c.role IN ('user', 'assistant')"""
)
def request_history(spark: SparkSession, sf: str) -> DataFrame:
    """All earlier messages of every request of every session."""
    requests = requests_of(spark, sf).withColumnRenamed("turn", "request_turn")
    history = sessions.history_of_requests(requests, table(spark, sf, "conversations"), block_turns=3)
    return history.select("request_id", "turn", "role", "text")


@query(
    """WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL
    SELECT c.conv_id, c.turn + 1, 'assistant', 're: ' || c.text
    FROM conversations c JOIN last USING (conv_id, turn)
    WHERE c.turn < 5 AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1)"""
)
def log_after_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions' logs with the answers to their open requests written back, each once."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    asked = sessions.open_requests(turns).select(
        "conv_id", F.col("request_turn").alias("turn"), "question",
        F.when(F.col("request_turn") < 5, F.concat(F.lit("re: "), "question")).alias("answer"),
    )
    finished = sessions.answered_turns(asked, "conv_id", "turn", "question", "answer")
    once = sessions.with_answers(turns, finished, "conv_id")
    # written back again, nothing is added
    return sessions.with_answers(once, finished, "conv_id")
