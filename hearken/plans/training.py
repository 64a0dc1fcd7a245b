"""Train, evaluate and save the two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions.labels import EMOTIONS, label_name
from hearken.functions.text import filter_languages
from hearken.operators.metrics import evaluation
from hearken.operators.models import (
    TextModel,
    best_emotion_model,
    predictions,
    report_on,
    save_model,
    train_language,
)


def train_language_model(
    labelled: DataFrame, out: str, langs: list[str] | None = None, **settings
) -> tuple[TextModel, DataFrame]:
    """(text, lang, split) to a saved model and its test report."""
    chosen = filter_languages(labelled, langs)
    model = train_language(chosen.where(F.col("split") == "train"), **settings)
    save_model(model, out, {"languages": langs})
    return model, report_on(model, chosen, "test", "text", "lang")


def train_emotion_model(
    labelled: DataFrame,
    out: str,
    names: dict[int, str] | None = None,
    candidates: list[dict] | None = None,
    label: str = "label",
) -> tuple[TextModel, DataFrame, DataFrame]:
    """(text, label, split) to a saved model, the candidates tried and test metrics."""
    names = names or EMOTIONS

    def part(name: str) -> DataFrame:
        return labelled.where(F.col("split") == name)

    model, tried = best_emotion_model(
        part("train"), part("validation"), candidates or [{}], "text", label, names
    )
    save_model(model, out, {"emotion_labels": names})
    test = part("test").withColumn("_name", label_name(label, names))
    return model, tried, evaluation(predictions(model, test, "text", "_name"))
