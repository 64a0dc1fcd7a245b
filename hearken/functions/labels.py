"""Label sets, guards and lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.text import clean_text, strip, word_pattern
from hearken.functions.vectors import let

# Intent labels, emotion labels, pivot language names and defaults.
INTENTS = [
    "greeting",
    "goodbye",
    "gratitude",
    "asking_mental_health_question",
    "out_of_scope",
]
ASKING = "asking_mental_health_question"
OUT_OF_SCOPE = "out_of_scope"
EMOTIONS = {0: "sadness", 1: "joy", 2: "love", 3: "anger", 4: "fear", 5: "surprise"}
PIVOT_NAMES = ["en", "english"]
PIVOT = "en"
DEFAULT_EMOTION = "neutral"
DEFAULT_K = 4

# Whole words that show an intent, from everyday vocabulary. A baseline for the hosted
# model; pass another mapping to extend it.
INTENT_LEXICON = {
    "asking_mental_health_question": [
        "afraid", "angst", "anxiety", "anxious", "burnout", "crying", "depressed", "despair",
        "empty", "grief", "grieving", "guilt", "hopeless", "insomnia", "lonely", "loneliness",
        "miserable", "overwhelmed", "panic", "self harm", "stress", "stressed", "suicidal",
        "suicide", "therapist", "therapy", "trauma", "unhappy", "worried", "worthless",
    ],
    "goodbye": ["adieu", "bye", "cheerio", "farewell", "good night", "goodbye", "so long", "take care"],
    "greeting": ["good afternoon", "good evening", "good morning", "greetings", "hello", "hey", "hi"],
    "gratitude": ["appreciate", "appreciated", "cheers", "obliged", "thank you", "thanks", "thx"],
}
INTENT_PRIORITY = ["asking_mental_health_question", "goodbye", "greeting", "gratitude"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def needs_pivot(lang: Column | str) -> Column:
    """True where the text is not in the pivot language yet."""
    return ~F.lower(_col(lang)).isin(PIVOT_NAMES)


def guard_label(
    c: Column | str, allowed: list[str] | None = None, fallback: str = OUT_OF_SCOPE
) -> Column:
    """Strip and lowercase; whatever is then not an allowed label becomes ``fallback``."""
    label = F.lower(strip(c))
    return F.when(label.isin(allowed or INTENTS), label).otherwise(F.lit(fallback))


def label_name(c: Column | str, names: dict | None = None) -> Column:
    """Name of a label code, null for an unknown code."""
    entries = chain.from_iterable((names or EMOTIONS).items())
    return F.element_at(F.create_map(*[F.lit(e) for e in entries]), _col(c))


def intent_by_rules(
    c: Column | str,
    lexicon: dict[str, list[str]] | None = None,
    priority: list[str] | None = None,
) -> Column:
    """First intent, by priority, one of whose lexicon entries occurs in the text."""
    lexicon = lexicon or INTENT_LEXICON

    def first_match(clean: Column) -> Column:
        rule = F
        for intent in priority or INTENT_PRIORITY:
            rule = rule.when(clean.rlike(word_pattern(lexicon[intent])), F.lit(intent))
        return rule.otherwise(F.lit(OUT_OF_SCOPE))

    # Cleaned once, not once per intent.
    return let(clean_text(c), first_match)


def reply_field(payload: Column | str) -> Column:
    """First non-empty of the known reply fields of a JSON object, else the payload."""
    # Fixed value: field order.
    fields = ["answer", "response", "message", "reply", "text"]
    raw = _col(payload)
    parsed = F.from_json(raw, ", ".join(f"{f} string" for f in fields))
    return F.coalesce(*[F.nullif(parsed[f], F.lit("")) for f in fields], raw)


def display_suffix(lang: Column | str, emotion: Column | str, intent: Column | str) -> Column:
    """Emotion and intent in a trailing line, only where a language was detected."""
    shown = F.concat(F.lit("\n\n*["), _col(emotion), F.lit(" • "), _col(intent), F.lit("]*"))
    return F.when(F.coalesce(_col(lang), F.lit("")) != "", shown).otherwise(F.lit(""))
