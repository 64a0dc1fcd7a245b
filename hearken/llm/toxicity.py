"""Toxicity by a weighted lexicon, found with one Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones,
digits and signs inside words to the letters they stand for. The lexicon is learned
from labelled rows: whole words and word beginnings that stand in many toxic documents and
in few others, weighted by their log odds. Exception phrases are two-word phrases with a
lexicon entry that occur in other documents only; a match inside one does not count.
The score is a logistic function of the matched weight and of that weight by length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, query, stored, table
from hearken.llm.language import HELD_OUT, fold_of

#: Labelled rows the lexicon and the curve are fitted on, chosen by a hash of the id.
TRAIN_ROWS = 30_000
#: Beginnings of words that may become entries, in letters.
SHORTEST, LONGEST = 4, 8
#: An entry stands in at least so many toxic documents, and so large a part of them.
MIN_DOCUMENTS, MIN_PART = 5, 0.004
MIN_PRECISION = 0.8
THRESHOLD = 0.3
#: Patterns a training task holds before it hands its sums on.
HELD_PATTERNS = 200_000

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y",
    "х": "x", "ԛ": "q", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs written for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_LETTERS = str.maketrans(_LOOK_ALIKE)
_AS_I = str.maketrans(_SIGNS)
_AS_L = str.maketrans(_SIGNS | {"1": "l", "!": "l"})
_FOREIGN = re.compile("[ɐ-￿\U00010000-\U0010ffffı]")
_DISGUISED = re.compile(r"(?=[^\W\d_]*[0134578@$!])[^\W_]*[^\W\d_][0134578@$!]+[^\W\d_][^\W_@$!]*|[01345@$]+[^\W\d_]+[^\W_]*")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> list[str]:
    """Folded words. A word with letters and substitutes is also read with 1 as l."""
    text = (text or "").lower()
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    more: list[str] = []

    def undo(m: re.Match) -> str:
        other = m[0].translate(_AS_L)
        own = m[0].translate(_AS_I)
        if other != own:
            more.append(other)
        return own

    if _HAS_SIGN.search(text):
        text = _DISGUISED.sub(undo, text)
    return _WORD.findall(text + " " + " ".join(more) if more else text)


_HAS_SIGN = re.compile(r"[^\W\d_][0134578@$!]+[^\W\d_]|[01345@$][^\W\d_]")


def _patterns(words: list[str]) -> set[str]:
    """Entries a text could support: ``" word "`` for whole words, ``" begin"`` for beginnings."""
    found = set()
    for word in set(words):
        found.add(f" {word} ")
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            found.add(f" {word[:k]}")
    return found


class Lexicon:
    """Entries with weights, exception phrases, and the curve from matches to a score."""

    def __init__(self, entries: dict[str, float], exceptions: set[str], curve=(-3.0, 1.0, 1.0)):
        self.entries, self.exceptions, self.curve = entries, exceptions, np.array(curve)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def matched(self, words: list[str]) -> float:
        """Weight of all matched words; a word counts once, by its heaviest entry, and not
        at all inside an exception phrase."""
        if not self.entries:
            return 0.0
        text = " " + " ".join(words) + " "
        weights: dict[int, float] = {}
        spans = []
        for end, (size, weight) in self.automaton().iter(text):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            else:
                weights[start] = max(weight, weights.get(start, 0.0))
        for start, end in spans:
            for at in [k for k in weights if start <= k < end]:
                del weights[at]
        return sum(weights.values())

    def features(self, words: list[str]) -> tuple[float, float, float]:
        weight = self.matched(words)
        return 1.0, math.log1p(weight), math.log1p(100.0 * weight / (len(words) + 20.0))

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.curve, self.features(fold(text))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def fit_curve(self, rows: list[tuple[float, float, float]], labels: list[int]) -> None:
        """Logistic regression by Newton steps, with a small ridge that keeps it finite."""
        x, y = np.array(rows).reshape(-1, 3), np.array(labels, float)
        w = np.zeros(3)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.diag([1e-6, 0.05, 0.05])
            step = np.linalg.solve(
                (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w
            )
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of about ``rows`` labelled documents at most, as a stored table.

    Labels are drawn by a hash of their id before texts are read, so their number has a
    bound and the drawn ones can be broadcast.
    """
    known = labels.where("toxic IS NOT NULL").select("doc_id", "toxic")
    part = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(known.where(draw < part))
    return stored(docs.select("doc_id", "text").join(drawn, "doc_id"), "labelled")


def _sums(sample: DataFrame, of) -> DataFrame:
    """``pattern, bad, good``: documents of each label that hold a pattern, ``of(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: Counter = Counter()
        good: Counter = Counter()

        def sums():
            keys = list(bad.keys() | good.keys())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.string()),
                    pa.array([bad[k] for k in keys], pa.int64()),
                    pa.array([good[k] for k in keys], pa.int64()),
                ],
                names=["pattern", "bad", "good"],
            )

        for batch in batches:
            for text, toxic in zip(
                batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True
            ):
                (bad if toxic == 1 else good).update(of(text))
                if len(bad) + len(good) > HELD_PATTERNS:
                    yield sums()
                    bad.clear()
                    good.clear()
        yield sums()

    return (
        in_arrow(sample, count, "pattern string, bad long, good long")
        .groupBy("pattern")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )


def fit_lexicon(sample: DataFrame) -> Lexicon:
    """Lexicon of the labelled rows ``sample (doc_id, text, toxic)``, see ``training_rows``.

    What toxic rows hold often is found first, then counted in the others. Without toxic or
    without other rows the lexicon is empty and scores are constant.
    """
    n = sample.agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("bad"), F.count("*").alias("all")
    ).first()
    bad, good = n["bad"], n["all"] - n["bad"]
    if not bad or not good:
        return Lexicon({}, set(), (-3.0 if good else 0.0, 0.0, 0.0))
    least = max(MIN_DOCUMENTS, math.ceil(MIN_PART * bad))
    often = (
        _sums(sample.where("toxic = 1"), lambda text: _patterns(fold(text)))
        .where(F.col("bad") >= least)
        .select("pattern", "bad")
        .collect()
    )
    bad_of = {r["pattern"]: r["bad"] for r in often}
    candidates = sample.sparkSession.sparkContext.broadcast(frozenset(bad_of))
    good_of = dict(
        _sums(
            sample.where("toxic <> 1"), lambda text: _patterns(fold(text)) & candidates.value
        )
        .select("pattern", "good")
        .collect()
    )
    counts = {p: (n, good_of.get(p, 0)) for p, n in bad_of.items()}
    counts = {p: (n, g) for p, (n, g) in counts.items() if n >= MIN_PRECISION * (n + g)}
    entries = _pruned(counts, bad, good)
    doubtful = [e for e in entries if counts[e][1]]
    exceptions = _exceptions(sample, doubtful) if doubtful else set()
    lexicon = Lexicon(entries, exceptions)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in x], pa.float64()),
                    pa.array([r[2] for r in x], pa.float64()),
                    batch.column("toxic").cast(pa.int32()),
                ],
                names=["weight", "rate", "toxic"],
            )

    measured = in_arrow(sample, measure, "weight double, rate double, toxic int").toArrow().to_pylist()
    measured.sort(key=lambda r: (r["weight"], r["rate"], r["toxic"]))
    lexicon.fit_curve([(1.0, r["weight"], r["rate"]) for r in measured], [r["toxic"] for r in measured])
    return lexicon


def _pruned(counts: dict[str, tuple[int, int]], bad: int, good: int) -> dict[str, float]:
    """Weights of the entries left when each word beginning that adds little to a shorter one,
    and each whole word that adds little to its beginnings, is dropped."""
    entries: dict[str, float] = {}
    for pattern in sorted(counts, key=lambda p: (len(p.strip()), p)):
        b, g = counts[pattern]
        shorter = [pattern[:k] for k in range(SHORTEST + 1, len(pattern)) if pattern[:k] in entries]
        if any(counts[s][1] * b <= g * counts[s][0] + b for s in shorter):
            continue
        entries[pattern] = math.log((b + 0.5) / (bad + 1.0)) - math.log((g + 0.5) / (good + 1.0))
    return entries


def _exceptions(sample: DataFrame, doubtful: list[str]) -> set[str]:
    """Two-word phrases around doubtful entries that only documents of the other label hold."""

    def phrases(text: str) -> set[str]:
        words = fold(text)
        hit = [any(f" {w} ".startswith(e) for e in doubtful) for w in words]
        return {
            f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]
        }

    rows = _sums(sample, phrases).where("bad = 0 AND good >= 3").collect()
    return {r["pattern"] for r in rows}


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every row, from its text alone.

    Null and empty texts match nothing and get the score of a text without matches.
    Repeated rows are scored each, null ids stay null, other columns are ignored, an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([shared.value.score(t) for t in batch.column("text").to_pylist()]),
                ],
                names=["doc_id", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; every fourth id's label is never seen."""
    docs = table(spark, sf_dir, "documents")
    seen = table(spark, sf_dir, "labels").where(fold_of("doc_id") != HELD_OUT)
    scored = score_toxicity(docs, fit_lexicon(training_rows(docs, seen)))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
