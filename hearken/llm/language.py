"""Language of a text as a mixture of languages.

Training counts hashed character trigrams (over UTF-8 bytes of lower-cased words) per
language. A text is taken as draws from a mixture of the languages' trigram
distributions; expectation-maximisation finds the proportions. Then the set of languages
is chosen: languages are added in order of proportion while the log-likelihood gains
more than a penalty per language that grows with the log of the number of trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, query, table

BUCKETS = 1 << 15
#: Rows the model is fitted on, chosen by a hash of the id. A bound on the labelled sample only.
TRAIN_ROWS = 30_000
HELD_OUT = 2
FOLDS = 4
UNKNOWN = "und"
#: Expectation-maximisation ends when no proportion moves by more.
SETTLED = 1e-4
#: Neighbouring trigrams overlap, so three count as one observation.
OVERLAP = 3.0
PENALTY = 2.0
SMOOTHING = 0.5
#: Below this no language accounts for enough of a text to keep it.
LEAST_SCORE = 0.4

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold_of(doc_id):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of every trigram of the text's words, each word between single spaces."""
    data = (" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode()
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class LanguageModel:
    """Trigram log-probabilities of each language and the mixture inference over them."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smoothed = counts + SMOOTHING
        self.p = smoothed / smoothed.sum(axis=1, keepdims=True)
        self.log_p = np.log(self.p)

    def _mixture(self, of: list[int], grams: np.ndarray, n: np.ndarray):
        """Proportions and log-likelihood of the best mixture of the languages ``of``."""
        p = self.p[np.ix_(of, grams)]
        share = np.full(len(of), 1.0 / len(of))
        moved = 1.0
        while moved > SETTLED:  # the likelihood is concave in the proportions, so steps shrink
            weighted = share[:, None] * p
            new = (weighted @ (n / weighted.sum(axis=0))) / n.sum()
            moved = np.abs(new - share).max()
            share = new
        return share, float(n @ np.log(share @ p))

    def infer(self, text: str) -> tuple[list[tuple[str, float]], float]:
        """Chosen languages with proportions, largest first, and a score of the first."""
        grams, n = np.unique(trigram_buckets(text), return_counts=True)
        n = n / OVERLAP
        alone = self.log_p[:, grams] @ n
        first = int(alone.argmax())
        posterior = 1.0 / np.exp(alone - alone[first]).sum()
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0)], 1.0
        share, _ = self._mixture(list(range(len(self.languages))), grams, n)
        order = np.argsort(-share, kind="stable").tolist()
        chosen, best, best_share = [first], float(alone[first]), np.ones(1)
        price = PENALTY + 0.5 * np.log(1.0 + n.sum())
        for k in order:
            if k in chosen:
                continue
            with_k, likelihood = self._mixture([*chosen, k], grams, n)
            if likelihood - best <= price:
                break
            chosen, best, best_share = [*chosen, k], likelihood, with_k
        found = sorted(zip(chosen, best_share), key=lambda x: (-x[1], x[0]))
        score = posterior if len(found) == 1 else found[0][1]
        return [(self.languages[k], float(s)) for k, s in found], float(min(1.0, score))


def fit_languages(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Model of ``labelled (doc_id, text, lang)``; none if no row has both text and label.

    Every language keeps its share of at most about ``rows`` rows, chosen by a hash of
    the id; a language with few rows keeps at least some. Counts are added up in tasks,
    then in Spark; one row per language and bucket reaches the driver.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    part = min(1.0, rows / sum(sizes.values()))
    keep = {lang: max(part, min(1.0, 200 / n)) for lang, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in keep.items() for x in kv)), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(
                batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True
            ):
                own = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                names=["lang", "bucket", "n"],
            )

    counted = (
        in_arrow(
            known.where(draw < rate).select("text", "lang"), count, "lang string, bucket long, n long"
        )
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    at = {lang: i for i, lang in enumerate(languages)}
    row = np.array([at[x] for x in counted.column("lang").to_pylist()], np.int64)
    counts[row, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return LanguageModel(languages, counts)


def predict(model: LanguageModel | None, text: str | None):
    """Label, score and chosen languages of one text."""
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0, []
    found, score = model.infer(text)
    return found[0][0], score, found


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of every row, from its text alone.

    ``languages`` lists the chosen languages with their proportions; ``lang_pred`` is the
    largest. Text that is null or has no letter, and all text if nothing was learned, is
    ``und`` with score 0 and no languages. Repeated rows are scored each, null ids stay
    null, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"lang": x, "share": y} for x, y in f[2]] for f in found], kinds),
                ],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        docs.select("doc_id", "text"),
        identify,
        f"doc_id {kind}, lang_pred string, score double, "
        "languages array<struct<lang: string, share: double>>",
    )


def keep_identified(
    docs: DataFrame, model: LanguageModel | None, least_score: float = LEAST_SCORE
) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose language is known: not ``und``, and
    with a score of at least ``least_score``. Nothing is kept if nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (predict(shared.value, t) for t in batch.column("text").to_pylist())
            stay = [label != UNKNOWN and score >= least_score for label, score, _ in found]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return in_arrow(docs, keep, docs.schema)


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; every fourth id's label is never seen."""
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(fold_of("doc_id") != HELD_OUT)
    found = identify_languages(docs, fit_languages(learned.select("doc_id", "text", "lang")))
    held_out = F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
