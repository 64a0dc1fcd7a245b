"""Text functions, profile, metrics and TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.labels import label_name
from hearken.functions.text import (
    clean_text,
    contains,
    cut_from,
    drop_blank,
    filter_languages,
    split_valid,
    text_length,
    tidy_reply,
    truncate_tokens,
    words,
)
from hearken.functions.vectors import let, prediction, softmax
from hearken.operators import metrics, profile, sketches, tfidf
from hearken.operators.groups import recombine
from hearken.plans.registry.base import clean, query, table
from hearken.session import scratch_path, spread, store
from hearken.sources.readers import features_and_label, read_labelled

LANGS = ["de", "en", "es", "fr"]
QUALITY = {0: "low", 1: "high"}


@query(f"SELECT doc_id, {clean('text')} AS clean, length({clean('text')}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", clean_text("text").alias("clean")).withColumn(
        "n", text_length("clean").cast("long")
    )


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def filter_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return filter_languages(table(spark, sf, "documents"), ["en", "fr"]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE trim(text) <> ''")
def drop_blank_text(spark: SparkSession, sf: str) -> DataFrame:
    return drop_blank(table(spark, sf, "documents")).select("doc_id")


@query(
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'blank' ELSE 'missing' END AS reason
    FROM conversations WHERE role IN ('system', 'assistant')
    UNION ALL
    SELECT conv_id, turn, 'valid' AS reason FROM conversations WHERE role = 'user'"""
)
def valid_and_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The data has no blank text, so two roles are blanked out first."""
    masked = (
        F.when(F.col("role") == "user", F.col("text"))
        .when(F.col("role") == "system", F.lit(" \t  "))
    )
    turns = table(spark, sf, "conversations").withColumn("text", masked)
    valid, rejects = split_valid(turns)
    valid = valid.withColumn("reason", F.lit("valid"))
    return valid.unionByName(rejects).select("conv_id", "turn", "reason")


@query("SELECT doc_id FROM documents WHERE contains(text, ' the ')")
def contains_literal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(contains("text", " the ")).select("doc_id")


@query("SELECT page_id, regexp_replace(html, '<script[^\\n]*', '', 'g') AS html FROM pages")
def cut_after_tag(spark: SparkSession, sf: str) -> DataFrame:
    """The pages have no image tag, so the cut starts at another one."""
    pages = table(spark, sf, "pages")
    return pages.select("page_id", cut_from("html", "<script").alias("html"))


@query(
    """SELECT conv_id, turn, trim(trim(trim(chr(10) || ' "' || chr(39) || text || chr(39) || '" ',
        ' ' || chr(10)), '"'), chr(39)) AS reply FROM conversations"""
)
def tidy_replies(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.concat(F.lit("\n \"'"), F.col("text"), F.lit("'\" "))
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tidy_reply(quoted).alias("reply"))


@query(
    f"""SELECT doc_id, array_to_string(string_split({clean('text')}, ' ')[1:128], ' ') AS head,
        len(string_split({clean('text')}, ' ')) AS n_words FROM documents"""
)
def truncate_to_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        truncate_tokens("text").alias("head"),
        F.size(F.split(clean_text("text"), " ")).cast("long").alias("n_words"),
    )


@query(
    """SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS quality_name,
        CASE toxic WHEN 0 THEN 'sadness' WHEN 1 THEN 'joy' END AS emotion FROM labels"""
)
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.select(
        "doc_id",
        label_name("quality", QUALITY).alias("quality_name"),
        label_name("toxic").alias("emotion"),
    )


@query("SELECT text AS features, lang AS label FROM documents")
def features_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    return features_and_label(table(spark, sf, "documents"), "text", "lang")


# -- profile -----------------------------------------------------------------


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_contexts FROM documents")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.corpus_profile(table(spark, sf, "documents"), "text")


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL) AS n_null,
        sum(length(text))::BIGINT AS n_chars, max(length(text))::INTEGER AS max_chars,
        true AS near_exact FROM documents"""
)
def merged_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A profile from stored sketches of the sources, of which one came later; its number of
    distinct texts lies within three standard errors of the exact one."""
    docs = table(spark, sf, "documents")
    late = F.col("source").eqNullSafe(docs.agg(F.max("source")).first()[0])
    parts = store(sketches.part_profiles(docs.where(~late), "source", "text"), "profiles")
    parts = store(sketches.add_parts(parts, sketches.part_profiles(docs.where(late), "source", "text")), "profiles")
    exact = docs.agg(F.count_distinct("text")).first()[0]
    error = 3 * 1.04 / 2 ** (sketches.LG_K / 2)
    near = F.abs(F.col("n_distinct") - exact) <= F.lit(max(1.0, error * exact))
    return sketches.merged_profile(parts).withColumn("near_exact", near).drop("n_distinct")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "documents"), "text")


@query(
    """SELECT length(text) AS max_length, doc_id FROM documents
    ORDER BY length(text) DESC, doc_id LIMIT 1"""
)
def longest_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return profile.longest_text(docs, "doc_id").withColumn(
        "max_length", F.col("max_length").cast("long")
    )


@query(
    """SELECT doc_id, length(text) AS length FROM documents
    ORDER BY length(text) DESC, doc_id LIMIT 3"""
)
def longest_three(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return profile.longest_n(docs, "doc_id").withColumn("length", F.col("length").cast("long"))


@query(
    """WITH l AS (SELECT length(text) AS n FROM documents),
    b AS (SELECT min(n) AS lo, max(n) AS hi FROM l),
    p AS (SELECT CASE WHEN hi = lo THEN 0
        ELSE least(CAST(floor((n - lo) / ((hi - lo) / 10.0)) AS INTEGER), 9) END AS bin FROM l, b)
    SELECT CAST(r.i AS INTEGER) AS bin, count(p.bin) AS n
    FROM range(10) r(i) LEFT JOIN p ON p.bin = r.i GROUP BY r.i"""
)
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_histogram(table(spark, sf, "documents"))


@query(
    """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
    FROM documents"""
)
def mark_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return profile.mark_duplicates(docs, "doc_id", "text").select("doc_id", "is_duplicate")


_SPLIT = f"""CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END"""
_BUCKETS = f"""SELECT *, ('0x' || md5({clean('text')})[1:8])::BIGINT % 10 AS b FROM documents"""


@query(f"SELECT doc_id, lang, {_SPLIT} AS split FROM ({_BUCKETS})")
def labelled_splits(spark: SparkSession, sf: str) -> DataFrame:
    return profile.assign_split(table(spark, sf, "documents")).select("doc_id", "lang", "split")


@query(f"SELECT doc_id, lang, split FROM (SELECT doc_id, lang, {_SPLIT} AS split FROM ({_BUCKETS})) WHERE split = 'test'")
def labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled files without splits, read as the test split."""
    path = scratch_path(spark, "labelled")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.parquet(path)
    return read_labelled(spark, path, "text", "lang", "test", "doc_id").select("doc_id", "lang", "split")


@query(f"SELECT {_SPLIT} AS split, count(*) AS n FROM ({_BUCKETS}) GROUP BY 1")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return profile.split_sizes(profile.assign_split(table(spark, sf, "documents")))


# -- metrics -----------------------------------------------------------------

# A plain predictor to have labels to compare: the language with the most of its
# function words, the first in order on ties.
RULE_WORDS = {
    "de": ["der", "die", "und", "das"],
    "en": ["the", "and", "of", "to"],
    "es": ["el", "la", "que", "y"],
    "fr": ["le", "les", "des", "et"],
}


def _rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    def shares(found: Column) -> Column:
        def share(entries: list[str]) -> Column:
            hits = F.size(F.filter(found, lambda w: w.isin(entries))).cast("double")
            return hits / F.greatest(F.size(found), F.lit(1)) * 10

        return F.array(*[share(RULE_WORDS[x]) for x in LANGS])

    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    scores = let(words("text"), shares)
    return docs.withColumn("predicted", prediction(softmax(scores), LANGS))


def _rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_scores(spark, sf).select(
        "doc_id",
        F.col("lang").alias("y"),
        F.col("predicted.label").alias("p"),
        F.col("predicted.probs")[F.col("lang")].alias("p_true"),
    )


def _sql_hits(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in RULE_WORDS[lang])
    return f"len(list_filter(w, lambda x: x IN ({listed})))::DOUBLE / greatest(len(w), 1) * 10 AS s_{lang}"


_PREDICTED = f"""WITH tokens AS (
    SELECT doc_id, lang, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS w
    FROM documents),
scores AS (SELECT doc_id, lang, {', '.join(_sql_hits(x) for x in LANGS)} FROM tokens),
top AS (SELECT *, greatest({', '.join('s_' + x for x in LANGS)}) AS best FROM scores),
total AS (SELECT *, {' + '.join(f'exp(s_{x} - best)' for x in LANGS)} AS z FROM top),
probs AS (SELECT doc_id, lang AS y,
    {', '.join(f'exp(s_{x} - best) / z AS q_{x}' for x in LANGS)},
    CASE {' '.join(f"WHEN s_{x} = best THEN '{x}'" for x in LANGS)} END AS p FROM total),
pred AS (SELECT *, CASE y {' '.join(f"WHEN '{x}' THEN q_{x}" for x in LANGS)} END AS p_true
    FROM probs)
"""



def _full_report(rows: str) -> str:
    """SQL for the class report of a (y, p) relation, with both averages."""
    return f"""(WITH r AS (SELECT * FROM {rows}),
    lab AS (SELECT DISTINCT label FROM (SELECT y AS label FROM r UNION ALL SELECT p FROM r)),
    stats AS (SELECT label,
        (SELECT count(*) FROM r WHERE y = label) AS support,
        (SELECT count(*) FROM r WHERE p = label) AS predicted,
        (SELECT count(*) FROM r WHERE y = label AND p = label) AS hit FROM lab),
    report AS (SELECT label,
        CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS precision_,
        CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall_,
        CASE WHEN support + predicted = 0 THEN 0.0
            ELSE 2.0 * hit / (support + predicted) END AS f1,
        support FROM stats)
    SELECT label, precision_, recall_, f1, support FROM report
    UNION ALL
    SELECT 'macro', avg(precision_), avg(recall_), avg(f1), sum(support)::BIGINT FROM report
    UNION ALL
    SELECT 'weighted', sum(precision_ * support) / sum(support),
        sum(recall_ * support) / sum(support), sum(f1 * support) / sum(support),
        sum(support)::BIGINT FROM report)"""


_REPORT_COLUMNS = """label, round(precision_, 6) AS precision, round(recall_, 6) AS recall,
    round(f1, 6) AS f1, support"""


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    _PREDICTED
    + f"SELECT doc_id, p AS label, {', '.join(f'round(q_{x}, 6) AS {x}' for x in LANGS)},"
    f" round(greatest({', '.join('q_' + x for x in LANGS)}), 6) AS confidence FROM probs"
)
def rule_language_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = _rule_scores(spark, sf)
    return scored.select(
        "doc_id",
        F.col("predicted.label").alias("label"),
        F.round("predicted.confidence", 6).alias("confidence"),
        *[F.round(F.col("predicted.probs")[x], 6).alias(x) for x in LANGS],
    )


@query(
    """SELECT v.quality, n, CASE WHEN n > 0 THEN
        round((SELECT count(*) FROM labels WHERE quality IN (0, 1, 2)) / (3.0 * n), 6) END AS weight
    FROM (SELECT q.quality, count(l.quality) AS n
        FROM (VALUES (0), (1), (2)) q(quality) LEFT JOIN labels l ON l.quality = q.quality
        GROUP BY q.quality) v"""
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = metrics.class_weights(table(spark, sf, "labels"), "quality", [0, 1, 2])
    return weights.withColumn("weight", F.round("weight", 6))


@query(_PREDICTED + "SELECT round(avg((y = p)::INT), 6) AS accuracy FROM pred")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    result = metrics.accuracy(_rule_predictions(spark, sf))
    return result.select(F.round("accuracy", 6).alias("accuracy"))


@query(
    _PREDICTED
    + f"""SELECT y, {', '.join(f"count(*) FILTER (p = '{x}') AS p_{x}" for x in LANGS)}
    FROM pred GROUP BY y"""
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_rule_predictions(spark, sf), LANGS)


@query(_PREDICTED + f"SELECT {_REPORT_COLUMNS} FROM {_full_report('pred')}")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_report(metrics.full_report(_rule_predictions(spark, sf)))


@query(
    _PREDICTED
    + f"SELECT round(f1, 6) AS f1_weighted FROM {_full_report('pred')} WHERE label = 'weighted'"
)
def weighted_f1(spark: SparkSession, sf: str) -> DataFrame:
    result = metrics.weighted_f1(_rule_predictions(spark, sf))
    return result.select(F.round("f1_weighted", 6).alias("f1_weighted"))


@query(
    _PREDICTED
    + """, w AS (SELECT y, (SELECT count(*) FROM pred) / (4.0 * count(*)) AS weight
        FROM pred GROUP BY y)
    SELECT round(avg(-ln(greatest(p_true, 1e-15))), 6) AS loss,
        round(sum(weight * -ln(greatest(p_true, 1e-15))) / sum(weight), 6) AS weighted_loss
    FROM pred JOIN w USING (y)"""
)
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rule_predictions(spark, sf)
    weights = metrics.class_weights(rows, "y", LANGS).select("y", "weight")
    weighted = rows.join(F.broadcast(weights), "y")
    plain = metrics.log_loss(rows).scalar()
    return metrics.log_loss(weighted, weight="weight").select(
        F.round(plain, 6).alias("loss"), F.round("loss", 6).alias("weighted_loss")
    )


SPLITS = ["train", "validation", "test"]


@query(
    _PREDICTED
    + f""", split AS (SELECT doc_id, {_SPLIT} AS split FROM ({_BUCKETS})),
    tagged AS (SELECT * FROM pred JOIN split USING (doc_id))
    """
    + " UNION ALL ".join(
        f"SELECT {_REPORT_COLUMNS}, '{x}' AS split FROM"
        f" {_full_report(f"(SELECT * FROM tagged WHERE split = '{x}')")}"
        for x in SPLITS
    )
)
def language_report(spark: SparkSession, sf: str) -> DataFrame:
    """The class report of each split."""
    tagged = profile.assign_split(_rule_scores(spark, sf)).select(
        F.col("lang").alias("y"), F.col("predicted.label").alias("p"), "split"
    )
    reports = [
        _rounded_report(metrics.full_report(tagged.where(F.col("split") == x))).withColumn(
            "split", F.lit(x)
        )
        for x in SPLITS
    ]
    return recombine(*reports)


@query(
    _PREDICTED
    + f"""SELECT round((SELECT avg(-ln(greatest(p_true, 1e-15))) FROM pred), 6) AS loss,
        round((SELECT avg((y = p)::INT) FROM pred), 6) AS accuracy,
        round(f1, 6) AS f1_weighted FROM {_full_report('pred')} WHERE label = 'weighted'"""
)
def classifier_report(spark: SparkSession, sf: str) -> DataFrame:
    result = metrics.evaluation(_rule_predictions(spark, sf))
    return result.select(*[F.round(c, 6).alias(c) for c in result.columns])


# -- n-grams -----------------------------------------------------------------

_GRAMS = f"""WITH texts AS (
    SELECT doc_id, string_split({clean('text')}, '') AS c FROM documents),
chars AS (SELECT doc_id, unnest(c) AS c1, generate_subscripts(c, 1) AS pos FROM texts),
runs AS (SELECT doc_id, c1, lead(c1, 1) OVER w AS c2, lead(c1, 2) OVER w AS c3,
    lead(c1, 3) OVER w AS c4, lead(c1, 4) OVER w AS c5
    FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
    SELECT doc_id, c1 AS gram FROM runs
    UNION ALL SELECT doc_id, c1 || c2 FROM runs WHERE c2 IS NOT NULL
    UNION ALL SELECT doc_id, c1 || c2 || c3 FROM runs WHERE c3 IS NOT NULL
    UNION ALL SELECT doc_id, c1 || c2 || c3 || c4 FROM runs WHERE c4 IS NOT NULL
    UNION ALL SELECT doc_id, c1 || c2 || c3 || c4 || c5 FROM runs WHERE c5 IS NOT NULL),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
freq AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2)
"""


@query(_GRAMS + "SELECT gram, df FROM freq")
def ngram_df(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.ngram_df(spread(table(spark, sf, "documents").select("text")))


@query(
    _GRAMS
    + """, w AS (SELECT doc_id, tf, tf * (ln((1 + (SELECT count(*) FROM documents))
            / (1.0 + df)) + 1) AS weight FROM tf JOIN freq USING (gram))
    SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams,
        round(sqrt(sum(weight * weight)), 4) AS norm, round(max(weight), 6) AS top_weight,
        1.0::DOUBLE AS unit_square FROM w GROUP BY doc_id"""
)
def char_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return tfidf.tfidf_summary(tfidf.char_tfidf(docs, "doc_id"), "doc_id")
