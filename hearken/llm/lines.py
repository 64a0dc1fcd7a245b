"""Drop lines that recur over many documents.

Only DataFrame functions run. Each document gives every distinct line key once, so
keys are counted by a plain sum with partial sums before the shuffle. Keys travel
as two 64-bit hashes. Only hits of dropped keys are joined back, as positions, and a
document is put together again from the positions it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import query, table, text_key

MIN_CHARS = 1
MIN_DOCUMENTS = 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return common.lower_ascii(F.btrim(line, F.lit(common.SPACES)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(lines: Column, min_chars: int) -> Column:
    """Per line its position and two hashes of its key; lines with shorter keys are left out."""

    def hashed(key: Column, at: Column) -> Column:
        return F.struct(
            F.xxhash64(key).alias("h"),
            F.xxhash64(F.lit(1), key).alias("g"),
            at.alias("at"),
            (F.length(key) >= min_chars).alias("long_enough"),
        )

    # An array of its own for the keys: inside one lambda each of the three uses makes the key again.
    keys = F.transform(lines, line_key)
    return F.filter(F.transform(keys, hashed), lambda x: x["long_enough"])


def _once(hashes: Column) -> Column:
    """Distinct keys of one document: sorted, then compared with the element before."""
    keys = F.sort_array(F.transform(hashes, lambda x: F.struct(x["h"], x["g"])))
    # transform over a one-element array names the sorted array, so it is sorted once
    return F.flatten(
        F.transform(
            F.array(keys),
            lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) != x)),
        )
    )


def common_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``h, g``: keys found in at least ``min_documents`` rows of ``docs``."""
    keys = docs.select(F.explode(_once(_hashes(text_lines(F.col("text")), min_chars))).alias("k"))
    return (
        keys.groupBy(F.col("k.h").alias("h"), F.col("k.g").alias("g"))
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") >= min_documents)
        .select("h", "g")
    )


def drop_common_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: texts without the lines of common keys.

    Every row is a document, also one that repeats another row's id; rows equal in id
    and text get equal results. Null or empty text is one empty line and comes back
    empty. Keys under ``min_chars`` code points (blank lines) are never dropped. Other
    columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = (
        docs.select(
            F.col("doc_id").alias("_id"),
            text_key(F.col("text")).alias("_key"),
            F.explode(_hashes(text_lines(F.col("text")), min_chars)).alias("k"),
        )
        .select("_id", "_key", "k.h", "k.g", "k.at")
        .join(common_lines(docs, min_documents, min_chars), ["h", "g"])
        .groupBy("_id", "_key")
        .agg(F.collect_set("at").alias("_gone"))
    )
    texts = docs.withColumn("_row", text_key(F.col("text")))
    joined = texts.join(
        found, texts["doc_id"].eqNullSafe(found["_id"]) & (texts["_row"] == found["_key"]), "left"
    )
    lines = text_lines(F.col("text"))
    n = F.size(lines)
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    rebuilt = F.flatten(
        F.transform(
            F.array(lines),
            lambda all_lines: F.transform(stay, lambda at: F.get(all_lines, at)),
        )
    )
    return joined.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(rebuilt, "\n"))
        .alias("text"),
        n.cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


_KEY = common.SQL_LOWER.format(f"trim(line, {common.SQL_SPACES})")


@query(
    f"""
    WITH lines AS (
      SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
    ), keyed AS (SELECT *, {_KEY} AS key FROM lines),
    gone AS (
      SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}
    )
    SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                           FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN gone ON keyed.key = gone.key GROUP BY r, doc_id
    """
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` without the lines that at least 10 documents share."""
    return drop_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
