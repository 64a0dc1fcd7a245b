"""Corpus profile: counts, lengths, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.text import clean_text, text_length
from hearken.operators.skew import ROWS_PER_SLICE, heavy_from_counts, sliced_join


def corpus_profile(df: DataFrame, context: str = "context", exact: bool = True) -> DataFrame:
    """Rows and distinct contexts; null contexts are not counted as distinct."""
    distinct = F.count_distinct(context) if exact else F.approx_count_distinct(context)
    return df.agg(F.count("*").alias("n_rows"), distinct.alias("n_contexts"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def longest_text(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Greatest length and the row that has it, the lowest id on ties."""
    length = text_length(text)
    return df.agg(
        F.max(length).alias("max_length"),
        F.max_by(F.col(id_col), F.struct(length, -F.col(id_col))).alias(id_col),
    )


def longest_n(df: DataFrame, id_col: str, text: str = "text", n: int = 3) -> DataFrame:
    """The ``n`` longest texts, longest first."""
    return (
        df.select(id_col, text_length(text).alias("length"))
        .orderBy(F.desc("length"), id_col)
        .limit(n)
    )


def length_histogram(df: DataFrame, text: str = "text", bins: int = 10) -> DataFrame:
    """Rows per equal-width length bin; the last bin is closed, empty bins show 0.

    Lengths are grouped to one row per distinct length first, so the text is read
    once and what follows is small.
    """
    lengths = df.where(F.col(text).isNotNull()).groupBy(text_length(text).alias("length")).agg(
        F.count("*").alias("n")
    )
    low = lengths.agg(F.min("length")).scalar()
    high = lengths.agg(F.max("length")).scalar()
    width = (high - low) / F.lit(float(bins))
    position = F.least(F.floor((F.col("length") - low) / width), F.lit(bins - 1))
    placed = lengths.select(
        F.when(high == low, F.lit(0)).otherwise(position).cast("int").alias("bin"), "n"
    )
    all_bins = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n")
    )
    return placed.unionByName(all_bins).groupBy("bin").agg(F.sum("n").alias("n"))


def split_bucket(text: Column | str) -> Column:
    """0 to 9 from the normalised text, so exact copies share a bucket."""
    head = F.substring(F.md5(clean_text(text).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("long") % 10


def assign_split(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``split``: 8 of 10 buckets train, one validation, one test."""
    bucket = split_bucket(text)
    name = F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")
    return df.withColumn("split", name)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def mark_duplicates(
    df: DataFrame, id_col: str, col: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``is_duplicate``: true for each occurrence of a value after its first.

    First ids are found with a partial aggregate and joined back, so copies of one
    value never meet in one sort. Values travel as digests, not as texts.
    """
    keyed = df.withColumn("_digest", F.sha2(F.col(col).cast("binary"), 256))
    first = keyed.groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
    repeated = first.where((F.col("_n") > 1) & F.col("_digest").isNotNull())
    heavy = heavy_from_counts(repeated, ["_digest"], "_n", rows_per_slice)
    flag = F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))
    return (
        sliced_join(
            keyed, repeated.drop("_n"), ["_digest"], [id_col], "left", rows_per_slice, heavy
        )
        .withColumn("is_duplicate", flag)
        .drop("_digest", "_first")
    )
