"""Group sizes, thinning routes and the reduction report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers kept per question, and the group size where thinning starts.
KEEP = 5
MIN_RESPONSES = 4

SINGLE, KEPT_ALL, CLUSTERED = "single", "kept_all", "clustered"


def route_for(n: Column, keep: int = KEEP, min_responses: int = MIN_RESPONSES) -> Column:
    few = (n < min_responses) | (n <= keep)
    return F.when(n == 1, SINGLE).when(few, KEPT_ALL).otherwise(CLUSTERED)


def route_groups(
    df: DataFrame,
    id_col: str,
    context: str = "context",
    keep: int = KEEP,
    min_responses: int = MIN_RESPONSES,
) -> DataFrame:
    """One row per context: ``group_id`` (first id), size ``n`` and ``route``.

    Rows without a context belong to no group.
    """
    return (
        df.where(F.col(context).isNotNull())
        .groupBy(context)
        .agg(F.min(id_col).alias("group_id"), F.count("*").alias("n"))
        .withColumn("route", route_for(F.col("n"), keep, min_responses))
    )


def recombine(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def reduction_report(
    groups: DataFrame, keep: int = KEEP, dropped: DataFrame | None = None
) -> DataFrame:
    """One row: rows in and out, contexts, percent removed, groups per route.

    Follows from the group table alone, since a clustered group leaves exactly
    ``keep`` rows. ``dropped`` holds the rows without a context.
    """
    n, clustered = F.col("n"), F.col("route") == CLUSTERED
    left = F.when(clustered, F.lit(keep)).otherwise(n)
    report = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("grouped"),
        F.coalesce(F.sum(left), F.lit(0)).alias("rows_out"),
        F.count("*").alias("contexts_out"),
        F.count_if(clustered).alias("clustered"),
        F.count_if(F.col("route") == KEPT_ALL).alias("kept_all"),
        F.count_if(F.col("route") == SINGLE).alias("single"),
        F.lit(0).cast("long").alias("no_context"),
    )
    if dropped is not None:
        zeros = [F.lit(0).cast("long").alias(c) for c in report.columns[:-1]]
        missing = dropped.agg(F.count("*").alias("no_context")).select(*zeros, "no_context")
        report = report.unionByName(missing).agg(
            *[F.sum(c).cast("long").alias(c) for c in report.columns]
        )
    rows_in = F.col("grouped") + F.col("no_context")
    removed = F.round(100.0 * (1 - F.col("rows_out") / F.nullif(F.col("rows_in"), F.lit(0))), 1)
    return (
        report.withColumn("rows_in", rows_in).withColumn("reduction_pct", removed).drop("grouped")
    )


def multi_representatives(pairs: DataFrame, id_col: str, context: str = "context") -> DataFrame:
    """Contexts that still have more than one row, with their first id and size."""
    return (
        pairs.where(F.col(context).isNotNull())
        .groupBy(context)
        .agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def sample_report(pairs: DataFrame, id_col: str, context: str = "context") -> DataFrame:
    """All rows of the first context with more than one row."""
    first = multi_representatives(pairs, id_col, context).agg(
        F.min_by(context, "first_id").alias(context)
    )
    return pairs.join(F.broadcast(first), context, "left_semi")
