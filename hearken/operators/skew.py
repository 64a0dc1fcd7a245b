"""Joins that hold when one key owns a large part of the rows.

Keys with more than ``rows_per_slice`` rows are cut into slices: their rows get
a slice number from a hash of a row id, and the one-row-per-key side is repeated
once per slice. All other keys keep a single slice. The list of heavy keys (two
numbers per key) is stored and counted: up to ``MAX_BROADCAST`` keys it is broadcast, a
longer one is joined like any table, and an empty one is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.session import settle

ROWS_PER_SLICE = 200_000
MAX_BROADCAST = 1_000_000

_HASH, _SLICES, _SLICE = "_key_hash", "_slices", "_slice"


def heavy_keys(
    rows: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Hash and slice count of the keys with more than ``rows_per_slice`` rows."""
    counts = rows.groupBy(F.xxhash64(*keys).alias(_HASH)).agg(F.count("*").alias("_n"))
    return _heaviest(counts, rows_per_slice)


def heavy_from_counts(
    per_key: DataFrame, keys: list[str], n: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """The same from a table that already holds the row count ``n`` of each key."""
    counts = per_key.select(F.xxhash64(*keys).alias(_HASH), F.col(n).alias("_n"))
    return _heaviest(counts.where(F.col("_n") > rows_per_slice).groupBy(_HASH).agg(
        F.sum("_n").alias("_n")), rows_per_slice)


def _heaviest(counts: DataFrame, rows_per_slice: int) -> DataFrame:
    return (
        counts.where(F.col("_n") > rows_per_slice)
        .select(_HASH, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias(_SLICES))
    )


def sliced_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``per_key`` on ``keys`` with heavy keys spread by ``spread_by``.

    ``how`` may be any kind that keeps or filters ``rows``: inner, left,
    left_semi, left_anti. Keys are counted on ``rows`` unless ``heavy`` is given.
    """
    if heavy is None:
        heavy = heavy_keys(rows, keys, rows_per_slice)
    heavy = settle(heavy)
    n_heavy = heavy.count()
    if n_heavy == 0:
        return rows.join(per_key, keys, how)
    if n_heavy <= MAX_BROADCAST:
        heavy = F.broadcast(heavy)
    slices = F.coalesce(F.col(_SLICES), F.lit(1))
    left = (
        rows.withColumn(_HASH, F.xxhash64(*keys))
        .join(heavy, _HASH, "left")
        .withColumn(_SLICE, F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop(_HASH, _SLICES)
    )
    right = (
        per_key.withColumn(_HASH, F.xxhash64(*keys))
        .join(heavy, _HASH, "left")
        .withColumn(_SLICE, F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop(_HASH, _SLICES)
    )
    return left.join(right, [*keys, _SLICE], how).drop(_SLICE)
