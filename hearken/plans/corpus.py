"""Corpus build and indexing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.text import drop_blank
from hearken.operators.embedding import embed, fit_and_embed, fit_embedder
from hearken.operators.groups import (
    CLUSTERED,
    KEEP,
    MIN_RESPONSES,
    recombine,
    reduction_report,
    route_for,
)
from hearken.operators.retrieval import Cells, assign_cells, fit_centres, measure_cells
from hearken.operators.skew import ROWS_PER_SLICE, heavy_from_counts, sliced_join
from hearken.operators.thinning import GROUP_ROWS, SEED, pick_representatives
from hearken.session import path_exists, scratch_path, store
from hearken.sources.readers import read_cells, read_vectors
from hearken.sources.writers import write_cells, write_vectors

Embed = Callable[[DataFrame], DataFrame]


def attach_routes(
    pairs: DataFrame,
    keep: int = KEEP,
    min_responses: int = MIN_RESPONSES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``group_id``, group size ``n`` and ``route`` to every pair with a context.

    Sizes come from a partial aggregate over digests and are joined back sliced, so
    the answers of a hot question are not gathered to be counted.
    """
    keyed = pairs.where(F.col("context").isNotNull()).withColumn(
        "_digest", F.sha2(F.col("context").cast("binary"), 256)
    )
    sizes = keyed.groupBy("_digest").agg(
        F.min("pair_id").alias("group_id"), F.count("*").alias("n")
    )
    heavy = heavy_from_counts(sizes, ["_digest"], "n", rows_per_slice)
    return (
        sliced_join(keyed, sizes, ["_digest"], ["pair_id"], "inner", rows_per_slice, heavy)
        .withColumn("route", route_for(F.col("n"), keep, min_responses))
        .drop("_digest")
    )


def word_embedder(responses: DataFrame) -> Embed:
    """Default embedding of answers, fitted on the answers themselves."""
    model = fit_embedder(responses, "response")
    return lambda df: embed(model, df, "response")


def build_corpus(
    pairs: DataFrame,
    keep: int = KEEP,
    min_responses: int = MIN_RESPONSES,
    embedder: Embed | None = None,
    dedupe: bool = False,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Thin (pair_id, context, response); returns the kept pairs and the report.

    Only answers of clustered groups are embedded. The routed pairs are written
    once to the shared folder and read by each branch.
    """
    spark = pairs.sparkSession
    path = scratch_path(spark, "routed")
    # The route is a folder, so each branch reads its own rows only.
    attach_routes(pairs, keep, min_responses).write.partitionBy("route").parquet(path)
    routed = spark.read.schema(
        "pair_id long, context string, response string, group_id long, n long, route string"
    ).parquet(path)
    kept = routed.where(F.col("route") != CLUSTERED).select("pair_id", "context", "response")
    crowded = routed.where(F.col("route") == CLUSTERED)
    embedded = (embedder or word_embedder(crowded))(crowded)
    picks = pick_representatives(embedded, keep, dedupe, seed, group_rows, sizes=crowded)
    # pair_id is unique among the crowded rows, so this join has no hot key.
    thinned = picks.join(crowded, "pair_id").select("pair_id", "context", "response")
    # The first row of a group stands for it, so the report needs no second grouping.
    groups = routed.where(F.col("pair_id") == F.col("group_id"))
    missing = pairs.where(F.col("context").isNull())
    return recombine(kept, thinned), reduction_report(groups, keep, missing)


def index_documents(
    documents: DataFrame,
    path: str,
    force_recreate: bool = False,
    n_cells: int | None = None,
    embedder: Embed | None = None,
    text: str = "context",
) -> None:
    """Embed (doc_id, context, response) rows and write the vectors table, unless it is there.

    With ``n_cells`` the rows are divided into cells and the cell table is written
    beside them, so ``open_cells`` can search the stored rows.
    """
    if not force_recreate and path_exists(documents.sparkSession, path):
        return
    docs = drop_blank(documents, text)
    vectors = fit_and_embed(docs, text) if embedder is None else embedder(docs)
    if not n_cells:
        write_vectors(vectors, path, force_recreate)
        return
    # Stored before the centres are learned, so texts are embedded once.
    vectors = store(vectors, "vectors")
    centres = fit_centres(vectors, n_cells)
    write_vectors(assign_cells(vectors, centres), path, force_recreate)
    # Measured on the stored rows, so texts are not embedded once more.
    spark = documents.sparkSession
    cells = measure_cells(read_vectors(spark, path), centres)
    write_cells(spark, cells, _cells_path(path), force_recreate)


def _cells_path(path: str) -> str:
    return f"{path.rstrip('/')}-cells"


def open_cells(spark: SparkSession, path: str) -> Cells:
    """The stored vectors with their cells, ready for ``top_k_cells``."""
    stored = read_cells(spark, _cells_path(path)).orderBy("cell").collect()  # one row per cell
    return Cells(
        read_vectors(spark, path),
        np.array([r["centre"] for r in stored]),
        np.array([r["radius"] for r in stored]),
        np.array([r["n"] for r in stored]),
    )
