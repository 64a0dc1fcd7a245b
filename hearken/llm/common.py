"""What the operators of this package share: tables, stored stages, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearken.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII white space, as characters and as the regular expression between words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(sql: str | None = None):
    """Register a query under its function name, with SQL for DuckDB if there is any."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_array(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def text_key(text: Column) -> Column:
    """64-bit key of a text; with the document's id it names a row."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def whole_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, _row, _doc``: id and text key of each row, and all its columns in one struct,
    so that names in ``docs`` meet no others. ``select("_doc.*")`` gives the rows back."""
    return docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_row"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
    )


#: DuckDB counterparts.
SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = f"translate({{0}}, '{_UPPER}', '{_UPPER.lower()}')"
SQL_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

#: Bytes of one batch between Spark and Python; long texts make smaller batches. Each side
#: of each task holds a few of them, outside the heap.
ARROW_BATCH = 4 << 20


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, not only by rows.

    Columns travel under their positions, so names may hold dots or repeat in other case;
    ``run`` sees the names of ``df``. The bound is the session's setting, which is read when
    the job runs: it is lowered to ``ARROW_BATCH`` if it is above, and stays so.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key, str(ARROW_BATCH))) > ARROW_BATCH:
        conf.set(key, str(ARROW_BATCH))
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.rename_columns(names) for batch in batches)
        # workers live on after a task; what its batches took goes back
        pa.default_memory_pool().release_unused()

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)
