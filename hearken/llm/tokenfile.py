"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

Texts are dealt out by ranges of ``doc_id``, sorted and encoded in place, so files hold
ascending ids and their order is the order of the documents. Each row names its shard
(the range) and its place in it. ORC keeps minimum and maximum of every stripe and row
group, so a range of ids reads few stripes, and a Bloom filter per stripe, so a point
lookup does too; large files are split at stripes among tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, query, stored, table
from hearken.llm.tokens import tokenizer_path, worker_encoder
from hearken.session import scratch_path

END_ID = 0
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(8 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


#: Bytes of text encoded together; a longer text alone.
GROUP_BYTES = 1 << 20


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``GROUP_BYTES`` of text, of one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0)
        group = np.cumsum(lengths.to_numpy(zero_copy_only=False)) // GROUP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(start, end - start)


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, shard, place, ids``: token ids with the end id, in ascending ``doc_id`` order.

    ``shard`` numbers the ranges of ids in their order, ``place`` the rows of a shard.
    Null text encodes as empty, to the end id alone. Null ids come first; rows that repeat
    an id follow each other in text order. Other columns are ignored.
    """
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, place = worker_encoder(path, False), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in _groups(batches):
            found = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            n = batch.num_rows
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum([len(x) // 4 + 1 for x in found], out=offsets[1:])
            ids = np.frombuffer(end.join(found) + end, "<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(place, place + n, dtype=np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ],
                names=["doc_id", "shard", "place", "ids"],
            )
            place += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id")
    return in_arrow(
        ordered.sortWithinPartitions("doc_id", "text"),
        encode,
        f"doc_id {kind}, shard int, place long, ids array<int>",
    )


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Write encoded documents as ORC; a failed task's file is never seen."""
    tokens.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on ``doc_id`` and left-out columns skip stripes and streams."""
    return spark.read.orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of written tokens: a document's place in the
    whole stream, its length and the crc32 of its ids as little-endian unsigned integers.

    Lengths add up within a shard, and shard totals (one row per shard) over shards.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("shard"),
                    batch.column("place"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = stored(
        in_arrow(
            tokens, digest, f"doc_id {kind}, shard int, place long, n_tokens long, ids_crc32 long"
        ),
        "token_lengths",
    )
    before = F.coalesce(F.sum("n").over(_before("shard")), F.lit(0))
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", before.alias("_shard_start"))
    within = F.coalesce(F.sum("n_tokens").over(_before("place", "shard")), F.lit(0))
    return rows.join(shards, "shard").select(
        "doc_id",
        (F.col("_shard_start") + within).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def _before(order: str, *by: str):
    window = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return window.rowsBetween(Window.unboundedPreceding, -1)


@query()
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write whole ``documents`` as token ids in ORC, read them back, digest each document."""
    path = scratch_path(spark, "tokens.orc")
    write_tokens(encode_documents(table(spark, sf_dir, "documents")), path)
    return token_index(read_tokens(spark, path))
