"""Words of documents that repeat windows of benchmark items.

A window is ``WINDOW`` consecutive words of an item (all of them if it has fewer). A
document holds a window exactly if it holds all its short shingles in their places, so
one shingle of each window is enough to find candidates: shingles are ordered by
rarity and the rarest is the window's prefix. Documents look their shingles up among
the prefixes; position and length bounds say where the window would have to lie, and
the word hashes of that place are compared with the window's.

Prefixes of up to ``BLOCK_WINDOWS`` windows are broadcast, counted before. More windows
are taken in blocks, one pass over the documents each, and the matches of the blocks
are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import in_arrow, query, stored, table, text_key
from hearken.llm.hashing import PUNCTUATION, hashed_texts, window_hashes

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 100_000


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``item_id, size, shape, words, shingles`` of every distinct window of every item.

    ``words`` are the word hashes, ``shingles`` the hashes of its runs of ``shingle``
    words (of all its words, if fewer). Items without words have no window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("item_id").to_pylist(), []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, _, _, _, words, _ in hashed_texts(texts, PUNCTUATION, lower=True):
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    own = words[at : at + size]
                    rows.append((ids[i], own, window_hashes(own, min(shingle, size))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], batch.schema.field("item_id").type),
                    pa.array([len(r[1]) for r in rows], pa.int32()),
                    pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())),
                ],
                names=["item_id", "size", "words", "shingles"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return in_arrow(
        benchmark.select("item_id", "text"),
        cut,
        f"item_id {kind}, size int, words array<long>, shingles array<long>",
    ).distinct()


def with_prefix(windows: DataFrame) -> DataFrame:
    """Adds ``prefix`` and ``offset``: the rarest shingle of each window and its place.

    Rarity is the number of windows a shingle stands in; ties go by its hash.
    """
    named = windows.withColumn("w", F.xxhash64("size", "words"))
    each = named.select("w", F.posexplode("shingles").alias("offset", "s")).distinct()
    rarity = each.groupBy("s").agg(F.count("*").alias("n"))
    rarest = (
        each.join(rarity, "s")
        .groupBy("w")
        .agg(F.min(F.struct("n", "s", "offset")).alias("best"))
        .select("w", F.col("best.s").alias("prefix"), F.col("best.offset").alias("offset"))
    )
    return named.join(rarest, "w").drop("w", "shingles")


class WindowIndex:
    """Prefixes of one block of windows, as sorted arrays; what a task looks up."""

    def __init__(self, rows: list) -> None:
        self.by_width: dict[int, tuple] = {}
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(min(SHINGLE, r["size"]), []).append(r)
        for width, own in by.items():
            own.sort(key=lambda r: r["prefix"] & (2**64 - 1))
            prefix = np.array([r["prefix"] for r in own], np.int64).view(np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[prefix >> np.uint64(44)] = True
            self.by_width[width] = (
                prefix,
                seen,
                np.array([r["offset"] for r in own]),
                [np.array(r["words"], np.int64).view(np.uint64) for r in own],
                [r["item_id"] for r in own],
            )

    def matches(self, words: np.ndarray) -> list[tuple]:
        """``item_id, start, size`` of every place where a window stands in ``words``."""
        found = []
        for width, (prefix, seen, offsets, windows, items) in self.by_width.items():
            shingles = window_hashes(words, width)
            maybe = np.flatnonzero(seen[shingles >> np.uint64(44)])
            if not len(maybe):
                continue
            low = np.searchsorted(prefix, shingles[maybe], "left")
            high = np.searchsorted(prefix, shingles[maybe], "right")
            for at, first, last in zip(maybe, low, high, strict=True):
                for k in range(first, last):
                    start, own = at - offsets[k], windows[k]
                    if 0 <= start <= len(words) - len(own) and np.array_equal(
                        words[start : start + len(own)], own
                    ):
                        found.append((items[k], int(start), len(own)))
        return found


def _covered(n: int, spans: list[tuple[int, int]]) -> int:
    edge = np.zeros(n + 1, np.int32)
    for start, size in spans:
        edge[start] += 1
        edge[start + size] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


_MATCH = "array<struct<item_id: {0}, start: int, size: int>>"


def window_blocks(
    benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS
) -> list[DataFrame]:
    """The items' windows with their prefixes, in blocks of about ``block`` windows."""
    prefixes = stored(with_prefix(item_windows(benchmark, window, SHINGLE)), "windows")
    blocks = max(1, -(-prefixes.count() // block))
    if blocks == 1:
        return [prefixes]
    number = F.pmod(F.xxhash64("words"), F.lit(blocks))
    return [prefixes.where(number == b) for b in range(blocks)]


def find_windows(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS
) -> DataFrame:
    """``doc_id, key, n_words, n_hit, matches`` of every row; ``key`` is ``text_key``'s.

    ``matches`` lists item, first word and length of every occurring window; ``n_hit``
    counts the words inside any of them. Null or wordless texts have no words and no
    match, nor have such items. Rows that repeat an id are documents of their own, equal
    rows get equal results; items that share an id count as one. Other columns are
    ignored. Either table may be empty.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, key long, n_words int, n_hit int, matches {_MATCH.format(kind)}"
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    out_type = pa.list_(
        pa.struct([("item_id", _arrow(kind)), ("start", pa.int32()), ("size", pa.int32())])
    )

    def one_pass(index: Broadcast) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                n, hit, matches = [], [], []
                for _, _, _, _, words, _ in hashed_texts(texts, PUNCTUATION, lower=True):
                    found = index.value.matches(words)
                    n.append(len(words))
                    hit.append(_covered(len(words), [f[1:] for f in found]) if found else 0)
                    matches.append([dict(zip(("item_id", "start", "size"), f)) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("key"),
                        pa.array(n, pa.int32()),
                        pa.array(hit, pa.int32()),
                        pa.array(matches, out_type),
                    ],
                    names=["doc_id", "key", "n_words", "n_hit", "matches"],
                )

        return in_arrow(rows, look, schema)

    def broadcast(own: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(WindowIndex(own.collect()))

    first, *others = window_blocks(benchmark, window, block)
    if not others:
        return one_pass(broadcast(first))
    # one block's index at a time is on the executors; what a pass found is written
    passes = []
    for own in (first, *others):
        index = broadcast(own)
        found = one_pass(index)
        passes.append(stored(found if own is first else found.where("n_hit > 0"), "matches"))
        index.destroy()
    more = passes[1]
    for other in passes[2:]:
        more = more.unionByName(other)
    more = more.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("_more")
    )
    first = passes[0]
    joined = first.join(
        more, first["doc_id"].eqNullSafe(more["_id"]) & (first["key"] == more["_key"]), "left"
    )
    every = F.when(F.col("_more").isNull(), F.col("matches")).otherwise(
        F.concat("matches", "_more")
    )
    return joined.select("doc_id", "key", "n_words", every.alias("matches")).select(
        "doc_id", "key", "n_words", _words_hit(F.col("matches")).alias("n_hit"), "matches"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs``, all columns, without the documents that hold any window of an item.

    Each block of windows is a filter over the rows that the blocks before it left; rows
    are never shuffled.
    """

    def without(rows: DataFrame, own: DataFrame) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(own.collect()))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                stay = [
                    not index.value.matches(words)
                    for _, _, _, _, words, _ in hashed_texts(texts, PUNCTUATION, lower=True)
                ]
                yield batch.filter(pa.array(stay, pa.bool_()))

        return in_arrow(rows, clean, docs.schema)

    first, *others = window_blocks(benchmark, window, block)
    kept = without(docs, first)
    for own in others:
        kept = without(stored(kept, "clean"), own)
    return kept


def _words_hit(matches):
    """Length of the union of the spans: sorted by start, each adds what it has beyond the last."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"], m["size"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, s):
        end = s["start"] + s["size"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"),
        )

    return F.aggregate(spans, zero, add)["n"]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


_W = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = common.SQL_LOWER.format("text")


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '{_W}') AS w
               FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_W}') AS w
          FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT item_id, len(w) AS n, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i
           FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, least(n, {WINDOW}) AS size,
                       array_to_string(w[i : i + least(n, {WINDOW}) - 1], ' ') AS k FROM bw),
    sizes AS (SELECT DISTINCT size FROM windows),
    dw AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
           FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
                 FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT r, item_id, i, size FROM dw JOIN windows USING (size, k)),
    hits AS (SELECT r, count(DISTINCT p) AS n
             FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
    items AS (SELECT r, count(DISTINCT item_id) AS n,
                     string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
              FROM m GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit,
           coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(hits.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside a window of a benchmark item."""
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("matches.item_id").cast("array<string>")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
