"""Remove passages of words that occur more than once in the corpus.

Every run of ``WINDOW`` words that starts at two places or more is removed at all of
them. Suffix automata of corpus shards, each broadcast to all documents, would find the
same runs but read the corpus once per shard (see the README for figures), so windows are
counted by hash, after a filter that leaves out almost all windows that occur once:

1. A window's anchor is the least hash among its runs of half the length. Equal windows
   have equal anchors, and neighbouring windows mostly share theirs, so only about a
   tenth as many anchors as words are counted.
2. Anchors met twice or more are marked in a bitmap of bounded size, which is broadcast.
   A full bitmap would only let more windows pass; it never loses one.
3. Windows whose anchor is marked are counted by their own hash. Those met twice or more
   get a bitmap as well, which picks the places that are joined with them; words that
   their windows cover go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import in_arrow, query, stored, table, text_key
from hearken.llm.hashing import SPACES, hashed_texts, window_hashes

WINDOW = 35
#: Bits of the bitmap: sixteen for each repeated anchor, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def window_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window, and the hashes of all runs chosen by any window, ties included."""
    part = (window + 1) // 2
    runs = window_hashes(words, part)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    anchor = runs[:n].copy()
    for k in range(1, window - part + 1):
        np.minimum(anchor, runs[k : k + n], out=anchor)
    chosen = np.zeros(len(runs), bool)
    for k in range(window - part + 1):
        chosen[k : k + n] |= runs[k : k + n] == anchor
    return anchor, runs[chosen]


def _words(texts: list, separator=SPACES):
    for i, _, _, _, words, _ in hashed_texts(texts, separator, lower=False):
        yield i, words


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """``h``: anchors that windows of ``docs`` have at two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [window_anchors(words, window)[1] for _, words in _words(texts)]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"]
            )

    counted = in_arrow(docs.select("text"), count, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def anchor_bitmap(anchors: DataFrame) -> np.ndarray:
    """Bits set at the low bits of each anchor; at most ``MOST_BITS``, gathered as words of 64."""
    bits, wanted = LEAST_BITS, 16 * anchors.count()
    while bits < MOST_BITS and bits < wanted:
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    marked = (
        anchors.select(
            F.shiftright(at, 6).cast("int").alias("w"),
            F.call_function(
                "shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")
            ).alias("b"),
        )
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[marked.column("w").to_numpy()] = marked.column("b").to_numpy()
    return words.view(np.uint64)


def marked_in(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    at = anchors & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def repeated_windows(docs: DataFrame, window: int, bitmap: Broadcast) -> DataFrame:
    """``h``: hashes of windows that start at two places or more, among those of marked anchors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [np.zeros(0, np.uint64)]
            for _, words in _words(texts):
                marked = marked_in(bitmap.value, window_anchors(words, window)[0])
                if marked.any():
                    found.append(window_hashes(words, window)[marked])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"]
            )

    counted = in_arrow(docs.select("text"), count, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def repeated_places(docs: DataFrame, window: int) -> DataFrame:
    """``_id, _key, marks``: for each row of ``docs`` with repeated windows where they start,
    as numbers of 64-place groups with the places' bits.

    The repeated windows get a bitmap of their own, so that hardly any place travels whose
    window occurs once; the join with the windows' hashes then decides.
    """
    context = docs.sparkSession.sparkContext
    anchors = context.broadcast(anchor_bitmap(stored(repeated_anchors(docs, window), "anchors")))
    repeated = stored(repeated_windows(docs, window, anchors), "windows")
    anchors.unpersist()
    bitmap = context.broadcast(anchor_bitmap(repeated))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            at, windows, row = [], [], []
            for i, words in _words(texts):
                own = window_hashes(words, window)
                start = np.flatnonzero(marked_in(bitmap.value, own))
                if len(start):
                    at.append(start)
                    windows.append(own[start])
                    row.append(np.full(len(start), i))
            if not row:
                continue
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row),
                    batch.column("key").take(row),
                    pa.array(np.concatenate(at).astype(np.int32)),
                    pa.array(np.concatenate(windows).view(np.int64)),
                ],
                names=["_id", "_key", "at", "h"],
            )

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    places = in_arrow(keyed, candidates, f"_id {kind}, _key long, at int, h long")
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")
    )
    return (
        places.join(repeated, "h")
        .groupBy("_id", "_key", F.shiftright("at", 6).alias("w"))
        .agg(F.bit_or(bit).alias("b"))
        .groupBy("_id", "_key")
        .agg(F.collect_list(F.struct("w", "b")).alias("marks"))
    )


def covered_words(n: int, marks: list[dict], window: int) -> np.ndarray:
    """For n words, which lie in a window that starts at a marked place."""
    edge = np.zeros(n + 1, np.int64)
    for mark in marks:
        bits = np.uint64(mark["b"] & (2**64 - 1)) >> np.arange(64, dtype=np.uint64)
        start = 64 * mark["w"] + np.flatnonzero(bits & np.uint64(1))
        edge[start] += 1
        edge[start + window] -= 1
    return np.cumsum(edge)[:n] > 0


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words left, joined by single spaces.

    A word goes if a window of ``window`` words around it also starts anywhere else, in
    the same row or another; windows are judged on the input. Null and blank texts have
    no words and come back empty. Rows are documents of their own, also those that repeat
    an id; equal rows of a window's length or more lose everything. Null ids stay null, other
    columns are ignored, an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    # equal rows have the same places twice; their counts come from the windows
    places = repeated_places(docs, window)
    keyed = docs.withColumn("_row", text_key(F.col("text")))
    joined = keyed.join(
        places,
        keyed["doc_id"].eqNullSafe(places["_id"]) & (keyed["_row"] == places["_key"]),
        "left",
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n, gone, kept = [], [], []
            for text, marks in zip(texts, batch.column("marks").to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if marks:
                    stay = ~covered_words(len(words), marks, window)
                    words = list(compress(words, stay.tolist()))
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        joined.select("doc_id", "text", "marks"),
        rebuild,
        f"doc_id {kind}, n_words long, n_removed long, text string",
    )


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      {common.SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    starts AS (SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k
               FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 1} + 1)) AS i
                     FROM d WHERE len(w) >= {WINDOW})),
    twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p
             FROM starts JOIN twice USING (k)),
    each AS (SELECT d.r, d.doc_id, x.p, w[x.p] AS word
             FROM d, (SELECT r, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE d.r = x.r)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN (
      SELECT each.r, count(gone.p) AS n,
             string_agg(word, ' ' ORDER BY each.p) FILTER (WHERE gone.p IS NULL) AS kept
      FROM each LEFT JOIN gone ON each.r = gone.r AND each.p = gone.p GROUP BY each.r
    ) x ON d.r = x.r
    """
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` without the runs of 35 words that occur more than once."""
    return drop_repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )
