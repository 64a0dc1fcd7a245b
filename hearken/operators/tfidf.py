"""Character n-gram TF-IDF as tables: smoothed idf, raw counts, unit-length rows.

Grams are counted by numpy over blocks of texts. Inside a block a gram is a number, so the text of a
gram moves once a block and not once a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.text import one_blank
from hearken.operators.skew import ROWS_PER_SLICE, heavy_from_counts, sliced_join

MIN_DF = 2
LONGEST = 5
#: Code points of the texts of one block, or those of one document.
BLOCK_CHARS = 1 << 19
#: Numbers that stand for grams stay below this.
MOST = 1 << 62

FOUND = pa.schema({"_block": pa.int64(), "gram": pa.string(), "at": pa.int32(), "n": pa.int64()})


@dataclass
class Grams:
    """All grams of one length: where each one starts (once), and its times in each row.

    ``rank`` numbers the grams in an order that depends on the texts alone.
    """

    length: int
    start: np.ndarray
    row: np.ndarray
    rank: np.ndarray
    tf: np.ndarray


class Block:
    """Texts, one after the other, whose character 1-5-grams are counted."""

    def __init__(self, texts: list[str]):
        whole = "".join(texts)
        self.points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.bytes = np.frombuffer(whole.encode(), np.uint8)
        width = 1 + sum((self.points >= least).astype(np.int8) for least in (0x80, 0x800, 0x10000))
        self.at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        self.lengths = np.array([len(t) for t in texts], np.int64)

    def grams(self) -> Iterator[Grams]:
        n = len(self.points)
        if not n:
            return
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        # Whether a gram from here ends within its text; for each length, one place more of a text falls out.
        end = np.cumsum(self.lengths)[self.lengths > 0]
        inside = np.ones(n, bool)
        code, _ = _ranked(self.points.astype(np.int64), int(self.points.max()) + 1)
        letters = int(code.max()) + 1
        key, kinds = code, letters
        for length in range(1, LONGEST + 1):
            if length > 1:
                if kinds * letters >= MOST:
                    key, found = _ranked(key, kinds)
                    kinds = len(found)
                key, kinds = key[:-1] * letters + code[length - 1 :], kinds * letters
                inside[np.maximum(end - length + 1, 0)] = False
            here = np.flatnonzero(inside[: len(key)])
            if not len(here):
                return
            rank, found = _ranked(key[here], kinds)
            pairs = row[here] * len(found) + rank
            if len(self.lengths) * len(found) < 1 << 31:
                pairs = pairs.astype(np.int32)
            pairs.sort()
            new = np.empty(len(pairs), bool)
            new[:1], new[1:] = True, pairs[1:] != pairs[:-1]
            first = np.flatnonzero(new)
            tf = np.diff(first, append=len(pairs))
            own_row, own_rank = np.divmod(pairs[first], len(found))
            yield Grams(length, here[found], own_row, own_rank, tf)

    def texts(self, start: np.ndarray, length: int) -> pa.StringArray:
        """The grams of ``length`` code points from each ``start``."""
        begin = self.at[start]
        size = self.at[start + length] - begin
        offsets = np.concatenate([[0], np.cumsum(size)])
        taken = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.bytes[taken])]
        return pa.StringArray.from_buffers(len(start), buffers[1], buffers[2])


def _ranked(key: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's number among the distinct ones in ascending order, and a place of each of these."""
    if kinds <= 2 * len(key):  # a table is quicker than sorting
        place = np.full(kinds, -1)
        place[key] = np.arange(len(key))
        known = place >= 0
        return (np.cumsum(known) - 1)[key], place[known]
    bits = len(key).bit_length()
    if kinds << bits < MOST:  # sorting numbers is quicker than sorting places
        key = np.sort(key << bits | np.arange(len(key)))
        order = key & ((1 << bits) - 1)
        key >>= bits
    else:
        order = np.argsort(key)
        key = key[order]
    first = np.empty(len(key), bool)
    first[:1], first[1:] = True, key[1:] != key[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(first) - 1
    return rank, order[first]


def _cut(lengths: np.ndarray) -> Iterator[slice]:
    """Rows whose texts have ``BLOCK_CHARS`` together, or one row."""
    begin, held = 0, 0
    for row, n in enumerate(lengths):
        if row > begin and held + n > BLOCK_CHARS:
            yield slice(begin, row)
            begin, held = row, 0
        held += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def ngram_counts(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, gram, tf) over the whole normalised text, counted inside each row: nothing
    moves. Rows that repeat an id keep counts of their own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [one_blank(t) for t in batch.column(1).to_pylist()]
            for part in _cut(np.array([len(t) for t in texts])):
                ids, block = batch.column(0)[part], Block(texts[part])
                for g in block.grams():
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(g.row)),
                            block.texts(g.start[g.rank], g.length),
                            pa.array(g.tf),
                        ],
                        names=[id_col, "gram", "tf"],
                    )

    lowered = docs.select(id_col, F.lower(text).alias("_lower"))
    return lowered.mapInArrow(count, f"`{id_col}` {kind}, gram string, tf long")


def ngram_df(docs: DataFrame, text: str = "text", min_df: int = MIN_DF) -> DataFrame:
    """Documents per gram. Grams are made distinct inside each row and added up in each
    block of rows and each task, so what is shuffled is a gram with a count, once a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += [one_blank(t) for t in batch.column(0).drop_null().to_pylist()]
            parts = list(_cut(np.array([len(t) for t in held])))
            for part in parts[:-1]:
                yield from sums(held[part])
            held = held[parts[-1]] if parts else []
        yield from sums(held)

    def sums(texts: list[str]) -> Iterator[pa.RecordBatch]:
        block = Block(texts)
        for g in block.grams():
            yield pa.RecordBatch.from_arrays(
                [block.texts(g.start, g.length), pa.array(np.bincount(g.rank))], names=["gram", "n"]
            )

    grams = docs.select(F.lower(text).alias("_lower")).mapInArrow(count, "gram string, n long")
    return grams.groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)


def idf(n_docs, df):
    return np.log((1 + n_docs) / (1 + df)) + 1


def char_tfidf(
    docs: DataFrame,
    id_col: str,
    text: str = "text",
    min_df: int = MIN_DF,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(id, gram, tf, weight, unit_weight) rows.

    Documents are dealt to blocks of about ``BLOCK_CHARS`` by a hash of the id, rows of one id to the same one.
    A block sends each of its grams once, with its documents, and gets back how many documents
    of all have it, for the gram's number; weights and norms are then made inside the block. The
    blank has a row in every block: beyond ``rows_per_slice`` blocks its rows are joined in slices.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n_docs, chars = docs.agg(F.count(text), F.sum(F.char_length(text))).first()
    n_blocks = max(1, math.ceil((chars or 0) / BLOCK_CHARS))
    spark = docs.sparkSession
    tasks = max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    blocks = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(id_col).alias("_id"), F.lower(text).alias("_lower"))
        .withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)))
        .repartition(tasks, "_block")
    )

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        block, known, parts = _whole_block(_in_order(rows)), 0, []
        for g in block.grams():
            at = np.arange(known, known + len(g.start))
            known += len(at)
            arrays = [
                pa.array(np.full(len(at), key[0].as_py())),
                block.texts(g.start, g.length),
                pa.array(at.astype(np.int32)),
                pa.array(np.bincount(g.rank)),
            ]
            parts.append(pa.RecordBatch.from_arrays(arrays, schema=FOUND))
        return pa.Table.from_batches(parts, FOUND)

    def weigh(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        block, parts, begin = _whole_block(rows), [], 0
        df = np.zeros(len(block.points) * LONGEST, np.int64)
        df[known["at"].to_numpy()] = known["df"].to_numpy()
        ids = rows["_id"].combine_chunks()
        owner = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        square = np.zeros(len(owner))
        for g in block.grams():
            often = df[begin : begin + len(g.start)]
            begin += len(g.start)
            kept = often[g.rank] > 0
            row, rank, tf = g.row[kept], g.rank[kept], g.tf[kept]
            weight = tf * idf(n_docs, often)[rank]
            square += np.bincount(owner[row], weight * weight, len(owner))
            parts.append((row, g.start[rank], g.length, tf, weight))
        norm = np.sqrt(square)
        names = [id_col, "gram", "tf", "weight", "unit_weight"]
        kinds = [ids.type, pa.string(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_batches(
            [
                pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row)),
                        block.texts(start, length),
                        pa.array(tf),
                        pa.array(weight),
                        pa.array(weight / norm[owner[row]]),
                    ],
                    names=names,
                )
                for row, start, length, tf, weight in parts
            ],
            pa.schema(list(zip(names, kinds, strict=True))),
        )

    grams = blocks.groupBy("_block").applyInArrow(count, "_block long, gram string, at int, n long")
    if n_blocks <= rows_per_slice:
        found = grams.withColumn("df", F.sum("n").over(Window.partitionBy("gram")))
        found = found.where(F.col("df") >= min_df)
    else:
        frequencies = grams.groupBy("gram").agg(F.sum("n").alias("df"), F.count("*").alias("_rows"))
        frequencies = frequencies.where(F.col("df") >= min_df)
        heavy = heavy_from_counts(frequencies, ["gram"], "_rows", rows_per_slice)
        found = sliced_join(
            grams, frequencies.drop("_rows"), ["gram"], ["_block"], "inner", rows_per_slice, heavy
        )
    found = found.select("_block", "at", "df").repartition(tasks, "_block")
    return blocks.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(
        weigh, f"`{id_col}` {kind}, gram string, tf long, weight double, unit_weight double"
    )


def _in_order(rows: pa.Table) -> pa.Table:
    """The same order whenever a block is read, since grams are numbered in it."""
    return rows.sort_by([("_id", "ascending"), ("_lower", "ascending")])


def _whole_block(rows: pa.Table) -> Block:
    return Block([one_blank(t) for t in rows["_lower"].to_pylist()])


def tfidf_summary(weights: DataFrame, id_col: str) -> DataFrame:
    """Per document: terms, raw count, norm, greatest weight and squared length of the unit row."""
    rounded = F.round("weight", 6)
    return weights.groupBy(id_col).agg(
        F.count("*").alias("n_terms"),
        F.sum("tf").alias("n_grams"),
        F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 4).alias("norm"),
        F.max(rounded).alias("top_weight"),
        F.round(F.sum(F.col("unit_weight") * F.col("unit_weight")), 6).alias("unit_square"),
    )
