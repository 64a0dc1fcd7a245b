"""Ranked lexical search by exact inner products over sparse ball trees.

A document's vector has for each term an integer that grows with the term's count and
shrinks with the document's length; an item's vector has the terms' weights. The score is
their inner product. Only terms of the items are kept, so vectors are short.

Each task builds ball trees over its own documents, some thousands at a time: a node has
the centroid of its vectors, the radius of their ball, and along each term the greatest
distance above the centroid. A node's scores are at most

    <item, centroid> + min(|item| * radius, sum over terms of item's weight * distance along the term)

The first is computed in doubles and raised by a margin far above their rounding errors; the
second is the item's product with the greatest entries, in integers. Nodes are taken best bound first; those whose bound is below the least score still wanted are pruned with
all below them. Leaves are scored in 64-bit integers. The scores wanted start from those
of a bounded sample of the documents, which can only be too low, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import in_arrow, query, stored, table, text_key
from hearken.llm.hashing import PUNCTUATION, hashed_texts

TOP = 10
#: Documents of one tree and of one leaf, and of the sample.
TREE_ROWS, LEAF_ROWS = 4096, 32
SAMPLE_ROWS = 20_000
#: Distinct terms of the items that one pass looks for; more items make more passes.
BLOCK_TERMS = 20_000
#: Relative margin on sums of doubles, far above n * 2**-53 for n entries of a node.
MARGIN = 1e-7
_SCALE = 1_000_000_000
_BITS = np.uint64(44)


# -- terms --------------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, key, terms, counts``: each distinct item's term hashes with their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [
                np.unique(hashes, return_counts=True)
                for _, _, _, _, hashes, _ in hashed_texts(texts, PUNCTUATION, lower=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    batch.column("key"),
                    pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())),
                    pa.array([n for _, n in found], pa.list_(pa.int64())),
                ],
                names=["item_id", "key", "terms", "counts"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text", text_key(F.col("text")).alias("key"))
    return in_arrow(
        rows.dropDuplicates(["item_id", "key"]),
        cut,
        f"item_id {kind}, key long, terms array<long>, counts array<long>",
    )


class Vocabulary:
    """Numbers of the terms that are looked for."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes  # sorted
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> _BITS] = True

    def counts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers among ``words``, ascending, and how often each occurs."""
        words = words[self.seen[words >> _BITS]]
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.unique(at[self.hashes[at] == words], return_counts=True)


def term_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, key, n, terms, tf``: number of terms of each row, and the vocabulary's."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n, terms, tf, size = [], [], [], [0]
            for _, _, _, _, words, _ in hashed_texts(texts, PUNCTUATION, lower=True):
                own, times = known.value.counts(words)
                n.append(len(words))
                terms.append(own)
                tf.append(times)
                size.append(size[-1] + len(own))
            offsets = pa.array(size, pa.int32())
            none = np.zeros(0, np.int64)
            lists = (
                pa.ListArray.from_arrays(
                    offsets, pa.array(np.concatenate([none, *x]).astype(np.int32))
                )
                for x in (terms, tf)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), *lists],
                names=["doc_id", "key", "n", "terms", "tf"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        docs.select("doc_id", "text", text_key(F.col("text")).alias("key")),
        count,
        f"doc_id {kind}, key long, n long, terms array<int>, tf array<int>",
    )


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each term; ``size`` numbers at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "n"]
        )

    counted = in_arrow(vectors.select("terms"), count, "term int, n long")
    df = np.zeros(size, np.int64)
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row["term"]] = row["n"]
    return df


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# -- trees --------------------------------------------------------------------------------


class BallTree:
    """A balanced binary tree over sparse integer vectors, given as rows in CSR form.

    Node 0 is the root, node i has children 2i+1 and 2i+2; ``order`` lists the rows leaf by
    leaf, and node i holds ``order[start[i]:end[i]]``.
    """

    def __init__(
        self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int,
        leaf: int = LEAF_ROWS,
    ) -> None:
        rows = len(offsets) - 1
        depth = max(0, math.ceil(math.log2(max(1, rows) / leaf)))
        self.depth, self.size = depth, size
        self.order = self._split(offsets, terms, values.astype(np.float64), depth)
        length = np.diff(offsets)[self.order]
        self.offsets = np.concatenate(([0], np.cumsum(length)))
        entry = np.repeat(offsets[:-1][self.order] - self.offsets[:-1], length)
        entry += np.arange(len(terms))
        self.terms, self.values = terms[entry], values[entry]
        row_of = np.repeat(np.arange(rows), length)
        n_nodes = (2 << depth) - 1
        self.start, self.end = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        self.centroid = np.zeros((n_nodes, size))
        self.radius, self.most = np.zeros(n_nodes), np.zeros((n_nodes, size), np.int64)
        for level in range(depth + 1):
            first, n = (1 << level) - 1, 1 << level
            edge = np.arange(n + 1) * rows // n
            self.start[first : first + n], self.end[first : first + n] = edge[:-1], edge[1:]
            self._balls(first, edge, row_of)

    @staticmethod
    def _split(offsets, terms, values, depth) -> np.ndarray:
        """Rows in leaf order: each level halves every node along the line through the row
        farthest from another and the row farthest from that."""
        rows = len(offsets) - 1
        order = np.arange(rows)
        row_of = np.repeat(order, np.diff(offsets))
        square = np.bincount(row_of, values * values, rows)
        size = int(terms.max(initial=0)) + 1

        def dots(direction: np.ndarray) -> np.ndarray:
            """Inner products of all rows, each with its own node's direction."""
            return np.bincount(row_of, values * direction[node[row_of], terms], rows)

        def dense(rows_: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows_), size))
            for k, r in enumerate(rows_):
                out[k, terms[offsets[r] : offsets[r + 1]]] = values[offsets[r] : offsets[r + 1]]
            return out

        node = np.zeros(rows, np.int64)
        for level in range(depth):
            n = 1 << level
            edge = np.arange(n + 1) * rows // n
            node[order] = np.repeat(np.arange(n), np.diff(edge))

            def farthest(pivot: np.ndarray) -> np.ndarray:
                far = (square - 2 * dots(dense(pivot)))[order]
                return np.array([order[a + np.argmax(far[a:b])] for a, b in zip(edge, edge[1:])])

            one = farthest(order[edge[:-1]])
            other = farthest(one)
            along = dots(dense(one) - dense(other))
            order = order[np.lexsort((along[order], node[order]))]
        return order

    def _balls(self, first: int, edge: np.ndarray, row_of: np.ndarray) -> None:
        """Centroids, radii and greatest entries of the nodes of one level, rounded up."""
        n, rows = len(edge) - 1, len(self.order)
        node_of = np.repeat(np.arange(n), np.diff(edge))
        values = self.values.astype(np.float64)
        cell = node_of[row_of] * self.size + self.terms
        centre = np.bincount(cell, values, n * self.size).reshape(n, self.size)
        centre /= np.diff(edge)[:, None]
        self.centroid[first : first + n] = centre
        np.maximum.at(self.most[first : first + n].reshape(-1), cell, self.values)
        whole = (centre * centre).sum(1)[node_of]
        far = whole + np.bincount(row_of, values * (values - 2 * centre.reshape(-1)[cell]), rows)
        far += MARGIN * (np.bincount(row_of, values * values, rows) + whole)
        self.radius[first : first + n] = np.sqrt(np.maximum.reduceat(far, edge[:-1]).clip(0))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a number that no inner product with one of its rows exceeds."""
        norm = math.sqrt(float((weights.astype(np.float64) ** 2).sum()))
        ball = (self.centroid[:, terms] @ weights + norm * self.radius) * (1 + MARGIN) + 1
        return np.minimum(ball, self.most[:, terms] @ weights)

    def search(
        self, terms: np.ndarray, weights: np.ndarray, least: int, offer
    ) -> tuple[int, int]:
        """Calls ``offer(rows, scores)`` for the rows of leaves that may hold a score of
        ``least`` or more; it returns the new ``least``. Gives leaves scored, and all."""
        bound = self.bounds(terms, weights)
        dense = np.zeros(self.size, np.int64)
        dense[terms] = weights
        heap, leaves = [(-bound[0], 0)], 0
        inner = (1 << self.depth) - 1
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            if node < inner:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            leaves += 1
            a, b = self.start[node], self.end[node]
            at = self.offsets[a:b]
            entries = slice(at[0], self.offsets[b])
            scores = np.add.reduceat(
                dense[self.terms[entries]] * self.values[entries], at - at[0]
            )
            least = offer(self.order[a:b], scores)
        return leaves, inner + 1


class Best:
    """The best ``k`` scores of one item so far; ties go to the least document."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least, self.rows = k, least, []

    def offer(self, documents: list, scores: np.ndarray) -> int:
        good = np.flatnonzero(scores >= self.least)
        if len(good):
            self.rows += [(-int(scores[i]), documents[i]) for i in good]
            self.rows.sort()
            del self.rows[self.k :]
            if len(self.rows) == self.k:
                self.least = max(self.least, -self.rows[-1][0])
        return self.least


# -- search -------------------------------------------------------------------------------


def _document_values(n, tf, documents: int, length: int) -> np.ndarray:
    """The integer of every entry, from its row's number of terms and its own count."""
    m = 25 + (75 * n * documents) // length
    return (_SCALE * tf) // (1000 * tf + 8 * m)


def _task_best(
    vectors: DataFrame, queries: list, documents: int, length: int, size: int, k: int, least: list
) -> DataFrame:
    """``item, doc_id, key, score``: for each query the best rows of every task."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = shared.value
        best = [Best(k, x) for x in floor]
        for table_ in _in_trees(batches):
            ids, keys = table_.column("doc_id").to_pylist(), table_.column("key").to_pylist()
            # null ids come first
            documents_ = [(i is not None, i, key) for i, key in zip(ids, keys)]
            terms = table_.column("terms").combine_chunks()
            offsets = terms.offsets.to_numpy().astype(np.int64)
            count = np.diff(offsets)
            n = np.repeat(table_.column("n").to_numpy(), count)
            tf = table_.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            tree = BallTree(
                offsets - offsets[0],
                terms.flatten().to_numpy(),
                _document_values(n, tf, documents, length),
                size,
            )
            for (own, weights), top in zip(items, best, strict=True):
                tree.search(
                    own,
                    weights,
                    top.least,
                    lambda rows, scores, top=top: top.offer([documents_[r] for r in rows], scores),
                )
        found = [(q, *doc[1:], -s) for q, top in enumerate(best) for s, doc in top.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int32(), kind, pa.int64(), pa.int64()))],
            names=["item", "doc_id", "key", "score"],
        )

    ddl = vectors.schema["doc_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[ddl]
    # documents without any of the terms have score 0
    return in_arrow(
        vectors.where(F.size("terms") > 0), rank, f"item int, doc_id {ddl}, key long, score long"
    )


def _in_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``TREE_ROWS``."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TREE_ROWS):
            part = batch.slice(at, TREE_ROWS)
            held.append(part)
            rows += part.num_rows
            if rows >= TREE_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank`` up to ``k``; tasks' rows of an item are ranked in slices first."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("key")]

    def cut(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(64)))
    return cut(cut(sliced, "item", "_slice").drop("rank"), "item").drop("_slice")


def _blocks(items: list, block: int) -> list[list]:
    """Items in groups that look for up to ``block`` distinct terms each (one item at least)."""
    out, seen = [[]], set()
    for item in items:
        own = set(item["terms"])
        if out[-1] and len(seen | own) > block:
            out.append([])
            seen = set()
        seen |= own
        out[-1].append(item)
    return out


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    hashes = np.unique(np.array([t for r in items for t in r["terms"]], np.int64).view(np.uint64))
    vectors = stored(term_counts(docs, Vocabulary(hashes)), "vectors")
    totals = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = totals
    df = document_frequencies(vectors, len(hashes))
    weight = np.array([term_weight(documents, int(x)) for x in df], np.int64)
    queries = []
    for r in items:
        at = np.searchsorted(hashes, np.array(r["terms"], np.int64).view(np.uint64))
        queries.append((at, weight[at] * np.array(r["counts"], np.int64)))

    def best(rows: DataFrame, least: list) -> DataFrame:
        return _task_best(rows, queries, documents, length, len(hashes), k, least)

    least = [1] * len(items)
    if documents > SAMPLE_ROWS:
        share = F.pmod(F.xxhash64("doc_id", "key"), F.lit(-(-documents // SAMPLE_ROWS))) == 0
        top = _ranked(best(vectors.where(share), least), k).where(F.col("rank") == k)
        for row in top.select("item", "score").collect():
            least[row["item"]] = row["score"]
    ids = spark.createDataFrame(
        [(q, r["item_id"], r["key"]) for q, r in enumerate(items)],
        f"item int, item_id {items[0]['kind']}, item_key long",
    )
    return _ranked(stored(best(vectors, least), "best"), k).join(F.broadcast(ids), "item").select(
        "item_id", "item_key", "rank", "doc_id", "score"
    )


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, item_key, rank, doc_id, score``: the ``k`` best rows of ``docs`` for each item.

    Only scores above 0 count; equal ones go by ascending ``doc_id``, null first, then by
    text key. Every row of ``docs`` is a document, repeated rows too. Items equal in id and
    text are one; items that share an id alone are told apart by ``item_key``. Null or empty
    texts have no terms: such items find nothing, such documents are never found. Other
    columns are ignored; either table may be empty.

    The items' terms are gathered in blocks of about ``block`` distinct terms, each a pass over the
    documents with its own broadcast.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    known = [
        r.asDict() | {"kind": kind}
        for r in item_terms(items).where(F.size("terms") > 0).orderBy("item_id", "key").collect()
    ]
    out = None
    for part in _blocks(known, block) if known else []:
        found = _search_block(docs, part, k)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame(
        [], f"item_id {kind}, item_key long, rank int, doc_id {doc_kind}, score long"
    )


_TERMS = (
    "regexp_extract_all("
    + common.SQL_LOWER.format("coalesce(text, '')")
    + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
    s AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
    i AS (SELECT row_number() OVER () AS q, item_id, t
          FROM (SELECT DISTINCT item_id, text, {_TERMS} AS t FROM benchmark)),
    qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM i) GROUP BY ALL),
    dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
           WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
          FROM dt, s GROUP BY term, big_n),
    score AS (SELECT q, d.r, doc_id,
                     sum(times * w * ((1000000000 * tf)
                         // (1000 * tf + 8 * (25 + (75 * len(d.t) * big_n) // l))))::BIGINT AS score
              FROM qt JOIN w USING (term) JOIN dt USING (term) JOIN d USING (r), s GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank
               FROM score WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN i USING (q)
    WHERE rank <= {TOP}
    """
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for every item of ``benchmark``."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
