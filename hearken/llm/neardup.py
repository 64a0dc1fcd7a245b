"""Near duplicates by MinHash, with every link confirmed on the full shingle sets.

One pass hashes each document's words and word shingles. The set's hashes fall into
``BINS`` bins (one permutation); an empty bin borrows from the first full one in its own
fixed random order of bins (optimal densification). Bands of ``ROWS`` bins give bucket
keys. Documents with equal sets are one class, so copies cost one row each from then on.

Inside a bucket a star of candidate pairs is drawn, from its least document to the
others, never all pairs. A star may miss links between documents that are not both linked
to its centre. So buckets that still hold more than one component get one exact round over
all their documents: these sort their shingles from rare to frequent and meet on the few
rarest of which linked documents must share one. Documents whose own edits alone put them
out of reach drop out first; bounds by position and size and the components known so
far leave few of the other pairs to test. A group of copies thus costs one star, while no link
that could join two components stays unseen.

Of two documents with similarity s, a band of r rows agrees with chance s**r. With 6 rows and
32 bands a link at 0.85 misses all buckets with a chance of about 3e-7, with 5 rows and 38
bands a link at 0.8 does; more similar ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import in_arrow, query, stored, table, text_key, whole_rows
from hearken.llm.components import connected_components
from hearken.llm.hashing import (
    SPACES,
    hashed_texts,
    mix,
    sequence_hash,
    set_digest,
    window_hashes,
)

WORDS = 5
BINS = 192
#: Rows of a band, for links from 85 per cent and for those from 80.
ROWS, LOOSE_ROWS = 6, 5
#: Candidate ids that are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

#: Column i: the order in which bin i looks for a full bin.
_PROBES = np.array(
    [np.random.default_rng([7, i]).permutation(BINS) for i in range(BINS)], np.int64
).T.copy()
_BAND_SALT = mix(np.arange(1, BINS + 1, dtype=np.uint64))
_FACTOR = np.array([pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k in range(BINS)], np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, none is none."""
    if not len(words):
        return words
    if len(words) < size:
        return np.array([sequence_hash(words)], np.uint64)
    return np.unique(window_hashes(words, size))


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of a sorted, non-empty set of hashes, one for each band of ``rows`` bins."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.concatenate(([0], np.flatnonzero(bins[1:] != bins[:-1]) + 1))
    signature = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    signature[bins[first]] = values[first]
    empty = np.flatnonzero(~full)
    depth = 16
    for top in range(0, BINS, depth):
        if not len(empty):
            break
        probes = _PROBES[top : top + depth, empty]
        hit = full[probes]
        found = hit.any(axis=0)
        source = probes[hit.argmax(axis=0), np.arange(len(empty))]
        signature[empty[found]] = signature[source[found]]
        empty = empty[~found]
    bands = BINS // rows
    joined = signature[: bands * rows].reshape(bands, rows) * _FACTOR[:rows]
    return mix(joined.sum(axis=1, dtype=np.uint64) ^ _BAND_SALT[:bands])


def signatures(docs: DataFrame, size: int = WORDS, band_rows: int = ROWS) -> DataFrame:
    """``doc_id, key, n_shingles, digest, bands`` of every row; no digest or bands for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts, digests, bands = [], [], []
            for _, _, _, _, words, _ in hashed_texts(texts, SPACES, lower=True):
                values = shingle_set(words, size)
                counts.append(len(values))
                digests.append(set_digest(values) if len(values) else None)
                bands.append(band_keys(values, band_rows).view(np.int64) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n_shingles", "digest", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        docs.select("doc_id", "text", text_key(F.col("text")).alias("key")),
        sign,
        f"doc_id {kind}, key long, n_shingles long, digest binary, bands array<long>",
    )


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``rep, values``: the sets of the classes ``wanted (rep, digest)``, from their texts."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, digests = batch.column("rep").to_pylist(), batch.column("digest").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = []
            for i, _, _, _, words, _ in hashed_texts(texts, SPACES, lower=True):
                values = shingle_set(words, size)
                # another row may carry the same id
                if len(values) and set_digest(values) == digests[i]:
                    rows.append((reps[i], values.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], batch.schema.field("rep").type),
                    pa.array([r[1] for r in rows], pa.binary()),
                ],
                names=["rep", "values"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(texts.select("rep", "digest", "text"), build, f"rep {kind}, values binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked``: each pair with the test on its full sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                names=["a", "b", "linked"],
            )

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(
        sets.select(F.col("rep").alias("b"), F.col("values").alias("right")), "b"
    ).join(sets.select(F.col("rep").alias("a"), F.col("values").alias("left")), "a")
    return in_arrow(
        joined.select("a", "b", "left", "right"), test, f"a {kind}, b {kind}, linked boolean"
    )


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the least document of each bucket ``(key, rep, n)`` with its others.

    Pairs whose sizes alone rule a link out are left out.
    """
    centres = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"))
    fits = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
    return (
        members.join(centres, "key")
        .where((F.col("rep") != F.col("c.rep")) & fits)
        .select(F.col("c.rep").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``key, rep, n, rest``: the shingles of which a link at ``percent`` must share one.

    Shingles of a set stand in order of how many sets hold them, then of hash. ``rest``
    counts those from the key on that other sets hold too, so it bounds what two sets
    whose first common shingle is the key can share.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v, np.int64) for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.array([len(v) for v in values], pa.int64()),
                    pa.array(values, pa.list_(pa.int64())),
                ],
                names=["rep", "n", "keys"],
            )

    kind = sets.schema["rep"].dataType.simpleString()
    rows = in_arrow(
        sets.select("rep", "values"), unpack, f"rep {kind}, n long, keys array<long>"
    ).select("rep", "n", F.explode("keys").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(held, "key").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s")
    )
    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    prefix = F.slice("s", 1, F.size("s") - least.cast("int") + 1)
    return (
        shared.where(F.size("s") >= least)
        .select("rep", "n", F.size("s").alias("m"), F.posexplode(prefix).alias("i", "s"))
        .select(F.col("s.key").alias("key"), "rep", "n", (F.col("m") - F.col("i")).alias("rest"))
    )


def crossing_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of different components that share a rare shingle and may be linked.

    ``rare`` holds ``key, rep, n, rest, component``. Of each bucket, documents outside its
    largest component meet those of other components.
    """

    def enough(rest, n, other):
        return rest * (100 + percent) >= (n + other) * percent

    def split(rows: DataFrame) -> DataFrame:
        buckets = rows.groupBy("key").agg(
            F.min("n").alias("n_least"),
            F.min("component").alias("x"),
            F.max("component").alias("y"),
        )
        return rows.join(buckets.where("x <> y").select("key", "n_least"), "key")

    smallest = F.greatest(F.col("n_least"), F.col("n") * percent / 100)
    open_ = split(rare).where(enough(F.col("rest"), F.col("n"), smallest)).drop("n_least")
    open_ = stored(split(open_).drop("n_least"), "rare")
    largest = (
        open_.groupBy("key", "component")
        .agg(F.count("*").alias("size"))
        .groupBy("key")
        .agg(F.max(F.struct("size", "component")).alias("largest"))
    )
    centres = open_.join(largest, "key").where("component <> largest.component")
    centres = centres.select(
        "key", *[F.col(c).alias(f"c_{c}") for c in ("rep", "n", "rest", "component")]
    )
    may_link = (
        (F.col("component") != F.col("c_component"))
        & (F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent)
        & enough(F.least("rest", "c_rest"), F.col("n"), F.col("c_n"))
    )
    return (
        open_.join(centres, "key")
        .where(may_link)
        .select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = WORDS) -> DataFrame:
    """``doc_id, key, n_shingles, component_id`` of every row; ``key`` is ``text_key``'s.

    Documents are linked if their intersection holds at least ``percent`` per cent of
    their union; ``component_id`` is the least id reachable over links. Null and wordless
    texts have an empty set and are linked with nothing. Equal rows are linked like any
    equal texts; rows that share an id but not their text are documents of their own
    with one name. A row without id keeps a null component unless another row of
    its class has one. Other columns are ignored; an empty table gives an empty result.
    """
    if percent < 80:
        raise ValueError("bands are laid out for links from 80 per cent")
    rows = ROWS if percent >= 85 else LOOSE_ROWS
    signed = stored(signatures(docs, size, rows), "signatures")
    classes = stored(
        signed.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    named = classes.where("rep IS NOT NULL")
    keys = named.select(F.explode("bands").alias("key"), "rep", "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    members = stored(keys.join(shared, "key"), "members")
    wanted = members.select("rep").distinct().join(named.select("rep", "digest"), "rep")
    sets = stored(_sets(docs, wanted, size), "sets")
    stars = stored(star_pairs(members, percent), "pairs")
    component = connected_components(
        confirmed(stars, sets, percent).where("linked").select("a", "b")
    )
    # buckets that the stars did not join, and all documents of them
    of = component.select(F.col("node").alias("rep"), F.col("component").alias("_c"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(of, "rep", "left").select(
            *rows.columns, F.coalesce("_c", "rep").alias("component")
        )

    split = labelled(members).groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    )
    left = stored(
        members.join(split.where("x <> y").select("key"), "key").select("rep").distinct(), "left"
    )
    if not left.isEmpty():
        rare = labelled(rare_shingles(sets.join(left, "rep", "left_semi"), percent))
        crossing = stored(crossing_pairs(rare, percent), "pairs")
        more = confirmed(crossing, sets, percent).where("linked").select("a", "b")
        links = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        component = connected_components(links.unionByName(more))
    roots = named.select(F.col("digest").alias("_digest"), "rep")
    roots = roots.join(component, F.col("rep") == F.col("node"), "left").select(
        "_digest", F.coalesce("component", "rep").alias("component_id")
    )
    return signed.join(roots, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id",
        "key",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one of least id.

    Of rows equal in id and text one stays. Documents without words all stay.
    """
    found = near_duplicates(docs, percent, size)
    fate = stored(
        found.groupBy("doc_id", "key")
        .agg(
            F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_kept"),
            F.count("*").alias("_n"),
        )
        .where("NOT _kept OR _n > 1")
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_kept"),
        "fates",
    )
    keyed = whole_rows(docs)

    def same(other: DataFrame):
        return keyed["doc_id"].eqNullSafe(other["_id"]) & (keyed["_row"] == other["_key"])

    stay = keyed.join(fate, same(fate), "left_anti").select("_doc.*")
    repeated = fate.where("_kept")
    if repeated.isEmpty():
        return stay
    once = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_row"])
    return stay.unionByName(once.select("_doc.*"))


_WORDS = common.SQL_WORDS.format(common.SQL_LOWER.format("coalesce(text, '')"))


@query(
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i
                FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
              FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
              WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
              UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents LEFT JOIN n USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """
)
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents`` (similarity of 0.85 on 5-word shingles)."""
    found = near_duplicates(table(spark, sf_dir, "documents")).drop("key")
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
