"""Document fingerprints by SimHash, and search among them within a Hamming radius.

Only DataFrame functions run. A text's terms are its pairs of neighbouring words (a
single word by itself), weighted by how often they occur. Each occurrence votes with
the bits of a 128-bit hash; a fingerprint bit is set where more than half the votes are.
Votes of two bits are added in one 64-bit sum, in lanes of 32 bits, so a
fingerprint is 64 plain sums, added up before any shuffle.

The search cuts fingerprints into radius + 1 blocks: two within the radius agree in one
block at least, so a table keyed by block number and value finds all of them.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import query, stored, table, text_key

BITS = 128
RADIUS = 3
#: Every so many ids are taken as queries of the search.
QUERY_STEP = 50
#: Documents of neighbouring ids that are ordered together, and the most such ranges;
#: their bounds (two numbers each) are what the driver holds.
RANGE_ROWS = 2_000
MAX_RANGES = 20_000

_LANES = 0x0000000100000001
_HALF = 32


def term_hashes(text: Column) -> Column:
    """A hash for every occurrence of a term of the text."""
    words = common.word_array(text)

    def pairs(ws: Column) -> Column:
        pair = F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1))
        )
        return F.when(F.size(ws) > 1, pair).otherwise(
            F.transform(ws, lambda w: F.xxhash64(w))
        )

    # transform over a one-element array names the words, so they are split once
    return F.flatten(F.transform(F.array(words), pairs))


def fingerprint_columns(df: DataFrame, keys: list[str], term: str) -> DataFrame:
    """``keys, a, b``: fingerprints as two longs, from one row per term occurrence.

    ``term`` is the term's hash; null stands for a text without terms, which gets 0.
    """
    second = F.when(F.col(term).isNotNull(), F.xxhash64(term))
    lanes = [
        F.sum(F.shiftright(h, k).bitwiseAND(F.lit(_LANES))).alias(f"{name}{k}")
        for name, h in (("a", F.col(term)), ("b", second))
        for k in range(_HALF)
    ]
    votes = df.groupBy(*keys).agg(F.count(term).alias("_n"), *lanes)

    def packed(name: str) -> Column:
        value = F.lit(0).cast("long")
        for k in range(_HALF):
            lane = F.col(f"{name}{k}")
            low = lane.bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(lane, _HALF)
            for ones, at in ((low, k), (high, k + _HALF)):
                bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(at))
                value = value.bitwiseOR(F.when(ones * 2 > F.col("_n"), bit).otherwise(F.lit(0)))
        return value

    return votes.select(*keys, packed("a").alias("a"), packed("b").alias("b"))


def hex_fingerprint(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def hamming(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Part of the bits that agree: 1 for equal fingerprints, about a half for unlike texts."""
    return 1.0 - hamming(a, b, c, d) / float(BITS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, a, b``: fingerprint of every distinct ``(doc_id, text)`` of ``docs``.

    Null text counts as empty; texts without words get all zeros. A null id stays null, an
    empty table gives an empty result.
    """
    terms = docs.select(
        "doc_id",
        text_key(F.coalesce("text", F.lit(""))).alias("key"),
        F.explode_outer(term_hashes(F.col("text"))).alias("term"),
    )
    return fingerprint_columns(terms, ["doc_id", "key"], "term")


def _blocks(a: Column, b: Column, n: int) -> Column:
    """Number and value of each of ``n`` blocks of the fingerprint's bits."""
    parts = []
    edges = [BITS * i // n for i in range(n + 1)]
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        masks = [
            sum(1 << (bit - base) for bit in range(max(low, base), min(high, base + 64)))
            for base in (0, 64)
        ]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        parts.append(
            F.struct(
                F.lit(i).alias("i"),
                a.bitwiseAND(F.lit(signed[0]).cast("long")).alias("x"),
                b.bitwiseAND(F.lit(signed[1]).cast("long")).alias("y"),
            )
        )
    return F.array(*parts)


def within_radius(queries: DataFrame, classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``q_a, q_b, a, b, distance``: fingerprints of ``classes`` around each of ``queries``.

    Both tables hold distinct fingerprints ``a, b``; rows of equal fingerprints join by them.
    Every pair within the radius is found, the query itself included.
    """
    left = queries.select(
        F.col("a").alias("q_a"),
        F.col("b").alias("q_b"),
        F.explode(_blocks(F.col("a"), F.col("b"), radius + 1)).alias("block"),
    )
    right = classes.select(
        "a", "b", F.explode(_blocks(F.col("a"), F.col("b"), radius + 1)).alias("block")
    )
    distance = hamming(F.col("q_a"), F.col("q_b"), F.col("a"), F.col("b"))
    return (
        left.join(right, "block")
        .select("q_a", "q_b", "a", "b", distance.alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )


def _ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key, range, guest``: rows by ranges of ids, with each range's follower.

    Ranges hold about equally many rows. The row that follows a range in descending order,
    the first of the next range (after the last: of the first), is added to it as a guest.
    """
    spark = docs.sparkSession
    n = min(MAX_RANGES, max(1, math.ceil(docs.count() / RANGE_ROWS)))
    least = (
        docs.select("doc_id")
        .where("doc_id IS NOT NULL")
        .repartitionByRange(n, "doc_id")
        .groupBy(F.spark_partition_id())
        .agg(F.min("doc_id").alias("least"))
        .collect()
    )
    bounds = sorted({float(r["least"]) for r in least})[1:]
    keyed = docs.select(
        "doc_id",
        "text",
        text_key(F.coalesce("text", F.lit(""))).alias("key"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)).alias("_at"),
    )
    if bounds:
        keyed = Bucketizer(
            splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="range"
        ).transform(keyed)
    else:
        keyed = keyed.withColumn("range", F.lit(0.0))
    keyed = keyed.withColumn("range", F.col("range").cast("int")).drop("_at")
    tops = keyed.groupBy("range").agg(F.max(F.struct("doc_id", "key")).alias("top")).collect()
    tops.sort(key=lambda r: -r["range"])
    follow = [
        (r["range"], tops[(i + 1) % len(tops)]["top"]["doc_id"], tops[(i + 1) % len(tops)]["top"]["key"])
        for i, r in enumerate(tops)
    ]
    guests = spark.createDataFrame(
        follow, f"_range int, _id {docs.schema['doc_id'].dataType.simpleString()}, _key long"
    )
    # at most MAX_RANGES rows
    joined = keyed.join(
        F.broadcast(guests),
        keyed["doc_id"].eqNullSafe(guests["_id"]) & (keyed["key"] == guests["_key"]),
        "left",
    )
    places = F.array(
        F.struct(F.col("range"), F.lit(False).alias("guest")),
        F.when(
            F.col("_range").isNotNull(),
            F.struct(F.col("_range").alias("range"), F.lit(True).alias("guest")),
        ),
    )
    return (
        joined.select("doc_id", "text", "key", F.explode(places).alias("p"))
        .where("p IS NOT NULL")
        .select("doc_id", "text", "key", "p.range", "p.guest")
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's.

    Documents stand in descending ``doc_id`` order; the next after the last is the first.
    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the next document. Returns ``doc_id, n_chars, edited_sha256, a, b, edited_a,
    edited_b, next_a, next_b``.

    Null text counts as empty. Rows equal in id and text count once; others that share an id
    stand in the order of a text hash. Null ids stand last. A single document is its own
    next. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy(
        "guest", F.col("doc_id").desc_nulls_last(), F.col("key").desc()
    )
    placed = (
        _ranges(docs)
        .withColumn("_before", F.lag(F.struct("guest", "doc_id", "key")).over(order))
        .where(~F.col("_before").eqNullSafe(F.struct("guest", "doc_id", "key")))
        .withColumn("_next", F.lead("text").over(order))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - half),
        F.substring(F.col("_next"), F.lit(1), half),
    )
    keys = ["range", "guest", "doc_id", "key", "n_chars", "edited_sha256", "edit"]
    both = placed.select(
        "range",
        "guest",
        "doc_id",
        "key",
        n.cast("long").alias("n_chars"),
        F.when(~F.col("guest"), F.sha2(edited, 256)).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("edit"), F.col("text").alias("t")),
                F.struct((~F.col("guest")).alias("edit"), edited.alias("t")),
            )
        ).alias("v"),
    ).where("NOT guest OR v.t IS NOT NULL")
    terms = both.select(
        "range",
        "guest",
        "doc_id",
        "key",
        "n_chars",
        "edited_sha256",
        "v.edit",
        F.explode_outer(term_hashes(F.col("v.t"))).alias("term"),
    )
    prints = fingerprint_columns(terms, keys, "term")
    one = prints.groupBy("range", "guest", "doc_id", "key").agg(
        F.max("n_chars").alias("n_chars"),
        F.max("edited_sha256").alias("edited_sha256"),
        *(
            F.max(F.when(F.col("edit") == edit, F.col(c))).alias(name)
            for edit, c, name in (
                (False, "a", "a"),
                (False, "b", "b"),
                (True, "a", "edited_a"),
                (True, "b", "edited_b"),
            )
        ),
    )
    return (
        one.withColumn("next_a", F.lead("a").over(order))
        .withColumn("next_b", F.lead("b").over(order))
        .where("NOT guest")
        .drop("range", "guest", "key")
    )


@query()
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole ``documents`` and their edited texts, with their likeness.

    ``n_near``, for ids divisible by 50: other documents within the radius of 3 bits.
    """
    found = stored(compare_with_next(table(spark, sf_dir, "documents")), "fingerprints")
    classes = found.groupBy("a", "b").agg(F.count("*").alias("n"))
    queries = found.where(F.col("doc_id") % QUERY_STEP == 0).select("a", "b").distinct()
    near = (
        within_radius(queries, classes.select("a", "b"))
        .join(classes, ["a", "b"])
        .groupBy(F.col("q_a").alias("_a"), F.col("q_b").alias("_b"))
        .agg((F.sum("n") - 1).alias("_near"))
    )
    own = F.col("a"), F.col("b")
    return (
        found.join(near, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            hex_fingerprint(*own).alias("fingerprint"),
            hex_fingerprint(F.col("edited_a"), F.col("edited_b")).alias("edited_fingerprint"),
            likeness(*own, F.col("edited_a"), F.col("edited_b")).alias("near_edited"),
            likeness(*own, F.col("next_a"), F.col("next_b")).alias("near_next"),
            F.when(F.col("doc_id") % QUERY_STEP == 0, F.col("_near")).alias("n_near"),
        )
    )
