"""Mix sources to target weights in blocks of words.

Documents of a source are packed into one stream and the stream is cut into blocks of
``BLOCK_WORDS`` words. Each source gets a number of slots (its target in blocks) and
slots draw their output shard at random, so the number of blocks a shard takes from
each source is a multinomial draw. A slot's place in its source's sequence is mapped to
a block by a pseudorandom permutation of the block numbers, a new one for each pass over
the source, and blocks are joined by number. A target is at most ``MAX_REPEATS`` times
its source, so no block, and no document, is taken more often.

Only DataFrame functions run. Everything follows from ids, sizes and ``seed``, so
reruns agree. A large source is packed in chunks: sums per chunk give the chunks' offsets
and windows run inside chunks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.llm import common
from hearken.llm.common import query, stored, table, text_key, whole_rows

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
CHUNK_DOCUMENTS = 2000
SHARD_BLOCKS = 100_000
SLOT_RUN = 10_000
SEED = 17
_ROUNDS = 4


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.size(common.word_array(text)).cast("long")


def permuted(i: Column, n: Column, salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, as an expression of its index.

    Each round scrambles the largest power of two that fits (an odd multiplication and
    a xor-shift, both one-to-one) and rotates the whole range, so every round, and with
    it the result, is one-to-one. Holds for n up to 2**38.
    """
    half = F.greatest((F.length(F.bin(n)) / 2).cast("int"), F.lit(1))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1)
    rounds = F.array(
        *(
            F.struct(
                (F.pmod(F.xxhash64(salt, F.lit(2 * r)), F.lit(1 << 23)) * 2 + 1).alias("odd"),
                F.pmod(F.xxhash64(salt, F.lit(2 * r + 1)), n).alias("shift"),
            )
            for r in range(_ROUNDS)
        )
    )

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(x * r["odd"], size)
        y = y.bitwiseXOR(F.call_function("shiftright", y, half))
        return F.pmod(F.when(x < size, y).otherwise(x) + r["shift"], n)

    return F.aggregate(rounds, i.cast("long"), turn)


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_REPEATS,
) -> DataFrame:
    """``source, documents, source_size, target``: words the mix should take from each source.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share``
    times all words. A target stops at ``most`` times its source's words and the excess
    is shared again by weight. The level at which sources stop is found in closed form:
    sources stop in the order of size over weight, so one running sum tells, for each
    number of stopped sources, the level of the others. One row per source is gathered
    for that, so the number of sources has to fit one task; documents do not.
    """
    per_source = sizes.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("size").alias("source_size")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("w_all", F.sum("w").over(whole))
        # words for each unit of weight, if exactly the sources before stop
        .withColumn(
            "level", (F.col("budget") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
        )
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("cap_before", "level"))).over(whole))
    )
    target = F.least(
        F.col("cap").cast("double"),
        F.coalesce(F.col("final.level") * F.col("w"), F.col("cap")).cast("double"),
    )
    return leveled.select("source", "documents", "source_size", target.alias("target"))


def packed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``source_size, target`` and ``start``: words of the source's documents before this one.

    Rows are ordered by chunk, id and key; a chunk holds about ``CHUNK_DOCUMENTS``
    documents and is chosen by hash, so also the chunks of a hot source are even.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("documents") / CHUNK_DOCUMENTS))
    chunked = (
        rows.join(
            targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        )
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), chunks))
        .drop("_s", "documents")
    )
    by_chunk = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_chunk.select(
        F.col("source").alias("_s"),
        F.col("chunk").alias("_c"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    inside = (
        Window.partitionBy("source", "chunk")
        .orderBy("doc_id", "key", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunked.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
        .withColumn("start", F.col("_offset") + F.col("_inside"))
        .drop("_s", "_c", "_offset", "_inside", "chunk")
    )


def slots(targets: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``source, pass, block, shard``: the blocks that the mix takes, with their shard.

    A source of n blocks has round(target / block words) slots, never over
    ``MAX_REPEATS`` times n. Slot i is in pass i / n and takes the block that this pass's
    permutation gives for i mod n. The slots of all sources draw among as many shards as
    the mix needs for about ``SHARD_BLOCKS`` blocks each.
    """
    blocks = F.ceil(F.col("source_size") / block)
    counted = targets.where("source_size > 0").select(
        "source",
        blocks.alias("n"),
        F.least(F.round(F.col("target") / block).cast("long"), blocks * MAX_REPEATS).alias("slots"),
    )
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / SHARD_BLOCKS))
    # a source's slots are made in runs, so that a large one is made by many tasks; a given
    # number of partitions is kept, where the planner would put few rows into one
    run = SLOT_RUN
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        counted.withColumn("shards", shards)
        .where("slots > 0")
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("slots") / run) - 1)))
        .repartition(parts, "source", "run")
        .withColumn(
            "slot",
            F.explode(
                F.sequence(
                    F.col("run") * run, F.least(F.col("slots"), (F.col("run") + 1) * run) - 1
                )
            ),
        )
    )
    turn = F.floor(F.col("slot") / F.col("n"))
    salt = F.xxhash64(F.lit(seed), "source", turn)
    return runs.select(
        "source",
        turn.cast("int").alias("pass"),
        permuted(F.pmod("slot", "n"), F.col("n"), salt).alias("block"),
        F.pmod(F.xxhash64(F.lit(seed), "source", "slot"), "shards").alias("shard"),
    )


def mix(
    docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The packed documents and the parts of them that the mix takes.

    First table: ``row, doc_id, key, size, source, start, source_size, target``, one row
    per row of ``docs``. Second: ``row, pass, shard, first, words``, one row for each
    block taken and document in it, ``first`` counted from 0 within the document.

    Every row is a document, repeated rows too. Null text has no words and takes none;
    a null source is a source; null ids are ids. An empty table gives empty results.
    """
    # equal rows are told apart by a number among themselves, so that reruns agree
    sized = stored(
        docs.select(
            "doc_id",
            text_key(F.col("text")).alias("key"),
            "source",
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    equal = Window.partitionBy("doc_id", "key", "source").orderBy("size")
    numbered = sized.withColumn("copy", F.row_number().over(equal))
    targets = stored(source_targets(sized), "targets")
    rows = packed(numbered, targets)
    whole = stored(rows.withColumn("row", F.struct("doc_id", "key", "source", "copy")), "packed")
    spans = whole.where("size > 0").select(
        "row",
        "source",
        "start",
        "size",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
            )
        ).alias("block"),
    )
    taken = slots(targets, block, seed).select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "pass", "shard"
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    # slots grow with the corpus, but exploded runs look small to the planner: never broadcast
    parts = spans.join(
        taken.hint("merge"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")),
    ).select("row", "pass", "shard", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    return whole, parts


def mixed_sizes(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of the packed documents."""
    taken = parts.groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("taken"))
    return whole.join(taken, F.col("row").eqNullSafe(F.col("_row")), "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for each document and
    pass that takes any of its words.

    A document taken whole keeps its text; else its text is the taken words in order, joined
    by single spaces. ``n_chars``, if there is such a column, follows the text. Of other
    columns equal rows share one row's values.
    """
    _, parts = mix(docs, block, seed)
    taken = (
        parts.groupBy("row", "pass")
        .agg(
            F.sum("words").cast("int").alias("words"),
            F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"),
        )
        .groupBy(
            F.col("row.doc_id").alias("_id"),
            F.col("row.key").alias("_key"),
            F.col("row.source").alias("_source"),
        )
        .agg(F.collect_list(F.struct("words", "spans")).alias("_taken"))
    )
    keyed = whole_rows(docs).withColumn("_from", F.col("_doc.source"))
    joined = keyed.join(
        taken,
        keyed["doc_id"].eqNullSafe(taken["_id"])
        & (keyed["_row"] == taken["_key"])
        & keyed["_from"].eqNullSafe(taken["_source"]),
    ).dropDuplicates(["doc_id", "_row", "_from"])
    each = joined.withColumn("_part", F.explode("_taken")).withColumn(
        "_words", common.word_array(F.col("_doc.text"))
    )
    cut = F.flatten(
        F.transform(
            "_part.spans",
            lambda s: F.slice("_words", s["first"].cast("int") + 1, s["words"].cast("int")),
        )
    )
    whole = F.col("_part.words") == F.size("_words")
    text = F.when(whole, F.col("_doc.text")).otherwise(F.array_join(cut, " "))
    mixed = each.withColumn("_doc", F.col("_doc").withField("text", text))
    if "n_chars" in docs.columns:
        length = F.length("_doc.text").cast(docs.schema["n_chars"].dataType)
        mixed = mixed.withColumn("_doc", F.col("_doc").withField("n_chars", length))
    return mixed.select("_doc.*")


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, and its source's target."""
    return mixed_sizes(*mix(table(spark, sf_dir, "documents")))
