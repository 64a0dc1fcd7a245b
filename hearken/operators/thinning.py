"""Keep the ``keep`` most central answers of each over-answered question.

Per group: k-means over the answer vectors, then for every centre the answer of
the whole group with the highest cosine to it.

* groups of at most ``group_rows`` rows are clustered each in one task;
* larger groups are cut into slices, packed once, and clustered by rounds of sums over
  the slices where they lie; only centres and sums pass between rounds.

Both ways use the same seeds: round r takes the row with the largest
distance / exponential variate, a hash of (seed, r, pair_id). That is k-means++
sampling without a driver-side generator, and it does not depend on row order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions.vectors import cosine
from hearken.operators.arrays import to_matrix, unit_rows
from hearken.operators.groups import KEEP
from hearken.operators.skew import ROWS_PER_SLICE, sliced_join
from hearken.session import store

SEED = 42
GROUP_ROWS = 20_000
# Rounds end when no centre moves; this is only a stop for groups that never settle.
MAX_ROUNDS = 300
SETTLED = 1e-8
DIGITS = 6
#: Rows that a step of a count copies; one group's matrix is held once beside its Arrow columns.
STEP_ROWS = 1024
#: Rows of one packed slice, and bytes of the centres that one broadcast may hold.
SLICE_ROWS = 4096
CENTRE_BYTES = 64 << 20

PACKED = "group_id long, slice int, width int, ids binary, vectors binary, races binary"
PICKS = "group_id long, cluster int, pair_id long, score double"


def with_race(members: DataFrame, keep: int, seed: int = SEED) -> DataFrame:
    """Add ``race``: one exponential variate per seeding round, from a hash of the id."""
    top = 2**53

    def variate(r: int):
        bits = F.xxhash64(F.lit(seed), F.lit(r), "pair_id").bitwiseAND(F.lit(top - 1))
        return -F.log((bits + 1) / F.lit(float(top + 1)))

    return members.withColumn("race", F.array(*[variate(r) for r in range(keep)]))


# -- numpy parts, used inside tasks ------------------------------------------


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centres)))
    for first in range(0, len(x), STEP_ROWS):
        part = x[first : first + STEP_ROWS]
        for at, c in enumerate(centres):
            out[first : first + STEP_ROWS, at] = ((part - c) ** 2).sum(axis=1)
    return out


def cluster_group(x: np.ndarray, race: np.ndarray, keep: int, max_rounds: int) -> np.ndarray:
    """Centres of one group whose rows are sorted by id."""
    chosen = [int(race[:, 0].argmin())]
    for r in range(1, keep):
        gap = squared_distances(x, x[chosen]).min(axis=1)
        chosen.append(int((gap / race[:, r]).argmax()))
    centres = x[chosen].copy()
    for _ in range(max_rounds):
        nearest = squared_distances(x, centres).argmin(axis=1)
        moved = centres.copy()
        for c in np.unique(nearest):
            moved[c] = x[nearest == c].mean(axis=0)
        shift = ((moved - centres) ** 2).sum(axis=1).max()
        centres = moved
        if shift <= SETTLED:
            break
    return centres


def closest(x: np.ndarray, ids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centre the id with the highest cosine, lowest id on ties, and that cosine."""
    directions = unit_rows(centres).T
    scores = np.vstack(
        [
            np.round(unit_rows(x[first : first + STEP_ROWS]) @ directions, DIGITS)
            for first in range(0, len(x), STEP_ROWS)
        ]
    )
    best = np.array([np.lexsort((ids, -scores[:, c]))[0] for c in range(len(centres))])
    return ids[best], scores[best, np.arange(len(centres))]


# -- Spark side --------------------------------------------------------------


def pick_representatives(
    members: DataFrame,
    keep: int = KEEP,
    dedupe: bool = False,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
    max_rounds: int = MAX_ROUNDS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(group_id, cluster, pair_id, score) from (group_id, pair_id, n, embedding).

    ``n`` is the group size. A group of at most ``keep`` rows returns all of them. Groups
    over ``group_rows`` are looked for first, and the rounds run only if there are any; ``sizes``
    may name a table of the same ``n`` that is cheaper to read than ``members``.
    """
    # Floats move as floats; tasks widen them before they count.
    floats = members.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    kind = "array<float>" if floats else "array<double>"
    rows = with_race(
        members.where(F.col("embedding").isNotNull()).select(
            "group_id", "pair_id", "n", F.col("embedding").cast(kind).alias("vector")
        ),
        keep,
        seed,
    )
    whole = rows.where(F.col("n") <= keep).select(
        "group_id",
        # Such a group has few rows, each its own centre.
        F.lit(None).cast("int").alias("cluster"),
        "pair_id",
        F.lit(1.0).alias("score"),
    )
    small = _small_groups(
        rows.where((F.col("n") > keep) & (F.col("n") <= group_rows)), keep, max_rounds
    )
    picks = whole.unionByName(small)
    over = (F.col("n") > keep) & (F.col("n") > group_rows)
    if not (members if sizes is None else sizes).where(over).select("n").isEmpty():
        large = rows.where(over)
        picks = picks.unionByName(_large_groups(large, keep, group_rows, max_rounds))
    if dedupe:
        picks = picks.groupBy("group_id", "pair_id").agg(
            F.min("cluster").alias("cluster"), F.max("score").alias("score")
        )
    return picks.select("group_id", "cluster", "pair_id", "score")


def _small_groups(rows: DataFrame, keep: int, max_rounds: int) -> DataFrame:
    def one(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group["pair_id"].to_numpy(), kind="stable")
        ids, race = group["pair_id"].to_numpy()[order], to_matrix(group["race"])[order]
        x = np.empty((len(ids), len(group["vector"][0])))
        at = np.argsort(order)  # each row's place
        for batch in group.select(["vector"]).to_batches():
            x[at[: batch.num_rows]] = to_matrix(batch.column(0))
            at = at[batch.num_rows :]
        centres = cluster_group(x, race, keep, max_rounds)
        picked, score = closest(x, ids, centres)
        return pa.table(
            {
                "group_id": pa.array([key[0].as_py()] * keep, pa.int64()),
                "cluster": pa.array(range(keep), pa.int32()),
                "pair_id": pa.array(picked, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return rows.groupBy("group_id").applyInArrow(one, PICKS)


def _large_groups(rows: DataFrame, keep: int, group_rows: int, max_rounds: int) -> DataFrame:
    """Rounds over packed slices; vectors are shuffled once, to be packed.

    A slice of a group is one stored row with its vectors, ids and variates as matrices.
    Each round reads the slices where they lie, with the centres broadcast, and only sums
    move. Slices are stored in order of their groups: few tasks have a part of one group, so
    their sums go straight to the driver, and a round is one stage. Groups whose centres stand still leave.
    Groups are taken together as long as their centres fit ``CENTRE_BYTES``.
    """
    spark = rows.sparkSession
    size = min(group_rows, SLICE_ROWS)
    slices = F.ceil(F.col("n") / size).cast("int")
    packed = store(
        rows.withColumn("slice", F.pmod(F.xxhash64("pair_id"), slices).cast("int"))
        .groupBy("group_id", "slice")
        .applyInArrow(_pack, PACKED),
        "packed",
    )
    tasks = max(spark.sparkContext.defaultParallelism, packed.rdd.getNumPartitions())
    order = ["group_id", "slice"]
    blocks = store(
        packed.repartitionByRange(tasks, *order).sortWithinPartitions(*order), "slices"
    )
    counted = blocks.agg(F.count_distinct("group_id"), F.max("width")).first()
    rounds = max(1, -(-counted[0] * keep * (counted[1] or 1) * 8 // CENTRE_BYTES))
    out = spark.createDataFrame([], PICKS)
    for b in range(rounds):
        own = blocks
        if rounds > 1:
            own = blocks.where(F.pmod(F.xxhash64("group_id"), F.lit(rounds)) == b)
        centres = _settled_centres(own, keep, max_rounds)
        out = out.unionByName(_closest_rows(own, centres))
    return out


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pair_id")
    x = to_matrix(rows["vector"])

    def packed(m: np.ndarray) -> pa.Array:
        return pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())

    return pa.table(
        {
            "group_id": rows["group_id"].slice(0, 1),
            "slice": rows["slice"].slice(0, 1),
            "width": pa.array([x.shape[1]], pa.int32()),
            "ids": packed(rows["pair_id"].to_numpy()),
            "vectors": packed(x),
            "races": packed(to_matrix(rows["race"])),
        }
    )


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """Group, vectors, ids and variates; short slices of a group that follow each other as one."""
    group, held, n = None, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("group_id", "width", "ids", "vectors", "races")]
        for at in range(batch.num_rows):
            own, width, ids, x, races = (c[at] for c in columns)
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            if held and (own.as_py() != group or n + len(ids) > SLICE_ROWS):
                yield group, *_joined(held)
                held, n = [], 0
            x = np.frombuffer(x.as_buffer()).reshape(len(ids), width.as_py())
            held.append((x, ids, np.frombuffer(races.as_buffer()).reshape(len(ids), -1)))
            group, n = own.as_py(), n + len(ids)
    if held:
        yield group, *_joined(held)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def _highest(blocks: DataFrame, score, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Each group's row of highest ``score(x, race, centres)``, lowest id on ties."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for group, x, ids, race in _unpacked(batches):
            value = score(x, race, shared.value.get(group))
            at = int(value.argmax())
            own = (float(value[at]), -int(ids[at]), x[at].tobytes())
            if group not in best or own[:2] > best[group][:2]:
                best[group] = own
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(best), pa.int64()),
                pa.array([v[0] for v in best.values()], pa.float64()),
                pa.array([v[1] for v in best.values()], pa.int64()),
                pa.array([v[2] for v in best.values()], pa.binary()),
            ],
            names=["group_id", "score", "order", "vector"],
        )

    top: dict[int, tuple] = {}
    found = blocks.mapInArrow(run, "group_id long, score double, order long, vector binary")
    for r in found.collect():
        if r["group_id"] not in top or (r["score"], r["order"]) > top[r["group_id"]][:2]:
            top[r["group_id"]] = (r["score"], r["order"], np.frombuffer(r["vector"]))
    shared.destroy()
    return {g: v for g, (_, _, v) in top.items()}


def _cluster_sums(
    blocks: DataFrame, centres: dict[int, np.ndarray]
) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """Rows and sums of each (group, cluster): added up in each task, then over all."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for group, x, _, _ in _unpacked(batches):
            known = shared.value.get(group)
            if known is None:  # settled
                continue
            nearest = squared_distances(x, known).argmin(axis=1)
            for c in np.unique(nearest):
                own = x[nearest == c]
                n, total = sums.get((group, int(c)), (0, 0.0))
                sums[group, int(c)] = n + len(own), total + own.sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {
                "group_id": pa.array([g for g, _ in sums], pa.int64()),
                "cluster": pa.array([c for _, c in sums], pa.int32()),
                "n": pa.array([n for n, _ in sums.values()], pa.int64()),
                "sums": pa.array([v.tobytes() for _, v in sums.values()], pa.binary()),
            }
        )

    out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for r in blocks.mapInArrow(run, "group_id long, cluster int, n long, sums binary").collect():
        key = r["group_id"], r["cluster"]
        n, total = out.get(key, (0, 0.0))
        out[key] = n + r["n"], total + np.frombuffer(r["sums"])
    shared.destroy()
    return out


def _settled_centres(blocks: DataFrame, keep: int, max_rounds: int) -> dict[int, np.ndarray]:
    """Centres (cluster, width) of all groups of ``blocks``."""
    seeds = _highest(blocks, lambda x, race, _: -race[:, 0], {})
    centres = {g: v[None, :] for g, v in seeds.items()}
    for r in range(1, keep):

        def gap(x: np.ndarray, race: np.ndarray, known: np.ndarray, r: int = r) -> np.ndarray:
            return squared_distances(x, known).min(axis=1) / race[:, r]

        for g, v in _highest(blocks, gap, centres).items():
            centres[g] = np.vstack([centres[g], v])
    moving = dict(centres)
    for _ in range(max_rounds):
        if not moving:
            break
        moved = {g: c.copy() for g, c in moving.items()}
        for (group, cluster), (n, total) in _cluster_sums(blocks, moving).items():
            moved[group][cluster] = total / n
        centres.update(moved)
        moving = {
            g: c for g, c in moved.items() if ((c - moving[g]) ** 2).sum(axis=1).max() > SETTLED
        }
    return centres


def _closest_rows(blocks: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The row closest to each centre of each group."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, x, ids, _ in _unpacked(batches):
            picked, score = closest(x, ids, shared.value[group])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(picked), group)),
                    pa.array(np.arange(len(picked)), pa.int32()),
                    pa.array(picked),
                    pa.array(score),
                ],
                names=["group_id", "cluster", "pair_id", "score"],
            )

    best = F.max_by(F.struct("pair_id", "score"), F.struct(F.col("score"), -F.col("pair_id")))
    return (
        blocks.mapInArrow(run, PICKS)
        .groupBy("group_id", "cluster")
        .agg(best.alias("best"))
        .select("group_id", "cluster", "best.pair_id", "best.score")
    )


# -- given clusters ----------------------------------------------------------


def centroids(members: DataFrame, group: str, cluster: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per (group, cluster), summed by position before the exchange."""
    return (
        members.select(group, cluster, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
        .groupBy(group, cluster, "at")
        .agg(F.avg("x").alias("value"))
        .groupBy(group, cluster)
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
        .select(group, cluster, F.col("cells.value").alias("centre"))
    )


def nearest_to_centroids(
    members: DataFrame,
    centres: DataFrame,
    group: str,
    cluster: str,
    id_col: str,
    vector: str = "embedding",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Per centre the member of the whole group with the highest cosine, lowest id on ties."""
    listed = centres.groupBy(group).agg(
        F.collect_list(F.struct(F.col(cluster), F.col("centre"))).alias("_centres")
    )
    scored = (
        sliced_join(
            members.select(group, id_col, vector), listed, [group], [id_col], "inner",
            rows_per_slice,
        )
        .select(group, id_col, vector, F.inline("_centres"))
        .withColumn("score", F.round(cosine(vector, "centre"), DIGITS))
    )
    best = F.max_by(F.struct(id_col, "score"), F.struct(F.col("score"), -F.col(id_col)))
    return (
        scored.groupBy(group, cluster)
        .agg(best.alias("best"))
        .select(group, cluster, f"best.{id_col}", "best.score")
    )
