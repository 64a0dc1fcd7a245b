"""The tree of all prefixes of conversations, as double-array tries of prefix shards.

A turn is named by a digest of its role and text; texts are not carried further. Equal
conversations are put together first, so a group of copies is one weighted sequence.
A prefix with more sequences below it than a shard may hold is an upper node; every other
sequence belongs to the shard of its shortest prefix that is no upper node, so a common
first turn is split at its second, third and so on. A shard packs its sequences into BASE
and CHECK arrays over dense numbers of its turns and walks them for the nodes. What the
shards say about the upper nodes above them is added up over all shards.

The number of upper nodes is bounded: a prefix counts as one with more than
(all prefix rows / ``MOST_UPPER``) sequences, so there are fewer than ``MOST_UPPER``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, query, stored, table

#: Conversations of one hundred share up to five turns of their first.
GROUP, HEADS = 100, 6
#: Distinct sequences of one shard, and upper nodes, at most.
SHARD_SEQUENCES = 200
MOST_UPPER = 200_000
#: Ids of one slice of equal conversations, as a power of two.
SLICE_BITS = 12
#: Rows of one batch of nodes.
BATCH_ROWS = 8192

_NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(
    conversations: DataFrame, group: int = GROUP, heads: int = HEADS
) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(id, chars)``.

    The first h turns are those of conversation c - c % ``group`` (all if fewer, none if
    there is none), h being crc32 of the id's digits modulo ``heads``; its own turns after its
    first h follow. Turns are ordered by ``turn``, null first, equal ones by their
    digest. Null role or text is empty. Rows without ``conv_id`` belong to no
    conversation. Other columns are ignored.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.length(text).alias("chars"),
    )
    own = (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("own"))
    )
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("own", 1, heads - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    head = F.coalesce("head", F.slice("own", 1, 0))
    turns = F.concat(F.slice(head, F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return (
        own.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group)
        .join(first, "_first", "left")
        .select(
            "conv_id",
            F.transform(turns, lambda t: F.struct(t["id"], t["chars"])).alias("turns"),
        )
    )


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """``ids, chars, n, first, ends`` of every distinct sequence of turns: how many
    conversations have it, the least id, and the SHA-256 of all of them, comma-joined.

    Copies are gathered in slices of up to 4,096 neighbouring ids; a sequence's slices
    then stream through one task in order, since this digest has to be taken in order.
    """
    sliced = (
        rows.withColumn("seq", F.md5(F.array_join(F.col("turns.id"), "")))
        .groupBy("seq", F.shiftright("conv_id", SLICE_BITS).alias("part"))
        .agg(
            F.first("turns").alias("turns"),
            F.count("*").alias("n"),
            F.min("conv_id").alias("first"),
            F.array_join(
                F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ","
            ).alias("members"),
        )
        .select(
            "seq",
            "part",
            F.col("turns.id").alias("ids"),
            F.col("turns.chars").alias("chars"),
            "n",
            "first",
            "members",
        )
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[dict] = []
        for _, parts in groupby(rows, key=lambda r: r["seq"]):
            one = next(parts)
            digest = hashlib.sha256(one["members"].encode())
            for part in parts:
                digest.update(b"," + part["members"].encode())
                one["n"] += part["n"]
            one["ends"] = digest.hexdigest()
            out.append({c: one[c] for c in _SEQUENCE.names})
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, _SEQUENCE)
                out = []
        yield pa.RecordBatch.from_pylist(out, _SEQUENCE)

    return in_arrow(
        sliced.repartition("seq").sortWithinPartitions("seq", "part"),
        merge,
        "ids array<string>, chars array<int>, n long, first long, ends string",
    )


_SEQUENCE = pa.schema(
    [
        ("ids", pa.list_(pa.string())),
        ("chars", pa.list_(pa.int32())),
        ("n", pa.int64()),
        ("first", pa.int64()),
        ("ends", pa.string()),
    ]
)


def prefix_digests(ids: list[str]) -> list[bytes]:
    """Digest of each prefix of a sequence, from one turn on."""
    out, last = [], b""
    for i in ids:
        last = hashlib.md5(last + i.encode()).digest()
        out.append(last)
    return out


def upper_prefixes(sequences: DataFrame, shard: int, most: int) -> set[bytes]:
    """Digests of the prefixes that too many sequences share; fewer than ``most``."""
    total = sequences.agg(F.sum(F.size("ids"))).first()[0] or 0
    limit = max(shard, -(-total // most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for ids in batch.column("ids").to_pylist():
                for p in prefix_digests(ids):
                    found[p] = found.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["p", "n"],
            )

    counted = in_arrow(sequences.select("ids"), count, "p binary, n long")
    large = counted.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return {bytes(r["p"]) for r in large.select("p").collect()}


class DoubleArray:
    """A trie of sequences of dense numbers (from 1), which must be sorted and distinct.

    State s goes by label c to state ``base[s] + c`` if ``check`` there is s. State 0 is
    the start; slots that are not taken have -1 in ``check``.
    """

    def __init__(self, words: list[list[int]]) -> None:
        self.base, self.check = [0], [0]
        low = 1
        stack = [(0, 0, len(words), 0)]
        while stack:
            state, i, end, depth = stack.pop()
            while i < end and len(words[i]) == depth:
                i += 1
            children = []
            while i < end:
                label, start = words[i][depth], i
                while i < end and words[i][depth] == label:
                    i += 1
                children.append((label, start, i))
            if not children:
                continue
            while low < len(self.check) and self.check[low] >= 0:
                low += 1
            at, labels = low, [c[0] for c in children]
            while not self._fits(at - labels[0], labels):
                at += 1
            base = self.base[state] = at - labels[0]
            more = base + labels[-1] + 1 - len(self.check)
            if more > 0:
                self.base += [0] * more
                self.check += [-1] * more
            for label, start, stop in children:
                self.check[base + label] = state
                stack.append((base + label, start, stop, depth + 1))

    def _fits(self, base: int, labels: list[int]) -> bool:
        n = len(self.check)
        return all(base + c >= n or self.check[base + c] < 0 for c in labels)

    def step(self, state: int, label: int) -> int:
        """The next state, or -1."""
        to = self.base[state] + label
        return to if 0 < to < len(self.check) and self.check[to] == state else -1


def shard_nodes(rows: list[dict], above: int) -> list[dict]:
    """Nodes of one shard below ``above`` shared turns, parents before children.

    ``rows`` are distinct sequences in order of their turn ids.
    """
    names = sorted({i for r in rows for i in r["ids"][above:]})
    number = {name: k for k, name in enumerate(names, 1)}
    words = [[number[i] for i in r["ids"][above:]] for r in rows]
    trie = DoubleArray(words)
    nodes: dict[int, dict] = {}
    for row, word in zip(rows, words, strict=True):
        state = 0
        for depth, label in enumerate(word, above + 1):
            state = trie.step(state, label)
            node = nodes.get(state)
            if node is None:
                node = nodes[state] = {
                    "depth": depth,
                    "chars": row["chars"][depth - 1],
                    "conv_id": row["first"],
                    "n_convs": 0,
                    "n_children": 0,
                    "n_leaves": 0,
                    "saved": 0,
                    "ends": _NO_ENDS,
                }
            node["n_convs"] += row["n"]
            node["conv_id"] = min(node["conv_id"], row["first"])
        nodes[state]["ends"] = row["ends"]
    for state, node in reversed(nodes.items()):
        node["saved"] += (node["n_convs"] - 1) * node["chars"]
        node["n_leaves"] += not node["n_children"]
        parent = nodes.get(trie.check[state])
        node["parent_conv_id"] = parent and parent["conv_id"]
        if parent:
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved"] += node["saved"]
    return list(nodes.values())


_NODE = pa.schema(
    [
        ("upper", pa.bool_()),
        ("key", pa.binary()),
        ("above", pa.binary()),
        ("depth", pa.int64()),
        ("chars", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved", pa.int64()),
        ("ends", pa.string()),
    ]
)
_NODE_DDL = (
    "upper boolean, key binary, above binary, depth long, chars long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
)


def _shards(sequences: DataFrame, upper: set[bytes]) -> DataFrame:
    """Adds ``shard``, the digest of the shortest prefix that is no upper node (of all
    turns, if there is none), and ``shared``, how many turns are above it."""
    known = sequences.sparkSession.sparkContext.broadcast(upper)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, shared = [], []
            for ids in batch.column("ids").to_pylist():
                path = [b"", *prefix_digests(ids)]
                k = 1
                while k < len(path) and path[k] in known.value:
                    k += 1
                shards.append(path[min(k, len(ids))])
                shared.append(k - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shards, pa.binary()), pa.array(shared, pa.int32())],
                names=[*batch.schema.names, "shard", "shared"],
            )

    return in_arrow(
        sequences,
        assign,
        "ids array<string>, chars array<int>, n long, first long, ends string, "
        "shard binary, shared int",
    )


def _walk(sharded: DataFrame) -> DataFrame:
    """Nodes of all shards, and for each upper node one row a task with what its shards add."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[dict] = []
        upper: dict[bytes, dict] = {}
        for _, shard in groupby(rows, key=lambda r: r["shard"]):
            own = list(shard)
            shared, one = own[0]["shared"], own[0]
            path = [b"", *prefix_digests(one["ids"][:shared])]
            n, first = sum(r["n"] for r in own), min(r["first"] for r in own)
            for depth, key in enumerate(path):
                sums = upper.setdefault(
                    key,
                    {
                        "upper": True,
                        "key": key,
                        "above": path[depth - 1] if depth else None,
                        "depth": depth,
                        "chars": one["chars"][depth - 1] if depth else 0,
                        "conv_id": first,
                        "n_convs": 0,
                        "n_children": 0,
                        "n_leaves": 0,
                        "saved": 0,
                    },
                )
                sums["n_convs"] += n
                sums["conv_id"] = min(sums["conv_id"], first)
            if len(one["ids"]) == shared:  # the sequence that ends at an upper node
                sums["ends"] = one["ends"]
                continue
            nodes = shard_nodes(own, shared)
            sums["n_children"] += 1
            sums["n_leaves"] += nodes[0]["n_leaves"]
            sums["saved"] += nodes[0]["saved"]
            nodes[0]["key"] = path[-1]
            out += nodes
            while len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out[:BATCH_ROWS], _NODE)
                out = out[BATCH_ROWS:]
        yield pa.RecordBatch.from_pylist(out + list(upper.values()), _NODE)

    return in_arrow(
        sharded.repartition("shard").sortWithinPartitions("shard", "ids"), walk, _NODE_DDL
    )


def _merged_upper(rows: list) -> list[tuple]:
    """Upper nodes with their whole subtrees' sums, children before parents."""
    nodes = {r["key"]: r.asDict() for r in rows}
    for node in sorted(nodes.values(), key=lambda v: -v["depth"]):
        node["saved"] += (node["n_convs"] - 1) * node["chars"]
        node["n_leaves"] += not node["n_children"]
        if node["above"] is not None:
            parent = nodes[node["above"]]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved"] += node["saved"]
    return [
        (
            v["key"],
            v["conv_id"],
            v["depth"],
            nodes[v["above"]]["conv_id"] if v["above"] is not None else None,
            v["n_convs"],
            v["n_children"],
            v["n_leaves"],
            v["saved"],
            v["ends"] or _NO_ENDS,
        )
        for v in nodes.values()
    ]


def prefix_tree(
    rows: DataFrame, shard: int = SHARD_SEQUENCES, most_upper: int = MOST_UPPER
) -> DataFrame:
    """One row for each distinct prefix of the ``turns`` in ``rows`` (``conv_id, turns``).

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. ``conv_id`` must be
    unique. Conversations without turns are members of the root. Without any
    conversation there is no node.
    """
    spark = rows.sparkSession
    sequences = stored(distinct_sequences(rows), "sequences")
    upper = upper_prefixes(sequences, shard, most_upper)
    found = stored(_walk(_shards(sequences, upper)), "nodes")
    sums = (
        found.where("upper")
        .groupBy("key")
        .agg(
            F.first("above", ignorenulls=True).alias("above"),
            F.first("depth").alias("depth"),
            F.first("chars").alias("chars"),
            F.min("conv_id").alias("conv_id"),
            F.max("ends").alias("ends"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        )
        .collect()
    )
    merged = spark.createDataFrame(
        _merged_upper(sums),
        "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    )
    parents = F.broadcast(merged.select("key", F.col("conv_id").alias("_parent")))
    columns = [c for c in merged.columns if c != "key"]
    lower = (
        found.where("upper IS NULL")
        .join(parents, "key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
        .withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    )
    return lower.select(columns).unionByName(merged.select(columns))


_CRC = """list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
                            lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""


@query(
    f"""
    WITH t AS (SELECT conv_id AS c, turn,
                      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id,
                      length(coalesce(text, '')) AS chars
               FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM t GROUP BY c),
    lengths AS (SELECT DISTINCT id, chars FROM t),
    h AS (SELECT c, ids, xor({_CRC}, 4294967295) % {HEADS} AS h FROM own),
    conv AS (SELECT h.c, list_concat(coalesce(b.ids, [])[1 : h.h], h.ids[h.h + 1 :]) AS ids
             FROM h LEFT JOIN own b ON b.c = h.c - h.c % {GROUP}),
    member AS (SELECT c, len(ids) AS n, d, array_to_string(ids[1 : d], '') AS k, ids[d] AS id
               FROM (SELECT c, ids, unnest(range(0, len(ids) + 1)) AS d FROM conv)),
    node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(id) AS id,
                    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
             FROM member GROUP BY k, d),
    valued AS (SELECT node.*, (n_convs - 1) * coalesce(chars, 0) AS s,
                      NOT EXISTS (SELECT 1 FROM node x WHERE x.d = node.d + 1 AND left(x.k, 32 * node.d) = node.k) AS leaf
               FROM node LEFT JOIN lengths USING (id)),
    up AS (SELECT left(k, 32 * a) AS k, sum(s) AS saved, count(*) FILTER (WHERE leaf) AS leaves,
                  count(*) FILTER (WHERE d = a + 1) AS children
           FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued) GROUP BY 1)
    SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n_convs,
           up.children AS n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens,
           node.ends AS ends_sha256
    FROM node JOIN up USING (k)
    LEFT JOIN node p ON p.d = node.d - 1 AND p.k = left(node.k, 32 * (node.d - 1))
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree of all rebuilt ``conversations``."""
    return prefix_tree(rebuilt_conversations(table(spark, sf_dir, "conversations")))
