"""CSV with line breaks inside quotes, read by many tasks a file.

Whether a line break ends a record depends on all quotes before it. Each task first reads
its ranges of a file under both assumptions, that they begin between records and that they
begin inside quotes, and tells for each what state they end in and how many records begin in
them. The driver chains these answers, one row a range, which gives every range its true
state and the number of its first record. Then all ranges are cut into records at once;
a record that runs over range edges is put together from its pieces.

A quote opens a cell only at the cell's start, and two quotes inside a quoted cell are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if one was before it or not."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside, at = False, at + 1
        else:
            # the next quote that opens a cell: at the start, or behind a comma
            if at == 0 and n and line[0] == '"':
                inside, at = True, 1
                continue
            at = line.find(',"', max(at - 1, 0) if at else 0)
            if at < 0:
                return False
            inside, at = True, at + 2


def is_blank_record(line: str) -> bool:
    return line.rstrip("\r") == ""


@dataclass
class Range:
    """What a range does from one state: the state it ends in, records that begin in it, and
    whether a record ends in it that was open before."""

    inside: bool
    records: int = 0
    closes: bool = False

    def take(self, line: str) -> None:
        begins = not self.inside and not (is_blank_record(line))
        self.records += begins
        was = self.inside
        self.inside = inside_after(line, was)
        self.closes |= was and not self.inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


_OUTCOME = (
    "file string, block long, closed_inside boolean, closed_records long, "
    "open_inside boolean, open_records long, open_closes boolean"
)


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: its outcome from both states."""
    found: dict[tuple[str, int], tuple[Range, Range]] = {}
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            states = found.get((file, block))
            if states is None:
                states = found[file, block] = Range(False), Range(True)
            for s in states:
                s.take(line)
    rows = [(*k, a.inside, a.records, b.inside, b.records, b.closes) for k, (a, b) in found.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in _OUTCOME.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names
    )


@dataclass
class Start:
    """A range's true state at its start, the number of its first record among all files',
    and the range and number of the record that is open there."""

    inside: bool
    number: int
    owner: int


def _chain(outcomes: list) -> dict[tuple[str, int], Start]:
    starts, number = {}, 0
    file, inside, owner = None, False, 0
    for r in sorted(outcomes, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside = r["file"], False
        starts[r["file"], r["block"]] = Start(inside, number, owner)
        records = r["open_records"] if inside else r["closed_records"]
        number += records
        after = r["open_inside"] if inside else r["closed_inside"]
        if after and (not inside or r["open_closes"]):
            owner = number - 1  # the last record that began here is still open
        inside = after
    return starts


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``number, file, text``: the records of all files, header records too, numbered from 0
    in the order of file names and of records in a file. Blank records do not count."""
    lines = _lines(spark, path)
    starts = _chain(lines.mapInArrow(_outcomes, _OUTCOME).collect())
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each range in turn: state, next number, and the open record's number and lines
        current, inside, number, owner, held = None, False, 0, 0, []
        out: list[tuple] = []

        def give(open_: bool) -> None:
            whole = not open_ and not cut_before
            out.append((owner, current[0], current[1], "\n".join(held), whole))
            held.clear()

        cut_before = False
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != current:
                    if held:
                        give(True)
                    start = shared.value[file, block]
                    current, inside, number, owner = (file, block), start.inside, start.number, start.owner
                    cut_before = inside
                if not inside:
                    if is_blank_record(line):
                        continue
                    owner, number, cut_before = number, number + 1, False
                held.append(line)
                inside = inside_after(line, inside)
                if not inside:
                    give(False)
            yield _pieces(out)
            out = []
        if held:
            give(True)
        yield _pieces(out)

    pieces = lines.mapInArrow(cut, "number long, file string, block long, text string, whole boolean")
    together = (
        pieces.where("NOT whole")
        .groupBy("number", "file")
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select("number", "file", F.array_join(F.col("parts.text"), "\n").alias("text"))
    )
    records = pieces.where("whole").select("number", "file", "text").unionByName(together)
    return records.withColumn("text", F.rtrim("text", F.lit("\r")))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
        names=["number", "file", "block", "text", "whole"],
    )


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``pair_id`` and the columns of the CSV files at ``path``, all as text.

    ``pair_id`` numbers the rows from 0 in file order. All files must have the same header;
    a leading BOM is dropped. A quote that is never closed makes the rest of its file one
    record.
    """
    records = csv_records(spark, path)
    heads = records.groupBy("file").agg(F.min_by("text", "number").alias("head"), F.min("number").alias("at"))
    heads = heads.orderBy("at").collect()  # one row a file
    if not heads:
        raise ValueError(f"no header at {path}")
    names = _cells(spark, heads[0]["head"])
    others = {h["head"].removeprefix(BOM) for h in heads}
    if len(others) > 1 and len({tuple(_cells(spark, h)) for h in others}) > 1:
        raise ValueError(f"CSV headers differ at {path}")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    before = spark.createDataFrame(
        [(h["file"], h["at"], k + 1) for k, h in enumerate(heads)], "file string, at long, heads long"
    )
    rows = records.join(F.broadcast(before), "file").where("number > at")
    return rows.select(
        (F.col("number") - F.col("heads")).alias("pair_id"),
        F.from_csv("text", ddl, OPTIONS).alias("r"),
    ).select("pair_id", *(F.col("r").getField(n).alias(n) for n in names))


def _cells(spark: SparkSession, head: str) -> list[str]:
    """The cells of one header record, as Spark reads them."""
    width = head.count(",") + 1
    ddl = ", ".join(f"c{i} string" for i in range(width))
    one = spark.createDataFrame([(head.removeprefix(BOM),)], "head string")
    return [c for c in one.select(F.from_csv("head", ddl, OPTIONS).alias("r")).first()["r"] if c is not None]
