"""FASTQ records from files that are cut anywhere."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringloom.operators.durable import scratch, settle
from ringloom.operators.ranking import row_numbers
from ringloom.sources.collection import cleaned

#: Where a scan can stand: between records, among lines that belong to none, in a sequence, in a quality.
OUT, STRAY, SEQUENCE, QUALITY = range(4)
#: A line: the split that it lies in, its number there, and its text.
Line = tuple[int, int, str]
#: The number of the scan that closes what a file leaves open.
END = 1 << 62
#: Bytes of states that are sent to all tasks; more of them meet their lines in a join of both by split.
MOST_SENT = 8 << 20
STATE = "struct<mode: int, split: long, at: long, fasta: boolean, size: long, n: long, tail: array<struct<split: long, at: long, line: string>>>"
ROWS = f"file string, scanned long, split long, at long, head string, raw string, reason string, closed boolean, state {STATE}"


@dataclass
class _State:
    """What a scan knows between two lines of a file: its mode, and of an open record the place of its head, whether it began with `>`, the symbols of its sequence and of its quality so far, and the lines of the quality from the first that starts with `@`."""

    mode: int = OUT
    split: int = 0
    at: int = 0
    fasta: bool = False
    size: int = 0
    n: int = 0
    tail: list[Line] = field(default_factory=list)


def _records(lines: Iterator[Line], s: _State, end: bool = False) -> Iterator[tuple[int, int, str | None, str, str | None, bool]]:
    """(split, at, head, sequence, reason, closed) of each record, or part of one, in the lines of a split, from the state `s`, which is left as the scan ends; `end` tells that the file ends there as well. head is null but in a record's first part, reason is null where it is whole.

    `@` or `>` starts a record, sequence lines are joined up to `+`, and quality lines up to the sequence's length; empty lines are skipped. After a quality of another length, the scan goes on at the first of its lines that starts with `@`, if any.
    """
    again: deque[Line] = deque()
    head, parts = None, []

    def part(reason: str | None = None, closed: bool = True) -> tuple:
        return s.split, s.at, head, "".join(parts), reason, closed

    while True:
        place = again.popleft() if again else next(lines, None)
        if place is None:
            if not end or s.mode in (OUT, STRAY):
                break
            if s.mode == SEQUENCE:
                yield part(None if s.fasta else "malformed")
            else:
                yield part(None if s.n == s.size else "quality length")
                again.extend(s.tail)
            s.mode, s.tail = OUT, []
            continue
        split, at, line = place
        if s.mode in (OUT, STRAY):
            if line.startswith(("@", ">")):
                s.mode, s.split, s.at, s.fasta, s.size, s.n = SEQUENCE, split, at, line[0] == ">", 0, 0
                head, parts = line, []
            elif line and s.mode == OUT:
                yield split, at, line, "", "malformed", True
                s.mode = STRAY
        elif s.mode == SEQUENCE:
            if line.startswith("+"):
                s.mode = QUALITY
            elif line.startswith(("@", ">")):
                yield part(None if s.fasta else "malformed")
                again.appendleft(place)
                s.mode = OUT
            else:
                parts.append(line)
                s.size += len(line)
        else:
            s.n += len(line)
            if s.tail or line.startswith("@"):
                s.tail.append(place)
            if s.n < s.size:
                continue
            # a record of no symbols may go without a quality line
            yield part(None if s.n == s.size or (not s.size and s.tail) else "quality length")
            if s.n != s.size:
                again.extendleft(reversed(s.tail))
            s.mode, s.tail = OUT, []
    if s.mode in (SEQUENCE, QUALITY):
        if head is not None or parts:
            yield part(closed=False)
    else:
        # nothing of a record that is closed tells two scans apart
        s.split, s.at, s.fasta, s.size, s.n = 0, 0, False, 0, 0


def _scanned(emit: str):
    """The records of each split of the lines, in parts where they cross it, and a row with the state after it. emit: rows of records of `first` splits of a file, of `all`; or `end`, for rows that are the states at the ends of files."""

    def rows(file: str, split: int, lines: Iterator[str], start: dict | None) -> Iterator[tuple]:
        s = _State(**start) if start else _State()
        s.tail = [(x["split"], x["at"], x["line"]) for x in s.tail]
        last = emit == "end"
        for r in _records(((split, i, x) for i, x in enumerate(lines)), s, last):
            if emit != "first" or split == 0:
                yield (file, END if last else split, *r, None)
        if not last:
            tail = [dict(zip(("split", "at", "line"), x, strict=True)) for x in s.tail]
            yield file, split, None, None, None, None, None, None, {**vars(s), "tail": tail}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for b in batches:
                files, splits, lines = (b.column(c).to_pylist() for c in ("file", "split", "line"))
                yield from zip(zip(files, splits, strict=True), lines, itertools.repeat(b.column("start")), itertools.count())

        def found() -> Iterator[tuple]:
            for (file, split), own in itertools.groupby(cells(), lambda x: x[0]):
                _, line, starts, i = next(own)
                lines = iter(()) if emit == "end" else itertools.chain([line], (x[1] for x in own))
                yield from rows(file, split, lines, starts[i].as_py())

        held, size = [], 0
        for row in found():
            held.append(row)
            size += len(row[5] or "")
            if len(held) == 1000 or size > 1 << 22:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    return scanned


_TYPES = {
    "file": pa.string(), "scanned": pa.int64(), "split": pa.int64(), "at": pa.int64(), "head": pa.string(), "raw": pa.string(), "reason": pa.string(), "closed": pa.bool_(),
    "state": pa.struct(
        [("mode", pa.int32()), ("split", pa.int64()), ("at", pa.int64()), ("fasta", pa.bool_()), ("size", pa.int64()), ("n", pa.int64())]
        + [("tail", pa.list_(pa.struct([("split", pa.int64()), ("at", pa.int64()), ("line", pa.string())])))]
    ),
}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())], list(_TYPES))


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike in each scan, also if executors come or go in between."""
    name = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(name, None)
    if old is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line), in a file's order within each split; splits are told by their offset."""
    return spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line")
    )


def _started(lines: DataFrame, starts: DataFrame, most_sent: int) -> DataFrame:
    """The lines of the splits in the settled `starts`, each with its split's state at the start."""
    size = starts.agg(F.coalesce(F.sum(F.length("file") + 64 + F.length(F.to_json("start"))), F.lit(0))).first()[0]
    if size <= most_sent:
        # lines stay where they are, in order
        return lines.join(F.broadcast(starts), ["file", "split"])
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    met = numbered.join(starts.hint("merge"), ["file", "split"]).repartition("file", "split")
    return met.sortWithinPartitions("file", "split", "at").drop("at")


def read_fastq(spark: SparkSession, path: str, mode: str = "bytes", most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """Records of FASTQ files, on one line each or wrapped, and the broken ones (file, record, reason) with the reason: a quality that is missing or of another length, or a record without its `@` or `+`.

    Where a record ends is known only from its start, so splits of a file depend on each other: by the state in which the scan of one leaves its last line. Each split is first scanned as if it began between records, which leaves it in the right state as a rule, as scans that begin in different states soon meet. Then each is scanned from the state that the split before it was left in, and again if that changes, until none does: two scans in all, as a rule, each of them in as many tasks as splits. What a split leaves open is told to the next one by a few numbers, not by its text; parts of a record that crosses splits are put together in the end. Files whose codec can't be split are one split and scanned once. Up to `most_sent` bytes of states are broadcast.
    """
    with scratch(spark) as keep, _same_splits(spark):
        lines = _lines(spark, path)
        none = F.lit(None).cast(STATE)
        of = lambda rows: rows.filter("state IS NOT NULL").select("file", F.col("scanned").alias("split"), "state")
        rows = settle(lines.withColumn("start", none).mapInArrow(_scanned("first"), ROWS), "records")
        tables, states = [rows.filter("state IS NULL")], of(rows).withColumn("start", none)
        # the first split's start is right, all others are still to be scanned for their records
        wanted = F.col("split") > 0
        while True:
            before = F.lag("state").over(Window.partitionBy("file").orderBy("split"))
            moved = settle(states.withColumn("next", before).filter(wanted).select("file", "split", F.col("next").alias("start")), "starts")
            if not moved.limit(1).count():
                break
            rows = settle(_started(lines, moved, most_sent).mapInArrow(_scanned("all"), ROWS), "records")
            gone = moved.select("file", F.col("split").alias("scanned"))
            tables = [*(t.join(gone, ["file", "scanned"], "left_anti") for t in tables), rows.filter("state IS NULL")]
            others = states.join(moved.select("file", "split"), ["file", "split"], "left_anti")
            states = settle(others.unionByName(of(rows).join(moved, ["file", "split"])), "states")
            wanted = (F.col("split") > 0) & ~F.col("start").eqNullSafe(F.col("next"))
        left = states.groupBy("file").agg(F.max("split").alias("split"), F.max_by("state", "split").alias("start")).withColumn("line", F.lit(""))
        tables.append(left.select("file", "split", "line", "start").mapInArrow(_scanned("end"), ROWS))
        parts = _union(tables).select("file", "scanned", "split", "at", "head", "raw", "reason", "closed")
        own = ["file", "split", "at"]
        whole = parts.filter("closed AND head IS NOT NULL").select(*own, "head", "raw", "reason")
        pieces = F.transform(F.sort_array(F.collect_list(F.struct("scanned", "raw"))), lambda x: x.raw)
        crossing = parts.filter("NOT (closed AND head IS NOT NULL)").groupBy(*own).agg(
            F.max("head").alias("head"), F.array_join(pieces, "").alias("raw"), F.max("reason").alias("reason")
        )
        found = settle(whole.union(crossing).select(*own, F.regexp_extract("head", r"^[@>]([^\s]*)", 1).alias("name"), cleaned(F.col("raw"), mode).alias("seq"), "reason"), "found")
        good = found.filter("reason IS NULL AND seq <> ''").drop("reason")
        seqs = keep(row_numbers(good, own, "seq_id")).select("seq_id", "name", "seq")
        # a record's number in its file: the records of the splits before it, and its number in its split
        bad = found.filter("reason IS NOT NULL").select("file", "split").distinct()
        inside = found.select(*own, "reason").join(bad, ["file", "split"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("file", "split").orderBy("at")))
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        base = found.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n")).select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        told = inside.filter("reason IS NOT NULL").join(base, ["file", "split"])
        broken = keep(settle(told.select("file", (F.col("base") + F.col("nth") - 1).alias("record"), "reason"), "broken"))
        return seqs, broken


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out
