"""Runs of the transform, samples at their ends, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions import byte_width
from ringloom.operators.ranking import sums_before

#: Positions that are looked at together; what goes on from block to block is summed over one row each.
BLOCK = 1 << 16


def _pieces(rows: DataFrame, break_at: Column | None, block: int) -> DataFrame:
    """`rows` with run_id, from 0. Breaks are found within blocks of positions; a block's first row is held against the last of the block before; counts of breaks of the blocks before are added."""
    held = rows.withColumn("_block", F.floor(F.col("pos") / block))
    own = Window.partitionBy("_block").orderBy("pos")
    ends = held.groupBy("_block").agg(F.max_by("bwt", "pos").alias("_last")).select((F.col("_block") + 1).alias("_block"), "_last")
    held = held.withColumn("_lag", F.lag("bwt").over(own)).join(ends, "_block", "left")
    new = ~F.col("bwt").eqNullSafe(F.coalesce("_lag", "_last"))
    if break_at is not None:
        new = new | break_at
    held = held.withColumn("_new", new.cast("long"))
    offsets = sums_before(held.groupBy("_block").agg(F.sum("_new").alias("_n")), "_block", "_n", "_before")
    run = F.sum("_new").over(own) + F.col("_before") - 1
    return held.join(offsets, "_block").withColumn("run_id", run)


def rle(ebwt: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, head, length, start_pos) of the maximal runs of (pos, bwt)."""
    return (
        _pieces(ebwt.select("pos", "bwt"), None, block).groupBy("run_id")
        .agg(F.first("bwt").alias("head"), F.count(F.lit(1)).alias("length"), F.min("pos").alias("start_pos"))
    )


def pieces_of_runs(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(head, length, start_pos) cut at multiples of `block`, so that no piece is longer."""
    first, end = F.col("start_pos"), F.col("start_pos") + F.col("length")
    cut = runs.select("head", "length", "start_pos", F.explode(F.sequence(F.floor(first / block), F.floor((end - 1) / block))).alias("_block"))
    low, high = F.greatest(first, F.col("_block") * block), F.least(end, (F.col("_block") + 1) * block)
    return cut.select("head", (high - low).alias("length"), low.alias("start_pos"))


def expand(runs: DataFrame) -> DataFrame:
    """(pos, bwt) from (head, length, start_pos). Long runs are expanded piece by piece."""
    return pieces_of_runs(runs).select(F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + F.col("length") - 1)).alias("pos"), F.col("head").alias("bwt"))


def samples(sorted_rows: DataFrame, split_starts: bool = False, block: int = BLOCK) -> DataFrame:
    """(run_id, start_da, start_gca, end_da, end_gca): sequence and offset at both ends of each run of (pos, bwt, seq_id, off); with `split_starts`, each offset 0 also begins a run."""
    runs = _pieces(sorted_rows, F.col("off") == 0 if split_starts else None, block).groupBy("run_id").agg(
        F.min_by(F.struct("seq_id", "off"), "pos").alias("s"), F.max_by(F.struct("seq_id", "off"), "pos").alias("e")
    )
    return runs.select(
        "run_id", F.col("s.seq_id").alias("start_da"), F.col("s.off").alias("start_gca"), F.col("e.seq_id").alias("end_da"), F.col("e.off").alias("end_gca")
    )


def info(runs: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: runs, ebwt_length, and the bytes of an offset and of a sequence number."""
    total = runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("length").cast("long").alias("ebwt_length"))
    m = sequences.agg(F.count(F.lit(1)).alias("m"))
    return total.crossJoin(m).select("runs", "ebwt_length", byte_width(F.col("ebwt_length")).alias("bytes_gca"), byte_width(F.col("m")).alias("bytes_da"))


def i_positions(sorted_rows: DataFrame) -> DataFrame:
    """(pos) of the rotations that are the sequences themselves."""
    return sorted_rows.filter("off = 0").select("pos")


def gca(sorted_rows: DataFrame) -> DataFrame:
    """(pos, da, gca): sequence and offset of each rotation."""
    return sorted_rows.select("pos", F.col("seq_id").alias("da"), F.col("off").alias("gca"))
