"""Rotations of a collection in omega-order, by definition: for short sequences, and to test all else against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators.ranking import row_numbers


def rotations(seqs: DataFrame) -> DataFrame:
    """(seq_id, off, rot, bwt, len) of every rotation; bwt is its last symbol."""
    rows = seqs.select("seq_id", "seq", F.length("seq").alias("len")).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    rot = F.concat(F.expr("substring(seq, off + 1)"), F.expr("substring(seq, 1, off)"))
    return rows.select(
        "seq_id", F.col("off").cast("long").alias("off"), rot.alias("rot"),
        F.when(F.col("off") == 0, F.expr("substring(seq, len, 1)")).otherwise(F.expr("substring(seq, off, 1)")).alias("bwt"),
        F.col("len").cast("long").alias("len"),
    )


def sorted_rotations(seqs: DataFrame) -> DataFrame:
    """(pos, bwt, seq_id, off): all rotations in omega-order, equal ones by seq_id and off.

    A rotation repeated to twice the longest length settles every comparison, so keys take 2 N max(L) symbols: short sequences only; circular_sa.sorted_rotations() does the same for long ones.
    """
    rot = rotations(seqs)
    longest = seqs.agg((F.max(F.length("seq")) * 2).cast("int").alias("k"))
    keyed = rot.crossJoin(F.broadcast(longest)).withColumn("okey", F.expr("substring(repeat(rot, cast(floor(k / len) as int) + 1), 1, k)"))
    return row_numbers(keyed, ["okey", "seq_id", "off"], "pos").select("pos", "bwt", "seq_id", "off")
