"""Collections from string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions import ascii_upper, has_other_than_letters, has_reserved
from ringloom.operators.durable import partitions
from ringloom.operators.ranking import row_numbers, sums_before


def cleaned(text: Column, mode: str = "bytes") -> Column:
    """`bytes`: a-z in upper case. `letters`: of that, A-Z alone."""
    upper = ascii_upper(text)
    if mode == "bytes":
        return upper
    if mode == "letters":
        return F.regexp_replace(upper, "[^A-Z]", "")
    raise ValueError(f"unknown mode {mode!r}")


def _leaves_any(text: Column, mode: str) -> Column:
    """Whether cleaned() leaves a symbol; it need not be run to know, and a filter by what it gives would run it once more for each row."""
    return text.rlike("[A-Za-z]") if mode == "letters" else text != ""


def from_table(df: DataFrame, key: str | list[str], text: str, mode: str = "bytes", name: str | None = None) -> DataFrame:
    """The collection of a string column. The order of the collection is that of `key`: an integer column is seq_id itself, several columns are numbered in their order. Null and empty strings are left out."""
    keys = [key] if isinstance(key, str) else key
    label = F.col(name) if name else F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    symbols = cleaned(F.col(text), mode).alias("seq")
    df = df.filter(_leaves_any(F.col(text), mode))
    if len(keys) == 1:
        return df.select(F.col(keys[0]).cast("long").alias("seq_id"), label.alias("name"), symbols)
    out = df.select(*keys, label.alias("name"), symbols)
    return row_numbers(out, keys, "seq_id").select("seq_id", "name", "seq")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table dealt by `key` over as many tasks as the session shuffles to: tables of short strings come in few row groups, and one is one task, however many rows it has. To be done before from_table(), so that they aren't cleaned in that task either."""
    return df.repartition(partitions(df.sparkSession), key)


def check_strict(seqs: DataFrame, letters: bool = False) -> DataFrame:
    """Sequences that a strict reader refuses, with the reason: reserved bytes anywhere, or, with `letters`, anything but A-Z."""
    bad = F.when(has_reserved(F.col("seq")), "reserved byte")
    if letters:
        bad = bad.when(has_other_than_letters(F.col("seq")), "not a letter")
    return seqs.withColumn("reason", bad).filter("reason IS NOT NULL").select("seq_id", "seq", "reason")


def with_starts(seqs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(seq_id, start_pos, length): where each sequence starts in the concatenation. Sums run within blocks of seq_id, then over one row a block."""
    rows = seqs.select("seq_id", F.length("seq").cast("long").alias("length"), F.floor(F.col("seq_id") / block).alias("_block"))
    offsets = sums_before(rows.groupBy("_block").agg(F.sum("length").alias("_n")), "_block", "_n", "_before")
    own = F.sum("length").over(Window.partitionBy("_block").orderBy("seq_id")) - F.col("length")
    return rows.withColumn("_own", own).join(offsets, "_block").select(
        "seq_id", (F.col("_own") + F.col("_before")).alias("start_pos"), "length"
    )


def concat(*collections: DataFrame) -> DataFrame:
    """Several collections one after the other, numbered anew."""
    parts = [c.select(F.lit(i).alias("part"), "seq_id", "name", "seq") for i, c in enumerate(collections)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return row_numbers(every.withColumnRenamed("seq_id", "old"), ["part", "old"], "seq_id").select("seq_id", "name", "seq")
