"""Writers: one Parquet table for each relation, and sequences as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.plans.api import Index, Parse

RELATIONS = ("ebwt", "rle", "i_positions", "gca", "samples", "info", "filtered")


def write_index(index: Index, path: str, mode: str = "errorifexists") -> list[str]:
    """Write the relations that the index has to `path`/name; their names."""
    there = [name for name in RELATIONS if getattr(index, name) is not None]
    for name in there:
        getattr(index, name).write.mode(mode).parquet(f"{path}/{name}")
    return there


def read_index(spark: SparkSession, path: str, names: list[str]) -> Index:
    """An index from what write_index() wrote."""
    return Index(**{name: spark.read.parquet(f"{path}/{name}") if name in names else None for name in RELATIONS})


def write_parse(parts: Parse, path: str, mode: str = "errorifexists") -> None:
    for name, df in (("dictionary", parts.words), ("parse", parts.parsed), ("filtered", parts.filtered)):
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_lines(seqs: DataFrame, path: str, order: str = "seq_id", mode: str = "errorifexists") -> None:
    """One sequence a line, in the order of a column: files by key range, so their names follow the order."""
    seqs.orderBy(order).select(F.col("seq").alias("value")).write.mode(mode).text(path)
