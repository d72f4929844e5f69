"""FASTA and FASTQ files, plain or compressed."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators.durable import scratch, settle
from ringloom.operators.ranking import row_numbers
from ringloom.sources.collection import cleaned
from ringloom.sources.fastq import read_fastq

log = logging.getLogger("ringloom")


def read_fasta(spark: SparkSession, path: str, mode: str = "bytes") -> DataFrame:
    """Records of FASTA files: a `>` line names a record, the lines after it are its sequence. Lines before a file's first `>` are passed over, with a warning."""
    records = spark.read.text(path, lineSep="\n>")
    headed = F.startswith("value", F.lit(">"))
    rows = records.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        headed.alias("headed"),
        F.when(headed, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("record"),
    )
    parts = rows.select(
        "file", "split", "at", "headed",
        F.regexp_extract("record", r"^([^\s]*)", 1).alias("name"),
        F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "").alias("raw"),
    )
    with scratch(spark) as keep:
        held = settle(parts.select("file", "split", "at", "headed", "name", cleaned(F.col("raw"), mode).alias("seq")), "records")
        # all but a file's first record begin after a `>`, which parts them
        first = held.filter("split = 0").groupBy("file").agg(F.min("at").alias("at"), F.min_by("headed", "at").alias("headed"), F.min_by("name", "at").alias("name"))
        stray = settle(first.filter("NOT headed").select("file", "at", "name"), "stray")
        if files := stray.filter("name <> ''").count():
            log.warning("lines before the first record of %d files are passed over", files)
        seqs = held.join(stray, ["file", "at"], "left_anti").filter("seq <> ''")
        return keep(row_numbers(seqs.select("file", "split", "at", "name", "seq"), ["file", "split", "at"], "seq_id")).select("seq_id", "name", "seq")


def read_with_broken(spark: SparkSession, path: str, mode: str = "bytes") -> tuple[DataFrame, DataFrame | None]:
    """FASTA, FASTQ, or files with records of both: if any line starts with `@`, which none does in FASTA, records are scanned as read_fastq() does. Compressed files are told by their extension. With them, the broken records of FASTQ (file, record, reason), or None."""
    if spark.read.text(path).filter(F.startswith("value", F.lit("@"))).limit(1).count():
        return read_fastq(spark, path, mode)
    return read_fasta(spark, path, mode), None


def check_broken(broken: DataFrame | None, error: bool) -> None:
    """An error, or else a warning, if there are broken records."""
    some = broken.groupBy("reason").count().collect() if broken is not None else []
    if some:
        first = broken.orderBy("file", "record").first()
        told = f"broken FASTQ records: {', '.join(f'{r['count']} {r.reason}' for r in some)}; the first is record {first.record} of {first.file}"
        if error:
            raise ValueError(told)
        log.warning(told)


def read_sequences(spark: SparkSession, path: str, mode: str = "bytes", strict: bool = False) -> DataFrame:
    """The sequences of read_with_broken(). Broken records are told in a warning, or an error if `strict`."""
    seqs, broken = read_with_broken(spark, path, mode)
    check_broken(broken, strict)
    return seqs
