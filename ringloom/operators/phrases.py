"""Circular prefix-free parsing: phrases, their dictionary, and the parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME, phrase_hash
from ringloom.operators.ranking import row_numbers
from ringloom.operators.triggers import packs


def cut(seqs: list[str], row: np.ndarray, ends: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(idx, end_pos, len, phrases) of the triggers that end at `ends` of the sequences numbered `row`, in order: from the first symbol of each trigger through the last of the next, around the sequence. A single trigger gives one phrase that comes back to itself."""
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(begins, append=len(row))
    idx = np.arange(len(row)) - np.repeat(begins, count)
    nxt = np.append(ends[1:], 0)
    nxt[begins + count - 1] = ends[begins]
    n = np.repeat(np.array([len(seqs[i]) for i in row[begins].tolist()], np.int64), count)
    start = (ends - w + 1) % n
    stop = start + w + (nxt - ends - 1) % n + 1
    turns = -(-stop // n)
    found = [
        seqs[i][a:b] if t == 1 else (seqs[i] * t)[a:b] for i, a, b, t in zip(row.tolist(), start.tolist(), stop.tolist(), turns.tolist(), strict=True)
    ]
    return idx, nxt, n, found


def phrases(seqs: DataFrame, w: int, p: int, primes=(PLAIN_PRIME,), remainders=(0,)) -> DataFrame:
    """(seq_id, idx, phrase, end_pos, len) of each sequence with a trigger: its phrases in order, where each ends, and the sequence's length. Sequences without a trigger, triggers.filtered(), have none.

    Texts are cut in place, in batches; what leaves a task is longer than what came by w symbols a phrase.
    """
    primes, remainders = tuple(primes), tuple(remainders)

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("seq_id").to_numpy(), batch.column("seq").to_pylist()
            for pack in packs(texts, w):
                row, ends = pack.places(np.flatnonzero(pack.hit(p, primes, remainders)))
                if not len(ends):
                    continue
                idx, nxt, n, found = cut(texts, row, ends, w)
                for at in range(0, len(found), 10_000):
                    part = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[part]]), pa.array(idx[part]), pa.array(found[part]), pa.array(nxt[part]), pa.array(n[part])],
                        ["seq_id", "idx", "phrase", "end_pos", "len"],
                    )

    return seqs.select("seq_id", "seq").mapInArrow(segmented, "seq_id long, idx long, phrase string, end_pos long, len long")


def dictionary(found: DataFrame) -> DataFrame:
    """(rank, phrase, occ): distinct phrases ranked from 1 in byte order, and how often each occurs."""
    counted = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("occ"))
    return row_numbers(counted, ["phrase"], "rank", start=1).select("rank", "phrase", "occ")


def dictionary_stats(words: DataFrame) -> DataFrame:
    """One row: distinct phrases, their symbols, and occurrences."""
    return words.agg(
        F.count(F.lit(1)).alias("phrases"), F.sum(F.length("phrase")).cast("long").alias("symbols"), F.sum("occ").cast("long").alias("occurrences")
    )


def collisions(words: DataFrame) -> DataFrame:
    """(hash, n) of phrase hashes that several phrases share; none is expected, and nothing depends on them."""
    return words.select(phrase_hash(F.col("phrase")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def parse(found: DataFrame, words: DataFrame) -> DataFrame:
    """(seq_id, idx, rank, end_pos, len): each phrase by its rank. Spark broadcasts a small dictionary and splits a skewed join."""
    return found.join(words.select("phrase", "rank"), "phrase").select("seq_id", "idx", "rank", "end_pos", "len")


def start_offsets(parsed: DataFrame) -> DataFrame:
    """(seq_id, rank, end_pos): the last phrase of each sequence, which holds its first symbol, and where the phrase ends."""
    last = parsed.groupBy("seq_id").agg(F.max_by(F.struct("rank", "end_pos"), "idx").alias("p"))
    return last.select("seq_id", F.col("p.rank").alias("rank"), F.col("p.end_pos").alias("end_pos"))


def start_chars(parsed: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (rank, off): which phrases hold a sequence's first symbol, and at which offsets."""
    at = start_offsets(parsed).join(words, "rank")
    return at.select("rank", (F.length("phrase") - 1 - F.col("end_pos")).cast("long").alias("off")).distinct()
