"""Phrase counts over a stream of sequences.

The parse of a sequence needs nothing but the sequence, and counts of phrases only grow, so the dictionary can be kept up to date as sequences arrive. Ranks, and all that follows from them, need the whole collection and stay a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME
from ringloom.operators import phrases as batch


def phrase_stream(seqs: DataFrame, w: int = 10, p: int = 100, primes=(PLAIN_PRIME,), remainders=(0,)) -> DataFrame:
    """The phrases of a stream of (seq_id, seq): what phrases.phrases() gives, in any output mode."""
    return batch.phrases(seqs, w, p, primes, remainders)


def dictionary_counts(seqs: DataFrame, w: int = 10, p: int = 100, primes=(PLAIN_PRIME,), remainders=(0,)) -> DataFrame:
    """(phrase, occ) over all sequences so far; for output modes `update` and `complete`. The state is a row for each distinct phrase."""
    return phrase_stream(seqs, w, p, primes, remainders).groupBy("phrase").agg(F.count(F.lit(1)).alias("occ"))
