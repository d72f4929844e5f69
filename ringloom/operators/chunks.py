"""Sequences in pieces, so that one may be longer than a row can be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME
from ringloom.operators.durable import scratch, settle
from ringloom.operators.triggers import codes_of, trigger_mask

#: Symbols of a chunk.
SIZE = 1 << 20
_PIECES = "seq_id long, chunk long, n long, triggers long, nth long, text string, stop long"


def chunked(seqs: DataFrame, size: int = SIZE) -> DataFrame:
    """(seq_id, chunk, text): the sequences of (seq_id, seq) in chunks of `size` symbols, numbered from 0, the last one shorter."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    rows = seqs.select("seq_id", "seq", at.alias("at"))
    return rows.select("seq_id", F.floor(F.col("at") / size).alias("chunk"), F.substring("seq", F.col("at") + 1, F.lit(size)).alias("text")).filter("text <> ''")


def _pieces(w: int, p: int, primes, remainders):
    """Each chunk at its triggers: what lies between two of them is a phrase, nth from 0; what stands before the first is numbered -1, and what comes from the last one on is the last. Without triggers, the chunk is one piece, numbered -1."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, chunk, before, text in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "chunk", "before", "text")), strict=True):
                lead = len(before)
                hit = trigger_mask(codes_of(before + text), w, p, primes, remainders)
                # windows that begin before what is known here end in no place of this chunk
                ends = np.flatnonzero(hit[lead:]).tolist() if lead >= w - 1 else []
                whole, out, at = before + text, [], 0
                for k, e in enumerate([*ends, len(text) - 1]):
                    # from the first symbol of the trigger before, or from the chunk's first
                    out.append((k - 1, whole[at : lead + e + 1] if k else text[: e + 1], e if k < len(ends) else None))
                    at = lead + e - w + 1
                for i in range(0, len(out), 10_000):
                    nth, texts, stops = zip(*out[i : i + 10_000], strict=True)
                    same = lambda v, n=len(nth): pa.array([v] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [same(seq_id), same(chunk), same(len(text)), same(len(ends)), pa.array(nth, pa.int64()), pa.array(texts), pa.array(stops, pa.int64())],
                        ["seq_id", "chunk", "n", "triggers", "nth", "text", "stop"],
                    )

    return pieces


def phrases_of_chunks(chunks: DataFrame, w: int, p: int, primes=(PLAIN_PRIME,), remainders=(0,)) -> DataFrame:
    """phrases.phrases() of sequences in chunks (seq_id, chunk, text), in the order of `chunk`: (seq_id, idx, phrase, end_pos, len).

    Each chunk is cut by itself, with the w - 1 symbols before it, around the sequence. A phrase that goes on in the next chunk, or over several, is put together from their pieces, by the number of the trigger that it starts with: triggers are counted a chunk, and counts are added up over one row a chunk. So no row holds more than a chunk or a phrase. Every chunk but a sequence's last must have w - 1 symbols at least; a sequence of fewer than w symbols in all has no triggers.
    """
    own = Window.partitionBy("seq_id").orderBy("chunk")
    tail = F.substring("text", F.greatest(F.length("text") - (w - 2), F.lit(1)), F.lit(w - 1))
    with scratch(chunks.sparkSession) as keep:
        # the ends of chunks, one short row each, meet around their sequence
        ends = chunks.select("seq_id", "chunk", tail.alias("tail"), F.length("text").cast("long").alias("n"))
        last = Window.partitionBy("seq_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        turn = lambda c, k: F.coalesce(F.lag(c, k).over(own), F.nth_value(c, k).over(Window.partitionBy("seq_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        ends = ends.withColumn("count", F.count(F.lit(1)).over(last)).withColumn("len", F.sum("n").over(last))
        one, two = turn("tail", 1), turn("tail", 2)
        # the first chunk is preceded by the last; the second by the first, and that by the last
        two = F.when(F.lag("tail", 1).over(own).isNotNull() & F.lag("tail", 2).over(own).isNull(), F.last("tail").over(last)).otherwise(two)
        joined = F.concat(F.when(F.col("count") > 1, two).otherwise(F.lit("")), one)
        before = F.substring(joined, F.greatest(F.length(joined) - (w - 2), F.lit(1)), F.lit(w - 1))
        before = F.when(F.col("len") >= w, before).otherwise(F.lit(""))
        context = settle(ends.select("seq_id", "chunk", before.alias("before"), "len", (F.sum("n").over(own) - F.col("n")).alias("start")), "context")
        given = chunks.select("seq_id", "chunk", "text").join(context.select("seq_id", "chunk", "before"), ["seq_id", "chunk"])
        cut = settle(given.mapInArrow(_pieces(w, p, tuple(primes), tuple(remainders)), _PIECES), "pieces")
        counts = cut.filter("nth = -1").select("seq_id", "chunk", "triggers")
        placed = counts.join(context.select("seq_id", "chunk", "len", "start"), ["seq_id", "chunk"])
        placed = placed.withColumn("earlier", F.sum("triggers").over(own) - F.col("triggers")).withColumn("total", F.sum("triggers").over(last)).filter("total > 0")
        rows = cut.drop("triggers").join(placed.drop("triggers"), ["seq_id", "chunk"])
        nth = F.col("nth") + F.col("earlier")
        rows = rows.select(
            "seq_id", F.pmod(nth, F.col("total")).alias("idx"), (nth < 0).alias("around"), "chunk", "nth", "text", (F.col("start") + F.col("stop")).alias("end_pos"), "len"
        )
        parts = F.sort_array(F.collect_list(F.struct("around", "chunk", "nth", "text")))
        found = rows.groupBy("seq_id", "idx").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("phrase"), F.max("end_pos").alias("end_pos"), F.max("len").alias("len"))
        return keep(settle(found.select("seq_id", "idx", "phrase", "end_pos", "len"), "phrases"))
