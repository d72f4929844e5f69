"""Omega-order of all rotations of a collection of symbol strings by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringloom.operators.durable import partitions, scratch, settle
from ringloom.operators.ranking import dense_ranks, row_numbers, sums_in_order


#: Symbols of a character's window.
WIDTH = 8
#: Symbols of the first windows where an order is wanted: five rounds of doubling fewer, and strings up to this length need none.
WIDE = 32
#: The same of the parse, in phrases.
PHRASES = 16
#: Symbols of a string that are handled in one row.
CHUNK = 1 << 16


def classes(symbols: DataFrame, symbol: str, width: int = 1, around: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, idx, class, *carry) from (seq_id, idx, `symbol`, k, *carry): how many rotations are smaller than that of its string that starts at each place; equal rotations share it. k is the string's length, and `symbol` tells the first `width` places of the rotation. Not `around`: of the suffix that starts at each place.

    A class is a number, and the ones after it up to its size are its own, so it stays where it is when others split. It is closed once it can't split any more: when it has one member, or when its windows are so long that equal ones are equal rotations (one period of strings of the same length, two where lengths differ), or suffixes (all of it). Its rows leave the rounds. For the others, ranks of windows of h symbols give ranks of windows of 2h by one join on (seq_id, idx) and sums over distinct pairs, until no class splits; then none ever does. So there are at most log2(longest) + 2 rounds, each writes the rows that were still open, and a row leaves with a round that is a few times the length of its longest repeat.
    """
    needs = F.when(F.min("k") == F.max("k"), F.max("k")).otherwise(2 * F.max("k")) if around else F.max(F.col("k") - F.col("idx"))
    ended = lambda h: (F.col("n") == 1) | (F.col("longest") <= h)
    groups = lambda rows, keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), needs.alias("longest"))
    kept = ["seq_id", "idx", "k", *(c for c in carry if c != "k")]
    with scratch(symbols.sparkSession) as keep:
        with scratch(symbols.sparkSession) as keep_round:
            first = sums_in_order(groups(symbols, [symbol]), [symbol], "n", "class")
            placed = symbols.select(*kept, F.col(symbol).alias("_symbol")).join(first.withColumnRenamed(symbol, "_symbol"), "_symbol")
            now = keep_round(settle(placed.select(*kept, "class", ended(width).alias("done"), F.lit(True).alias("split")), "classes"))
        closed, h = [], width
        while True:
            keep(now)
            left, split = now.agg(F.count_if(~F.col("done")), F.max("split")).first()
            if not left or not split:
                return reduce(DataFrame.union, [x.select("seq_id", "idx", "class", *carry) for x in (*closed, now)])
            with scratch(symbols.sparkSession) as keep_round:
                closed.append(now.filter("done"))
                open_ = now.filter("NOT done").select(*kept, "class")
                ahead = F.pmod(F.col("idx") + h, F.col("k")) if around else F.col("idx") + h
                known = reduce(DataFrame.union, [x.select("seq_id", F.col("idx").alias("ahead"), F.col("class").alias("next")) for x in (*closed, open_)])
                pairs = open_.withColumn("ahead", ahead).join(known, ["seq_id", "ahead"], "inner" if around else "left")
                # nothing stands before anything else
                pairs = pairs.select(*kept, "class", F.coalesce("next", F.lit(-1).cast("long")).alias("next"))
                # a part of a class takes as many numbers as it has members
                each = sums_in_order(groups(pairs, ["class", "next"]), ["class", "next"], "n", "before")
                whole = each.groupBy("class").agg(F.min("before").alias("base"), F.max("before").alias("top"))
                moved = each.join(whole, "class").select("class", "next", (F.col("class") + F.col("before") - F.col("base")).alias("to"), ended(2 * h).alias("done"), (F.col("top") > F.col("base")).alias("split"))
                now = keep_round(settle(pairs.join(moved, ["class", "next"]).select(*kept, F.col("to").alias("class"), "done", "split"), "classes"))
            h *= 2


#: Rows that leave a task together.
ROWS = 8192


def characters(seqs: DataFrame, width: int = WIDTH, around: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, idx, k, window, bwt) of each character: the `width` symbols from it on, and the one before it, around the string; not `around`, windows end with the string, and the first symbol has an empty one before it. Strings are handled in chunks, so no row holds an entry for each symbol of a long one."""
    names = ["seq_id", "idx", "k", "window", "bwt"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, windows, before = [], [], []

        def told() -> pa.RecordBatch:
            sizes = [high - low for _, low, high, _ in pieces]
            idx = np.concatenate([np.arange(low, high) for _, low, high, _ in pieces])
            of = lambda j: np.repeat(np.array([piece[j] for piece in pieces], np.int64), sizes)
            out = pa.RecordBatch.from_arrays([pa.array(of(0)), pa.array(idx), pa.array(of(3)), pa.array(windows), pa.array(before)], names)
            pieces.clear(), windows.clear(), before.clear()
            return out

        for batch in batches:
            for seq_id, seq in zip(batch.column("seq_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                k = len(seq)
                for low in range(0, k, chunk):
                    high = min(k, low + chunk)
                    over = high + width - 1 - k
                    body = seq[low : high + width - 1]
                    if around and over > 0:
                        body += seq[:over] if over <= k else (seq * (over // k + 1))[:over]
                    windows += [body[j : j + width] for j in range(high - low)]
                    if low:
                        before += seq[low - 1 : high - 1]
                    else:
                        before.append(seq[-1] if around else "")
                        before += seq[: high - 1]
                    pieces.append((seq_id, low, high, k))
                    if len(windows) >= ROWS:
                        yield told()
        if pieces:
            yield told()

    return seqs.select(F.col("seq_id").cast("long"), "seq").mapInArrow(cells, "seq_id long, idx long, k long, window string, bwt string")


def sorted_rotations(seqs: DataFrame) -> DataFrame:
    """(pos, bwt, seq_id, off): what conjugates.sorted_rotations() gives, for collections of any size."""
    with scratch(seqs.sparkSession) as keep:
        chars = settle(characters(seqs, WIDE), "characters")
        rows = classes(chars, "window", WIDE, carry=("bwt",)).select("class", "seq_id", F.col("idx").alias("off"), "bwt")
        return keep(row_numbers(rows, ["class", "seq_id", "off"], "pos")).select("pos", "bwt", "seq_id", "off")


# ---- the parse ----


def parse_windows(parse: DataFrame, before: tuple[str, ...] = (), width: int = PHRASES, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, idx, k, rank, window, prev_...) from (seq_id, idx, rank, ...): the sequence's number of phrases, the ranks of the `width` phrases from each on, around the sequence, eight bytes each, and the columns `before` of the phrase before it.

    Each sequence's phrases come together by a shuffle; those of long ones in chunks, which get the neighbours of their first and last phrase as well.
    """
    if width > chunk:
        raise ValueError("a chunk must have a window's phrases")
    long_ones = parse.filter(F.col("idx") >= chunk).groupBy("seq_id").agg((F.max("idx") + 1).alias("_k"))
    columns = list(dict.fromkeys(["rank", *before]))
    idx, k = F.col("idx"), F.col("_k")
    rows = parse.select("seq_id", "idx", *columns).join(long_ones, "seq_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0).cast("long")))
    # the last chunk takes what is left, so that none is shorter than a window
    rows = rows.withColumn("_last", F.greatest(F.floor(k / chunk) - 1, F.lit(0)))
    rows = rows.withColumn("_own", F.least(F.floor(idx / chunk), F.col("_last")))
    own, last = F.col("_own"), F.col("_last")
    to = lambda part, place, here: F.struct(part.alias("part"), place.alias("place"), F.lit(here).alias("own"))
    several, first = last > 0, own == 0
    back = F.when(several & (idx - own * chunk < width - 1), to(F.when(first, last).otherwise(own - 1), F.when(first, idx + k).otherwise(idx), False))
    on = F.when(several & (idx == F.when(own == last, k).otherwise((own + 1) * chunk) - 1), to(F.when(own == last, F.lit(0).cast("long")).otherwise(own + 1), F.when(own == last, idx - k).otherwise(idx), False))
    rows = rows.withColumn("_to", F.explode(F.array_compact(F.array(to(own, idx, True), back, on)))).select(
        "seq_id", "idx", *columns, "_k", F.col("_to.part").alias("_part"), F.col("_to.place").alias("_place"), F.col("_to.own").alias("_here")
    )
    rows = rows.repartition(partitions(parse.sparkSession), "seq_id", "_part").sortWithinPartitions("seq_id", "_part", "_place")
    prev = [f"prev_{c}" for c in before]

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        of = lambda c: table.column(c).to_numpy()
        begins = _begins(table)
        sizes = np.diff(begins, append=table.num_rows)
        start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        place = np.arange(table.num_rows) - start
        columns_of = {c: of(c) for c in columns}
        ids, at, count = of("seq_id"), of("idx"), np.where(of("_k") > 0, of("_k"), size)
        here = np.flatnonzero(of("_here"))
        for low in range(0, len(here), ROWS):
            i = here[low : low + ROWS]
            ring = start[i, None] + (place[i, None] + np.arange(width)) % size[i, None]
            cells = pa.py_buffer(columns_of["rank"][ring].astype(">i8").tobytes())
            window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(i), [None, cells]).cast(pa.binary())
            j = start[i] + (place[i] - 1) % size[i]
            values = [ids[i], at[i], count[i], columns_of["rank"][i]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, values), window, *[pa.array(columns_of[c][j]) for c in before]], ["seq_id", "idx", "k", "rank", "window", *prev])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if not batch.num_rows or (sum(b.num_rows for b in held) < ROWS):
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            # the last one may go on
            till = table.num_rows if batch is None else int(_begins(table)[-1])
            if till:
                yield from whole(table.slice(0, till))
            held = table.slice(till).to_batches()

    types = {f.name: f.dataType for f in parse.schema.fields}
    fields = [("seq_id", T.LongType()), ("idx", T.LongType()), ("k", T.LongType()), ("rank", T.LongType()), ("window", T.BinaryType()), *[(f"prev_{c}", types[c]) for c in before]]
    return rows.mapInArrow(cut, T.StructType([T.StructField(*f) for f in fields]))


def _begins(table: pa.Table) -> np.ndarray:
    """Where each sequence, or chunk of one, begins."""
    ids, part = table.column("seq_id").to_numpy(), table.column("_part").to_numpy()
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])]))


def parse_classes(parse: DataFrame, before: tuple[str, ...] = (), dense: bool = True) -> DataFrame:
    """(seq_id, idx, rank, csa_class, prev_...) from (seq_id, idx, rank, ...): the order of the rotations of each sequence of phrase ranks, equal ones alike, and the columns `before` of the phrase before each. `dense`: without gaps from 0."""
    carry = ("rank", *(f"prev_{c}" for c in before))
    with scratch(parse.sparkSession) as keep:
        found = classes(settle(parse_windows(parse, before), "windows"), "window", PHRASES, carry=carry)
        found = dense_ranks(found, ["class"], "csa_class") if dense else found.withColumnRenamed("class", "csa_class")
        return keep(settle(found.select("seq_id", "idx", "rank", "csa_class", *carry[1:]), "classes"))


def parse_ebwt(placed: DataFrame) -> DataFrame:
    """(csa_pos, csa_class, seq_id, idx, rank, prev_rank): the parse in the order of its rotations, equal ones by sequence and place, each with the phrase before it. `placed` is parse_classes() with the rank before."""
    return row_numbers(placed, ["csa_class", "seq_id", "idx"], "csa_pos").select("csa_pos", "csa_class", "seq_id", "idx", "rank", "prev_rank")


def inverted_list(ebwt_of_parse: DataFrame) -> DataFrame:
    """(il_pos, prev_rank, csa_pos, first): for each phrase, the places in the parse's order that it precedes, ascending; `first` marks where a phrase's list begins."""
    rows = row_numbers(ebwt_of_parse.select("prev_rank", "csa_pos"), ["prev_rank", "csa_pos"], "il_pos")
    heads = ebwt_of_parse.groupBy("prev_rank").agg(F.min("csa_pos").alias("head"))
    return rows.join(heads, "prev_rank").select("il_pos", "prev_rank", "csa_pos", (F.col("csa_pos") == F.col("head")).alias("first"))
