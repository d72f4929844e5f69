"""From the transform back to the sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.operators.circular_sa import CHUNK
from ringloom.operators.durable import drop_table, scratch, settle
from ringloom.operators.ranking import row_numbers, sums_in_order
from ringloom.operators.runs import BLOCK


def histogram(ebwt: DataFrame) -> DataFrame:
    """(bwt, n) of each symbol."""
    return ebwt.groupBy("bwt").agg(F.count(F.lit(1)).alias("n"))


def c_array(ebwt: DataFrame) -> DataFrame:
    """(bwt, n, smaller): how often each symbol occurs, and how many smaller symbols there are. One row a symbol is ordered."""
    before = Window.orderBy("bwt").rowsBetween(Window.unboundedPreceding, -1)
    return histogram(ebwt).withColumn("smaller", F.coalesce(F.sum("n").over(before), F.lit(0)))


def lf_mapping(ebwt: DataFrame) -> DataFrame:
    """(pos, bwt, lf): where the rotation that starts with the last symbol of each rotation stands. Smaller symbols, then equal symbols before it: the number of the row by (bwt, pos)."""
    return row_numbers(ebwt.select("pos", "bwt"), ["bwt", "pos"], "lf").select("pos", "bwt", "lf")


def lf_runs(runs: DataFrame) -> DataFrame:
    """(head, length, start_pos, lf): where each run's rotations go; those of a run stay together and in order. The symbols of all runs before it, by (head, start_pos): a row for each run is ordered, none for each position."""
    return sums_in_order(runs.select("head", "length", "start_pos"), ["head", "start_pos"], "length", "lf")


def _mapping_of_runs(mapped: DataFrame) -> DataFrame:
    """(pos, bwt, lf) from lf_runs(), in pieces that are no longer than a block."""
    size = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK).cast("long")))
    cut = mapped.select("head", "length", "start_pos", "lf", size.alias("_from"))
    own = F.least(F.lit(BLOCK), F.col("length") - F.col("_from"))
    rows = cut.select("head", "start_pos", "lf", F.explode(F.sequence(F.col("_from"), F.col("_from") + own - 1)).alias("_at"))
    return rows.select((F.col("start_pos") + F.col("_at")).alias("pos"), F.col("head").alias("bwt"), (F.col("lf") + F.col("_at")).alias("lf"))


def invert_runs(runs: DataFrame, starts: DataFrame, few: int | None = None) -> DataFrame:
    """What invert() gives, from the runs (head, length, start_pos): the mapping is known by run, so positions are neither sorted nor written to learn it."""
    with scratch(runs.sparkSession) as keep:
        mapped = settle(lf_runs(runs), "mapping")
        return keep(_inverted(_mapping_of_runs(mapped), starts, FEW if few is None else few)).select("ord", "seq")


#: Rows that are few enough for pointer doubling as they are.
FEW = 1 << 22


def invert(ebwt: DataFrame, starts: DataFrame, few: int = FEW) -> DataFrame:
    """(ord, seq) from (pos, bwt) and (pos) of the sequences' own rotations: the sequences in the order of `starts`.

    From each start, the mapping walks its sequence backwards. Each place learns its start and distance by list ranking: ranked(). Sequences must be primitive; each is one row in the end, which Spark holds to 2 GB.
    """
    with scratch(ebwt.sparkSession) as keep:
        return keep(_inverted(settle(lf_mapping(ebwt), "mapping"), starts, few)).select("ord", "seq")


def _inverted(lf: DataFrame, starts: DataFrame, few: int) -> DataFrame:
    """(ord, head, seq) from the mapping (pos, bwt, lf)."""
    heads = settle(starts.select("pos").distinct(), "heads")
    placed = ranked(lf.select("pos", F.col("lf").alias("prev")), heads, few)
    texts = _joined(placed.join(lf.select("pos", "bwt"), "pos").select("head", (-F.col("dist")).alias("place"), "bwt"), "head")
    return row_numbers(texts, ["head"], "ord")


#: No place.
NONE = -1


def ranked(lists: DataFrame, heads: DataFrame, few: int = FEW) -> DataFrame:
    """(pos, head, dist) from (pos, prev), a permutation, and (pos) of the settled `heads`, one in each of its cycles: which head a place comes to, against `prev`, and in how many steps. A cycle without a head is an error.

    Places whose hash is smaller than that of both neighbours, a third, leave the lists; their neighbours are joined across the gap. So rows fall to two thirds a round, and all rounds together shuffle a few times as many rows as there are places, however long the lists are. The last `few` are ranked by pointer doubling; then places come back round by round, each from the neighbour that it left.
    """
    end = F.lit(NONE).cast("long")
    # lists end at heads, and begin before them
    is_head = F.col("head").isNotNull()
    now = lists.select(F.col("prev").alias("pos"), F.col("pos").alias("next")).join(heads.withColumnRenamed("pos", "head"), F.col("pos") == F.col("head"), "left")
    now = now.select("pos", F.when(is_head, end).otherwise(F.col("next")).alias("next"), F.when(is_head, 0).otherwise(1).cast("long").alias("step"))
    gone: list[DataFrame] = []
    open_ = lists.count()
    if open_ > few:
        back = lists.join(heads.withColumnRenamed("pos", "to"), F.col("prev") == F.col("to"), "left")
        back = back.select("pos", F.when(F.col("to").isNotNull(), end).otherwise(F.col("prev")).alias("prev"))
        now = settle(now.join(back, "pos"), "lists")
    while open_ > few:
        drawn = lambda c, i=len(gone): F.xxhash64(c, F.lit(i))
        low = (F.col("next") >= 0) & (drawn("pos") < drawn("next")) & ((F.col("prev") < 0) | (drawn("pos") < drawn("prev")))
        marked = settle(now.withColumn("gone", low), "lists")
        out = marked.filter("gone")
        none = F.lit(None).cast("long")
        told = marked.filter("NOT gone").select("pos", "next", "step", "prev", none.alias("next2"), none.alias("more"), none.alias("prev2"))
        told = told.union(out.filter("prev >= 0").select(F.col("prev").alias("pos"), none, none, none, "next", "step", none))
        told = told.union(out.select(F.col("next").alias("pos"), none, none, none, none, none, "prev"))
        met = told.groupBy("pos").agg(*[F.max(c).alias(c) for c in told.columns[1:]])
        step = F.col("step") + F.coalesce("more", F.lit(0))
        after = settle(met.select("pos", F.coalesce("next2", "next").alias("next"), step.alias("step"), F.coalesce("prev2", "prev").alias("prev")), "lists")
        drop_table(now)
        left = after.filter("next >= 0").count()
        gone.append(out.select("pos", "next", "step"))
        now = after
        if left == open_:
            break
        open_ = left
    found = [_doubled(now)]
    for out in reversed(gone):
        known = reduce(DataFrame.union, found).select(F.col("pos").alias("next"), "head", "dist")
        found.append(settle(out.join(known, "next").select("pos", "head", (F.col("dist") + F.col("step")).alias("dist")), "ranked"))
    return reduce(DataFrame.union, found)


def _doubled(lists: DataFrame) -> DataFrame:
    """(pos, head, dist) of (pos, next, step) by pointer doubling. Places that have come to their head leave the rounds."""
    start = lists.select("pos", F.when(F.col("next") < 0, F.col("pos")).otherwise(F.col("next")).alias("head"), F.col("step").alias("dist"), (F.col("next") < 0).alias("done"))
    now, closed, rounds = settle(start, "jumps"), [], 0
    most = now.count().bit_length()
    while now.filter("NOT done").limit(1).count():
        if rounds > most:
            raise ValueError("a cycle has no start")
        closed.append(now.filter("done"))
        known = reduce(DataFrame.union, [*closed, now.filter("NOT done")])
        known = known.select(F.col("pos").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        met = now.filter("NOT done").join(known, "head")
        now = settle(met.select("pos", F.col("head2").alias("head"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done")), "jumps")
        rounds += 1
    return reduce(DataFrame.union, [*closed, now]).select("pos", "head", "dist")


def _joined(symbols: DataFrame, name: str, chunk: int = CHUNK) -> DataFrame:
    """(`name`, seq): the symbols of each string in the order of `place`. Chunks of it are put together first, so that no row holds an entry for each symbol of a long one; the string itself is one row."""
    text = lambda of: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*of))), lambda x: x[of[1]]), "")
    parts = symbols.groupBy(name, F.floor(F.col("place") / chunk).alias("_part")).agg(text(["place", "bwt"]).alias("_text"))
    return parts.groupBy(name).agg(text(["_part", "_text"]).alias("seq"))


def invert_gca(sorted_rows: DataFrame) -> DataFrame:
    """(seq_id, seq) where sequence and offset of each rotation are known: the symbol before each offset, in order."""
    # the symbol before offset 0 is the last
    place = F.when(F.col("off") == 0, F.lit(1 << 62)).otherwise(F.col("off"))
    return _joined(sorted_rows.select("seq_id", place.alias("place"), "bwt"), "seq_id")
