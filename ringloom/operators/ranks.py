"""The transform as a stored structure that answers rank, select and access for many places at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.operators.durable import drop_table, partitions, scratch, settle
from ringloom.operators.runs import BLOCK, pieces_of_runs

#: Symbols of a block, blocks of a group, and occurrences of a symbol that select() looks up together.
SMALL, GROUP, BUCKET = 1 << 12, 1 << 10, 1 << 10


@dataclass
class Ranks:
    """blocks (block, text): the transform in pieces of `small` symbols. groups (bwt, group, before, n, counts): for each symbol and group of blocks from its first on, its occurrences before the group and in it, and (block, n) of each block that has it. totals (bwt, n, smaller)."""

    blocks: DataFrame
    groups: DataFrame
    totals: DataFrame
    small: int
    group: int

    def release(self) -> None:
        for table in (self.blocks, self.groups, self.totals):
            drop_table(table)


def stored_ranks(runs: DataFrame, small: int = SMALL, group: int = GROUP) -> Ranks:
    """The structure over runs (head, length, start_pos). Runs are cut at the ends of blocks, so no more rows are made than there are runs and blocks. A symbol has a row for each group of `small` x `group` positions, and only these are added up in order."""
    with scratch(runs.sparkSession) as keep:
        pieces = settle(pieces_of_runs(runs, small).withColumn("block", F.floor(F.col("start_pos") / small)), "pieces")
        text = F.transform(F.sort_array(F.collect_list(F.struct("start_pos", "head", "length"))), lambda x: F.repeat(x["head"], x["length"].cast("int")))
        blocks = keep(settle(pieces.groupBy("block").agg(F.array_join(text, "").alias("text")), "blocks"))
        each = pieces.groupBy(F.col("head").alias("bwt"), "block").agg(F.sum("length").alias("n"))
        held = each.groupBy("bwt", F.floor(F.col("block") / group).alias("group")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "n"))).alias("counts"))
        held = settle(held, "held")
        order = Window.partitionBy("bwt").orderBy("group")
        last = held.agg(F.max("group").alias("_last"))
        rows = held.withColumn("before", F.sum("n").over(order) - F.col("n")).crossJoin(F.broadcast(last))
        # groups without the symbol, and one behind the last, come after those with it
        until = F.coalesce(F.lead("group").over(order) - 1, F.col("_last") + 1)
        rows = rows.withColumn("_until", until).select("bwt", F.col("group").alias("_own"), "before", "n", "counts", F.explode(F.sequence("group", "_until")).alias("group"))
        own = F.col("group") == F.col("_own")
        groups = rows.select("bwt", "group", F.when(own, F.col("before")).otherwise(F.col("before") + F.col("n")).alias("before"), F.when(own, F.col("n")).otherwise(0).alias("n"), F.when(own, F.col("counts")).alias("counts"))
        totals = held.groupBy("bwt").agg(F.sum("n").alias("n"))
        totals = totals.withColumn("smaller", F.coalesce(F.sum("n").over(Window.orderBy("bwt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return Ranks(blocks, keep(settle(groups, "groups")), keep(settle(totals, "totals")), small, group)


def access(ranks: Ranks, places: DataFrame) -> DataFrame:
    """`places` with the symbol `bwt` at each `pos`; null outside the transform. Only blocks that are asked for are met."""
    rows = places.withColumn("block", F.floor(F.col("pos") / ranks.small)).join(ranks.blocks, "block", "left")
    symbol = F.substring("text", (F.col("pos") % ranks.small + 1).cast("int"), F.lit(1))
    return rows.withColumn("bwt", F.when(symbol != "", symbol)).drop("block", "text")


def rank(ranks: Ranks, asked: DataFrame) -> DataFrame:
    """`asked` with `rank`: how often the symbol `bwt` occurs before `pos`, from 0 to the transform's length. A symbol that never occurs has rank 0."""
    rows = asked.withColumn("block", F.floor(F.col("pos") / ranks.small)).withColumn("group", F.floor(F.col("block") / ranks.group))
    rows = rows.join(ranks.groups.drop("n"), ["bwt", "group"], "left")
    inside = F.aggregate(F.coalesce("counts", F.array()), F.lit(0).cast("long"), lambda x, c: x + F.when(c["block"] < F.col("block"), c["n"]).otherwise(0))
    rows = rows.withColumn("before", F.coalesce(F.col("before") + inside, F.lit(0))).drop("counts", "group")
    rows = rows.join(ranks.blocks, "block", "left")
    lead = F.left("text", (F.col("pos") % ranks.small).cast("int"))
    own = F.length(lead) - F.length(F.replace(lead, F.col("bwt"), F.lit("")))
    return rows.withColumn("rank", F.col("before") + F.coalesce(own, F.lit(0))).drop("block", "text", "before")


def every(ranks: Ranks) -> DataFrame:
    """(bwt, k) of each occurrence of each symbol, made in as many tasks as the session shuffles to."""
    top = F.col("n") - 1
    parts = ranks.totals.select("bwt", top.alias("_top"), F.explode(F.sequence(F.lit(0).cast("long"), top, F.lit(BLOCK).cast("long"))).alias("_from"))
    parts = parts.repartition(partitions(parts.sparkSession), "bwt", "_from")
    return parts.select("bwt", F.explode(F.sequence("_from", F.least(F.col("_from") + BLOCK - 1, F.col("_top")))).alias("k"))


def select(ranks: Ranks, asked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`asked` with `pos`: where the symbol `bwt` occurs for the `k`-th time, from 0; null if it occurs less often. Blocks are entered under each bucket of occurrences that they have some of, at most `bucket` blocks in one, so an occurrence meets few blocks and walks no list of counts."""
    held = ranks.groups.filter("n > 0").select("bwt", "group", "before", F.explode("counts").alias("_c")).select("bwt", "group", "before", "_c.block", "_c.n")
    first = F.col("before") + F.sum("n").over(Window.partitionBy("bwt", "group").orderBy("block")) - F.col("n")
    held = held.withColumn("first", first).select("bwt", "block", "n", "first")
    held = held.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("first") + F.col("n") - 1) / bucket))))
    asked = asked.withColumn("_id", F.monotonically_increasing_id())
    asked = settle(asked, "asked")
    met = asked.select("_id", "bwt", "k", F.floor(F.col("k") / bucket).alias("_bucket")).join(held, ["bwt", "_bucket"])
    met = met.filter((F.col("first") <= F.col("k")) & (F.col("k") < F.col("first") + F.col("n")))
    met = met.select("_id", "bwt", (F.col("k") - F.col("first")).alias("left"), "block").join(ranks.blocks, "block")
    place = F.length(F.expr("substring_index(text, bwt, CAST(left AS INT) + 1)"))
    found = met.select("_id", (F.col("block") * ranks.small + place).alias("pos"))
    return asked.join(found, "_id", "left").drop("_id")


def lf(ranks: Ranks, places: DataFrame) -> DataFrame:
    """`places` (pos, ...) with the symbol `bwt` and `lf`, where the rotation that starts with it stands: a step of the mapping for a few places, without numbering all rows."""
    rows = rank(ranks, access(ranks, places))
    return rows.join(ranks.totals.select("bwt", "smaller"), "bwt", "left").withColumn("lf", F.col("rank") + F.col("smaller")).drop("rank", "smaller")
