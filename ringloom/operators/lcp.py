"""How far neighbours in the order of the dictionary's suffixes agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators.circular_sa import WIDTH, characters
from ringloom.operators.durable import scratch, settle
from ringloom.operators.merge import placed_suffixes
from ringloom.operators.ranking import row_numbers


def _named(windows: DataFrame, keys: list[str], h: int) -> DataFrame:
    """(seq_id, idx, left, name) of the windows of h symbols that stand at several places: equal ones share a name. What stands at one place only agrees with nothing and goes."""
    names = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    names = settle(names.withColumn("name", F.monotonically_increasing_id()), "names")
    return settle(windows.join(names, keys).select("seq_id", "idx", "left", "name"), f"windows{h}")


def common_prefixes(pairs: DataFrame, chars: DataFrame) -> DataFrame:
    """(*pairs, lcp): how many symbols two suffixes have in common, from (a_id, a_at, b_id, b_at) and the settled characters(around=False), whose windows are WIDTH symbols long.

    Windows of WIDTH, 2 WIDTH, 4 WIDTH ... symbols get names, each from two of the size before, as long as any stands at several places; the rows of the others leave. Then from the longest down, pairs whose next windows bear the same name move on by its length, and the symbols of the last windows are compared one by one. So there are twice as many rounds as the longest repeat has binary digits, and each compares a pair by two numbers.
    """
    with scratch(chars.sparkSession) as keep:
        full = chars.withColumn("left", F.col("k") - F.col("idx")).filter(F.col("left") >= WIDTH)
        levels, h = [_named(full.select("seq_id", "idx", "left", "window"), ["window"], WIDTH)], WIDTH
        while levels[-1].limit(1).count():
            now = levels[-1]
            ahead = now.select("seq_id", (F.col("idx") - h).alias("idx"), F.col("name").alias("second"))
            twice = now.filter(F.col("left") >= 2 * h).join(ahead, ["seq_id", "idx"])
            levels.append(_named(twice.select("seq_id", "idx", "left", F.col("name").alias("first"), "second"), ["first", "second"], 2 * h))
            h *= 2
        now = settle(pairs.withColumn("lcp", F.lit(0).cast("long")), "pairs")
        for level in reversed(levels[:-1]):
            h //= 2
            for side in "ab":
                own = level.select(F.col("seq_id").alias(f"{side}_id"), F.col("idx").alias("_at"), F.col("name").alias(f"_{side}"))
                now = now.withColumn("_at", F.col(f"{side}_at") + F.col("lcp")).join(own, [f"{side}_id", "_at"], "left").drop("_at")
            same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
            now = settle(now.withColumn("lcp", F.col("lcp") + F.when(same, h).otherwise(0)).drop("_a", "_b"), "pairs")
        for side in "ab":
            own = chars.select(F.col("seq_id").alias(f"{side}_id"), F.col("idx").alias("_at"), F.col("window").alias(f"_{side}"))
            now = now.withColumn("_at", F.col(f"{side}_at") + F.col("lcp")).join(own, [f"{side}_id", "_at"], "left").drop("_at")
        agree = lambda j: (F.left("_a", F.lit(j)) == F.left("_b", F.lit(j))) & (F.length("_a") >= j) & (F.length("_b") >= j)
        more = reduce(lambda x, y: x + y, [F.when(agree(j), 1).otherwise(0) for j in range(1, WIDTH + 1)])
        return keep(settle(now.select(*pairs.columns, (F.col("lcp") + more).alias("lcp")), "prefixes"))


def dict_lcp(words: DataFrame, w: int) -> DataFrame:
    """(pos, rank, off, suffix_len, lcp): the suffixes of the phrases that are at least w long and not the whole, in order, equal ones by phrase, each with how many symbols it has in common with the one before; 0 for the first. Equal suffixes are known by their group; only one of each group is compared with one of the group before."""
    with scratch(words.sparkSession) as keep:
        chars = settle(characters(words.select(F.col("rank").alias("seq_id"), F.col("phrase").alias("seq")), around=False), "phrases")
        suffixes = settle(placed_suffixes(words, w), "suffixes")
        heads = suffixes.groupBy("group").agg(F.min(F.struct("rank", "off")).alias("head"))
        heads = settle(row_numbers(heads.select("group", "head.rank", "head.off"), ["group"], "nth"), "groups")
        before = heads.select((F.col("nth") + 1).alias("nth"), F.col("rank").alias("a_id"), F.col("off").alias("a_at"))
        pairs = heads.join(before, "nth").select("a_id", "a_at", F.col("rank").alias("b_id"), F.col("off").alias("b_at"))
        found = common_prefixes(pairs, chars).select(F.col("b_id").alias("rank"), F.col("b_at").alias("off"), "lcp")
        first = heads.filter("nth = 0").select("rank", "off", F.lit(0).cast("long").alias("lcp"))
        rows = suffixes.select("group", "rank", "off", "suffix_len").join(found.union(first), ["rank", "off"], "left")
        # what isn't the first of its group is equal to the one before
        rows = rows.withColumn("lcp", F.coalesce("lcp", "suffix_len"))
        return keep(row_numbers(rows, ["group", "rank", "off"], "pos")).select("pos", "rank", "off", "suffix_len", "lcp")
