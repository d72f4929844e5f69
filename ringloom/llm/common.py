"""What several operators share: durable intermediate tables, fresh names, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators.durable import drop_table, new_path, partitions, settle, shared_dir  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters; words are parted by runs of those.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null for null."""
    return F.array_remove(F.split(text, GAP), "")


def let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes of an Arrow batch on its way to Python, so that memory doesn't follow the length of texts.
BATCH_BYTES = 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    digits = int("".join(c for c in now if c.isdigit()) or 0)
    size = digits * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to `name` that `df` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of ``seed:key``; a null key counts as an empty one."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected `edges` (a long, b long): (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a partial-then-final minimum and a join back, so that a hub with any number of neighbours is never gathered in one row. Nodes without an edge don't appear; loops and repeated edges don't matter; an empty input gives an empty result.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        after = settle(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    # every edge now leads straight to the smallest node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
