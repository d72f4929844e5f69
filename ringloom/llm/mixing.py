"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import fresh, settle, unit_hash, words

#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes; the most that one source may be repeated.
TOTAL, MOST = 1.5, 2.0
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """From (source, size) rows, one row per source: source, source_size, target.

    Partial sums come first, so the windows below see a row per source, not per document. Sources are ordered by code point, null last, and dealt `weights` in turn. A source's target is its weight's share of `total` x all sizes, but `most` x its own size at most: with the sources in order of cap over weight, the capped ones are a prefix, and the share per weight beyond that prefix is what is left of the total over the weights left. A source of size 0 has target 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % F.lit(len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("left", left).withColumn("weights_left", weights_left)
    # the first source in that order whose share doesn't pass its cap sets the share for all from there on
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights_left")
    by = by.withColumn("fits", fits)
    first = F.first(F.when(F.col("fits"), F.struct("left", "weights_left")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    by = by.withColumn("share", first)
    shared = F.col("weight") * F.col("share.left") / F.col("share.weights_left")
    return by.select("source", "source_size", F.coalesce(F.least(shared, F.col("cap")), F.col("cap")).alias("target"))


def plan(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """How often each document is taken: (doc_id, source, size, source_size, target, copies), a row for each row of `docs`.

    A source's rate is target / source_size; each of its documents is taken floor(rate) times and once more with the rate's fraction as probability, decided by a hash of seed and doc_id. So reruns agree, and rows that repeat a doc_id are decided alike. A null text has size 0, a null doc_id hashes as an empty one, null sources are one source, an empty table gives no rows; other columns are not read.
    """
    # the texts are read once: sums and decisions both come from the small table of sizes
    sized = settle(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    return _with_copies(sized, targets(sized, weights, total, most), seed)


def _with_copies(rows: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    goals = goals.withColumnRenamed("source", "goal_source")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate)
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra.cast("long"))


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """The mixture itself: the rows of `docs`, each as often as plan() takes it, with the columns of `docs` whatever their names."""
    row = fresh(docs, "row")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    # written, so that its size is known and the texts need not be shuffled to meet it
    goals = settle(targets(sized, weights, total, most), "goals")
    rows = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias(row))
    taken = _with_copies(rows, goals, seed).filter("copies > 0")
    return taken.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{row}.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
         row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS nth
  FROM by_source),
cut AS (
  SELECT nth, "left", weights_left FROM ranked WHERE "left" * weight <= cap * weights_left ORDER BY nth LIMIT 1),
goals AS (
  SELECT r.source, r.source_size,
         CASE WHEN c.nth IS NULL OR r.nth < c.nth THEN r.cap ELSE least(r.weight * c."left" / c.weights_left, r.cap) END AS target
  FROM ranked r LEFT JOIN cut c ON true),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
