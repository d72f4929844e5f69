"""Quality rules with adaptive thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import fresh, let, settle, words

SYMBOLS = "#*$%&|<>"
#: Rules that hold for all documents: fewest words, and most words in repeated windows in 100.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: The ratios that get thresholds, in 10,000ths: a count, what it is a share of, and by how much the least event raises the count: a symbol, a repeated line, a 3-word window that comes again. None raises the mean length of words.
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 1),
    "repeated": ("n_repeat_words", "n_words", 6),
    "dup_lines": ("n_dup_lines", "n_words", 1),
    "word_length": ("word_chars", "n_words", 0),
}
#: Sizes of which groups have medians.
SIZES = ("word_chars", "n_words")
#: A ratio is too high above `q(HIGH) + SPREADS x (q(HIGH) - q(MIDDLE))` of its group and what SPREADS events make of a document, of the group's median size or its own if that is less.
HIGH, MIDDLE, SPREADS = 80, 50, 8
#: The limit of a (lang, source) is blended with that of its language, and that with the limit of all, which weigh as much as so many documents.
WEIGHT = 100


def measures(text: Column) -> Column:
    """A struct of counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text counts as an empty one.

    Repeated windows are found inside the row: the 64-bit hashes of all 3-word windows are sorted with their places, equal neighbours mark three places each, and the distinct places are counted. Texts whose windows are all different skip the sort.
    """
    text = F.coalesce(text, F.lit(""))

    def repeated(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

        def places(h: Column) -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            marked = let(
                pairs,
                lambda s: F.filter(
                    s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
                ),
            )
            covered = F.flatten(F.transform(marked, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(covered))

        found = let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(found)

    bare = text
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(m: str) -> Column:
    c = F.col(m)
    return (c["n_words"] < FEWEST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


#: Leading bits that the counts of a sketch's bucket agree in.
BITS = 8


def bucket(v: Column) -> Column:
    """The sketch's bucket of a count: counts below 2^BITS have their own, larger ones share one with all that agree in their BITS leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return shift.cast("long") * (1 << BITS) + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest count in a bucket."""
    shift = F.floor((b - (1 << BITS - 1)) / (1 << BITS)).cast("long")
    shift = F.when(b < 1 << BITS, F.lit(0)).otherwise(shift)
    return ((b - shift * (1 << BITS) + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def ratio(m: str, name: str) -> Column:
    count, of, _ = RATIOS[name]
    return F.floor(F.col(m)[count] * 10000 / F.col(m)[of]).cast("long")


def sketches(measured: DataFrame, m: str) -> DataFrame:
    """Quantile sketches of each ratio and size for each (lang, source), as rows: lang, source, name, bucket, n.

    A sketch is a histogram over logarithmic buckets, at most a 128th of the value wide. Sketches are merged by adding their rows, so Spark builds them in part on each task, and a source with a third of all rows sends a row a bucket and task, some thousands at most. Documents that failed the base rules, and those without words, are left out.
    """
    values = {k: ratio(m, k) for k in RATIOS} | {k: F.col(m)[k] for k in SIZES}
    rows = measured.filter(~base_failed(m)).select("lang", "source", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("name", "v"))
    return rows.groupBy("lang", "source", "name", bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """The limit of each ratio and the median of each size for each (lang, source): lang, source, and a column for each of these.

    Sketches are merged up to those of languages and of all. What is taken from a group's sketch, a limit or the median of a size, is the mean of its own, weighed by its documents, and that of its language, weighed by `weight`; the language's is blended with that of all in the same way, so no verdict turns on a group's size as such.
    """
    levels = []
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "name")
        run = F.sum("n").over(w.orderBy("bucket"))
        placed = merged.withColumn("total", F.sum("n").over(w)).withColumn("run", run)
        q = {
            p: F.min(F.when(F.col("run") * 100 >= F.col("total") * p, bucket_top(F.col("bucket")))) for p in (HIGH, MIDDLE)
        }
        limit = F.when(F.col("name").isin(*SIZES), q[MIDDLE]).otherwise(q[HIGH] * (1 + SPREADS) - q[MIDDLE] * SPREADS)
        levels.append(
            placed.groupBy(*keys, "name").agg(F.max("total").alias(f"total{depth}"), limit.alias(f"limit{depth}"))
        )
    fine, mid, top = levels
    mid = mid.withColumnRenamed("lang", "mid_lang")
    joined = fine.join(mid, ["name"]).filter(F.col("lang").eqNullSafe(F.col("mid_lang"))).join(top, "name")
    blended = lambda total, own, above: (F.col(total) * F.col(own) + F.lit(float(weight)) * above) / (F.col(total) + F.lit(float(weight)))
    joined = joined.withColumn("limit", blended("total0", "limit0", blended("total1", "limit1", F.col("limit2"))))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("name") == k, F.col("limit"))).alias(f"limit_{k}") for k in (*RATIOS, *SIZES)])


def judge(measured: DataFrame, m: str, limits: DataFrame) -> DataFrame:
    """`measured` with the column kept: passed the base rules, and no ratio above its group's limit and the room for SPREADS events. Where a symbol is rare, its quantiles are 0, and the room, from the sketch of sizes, decides."""
    limits = limits.withColumnRenamed("lang", "limit_lang").withColumnRenamed("source", "limit_source")
    same = F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source"))
    high = F.lit(False)
    for k, (_, of, step) in RATIOS.items():
        room = F.lit(float(SPREADS * step * 10000)) / F.least(F.col(m)[of].cast("double"), F.col(f"limit_{of}"))
        high = high | F.coalesce(ratio(m, k) > F.col(f"limit_{k}") + room, F.lit(False))
    keep = fresh(measured, "kept")
    joined = measured.join(limits, same, "left").withColumn(keep, ~base_failed(m) & ~high)
    return joined.drop("limit_lang", "limit_source", *[f"limit_{k}" for k in (*RATIOS, *SIZES)])


def verdicts(docs: DataFrame, columns=("doc_id", "lang", "source")) -> DataFrame:
    """`columns` of each row of `docs` with its struct of measures and its verdict, in the columns measures and kept.

    The texts are read and measured once; thresholds and verdicts come from the written measures. Null languages and null sources are groups of their own; a null text counts as an empty one and fails; rows that repeat are judged alike; an empty table gives no rows; a column of `docs` that isn't named in `columns` is not read.
    """
    measured = settle(docs.select(*columns, measures(F.col("text")).alias("measures")), "measures")
    # the limits are written, so that their size is known and the rows need not be shuffled to meet them
    return judge(measured, "measures", settle(thresholds(sketches(measured, "measures")), "limits"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs` whatever their names."""
    row = fresh(docs, "row")
    held = docs.select("lang", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias(row))
    return verdicts(held, ("lang", "source", row)).filter("kept").select(f"{row}.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = verdicts(docs)
    return out.select(
        "doc_id", *[F.col("measures")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed("measures").alias("base_failed"), "kept",
    )


def _limits_sql() -> str:
    levels = []
    for i, keys in enumerate((["lang", "source", "name"], ["lang", "name"], ["name"])):
        k = ", ".join(keys)
        levels.append(f"""
g{i} AS (SELECT {k}, b, sum(n)::BIGINT AS n FROM sketch GROUP BY {k}, b),
r{i} AS (SELECT *, sum(n) OVER (PARTITION BY {k}) AS total, sum(n) OVER (PARTITION BY {k} ORDER BY b) AS run,
                CASE WHEN b < {1 << BITS} THEN b ELSE ((b - (b - {1 << BITS - 1}) // {1 << BITS} * {1 << BITS} + 1) << ((b - {1 << BITS - 1}) // {1 << BITS})) - 1 END AS top FROM g{i}),
q{i} AS (SELECT {k}, max(total) AS total, min(top) FILTER (run * 100 >= total * {HIGH}) AS high, min(top) FILTER (run * 100 >= total * {MIDDLE}) AS middle FROM r{i} GROUP BY {k}),
l{i} AS (SELECT {k}, total, CASE WHEN name IN {SIZES} THEN middle ELSE high * {1 + SPREADS} - middle * {SPREADS} END AS top FROM q{i})""")
    return ",".join(levels)


_GAP_SQL = r"[\x20\x09-\x0D]"
_RATIO_SQL = ", ".join(f"floor({count} * 10000 / {of})" for count, of, _ in RATIOS.values())
_ROOM_SQL = " ".join(f"WHEN '{k}' THEN {float(SPREADS * step * 10000)}::DOUBLE / least(v.{of}::DOUBLE, s.{of})" for k, (_, of, step) in RATIOS.items())
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_GAP_SQL}+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, n_words, word_chars, unnest({[*RATIOS, *SIZES]}) AS name, unnest([{_RATIO_SQL}, {', '.join(SIZES)}])::BIGINT AS v FROM f WHERE NOT base_failed),
sketch AS (SELECT lang, source, name, greatest(length(bin(v)) - {BITS}, 0) * {1 << BITS} + (v >> greatest(length(bin(v)) - {BITS}, 0)::INT) AS b, count(*) AS n FROM v GROUP BY ALL),
{_limits_sql().strip()},
blend AS (SELECT a.lang, a.source, a.name,
               (a.total::DOUBLE * a.top::DOUBLE + {float(WEIGHT)} * ((b.total::DOUBLE * b.top::DOUBLE + {float(WEIGHT)} * c.top::DOUBLE) / (b.total::DOUBLE + {float(WEIGHT)}))) / (a.total::DOUBLE + {float(WEIGHT)}) AS top
        FROM l0 a JOIN l1 b ON a.name = b.name AND a.lang IS NOT DISTINCT FROM b.lang JOIN l2 c ON a.name = c.name),
s AS (SELECT lang, source, max(top) FILTER (name = 'word_chars') AS word_chars, max(top) FILTER (name = 'n_words') AS n_words FROM blend GROUP BY lang, source),
high AS (SELECT DISTINCT v.doc_id FROM v JOIN blend b ON v.name = b.name AND v.lang IS NOT DISTINCT FROM b.lang AND v.source IS NOT DISTINCT FROM b.source
         JOIN s ON v.lang IS NOT DISTINCT FROM s.lang AND v.source IS NOT DISTINCT FROM s.source WHERE v.v > b.top + CASE v.name {_ROOM_SQL} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM high) AS kept FROM f
"""
