"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringloom.llm.common import fresh, let

#: Words are runs of letters and digits of ASCII and of anything outside ASCII.
GAP_CHARS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a gram; a shorter template is one gram.
WIDTH = 3
#: Diagonals that lie so many words apart at most are merged: so many words may be added or left out.
BAND = 8
#: A span must meet so many hundredths of the template's words, in order, and of its own.
LEAST_COVER = 75

#: (label, whether all places are told, text) of each template. The phrases, and the opening notices that these licenses ask for.
TEMPLATES = [
    ("cc-by", True, "cc by"),
    ("gpl", True, "general public license"),
    ("reserved", True, "all rights reserved"),
    ("cc-by-nc", False, "cc by nc"),
    ("cc-by-sa", False, "cc by sa"),
    ("cc-by", False, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", False, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl", False, "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl", False,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("apache-2.0", False, "Apache License, Version 2.0"),
    (
        "apache-2.0", False,
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    ("mit", False, "Released under the MIT License."),
    ("mit", False, "Licensed under the MIT License."),
    (
        "mit", False,
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    (
        "bsd", False,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("mpl-2.0", False, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def terms(text: Column) -> Column:
    """The words of a text in order, with A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP_CHARS), "")


def _grams(w: Column, width: int) -> Column:
    """The words from each place on, `width` at most."""
    return F.transform(w, lambda x, i: F.struct(i.alias("pos"), F.slice(w, i + 1, width).alias("gram")))


def _hash(gram: Column, k: int) -> Column:
    """The hash of a gram's first k words; null if it has fewer."""
    return F.when(F.size(gram) >= k, F.xxhash64(*[F.get(gram, F.lit(i)) for i in range(k)]))


def template_grams(spark: SparkSession, templates=TEMPLATES, width: int = WIDTH) -> DataFrame:
    """A row for each gram of each template, of `width` words or all that it has, and one, of template -1, for what is no gram: hash, template, label, place (whether all places are told), size (words), k, at (where the gram stands), words."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("place"), terms(F.lit(c)).alias("w")) for i, (a, b, c) in enumerate(templates)])
    each = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("size", F.size("w")).filter("size > 0")
    each = each.withColumn("k", F.least("size", F.lit(width)))
    each = each.select("*", F.explode(_grams(F.col("w"), width)).alias("g")).filter(F.size("g.gram") >= F.col("k"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, _hash(F.col("g.gram"), k)) for k in range(1, width + 1)])
    grams = each.select(hashed.alias("hash"), "template", "label", "place", "size", "k", F.col("g.pos").alias("at"), F.slice("g.gram", F.lit(1), F.col("k")).alias("words"))
    blank = spark.range(1).select(
        F.lit(0).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("place"), F.lit(0).alias("size"), F.lit(0).alias("k"), F.lit(0).alias("at"),
        F.array().cast("array<string>").alias("words"),
    )
    return grams.union(blank)


def _votes(docs: DataFrame, given: Column, templates, width: int) -> DataFrame:
    """The grams of `docs` that meet a template's: row, template, label, place, size, k, at, pos; and a row for each of `docs`, of template -1, with `given` and n_words."""
    spark = docs.sparkSession
    sizes = sorted({min(width, len(t.split())) for t in (_plain(t) for *_, t in templates) if t})
    kind = docs.select(given.alias("g")).schema["g"].dataType
    blank = F.lit(None).cast(kind)

    def told(w: Column) -> Column:
        head = F.struct(F.lit(-1).alias("pos"), F.array().cast("array<string>").alias("gram"), F.size(w).cast("long").alias("n_words"), F.col("given"))
        rest = F.transform(w, lambda x, i: F.struct(i.alias("pos"), F.slice(w, i + 1, max(sizes, default=1)).alias("gram"), F.lit(None).cast("long").alias("n_words"), blank.alias("given")))
        return F.concat(F.array(head), rest)

    # what is carried along stands once for a document, not at every place
    rows = docs.select(F.monotonically_increasing_id().alias("row"), given.alias("given"), docs["text"])
    each = rows.select("row", F.explode(let(terms(F.col("text")), told)).alias("g"))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _hash(F.col("g.gram"), k).alias("hash")) for k in sizes])
    keys = F.when(F.col("g.pos") < 0, F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("hash")))).otherwise(keys)
    each = each.select("row", "g", F.explode(keys).alias("key")).select("row", "g.*", F.col("key.k").alias("own_k"), F.col("key.hash").alias("own_hash"))
    # the templates' grams are a parameter of some hundred rows, whatever the documents
    met = each.join(F.broadcast(template_grams(spark, templates, width)), (F.col("own_k") == F.col("k")) & (F.col("own_hash") == F.col("hash")))
    met = met.filter((F.col("template") < 0) | (F.slice("gram", F.lit(1), F.col("k")) == F.col("words")))
    return met.select("row", "template", "label", "place", "size", "k", "at", "pos", "n_words", "given")


def _plain(text: str) -> str:
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).strip()


def _in_order(votes: Column, k: Column) -> Column:
    """How many words of a template are met in order by `votes`, (pos, at) sorted."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("met"))

    def step(s: Column, v: Column) -> Column:
        ahead = F.struct(v["at"].alias("at"), (v["at"] + k).alias("end"), (s["met"] + v["at"] + k - F.greatest(s["end"], v["at"])).alias("met"))
        return F.when(v["at"] > s["at"], ahead).otherwise(s)

    return F.aggregate(votes, start, step, lambda s: s["met"])


def spans(docs: DataFrame, columns=("doc_id",), templates=TEMPLATES, width: int = WIDTH, band: int = BAND, least: int = LEAST_COVER) -> DataFrame:
    """`columns` of each row of `docs`, n_words, and its `spans`: array of (start, end, label, place, met, size), by start: word places, end exclusive, whether it is a place of a phrase, and how many of the template's `size` words it meets.

    All rolling grams of `width` words are joined with the templates' by hash, and compared word by word. A gram votes for the diagonal pos - at; a diagonal holds a vote for each of a template's places at most. Each diagonal is merged with those up to `band` words further on, and the span that these votes cover is verified: `least` hundredths of the template's words must be met in order, and of the span's own words. Of bands that lie within `band` words of each other, the one that meets most words counts. A span inside one that another template has at greater length, or that meets more words there, is left out. Phrases that are told wherever they stand must be met whole and are a span each.

    Only grams that meet a template are shuffled, by the number of the document's row, with one row for the document itself. A null text counts as an empty one and has no spans; rows that repeat have the same spans; nulls stay what they are; an empty table gives no rows; templates without words are passed over. `docs` must have text, and `columns` may not hold n_words or spans: that is an error; other columns may have any names.
    """
    if taken := {c.lower() for c in columns} & {"n_words", "spans"}:
        raise ValueError(f"columns may not hold {', '.join(sorted(taken))}")
    given = F.struct(*[docs[c] for c in columns])
    votes = _votes(docs, given, templates, width).repartition("row")
    diagonal = F.col("pos") - F.col("at")
    lines = votes.groupBy("row", "template", diagonal.alias("d")).agg(
        *[F.first(c).alias(c) for c in ("label", "place", "size", "k", "n_words", "given")], F.sort_array(F.collect_set(F.struct("pos", "at"))).alias("votes")
    )
    by = Window.partitionBy("row", "template").orderBy("d")
    merged = F.when(F.col("place"), F.col("votes")).otherwise(F.sort_array(F.flatten(F.collect_list("votes").over(by.rangeBetween(0, band)))))
    found = lines.withColumn("votes", merged).withColumn("met", _in_order(F.col("votes"), F.col("k")))
    found = found.withColumn("start", F.get("votes", F.lit(0))["pos"]).withColumn("end", F.array_max(F.transform("votes", lambda v: v["pos"])) + F.col("k"))
    best = F.max(F.struct("met", (-F.col("d")).alias("d"))).over(by.rangeBetween(-band, band))
    good = (F.col("met") * 100 >= F.col("size") * least) & (F.col("met") * 100 >= (F.col("end") - F.col("start")) * least)
    found = found.withColumn("kept", (F.col("template") >= 0) & F.when(F.col("place"), F.col("met") == F.col("size")).otherwise(good & (best["d"] == -F.col("d"))))
    inside = Window.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("met").desc(), "template").rowsBetween(Window.unboundedPreceding, -1)
    around = F.max(F.when(F.col("kept") & ~F.col("place"), F.struct("end", "met"))).over(inside)
    found = found.withColumn("kept", F.col("kept") & (F.col("place") | ~F.coalesce(around > F.struct("end", "met"), F.lit(False))))
    span = F.when(F.col("kept"), F.struct("start", "end", "label", "place", "met", "size"))
    out = found.groupBy("row").agg(F.first("given", ignorenulls=True).alias("given"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select("given.*", "n_words", "spans")


def scanned(docs: DataFrame, columns=("doc_id",), **how) -> DataFrame:
    """`columns` of each row of `docs`; n_words; n_base, first_word and last_word, the places of phrases; base_labels and labels, distinct and sorted, joined by commas; and score, the largest share of a template's words that a span meets, 0 without spans. Cases as for spans()."""
    found = spans(docs, columns, **how)
    name = fresh(found, "places")
    held = found.withColumn(name, F.filter("spans", lambda s: s["place"]))
    labels = lambda s: F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))), ",")
    start = F.transform(name, lambda s: s["start"].cast("long"))
    return held.select(
        *columns, "n_words", F.size(name).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels(name).alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["met"] / s["size"])), F.lit(0.0)).alias("score"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _templates_sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    return ", ".join(f"({i}, '{a}', {b}, '{quoted(c)}')" for i, (a, b, c) in enumerate(TEMPLATES))


_TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents),
t AS (SELECT template, label, place, w, len(w)::INT AS size, least(len(w), {WIDTH})::INT AS k FROM (SELECT template, label, place, {_TERMS_SQL} AS w FROM (VALUES {_templates_sql()}) v(template, label, place, text))),
tg AS (SELECT template, label, place, size, k, w[p + 1 : p + k] AS g, p::INT AS o FROM (SELECT *, unnest(range(len(w) - k + 1)) AS p FROM t)),
dg AS (SELECT r, p::INT AS pos, w[p + 1 : p + {WIDTH}] AS g FROM (SELECT r, w, unnest(range(len(w))) AS p FROM d)),
votes AS (SELECT r, template, label, place, size, k, o, pos, pos - o AS d
          FROM (SELECT r, pos, n, g[1 : n] AS g FROM dg, (SELECT DISTINCT k AS n FROM tg) WHERE len(g) >= n) x JOIN tg ON x.g = tg.g AND x.n = tg.k),
lines AS (SELECT r, template, label, place, size, k, d, list([pos, o]) AS v FROM votes GROUP BY ALL),
merged AS (SELECT *, CASE WHEN place THEN v ELSE list_sort(flatten(list(v) OVER (PARTITION BY r, template ORDER BY d RANGE BETWEEN CURRENT ROW AND {BAND} FOLLOWING))) END AS vs FROM lines),
met AS (SELECT *, list_reduce(list_prepend([-1, 0, 0], list_transform(vs, lambda v: [v[2], k, 0])),
                    lambda s, v: CASE WHEN v[1] > s[1] THEN [v[1], v[1] + v[2], s[3] + v[1] + v[2] - greatest(s[2], v[1])] ELSE s END)[3] AS met,
               vs[1][1] AS start, list_max(list_transform(vs, lambda v: v[1])) + k AS stop FROM merged),
best AS (SELECT *, max({{'met': met, 'd': -d}}) OVER (PARTITION BY r, template ORDER BY d RANGE BETWEEN {BAND} PRECEDING AND {BAND} FOLLOWING) AS top FROM met),
good AS (SELECT * FROM best WHERE CASE WHEN place THEN met = size ELSE met * 100 >= size * {LEAST_COVER} AND met * 100 >= (stop - start) * {LEAST_COVER} AND top.d = -d END),
inside AS (SELECT *, max({{'stop': stop, 'met': met}}) FILTER (NOT place) OVER (PARTITION BY r ORDER BY start, stop DESC, met DESC, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS around FROM good),
found AS (SELECT * FROM inside WHERE place OR around IS NULL OR NOT around > {{'stop': stop, 'met': met}}),
told AS (SELECT r, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(met::DOUBLE / size) AS score
         FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN told USING (r)
"""
