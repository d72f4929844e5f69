"""URL filters: a temporal join of captures with dated lists, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import settle

#: The fewest days in a bucket of the join, and the most buckets that a closed interval is entered in: buckets get wider where captures span more days.
LEAST_WIDTH, MOST_BUCKETS = 32, 64


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; null without one."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), "[.]$", "")
    return F.when(host != "", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def domains_of(host: Column) -> Column:
    """The host and the domains above it, down to two labels: a.b.c.d, b.c.d, c.d."""
    labels = F.split(host, "[.]")
    depth = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(list, domain, start, stop): when each entry was active, from the day of an `add` to that of the next event of its list and domain, or without end (null); of events of one day, the `remove` counts."""
    w = Window.partitionBy("list", "domain").orderBy("day", "action")
    spans = events.filter("list IS NOT NULL AND domain IS NOT NULL AND day IS NOT NULL").withColumn("stop", F.lead("day").over(w))
    return spans.filter("action = 'add' AND (stop IS NULL OR day < stop)").select("list", "domain", F.col("day").alias("start"), "stop")


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, host, day, n_active, matched, verdict) for each row of `captures` (page_id, url, day), against the entries of `events` (list, domain, day, action) that were active on its day. Days are whole numbers of any size: days since some date, yyyymmdd or seconds.

    Lists are `block` and `allow`. An entry matches its domain and all below it; the longest active match decides, and of equal ones `allow`. n_active counts the active matches, matched is the deciding domain, verdict `drop` or `keep`.

    Captures are first reduced to distinct (host, day). An open interval, of which a list has one a domain at most, is one row and meets each of a capture's domains. Closed ones are cut to the days that captures have and entered in the buckets that they touch; each domain of a capture looks in the bucket of its day, an equi-join with a range check, so a domain with many entries or a host with a third of all captures is spread over days. Verdicts then go back to the captures by (host, day).

    A capture without host or day matches nothing and is kept; a null page_id stays; rows that repeat are told alike; repeated events count once; no events, or no captures, are fine; other columns are not read.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("day").cast("long").alias("day"))
    asked = settle(rows.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct(), "asked")
    first, last = asked.agg(F.coalesce(F.min("day"), F.lit(0)), F.coalesce(F.max("day"), F.lit(0))).first()
    width = max(LEAST_WIDTH, -(-(last - first + 1) // (MOST_BUCKETS - 1)))
    bucket = lambda day: F.floor((day - F.lit(first)) / F.lit(width)).cast("long")
    spans = intervals(events.select("list", "domain", F.col("day").cast("long").alias("day"), "action").distinct())
    spans = spans.filter(F.col("start") <= last).filter(F.col("stop").isNull() | (F.col("stop") > first))
    touched = F.sequence(bucket(F.greatest("start", F.lit(first))), bucket(F.least(F.col("stop") - 1, F.lit(last))))
    entered = spans.select("list", "domain", "start", "stop", F.explode(F.when(F.col("stop").isNull(), F.array(F.lit(OPEN).cast("long"))).otherwise(touched)).alias("bucket"))
    domains = asked.select("host", "day", F.explode(domains_of(F.col("host"))).alias("domain"), F.array(F.lit(OPEN).cast("long"), bucket(F.col("day"))).alias("buckets"))
    # merge joins: hosts and days take little room in files, and far more where they would be broadcast
    active = domains.select("host", "day", "domain", F.explode("buckets").alias("bucket")).join(entered.hint("merge"), ["domain", "bucket"])
    active = active.filter("start <= day AND (stop IS NULL OR day < stop)")
    best = F.max(F.struct(F.length("domain").alias("length"), (F.col("list") == "allow").alias("allowed"), F.col("domain").alias("domain")))
    told = active.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select(
        F.col("host").alias("told_host"), F.col("day").alias("told_day"), "n", "best"
    )
    out = rows.join(told.hint("merge"), (F.col("host") == F.col("told_host")) & (F.col("day") == F.col("told_day")), "left")
    return out.select(
        "page_id", "host", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("best.domain").alias("matched"),
        F.when(F.col("best").isNotNull() & ~F.col("best.allowed"), "drop").otherwise("keep").alias("verdict"),
    )


#: The bucket of intervals without end.
OPEN = -1


def _digits(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, n), 16, 10).cast("long")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated events of a block and an allow list over the domains of `pages`, made from hashes of their names: the tables have no lists of their own. A fourth of the domains is blocked at some day and released later, half of these blocked again; a sixteenth is allowed from some day on."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).distinct()
    h = lambda start: _digits(F.col("domain"), start, 4)
    first, gone, again = h(5) % 200, h(5) % 200 + 1 + h(9) % 150, h(5) % 200 + 160 + h(13) % 100
    event = lambda when, kind, day, action: F.when(when, F.struct(F.lit(kind).alias("list"), day.alias("day"), F.lit(action).alias("action")))
    made = F.array(
        event(h(1) % 4 == 0, "block", first, "add"), event(h(1) % 4 == 0, "block", gone, "remove"), event(h(1) % 8 == 0, "block", again, "add"),
        event(h(17) % 16 == 0, "allow", first, "add"),
    )
    return domains.select("domain", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.list", "domain", "e.day", "e.action")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", _digits(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 1, 4) % 365)
    return evaluate(captures, list_events(pages))


OP3_SQL = r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
                  ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 4))::BIGINT % 365 AS day FROM pages),
b AS (SELECT page_id, day, translate(regexp_replace(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', ''), '[.]$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM a),
c AS (SELECT page_id, day, CASE WHEN host <> '' THEN host END AS host FROM b),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM c WHERE host IS NOT NULL),
up AS (SELECT host, array_to_string(labels[i:], '.') AS domain FROM (SELECT host, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM hosts)),
h AS (SELECT domain, ('0x' || substr(md5(domain), 1, 4))::BIGINT AS h1, ('0x' || substr(md5(domain), 5, 4))::BIGINT % 200 AS first,
             ('0x' || substr(md5(domain), 9, 4))::BIGINT AS h9, ('0x' || substr(md5(domain), 13, 4))::BIGINT AS h13, ('0x' || substr(md5(domain), 17, 4))::BIGINT AS h17 FROM (SELECT DISTINCT domain FROM up)),
events AS (SELECT 'block' AS list, domain, first AS day, 'add' AS action FROM h WHERE h1 % 4 = 0 UNION
           SELECT 'block', domain, first + 1 + h9 % 150, 'remove' FROM h WHERE h1 % 4 = 0 UNION
           SELECT 'block', domain, first + 160 + h13 % 100, 'add' FROM h WHERE h1 % 8 = 0 UNION
           SELECT 'allow', domain, first, 'add' FROM h WHERE h17 % 16 = 0),
spans AS (SELECT list, domain, action, day AS start, lead(day) OVER (PARTITION BY list, domain ORDER BY day, action) AS stop FROM events),
active AS (SELECT x.host, x.day, s.list, s.domain FROM (SELECT DISTINCT host, day FROM c) x JOIN up USING (host) JOIN spans s ON s.domain = up.domain AND s.action = 'add' AND s.start <= x.day AND (s.stop IS NULL OR x.day < s.stop)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY host, day) AS n, row_number() OVER (PARTITION BY host, day ORDER BY length(domain) DESC, list = 'allow' DESC) AS nth FROM active)
SELECT c.page_id, c.host, c.day, coalesce(r.n, 0)::BIGINT AS n_active, r.domain AS matched, CASE WHEN r.list = 'block' THEN 'drop' ELSE 'keep' END AS verdict
FROM c LEFT JOIN ranked r ON r.nth = 1 AND r.host = c.host AND r.day = c.day
"""
