"""Importance resampling towards the distribution of a target collection."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import drop_table, lean_batches, settle
from ringloom.operators.ranking import row_numbers

#: Words in a feature at most, buckets of features, and observations that each bucket has from the start.
LONGEST, BUCKETS, PRIOR = 1, 10_000, 1
SCALE, SEED = 1000, 2024
#: Documents of fewer words aren't drawn; of the others, so many in a hundred are.
FEWEST_WORDS, SHARE = 20, 10
#: Keys that are few enough to be sorted in one place.
FEW = 4096
#: A feature of more bytes is hashed by itself, the others of a batch together.
LONG = 64

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(c).isalnum() for c in range(128)]
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


# ---- features ----


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop, sizes): the words of all `texts` in UTF-8 with one space after each, where each starts and stops, and how many each text has; a null text has none.

    Words are runs of letters and digits of ASCII and of anything outside ASCII, with A-Z lower-cased.
    """
    data = np.frombuffer(b"\n".join((*(t.as_buffer() if t.is_valid else b"" for t in texts), b"")).lower(), np.uint8)
    ends = np.cumsum([(t.as_buffer().size if t.is_valid else 0) + 1 for t in texts]).astype(np.int64)
    word = _WORD[data]
    kept = word.copy()
    kept[1:] |= word[:-1]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    out = np.where(word, data, 0x20).astype(np.uint8)[kept]
    stop = np.flatnonzero(~word[kept])
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    return out, start, stop, sizes


def crc32(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The CRC-32 of each of the byte ranges of `data`."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = stop - start
    at = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = (out[at] >> 8) ^ _CRC[(out[at] ^ data[start[at] + k]) & 0xFF]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : stop[i]].tobytes())
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, sizes, words): of the features of all `texts`, one text after the other, how many features each has, and how many words. Features are all runs of 1 to `longest` words, parted by a space."""
    data, start, stop, words = spelled(texts)
    text = np.repeat(np.arange(len(words)), words)
    found, own = [], []
    for n in range(1, longest + 1):
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        found.append(crc32(data, start[at], stop[at + n - 1]) % np.uint32(buckets))
        own.append(text[at])
    found, own = np.concatenate(found).astype(np.int64), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return found[order], np.bincount(own, minlength=len(words)), words


def _counted(longest: int, buckets: int):
    """How often each bucket occurs in a task's texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(features(batch.column("text"), longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    return counted


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of each bucket occur in the column `text`, over all rows. Tasks send a row a bucket at most, and as many reach the driver."""
    rows = texts.select("text").mapInArrow(_counted(longest, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: SCALE times the log ratio of the target's smoothed share to the corpus's, down to a whole number."""
    n = len(corpus) * PRIOR
    ratio = lambda s, t: (float(t) + PRIOR) * (float(corpus.sum()) + n) / ((float(s) + PRIOR) * (float(target.sum()) + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _weighed(longest: int, gain):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, words = features(batch.column("text"), longest, len(gain.value))
            sums = np.concatenate([[0], np.cumsum(gain.value[found])])
            ends = np.cumsum(sizes)
            weight = sums[ends] - sums[ends - sizes]
            rest = batch.drop_columns(["text"])
            for name, values in (("n_words", words), ("n_features", sizes), ("weight", weight)):
                rest = rest.append_column(name, pa.array(values.astype(np.int64)))
            yield rest

    return weighed


# ---- the draw ----


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-SCALE * ln(-ln(u))), u in (0, 1) from the first 32 bits of sha256 of ``seed:doc_id``; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(2**32))))).cast("long")


#: A key is what rows are drawn by, as numbers of which smaller ones come first; the last part tells rows apart.
KEY = ("k0", "k1", "k2", "k3")
_PARTS = "above long, upper array<long>, below long, lower array<long>"


def _middle(keys: np.ndarray) -> list[int] | None:
    """The lower median of rows of parts."""
    return keys[np.lexsort(keys.T[::-1])[(len(keys) - 1) // 2]].tolist() if len(keys) else None


def _halves(pivot: list[int] | None):
    """How many of a task's keys come before the pivot and after it, and the medians of both; without a pivot all come after it."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(c).to_numpy() for c in KEY], axis=1) for b in batches]
        keys = np.concatenate(parts) if parts else np.zeros((0, len(KEY)), np.int64)
        first, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        if pivot is not None:
            for column, p in zip(keys.T, pivot, strict=True):
                first |= same & (column < p)
                same &= column == p
        else:
            same[:] = False
        above, below = keys[first], keys[~first & ~same]
        if len(keys):
            kinds = (pa.int64(), pa.list_(pa.int64())) * 2
            row = (len(above), _middle(above), len(below), _middle(below))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["above", "upper", "below", "lower"])

    return halves


def weighted_median(medians: list[tuple[list[int], int]]) -> list[int]:
    """The first of the sorted (key, weight) up to which half of all weight lies."""
    left = sum(n for _, n in medians)
    run = 0
    for key, n in sorted(medians):
        run += n
        if 2 * run >= left:
            return key
    raise ValueError("no keys")


def before(key: list[int]) -> Column:
    """Whether a row's key comes before `key`."""
    out = F.lit(False)
    for c, v in reversed(list(zip(KEY, key, strict=True))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def cutoff(keys: DataFrame, n: int, few: int = FEW) -> list[int]:
    """The `n`-th of the distinct `keys`, n at least 1 and at most their number, by weighted medians of medians.

    Each round the tasks tell the median of their keys that are left, and how many there are. A quarter of all keys or more lies on either side of the median of these medians, weighed by the sizes, so a quarter or more is discarded whichever side the cutoff is on. The same pass that counts around a pivot gives the medians of both sides, so a round is one pass; what is left is written again whenever it has halved. The last `few` are sorted in one place. Only a row a task reaches the driver.
    """
    left, held = keys.select(*KEY), None
    rounds = left.mapInArrow(_halves(None), _PARTS).collect()
    total = written = sum(r.below for r in rounds)
    medians = [(r.lower, r.below) for r in rounds if r.below]
    while total > few:
        pivot = weighted_median(medians)
        rounds = left.mapInArrow(_halves(pivot), _PARTS).collect()
        above = sum(r.above for r in rounds)
        if n == above + 1:
            break
        if n <= above:
            left, total, medians = left.filter(before(pivot)), above, [(r.upper, r.above) for r in rounds if r.above]
        else:
            n, total = n - above - 1, total - above - 1
            left, medians = left.filter(~before(pivot) & ~same_key(pivot)), [(r.lower, r.below) for r in rounds if r.below]
        if 2 * total <= written:
            old, held = held, settle(left, "left")
            left, written = held, total
            if old is not None:
                drop_table(old)
    else:
        pivot = [int(v) for v in left.orderBy(*KEY).limit(few).collect()[n - 1]]
    if held is not None:
        drop_table(held)
    return pivot


def same_key(key: list[int]) -> Column:
    out = F.lit(True)
    for c, v in zip(KEY, key, strict=True):
        out &= F.col(c) == v
    return out


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, fewest: int = FEWEST_WORDS, share: int = SHARE
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of `docs`: how a draw of `share` percent of its documents of `fewest` words or more, without replacement and with probabilities by importance weights towards `target` (Xie et al., 2023), ranks them; rank is null for those that aren't drawn.

    Features are runs of 1 to `longest` words of whole texts, hashed to `buckets`; two passes over the texts count them and add up a document's gains, from an array with a number a bucket. A document's score is its weight and Gumbel noise from its id, so the highest scores are a draw (Kool et al., 2019), and reruns agree. The cutoff is found exactly by cutoff(); only the winners are sorted, by ranges.

    A null text has no features and weight 0; a null doc_id draws like an empty one and comes last among ties; rows that repeat a doc_id are drawn each by itself, that of fewer features first; with an empty target all gains come from the corpus alone; an empty table gives no rows; only doc_id and text are read. Sets the session's Arrow batches to 8 MB.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(gain)
    weighed = rows.mapInArrow(_weighed(longest, sent), "doc_id long, n_words long, n_features long, weight long")
    scored = settle(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "scored")
    # a key: falling scores, rising ids with null last, features, and the row's number
    names = dict(zip(KEY, (-F.col("score"), F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("n_features"), F.col("row")), strict=True))
    keyed = scored.withColumns(names)
    able = F.col("n_words") >= fewest
    drawn = scored.filter(able).count() * share // 100
    shown = ("doc_id", "n_features", "weight", "score")
    if not drawn:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    last = cutoff(keyed.filter(able), drawn)
    won = able & (before(last) | same_key(last))
    winners = row_numbers(keyed.filter(won).select(*shown, *KEY), list(KEY), "rank", 1)
    return winners.select(*shown, F.col("rank").cast("long")).union(keyed.filter(~won).select(*shown, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTE_SQL = "('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT"
OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
b AS (SELECT {_WORDS_SQL} AS words FROM benchmark),
crc AS (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n)),
tab AS (SELECT list(c ORDER BY n) AS c FROM crc),
df AS (SELECT doc_id, unnest(words) AS w FROM d),
bf AS (SELECT unnest(words) AS w FROM b),
w AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM df UNION SELECT w FROM bf)),
step AS (SELECT w, h, 0 AS i, 4294967295::BIGINT AS x FROM w
         UNION ALL SELECT w, h, i + 1, xor(x >> 8, tab.c[xor(x & 255, {_BYTE_SQL}) + 1]) FROM step, tab WHERE 2 * i < length(h)),
k AS (SELECT w, xor(x, 4294967295) % {BUCKETS} AS bucket FROM step WHERE 2 * i = length(h)),
s AS (SELECT bucket, count(*) AS n FROM df JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN k USING (w) GROUP BY bucket),
total AS MATERIALIZED (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {BUCKETS} AS t),
g AS (SELECT bucket, floor({SCALE} * ln((coalesce(t.n, 0)::DOUBLE + 1) * total.s / ((s.n::DOUBLE + 1) * total.t)))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket) CROSS JOIN total),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM df JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
sc AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
              coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
       FROM d LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= {FEWEST_WORDS})
SELECT sc.doc_id, n_features, weight, score::BIGINT AS score, rank::BIGINT AS rank
FROM sc LEFT JOIN (SELECT doc_id, rank FROM r WHERE rank <= {SHARE} * n // 100) r ON sc.doc_id IS NOT DISTINCT FROM r.doc_id
"""
