"""Language-model scores by cross-entropy difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import lean_batches, settle
from ringloom.llm.tokens import chained, word_hashes

#: Bytes of text in a block of documents (a row counts ROW_BYTES more), and blocks a bucket of n-grams. A block doesn't grow with the input, nor do the n-grams of a bucket; but a bucket gets a row, shorter and shorter, from each block, so B blocks make up to B x B / 2 rows, and a frequent n-gram is an entry of each.
BLOCK_BYTES, ROW_BYTES, BLOCKS_A_BUCKET = 4 << 20, 16, 2
#: How many observations the uniform estimate weighs in that of a word, and the estimate of a word in that of a pair.
UNIFORM, SINGLE = 1000.0, 10.0
#: The two lowest bits of an n-gram's hash tell its length.
WORD, PAIR = np.uint64(1), np.uint64(2)
REPLIES = "bucket int, block long, n binary, target binary, words long, target_words long, vocabulary long"


def _packed(a: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, so that a codec finds the zeros."""
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = 1 + max((i for i in range(8) if planes[i].any()), default=0)
    return bytes([used]) + planes[:used].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<u8")[:, 0]


def _dealt(most: int):
    """Rows in blocks of `most` bytes, or one text that is longer: block, ids, and the texts, compressed."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            ids = pa.chunked_array([part.column("doc_id") for part in held]).to_pylist()
            name = TaskContext.get().partitionId() << 32 | nth
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "ids", "load"]
            )

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column("text")):
                size += ROW_BYTES + (text.as_buffer().size if text.is_valid else 0)
                if size >= most:
                    held.append(batch.slice(start, i + 1 - start))
                    yield block()
                    held, size, nth, start = [], 0, nth + 1, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block()

    return dealt


class _Block:
    """The words and pairs of words of a block's documents: `keys` are the distinct ones, sorted; `where` is the key of each word, then of each pair; `text_of` its document."""

    def __init__(self, load: bytes, targets: list[int] | None) -> None:
        table = pa.ipc.open_stream(load).read_all()
        self.doc_id = table.column("doc_id").combine_chunks()
        found = [word_hashes(c) for c in table.column("text").chunks]
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: the places of words that follow another
        self.follows = np.flatnonzero(text[1:] == text[:-1]) + 1
        pairs = chained(h[self.follows - 1], h[self.follows])
        grams = np.concatenate([h & ~np.uint64(3) | WORD, pairs & ~np.uint64(3) | PAIR])
        self.keys, self.where = np.unique(grams, return_inverse=True)
        self.text_of = np.concatenate([text, text[self.follows]])
        self.target = np.zeros(len(self.sizes), bool)
        self.target[targets or []] = True

    def buckets(self, bits: int) -> np.ndarray:
        """Buckets are ranges of hashes."""
        return (self.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)


def _requests(bits: int):
    """For each bucket, the keys of a block that fall in it, as differences, and how often all documents and target documents of the block have them."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, load, targets in zip(*(batch.column(c).to_pylist() for c in ("block", "load", "targets")), strict=True):
                b = _Block(load, targets)
                n = np.bincount(b.where, minlength=len(b.keys))
                t = np.bincount(b.where, b.target[b.text_of], len(b.keys)).astype(np.int64)
                there, start = np.unique(b.buckets(bits), return_index=True)
                cuts = [slice(s, e) for s, e in zip(start, [*start[1:], len(b.keys)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there, pa.int32()), pa.array(np.full(len(there), block)),
                        pa.array([_packed(np.diff(b.keys[c], prepend=np.uint64(0))) for c in cuts], pa.binary()),
                        pa.array([_packed(n[c]) for c in cuts], pa.binary()), pa.array([_packed(t[c]) for c in cuts], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "n", "target"],
                )

    return requests


def _replies(table: pa.Table) -> pa.Table:
    """A bucket's counts over all blocks, to each block for the keys that it sent, and a row without a block: words, words of targets, distinct words."""
    asked = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    keys, where = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([len(x) for x in asked])[:-1]
    words, told, sums = keys & np.uint64(3) == WORD, [], []
    for column in ("n", "target"):
        each = np.concatenate([_unpacked(x) for x in table.column(column).to_pylist()])
        count = np.bincount(where, each, len(keys)).astype(np.int64)
        told.append([*(_packed(x) for x in np.split(count[where], ends)), None])
        sums.append(int(count[words].sum()))
    rows, blocks = table.num_rows, [*table.column("block").to_pylist(), None]
    last = lambda v: pa.array([None] * rows + [v], pa.int64())
    return pa.Table.from_arrays(
        [pa.array([table.column("bucket")[0].as_py()] * (rows + 1), pa.int32()), pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in told), last(sums[0]), last(sums[1]), last(int(words.sum()))],
        ["bucket", "block", "n", "target", "words", "target_words", "vocabulary"],
    )


def _scores(totals: tuple[int, int], vocabulary: int):
    def scores(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(blocks.column("load")[0].as_py(), blocks.column("targets")[0].as_py())
        replies = replies.sort_by("bucket")
        _, pair, times = np.unique(b.where * max(1, len(b.sizes)) + b.text_of, return_inverse=True, return_counts=True)
        own, words = times[pair], int(b.sizes.sum())
        out = []
        for column, total, left_out in (("target", totals[1], b.target), ("n", totals[0], np.ones(len(b.sizes), bool))):
            count = np.concatenate([np.zeros(0), *(_unpacked(x) for x in replies.column(column).to_pylist())])
            # a document is scored by the counts of all others
            count = count[b.where] - own * left_out[b.text_of]
            p = (count[:words] + UNIFORM / max(1, vocabulary)) / ((total - b.sizes * left_out)[b.text_of[:words]] + UNIFORM)
            p[b.follows] = (count[words:] + SINGLE * p[b.follows]) / (count[b.follows - 1] + SINGLE)
            out.append(pa.array(np.bincount(b.text_of[:words], -np.log2(p), len(b.sizes)) / np.maximum(b.sizes, 1)))
        return pa.Table.from_arrays([b.doc_id, pa.array(b.sizes), *out], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    return scores


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of `docs`: bits a word under a model of the documents in `target_ids` and under one of all documents, and their difference (Moore and Lewis, 2010); lower is closer to the target.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Both are models of pairs of words over one vocabulary, all distinct words of `docs`, with Dirichlet smoothing (MacKay and Peto, 1995): a pair's estimate weighs in that of its second word as SINGLE observations, that the uniform one as UNIFORM. A word's count as a context is its count. All words and pairs of all texts count, by 64-bit hashes; a document is scored by the counts of all other rows, else it would seem as likely as it is long.

    Documents travel in blocks of `block_bytes` of text. Each block sends its distinct words and pairs with partial counts to buckets, which are ranges of hashes, so that a frequent pair is one entry a block; buckets add them up and reply to each block. With very many blocks, the parts of a block get small; a larger `block_bytes` helps. Three totals reach the driver: words of either model and the size of the vocabulary.

    A null text counts as an empty one, with losses and score 0; a null doc_id is no target; rows that repeat are documents of their own and score alike; with no targets, or none but the document itself, the target model is uniform; an empty table gives no rows; other columns are not read. Sets the session's Arrow batches to 8 MB.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = settle(rows.mapInArrow(_dealt(block_bytes), "block long, ids array<long>, load binary"), "blocks")
    bits = max(0, (blocks.count() // BLOCKS_A_BUCKET - 1).bit_length())
    # only ids are joined; the texts stay where they are
    targets = target_ids.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    flags = blocks.select("block", F.posexplode("ids").alias("pos", "id")).join(targets, "id").groupBy("block").agg(F.collect_list("pos").alias("targets"))
    marked = blocks.select("block", "load").join(settle(flags, "flags"), "block", "left")
    asked = marked.mapInArrow(_requests(bits), "bucket int, block long, keys binary, n binary, target binary")
    replies = settle(asked.groupBy("bucket").applyInArrow(_replies, REPLIES), "replies")
    n, target, vocabulary = replies.filter("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target_words", "vocabulary")]).first()
    told = replies.filter("block IS NOT NULL").select("bucket", "block", "n", "target")
    out = marked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _scores((n, target), vocabulary), "doc_id long, n_tokens long, target_loss double, background_loss double"
    )
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op2_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic are the target; losses to six places."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1 AND toxic = 0"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS chosen,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sizes AS (SELECT doc_id, chosen, len(words)::BIGINT AS n FROM w),
t AS (SELECT doc_id, chosen, unnest(words) AS w, unnest([NULL] || words[:-2]) AS v FROM w WHERE len(words) > 0),
own1 AS (SELECT doc_id, chosen, w, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
own2 AS (SELECT doc_id, chosen, v, w, count(*)::DOUBLE AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
one AS (SELECT w, sum(n) AS b, coalesce(sum(n) FILTER (chosen), 0) AS t FROM own1 GROUP BY w),
two AS (SELECT v, w, sum(n) AS b, coalesce(sum(n) FILTER (chosen), 0) AS t FROM own2 GROUP BY v, w),
total AS (SELECT coalesce(sum(n), 0)::DOUBLE AS b, coalesce(sum(n) FILTER (chosen), 0)::DOUBLE AS t, greatest(1, (SELECT count(*) FROM one))::DOUBLE AS vocabulary FROM sizes),
part AS (SELECT t.doc_id, t.v, t.w, CASE WHEN s.chosen THEN 1 ELSE 0 END AS c, s.n AS size FROM t JOIN sizes s USING (doc_id)),
counts AS (SELECT p.doc_id, p.v, o.b - x.n AS b1, o.t - p.c * x.n AS t1, total.b - p.size AS nb, total.t - p.c * p.size AS nt, vocabulary,
                  f.b - fx.n AS fb, f.t - p.c * fx.n AS ft, q.b - qx.n AS b2, q.t - p.c * qx.n AS t2
           FROM part p CROSS JOIN total JOIN one o ON o.w = p.w JOIN own1 x ON x.doc_id = p.doc_id AND x.w = p.w
           LEFT JOIN one f ON f.w = p.v LEFT JOIN own1 fx ON fx.doc_id = p.doc_id AND fx.w = p.v
           LEFT JOIN two q ON q.v = p.v AND q.w = p.w LEFT JOIN own2 qx ON qx.doc_id = p.doc_id AND qx.v = p.v AND qx.w = p.w),
single AS (SELECT *, (b1 + {UNIFORM} / vocabulary) / (nb + {UNIFORM}) AS pb, (t1 + {UNIFORM} / vocabulary) / (nt + {UNIFORM}) AS pt FROM counts),
pairs AS (SELECT doc_id, CASE WHEN v IS NULL THEN pb ELSE (b2 + {SINGLE} * pb) / (fb + {SINGLE}) END AS pb,
                 CASE WHEN v IS NULL THEN pt ELSE (t2 + {SINGLE} * pt) / (ft + {SINGLE}) END AS pt FROM single),
lost AS (SELECT doc_id, avg(-log2(pt)) AS t, avg(-log2(pb)) AS b FROM pairs GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_tokens, round(coalesce(t, 0), 6) AS target_loss, round(coalesce(b, 0), 6) AS background_loss, round(coalesce(t - b, 0), 6) AS score
FROM sizes s LEFT JOIN lost USING (doc_id)
"""
