"""Hard negatives of labelled vectors by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import drop_table, lean_batches, partitions, settle

#: Components become floor(SCALE * x).
SCALE = 256
#: How many positives an anchor has, and negatives a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between so many hundredths of the positive's score.
LEAST, MOST = 80, 100
#: The codebooks are fitted to so many rows at most, those of the smallest hashes of ids, in so many rounds. Every row is entered in the index, and results don't depend on the fit.
SAMPLE, FIT_ROUNDS = 20_000, 8
#: Rows of a cell, about, which set the codewords of a half; fewest and most codewords.
ROWS_A_CELL, FEWEST, MOST_CODES = 1024, 4, 256
#: Rows of a block, and anchors that meet a block at once: a task holds one such pair.
BLOCK, CHUNK = 1024, 1024
#: Rows that an anchor's first round visits, about, and how many times more a later one does than all before it.
FIRST_ROWS, GROWTH = 2048, 8
TOP, BOTTOM = 2**63 - 1, -(2**63)

ROWS = "cell int, vec_id long, label long, vector binary, d1 double, d2 double, n1 double, n2 double"
BLOCKS = "cell int, ids binary, labels binary, vectors binary"
ANCHORS = "vec_id long, label long, vector binary"
REQUESTS = "cell int, open long, anchors binary, ids binary, labels binary, vectors binary, lows binary, highs binary, needs binary"


# ---- the index ----


@dataclass
class Codebooks:
    """Codewords of both halves of the components: `centres`, and for each the largest distance and norm of the halves that are nearest to it, `radii` and `norms`; `counts`, the rows of each cell."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    norms: tuple[np.ndarray, np.ndarray] | None = None
    counts: np.ndarray | None = None

    @property
    def cut(self) -> int:
        return self.centres[0].shape[1]

    @property
    def dim(self) -> int:
        return self.cut + self.centres[1].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For the rows of `x` and each codeword of either half: no half of that codeword scores more, and none less."""
        upper, lower = [], []
        for q, c, r, n in zip(self.halves(x), self.centres, self.radii, self.norms, strict=True):
            own = np.sqrt((q * q).sum(axis=1))[:, None]
            at, reach = q @ c.T, own * r
            slack = 1e-9 * own * (np.sqrt((c * c).sum(axis=1)) + r) + 1e-6
            upper.append(np.minimum(at + reach, own * n) + slack)
            lower.append(np.maximum(at - reach, -own * n) - slack)
        return upper, lower


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fitted(sample: np.ndarray, codes: int) -> Codebooks:
    """`codes` codewords for each half of the components, by k-means over `sample`."""
    cut = sample.shape[1] // 2
    centres = []
    for half in (sample[:, :cut], sample[:, cut:]):
        c = half[np.linspace(0, len(half) - 1, codes).astype(int)].copy()
        for _ in range(FIT_ROUNDS):
            own = nearest(half, c)
            n = np.bincount(own, minlength=codes)
            sums = np.zeros_like(c)
            np.add.at(sums, own, half)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        centres.append(c)
    return Codebooks(tuple(centres))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, in two bytes each if they fit."""
    small = not x.size or np.abs(x).max() < 2**15
    return x.astype("<i2" if small else "<i8").tobytes()


def unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * dim else "<i8").reshape(rows, dim).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of `a` with those of `b`, exact: in doubles where these hold every partial sum."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def whole(lists: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of lists of numbers, filled up to `dim` components with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    x = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if x.size and np.add.reduceat(x * x, (np.cumsum(size) - size)[size > 0]).max() >= 2**62:
        raise ValueError("components are too large: scores would not fit 64 bits")
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x.astype(np.int64)
    return out


def _placed(books):
    """Each row with its cell, and the distance from its codeword and the norm of either half."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebooks = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column("embedding"), b.dim)
            halves = b.halves(x.astype(np.float64))
            own = [nearest(h, c) for h, c in zip(halves, b.centres, strict=True)]
            far = [np.sqrt(((h - c[o]) ** 2).sum(axis=1)) for h, c, o in zip(halves, b.centres, own, strict=True)]
            norm = [np.sqrt((h * h).sum(axis=1)) for h in halves]
            cell = own[0] * len(b.centres[1]) + own[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column("vec_id"), batch.column("label"), pa.array([packed(v) for v in x], pa.binary()), *map(pa.array, (*far, *norm))],
                ["cell", "vec_id", "label", "vector", "d1", "d2", "n1", "n2"],
            )

    return placed


def _blocked(dim: int):
    """Rows sorted by cell and id in blocks of a cell; a row that repeats the one before is left out."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, labels = (np.array([r[k] for r in held], "<i8").tobytes() for k in (1, 2))
        x = np.concatenate([unpacked(r[3], 1, dim) for r in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0][0]], pa.int32()), *(pa.array([v], pa.binary()) for v in (ids, labels, packed(x)))], ["cell", "ids", "labels", "vectors"]
        )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "vec_id", "label", "vector")), strict=True):
                if held and row == held[-1]:
                    continue
                if held and (row[0] != held[0][0] or len(held) >= BLOCK):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return blocked


def _anchors(every: int, dim: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, vectors in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "vectors")), strict=True):
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                at = np.flatnonzero(ids % every == 0)
                x = unpacked(vectors, len(ids), dim)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), pa.array([packed(v) for v in x], pa.binary())], ["vec_id", "label", "vector"])

    return anchors


def indexed(rows: DataFrame, dim: int) -> tuple[DataFrame, Codebooks]:
    """(blocks, codebooks) of `rows` (vec_id, label, embedding): every row in a block of its cell.

    Cells are split over tasks by ranges of (cell, id), so that one with a third of all rows is many blocks. A row for each codeword and cell reaches the driver, 65,536 at most.
    """
    spark = rows.sparkSession
    n = rows.count()
    codes = int(min(MOST_CODES, max(FEWEST, np.ceil(np.sqrt(n / ROWS_A_CELL)))))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    sample = whole(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen, dim).astype(np.float64) if n else np.zeros((1, dim))
    books = fitted(sample, codes)
    sent = spark.sparkContext.broadcast(books)
    placed = settle(rows.mapInArrow(_placed(sent), ROWS), "placed")
    size = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("d1", "d2", "n1", "n2")]).collect()
    books.counts = np.zeros(codes * codes, np.int64)
    far, norm = (tuple(np.zeros(codes) for _ in range(2)) for _ in range(2))
    for r in size:
        books.counts[r.cell] = r.n
        for half, code in enumerate(divmod(r.cell, codes)):
            far[half][code] = max(far[half][code], r[f"d{half + 1}"])
            norm[half][code] = max(norm[half][code], r[f"n{half + 1}"])
    books.radii, books.norms = far, norm
    order = ["cell", "vec_id", "label", "vector"]
    dealt = placed.select(*order).repartitionByRange(partitions(spark), "cell", "vec_id").sortWithinPartitions(*order)
    blocks = settle(dealt.mapInArrow(_blocked(dim), BLOCKS), "blocks")
    drop_table(placed)
    return blocks, books


# ---- the search ----


def visits(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(u[a] + v[b], a, b) of all pairs, largest sums first, of `u` and `v` in falling order (Babenko and Lempitsky, 2012); the heap holds a pair for each a that was begun."""
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, a, b
        if b + 1 < len(v):
            heapq.heappush(heap, (-(u[a] + v[b + 1]), a, b + 1))
        if b == 0 and a + 1 < len(u):
            heapq.heappush(heap, (-(u[a + 1] + v[0]), a + 1, 0))


def _longs(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _requests(books, start: int, stop: int):
    """The cells that anchors visit in the round from the `start`-th to the `stop`-th row, each with the anchors that ask for it; and how many anchors have further to go."""

    def asked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        b: Codebooks = books.value
        n, codes = batch.num_rows, len(b.centres[1])
        key, ids, labels = (batch.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        x = np.concatenate([unpacked(v, 1, b.dim) for v in batch.column("vector").to_pylist()])
        lows, highs, needs = (_longs(batch.column(c)) for c in ("lows", "highs", "needs"))
        (u1, u2), (l1, l2) = b.bounds(x.astype(np.float64))
        o1, o2 = np.argsort(-u1, axis=1), np.argsort(-u2, axis=1)
        wanted: dict[int, list[int]] = {}
        further = 0
        for i in range(n):
            need, top, passed = needs[i].min(), highs[i].max(), 0
            for bound, p, q in visits(u1[i][o1[i]], u2[i][o2[i]]):
                if bound < need:
                    break  # all windows are certified
                if passed >= stop:
                    further += 1
                    break
                one, two = o1[i][p], o2[i][q]
                cell = int(one * codes + two)
                if passed >= start and b.counts[cell] and l1[i][one] + l2[i][two] <= top:
                    wanted.setdefault(cell, []).append(i)
                passed += b.counts[cell]
        blank = [None] * 7
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([further], pa.int64()), *(pa.array([v], pa.binary()) for v in blank)], _NAMES)
        for cell, at in wanted.items():
            parts = [*(v[at].astype("<i8").tobytes() for v in (key, ids, labels)), packed(x[at]), *(v[at].astype("<i8").tobytes() for v in (lows, highs, needs))]
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([0], pa.int64()), *(pa.array([v], pa.binary()) for v in parts)], _NAMES)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield from asked(batch.slice(at, CHUNK))

    return requests


_NAMES = [x.split()[0] for x in REQUESTS.split(", ")]


def _met(dim: int, same: bool, most: int):
    """Of anchors and a block: for each anchor and window its `most` first rows, of the same label or of others."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                key, vec, mine, ids, labels = (np.frombuffer(r[c], "<i8") for c in ("anchors", "vecs", "own_labels", "ids", "labels"))
                s = scores(unpacked(r["own_vectors"], len(key), dim), unpacked(r["vectors"], len(ids), dim))
                lows, highs, needs = (np.frombuffer(r[c], "<i8").reshape(len(key), -1) for c in ("lows", "highs", "needs"))
                fits = (mine[:, None] == labels[None, :]) == same
                if same:
                    fits &= vec[:, None] != ids[None, :]
                for w in range(lows.shape[1]):
                    a, b = np.nonzero(fits & (s >= np.maximum(lows, needs)[:, w, None]) & (s <= highs[:, w, None]))
                    order = np.lexsort((ids[b], -s[a, b], a))
                    a, b = a[order], b[order]
                    first = np.searchsorted(a, a)
                    keep = np.arange(len(a)) - first < most
                    a, b = a[keep], b[keep]
                    if len(a):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[a]), pa.array(np.full(len(a), w, np.int32)), pa.array(s[a, b]), pa.array(ids[b])], ["anchor", "w", "score", "other"]
                        )

    return met


def searched(anchors: DataFrame, blocks: DataFrame, books: Codebooks, same: bool, most: int) -> DataFrame:
    """For each window, (lows[w], highs[w]), of each of the settled `anchors` (anchor, vec_id, label, vector, lows, highs): its `most` first rows, by score and then id, that lie in it, of the anchor's label or of all others: (anchor, w, score, other, rank). Exact.

    Anchors visit cells by their bounds, the largest first, in rounds that visit ever more rows; cells whose rows all score above an anchor's windows are passed over. A round's cells meet their blocks in a join, and each pair leaves `most` rows a window at most, none below what the anchor has. An anchor stops once no cell that is left can hold a row for any of its windows.
    """
    spark = anchors.sparkSession
    sent = spark.sparkContext.broadcast(books)
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "other")
    found = spark.createDataFrame([], "anchor long, w int, score long, other long, rank int")
    # a window without room needs nothing
    state = anchors.withColumn("needs", F.transform("lows", lambda lo, i: F.when(lo > F.get("highs", i), F.lit(TOP)).otherwise(lo)))
    start, stop, last = 0, FIRST_ROWS, None
    while True:
        asked = settle(state.mapInArrow(_requests(sent, start, stop), REQUESTS), "asked")
        further, cells = asked.agg(F.coalesce(F.sum("open"), F.lit(0)), F.count_if(F.col("cell") >= 0)).first()
        if cells:
            names = {"ids": "vecs", "labels": "own_labels", "vectors": "own_vectors"}
            met = asked.filter("cell >= 0").drop("open").withColumnsRenamed(names).join(blocks, "cell")
            new = found.drop("rank").union(met.mapInArrow(_met(books.dim, same, most), "anchor long, w int, score long, other long"))
            found = settle(new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most), "found")
            if last is not None:
                drop_table(last)
            last = found
        drop_table(asked)
        if not further:
            return found
        start, stop = stop, stop * (1 + GROWTH)
        full = found.filter(F.col("rank") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
        need = lambda lo, i: F.when(lo > F.get("highs", i), F.lit(TOP)).otherwise(F.coalesce(F.try_element_at("full", i), lo))
        state = anchors.join(full, "anchor", "left").withColumn("needs", F.transform("lows", need)).drop("full")


def hard_negatives(vectors: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Hard negatives of the rows of `vectors` (vec_id, embedding, label) whose vec_id is divisible by `every`, the anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Exact.

    A component x becomes floor(SCALE * x), a score is an inner product; higher scores come first, then smaller ids. An anchor's positives are its first `positives` other rows of its label, and for each of these its negatives are the first `negatives` rows of other labels whose score is `least` to `most` hundredths of the positive's. Fewer, if there are no more; none for a positive with a score below 0.

    Every row is entered in a cell of two codebooks, one for each half of the components. The search for positives and that for all windows of negatives visit cells by summed bounds of the halves' scores, and stop where what is left can't matter. Vectors without clusters leave no cell out; then every anchor meets every block, once in either search.

    Null ids, labels and vectors and vectors with null or non-finite components take no part; rows that repeat vec_id, label and vector are one row, rows that share a vec_id alone are rows of their own but never each other's positives; shorter vectors are filled up with zeros, empty ones score 0; components of 2^23 or so and more, whose scores don't fit 64 bits, are an error; an empty table gives no rows; other columns are not read. Sets the session's Arrow batches to 8 MB.
    """
    spark = vectors.sparkSession
    lean_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~bad)
    dim = max(2, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    blocks, books = indexed(rows, dim)
    anchors = blocks.select("ids", "labels", "vectors").mapInArrow(_anchors(every, dim), ANCHORS)
    anchors = settle(anchors.repartition(partitions(spark), "vec_id").withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    everything = anchors.withColumn("lows", F.array(F.lit(BOTTOM))).withColumn("highs", F.array(F.lit(TOP)))
    liked = searched(everything, blocks, books, True, positives)
    share = lambda hundredths: F.col("score").cast("decimal(20,0)") * F.lit(Decimal(hundredths) / 100)  # noqa: E731  exact
    edges = F.struct("rank", F.ceil(share(least)).cast("long").alias("low"), F.floor(share(most)).cast("long").alias("high"))
    wide = liked.groupBy("anchor").agg(F.sort_array(F.collect_list(edges)).alias("edges"))
    padded = lambda field, blank: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("edges", i)[field], F.lit(blank)))
    windows = anchors.join(wide, "anchor").select(*anchors.columns, padded("low", TOP).alias("lows"), padded("high", BOTTOM).alias("highs"))
    windows = settle(windows, "windows")
    other = searched(windows, blocks, books, False, negatives)

    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id")).join(
        liked.select("anchor", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "anchor"
    )
    out = other.select("anchor", "w", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), 100)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
