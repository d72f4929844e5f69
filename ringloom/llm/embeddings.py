"""Near-duplicates among embeddings by Euclidean p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringloom.llm.common import components, drop_table, lean_batches, settle
from ringloom.llm.shingles import _whole_runs
from ringloom.llm.tokens import MIX, mixed

LEAST_COSINE = 0.93
#: Projections of a table, width of their cells, and tables. Unit vectors at the least cosine are 0.374 apart and fall in one cell with probability 0.851, in one bucket of 16 cells with 0.076, and in one bucket of one of 40 tables at least with 0.957; at cosine 0.97, with 0.9998. Vectors at right angles share a bucket of some table with probability 0.0004.
PROJECTIONS, CELL, TABLES = 16, 2.0, 40
SEED = 20260101
#: A bucket of more vectors than this is compared in blocks of so many; buckets of SHORT vectors are compared many at a time.
BLOCK, SHORT = 512, 12
_KEYS = ("key", "i", "j")


class Hashing:
    """Names, of 64 bits, of a label and bucket for each unit vector and table; what is drawn for a length of vectors is kept."""

    def __init__(self) -> None:
        self.drawn: dict[int, tuple] = {}

    def _draw(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self.drawn:
            rng = np.random.default_rng([SEED, dim])
            a = rng.standard_normal((dim, TABLES * PROJECTIONS))
            b = rng.uniform(0, CELL, TABLES * PROJECTIONS)
            odd = rng.integers(0, 2**63, (TABLES, PROJECTIONS), dtype=np.int64).astype(np.uint64) | np.uint64(1)
            self.drawn[dim] = a, b, odd
        return self.drawn[dim]

    def __call__(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        a, b, odd = self._draw(unit.shape[1])
        cells = np.floor((unit @ a + b) / CELL).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
        table = np.arange(TABLES, dtype=np.uint64) * MIX[0]
        return mixed(mixed((cells * odd).sum(axis=2, dtype=np.uint64) + table) + label.view(np.uint64)[:, None] * MIX[2]).view(np.int64)


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, as bytes, at length 1 in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components leave the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _flat(kind: str):
    """Lists of numbers as bytes."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(np.diff(lists.offsets.to_numpy()))
            vectors = [x.tobytes() for x in np.split(values, ends[:-1])] if len(ends) else []
            yield batch.drop_columns(["embedding"]).append_column("vector", pa.array(vectors, pa.binary()))

    return flat


def _spread(kind: str):
    """A row for each vector and table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Hashing()
        for batch in batches:
            vec, label, vectors = batch.column("vec").to_numpy(), batch.column("label").to_numpy(), batch.column("vector").to_pylist()
            for at in _by_length(vectors):
                for part in np.array_split(at, -(-len(at) // 500)):
                    keys = signatures(units([vectors[k] for k in part], kind), label[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec[part], TABLES)), pa.array(keys.reshape(-1))], ["vec", "key"])

    return spread


def _compare(least: float, kind: str):
    """Of rows sorted by bucket and pair of blocks: links, the sum of copies of what a vector is linked with, and a smaller vector that it is connected with."""
    signatures = Hashing()

    def told(cols: dict, a: np.ndarray, b: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the linked rows `a` and `b` of one bucket that no earlier table brings together."""
        first = np.zeros(len(a), bool)
        for at in range(0, len(a), 10_000):
            x, y = a[at : at + 10_000], b[at : at + 10_000]
            some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            signs = signatures(unit[some], cols["label"][some])
            sx, sy = signs[where[: len(x)]], signs[where[len(x) :]]
            first[at : at + 10_000] = (sx == sy).argmax(axis=1) == (sx == cols["key"][x][:, None]).argmax(axis=1)
        return a[first], b[first]

    def out(vec: np.ndarray, links: np.ndarray, peer: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(vec), pa.array(links.astype(np.int64)), pa.array(peer)], ["vec", "links", "peer"])

    def short(cols: dict, rows: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = units([cols["vector"][k] for k in rows], kind)
        mine = {c: cols[c][rows] for c in ("vec", "label", "copies", "key")}
        for d in range(1, SHORT):
            a = np.flatnonzero(run[:-d] == run[d:])
            a = a[mine["label"][a] == mine["label"][a + d]]
            a = a[np.einsum("ij,ij->i", unit[a], unit[a + d]) >= least]
            a, b = told(mine, a, a + d, unit)
            if len(a):
                low = np.minimum(mine["vec"][a], mine["vec"][b])
                yield out(np.concatenate([mine["vec"][a], mine["vec"][b]]), np.concatenate([mine["copies"][b], mine["copies"][a]]), np.concatenate([low, low]))

    def large(rows: dict) -> Iterator[pa.RecordBatch]:
        n = len(rows["vec"])
        one_block = rows["i"][0] == rows["j"][0]
        for at in _by_length(rows["vector"]):
            unit = np.zeros((n, len(rows["vector"][at[0]]) // np.dtype(kind).itemsize))
            unit[at] = units([rows["vector"][k] for k in at], kind)
            x = at if one_block else at[rows["side"][at] == 0]
            y = at if one_block else at[rows["side"][at] == 1]
            if not len(x) or not len(y):
                continue
            near = np.zeros((n, n), bool)
            near[np.ix_(x, y)] = (unit[x] @ unit[y].T >= least) & (rows["label"][x][:, None] == rows["label"][y][None, :])
            np.fill_diagonal(near, False)
            near |= near.T
            if not near.any():
                continue
            i, j = told(rows, *np.nonzero(np.triu(near)), unit)
            links = np.bincount(i, rows["copies"][j], n) + np.bincount(j, rows["copies"][i], n)
            peer = np.arange(n)
            while True:
                low = np.minimum(np.where(near, peer[None, :], n).min(axis=1), peer)
                if (low == peer).all():
                    break
                peer = low
            known = np.flatnonzero((links > 0) | (peer != np.arange(n)))
            yield out(rows["vec"][known], links[known], rows["vec"][peer[known]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in _whole_runs(batches, _KEYS):
            size = np.diff(cuts)
            few = (cols["i"][cuts[:-1]] == cols["j"][cuts[:-1]]) & (size <= SHORT)
            rows, run = np.flatnonzero(np.repeat(few & (size > 1), size)), np.repeat(np.arange(len(size)), size)
            for at in _by_length([cols["vector"][k] for k in rows]):
                yield from short(cols, rows[at], run[rows[at]])
            for k in np.flatnonzero(~few & (size > 1)):
                yield from large({c: v[cuts[k] : cuts[k + 1]] for c, v in cols.items()})

    return compare


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding, label).

    Vectors of one label are linked where their cosine, in double precision, is `least` or more and the hashing brings them together; vectors that are equal always are. Equal vectors are hashed once and count as often as they occur. Unit vectors are put in a bucket of each table; only ids travel for that, and vectors, once and as they came, for buckets of several. Large buckets are compared block by block, so that neither a row nor a task holds a bucket of any size, and a pair counts only in the first table that brings it together. Only sums of links and one edge for each vector leave a block.

    Null, zero, or not wholly finite vectors, null labels and null ids link with nothing; vectors of different lengths don't link; a null vec_id has a null component and isn't kept; rows that repeat vec_id, label and vector are one vector; an empty table gives no rows; other columns are not read. Sets the session's Arrow batches to 8 MB.
    """
    lean_batches(vectors.sparkSession)
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, numbers = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(numbers).alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(
        ~bad & F.exists("embedding", lambda x: x != 0)
    )
    keyed = good.select("vec_id", "label", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), "embedding")
    distinct = keyed.select("vec_id", "label", "k1", "k2").distinct()
    first = settle(distinct.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies")), "vectors")
    same = settle(distinct.join(first, ["label", "k1", "k2"]).select("vec_id", "vec", "copies"), "same")
    heads = keyed.join(first.withColumnRenamed("vec", "vec_id"), ["vec_id", "label", "k1", "k2"]).dropDuplicates(["vec_id", "label", "k1", "k2"])
    heads = heads.select(F.col("vec_id").alias("vec"), "label", "copies", "embedding")
    signed = settle(heads.mapInArrow(_flat(kind), "vec long, label long, copies long, vector binary"), "signed")
    spread = signed.select("vec", "label", "vector").mapInArrow(_spread(kind), "vec long, key long")
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    dealt = spread.join(full, "key").withColumn("blocks", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "vec"
    ).join(signed, "vec")
    found = settle(
        dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_compare(least, kind), "vec long, links long, peer long"), "found"
    )
    drop_table(signed)
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec").alias("a"), F.col("peer").alias("b")))
    told = same.join(links, "vec", "left").join(parts, same["vec"] == F.col("node"), "left").select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec").alias("component")
    )
    # rows that share a vec_id but not the vector are one node: it has the links of the one with most
    told = told.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(told.withColumnRenamed("vec_id", "told_id"), F.col("vec_id") == F.col("told_id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
