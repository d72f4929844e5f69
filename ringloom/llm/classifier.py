"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import lean_batches, settle
from ringloom.llm.tokens import chained, word_hashes

#: Rows of labels of this fold of FOLDS are never looked at when fitting.
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
#: Buckets of word shapes, and the other features of a text.
SHAPES, OTHERS = 192, 12
FEATURES = SHAPES + OTHERS
STEPS, RATE = 2000, 0.02
#: The penalty on squared weights, and what few documents add to it: so much over their number.
PENALTY, PENALTY_OF_FEW = 2e-3, 30.0
#: The class prior is the least ratio of unlabelled to positive documents above a score that at least this share of the positive ones reach; scores are told in so many bins over [-REACH, REACH].
LEAST_TAIL, BINS, REACH = 0.5, 2048, 4.0
#: A linear score of -0.4 stands for a probability of (1 - 0.4) / 2 = 0.3, and so it does after squashing with this slope.
SLOPE = float(np.log(0.7 / 0.3) / 0.4)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


# ---- features ----


def kind_of(c: str) -> str:
    """The class of a character: upper-case and other letters, digits, each ASCII character that is neither, and others by category."""
    if c.isalpha():
        return "U" if c.isupper() else "l"
    return "0" if c.isdigit() else c if c.isascii() else unicodedata.category(c)[0]


def shape_bucket(kinds: str) -> int:
    """The bucket of a word's shape, the classes of its characters with runs of one class as one: `THE!!` is `U!`."""
    shape = [k for k, _ in groupby(kinds)]
    return int(sum(int(_AT[ord(k), min(i, PLACES - 1)]) for i, k in enumerate(shape)) % 2**64 % SHAPES)


#: Classes are told by the code of the character that names them; a shape's places beyond the last of PLACES count as that one.
PLACES = 64
_AT = np.random.default_rng(20260102).integers(0, 2**63, (128, PLACES), np.uint64)


class Featurizer:
    """Features of whole texts: how often each word shape occurs, and ratios of length, case, digits, symbols and repetition, worked out for a column of texts at once. Words are runs of anything but ASCII white space; for repetition, A-Z count as a-z. The classes of characters seen so far are kept."""

    def __init__(self) -> None:
        self.kind = np.zeros(0x110000, np.uint8)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if not out.all():
            for c in np.unique(codes[out == 0]).tolist():
                self.kind[c] = ord(kind_of(chr(c)))
            out = self.kind[codes]
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        """A row of features for each text; a null text counts as an empty one."""
        texts, rows = [t or "" for t in column.to_pylist()], len(column)
        hashes, n = word_hashes(column)
        some, count = np.maximum(n, 1), lambda row, w=None: np.bincount(row, w, rows)
        row = np.repeat(np.arange(rows), n)
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
        kinds = self._kinds(codes)
        space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, stop = edge[0::2], edge[1::2]
        chars = stop - start
        upto = lambda flag: np.concatenate([[0], np.cumsum(flag)])
        within = lambda flag: (u := upto(flag))[stop] - u[start]
        upper, digits, letters = (within(kinds == ord(k)) for k in "U0l")
        new = np.diff(kinds, prepend=0) != 0
        new[start] = True
        new &= ~space
        turns = np.flatnonzero(new)
        first = np.searchsorted(turns, start)
        place = np.arange(len(turns)) - np.repeat(first, np.diff(np.append(first, len(turns))))
        shape = np.add.reduceat(_AT[kinds[turns], np.minimum(place, PLACES - 1)], first) if len(first) else np.zeros(0, np.uint64)
        kind = (shape % np.uint64(SHAPES)).astype(np.int64)
        out = np.zeros((rows, FEATURES))
        out[:, :SHAPES] = np.sqrt(np.bincount(row * SHAPES + kind, minlength=rows * SHAPES).reshape(rows, SHAPES) / some[:, None])
        total = np.maximum(count(row, chars), 1)
        mean = total / some
        spread = np.sqrt(np.maximum(count(row, chars**2) / some - mean**2, 0))
        own = chained(row.astype(np.uint64), hashes)
        at = np.flatnonzero(row[2:] == row[:-2])
        lines = [[x for x in t.split("\n") if x] for t in texts]
        n_lines = np.array([len(x) for x in lines], np.int64)
        others = [
            n == 0, np.log1p(n), np.log1p(mean), np.log1p(spread), count(row, upper) / total, count(row, digits) / total, count(row, chars - upper - digits - letters) / total,
            _distinct(own, row, rows) / np.sqrt(some), count(row[1:][own[1:] == own[:-1]]) / np.maximum(n - 1, 1),
            np.where(n > 2, _distinct(chained(chained(own[at], hashes[at + 1]), hashes[at + 2]), row[at], rows) / np.maximum(n - 2, 1), 1.0),
            np.array([len(set(x)) for x in lines]) / np.maximum(n_lines, 1), np.log1p(n_lines) - np.log1p(n),
        ]
        out[:, SHAPES:] = np.stack(others, axis=1).reshape(rows, OTHERS)
        out[n == 0, SHAPES + 1 :] = 0
        return out.astype("<f4")


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different values each row has; no value is in two rows."""
    _, first = np.unique(values, return_index=True)
    return np.bincount(row[first], minlength=rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    featurizer = Featurizer()
    for batch in batches:
        found = featurizer(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "features"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of each row of `docs`: the texts are read once, here. Written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(rows.mapInArrow(_features, "doc_id long, features binary"), "features")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("features").to_pylist()), "<f4").reshape(-1, FEATURES)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


# ---- learning ----


class Moments:
    """The mean of [1, x][1, x]ᵀ over a set of documents: all that the risk of a linear score depends on under the squared loss."""

    def __init__(self, mean: np.ndarray, n: float = np.inf) -> None:
        self.mean, self.n = mean, n

    def under(self, shift: np.ndarray, scale: np.ndarray) -> Moments:
        """Those of (x - shift) / scale."""
        t = np.diag(np.concatenate([[1.0], 1 / scale]))
        t[1:, 0] = -shift / scale
        return Moments(t @ self.mean @ t.T, self.n)

    def loss(self, w: np.ndarray, y: int) -> tuple[float, np.ndarray]:
        """The mean of (w [1, x] - y)² / 4, and its gradient."""
        g = self.mean @ w
        return float(w @ g - 2 * y * g[0] + 1) / 4, (g - y * self.mean[0]) / 2


class Model:
    """A linear score of standardised features, squashed to a probability."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.weights = np.concatenate([[weights[0] - (weights[1:] * shift / scale).sum()], weights[1:] / scale])

    def linear(self, x: np.ndarray) -> np.ndarray:
        """Of rows [1, x]."""
        return (x * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SLOPE * self.linear(x), -30, 30)))


def risk(w: np.ndarray, positive: Moments, unlabelled: Moments, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: of positives as such, and of negatives, estimated as that of unlabelled documents as negatives less what the positives among them bring."""
    return prior * positive.loss(w, 1)[0], unlabelled.loss(w, -1)[0] - prior * positive.loss(w, -1)[0]


def fit(positive: Moments, unlabelled: Moments, prior: float) -> Model:
    """Minimise the non-negative unbiased risk (Kiryo et al., 2017) with the squared loss.

    Where the estimate of the negatives' risk falls below zero, the step goes up its gradient instead, so the model can't gain from calling positives negative. Full gradients, fixed start and steps: a fit repeats.
    """
    shift = unlabelled.mean[0, 1:]
    scale = np.maximum(np.sqrt(np.maximum(unlabelled.mean.diagonal()[1:] - shift**2, 0)), 0.02)
    p, u = positive.under(shift, scale), unlabelled.under(shift, scale)
    w, penalty = np.zeros(len(p.mean)), PENALTY + PENALTY_OF_FEW / u.n
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        up = u.loss(w, -1)[1] - prior * p.loss(w, -1)[1]
        gradient = prior * p.loss(w, 1)[1] + up if risk(w, p, u, prior)[1] >= 0 else -up
        gradient[1:] += penalty * w[1:]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        w = w - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, w)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from counts of positive and unlabelled documents by bins of a score that parts them: where only positives are, their share of the unlabelled ones is the ratio of the two tails (Blanchard et al., 2010)."""
    p, u = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (positive, unlabelled))
    far = p >= LEAST_TAIL
    return float(np.clip((u[far] / p[far]).min(), 0.02, 0.98)) if far.any() else 0.5


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each kind of document, rows of the sum of [1, x][1, x]ᵀ."""
    total = {k: np.zeros((FEATURES + 1, FEATURES + 1)) for k in (False, True)}
    for batch in batches:
        for kind in total:
            x = _matrix(batch.filter(batch.column("positive")) if kind else batch)
            total[kind] += x.T @ x
    for kind, rows in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(rows)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary())], ["positive", "part", "sums"]
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for kind, part, sums in zip(*(batch.column(c).to_pylist() for c in ("positive", "part", "sums")), strict=True):
            total[kind, part] = total.get((kind, part), 0) + np.frombuffer(sums, "<f8")
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in total], pa.bool_()), pa.array([p for _, p in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["positive", "part", "sums"]
    )


def moments(rows: DataFrame) -> tuple[Moments, Moments, int]:
    """Of positive and of all `rows` (positive, features), and how many are positive. Tasks send sums, which are added up by rows of the matrix; 0.7 MB reach the driver, whatever the corpus."""
    schema = "positive boolean, part int, sums binary"
    added = rows.mapInArrow(_sums, schema).repartition(64, "positive", "part").mapInArrow(_added, schema)
    total = {k: np.zeros((FEATURES + 1, FEATURES + 1)) for k in (False, True)}
    for r in added.collect():
        total[r.positive][r.part] = np.frombuffer(r.sums, "<f8")
    return *(Moments(total[k] / max(1.0, total[k][0, 0]), max(1.0, total[k][0, 0])) for k in (True, False)), int(total[True][0, 0])


def _binned(weights):
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(BINS, np.int64) for k in (False, True)}
        for batch in batches:
            at = np.clip((_matrix(batch) * weights.value).sum(axis=1) / REACH * BINS / 2 + BINS / 2, 0, BINS - 1).astype(np.int64)
            total[False] += np.bincount(at, minlength=BINS)
            total[True] += np.bincount(at[batch.column("positive").to_numpy(zero_copy_only=False)], minlength=BINS)
        for kind, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * BINS), pa.array(np.arange(BINS, dtype=np.int32)), pa.array(n)], ["positive", "bin", "n"])

    return binned


def train(found: DataFrame, labels: DataFrame) -> tuple[Model, float]:
    """The model and the class prior, from all documents of the written `found` (doc_id, features) outside the held-out fold: those labelled 1 are the trusted positives, and all, whatever their label, the unlabelled ones. Labels of 0 are not looked at.

    Under the squared loss, the risk depends on documents through sums alone, which Spark adds up over all of them: no sample is drawn. A first fit, with an even prior, parts positives from unlabelled documents; the prior is estimated from its scores, and the model fitted again with it. Without positives, a model that scores everything with 0.5 is returned.
    """
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct().withColumn("positive", F.lit(True))
    seen = found.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    rows = seen.join(trusted, F.col("doc_id") == F.col("id"), "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), "features")
    positive, unlabelled, n = moments(rows)
    if not n:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)), 0.5
    weights = found.sparkSession.sparkContext.broadcast(fit(positive, unlabelled, 0.5).weights)
    bins = rows.mapInArrow(_binned(weights), "positive boolean, bin int, n long").groupBy("positive", "bin").agg(F.sum("n").alias("n"))
    counts = {k: np.zeros(BINS) for k in (False, True)}
    for r in bins.collect():
        counts[r.positive][r.bin] = r.n
    prior = prior_of(counts[True], counts[False])
    return fit(positive, unlabelled, prior), prior


def _score(weights):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(np.zeros(FEATURES), np.ones(FEATURES), weights.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.score(_matrix(batch)))], ["doc_id", "score"])

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`: the probability that its label is 1, and whether that reaches CUT.

    Scores come from the whole text alone, which is read once. A null text counts as an empty one; rows that repeat score alike, and each counts when fitting; a null doc_id is scored and never used for fitting; an empty table gives no rows; only doc_id and text of `docs`, and doc_id and quality of `labels`, are read. The weights that are broadcast have a fixed size. Sets the session's Arrow batches to 8 MB.
    """
    lean_batches(docs.sparkSession)
    found = features(docs)
    model, _ = train(found, labels)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    out = found.mapInArrow(_score(weights), "doc_id long, score double")
    return out.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
