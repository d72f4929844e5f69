"""Windows that end phrases, and the choice of triggers for sequences that would have none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME, REMAINDER_PRIME, primes_for, string_hash
from ringloom.operators.durable import scratch, settle


def ring_hashes(codes: np.ndarray, w: int, prime: int) -> np.ndarray:
    """Hash of the window of w symbols that ends at each place, around the sequence, over all places at once, three symbols a step."""
    codes = codes.astype(np.int64)
    three = (np.roll(codes, 2) * 256 + np.roll(codes, 1)) * 256 + codes
    h = np.zeros(len(codes), np.int64)
    for j in range(w - 1, w - 1 - w % 3, -1):
        h = (h * 256 + np.roll(codes, j)) % prime
    for j in range(w - w % 3 - 3, -1, -3):
        h = ((h << 24) + np.roll(three, j)) % prime
    return h


def codes_of(seq: str) -> np.ndarray:
    """A sequence's symbols by code point."""
    return np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), "<u4")


def window_hashes_sql(seqs: DataFrame, w: int, prime: int = PLAIN_PRIME) -> DataFrame:
    """(seq_id, end_pos, hash) by column functions alone; for short sequences, as each window is cut from the whole."""
    rows = seqs.select("seq_id", "seq", F.length("seq").alias("len")).filter(F.col("len") >= w)
    rows = rows.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    window = F.substring(F.concat("seq", "seq"), F.pmod(F.col("e") - w + 1, F.col("len")) + 1, F.lit(w))
    return rows.select("seq_id", F.col("e").cast("long").alias("end_pos"), string_hash(window, prime).alias("hash"))


def window_hashes(seqs: DataFrame, w: int, prime: int = PLAIN_PRIME) -> DataFrame:
    """(seq_id, end_pos, hash) of each window of w symbols, around the sequence; sequences shorter than w have none."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_id").to_numpy()
            for pack in packs(batch.column("seq").to_pylist(), w):
                for start, h in pack.hashes(prime):
                    for at in range(0, len(h), 100_000):
                        part = h[at : at + 100_000]
                        row, end = pack.places(np.arange(start + at, start + at + len(part)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(end), pa.array(part)], ["seq_id", "end_pos", "hash"])

    return seqs.select("seq_id", "seq").mapInArrow(hashed, "seq_id long, end_pos long, hash long")


def trigger_positions(seqs: DataFrame, w: int, p: int, primes=(PLAIN_PRIME,), remainders=(0,)) -> DataFrame:
    """(seq_id, end_pos) of the windows whose hash by any of `primes` leaves any of `remainders` modulo p."""
    return seqs.select("seq_id", "seq").mapInArrow(_ends(w, p, tuple(primes), tuple(remainders)), "seq_id long, end_pos long")


#: Symbols that are hashed at once, so that memory follows a sequence's length by 5 bytes a symbol only.
PIECE = 1 << 20
#: Symbols of short sequences that are hashed together.
PACK = 1 << 16


def hash_pieces(codes: np.ndarray, w: int, prime: int) -> Iterator[tuple[int, np.ndarray]]:
    """(at, hashes) of the windows that end at the places from `at` on, a piece after the other; none if there are fewer than w places."""
    n = len(codes)
    for at in range(0, n if n >= w else 0, PIECE):
        yield at, ring_hashes(codes.take(np.arange(at - w + 1, min(n, at + PIECE)), mode="wrap"), w, prime)[w - 1 :]


@dataclass
class Pack:
    """Some of a batch's sequences, hashed together: a step costs the same for many short ones as for one. Places are counted through all of them."""

    #: Numbers of the sequences in the batch, each of w symbols or more, and where each begins among the places.
    rows: np.ndarray
    starts: np.ndarray
    size: int
    w: int
    codes: np.ndarray
    #: Where the places are in `codes`, which has the w - 1 symbols before each sequence too, around it; None for a single sequence as it is.
    own: np.ndarray | None

    def hashes(self, prime: int) -> Iterator[tuple[int, np.ndarray]]:
        """(at, hashes) of the windows that end at the places from `at` on."""
        if self.own is None:
            yield from hash_pieces(self.codes, self.w, prime)
        else:
            yield 0, ring_hashes(self.codes, self.w, prime)[self.own]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence's number and the place in it, for each of the ascending places `at`."""
        which = np.searchsorted(self.starts, at, "right") - 1
        return self.rows[which], at - self.starts[which]

    def hit(self, p: int, primes, remainders) -> np.ndarray:
        """Which places end a window that is a trigger."""
        return _hit(self.size, self.hashes, p, primes, remainders)


def packs(seqs: list[str], w: int) -> Iterator[Pack]:
    """The sequences of w symbols or more, in order; one that is as long as a pack is its own."""
    held, size = [], 0

    def packed() -> Pack:
        sizes = np.array([len(seqs[i]) for i in held])
        starts = np.cumsum(sizes) - sizes
        codes = codes_of("".join([seqs[i][len(seqs[i]) - w + 1 :] + seqs[i] for i in held]))
        own = np.arange(size) + np.repeat((w - 1) * np.arange(1, len(held) + 1), sizes)
        return Pack(np.array(held), starts, size, w, codes, own)

    for i, seq in enumerate(seqs):
        n = len(seq)
        if n < w:
            continue
        if held and size + n > PACK:
            yield packed()
            held, size = [], 0
        if n >= PACK:
            yield Pack(np.array([i]), np.array([0]), n, w, codes_of(seq), None)
        else:
            held.append(i)
            size += n
    if held:
        yield packed()


def _hit(n: int, hashes: Callable[[int], Iterator[tuple[int, np.ndarray]]], p: int, primes, remainders) -> np.ndarray:
    hit = np.zeros(n, bool)
    for prime in primes:
        for at, h in hashes(prime):
            rest = h % p
            hit[at : at + len(h)] |= rest == remainders[0] if len(remainders) == 1 else np.isin(rest, remainders)
    return hit


def trigger_mask(codes: np.ndarray, w: int, p: int, primes, remainders) -> np.ndarray:
    """Which places end a window that is a trigger."""
    return _hit(len(codes), lambda prime: hash_pieces(codes, w, prime), p, primes, remainders)


def _ends(w: int, p: int, primes, remainders):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_id").to_numpy()
            for pack in packs(batch.column("seq").to_pylist(), w):
                row, e = pack.places(np.flatnonzero(pack.hit(p, primes, remainders)))
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(e)], ["seq_id", "end_pos"])

    return ends


def prime_masks(seqs: DataFrame, w: int, p: int, primes=None) -> DataFrame:
    """(seq_id, mask): bit i is set if prime i gives the sequence a trigger."""
    primes = primes_for(w) if primes is None else tuple(primes)

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for pack in packs(batch.column("seq").to_pylist(), w):
                for i, q in enumerate(primes):
                    found[pack.rows] |= np.logical_or.reduceat(pack.hit(p, (q,), (0,)), pack.starts).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(found)], ["seq_id", "mask"])

    return seqs.select("seq_id", "seq").mapInArrow(masks, "seq_id long, mask long")


def _remainders(pack: Pack, p: int, prime: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, remainder, n) for each of a pack's sequences and the remainders among its windows, in that order."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, h in pack.hashes(prime):
        row, _ = pack.places(np.arange(at, at + len(h)))
        keys, n = np.unique(row * p + h % p, return_counts=True)
        both = np.concatenate([held[0], keys])
        keys, where = np.unique(both, return_inverse=True)
        held = keys, np.bincount(where, np.concatenate([held[1], n]), len(keys)).astype(np.int64)
    return held[0] // p, held[0] % p, held[1]


def remainder_histogram(seqs: DataFrame, w: int, p: int, prime: int = REMAINDER_PRIME) -> DataFrame:
    """(seq_id, remainder, n): how often each remainder modulo p occurs among a sequence's windows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_id").to_numpy()
            for pack in packs(batch.column("seq").to_pylist(), w):
                row, rest, n = _remainders(pack, p, prime)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(rest), pa.array(n)], ["seq_id", "remainder", "n"])

    return seqs.select("seq_id", "seq").mapInArrow(counted, "seq_id long, remainder long, n long")


def select_primes(seqs: DataFrame, w: int, p: int, most: int, drop_nonprimitive: bool = False) -> list[int]:
    """Indexes of the primes chosen, in the order chosen: prime 0, then, for the first sequence by seq_id that none chosen serves, the lowest that does, until `most` are chosen.

    The chosen set only grows, so the next sequence that changes it is the first one left unserved: one row a round reaches the driver.
    """
    usable = primitive(seqs) if drop_nonprimitive else seqs
    with scratch(seqs.sparkSession):
        # sequences that the same primes serve are settled by the first of them
        masks = settle(prime_masks(usable, w, p).filter("mask > 0").groupBy("mask").agg(F.min("seq_id").alias("seq_id")), "masks")
        chosen = [0]
        while len(chosen) < most:
            have = sum(1 << i for i in chosen)
            first = masks.filter(F.col("mask").bitwiseAND(F.lit(have)) == 0).agg(F.min_by("mask", "seq_id")).first()[0]
            if first is None:
                break
            chosen.append((first & -first).bit_length() - 1)
    return chosen


def select_remainders(seqs: DataFrame, w: int, p: int, most: int, drop_nonprimitive: bool = False) -> list[int]:
    """Remainders chosen, in the order chosen: 0, then, for the first sequence that has none of those chosen, its rarest one, the smallest of equally rare ones, until `most` are chosen."""
    usable = primitive(seqs) if drop_nonprimitive else seqs
    with scratch(seqs.sparkSession):
        counts = remainder_histogram(usable, w, p).groupBy("seq_id").agg(F.sort_array(F.collect_set("remainder")).alias("has"), F.min(F.struct("n", "remainder"))["remainder"].alias("rarest"))
        counts = settle(counts.groupBy("has", "rarest").agg(F.min("seq_id").alias("seq_id")), "remainders")
        chosen = [0]
        while len(chosen) < most:
            served = F.arrays_overlap("has", F.array(*[F.lit(r).cast("long") for r in chosen]))
            first = counts.filter(~served).agg(F.min_by("rarest", "seq_id")).first()[0]
            if first is None:
                break
            chosen.append(first)
    return chosen


def filtered(seqs: DataFrame, w: int, p: int, primes=(PLAIN_PRIME,), remainders=(0,), drop_nonprimitive: bool = False) -> DataFrame:
    """(seq_id, seq, reason) of the sequences left out: powers, where these are dropped, and those without a trigger. Each is looked at where it is."""
    primes, remainders = tuple(primes), tuple(remainders)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, served = batch.column("seq").to_pylist(), np.zeros(batch.num_rows, bool)
            for pack in packs(texts, w):
                served[pack.rows] = np.logical_or.reduceat(pack.hit(p, primes, remainders), pack.starts)
            reasons = [None if ok else "no trigger" for ok in served.tolist()]
            if drop_nonprimitive:
                reasons = ["not primitive" if is_power(seq) else reason for seq, reason in zip(texts, reasons, strict=True)]
            out = batch.append_column("reason", pa.array(reasons, pa.string()))
            yield out.filter(out.column("reason").is_valid())

    return seqs.select("seq_id", "seq").mapInArrow(told, "seq_id long, seq string, reason string")


def is_power(seq: str) -> bool:
    """What is_primitive() denies, of a sequence that is at hand: whether a shorter shift leaves it as it is."""
    return not seq or (seq + seq).find(seq, 1) < len(seq)


def primitive(seqs: DataFrame) -> DataFrame:
    """The sequences (seq_id, seq) that are no powers."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not is_power(seq) for seq in batch.column("seq").to_pylist()], pa.bool_()))

    return seqs.select("seq_id", "seq").mapInArrow(kept, "seq_id long, seq string")
