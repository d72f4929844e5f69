"""N-gram Jaccard join: fixed-size subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import components, drop_table, fresh, lean_batches, settle
from ringloom.llm.tokens import MIX, mixed, word_hashes

#: Words in a shingle, and the least Jaccard similarity of linked sets in 100.
WIDTH, LEAST = 3, 90
#: log2 of the buckets in which shingles are counted to put rare ones first; the counts are 4 MB, whatever the corpus.
COUNT_BITS = 20
#: log2 of the bits of the filter that tells which documents are candidates: 8 MB.
FILTER_BITS = 26
#: An inverted list of more members than this is compared in blocks of so many.
BLOCK = 1024


# ---- sets ----


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of the shingles of all `texts`, one text after the other, repeated ones too, and how many each text has. A text of fewer words is one shingle, one without words has none."""
    h, n = word_hashes(texts)
    k = np.where(n >= width, n - width + 1, n > 0)
    out = np.zeros(int(k.sum()), np.uint64)
    place, first = np.cumsum(k) - k, np.cumsum(n) - n
    for m in range(1, width):
        at = np.flatnonzero(n == m)
        out[place[at]] = _chain(h, first[at], m)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))
    out[np.repeat(n >= width, k)] = _chain(h, np.flatnonzero(left >= width), width)
    return out, k


def _chain(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = mixed(out * MIX[0] + h[at + i])
    return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    h, k = shingle_hashes(texts, width)
    ends = np.cumsum(k)
    return [np.unique(h[e - n : e]) for n, e in zip(k, ends, strict=True)]


def overlap(n: int, m: int, least: int = LEAST) -> int:
    """The fewest common elements of linked sets of n and m elements."""
    return -(-least * (n + m) // (100 + least))


def prefix(n: int, least: int = LEAST) -> int:
    """Two linked sets share one of their so many first elements, in any order that all sets keep to."""
    return n - -(-least * n // 100) + 1


def partners(n: int, least: int = LEAST) -> range:
    """The sizes that a set linked with one of size n can have."""
    return range(-(-least * n // 100), 100 * n // least + 1)


def subsets(n: int, most: int, least: int = LEAST) -> int:
    """How many fixed-size subsets a set of n elements is entered under, for partners of which one has `most` elements at most."""
    return sum(
        comb(n, overlap(n, m, least)) for m in partners(n, least) if min(n, m) <= most and overlap(n, m, least) <= min(n, m)
    )


def boundary(least: int = LEAST) -> int:
    """The largest size for which subsets cost less than inverted lists, for it and all below.

    A set costs a row for each subset one way; the other way, a row for each element of its prefix, and for each of these the reading of one candidate's set.
    """
    n = 1
    while subsets(n + 1, n + 1, least) <= prefix(n + 1, least) * (1 + 2 * (n + 1)):
        n += 1
    return n


def subset_keys(s: np.ndarray, most: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(keys, checks): 126 bits of hash that name a pair of sizes and a subset, with the set's side in the two lowest bits of the key: 0 where the sizes are equal, 1 for the smaller size, 2 for the larger. Two sets, of which one has `most` elements at most, are linked exactly if they have a key and check in common, but for its side, and either sides 0 or different ones."""
    n, keys, checks = len(s), [s[:0]], [s[:0]]
    first, second = mixed(s + MIX[2]), mixed(s * MIX[2] + MIX[0])
    for m in partners(n, least):
        c = overlap(n, m, least)
        if min(n, m) > most or c > min(n, m):
            continue
        gone = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(comb(n, n - c), n - c)
        seed = np.uint64((min(n, m) << 32 | max(n, m)) * int(MIX[0]) & 2**64 - 1)
        key, check = (mixed(x.sum(keepdims=True, dtype=np.uint64) - x[gone].sum(axis=1, dtype=np.uint64) + seed) for x in (first, second))
        keys.append(key << np.uint64(2) | np.uint64(0 if n == m else 1 if n < m else 2))
        checks.append(check)
    return np.concatenate(keys), np.concatenate(checks)


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap with four bits for each element or more, each bit the parity of its elements: bits that differ are no more than elements that differ."""
    bits = parity_bits(len(s))
    out = np.bincount((s >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(out.astype(np.uint8))


def parity_bits(n: int) -> int:
    return 1 << max(6, (4 * n - 1).bit_length())


def may_link(n, m, differ, least: int = LEAST):
    """Whether sets whose bitmaps differ in `differ` bits can be linked: n + m - 2 * overlap elements may differ."""
    return differ <= n + m - 2 * -(-least * (n + m) // (100 + least))


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= least * (len(a) + len(b) - common)


def _longs(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


# ---- stages on the executors ----


def _counts(width: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << COUNT_BITS, np.int64), False
        for batch in batches:
            found, _ = shingle_hashes(batch.column("text"), width)
            some |= len(found) > 0
            total += np.bincount((found >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        if some:
            parts = total.reshape(256, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(256, dtype=np.int32)), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())],
                ["part", "counts"],
            )

    return counts


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            c = np.frombuffer(counts.as_buffer(), "<i4").astype(np.int64)
            total[part] = total[part] + c if part in total else c
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for c in total.values()], pa.binary())],
        ["part", "counts"],
    )


def _summary(width: int, least: int, light: int, counts):
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        widest = partners(light, least).stop - 1
        for batch in batches:
            n, k1, k2, tokens, keys, checks, bits = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                name = _named(s.tobytes())
                n.append(len(s))
                k1.append(name[0])
                k2.append(name[1])
                first = s[:0]
                bits.append(parity(s).tobytes() if len(s) > light else b"")
                if len(s) > light:
                    order = np.lexsort((s, common[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                    first = s[order[: prefix(len(s), least)]]
                tokens.append(_longs(first))
                key, check = subset_keys(s, light, least) if 0 < len(s) <= widest else (s[:0], s[:0])
                keys.append(_longs(key))
                checks.append(_longs(check))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(tokens, longs), pa.array(keys, longs), pa.array(checks, longs), pa.array(bits, pa.binary())],
                ["doc_id", "n", "k1", "k2", "tokens", "keys", "checks", "bits"],
            )

    return summary


def _sets(width: int, wanted):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            rows = batch.filter(pa.array((bits[h >> 3] >> (h & 7)) & 1 == 1))
            found = [s.tobytes() for s in shingle_sets(rows.column("text"), width)]
            names = [_named(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([k for k, _ in names], pa.int64()), pa.array([k for _, k in names], pa.int64()), pa.array(found, pa.binary())],
                ["doc", "k1", "k2", "elements"],
            )

    return sets


def _named(elements: bytes) -> tuple[int, int]:
    """128 bits that stand for a set."""
    h = hashlib.blake2b(elements, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _verify(least: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
                for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _likely(least: int):
    """Of pairs with their sizes and bitmaps, those that the bitmaps don't rule out."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ba, bb = batch.column("ba").to_pylist(), batch.column("bb").to_pylist()
            differ = np.zeros(batch.num_rows, np.int64)
            widths = np.array([(len(x), len(y)) for x, y in zip(ba, bb, strict=True)], np.int64).reshape(-1, 2)
            for wa, wb in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == (wa, wb)).all(axis=1))
                x, y = (_folded(np.frombuffer(b"".join(b[i] for i in at), np.uint8).reshape(len(at), -1), min(wa, wb)) for b in (ba, bb))
                differ[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(may_link(na, nb, differ, least)))

    return likely


_LIST = ("token", "class", "i", "j")
LISTED = "token long, class int, i int, j int, side int, doc long, n long, place int, comp long"
#: Rows of lists, and pairs: those have the second document in b, its size in nb, and no list.
LEFT = LISTED + ", b long, nb long"
#: Lists of so many members are compared many at a time, each member with those after it.
SHORT = 12


def _sides(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(rows["side"] == 0)
    return left, left if rows["i"][0] == rows["j"][0] else np.flatnonzero(rows["side"] == 1)


def _fit(rows: dict, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which rows `a` and `b`, of one list each, belong to different components, and have sizes and places of the list's element that leave room for the overlap that they need."""
    n, comp, rest = rows["n"], rows["comp"], rows["n"] - rows["place"]
    ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
    return ok & (np.minimum(rest[a], rest[b]) >= -(-least * (n[a] + n[b]) // (100 + least)))


def _possible(rows: dict, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Of one list, which of `a` and which of `b` fit."""
    ok = _fit(rows, a[:, None], b[None, :], least)
    return np.triu(ok, 1) if a is b else ok


def _with_partner(least: int):
    """Of rows sorted by list and pair of blocks, the possible pairs of each list, or, where these are more than the rows, the rows that have a possible partner."""

    def rows_of(cols: dict) -> pa.RecordBatch:
        none = pa.nulls(len(cols["doc"]), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(cols[k]) for k in _names(LISTED)), none, none], _names(LEFT))

    def pairs_of(cols: dict, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = np.where(cols["doc"][a] > cols["doc"][b], a, b), np.where(cols["doc"][a] > cols["doc"][b], b, a)
        told = {"doc": cols["doc"][a], "n": cols["n"][a], "b": cols["doc"][b], "nb": cols["n"][b]}
        kinds = [(k, pa.int32() if kind == "int" else pa.int64()) for k, kind in (x.split() for x in LEFT.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(told[k]) if k in told else pa.nulls(len(a), t) for k, t in kinds], _names(LEFT))

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in _whole_runs(batches, _LIST):
            size = np.diff(cuts)
            one_block = cols["i"][cuts[:-1]] == cols["j"][cuts[:-1]]
            short = np.repeat(one_block & (size <= SHORT), size)
            run = np.repeat(np.arange(len(size)), size)
            for d in range(1, min(SHORT, int(size.max(initial=0)))):
                a = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
                a = a[_fit(cols, a, a + d, least)]
                if len(a):
                    yield pairs_of(cols, a, a + d)
            for k in np.flatnonzero((size > 1) & ~(one_block & (size <= SHORT))):
                rows = {c: v[cuts[k] : cuts[k + 1]] for c, v in cols.items()}
                a, b = _sides(rows)
                if not len(a) or not len(b):
                    continue
                ok = _possible(rows, a, b, least)
                i, j = np.nonzero(ok)
                if 0 < len(i) <= len(rows["doc"]):
                    yield pairs_of(rows, a[i], b[j])
                elif len(i):
                    keep = np.union1d(a[ok.any(axis=1)], b[ok.any(axis=0)])
                    yield rows_of({c: v[keep] for c, v in rows.items()})

    return with_partner


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _across(least: int):
    """Of rows sorted by list and pair of blocks, the possible pairs that the bitmaps don't rule out either."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, _LIST):
            a, b = _sides(rows)
            if not len(a) or not len(b):
                continue
            ok, bits, n = _possible(rows, a, b, least), rows["bits"], rows["n"]
            wide_a, wide_b = np.array([len(bits[k]) for k in a]), np.array([len(bits[k]) for k in b])
            for wa in np.unique(wide_a):
                for wb in np.unique(wide_b):
                    # bitmaps are compared at the narrower width; wider ones fold by exclusive or
                    i, j, width = np.flatnonzero(wide_a == wa), np.flatnonzero(wide_b == wb), min(wa, wb)
                    x, y = (_folded(np.frombuffer(b"".join(bits[k] for k in at), np.uint8).reshape(len(at), -1), width).copy().view(np.uint64) for at in (a[i], b[j]))
                    for at, row in zip(i, x, strict=True):
                        differ = np.bitwise_count(row[None, :] ^ y).sum(axis=1, dtype=np.int64)
                        ok[at, j] &= may_link(n[a[at]], n[b[j]], differ, least)
            i, j = np.nonzero(ok)
            if len(i):
                x, y = rows["doc"][a[i]], rows["doc"][b[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    return across


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one a row, at a narrower width: halves fold by exclusive or."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict, np.ndarray]]:
    """Of rows sorted by `keys`, whole runs of equal keys, many at a time: columns (numbers in numpy, bytes in a list), and where each run begins, with the end. Only a run that isn't finished is held."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {
            c: batch.column(c).to_pylist() if pa.types.is_binary(batch.column(c).type) else batch.column(c).to_numpy()
            for c in batch.schema.names
        }
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
            new[0] |= not held or held[-1][k][-1] != cols[k][0]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(cols)
            continue
        last = int(cuts[-1])
        if held and cuts[0] == 0:
            whole = _glued(held)
            yield whole, np.array([0, len(whole[keys[0]])])
            held = []
        if last:
            done = _glued([*held, {c: v[:last] for c, v in cols.items()}])
            before = len(done[keys[0]]) - last
            yield done, np.concatenate([[0], cuts[cuts > 0] + before] if before else [cuts])
        held = [{c: v[last:] for c, v in cols.items()}]
    if held:
        whole = _glued(held)
        yield whole, np.array([0, len(whole[keys[0]])])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict]:
    """Of rows sorted by `keys`, each run of equal keys."""
    for cols, cuts in _whole_runs(batches, keys):
        for s, e in itertools.pairwise(cuts.tolist()):
            yield {c: v[s:e] for c, v in cols.items()}


def _glued(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {
        c: list(itertools.chain.from_iterable(p[c] for p in parts)) if isinstance(parts[0][c], list) else np.concatenate([p[c] for p in parts])
        for c in parts[0]
    }


# ---- the join ----


def shingle_counts(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How often shingles of each of 2^COUNT_BITS hash buckets occur, over all documents. Buckets are added up on the executors; 4 MB reach the driver, whatever the corpus."""
    parts = docs.select("text").mapInArrow(_counts(width), "part int, counts binary").repartition(64, "part")
    total = np.zeros((256, (1 << COUNT_BITS) // 256), np.int64)
    for row in parts.mapInArrow(_added, "part int, counts binary").collect():
        total[row.part] = np.frombuffer(row.counts, "<i4")
    return total.reshape(-1).astype(np.int32)


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashed `doc` ids, of 8 MB at most, whatever their number."""
    h = _bit(F.col("doc")) + 1
    rows = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")
    )
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in rows.collect():
        at = (row.bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _bit(doc):
    return F.pmod(F.xxhash64(doc), F.lit(1 << FILTER_BITS))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """Those of the settled `pairs` (a, b) whose whole sets are linked. Only documents in pairs are shingled again and sent."""
    names = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(_bit_filter(names))
    text = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _bit(F.col("doc_id")).alias("h"))
    found = text.mapInArrow(_sets(width, wanted), "doc long, k1 long, k2 long, elements binary").join(names, "doc")
    sets = settle(found.groupBy("doc").agg(F.min_by("elements", F.struct("k1", "k2")).alias("elements")), "sets")
    a = sets.select(F.col("doc").alias("a"), F.col("elements").alias("ea"))
    b = sets.select(F.col("doc").alias("b"), F.col("elements").alias("eb"))
    out = settle(pairs.join(a, "a").join(b, "b").select("a", "b", "ea", "eb").mapInArrow(_verify(least), "a long, b long"), "verified")
    drop_table(sets)
    return out


def _with_bitmaps(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """`pairs` (a, b, na, nb) with the bitmap of each side, ba and bb."""
    one = lambda x: bits.select(F.col("doc").alias(x), F.col("bits").alias("b" + x))
    return pairs.join(one("a"), "a").join(one("b"), "b")


def _one_a_document(table: DataFrame) -> DataFrame:
    """The rows of `table` that have a doc_id and shingles; of a doc_id with several different sets, those of the smallest hash."""
    known = table.filter("doc_id IS NOT NULL AND n > 0")
    name = F.struct("k1", "k2")
    several = known.groupBy(F.col("doc_id").alias("several")).agg(F.min(name).alias("lo"), F.max(name).alias("hi")).filter("lo <> hi")
    # written, so that it is known to be small, as a rule, before it is joined
    several = settle(several.select("several", "lo"), "several")
    return known.join(several, F.col("doc_id") == F.col("several"), "left").filter(F.col("lo").isNull() | (name == F.col("lo"))).drop("several", "lo")


def classes(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`: documents whose sets of `width`-word shingles have a Jaccard similarity of `least` / 100 or more are linked, and a component is named by the smallest doc_id reachable.

    Small sets, up to the size where the costs cross (boundary()), are entered under fixed-size subsets, of the overlap that a pair of sizes needs: sets that share one are linked, and all are joined to the smallest of their key, without pairs. Larger sets are entered in the inverted lists of their rarest shingles. In each list, members of similar size are first held against the list's smallest; lists whose members then still belong to several components are compared across these components, in blocks. Short lists give pairs, each told once; longer ones are compared with bitmaps that rule out most pairs; what remains is decided on the whole sets. So copies of copies cost a row each, and no pair is left out but those already known to be connected.

    Equal sets count as one throughout. Words are runs of anything but ASCII white space, with A-Z lower-cased; a text of fewer words is one shingle; a null, empty or blank text has no shingles and no links. Rows that repeat a doc_id are one document; where their sets differ, it has the one of the smallest hash, and each row tells its own n_shingles. A null doc_id has no component (null). An empty table gives no rows; only doc_id and text are read. Sets the session's Arrow batches to 8 MB.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = boundary(least)
    counts = spark.sparkContext.broadcast(shingle_counts(docs, width))
    schema = "doc_id long, n long, k1 long, k2 long, tokens array<long>, keys array<long>, checks array<long>, bits binary"
    table = settle(docs.mapInArrow(_summary(width, least, light, counts), schema), "shingles")
    known = _one_a_document(table)

    # equal sets
    first = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"))
    same = settle(known.select("doc_id", "k1", "k2").join(first, ["k1", "k2"]).select("doc_id", "doc").distinct(), "same")

    # light sets
    keys = known.select("doc_id", F.explode(F.arrays_zip("keys", "checks")).alias("k")).select(
        "doc_id", F.shiftright("k.keys", 2).alias("key"), "k.checks", F.col("k.keys").bitwiseAND(F.lit(3)).alias("side")
    )
    # all sets of one side are linked with all of the other, so where both are there, the key's sets are connected
    least_doc = keys.groupBy("key", "checks").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("c"), F.min("side").alias("x"), F.max("side").alias("y"))
    least_doc = least_doc.filter("c > 1 AND (y = 0 OR x < y)").select("key", "checks", "b")
    sure = keys.join(least_doc, ["key", "checks"]).select(F.col("doc_id").alias("a"), "b").filter("a <> b")
    sure = sure.union(same.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).filter("a <> b"))

    # heavy sets: lists of at least two different sets of like size
    reps = same.filter("doc_id = doc").select("doc")
    listed = known.join(reps, F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("doc"), "n", "tokens").dropDuplicates(["doc"])
    listed = listed.select("doc", "n", F.posexplode("tokens").alias("place", "token"))
    shared = listed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / (least - 1)))).cast("int")
    members = listed.join(shared, "token").select("token", "doc", "n", "place", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    members = settle(members, "lists")
    heads = members.groupBy("token", "class").agg(F.min(F.struct("doc", "n", "place")).alias("head"), F.count(F.lit(1)).alias("c"))
    lists = settle(members.join(heads.filter("c > 1"), ["token", "class"]), "lists")
    drop_table(members)

    # all of a list against its smallest. The first element that two sets share leaves room for the overlap that they need
    need = F.ceil(F.lit(least) * (F.col("n") + F.col("head.n")) / F.lit(100 + least))
    room = F.least(F.col("n") - F.col("place"), F.col("head.n") - F.col("head.place")) >= need
    near = F.lit(100) * F.least("n", "head.n") >= F.lit(least) * F.greatest("n", "head.n")
    stars = lists.filter(near & room & (F.col("doc") != F.col("head.doc")))
    stars = settle(stars.select(F.col("doc").alias("a"), F.col("head.doc").alias("b"), F.col("n").alias("na"), F.col("head.n").alias("nb")).distinct(), "stars")
    bits = settle(known.select(F.col("doc_id").alias("doc"), "bits").join(lists.select("doc").distinct(), "doc").dropDuplicates(["doc"]), "bits")
    likely = settle(_with_bitmaps(stars, bits).mapInArrow(_likely(least), "a long, b long"), "likely")
    links = sure.union(_verified(likely, docs, width, least))
    drop_table(likely)
    parts = settle(components(links), "parts")

    # lists that still hold several components, across these
    placed = lists.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select(
        "token", "class", "doc", "n", "place", F.coalesce("component", "doc").alias("comp")
    )
    placed = settle(placed, "placed")
    drop_table(lists)
    several = placed.groupBy("token", "class").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).filter("x < y")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    dealt = placed.join(several.select("token", "class", "c"), ["token", "class"]).withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "token", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "n", "place", "comp",
    )
    # bitmaps are sent for distinct pairs, and for rows of long lists that sizes and places leave a partner
    left = settle(dealt.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(_with_partner(least), LEFT), "left")
    drop_table(placed)
    apart = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = left.filter("b IS NOT NULL").select(F.col("doc").alias("a"), "b", F.col("n").alias("na"), "nb").distinct().join(apart, ["a", "b"], "left_anti")
    pairs = _with_bitmaps(settle(pairs, "pairs"), bits).mapInArrow(_likely(least), "a long, b long")
    rows = left.filter("b IS NULL").drop("b", "nb").join(bits, "doc").repartition(*_LIST).sortWithinPartitions(*_LIST)
    crossing = rows.mapInArrow(_across(least), "a long, b long").join(apart, ["a", "b"], "left_anti")
    crossing = settle(pairs.union(crossing).distinct(), "crossing")
    for old in (left, bits, stars):
        drop_table(old)
    whole = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_verified(crossing, docs, width, least)))
    out = table.select("doc_id", F.col("n").alias("n_shingles")).join(whole, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of `docs` without those whose component has a smaller doc_id; documents with no links, no words or no doc_id stay. Rows that repeat the doc_id that stays are all kept."""
    gone = fresh(docs, "gone")
    found = classes(docs, width, least).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"] == found[gone], "left_anti")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
