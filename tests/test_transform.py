"""Rotations, runs, parsing, the merge and inversion against definitions in plain Python."""

import itertools
import random
import time

import pytest

from ringloom.operators import borders, chunks, circular_sa, conjugates, durable, inverse, merge, phrases, ranking, runs, triggers
from ringloom.functions import PHRASE_PRIME, PLAIN_PRIME, PRIMES, REMAINDER_PRIME, border, is_primitive, string_hash
from ringloom.plans import api
from pyspark.sql import functions as F


def collection(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def by_definition(texts):
    k = 2 * max(map(len, texts))
    rows = []
    for i, s in enumerate(texts):
        for o in range(len(s)):
            rot = s[o:] + s[:o]
            rows.append(((rot * (k // len(rot) + 1))[:k], i, o, s[o - 1]))
    return [(pos, b, i, o) for pos, (_, i, o, b) in enumerate(sorted(rows))]


FIXTURES = [
    (["BANANA"], "NNBAAA", [5, 3, 1, 0, 4, 2], [0] * 6, [3], [("N", 2), ("B", 1), ("A", 3)]),
    (["AB", "A"], "ABA", [0, 0, 1], [1, 0, 0], [0, 1], [("A", 1), ("B", 1), ("A", 1)]),
    (["AB", "AB"], "BBAA", [0, 0, 1, 1], [0, 1, 0, 1], [0, 1], [("B", 2), ("A", 2)]),
    (["AB", "BA"], "BBAA", [0, 1, 1, 0], [0, 1, 0, 1], [0, 3], [("B", 2), ("A", 2)]),
]


@pytest.mark.parametrize(("texts", "ebwt", "gca", "da", "starts", "rle"), FIXTURES)
@pytest.mark.parametrize("method", [conjugates.sorted_rotations, circular_sa.sorted_rotations])
def test_fixtures(spark, method, texts, ebwt, gca, da, starts, rle):
    rows = method(collection(spark, texts)).cache()
    got = sorted(rows.collect())
    assert "".join(r.bwt for r in got) == ebwt
    assert [r.off for r in got] == gca
    assert [r.seq_id for r in got] == da
    assert sorted(r.pos for r in runs.i_positions(rows).collect()) == starts
    # a block of two positions makes runs cross blocks
    for block in (2, 1 << 16):
        assert [(r["head"], r["length"]) for r in sorted(runs.rle(rows, block).collect())] == rle
    assert sorted(map(tuple, runs.expand(runs.rle(rows)).collect())) == [(r.pos, r.bwt) for r in got]


def random_texts(rng, alphabet, n, low, high):
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)]
    out.append(out[0])
    turn = rng.randrange(len(out[1]))
    out.append(out[1][turn:] + out[1][:turn])
    out.append(out[2][: len(out[2]) // 2 + 1] * 2)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_doubling_is_the_definition(spark, seed):
    texts = random_texts(random.Random(seed), "AB", 5, 1, 9)
    got = circular_sa.sorted_rotations(collection(spark, texts)).select("pos", "bwt", "seq_id", "off").collect()
    assert sorted(map(tuple, got)) == by_definition(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_merge_is_the_definition(spark, seed):
    texts = random_texts(random.Random(seed), "ABCD", 6, 6, 40)
    seqs = collection(spark, texts)
    primes = PRIMES[:3]
    left_out = {r.seq_id for r in triggers.filtered(seqs, 4, 3, primes).collect()}
    used = seqs.filter(~F.col("seq_id").isin(list(left_out) or [-1]))
    order = [i for i in range(len(texts)) if i not in left_out]
    want = [(p, b, order[i], o) for p, b, i, o in by_definition([texts[i] for i in order])]
    found = phrases.phrases(used, 4, 3, primes).cache()
    words = phrases.dictionary(found).cache()
    parsed = phrases.parse(found, words).cache()
    assert words.agg(F.sum(F.col("occ") * (F.length("phrase") - 4))).first()[0] == sum(len(texts[i]) for i in order)
    assert sorted(map(tuple, merge.sorted_rotations(words, parsed, 4).collect())) == want
    spans = merge.blocks(words, parsed, 4).cache()
    assert sorted(map(tuple, merge.ebwt_from_blocks(spans).collect())) == [(p, b) for p, b, _, _ in want]
    rows = spark.createDataFrame([(p, b) for p, b, _, _ in want], "pos long, bwt string")
    expected = sorted(map(tuple, runs.rle(rows).collect()))
    assert sorted(map(tuple, merge.rle_from_blocks(spans, 4).collect())) == expected
    rows = spark.createDataFrame(want, "pos long, bwt string, seq_id long, off long").cache()
    ends = merge.blocks(words, parsed, 4, ends=True).cache()
    both = merge.blocks(words, parsed, 4, starts=True, ends=True).cache()
    assert sorted(map(tuple, both.select("start_pos", "bwt", "length").collect())) != [] and both.count() >= ends.count() == spans.count()
    for block in (4, 1 << 16):
        assert sorted(map(tuple, merge.samples_from_blocks(ends, block=block).collect())) == sorted(map(tuple, runs.samples(rows).collect()))
        assert sorted(map(tuple, merge.samples_from_blocks(both, True, block).collect())) == sorted(map(tuple, runs.samples(rows, True).collect()))
    assert sorted(r.pos for r in merge.i_positions_from_blocks(both).collect()) == [p for p, _, _, o in want if o == 0]


def test_samples_of_powers(spark):
    """Equal rotations of one sequence, cut by its own end or not."""
    rng = random.Random(31)
    texts = []
    for _ in range(8):
        base = "".join(rng.choice("ABC") for _ in range(rng.randint(5, 9)))
        turn = rng.randrange(len(base))
        texts += [base * rng.randint(1, 4), (base[turn:] + base[:turn]) * rng.randint(1, 3)]
    index = api.build(collection(spark, texts), w=4, p=10, trigger_mode="remainders", max_triggers=10, gca="samples", sample_starts=True, rle=True)
    want = by_definition(texts)
    rows = spark.createDataFrame(want, "pos long, bwt string, seq_id long, off long").cache()
    assert sorted(map(tuple, index.samples.collect())) == sorted(map(tuple, runs.samples(rows, True).collect()))
    assert sorted(r.pos for r in index.i_positions.collect()) == [p for p, _, _, o in want if o == 0]


def test_blocks_follow_groups(spark):
    """Starts and samples of a repetitive collection without a row for each of its rotations."""
    rng = random.Random(32)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    texts = [text[:i] + "T" + text[i + 1 :] for i in range(0, 3000, 75)]
    parts = api.segment(collection(spark, texts), 6, 20)
    spans = merge.blocks(parts.words, parts.parsed, 6, starts=True, ends=True).cache()
    assert spans.agg(F.sum("length")).first()[0] == 120_000
    assert spans.count() < 12_000
    assert spans.filter("is_start").count() == 40


def test_inversion(spark):
    texts = ["BANANA", "ABRACADABRA", "A", "BANANA", "CAB"]
    rows = circular_sa.sorted_rotations(collection(spark, texts)).cache()
    back = inverse.invert(rows.select("pos", "bwt"), runs.i_positions(rows)).collect()
    assert sorted(r.seq for r in back) == sorted(texts)
    order = [i for _, _, i, o in by_definition(texts) if o == 0]
    assert [r.seq for r in sorted(back)] == [texts[i] for i in order]
    assert sorted(map(tuple, inverse.invert_gca(rows).collect())) == list(enumerate(texts))


@pytest.mark.parametrize("few", [0, 50])
def test_list_ranking(spark, few):
    rng = random.Random(few)
    places = list(range(400))
    rng.shuffle(places)
    lists = [places[:1], places[1:3], places[3:60], places[60:]]
    prev = [(x, c[i - 1]) for c in lists for i, x in enumerate(c)]
    heads = [c[0] for c in lists]
    want = sorted((x, c[0], (len(c) - i) % len(c)) for c in lists for i, x in enumerate(c))
    df = spark.createDataFrame(prev, "pos long, prev long").repartition(3)
    got = inverse.ranked(df, spark.createDataFrame([(h,) for h in heads], "pos long"), few)
    # a place comes to its head by the places that have it as prev
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError, match="no start"):
        inverse.ranked(df, spark.createDataFrame([(h,) for h in heads[:3]], "pos long"), few)


def test_rows_of_ranking_follow_places(spark, monkeypatch):
    """The rows that all rounds of list ranking write are a few times the places, however long the lists are."""
    written = {}
    for n in (500, 5000):
        df = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.col("id") + 1, F.lit(n)).alias("prev"))
        tables = {}
        monkeypatch.setattr(inverse, "drop_table", lambda t: tables.setdefault(t.settled_at, t.count()))
        inverse.ranked(df, spark.range(1).select(F.col("id").alias("pos")), 20).count()
        written[n] = sum(tables.values()) / n
        monkeypatch.undo()
    assert written[5000] < 4 and abs(written[5000] - written[500]) < 1


def test_closed_rows_leave_the_rounds(spark, monkeypatch):
    rng = random.Random(41)
    texts = ["".join(rng.choice("ACGT") for _ in range(4000)), "ACGT" * 30]
    texts.append(texts[0][100:140] + "".join(rng.choice("ACGT") for _ in range(500)))
    sizes = []

    def settle(df, name, f=circular_sa.settle):
        out = f(df, name)
        if name == "classes":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(circular_sa, "settle", settle)
    assert sorted(map(tuple, circular_sa.sorted_rotations(collection(spark, texts)).collect())) == by_definition(texts)
    assert sizes[0] == sum(map(len, texts)) and all(b <= a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[2] < 0.1 * sizes[0]


def test_classes_keep_apart_round_by_round(spark):
    """Long common parts, so that classes split again and again."""
    rng = random.Random(43)
    texts = [f"CUSTOMER#{i:09d}" for i in range(60)] + ["A" * rng.randint(1, 70) + "B" * rng.randint(0, 2) for _ in range(12)]
    assert sorted(map(tuple, circular_sa.sorted_rotations(collection(spark, texts)).collect())) == by_definition(texts)


def test_used_up_tables_go(spark, tmp_path, monkeypatch):
    def there():
        return {f.name.rpartition("-")[0] for f in tmp_path.iterdir()}

    monkeypatch.setattr(durable, "shared_dir", lambda spark: f"file://{tmp_path}")
    seqs = collection(spark, ["BANANA", "ABRACADABRA" * 3 + "X", "A", "BANANA", "CAB"])
    rows = circular_sa.sorted_rotations(seqs)
    assert there() == {"ranges"}
    rows.count()
    durable.drop_table(rows)
    assert there() == set()
    index = api.build(seqs, method="doubling", gca="samples")
    assert there() == {"rotations", "runs"}
    back = index.invert()
    assert there() == {"rotations", "runs", "ranges"} and back.count() == 5
    durable.drop_table(back)
    index.release()
    assert there() == set()
    index = api.build(seqs, w=4, p=10, trigger_mode="remainders", max_triggers=10, gca="samples", allow_filtered=True)
    assert there() == {"filtered", "blocks", "runs"}
    assert index.ebwt.count() == index.info.first().ebwt_length
    index.release()
    assert there() == set()


def test_long_powers(spark):
    """In time that follows the length."""
    texts = ["A" * 400_000 + "C", "AC" * 200_000, "A" * 400_000, "ACGTT" * 80_000 + "A", "AB" * 65_536, "é漢" * 9, "é漢" * 9 + "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    start = time.monotonic()
    assert [r.p for r in rows.select(is_primitive(F.col("s")).alias("p")).collect()] == [True, False, False, True, False, False, True]
    assert time.monotonic() - start < 20
    some = ["", None, *("".join(c) for n in range(1, 9) for c in itertools.product("AB", repeat=n))]
    rows = spark.createDataFrame([(t,) for t in some], "s string")
    want = {t: None if t is None else bool(t) and (t + t).find(t, 1) == len(t) for t in some}
    assert {r.s: r.p for r in rows.select("s", is_primitive(F.col("s")).alias("p")).collect()} == want


@pytest.mark.parametrize(("w", "size"), [(4, 3), (4, 7), (6, 50), (5, 1000)])
def test_phrases_of_chunks(spark, w, size):
    rng = random.Random(w * size)
    texts = ["".join(rng.choice("ABC") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 49, 50, 51, 52, 300, 1001)] + ["AB" * 30, "A" * 90, "é漢B" * 40]
    seqs = collection(spark, texts)
    for p, remainders in ((10, (0,)), (60, (0, 7)), (3, (0,))):
        got = chunks.phrases_of_chunks(chunks.chunked(seqs, size).repartition(3), w, p, (PLAIN_PRIME,), remainders)
        want = phrases.phrases(seqs, w, p, (PLAIN_PRIME,), remainders)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_primitive_and_border(spark):
    table = [("A", True, 0), ("AAAA", False, 3), ("ABAB", False, 2), ("ABABA", True, 3), ("ABCABD", True, 0)]
    rows = spark.createDataFrame(table, "s string, p boolean, b int")
    for r in rows.select("s", "p", "b", is_primitive(F.col("s")).alias("ip"), border(F.col("s")).alias("ib")).collect():
        assert (r.ip, r.ib) == (r.p, r.b), r.s


def test_borders_of_any_length(spark):
    rng = random.Random(16)
    texts = ["A", "AB", "AA", "ABABA", "é漢é漢"] + ["".join(rng.choice("AB") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    want = [max(k for k in range(len(s)) if s[:k] == s[len(s) - k :]) for s in texts]
    assert [r.border for r in sorted(borders.borders(collection(spark, texts)).collect())] == want
    half = "".join(rng.choice("ACGT") for _ in range(150_000))
    assert borders.longest_border(triggers.codes_of(half + "N" + half)) == 150_000


def test_hashes(spark):
    known = {
        "ACGTACGTAC": (543011939, 1861354080, 9360338349508757),
        "AAAAAAAAAA": (1676035178, 1058861186, 26389565759942246),
        "NATIONAAAA": (437806056, 1994777791, 14864522167277292),
    }
    rows = spark.createDataFrame([(k,) for k in known], "s string")
    for r in rows.select("s", *[string_hash(F.col("s"), q) for q in (PLAIN_PRIME, REMAINDER_PRIME, PHRASE_PRIME)]).collect():
        assert tuple(r)[1:] == known[r.s]
    seqs = collection(spark, ["NATIONAAAABAN", "AB", "ABCD"])
    plain = sorted(map(tuple, triggers.window_hashes_sql(seqs, 4).collect()))
    assert plain == sorted(map(tuple, triggers.window_hashes(seqs, 4).collect()))
    assert {r[0] for r in plain} == {0, 2}


def test_greedy_choices(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    seqs = collection(spark, texts)
    masks = {r.seq_id: r.mask for r in triggers.prime_masks(seqs, 5, 20).collect()}
    chosen, have = [0], 1
    for i in sorted(masks):
        if not masks[i] & have and len(chosen) < 6 and masks[i]:
            low = (masks[i] & -masks[i]).bit_length() - 1
            chosen.append(low)
            have |= 1 << low
    assert triggers.select_primes(seqs, 5, 20, 6) == chosen
    hist = {}
    for r in triggers.remainder_histogram(seqs, 5, 20).collect():
        hist.setdefault(r.seq_id, []).append((r.n, r.remainder))
    chosen = [0]
    for i in sorted(hist):
        if len(chosen) < 6 and not {x for _, x in hist[i]} & set(chosen):
            chosen.append(min(hist[i])[1])
    assert triggers.select_remainders(seqs, 5, 20, 6) == chosen


def test_build(spark):
    texts = ["BANANABANDANA", "ABRACADABRAABRACAD", "CABCABCABA", "BANANABANDANA"]
    seqs = collection(spark, texts)
    want = by_definition(texts)
    for options in (
        {"method": "doubling"},
        {"w": 4, "p": 10, "trigger_mode": "primes", "max_triggers": 24},
        {"w": 4, "p": 10, "trigger_mode": "remainders", "max_triggers": 10},
    ):
        made = api.build(seqs, gca="full", **options)
        assert sorted(map(tuple, made.ebwt.collect())) == [(p, b) for p, b, _, _ in want]
        assert sorted(map(tuple, made.gca.collect())) == [(p, i, o) for p, _, i, o in want]
        assert made.info.first().ebwt_length == len(want)
        assert sorted(r.seq for r in made.invert().collect()) == sorted(texts)
    coded = api.build(seqs, w=4, p=10, trigger_mode="primes", max_triggers=24, rle=True, starts=False)
    assert coded.ebwt is None
    assert sum(r["length"] for r in coded.rle.collect()) == len(want)
    with pytest.raises(ValueError, match="no trigger"):
        api.build(seqs, w=12, p=10_000)
    with pytest.raises(ValueError, match="at least 4"):
        api.build(seqs, w=3)
    powers = collection(spark, ["ABABABAB", "ABCDE"])
    assert [r.seq_id for r in api.build(powers, method="doubling", drop_nonprimitive=True).filtered.collect()] == [0]


def test_samples(spark):
    texts = ["BANANA", "ANAB", "NAB"]
    rows = circular_sa.sorted_rotations(collection(spark, texts)).cache()
    for split in (False, True):
        want, last = [], None
        for _, b, i, o in by_definition(texts):
            if b != last or (split and o == 0):
                want.append([i, o, i, o])
            want[-1][2:] = [i, o]
            last = b
        got = [list(r)[1:] for r in sorted(runs.samples(rows, split, 4).collect())]
        assert got == want


def test_chunks_make_no_difference(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ABC") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 16, 17, 40)] + ["é漢A\U0001f600B" * 3]
    seqs = collection(spark, texts)
    for around in (True, False):
        want = []
        for i, s in enumerate(texts):
            for o in range(len(s)):
                ring = (s[o:] + s * 8)[:8] if around else s[o : o + 8]
                want.append((i, o, len(s), ring, s[o - 1] if o or around else ""))
        for chunk in (3, 8, 1 << 16):
            assert sorted(map(tuple, circular_sa.characters(seqs, 8, around, chunk).collect())) == want
    rows = circular_sa.sorted_rotations(seqs).cache()
    for chunk in (4, 1 << 16):
        symbols = rows.select("seq_id", F.when(F.col("off") == 0, 1 << 62).otherwise(F.col("off")).alias("place"), "bwt")
        assert sorted(map(tuple, inverse._joined(symbols, "seq_id", chunk).collect())) == list(enumerate(texts))


def test_suffixes_without_spelling_them(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("AB") for _ in range(rng.randint(4, 30))) for _ in range(25)} | {"ABAB" * 6})
    table = spark.createDataFrame([(i + 1, p, 1 + i % 3) for i, p in enumerate(words)], "rank long, phrase string, occ long")
    got = merge.placed_suffixes(table, 4).collect()
    rows = [(i + 1, o, p[o:], p[o - 1]) for i, p in enumerate(words) for o in range(1, len(p) - 3)]
    assert {(r.rank, r.off, r.suffix_len, r.bwt, r.occ) for r in got} == {(r, o, len(s), b, 1 + (r - 1) % 3) for r, o, s, b in rows}
    group = {(r.rank, r.off): r.group for r in got}
    spelt = sorted((s, group[r, o]) for r, o, s, _ in rows)
    assert [g for _, g in spelt] == sorted(group.values())
    assert len(set(spelt)) == len({s for s, _ in spelt}) == len({g for _, g in spelt})


def test_long_sequences_in_small_memory(spark):
    rng = random.Random(13)
    text = "".join(rng.choices("ACGT", k=2_000_000))
    seqs = collection(spark, [text, "ACGT" * 5])
    found = phrases.phrases(seqs, 10, 100).filter("seq_id = 0")
    k, total = found.agg(F.count("*"), F.sum(F.length("phrase") - 10)).first()
    assert total == len(text) and 15_000 < k < 25_000
    chars = circular_sa.characters(seqs)
    assert chars.filter("seq_id = 0").agg(F.count("*"), F.max("idx"), F.sum(F.length("window"))).first() == (len(text), len(text) - 1, 8 * len(text))


def test_hashes_agree_outside_ascii(spark):
    seqs = collection(spark, ["ABCD漢", "ééééé", "A\U0001f600BCDE", "ABCDEFGHIJKL"])
    for w in (4, 5, 6):
        plain = sorted(map(tuple, triggers.window_hashes_sql(seqs, w).collect()))
        assert plain == sorted(map(tuple, triggers.window_hashes(seqs, w).collect())) and plain
        for i, s in enumerate(["ABCD漢", "ééééé"]):
            for e in range(len(s)) if len(s) >= w else ():
                h = 0
                for c in (s + s)[(e - w + 1) % len(s) :][:w]:
                    h = (h * 256 + ord(c)) % PLAIN_PRIME
                assert (i, e, h) in plain


def test_pieces_of_a_sequence_make_no_difference():
    codes = triggers.codes_of("".join(random.Random(15).choices("ABCDE", k=500)))
    whole = triggers.trigger_mask(codes, 7, 11, PRIMES[:2], (0, 4))
    assert whole.any()
    assert all(hit for h, hit in zip(triggers.ring_hashes(codes, 7, PRIMES[0]), whole) if h % 11 in (0, 4))
    old, triggers.PIECE = triggers.PIECE, 13
    try:
        assert (triggers.trigger_mask(codes, 7, 11, PRIMES[:2], (0, 4)) == whole).all()
        assert not triggers.trigger_mask(codes[:6], 7, 1, PRIMES[:1], (0,)).any()
    finally:
        triggers.PIECE = old


def test_sums_before(spark):
    rng = random.Random(14)
    rows = sorted({rng.randint(0, 500): rng.randint(0, 9) for _ in range(90)}.items())
    table = spark.createDataFrame(rows, "k long, n long")
    for level in (7, 1 << 16):
        got = sorted(map(tuple, ranking.sums_before(table, "k", "n", "b", level).collect()))
        assert got == [(k, sum(n for x, n in rows if x < k)) for k, _ in rows]
    assert ranking.row_numbers(table.limit(0), ["k"], "nth").count() == 0
    assert [r.nth for r in sorted(ranking.row_numbers(table, ["k"], "nth", 5).collect())] == list(range(5, 5 + len(rows)))


def test_common_prefixes_of_the_dictionary(spark):
    from os.path import commonprefix

    from ringloom.operators.lcp import dict_lcp

    rng = random.Random(3)
    long = "".join(rng.choices("AC", k=300))
    words = sorted({"GGGG", "TTTTT", long, long[7:] + "C", "T" + long, "A" * 70, "A" * 90 + "C", "é😀" * 20, *random_texts(rng, "AC", 12, 5, 40)})
    table = spark.createDataFrame([(i, x, 1) for i, x in enumerate(words, 1)], "rank long, phrase string, occ long")
    suffixes = sorted((x[o:], i, o) for i, x in enumerate(words, 1) for o in range(1, len(x) - 3))
    before = [None, *(s for s, _, _ in suffixes)]
    want = [(p, i, o, len(s), len(commonprefix([s, b])) if b else 0) for p, ((s, i, o), b) in enumerate(zip(suffixes, before, strict=False))]
    assert sorted(map(tuple, dict_lcp(table, 4).collect())) == want
    one = spark.createDataFrame([(1, "ACGTA", 1)], "rank long, phrase string, occ long")
    assert list(map(tuple, dict_lcp(one, 4).collect())) == [(0, 1, 1, 4, 0)]
    assert dict_lcp(one.limit(0), 4).count() == 0


def test_stored_ranks(spark):
    from ringloom.operators import ranks

    rng = random.Random(5)
    text = "".join(c * rng.choice([1, 1, 2, 30]) for c in rng.choices("ab*|é😀", k=60)) + "z" + "a" * 400
    table = spark.createDataFrame(list(enumerate(text)), "pos long, bwt string")
    pieces = runs.rle(table).cache()
    assert sorted(map(tuple, runs.expand(pieces).collect())) == list(enumerate(text))
    assert {r.length for r in runs.pieces_of_runs(pieces, 16).collect()} <= set(range(1, 17))
    for small, group, bucket in ((8, 4, 16), (ranks.SMALL, ranks.GROUP, ranks.BUCKET)):
        stored = ranks.stored_ranks(pieces, small, group)
        asked = [(i, c) for i in (*range(0, len(text) + 1, 7), len(text)) for c in (*sorted(set(text)), "?")]
        got = ranks.rank(stored, spark.createDataFrame(asked, "pos long, bwt string")).select("pos", "bwt", "rank").collect()
        assert sorted(map(tuple, got)) == sorted((i, c, text[:i].count(c)) for i, c in asked)
        places = {c: [i for i, x in enumerate(text) if x == c] for c in sorted(set(text))}
        asked = [(c, k) for c, at in places.items() for k in (*range(0, len(at), 3), len(at) - 1, len(at))]
        got = ranks.select(stored, spark.createDataFrame(asked, "bwt string, k long"), bucket).select("bwt", "k", "pos").collect()
        assert sorted(map(str, got)) == sorted(f"Row(bwt='{c}', k={k}, pos={(places[c] + [None])[k]})" for c, k in asked)
        order = sorted(range(len(text)), key=lambda i: (text[i], i))
        got = ranks.lf(stored, spark.range(0, len(text), 11).withColumnRenamed("id", "pos")).select("pos", "bwt", "lf").collect()
        assert sorted(map(tuple, got)) == [(i, text[i], order.index(i)) for i in range(0, len(text), 11)]
        stored.release()
    assert ranks.stored_ranks(pieces.limit(0)).blocks.count() == 0


def test_inversion_from_runs(spark):
    rng = random.Random(6)
    texts = sorted({*random_texts(rng, "AC", 12, 3, 30), "A" * 5 + "G", "é😀AC"})
    texts = [t for t in texts if t not in (t + t)[1:-1]]
    rows = circular_sa.sorted_rotations(collection(spark, texts)).cache()
    want = [r.seq_id for r in rows.filter("off = 0").orderBy("pos").collect()]
    for few in (8, None):
        back = inverse.invert_runs(runs.rle(rows), runs.i_positions(rows), few)
        assert [(r.ord, r.seq) for r in back.orderBy("ord").collect()] == [(i, texts[s]) for i, s in enumerate(want)]


def test_short_sequences_are_hashed_together(monkeypatch):
    """A few steps for a batch, not one a sequence, with what each sequence gives by itself."""
    rng = random.Random(31)
    texts = ["".join(rng.choices("ABCÄ", k=rng.choice([0, 1, 3, 4, 5, 9, 40]))) for _ in range(3000)]
    texts[1000] = "AB" * 40_000
    calls, real = [], triggers.ring_hashes
    monkeypatch.setattr(triggers, "ring_hashes", lambda *a: calls.append(1) or real(*a))
    for w, pack in ((4, 1 << 16), (1, 50), (7, 300)):
        want = [(i, e) for i, s in enumerate(texts) for e in triggers.trigger_mask(triggers.codes_of(s), w, 3, PRIMES[:2], (0, 2)).nonzero()[0].tolist()]
        monkeypatch.setattr(triggers, "PACK", pack)
        calls.clear()
        got = []
        for each in triggers.packs(texts, w):
            row, end = each.places(each.hit(3, PRIMES[:2], (0, 2)).nonzero()[0])
            got += zip(row.tolist(), end.tolist())
        assert got == want
        assert pack < 1 << 16 or len(calls) <= 6
    assert [triggers.is_power(s) for s in ("", "A", "AA", "ABAB", "ABA", "ABCABD")] == [True, False, True, True, False, False]


def test_hashing_steps_of_queries(spark, monkeypatch):
    """Masks, ends and phrases of many short sequences take few steps."""
    from ringloom.operators.phrases import cut

    seqs = ["ABCDE", "AB", "BCDEABCDE", "EDCBA"]
    row, ends = next(((r, e) for x in triggers.packs(seqs, 4) for r, e in [x.places(x.hit(2, PRIMES[:1], (0,)).nonzero()[0])]))
    idx, nxt, n, found = cut(seqs, row, ends, 4)
    for i in set(row.tolist()):
        own = ends[row == i].tolist()
        assert idx[row == i].tolist() == list(range(len(own)))
        assert nxt[row == i].tolist() == own[1:] + own[:1]
        assert set(n[row == i].tolist()) == {len(seqs[i])}
    assert len(found) == len(row)


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """Short names come in one row group; the work on them doesn't stay in one task."""
    from ringloom.plans import queries

    spark.range(1000).selectExpr("id AS p_partkey", "'part ' || id AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    masks = queries.prime_hit_mask(spark, str(tmp_path))
    assert masks.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_select_meets_blocks(spark):
    """Every occurrence is made in several tasks and found by a join with blocks; no list of counts is walked for each."""
    from ringloom.operators import ranks

    rng = random.Random(41)
    text = "".join(rng.choice("ABC") * rng.randint(1, 9) for _ in range(60))
    found = [(i, c) for i, c in enumerate(text)]
    stored = ranks.stored_ranks(runs.rle(spark.createDataFrame(found, "pos long, bwt string")), small=4, group=3)
    asked = ranks.every(stored)
    assert asked.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    got = ranks.select(stored, asked, bucket=2)
    assert "aggregate(counts" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.bwt, r.k, r.pos) for r in got.collect()) == sorted((c, text[:i].count(c), i) for i, c in found)


def rounds_of(monkeypatch):
    """Names of the tables that the orders write."""
    names, real = [], circular_sa.settle
    monkeypatch.setattr(circular_sa, "settle", lambda df, name, codec=None: names.append(name) or real(df, name, codec))
    return names


def test_short_sequences_take_one_round(spark, monkeypatch):
    """Copies of short names stay equal for ever; windows of a whole period tell that they do."""
    texts = [f"CUSTOMER#{i:09d}" for i in (1, 2, 1, 33, 33, 1)] + ["ABAB", "AB", "BOLT", "BOLT"]
    names = rounds_of(monkeypatch)
    assert sorted(map(tuple, circular_sa.sorted_rotations(collection(spark, texts)).collect())) == by_definition(texts)
    assert names.count("classes") == 1
    names.clear()
    seqs = collection(spark, texts[:6])
    parts = api.segment(seqs, 4, 10, "primes", 24)
    assert sorted(map(tuple, merge.sorted_rotations(parts.words, parts.parsed, 4).collect())) == by_definition(texts[:6])
    # a round for the phrases and one for the parse, and the classes themselves
    assert names == ["classes", "windows", "classes", "classes"]


@pytest.mark.parametrize("chunk", [4, 5, 1 << 16])
def test_windows_of_the_parse(spark, chunk):
    """Sequences of phrases around themselves, in chunks or whole, with the phrase before each."""
    rng = random.Random(51)
    ranks = [[rng.randint(1, 3) for _ in range(k)] for k in (1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13, 16, 21)]
    rows = [(i, j, r, 100 * i + j, len(x)) for i, x in enumerate(ranks) for j, r in enumerate(x)]
    rng.shuffle(rows)
    parse = spark.createDataFrame(rows, "seq_id long, idx long, rank long, end_pos long, len long")
    got = [
        (r.seq_id, r.idx, r.k, r.rank, [int.from_bytes(r.window[8 * j : 8 * j + 8], "big") for j in range(4)], r.prev_rank, r.prev_end_pos)
        for r in circular_sa.parse_windows(parse, ("rank", "end_pos"), 4, chunk).collect()
    ]
    want = [(i, j, len(x), x[j], [x[(j + d) % len(x)] for d in range(4)], x[j - 1], 100 * i + (j - 1) % len(x)) for i, x in enumerate(ranks) for j in range(len(x))]
    assert sorted(got) == want
    k = 2 * max(map(len, ranks))
    keys = {(i, j): tuple((x[j:] + x[:j]) * k)[:k] for i, x in enumerate(ranks) for j in range(len(x))}
    order = {key: n for n, key in enumerate(sorted(set(keys.values())))}
    assert {(r.seq_id, r.idx): r.csa_class for r in circular_sa.parse_classes(parse).collect()} == {at: order[key] for at, key in keys.items()}


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_runs_of_blocks_longer_than_what_is_looked_at_together(spark, block):
    rng = random.Random(52)
    given, at = [], 0
    for _ in range(60):
        n = rng.choice((1, 1, 2, 5, 20))
        given.append((at, rng.choice("AB"), n))
        at += n
    want = [(h, sum(1 for _ in g)) for h, g in itertools.groupby("".join(b * n for _, b, n in given))]
    got = sorted(merge.rle_from_blocks(spark.createDataFrame(given, "start_pos long, bwt string, length long"), block).collect())
    assert [(r.run_id, r["head"], r.length) for r in got] == [(i, h, n) for i, (h, n) in enumerate(want)]


@pytest.mark.parametrize("query", ["dictionary", "dict_suffixes", "phrase_hash_collisions"])
def test_phrases_are_not_written_to_be_counted(spark, tmp_path, monkeypatch, query):
    """A dictionary is read from counts of what tasks cut, each sequence cut once; phrases aren't written first."""
    from ringloom.operators import ranking
    from ringloom.plans import queries

    names = []
    for module in (queries, ranking):
        monkeypatch.setattr(module, "settle", lambda df, name, codec=None, real=module.settle: names.append(name) or real(df, name, codec))
    cut = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            cut.add(batch.num_rows)
            yield batch

    real = queries._parts
    monkeypatch.setattr(queries, "_parts", lambda *a: real(*a).select("seq_id", "seq").mapInArrow(counted, "seq_id long, seq string"))
    spark.range(300).selectExpr("id AS p_partkey", "'large ring' || chr(97 + id % 7) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    getattr(queries, query)(spark, str(tmp_path)).collect()
    assert names == ["ranges", "dictionary"]
    assert cut.value == 300
