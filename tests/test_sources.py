import gzip

import pytest
from pyspark.sql import functions as F

from ringloom.functions import packed_int
from ringloom.sources import check_strict, concat, from_table, read_fasta, read_fastq, read_sequences, with_starts

FASTA = ">s1 first\r\nACgt\r\nAC\r\n>s2\r\nTTT\r\n>s3 empty\r\n>s4\r\nA-C1\r\n"


def rows(df):
    return [tuple(r) for r in df.orderBy("seq_id").collect()]


@pytest.mark.parametrize("packed", [False, True])
def test_fasta(spark, tmp_path, packed):
    path = tmp_path / ("x.fa.gz" if packed else "x.fa")
    path.write_bytes(gzip.compress(FASTA.encode()) if packed else FASTA.encode())
    assert rows(read_sequences(spark, str(path))) == [(0, "s1", "ACGTAC"), (1, "s2", "TTT"), (2, "s4", "A-C1")]
    assert rows(read_fasta(spark, str(path), "letters"))[-1] == (2, "s4", "AC")


def test_lines_before_the_first_record(spark, tmp_path, caplog):
    (tmp_path / "a.fa").write_text("junk line\nACGT\n>a\nAC\nGT\n>b\nTT\n")
    (tmp_path / "b.fa").write_text("\n\n>c x\nGG\n")
    (tmp_path / "c.fa").write_text(">d\nCC\n>\nAA\n")
    (tmp_path / "d.fa").write_text("no record at all\n")
    (tmp_path / "e.fa").write_bytes(b"")
    assert rows(read_fasta(spark, str(tmp_path))) == [(0, "a", "ACGT"), (1, "b", "TT"), (2, "c", "GG"), (3, "d", "CC"), (4, "", "AA")]
    assert "first record of 2 files" in caplog.text


def test_fastq(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+r2\nII\n@r3\nAAA\n+\nII\n")
    good, bad = read_fastq(spark, str(path))
    assert rows(good) == [(0, "r1", "ACGT"), (1, "r2", "GG")]
    assert [(r.record, r.reason) for r in bad.collect()] == [(2, "quality length")]
    assert rows(read_sequences(spark, str(path))) == rows(good)


def test_tables(spark):
    df = spark.createDataFrame([(2, 1, "é b1"), (1, 2, "Ab"), (1, 1, None), (3, 1, "")], "k int, t int, s string")
    assert rows(from_table(df, ["k", "t"], "s").select("seq_id", "seq")) == [(0, "AB"), (1, "é B1")]
    assert rows(from_table(df.filter("k < 3"), "k", "s", "letters").select("seq_id", "seq")) == [(1, "AB"), (2, "B")]
    with pytest.raises(ValueError, match="mode"):
        from_table(df, "k", "s", "other")


def test_concat_and_packed(spark):
    a = spark.createDataFrame([(4, "x", "A"), (2, "y", "B")], "seq_id long, name string, seq string")
    assert rows(concat(a, a)) == [(0, "y", "B"), (1, "x", "A"), (2, "y", "B"), (3, "x", "A")]
    packed = spark.createDataFrame([(bytearray((2**33 + 258).to_bytes(5, "little")),)], "b binary")
    assert packed.select(packed_int(packed.b)).first()[0] == 2**33 + 258


def test_starts_and_strictness(spark):
    df = spark.createDataFrame([(0, "ABC"), (1, "D"), (5, "E\x01"), (9, "F1")], "seq_id long, seq string")
    want = [(0, 0, 3), (1, 3, 1), (5, 4, 2), (9, 6, 2)]
    for block in (2, 1 << 16):
        assert rows(with_starts(df, block)) == want
    assert [(r.seq_id, r.reason) for r in check_strict(df, letters=True).orderBy("seq_id").collect()] == [(5, "reserved byte"), (9, "not a letter")]


def test_fastq_is_framed_by_its_lines(spark, tmp_path, caplog):
    path = tmp_path / "x.fq"
    path.write_text("\n@r1 x\nACGT\nAC\n+\n@III\nII\n\n@r2\nGG\n+r2\nII\n\n@r3\nAAAAA\n+\nI\n@r4\nTT\n+\nII\nstray\n@r5\nCC\n@r6\nGC\n+\nII\n@r7\nAAA\n+\n")
    good, bad = read_fastq(spark, str(path))
    assert rows(good) == [(0, "r1", "ACGTAC"), (1, "r2", "GG"), (2, "r4", "TT"), (3, "r6", "GC")]
    assert sorted((r.record, r.reason) for r in bad.collect()) == [(2, "quality length"), (4, "malformed"), (5, "malformed"), (7, "quality length")]
    with pytest.raises(ValueError, match="2 malformed"):
        read_sequences(spark, str(path), strict=True)
    read_sequences(spark, str(path))
    assert "2 quality length" in caplog.text


def test_fasta_records_cross_splits(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 40 + 1)) for i in range(400)]
    (tmp_path / "x.fa").write_text("".join(f">{n} c\n{s[:30]}\n{s[30:]}\n" for n, s in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [(r.name, r.seq) for r in sorted(read_sequences(spark, str(tmp_path / "x.fa")).collect())]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == rows


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from ringloom.operators.durable import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def framed(text):
    """(name, seq) of the whole records of a file and (record, reason) of the others, by a plain scan of its lines."""
    lines, i, record, stray, good, bad = [x.rstrip("\r").rstrip(" ") for x in text.removesuffix("\n").split("\n")], 0, 0, False, [], []
    while i < len(lines):
        if lines[i][:1] not in ("@", ">") or not lines[i]:
            if lines[i] and not stray:
                bad.append((record, "malformed"))
                record += 1
            stray |= bool(lines[i])
            i += 1
            continue
        head, stray, seq, i = lines[i], False, "", i + 1
        while i < len(lines) and (not lines[i] or lines[i][0] not in "@>+"):
            seq, i = seq + lines[i], i + 1
        reason = None
        if i == len(lines) or lines[i][0] != "+":
            reason = None if head[0] == ">" else "malformed"
        else:
            first = i = i + 1
            n = 0
            while i < len(lines):
                n, i = n + len(lines[i]), i + 1
                if n >= len(seq):
                    break
            if n != len(seq):
                i = next((j for j in range(first, i) if lines[j].startswith("@")), i)
                reason = None if not seq and i == first else "quality length"
        if reason:
            bad.append((record, reason))
        elif seq:
            good.append((head[1:].split(" ")[0], seq.upper()))
        record += 1
    return good, bad


def random_file(r, n):
    """Records on one line or several, with marks among the qualities, some of them broken."""
    out = []
    wrapped = lambda x, w: [x[i : i + w] for i in range(0, len(x), w)] or [""]
    for i in range(n):
        size = r.choice([0, 1, 5, 30, 80, 200])
        seq, quality = "".join(r.choices("ACGT", k=size)), "".join(r.choices("@>+I#", k=size))
        width = r.choice([7, 60, 1000])
        lines = [f"@r{i} c", *wrapped(seq, width), "+", *wrapped(quality, width)] if r.random() < 0.8 else [f">f{i}", *wrapped(seq, width)]
        broken = r.random()
        if broken < 0.08:
            lines.pop(r.randrange(len(lines)))
        elif broken < 0.12:
            lines.insert(r.randrange(len(lines)), r.choice(["", "@", "junk", "+", "@I"]))
        out += lines
    return "\n".join(out) + "\n"


@pytest.mark.parametrize(("most_sent", "sizes"), [(1 << 20, [30, 1, 12]), (0, [12])])
def test_fastq_splits_are_framed_as_one_scan_would(spark, tmp_path, most_sent, sizes):
    import random

    r = random.Random(7)
    texts = {f"{i}.fq": random_file(r, n) for i, n in enumerate(sizes)}
    if most_sent:
        # a quality that opens with marks and ends in a later split, and a file that stops in it
        texts["3.fq"] = "@long\n" + "ACGT" * 175 + "\n+\n" + ("@" + "+" * 69 + "\n") * 10 + "@next\nAC\n+\nII\n"
        texts["4.fq"] = "@open\n" + "ACGTACGT\n" * 100 + "+\n" + "@IIIIIII\n" * 60
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        good, bad = read_fastq(spark, str(tmp_path), most_sent=most_sent)
        got = [(x.name, x.seq) for x in good.orderBy("seq_id").collect()]
        told = sorted((x.file[-4:], x.record, x.reason) for x in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {name: framed(text) for name, text in texts.items()}
    assert got == [x for name in sorted(want) for x in want[name][0]]
    assert told == sorted((name, *x) for name in want for x in want[name][1])
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_what_is_left_out_is_told_without_cleaning(spark):
    """What would be empty goes, as by cleaning it."""
    from ringloom.sources.collection import cleaned

    texts = [None, "", " ", "\n", "7-7", "é", "ſ", "K", "ａ", "a", "Z", "[", "`", "@{", "ß\nq", "0x0"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, s string")
    for mode in ("bytes", "letters"):
        want = df.select("k", cleaned(F.col("s"), mode).alias("seq")).filter("seq <> ''")
        got = from_table(df, "k", "s", mode)
        assert sorted(map(tuple, got.select("seq_id", "seq").collect())) == sorted(map(tuple, want.collect()))
        assert sorted(r.seq for r in from_table(df, ["k", "s"], "s", mode).collect()) == sorted(r.seq for r in want.collect())


@pytest.mark.parametrize("query", ["trigger_positions_multi_remainder", "phrases_multi_remainder", "_phrases"])
def test_names_are_cleaned_once_and_where_they_are_dealt_to(spark, tmp_path, query):
    """One row group is one task, so nothing is cleaned before names are dealt, nor a second time to know what is empty."""
    from ringloom.plans import queries

    spark.range(10).selectExpr("id AS p_partkey", "'part ' || id AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = getattr(queries, query)(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert plan.index("regexp_replace") < plan.index("Repartition")
