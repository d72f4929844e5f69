import pytest

from ringloom.__main__ import main
from ringloom.plans import api

TEXTS = ["BANANABANDANA", "ABRACADABRAABRACAD", "CABCABCABA"]


@pytest.mark.parametrize("more", [["--reads", "-n", "24", "--rle", "--samples"], ["--doubling", "--GCA"]])
def test_file_to_tables_and_back(spark, tmp_path, more):
    path = tmp_path / "x.fa"
    path.write_text("".join(f">s{i}\n{t}\n" for i, t in enumerate(TEXTS)))
    out = str(tmp_path / "out")
    main([str(path), out, "-w", "4", "-p", "10", "--invert", *more], spark)
    assert sorted(r.value for r in spark.read.text(f"{out}/inverted").collect()) == sorted(TEXTS)
    assert spark.read.parquet(f"{out}/info").first().ebwt_length == sum(map(len, TEXTS))
    assert spark.read.parquet(f"{out}/{'samples' if '--samples' in more else 'gca'}").count() > 0


def test_parsing_alone(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a\n" + TEXTS[1] * 3 + "\n")
    main([str(path), str(tmp_path / "out"), "-w", "4", "-p", "10", "--reads", "-n", "24", "--parsing"], spark)
    assert spark.read.parquet(str(tmp_path / "out/dictionary")).count() > 0


def test_broken_records_are_an_error_or_written(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(f"@a\n{TEXTS[0]}\n+\n{'I' * len(TEXTS[0])}\n@b\nACGT\n+\nII\n")
    args = [str(path), str(tmp_path / "out"), "--doubling"]
    with pytest.raises(ValueError, match="1 quality length"):
        main(args, spark)
    main([*args, "--allow-broken"], spark)
    assert [(r.record, r.reason) for r in spark.read.parquet(str(tmp_path / "out/broken")).collect()] == [(1, "quality length")]
    assert spark.read.parquet(str(tmp_path / "out/info")).first().ebwt_length == len(TEXTS[0])


def test_strict_reading(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a\nACGT\n>b\nAC\x01GT\n>c\nA-C\n")
    with pytest.raises(ValueError, match="sequence 1: reserved byte"):
        main([str(path), str(tmp_path / "out"), "--doubling", "--strict", "reserved"], spark)
    seqs = spark.createDataFrame([(7, "AC-GT")], "seq_id long, seq string")
    with pytest.raises(ValueError, match="sequence 7: not a letter"):
        api.build(seqs, method="doubling", strict="letters")
    with pytest.raises(ValueError, match="strict"):
        api.build(seqs, strict="other")
    assert api.build(seqs, method="doubling", strict="reserved").ebwt.count() == 5
