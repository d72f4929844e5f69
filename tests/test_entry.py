"""Each registered query of the core against its SQL, over whole small tables."""

import os

import pytest

import __spark_entry__ as entry
from ringloom.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SOME = ["sequences_clean", "sequence_starts", "nonprimitive_filter", "window_hash_w4", "trigger_positions_multi_prime", "select_primes", "filtered_sequences",
        "phrases", "dictionary", "parse", "parse_ebwt", "easy_blocks", "hard_blocks", "ebwt_definition", "ebwt_pfp", "ebwt_rle", "gca_samples", "lf_mapping", "invert",
        "fasta_files", "fastq_files", "mixed_files", "sequence_lines", "concatenated", "packed_integers", "select_remainders", "trigger_positions_documents",
        "phrases_documents", "parse_count_check", "phrases_multi_remainder", "phrases_multi_prime", "segment_without_powers", "segment_reads",
        "phrases_chunks", "gca_samples_pfp", "gca_samples_split_starts_pfp", "i_positions_pfp", "parse_circular_sa", "gca_full", "ebwt_rle_pfp", "remainder_histogram", "dict_lcp",
        "lf_runs", "invert_rle", "rank_queries", "select_queries", "lf_of_starts"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cur = duck.execute(core.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def test_names():
    assert set(core.oracle_sql()) <= set(core.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["run_id", "head", "length", "start_pos"]
