"""The transform of a sequence file from the command line.

    spark-submit -m ringloom INPUT OUT [options]      or      python -m ringloom INPUT OUT [options]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from ringloom import sinks
from ringloom.plans import api
from ringloom.sources.fasta import check_broken, read_with_broken

log = logging.getLogger("ringloom")


def options() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="ringloom", description=__doc__.splitlines()[0])
    a.add_argument("input", help="FASTA or FASTQ, plain or compressed")
    a.add_argument("out", help="folder for one Parquet table for each relation")
    a.add_argument("-w", type=int, default=10, help="symbols in a window, 4 at least")
    a.add_argument("-p", type=int, default=100, help="modulus of window hashes, 10 at least")
    a.add_argument("-n", type=int, default=1, help="most primes, or remainders, with --reads")
    a.add_argument("--letters", action="store_true", help="keep A-Z only")
    a.add_argument("--strict", choices=["reserved", "letters"], help="refuse sequences with reserved bytes, or with anything but A-Z")
    a.add_argument("--rle", action="store_true", help="runs in place of the plain transform")
    a.add_argument("--samples", action="store_true", help="conjugate array at both ends of runs")
    a.add_argument("--GCA", dest="gca", action="store_true", help="the whole conjugate array; goes before --samples")
    a.add_argument("--starts", action="store_true", help="with --samples, also at each sequence's own rotation")
    a.add_argument("--reads", action="store_true", help="choose several triggers, and leave out sequences that have none")
    a.add_argument("--remainders", action="store_true", help="with --reads, several remainders in place of several primes")
    a.add_argument("--period", action="store_true", help="leave out powers of shorter sequences")
    a.add_argument("--doubling", action="store_true", help="rank rotations directly, without parsing")
    a.add_argument("--parsing", action="store_true", help="stop after the parse")
    a.add_argument("--allow-broken", action="store_true", help="leave out broken FASTQ records, and write them with the reason; without it they are an error")
    a.add_argument("--invert", action="store_true", help="also write the sequences back from the transform")
    a.add_argument("--verbose", action="store_true")
    return a


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = options().parse_args(args)
    logging.basicConfig(level=logging.INFO if o.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("ringloom").getOrCreate()
    seqs, broken = read_with_broken(spark, o.input, "letters" if o.letters else "bytes")
    check_broken(broken, error=not o.allow_broken)
    if broken is not None and o.allow_broken:
        broken.write.parquet(f"{o.out}/broken")
    api.check(seqs, o.strict)
    mode = ("remainders" if o.remainders else "primes") if o.reads else "plain"
    if o.parsing:
        sinks.write_parse(api.segment(seqs, o.w, o.p, mode, o.n, o.period), o.out)
        return
    index = api.build(
        seqs, method="doubling" if o.doubling else "parse", w=o.w, p=o.p, rle=o.rle, gca="full" if o.gca else "samples" if o.samples else "none",
        trigger_mode=mode, max_triggers=o.n, drop_nonprimitive=o.period, sample_starts=o.starts, allow_filtered=o.reads,
    )
    there = sinks.write_index(index, o.out)
    log.info("wrote %s", ", ".join(there))
    if o.invert:
        sinks.write_lines(sinks.read_index(spark, o.out, there).invert(), f"{o.out}/inverted", "ord")


if __name__ == "__main__":
    main()
