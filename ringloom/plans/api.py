"""One call from a collection to its transform."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME, REMAINDER_PRIME, is_primitive, primes_for
from ringloom.operators import circular_sa, inverse, merge, phrases, runs, triggers
from ringloom.operators.durable import drop_table, scratch, settle
from ringloom.sources.collection import check_strict


@dataclass
class Parse:
    """The parse of a collection: its phrases' dictionary, the parse itself, and the sequences left out."""

    words: DataFrame
    parsed: DataFrame
    filtered: DataFrame
    w: int
    primes: tuple[int, ...]
    remainders: tuple[int, ...]


@dataclass
class Index:
    """What build() gives; relations that weren't asked for are None."""

    ebwt: DataFrame | None
    rle: DataFrame | None
    i_positions: DataFrame | None
    gca: DataFrame | None
    samples: DataFrame | None
    info: DataFrame
    filtered: DataFrame | None
    #: The tables that the relations are read from.
    made: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the tables that the relations are read from, which otherwise go with the session."""
        for table in self.made:
            drop_table(table)

    def invert(self) -> DataFrame:
        """(ord, seq): the sequences back from the transform, plain or run-length encoded."""
        if self.i_positions is None:
            raise ValueError("inversion needs the start positions: build with starts=True")
        return inverse.invert(self.ebwt, self.i_positions) if self.ebwt is not None else inverse.invert_runs(self.rle, self.i_positions)


def check(seqs: DataFrame, strict: str | None) -> None:
    """An error if a strict reader would refuse a sequence."""
    if strict not in (None, "reserved", "letters"):
        raise ValueError(f"unknown strict {strict!r}")
    if strict and (bad := check_strict(seqs, strict == "letters").select("seq_id", "reason").first()):
        raise ValueError(f"sequence {bad.seq_id}: {bad.reason}")


def segment(
    seqs: DataFrame, w: int = 10, p: int = 100, trigger_mode: str = "plain", max_triggers: int = 1, drop_nonprimitive: bool = False
) -> Parse:
    """Parse a collection.

    trigger_mode: `plain`, one prime and remainder 0; `primes` or `remainders`, up to `max_triggers` of them, chosen so that more sequences get a trigger. drop_nonprimitive leaves powers out. Sequences without a trigger are told in `filtered`, with the reason.
    """
    if w < 4:
        raise ValueError("w must be at least 4")
    if p < 10:
        raise ValueError("p must be at least 10")
    primes, remainders = (PLAIN_PRIME,), (0,)
    if trigger_mode == "primes":
        table = primes_for(w)
        primes = tuple(table[i] for i in triggers.select_primes(seqs, w, p, max_triggers, drop_nonprimitive))
    elif trigger_mode == "remainders":
        primes, remainders = (REMAINDER_PRIME,), tuple(triggers.select_remainders(seqs, w, p, max_triggers, drop_nonprimitive))
    elif trigger_mode != "plain":
        raise ValueError(f"unknown trigger_mode {trigger_mode!r}")
    with scratch(seqs.sparkSession) as keep:
        left_out = keep(settle(triggers.filtered(seqs, w, p, primes, remainders, drop_nonprimitive), "filtered"))
        # those without a trigger have no phrases
        used = triggers.primitive(seqs) if drop_nonprimitive else seqs
        found = settle(phrases.phrases(used, w, p, primes, remainders), "phrases")
        words = keep(settle(phrases.dictionary(found), "dictionary"))
        return Parse(words, keep(settle(phrases.parse(found, words), "parse")), left_out, w, primes, remainders)


def build(
    seqs: DataFrame,
    method: str = "parse",
    w: int = 10,
    p: int = 100,
    rle: bool = False,
    gca: str = "none",
    trigger_mode: str = "plain",
    max_triggers: int = 1,
    drop_nonprimitive: bool = False,
    sample_starts: bool = False,
    starts: bool = True,
    allow_filtered: bool = False,
    strict: str | None = None,
) -> Index:
    """The transform of a collection (seq_id, seq).

    method: `parse` goes through prefix-free parsing, whose work falls with repetition; `doubling` ranks all rotations directly and takes any sequence. With `parse`, sequences that can't be parsed are an error unless `allow_filtered`; with drop_nonprimitive, powers are left out by either. gca: `none`, `samples` at both ends of runs, or `full`. rle gives runs instead of the plain transform. sample_starts begins a sample at each sequence's own rotation as well. strict: `reserved` makes a sequence with a reserved byte (0, 1, 2) an error, `letters` one with anything but A-Z. But for the full array, `parse` keeps the transform in blocks, with the rotations at their ends, and expands only groups with several symbols before them or in which a sequence starts.
    """
    check(seqs, strict)
    if gca not in ("none", "samples", "full"):
        raise ValueError(f"unknown gca {gca!r}")
    if method not in ("parse", "doubling"):
        raise ValueError(f"unknown method {method!r}")
    with scratch(seqs.sparkSession) as keep:
        if method == "doubling":
            left_out = None
            if drop_nonprimitive:
                left_out = seqs.filter(~is_primitive(F.col("seq"))).select("seq_id", "seq", F.lit("not primitive").alias("reason"))
                seqs = seqs.filter(is_primitive(F.col("seq")))
            made = [settle(circular_sa.sorted_rotations(seqs), "rotations")]
        else:
            parts = segment(seqs, w, p, trigger_mode, max_triggers, drop_nonprimitive)
            left_out = parts.filtered
            if not allow_filtered and left_out.filter("reason = 'no trigger'").limit(1).count():
                raise ValueError("some sequences have no trigger; use several triggers, method='doubling', or allow_filtered")
            seqs = seqs.join(left_out.select("seq_id"), "seq_id", "left_anti")
            if gca == "full":
                made = [left_out, settle(merge.sorted_rotations(parts.words, parts.parsed, w), "rotations")]
            else:
                made = [left_out, settle(merge.blocks(parts.words, parts.parsed, w, starts=starts or sample_starts, ends=gca == "samples"), "blocks")]
        rows, in_blocks = made[-1], method == "parse" and gca != "full"
        made.append(settle(merge.rle_from_blocks(rows) if in_blocks else runs.rle(rows), "runs"))
        index = Index(
            ebwt=None if rle else merge.ebwt_from_blocks(rows) if in_blocks else rows.select("pos", "bwt"),
            rle=made[-1] if rle else None,
            i_positions=None if not starts else merge.i_positions_from_blocks(rows) if in_blocks else runs.i_positions(rows),
            gca=runs.gca(rows) if gca == "full" else None,
            samples=None if gca != "samples" else merge.samples_from_blocks(rows, sample_starts) if in_blocks else runs.samples(rows, sample_starts),
            info=runs.info(made[-1], seqs),
            filtered=left_out,
            made=made,
        )
        for table in made:
            keep(table)
        return index
