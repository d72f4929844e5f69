"""The transform of a collection from its dictionary and the order of its parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.operators.circular_sa import WIDE, characters, classes, parse_classes
from ringloom.operators.durable import scratch, settle
from ringloom.operators.ranking import row_numbers, sums_before, sums_in_order


def dict_suffixes(words: DataFrame, w: int) -> DataFrame:
    """(rank, off, suffix, suffix_len, bwt, occ): the suffixes of each phrase that are at least w long and not the whole, and the symbol before each. Spelt out, for a look at them; the merge takes placed_suffixes()."""
    rows = words.select("rank", "phrase", "occ", F.length("phrase").alias("n")).filter(F.col("n") > w)
    rows = rows.withColumn("off", F.explode(F.sequence(F.lit(1), F.col("n") - w)))
    return rows.select(
        "rank", F.col("off").cast("long").alias("off"), F.expr("substring(phrase, off + 1)").alias("suffix"),
        (F.col("n") - F.col("off")).cast("long").alias("suffix_len"), F.expr("substring(phrase, off, 1)").alias("bwt"), "occ",
    )


def suffix_groups(suffixes: DataFrame, name: str = "suffix") -> DataFrame:
    """(`name`, occ, symbols, bwt): each distinct suffix with its occurrences in the text, how many symbols stand before it, and the smallest of them. A group of one symbol is easy: it is a block of that symbol, whatever the order within."""
    return suffixes.groupBy(name).agg(
        F.sum("occ").alias("occ"), F.when(F.min("bwt") == F.max("bwt"), 1).otherwise(2).cast("long").alias("symbols"), F.min("bwt").alias("bwt")
    )


def easy_blocks(groups: DataFrame) -> DataFrame:
    """(suffix, bwt, length) of the groups whose occurrences needn't be told apart."""
    return groups.filter("symbols = 1").select("suffix", "bwt", F.col("occ").alias("length"))


def occurrences(parsed: DataFrame, dense: bool = True) -> DataFrame:
    """(rank, csa_class, seq_id, end_pos, len): each occurrence of a phrase, and the class of the parse rotation that follows it."""
    placed = parse_classes(parsed, ("rank", "end_pos", "len"), dense)
    return placed.select(F.col("prev_rank").alias("rank"), "csa_class", "seq_id", F.col("prev_end_pos").alias("end_pos"), F.col("prev_len").alias("len"))


def expanded(suffixes: DataFrame, occurring: DataFrame, name: str = "suffix") -> DataFrame:
    """(`name`, csa_class, seq_id, off, bwt): a row for each occurrence of each suffix."""
    rows = suffixes.select("rank", name, "suffix_len", "bwt").join(occurring, "rank")
    off = F.pmod(F.col("end_pos") - F.col("suffix_len") + 1, F.col("len"))
    return rows.select(name, "csa_class", "seq_id", off.alias("off"), "bwt")


def hard_groups(suffixes: DataFrame, occurring: DataFrame) -> DataFrame:
    """(suffix, first_class, last_class, n) of the groups whose occurrences have to be ordered."""
    hard = suffix_groups(suffixes).filter("symbols > 1").select("suffix")
    return expanded(suffixes.join(hard, "suffix", "left_semi"), occurring).groupBy("suffix").agg(
        F.min("csa_class").alias("first_class"), F.max("csa_class").alias("last_class"), F.count(F.lit(1)).alias("n")
    )


def placed_suffixes(words: DataFrame, w: int) -> DataFrame:
    """(rank, off, suffix_len, bwt, occ, group): what dict_suffixes() gives, with how many suffixes are smaller in place of the suffix. Phrases are ordered symbol by symbol, by prefix doubling, so the work is linear in the dictionary but for a logarithm, and no suffix is spelt out."""
    chars = settle(characters(words.select(F.col("rank").alias("seq_id"), F.col("phrase").alias("seq")), WIDE, around=False), "phrases")
    placed = classes(chars, "window", WIDE, around=False, carry=("k", "bwt"))
    rows = placed.filter((F.col("idx") > 0) & (F.col("k") - F.col("idx") >= w)).join(words.select(F.col("rank").alias("seq_id"), "occ"), "seq_id")
    return rows.select(F.col("seq_id").alias("rank"), F.col("idx").alias("off"), (F.col("k") - F.col("idx")).alias("suffix_len"), "bwt", "occ", F.col("class").alias("group"))


def sorted_rotations(words: DataFrame, parsed: DataFrame, w: int) -> DataFrame:
    """(pos, bwt, seq_id, off) of all rotations: by suffix, then by the class of what follows; equal rotations by sequence and offset. No valid suffix is a proper prefix of another, so this is omega-order."""
    with scratch(words.sparkSession) as keep:
        rows = expanded(placed_suffixes(words, w), occurrences(parsed, dense=False), "group")
        return keep(row_numbers(rows, ["group", "csa_class", "seq_id", "off"], "pos")).select("pos", "bwt", "seq_id", "off")


def start_suffixes(words: DataFrame, parsed: DataFrame, w: int) -> DataFrame:
    """Distinct (rank, suffix_len) of the suffixes with which a sequence starts somewhere: those as long as the way from the sequence's first symbol to the phrase's end, around it any number of times."""
    rows = parsed.join(words.select("rank", F.length("phrase").cast("long").alias("n")), "rank")
    first = F.col("end_pos") + 1
    low, high = F.ceil((F.lit(w) - first) / F.col("len")), F.floor((F.col("n") - 1 - first) / F.col("len"))
    rows = rows.select("rank", "len", first.alias("first"), low.alias("low"), high.alias("high")).filter("low <= high")
    rows = rows.select("rank", "len", "first", F.explode(F.sequence("low", "high")).alias("turns"))
    return rows.select("rank", (F.col("first") + F.col("turns") * F.col("len")).alias("suffix_len")).distinct()


def _bounds(occurring: DataFrame) -> DataFrame:
    """(rank, first, last): the occurrences of each phrase that come first and last in the order of what follows, as structs of csa_class, seq_id, end_pos, len, times. What follows is the same at several places of a sequence only if it is a power; then these are len / times apart, and each phrase's suffixes there are too."""
    each = occurring.groupBy("rank", "csa_class", "seq_id").agg(F.min("end_pos").alias("end_pos"), F.min("len").alias("len"), F.count(F.lit(1)).alias("times"))
    place = F.struct("csa_class", "seq_id", "end_pos", "len", "times")
    return each.groupBy("rank").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def group_ends(suffixes: DataFrame, occurring: DataFrame) -> DataFrame:
    """(group, low, high): the first and the last occurrence of each group of `suffixes`, as (csa_class, seq_id, off), by the bounds of its phrases alone: a row for each suffix, none for each occurrence."""
    rows = suffixes.select("group", "rank", "suffix_len").join(_bounds(occurring), "rank")
    step = lambda x: F.floor(F.col(x)["len"] / F.col(x)["times"])
    off = lambda x: F.pmod(F.col(x)["end_pos"] - F.col("suffix_len") + 1, step(x))
    low = F.struct(F.col("first.csa_class"), F.col("first.seq_id"), off("first").alias("off"))
    high = F.struct(F.col("last.csa_class"), F.col("last.seq_id"), (off("last") + (F.col("last.times") - 1) * step("last")).alias("off"))
    return rows.groupBy("group").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def blocks(words: DataFrame, parsed: DataFrame, w: int, starts: bool = False, ends: bool = False) -> DataFrame:
    """(start_pos, bwt, length): the transform in blocks. Occurrences are aggregated before they are expanded: easy groups are a block each, straight from the dictionary, and only hard groups are expanded and ordered.

    With `ends`, also first_seq, first_off, last_seq and last_off, the rotations at both ends of a block. With `starts`, groups in which a sequence starts are expanded too, and is_start tells the blocks, of one rotation, that are a sequence's own.
    """
    with scratch(words.sparkSession) as keep:
        suffixes = settle(placed_suffixes(words, w), "suffixes")
        groups = settle(suffix_groups(suffixes, "group"), "groups")
        spread = groups.filter("symbols > 1").select("group")
        if starts:
            spread = spread.union(suffixes.join(start_suffixes(words, parsed, w), ["rank", "suffix_len"]).select("group")).distinct()
        occurring = occurrences(parsed, dense=False)
        whole = groups.join(spread, "group", "left_anti")
        if ends:
            whole = whole.join(group_ends(suffixes, occurring), "group")
        zero = F.lit(0).cast("long")
        key = ("group", "csa_class", "seq_id", "off")
        told = [*(["low", "high"] if ends else []), *(["is_start"] if starts else [])]
        easy = whole.withColumn("is_start", F.lit(False)).select("group", *[zero.alias(c) for c in key[1:]], "bwt", F.col("occ").alias("length"), *told)
        own = F.struct("csa_class", "seq_id", "off")
        rows = expanded(suffixes.join(spread, "group", "left_semi"), occurring, "group").withColumns({"low": own, "high": own, "is_start": F.col("off") == 0})
        rows = rows.select(*key, "bwt", F.lit(1).cast("long").alias("length"), *told)
        started = keep(sums_in_order(easy.union(rows), list(key), "length", "start_pos"))
        shown = [F.col(f"{x}.{c}").alias(f"{y}_{n}") for x, y in (("low", "first"), ("high", "last")) for c, n in (("seq_id", "seq"), ("off", "off"))] if ends else []
        return started.select("start_pos", "bwt", "length", *shown, *(["is_start"] if starts else []))


def ebwt_from_blocks(rows: DataFrame) -> DataFrame:
    """(pos, bwt) from (start_pos, bwt, length)."""
    return rows.select(F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + F.col("length") - 1)).alias("pos"), "bwt")


def _run_blocks(rows: DataFrame, break_at: Column | None, block: int) -> DataFrame:
    """The blocks with run_id, from 0: neighbours of one symbol have the same, unless `break_at` begins another."""
    held = rows.withColumn("_block", F.floor(F.col("start_pos") / block))
    own = Window.partitionBy("_block").orderBy("start_pos")
    # a block's first row is held against the last of the block before it, wherever that began
    ends = held.groupBy("_block").agg(F.max_by(F.struct((F.col("start_pos") + F.col("length")).alias("start_pos"), F.col("bwt").alias("_last")), "start_pos").alias("e")).select("e.*")
    new = ~F.col("bwt").eqNullSafe(F.coalesce("_lag", "_last"))
    if break_at is not None:
        new = new | break_at
    held = held.withColumn("_lag", F.lag("bwt").over(own)).join(ends, "start_pos", "left").withColumn("_new", new.cast("long"))
    offsets = sums_before(held.groupBy("_block").agg(F.sum("_new").alias("_n")), "_block", "_n", "_before")
    numbered = held.withColumn("_own", F.sum("_new").over(own)).join(offsets, "_block")
    return numbered.withColumn("run_id", F.col("_own") + F.col("_before") - 1)


def rle_from_blocks(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(run_id, head, length, start_pos): neighbouring blocks of one symbol made one, without a row for each position."""
    return _run_blocks(rows, None, block).groupBy("run_id").agg(
        F.first("bwt").alias("head"), F.sum("length").alias("length"), F.min("start_pos").alias("start_pos")
    )


def samples_from_blocks(rows: DataFrame, split_starts: bool = False, block: int = 1 << 16) -> DataFrame:
    """runs.samples() from blocks with their ends and, for `split_starts`, their starts."""
    runs = _run_blocks(rows, F.col("is_start") if split_starts else None, block).groupBy("run_id").agg(
        F.min_by(F.struct("first_seq", "first_off"), "start_pos").alias("s"), F.max_by(F.struct("last_seq", "last_off"), "start_pos").alias("e")
    )
    return runs.select(
        "run_id", F.col("s.first_seq").alias("start_da"), F.col("s.first_off").alias("start_gca"), F.col("e.last_seq").alias("end_da"), F.col("e.last_off").alias("end_gca")
    )


def i_positions_from_blocks(rows: DataFrame) -> DataFrame:
    """(pos) of the rotations that are the sequences themselves, from blocks with their starts."""
    return rows.filter("is_start").select(F.col("start_pos").alias("pos"))
