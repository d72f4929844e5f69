"""The registered queries on the given tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions import PLAIN_PRIME, PRIMES, REMAINDER_PRIME, SHORT_PRIMES, is_primitive, packed_int, phrase_hash
from ringloom.operators import chunks, circular_sa, conjugates, inverse, lcp, merge, phrases, ranks, runs, triggers
from ringloom.operators.borders import borders as borders_of
from ringloom.operators.durable import new_path, settle
from ringloom.operators.ranking import row_numbers
from ringloom.plans import api, sql
from ringloom.sinks import read_index, write_index, write_lines
from ringloom.sources import check_strict, concat, from_table, read_sequences, spread, with_starts

W, P = 4, 10
#: Remainders of the query on several of them; any set would do.
REMAINDERS = (0, 3, 7)
#: Primes of the query on several of them.
THREE = PRIMES[:3]


def _seqs(spark: SparkSession, d: str, table: str, key, text: str, mode: str = "bytes") -> DataFrame:
    return from_table(spark.read.parquet(f"{d}/{table}.parquet"), key, text, mode)


def _names(spark: SparkSession, d: str, table: str, key: str, text: str, mode: str = "bytes") -> DataFrame:
    """_seqs() of a table of short strings, as it is read dealt over tasks and cleaned there."""
    return from_table(spread(spark.read.parquet(f"{d}/{table}.parquet").select(key, text), key), key, text, mode)


def _parts(spark, d, mode="letters"):
    return _names(spark, d, "part", "p_partkey", "p_name", mode)


def _customers(spark, d):
    return _names(spark, d, "customer", "c_custkey", "c_name")


def _documents(spark, d):
    return _seqs(spark, d, "documents", "doc_id", "text", "letters")


PARTS = sql.seqs("part", "p_partkey", "p_name", "letters")
PARTS_BYTES = sql.seqs("part", "p_partkey", "p_name")
CUSTOMERS = sql.seqs("customer", "c_custkey", "c_name")
SUPPLIERS = sql.seqs("supplier", "s_suppkey", "s_name")
DOCUMENTS = sql.seqs("documents", "doc_id", "text", "letters")
PARSED = ",".join([PARTS, sql.ends(W, P, (PLAIN_PRIME,)), sql.phrases(W), sql.DICTIONARY])

Q: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# ---- collections ----


@_query("sequences_clean", f"WITH {DOCUMENTS} SELECT seq_id, length(seq)::BIGINT AS length, md5(seq) AS seq_md5 FROM seqs")
def sequences_clean(spark, d):
    return _documents(spark, d).select("seq_id", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("seq_md5"))


@_query(
    "sequences_conversations",
    f"""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq_id, conv_id || '/' || turn AS name, md5(seq) AS seq_md5 FROM (
        SELECT conv_id, turn, regexp_replace(translate(text, '{sql.LOW}', '{sql.UP}'), '[^A-Z]', '', 'g') AS seq FROM conversations) WHERE seq <> ''""",
)
def sequences_conversations(spark, d):
    return _seqs(spark, d, "conversations", ["conv_id", "turn"], "text", "letters").select("seq_id", "name", F.md5("seq").alias("seq_md5"))


@_query("strict_violations", f"WITH {CUSTOMERS} SELECT seq_id, seq, 'not a letter' AS reason FROM seqs WHERE regexp_matches(seq, '[^A-Z]')")
def strict_violations(spark, d):
    return check_strict(_customers(spark, d), letters=True)


@_query("sequence_starts", f"WITH {DOCUMENTS} SELECT seq_id, (sum(length(seq)) OVER (ORDER BY seq_id) - length(seq))::BIGINT AS start_pos, length(seq)::BIGINT AS length FROM seqs")
def sequence_starts(spark, d):
    return with_starts(_documents(spark, d))


@_query("nonprimitive_filter", f"WITH {DOCUMENTS} SELECT seq_id, position(seq IN substr(seq, 2) || substr(seq, 1, length(seq) - 1)) = 0 AS is_primitive FROM seqs")
def nonprimitive_filter(spark, d):
    return _documents(spark, d).select("seq_id", is_primitive(F.col("seq")).alias("is_primitive"))


@_query(
    "borders",
    f"""WITH {PARTS}, b AS (SELECT seq_id, seq, unnest(range(0, length(seq))) AS n FROM seqs)
        SELECT seq_id, max(n)::BIGINT AS border FROM b WHERE substr(seq, 1, n::INT) = substr(seq, (length(seq) - n + 1)::INT, n::INT) GROUP BY seq_id""",
)
def borders(spark, d):
    return borders_of(_parts(spark, d))


# ---- files and stored relations ----


def _written(spark, seqs: DataFrame, record, kind: str, **options) -> str:
    """Files of records in the order of a collection, in the shared folder."""
    path = new_path(spark, kind)
    seqs.orderBy("seq_id").select(record.alias("value")).write.options(**options).text(path)
    return path


_NUMBERED = "SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, seq_id::VARCHAR AS name, md5(seq) AS seq_md5 FROM seqs"
#: Sequences on lines of 60 symbols.
WRAPPED = "rtrim('\\n', regexp_replace(seq, '(.{60})', '$1\\n'))"


def _read_back(spark, path: str) -> DataFrame:
    return read_sequences(spark, path, strict=True).select("seq_id", "name", F.md5("seq").alias("seq_md5"))


@_query("fasta_files", f"WITH {DOCUMENTS} {_NUMBERED}")
def fasta_files(spark, d):
    """Documents as wrapped FASTA records and back."""
    return _read_back(spark, _written(spark, _documents(spark, d), F.concat(F.lit(">"), "name", F.lit(" a comment\n"), F.expr(WRAPPED)), "fasta"))


@_query("fasta_files_compressed", f"WITH {DOCUMENTS} {_NUMBERED}")
def fasta_files_compressed(spark, d):
    return _read_back(spark, _written(spark, _documents(spark, d), F.concat(F.lit(">"), "name", F.lit("\n"), "seq"), "fasta", compression="gzip"))


@_query("fastq_files", f"WITH {PARTS} {_NUMBERED}")
def fastq_files(spark, d):
    """Part names as FASTQ records, every other one over several lines with a blank line after it, and back."""
    quality = F.repeat(F.lit("I"), F.length("seq"))
    some = lambda x: F.when(F.col("seq_id") % 2 == 0, F.concat(F.substring(x, F.lit(1), F.lit(3)), F.lit("\n"), F.substring(x, F.lit(4), F.length(x)), F.lit("\n"))).otherwise(x)
    return _read_back(spark, _written(spark, _parts(spark, d), F.concat(F.lit("@"), "name", F.lit("\n"), some(F.col("seq")), F.lit("\n+\n"), some(quality)), "fastq"))


@_query("fastq_documents", f"WITH {DOCUMENTS} {_NUMBERED}")
def fastq_documents(spark, d):
    """Documents as FASTQ records, wrapped, with qualities that look like heads, and back."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), F.expr(WRAPPED), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
    return _read_back(spark, _written(spark, _documents(spark, d), record, "fastq"))


@_query("mixed_files", f"WITH {PARTS} {_NUMBERED}")
def mixed_files(spark, d):
    """FASTA and FASTQ records in one file."""
    fastq = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    record = F.when(F.col("seq_id") % 3 == 0, fastq).otherwise(F.concat(F.lit(">"), "name", F.lit("\n"), "seq"))
    return _read_back(spark, _written(spark, _parts(spark, d), record, "mixed"))


@_query("sequence_lines", f"WITH {PARTS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS line, seq FROM seqs")
def sequence_lines(spark, d):
    """Sequences written a line each, and the lines read in order."""
    path = new_path(spark, "lines")
    write_lines(_parts(spark, d), path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("seq"))
    return row_numbers(settle(lines, "lines"), ["file", "split", "at"], "line").select("line", "seq")


@_query(
    "concatenated",
    f"""WITH {PARTS}, c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS name, translate(c_name, '{sql.LOW}', '{sql.UP}') AS seq FROM customer WHERE c_name <> '')
        SELECT row_number() OVER (ORDER BY part, k) - 1 AS seq_id, name, seq FROM (SELECT 0 AS part, seq_id AS k, seq_id::VARCHAR AS name, seq FROM seqs UNION ALL SELECT 1, k, name, seq FROM c)""",
)
def concatenated(spark, d):
    return concat(_parts(spark, d), _customers(spark, d))


@_query("packed_integers", "SELECT o_orderkey, o_custkey, (o_orderkey * 65536 + o_custkey)::BIGINT AS number FROM orders")
def packed_integers(spark, d):
    """Numbers of 7 little-endian bytes, read back."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", (F.col("o_orderkey").cast("long") * 65536 + F.col("o_custkey")).alias("n"))
    digits = F.lpad(F.hex("n"), 14, "0")
    little = F.unhex(F.concat(*[F.substring(digits, F.lit(13 - 2 * i), F.lit(2)) for i in range(7)]))
    return settle(rows.select("o_orderkey", "o_custkey", little.alias("bytes")), "packed").select("o_orderkey", "o_custkey", packed_int(F.col("bytes")).alias("number"))


@_query("stored_index", f"WITH {CUSTOMERS}, {sql.ROTATIONS} SELECT pos, bwt FROM sorted_rows")
def stored_index(spark, d):
    """The relations of an index, each under its name, written and read again."""
    path = new_path(spark, "index")
    names = write_index(api.build(_customers(spark, d), method="doubling", gca="samples"), path)
    return read_index(spark, path, names).ebwt


# ---- hashes and triggers ----


@_query("window_hash_w4", f"WITH {PARTS}, {sql.hashes(4, PLAIN_PRIME)} SELECT seq_id, e::BIGINT AS end_pos, hash FROM h")
def window_hash_w4(spark, d):
    return triggers.window_hashes_sql(_parts(spark, d), 4)


@_query("window_hash_w10", f"WITH {CUSTOMERS}, {sql.hashes(10, PLAIN_PRIME)} SELECT seq_id, e::BIGINT AS end_pos, hash FROM h")
def window_hash_w10(spark, d):
    return triggers.window_hashes(_customers(spark, d), 10)


@_query("trigger_positions", f"WITH {PARTS}, {sql.ends(W, P, (PLAIN_PRIME,))} SELECT seq_id, e::BIGINT AS end_pos FROM ends")
def trigger_positions(spark, d):
    return triggers.trigger_positions(_parts(spark, d), W, P)


@_query("trigger_positions_documents", f"WITH {DOCUMENTS}, {sql.ends_of_long(10, 100, PLAIN_PRIME)} SELECT seq_id, e::BIGINT AS end_pos FROM ends")
def trigger_positions_documents(spark, d):
    return triggers.trigger_positions(_documents(spark, d), 10, 100)


@_query("trigger_positions_multi_remainder", f"WITH {PARTS}, {sql.ends(W, P, (REMAINDER_PRIME,), REMAINDERS)} SELECT seq_id, e::BIGINT AS end_pos FROM ends")
def trigger_positions_multi_remainder(spark, d):
    return triggers.trigger_positions(_parts(spark, d), W, P, (REMAINDER_PRIME,), REMAINDERS)


@_query("trigger_positions_multi_prime", f"WITH {CUSTOMERS}, {sql.ends(6, P, THREE)} SELECT seq_id, e::BIGINT AS end_pos FROM ends")
def trigger_positions_multi_prime(spark, d):
    return triggers.trigger_positions(_customers(spark, d), 6, P, THREE)


@_query("remainder_histogram", f"WITH {PARTS}, {sql.hashes(W, REMAINDER_PRIME)} SELECT seq_id, hash % {P} AS remainder, count(*) AS n FROM h GROUP BY ALL")
def remainder_histogram(spark, d):
    return triggers.remainder_histogram(_parts(spark, d), W, P)


MASKS = sql.masks(W, P, SHORT_PRIMES)


@_query("prime_hit_mask", f"WITH {PARTS}, {MASKS} SELECT seq_id, mask FROM masks")
def prime_hit_mask(spark, d):
    return triggers.prime_masks(_parts(spark, d), W, P)


def _table(spark, values, *names):
    """A few chosen values as a table."""
    cells = ", ".join("(" + ", ".join(str(int(x)) for x in v) + ")" for v in values)
    return spark.sql(f"SELECT {', '.join(f'cast({n} AS BIGINT) AS {n}' for n in names)} FROM VALUES {cells} AS t({', '.join(names)})")


@_query("select_primes", f"WITH RECURSIVE {PARTS}, {MASKS}, {sql.picks(5)} SELECT nth, chosen FROM pick")
def select_primes(spark, d):
    return _table(spark, enumerate(triggers.select_primes(_parts(spark, d), W, P, 5)), "nth", "chosen")


RARE = sql.remainder_masks(W, P, REMAINDER_PRIME)


@_query("select_remainders", f"WITH RECURSIVE {PARTS}, {RARE}, {sql.picks(5, 'm.low')} SELECT nth, chosen FROM pick")
def select_remainders(spark, d):
    return _table(spark, enumerate(triggers.select_remainders(_parts(spark, d), W, P, 5)), "nth", "chosen")


@_query(
    "filtered_sequences",
    f"""WITH {PARTS}, {sql.ends(W, P, (PLAIN_PRIME,))},
        t AS (SELECT seq_id, seq, CASE WHEN position(seq IN substr(seq, 2) || substr(seq, 1, length(seq) - 1)) > 0 THEN 'not primitive'
                     WHEN seq_id NOT IN (SELECT seq_id FROM ends) THEN 'no trigger' END AS reason FROM seqs)
        SELECT * FROM t WHERE reason IS NOT NULL""",
)
def filtered_sequences(spark, d):
    return triggers.filtered(_parts(spark, d), W, P, drop_nonprimitive=True)


# ---- parsing ----


def _phrases(spark, d):
    return phrases.phrases(_parts(spark, d), W, P)


def _words(spark, d):
    """The dictionary alone: phrases are counted as they are cut, and not written."""
    return settle(phrases.dictionary(_phrases(spark, d)), "dictionary")


def _parsed(spark, d):
    found = settle(_phrases(spark, d), "phrases")
    words = settle(phrases.dictionary(found), "dictionary")
    return settle(phrases.parse(found, words), "parse"), words


@_query("phrases", f"WITH {PARSED} SELECT seq_id, idx, phrase, end_pos, len FROM phrases")
def phrases_query(spark, d):
    return _phrases(spark, d)


@_query("phrases_documents", f"WITH {DOCUMENTS}, {sql.ends_of_long(10, 100, PLAIN_PRIME)}, {sql.phrases(10)} SELECT seq_id, idx, phrase, end_pos, len FROM phrases")
def phrases_documents(spark, d):
    return phrases.phrases(_documents(spark, d), 10, 100)


@_query("phrases_chunks", f"WITH {DOCUMENTS}, {sql.ends_of_long(10, 100, PLAIN_PRIME)}, {sql.phrases(10)} SELECT seq_id, idx, phrase, end_pos, len FROM phrases")
def phrases_chunks(spark, d):
    """Phrases of documents in chunks of 1,000 symbols."""
    return chunks.phrases_of_chunks(chunks.chunked(_documents(spark, d), 1000), 10, 100)


@_query("phrase_hash", f"WITH {PARSED} SELECT phrase, {sql.PHRASE_HASH} AS hash FROM dictionary")
def phrase_hash_query(spark, d):
    return _words(spark, d).select("phrase", phrase_hash(F.col("phrase")).alias("hash"))


@_query("phrase_hash_collisions", f"WITH {PARSED}, x AS (SELECT {sql.PHRASE_HASH} AS hash FROM dictionary) SELECT hash, count(*) AS n FROM x GROUP BY hash HAVING count(*) > 1")
def phrase_hash_collisions(spark, d):
    return phrases.collisions(_words(spark, d))


@_query("dictionary", f"WITH {PARSED} SELECT rank, phrase, occ FROM dictionary")
def dictionary(spark, d):
    return _words(spark, d)


@_query("dictionary_stats", f"WITH {PARSED} SELECT count(*) AS phrases, sum(length(phrase))::BIGINT AS symbols, sum(occ)::BIGINT AS occurrences FROM dictionary")
def dictionary_stats(spark, d):
    return phrases.dictionary_stats(_words(spark, d))


@_query("parse", f"WITH {PARSED} SELECT seq_id, idx, rank, end_pos, len FROM parse")
def parse(spark, d):
    return _parsed(spark, d)[0]


@_query("parse_count_check", f"WITH {PARSED}, c AS (SELECT rank, count(*) AS n FROM parse GROUP BY rank) SELECT rank, occ, n, occ = n AS agrees FROM dictionary JOIN c USING (rank)")
def parse_count_check(spark, d):
    """Occurrences as the dictionary counts them and as the parse has them."""
    parsed, words = _parsed(spark, d)
    counts = parsed.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    rows = words.join(counts, "rank", "left").select("rank", "occ", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("agrees", F.col("occ") == F.col("n"))


@_query("phrases_multi_remainder", f"WITH {PARTS}, {sql.ends(W, P, (REMAINDER_PRIME,), REMAINDERS)}, {sql.phrases(W)} SELECT seq_id, idx, phrase, end_pos, len FROM phrases")
def phrases_multi_remainder(spark, d):
    return phrases.phrases(_parts(spark, d), W, P, (REMAINDER_PRIME,), REMAINDERS)


@_query("phrases_multi_prime", f"WITH {CUSTOMERS}, {sql.ends(6, P, THREE)}, {sql.phrases(6)} SELECT seq_id, idx, phrase, end_pos, len FROM phrases")
def phrases_multi_prime(spark, d):
    return phrases.phrases(_customers(spark, d), 6, P, THREE)


WHOLE = "position(seq IN substr(seq, 2) || substr(seq, 1, length(seq) - 1)) = 0"
NO_POWERS = f"{PARTS.replace('seqs AS', 'every AS')}, seqs AS (SELECT * FROM every WHERE {WHOLE})"


@_query("segment_without_powers", f"WITH {NO_POWERS}, {sql.ends(W, P, (PLAIN_PRIME,))}, {sql.phrases(W)}, {sql.DICTIONARY} SELECT seq_id, idx, rank, end_pos, len FROM parse")
def segment_without_powers(spark, d):
    """The whole of segmentation: what can't be parsed and what is a power goes, then phrases, dictionary and parse."""
    return api.segment(_parts(spark, d), W, P, drop_nonprimitive=True).parsed


#: Of customers, hashes by all primes and the primes chosen; then the triggers by these.
CHOSEN = f"{CUSTOMERS}, {sql.masks(6, 10, PRIMES)}, {sql.picks(len(PRIMES))}, best AS (SELECT max(have) AS have FROM pick)"
CHOSEN_ENDS = "ends AS (" + " UNION ".join(f"SELECT seq_id, seq, len, e FROM h{i} CROSS JOIN best WHERE hash % 10 = 0 AND have & {1 << i} > 0" for i in range(len(PRIMES))) + ")"


@_query("segment_reads", f"WITH RECURSIVE {CHOSEN}, {CHOSEN_ENDS}, {sql.phrases(6)}, {sql.DICTIONARY} SELECT seq_id, idx, rank, end_pos, len FROM parse")
def segment_reads(spark, d):
    """The same with primes chosen one after the other, until every sequence has a trigger that can have one."""
    return api.segment(_customers(spark, d), 6, 10, "primes", len(PRIMES)).parsed


@_query("start_offsets", f"WITH {PARSED} SELECT seq_id, rank, end_pos FROM parse WHERE idx = k - 1")
def start_offsets(spark, d):
    return phrases.start_offsets(_parsed(spark, d)[0])


@_query("start_chars_distinct", f"WITH {PARSED} SELECT DISTINCT rank, (length(phrase) - 1 - end_pos)::BIGINT AS off FROM parse JOIN dictionary USING (rank) WHERE idx = k - 1")
def start_chars_distinct(spark, d):
    parsed, words = _parsed(spark, d)
    return phrases.start_chars(parsed, words)


# ---- order of the parse ----


@_query("parse_circular_sa", f"WITH {PARSED}, {sql.CSA} SELECT seq_id, idx, rank, csa_class FROM csa")
def parse_circular_sa(spark, d):
    return circular_sa.parse_classes(_parsed(spark, d)[0])


@_query("parse_ebwt", f"WITH {PARSED}, {sql.CSA}, {sql.PARSE_EBWT} SELECT * FROM pe")
def parse_ebwt(spark, d):
    return circular_sa.parse_ebwt(circular_sa.parse_classes(_parsed(spark, d)[0], ("rank",)))


@_query(
    "inverted_list",
    f"""WITH {PARSED}, {sql.CSA}, {sql.PARSE_EBWT} SELECT row_number() OVER (ORDER BY prev_rank, csa_pos) - 1 AS il_pos, prev_rank, csa_pos,
        csa_pos = min(csa_pos) OVER (PARTITION BY prev_rank) AS first FROM pe""",
)
def inverted_list(spark, d):
    return circular_sa.inverted_list(settle(parse_ebwt(spark, d), "parse_ebwt"))


@_query(
    "inverted_list_bounds",
    f"""WITH {PARSED}, {sql.CSA}, {sql.PARSE_EBWT}, il AS (SELECT row_number() OVER (ORDER BY prev_rank, csa_pos) - 1 AS il_pos, prev_rank FROM pe)
        SELECT prev_rank, min(il_pos)::BIGINT AS first_pos, count(*) AS n FROM il GROUP BY prev_rank""",
)
def inverted_list_bounds(spark, d):
    return inverted_list(spark, d).groupBy("prev_rank").agg(F.min("il_pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


# ---- dictionary suffixes and the merge ----


@_query("dict_suffixes", f"WITH {PARSED}, {sql.suffixes(W)} SELECT rank, off, suffix, suffix_len, bwt, occ FROM suffixes")
def dict_suffixes(spark, d):
    return merge.dict_suffixes(_words(spark, d), W)


@_query("suffix_groups", f"WITH {PARSED}, {sql.suffixes(W)} SELECT * FROM grouped")
def suffix_groups(spark, d):
    return merge.suffix_groups(dict_suffixes(spark, d))


@_query("easy_blocks", f"WITH {PARSED}, {sql.suffixes(W)} SELECT suffix, bwt, occ AS length FROM grouped WHERE symbols = 1")
def easy_blocks(spark, d):
    return merge.easy_blocks(suffix_groups(spark, d))


@_query(
    "hard_blocks",
    f"""WITH {PARSED}, {sql.CSA}, {sql.suffixes(W)},
        x AS (SELECT s.suffix, c.csa_class FROM suffixes s JOIN grouped g ON g.suffix = s.suffix AND g.symbols > 1 JOIN csa p ON p.rank = s.rank
              JOIN csa c ON c.seq_id = p.seq_id AND c.idx = (p.idx + 1) % p.k)
        SELECT suffix, min(csa_class)::BIGINT AS first_class, max(csa_class)::BIGINT AS last_class, count(*) AS n FROM x GROUP BY suffix""",
)
def hard_blocks(spark, d):
    parsed, words = _parsed(spark, d)
    return merge.hard_groups(settle(merge.dict_suffixes(words, W), "suffixes"), settle(merge.occurrences(parsed), "occurrences"))


@_query(
    "dict_lcp",
    f"""WITH {PARSED}, {sql.suffixes(W)},
        sorted AS (SELECT rank, off, suffix, suffix_len, row_number() OVER (ORDER BY suffix, rank, off) - 1 AS pos, lag(suffix) OVER (ORDER BY suffix, rank, off) AS before FROM suffixes)
        SELECT pos, rank, off, suffix_len, coalesce(len(list_filter(range(1, least(length(suffix), length(before)) + 1), lambda j: suffix[1:j] = before[1:j])), 0)::BIGINT AS lcp FROM sorted""",
)
def dict_lcp(spark, d):
    return lcp.dict_lcp(_words(spark, d), W)


# ---- the transform ----


def _served(spark, d):
    """Part names with a trigger, and their parse."""
    return _parsed(spark, d)


SERVED = f"{sql.seqs('part', 'p_partkey', 'p_name', 'letters').replace('seqs AS', 'given AS')}, " + (
    sql.ends(W, P, (PLAIN_PRIME,)).replace("FROM seqs", "FROM given") + ", seqs AS (SELECT DISTINCT seq_id, seq FROM ends)"
)


def _sorted_parts(spark, d):
    return circular_sa.sorted_rotations(_parts(spark, d, "bytes"))


@_query("ebwt_definition", f"WITH {CUSTOMERS}, {sql.ROTATIONS} SELECT pos, bwt, seq_id, off FROM sorted_rows")
def ebwt_definition(spark, d):
    return conjugates.sorted_rotations(_customers(spark, d))


@_query("ebwt", f"WITH {PARTS_BYTES}, {sql.ROTATIONS} SELECT pos, bwt FROM sorted_rows")
def ebwt(spark, d):
    return _sorted_parts(spark, d).select("pos", "bwt")


@_query("ebwt_pfp", f"WITH {SERVED}, {sql.ROTATIONS} SELECT pos, bwt, seq_id, off FROM sorted_rows")
def ebwt_pfp(spark, d):
    parsed, words = _served(spark, d)
    return merge.sorted_rotations(words, parsed, W)


@_query("ebwt_pfp_blocks", f"WITH {SERVED}, {sql.ROTATIONS} SELECT pos, bwt FROM sorted_rows")
def ebwt_pfp_blocks(spark, d):
    parsed, words = _served(spark, d)
    return merge.ebwt_from_blocks(merge.blocks(words, parsed, W))


@_query("ebwt_rle", f"WITH {PARTS_BYTES}, {sql.ROTATIONS}, {sql.RUNS} SELECT run_id, head, length, start_pos FROM runs")
def ebwt_rle(spark, d):
    return runs.rle(settle(ebwt(spark, d), "ebwt"))


@_query("ebwt_rle_pfp", f"WITH {SERVED}, {sql.ROTATIONS}, {sql.RUNS} SELECT run_id, head, length, start_pos FROM runs")
def ebwt_rle_pfp(spark, d):
    parsed, words = _served(spark, d)
    return merge.rle_from_blocks(settle(merge.blocks(words, parsed, W), "blocks"))


SERVED_READS = f"{CHOSEN.replace('seqs AS', 'every AS', 1).replace('FROM seqs', 'FROM every')}, seqs AS (SELECT e.* FROM every e JOIN masks USING (seq_id) CROSS JOIN best WHERE mask & have > 0)"


@_query("ebwt_rle_reads", f"WITH RECURSIVE {SERVED_READS}, {sql.ROTATIONS}, {sql.RUNS} SELECT run_id, head, length, start_pos FROM runs")
def ebwt_rle_reads(spark, d):
    return api.build(_customers(spark, d), w=6, p=10, trigger_mode="primes", max_triggers=len(PRIMES), rle=True, starts=False, allow_filtered=True).rle


@_query(
    "ebwt_info",
    f"""WITH {PARTS_BYTES}, {sql.ROTATIONS}, {sql.RUNS} SELECT (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM sorted_rows) AS ebwt_length,
        ceil(log2((SELECT count(*) FROM sorted_rows)) / 8)::BIGINT AS bytes_gca, ceil(log2((SELECT count(*) FROM seqs)) / 8)::BIGINT AS bytes_da""",
)
def ebwt_info(spark, d):
    return runs.info(settle(ebwt_rle(spark, d), "runs"), _parts(spark, d, "bytes"))


@_query("i_positions", f"WITH {CUSTOMERS}, {sql.ROTATIONS} SELECT pos FROM sorted_rows WHERE off = 0")
def i_positions(spark, d):
    return runs.i_positions(circular_sa.sorted_rotations(_customers(spark, d)))


@_query("gca_full", f"WITH {CUSTOMERS}, {sql.ROTATIONS} SELECT pos, seq_id AS da, off AS gca FROM sorted_rows")
def gca_full(spark, d):
    return runs.gca(circular_sa.sorted_rotations(_customers(spark, d)))


SERVED_RARE = f"{PARTS.replace('seqs AS', 'every AS')}, {RARE.replace('FROM seqs', 'FROM every')}, {sql.picks(3, 'm.low')}, seqs AS (SELECT e.* FROM every e JOIN masks USING (seq_id) WHERE mask & (SELECT max(have) FROM pick) > 0)"


@_query("build_remainders", f"WITH RECURSIVE {SERVED_RARE}, {sql.ROTATIONS} SELECT pos, seq_id AS da, off AS gca FROM sorted_rows")
def build_remainders(spark, d):
    """One call with remainders chosen one after the other, through the parse to the complete array."""
    return api.build(_parts(spark, d), w=W, p=P, trigger_mode="remainders", max_triggers=3, gca="full", starts=False, allow_filtered=True).gca


_SAMPLES = "SELECT run_id, arg_min(seq_id, pos) AS start_da, arg_min(off, pos) AS start_gca, arg_max(seq_id, pos) AS end_da, arg_max(off, pos) AS end_gca FROM numbered GROUP BY run_id"


@_query("gca_samples", f"WITH {SUPPLIERS}, {sql.ROTATIONS}, {sql.RUNS} {_SAMPLES}")
def gca_samples(spark, d):
    return runs.samples(settle(circular_sa.sorted_rotations(_seqs(spark, d, "supplier", "s_suppkey", "s_name")), "rotations"))


@_query("gca_samples_split_starts", f"WITH {SUPPLIERS}, {sql.ROTATIONS}, {sql.RUNS.replace('THEN 1 ELSE 0 END', 'OR off = 0 THEN 1 ELSE 0 END')} {_SAMPLES}")
def gca_samples_split_starts(spark, d):
    return runs.samples(settle(circular_sa.sorted_rotations(_seqs(spark, d, "supplier", "s_suppkey", "s_name")), "rotations"), split_starts=True)


def _blocks(spark, d, **how):
    parsed, words = _served(spark, d)
    return settle(merge.blocks(words, parsed, W, **how), "blocks")


@_query("gca_samples_pfp", f"WITH {SERVED}, {sql.ROTATIONS}, {sql.RUNS} {_SAMPLES}")
def gca_samples_pfp(spark, d):
    """Samples through the parse, from blocks of the transform."""
    return merge.samples_from_blocks(_blocks(spark, d, ends=True))


@_query("gca_samples_split_starts_pfp", f"WITH {SERVED}, {sql.ROTATIONS}, {sql.RUNS.replace('THEN 1 ELSE 0 END', 'OR off = 0 THEN 1 ELSE 0 END')} {_SAMPLES}")
def gca_samples_split_starts_pfp(spark, d):
    return merge.samples_from_blocks(_blocks(spark, d, ends=True, starts=True), split_starts=True)


@_query("i_positions_pfp", f"WITH {SERVED}, {sql.ROTATIONS} SELECT pos FROM sorted_rows WHERE off = 0")
def i_positions_pfp(spark, d):
    return merge.i_positions_from_blocks(_blocks(spark, d, starts=True))


# ---- inversion ----


@_query("char_histogram", f"WITH {PARTS_BYTES}, {sql.ROTATIONS} SELECT bwt, count(*) AS n FROM sorted_rows GROUP BY bwt")
def char_histogram(spark, d):
    return inverse.histogram(ebwt(spark, d))


@_query("c_array", f"WITH {PARTS_BYTES}, {sql.ROTATIONS}, h AS (SELECT bwt, count(*) AS n FROM sorted_rows GROUP BY bwt) SELECT bwt, n, (sum(n) OVER (ORDER BY bwt) - n)::BIGINT AS smaller FROM h")
def c_array(spark, d):
    return inverse.c_array(ebwt(spark, d))


@_query(
    "lf_mapping",
    f"""WITH {PARTS_BYTES}, {sql.ROTATIONS}, h AS (SELECT bwt, count(*) AS n FROM sorted_rows GROUP BY bwt), before AS (SELECT bwt, sum(n) OVER (ORDER BY bwt) - n AS smaller FROM h)
        SELECT pos, bwt, (smaller + row_number() OVER (PARTITION BY bwt ORDER BY pos) - 1)::BIGINT AS lf FROM sorted_rows JOIN before USING (bwt)""",
)
def lf_mapping(spark, d):
    return inverse.lf_mapping(ebwt(spark, d))


@_query("invert", f"WITH {CUSTOMERS}, {sql.ROTATIONS} SELECT row_number() OVER (ORDER BY pos) - 1 AS ord, seq FROM sorted_rows JOIN seqs USING (seq_id) WHERE off = 0")
def invert(spark, d):
    rows = settle(circular_sa.sorted_rotations(_customers(spark, d)), "rotations")
    return inverse.invert(rows.select("pos", "bwt"), runs.i_positions(rows))


def _part_runs(spark, d):
    return settle(runs.rle(ebwt(spark, d)), "runs")


@_query(
    "lf_runs",
    f"""WITH {PARTS_BYTES}, {sql.ROTATIONS}, {sql.RUNS} SELECT head, length, start_pos, (sum(length) OVER (ORDER BY head, start_pos) - length)::BIGINT AS lf FROM runs""",
)
def lf_runs(spark, d):
    return inverse.lf_runs(_part_runs(spark, d))


@_query("invert_rle", SQL["invert"])
def invert_rle(spark, d):
    """Sequences back from the runs alone."""
    rows = settle(circular_sa.sorted_rotations(_customers(spark, d)), "rotations")
    return inverse.invert_runs(settle(runs.rle(rows), "runs"), runs.i_positions(rows))


@_query(
    "rank_queries",
    f"""WITH {PARTS_BYTES}, {sql.ROTATIONS}, total AS (SELECT count(*) AS n FROM sorted_rows), symbols AS (SELECT DISTINCT bwt FROM sorted_rows),
        every AS (SELECT s.bwt, r.pos, coalesce(sum(CASE WHEN r.bwt = s.bwt THEN 1 ELSE 0 END) OVER (PARTITION BY s.bwt ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank
                  FROM sorted_rows r CROSS JOIN symbols s)
        SELECT e.pos, e.bwt, e.rank FROM every e, total JOIN sorted_rows r ON r.pos = total.n - 1 - e.pos AND r.bwt = e.bwt""",
)
def rank_queries(spark, d):
    """How often each symbol occurs before the place that is as far from the other end."""
    rows = ebwt(spark, d)
    asked = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).select((F.col("n") - 1 - F.col("pos")).alias("pos"), "bwt")
    return ranks.rank(ranks.stored_ranks(_part_runs(spark, d)), asked).select("pos", "bwt", "rank")


@_query("select_queries", f"WITH {PARTS_BYTES}, {sql.ROTATIONS} SELECT bwt, row_number() OVER (PARTITION BY bwt ORDER BY pos) - 1 AS k, pos FROM sorted_rows")
def select_queries(spark, d):
    """Where each symbol occurs for the k-th time, for every k."""
    stored = ranks.stored_ranks(_part_runs(spark, d))
    return ranks.select(stored, ranks.every(stored)).select("bwt", "k", "pos")


@_query("lf_of_starts", SQL["lf_mapping"].replace("FROM sorted_rows JOIN before USING (bwt)", "FROM sorted_rows JOIN before USING (bwt) QUALIFY off = 0"))
def lf_of_starts(spark, d):
    """A step of the mapping from the sequences' own rotations, from the blocks that hold them."""
    rows = settle(_sorted_parts(spark, d), "rotations")
    return ranks.lf(ranks.stored_ranks(settle(runs.rle(rows), "runs")), runs.i_positions(rows)).select("pos", "bwt", "lf")


@_query("invert_gca", f"WITH {CUSTOMERS} SELECT seq_id, seq FROM seqs")
def invert_gca(spark, d):
    return inverse.invert_gca(circular_sa.sorted_rotations(_customers(spark, d)))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
