"""The definitions as SQL, for comparison: each is plain and slow on purpose."""

from __future__ import annotations

import string

from ringloom.functions import PHRASE_PRIME

LOW, UP = string.ascii_lowercase, string.ascii_uppercase


def seqs(table: str, key: str, text: str, mode: str = "bytes") -> str:
    clean = f"translate({text}, '{LOW}', '{UP}')"
    if mode == "letters":
        clean = f"regexp_replace({clean}, '[^A-Z]', '', 'g')"
    return f"seqs AS (SELECT {key}::BIGINT AS seq_id, {clean} AS seq FROM {table} WHERE {clean} <> '')"


#: After seqs: sorted_rows(pos, bwt, seq_id, off).
ROTATIONS = """
kk AS (SELECT 2 * max(length(seq)) AS kk FROM seqs),
r AS (SELECT seq_id, seq, unnest(range(0, length(seq))) AS off FROM seqs),
c AS (SELECT seq_id, off, substr(seq, off + 1) || substr(seq, 1, off) AS rot,
             CASE WHEN off = 0 THEN substr(seq, length(seq), 1) ELSE substr(seq, off, 1) END AS bwt FROM r),
o AS (SELECT c.*, substr(repeat(rot, CAST(floor(kk / length(rot)) AS INT) + 1), 1, kk) AS okey FROM c CROSS JOIN kk),
sorted_rows AS (SELECT row_number() OVER (ORDER BY okey, seq_id, off) - 1 AS pos, bwt, seq_id::BIGINT AS seq_id, off::BIGINT AS off FROM o)"""

#: After sorted_rows: runs(run_id, head, length, start_pos).
RUNS = """
flags AS (SELECT *, CASE WHEN bwt IS DISTINCT FROM lag(bwt) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS new FROM sorted_rows),
numbered AS (SELECT *, sum(new) OVER (ORDER BY pos)::BIGINT - 1 AS run_id FROM flags),
runs AS (SELECT run_id, min(bwt) AS head, count(*) AS length, min(pos)::BIGINT AS start_pos FROM numbered GROUP BY run_id)"""


def fold(text: str, length: str, prime: int) -> str:
    """A string's hash."""
    return f"list_reduce(list_transform(range(1, {length} + 1), lambda j: ascii(substr({text}, j::INT, 1))::BIGINT), lambda a, c: (a * 256 + c) % {prime})"


def hashes(w: int, prime: int, name: str = "h") -> str:
    """After seqs: `name`(seq_id, seq, len, e, hash)."""
    return f"""
{name}_at AS (SELECT seq_id, seq, length(seq) AS len, unnest(range(0, length(seq))) AS e FROM seqs WHERE length(seq) >= {w}),
{name}_win AS (SELECT *, substr(seq || seq, ((e - {w} + 1 + len) % len + 1)::INT, {w}) AS win FROM {name}_at),
{name} AS (SELECT seq_id, seq, len, e, {fold('win', str(w), prime)} AS hash FROM {name}_win)"""


def ends(w: int, p: int, primes, remainders=(0,)) -> str:
    """After seqs: ends(seq_id, seq, len, e), each trigger once."""
    parts = [hashes(w, q, f"h{i}") for i, q in enumerate(primes)]
    ok = ", ".join(map(str, remainders))
    union = " UNION ".join(f"SELECT seq_id, seq, len, e FROM h{i} WHERE hash % {p} IN ({ok})" for i in range(len(primes)))
    return ",".join(parts) + f",\nends AS ({union})"


def ends_of_long(w: int, p: int, prime: int) -> str:
    """After seqs: ends(seq_id, seq, len, e), for long sequences: a window's symbols are looked up in the rows before."""
    code = "ascii(c)::BIGINT"
    value = code if w == 1 else "lag(code, {}) OVER s".format(w - 1)
    for j in range(w - 2, -1, -1):
        value = f"({value} * 256 + {f'lag(code, {j}) OVER s' if j else 'code'}) % {prime}"
    return f"""
ring AS (SELECT seq_id, string_split(substr(seq, (length(seq) - {w} + 2)::INT) || seq, '') AS cs FROM seqs WHERE length(seq) >= {w}),
codes AS (SELECT seq_id, i, {code} AS code FROM (SELECT seq_id, unnest(cs) AS c, unnest(range(0, len(cs))) AS i FROM ring)),
long_h AS (SELECT seq_id, i - {w - 1} AS e, {value} AS hash FROM codes WINDOW s AS (PARTITION BY seq_id ORDER BY i)),
ends AS (SELECT seq_id, seq, length(seq) AS len, e FROM long_h JOIN seqs USING (seq_id) WHERE e >= 0 AND hash % {p} = 0)"""


def masks(w: int, p: int, primes) -> str:
    """After seqs: masks(seq_id, mask), the primes that give a sequence a trigger, as bits."""
    parts = ", ".join(hashes(w, q, f"h{i}") for i, q in enumerate(primes))
    union = " UNION ALL ".join(f"SELECT seq_id, {1 << i}::BIGINT AS bit FROM h{i} WHERE hash % {p} = 0" for i in range(len(primes)))
    return f"{parts}, hit AS (SELECT DISTINCT * FROM ({union})), masks AS (SELECT s.seq_id, coalesce(sum(bit), 0)::BIGINT AS mask FROM seqs s LEFT JOIN hit USING (seq_id) GROUP BY s.seq_id)"


def remainder_masks(w: int, p: int, prime: int) -> str:
    """After seqs: masks(seq_id, mask, low), the remainders of a sequence's windows, as bits, and the bit of its rarest."""
    return f"""{hashes(w, prime)},
hist AS (SELECT seq_id, hash % {p} AS r, count(*) AS n FROM h GROUP BY ALL),
masks AS (SELECT seq_id, sum(1::BIGINT << r::INT)::BIGINT AS mask, 1::BIGINT << arg_min(r, n * 1000 + r)::INT AS low FROM hist GROUP BY seq_id)"""


def picks(most: int, low: str = "m.mask & -m.mask") -> str:
    """After masks: pick(nth, have, chosen): bit 0, then, for the first sequence that none chosen serves, its `low`; to be used WITH RECURSIVE."""
    return f"""
pick(nth, have, chosen) AS (
  SELECT 0::BIGINT, 1::BIGINT, 0::BIGINT
  UNION ALL
  SELECT p.nth + 1, p.have | ({low}), log2(({low})::DOUBLE)::BIGINT
  FROM pick p JOIN masks m ON m.seq_id = (SELECT min(x.seq_id) FROM masks x WHERE x.mask > 0 AND x.mask & p.have = 0)
  WHERE p.nth < {most - 1})"""


def phrases(w: int) -> str:
    """After ends: phrases(seq_id, idx, phrase, end_pos, len)."""
    return f"""
nx AS (SELECT *, row_number() OVER s - 1 AS idx, coalesce(lead(e) OVER s, first_value(e) OVER s) AS nxt FROM ends WINDOW s AS (PARTITION BY seq_id ORDER BY e)),
phrases AS (SELECT seq_id, idx, substr(repeat(seq, 3), ((e - {w} + 1 + len) % len + 1)::INT, ({w} + (nxt - e - 1 + len) % len + 1)::INT) AS phrase,
                   nxt::BIGINT AS end_pos, len::BIGINT AS len FROM nx)"""


#: After phrases: dictionary(rank, phrase, occ) and parse(seq_id, idx, rank, end_pos, len, k).
DICTIONARY = """
dictionary AS (SELECT row_number() OVER (ORDER BY phrase) AS rank, phrase, count(*) AS occ FROM phrases GROUP BY phrase),
parse AS (SELECT p.seq_id, p.idx, d.rank, p.end_pos, p.len, count(*) OVER (PARTITION BY p.seq_id) AS k FROM phrases p JOIN dictionary d USING (phrase))"""

#: After parse: csa(seq_id, idx, rank, csa_class): rotations of rank strings, as zero-padded numbers.
CSA = """
strs AS (SELECT seq_id, k, string_agg(lpad(rank::VARCHAR, 8, '0'), '' ORDER BY idx) AS s FROM parse GROUP BY seq_id, k),
kp AS (SELECT 2 * max(k) AS kk FROM strs),
rots AS (SELECT p.seq_id, p.idx, p.rank, p.k, p.end_pos, p.len, substr(s, (8 * p.idx + 1)::INT) || substr(s, 1, (8 * p.idx)::INT) AS rot FROM parse p JOIN strs USING (seq_id)),
csa AS (SELECT seq_id, idx, rank, k, end_pos, len,
               dense_rank() OVER (ORDER BY substr(repeat(rot, CAST(floor(kk / k) AS INT) + 1), 1, (8 * kk)::INT)) - 1 AS csa_class FROM rots CROSS JOIN kp)"""

#: After csa: pe(csa_pos, csa_class, seq_id, idx, rank, prev_rank).
PARSE_EBWT = """
pe AS (SELECT row_number() OVER (ORDER BY a.csa_class, a.seq_id, a.idx) - 1 AS csa_pos, a.csa_class, a.seq_id, a.idx, a.rank, b.rank AS prev_rank
       FROM csa a JOIN csa b ON a.seq_id = b.seq_id AND b.idx = (a.idx - 1 + a.k) % a.k)"""


def suffixes(w: int) -> str:
    """After dictionary: suffixes(rank, off, suffix, suffix_len, bwt, occ)."""
    return f"""
offs AS (SELECT rank, phrase, occ, unnest(range(1, length(phrase) - {w} + 1)) AS off FROM dictionary),
suffixes AS (SELECT rank, off, substr(phrase, off::INT + 1) AS suffix, (length(phrase) - off)::BIGINT AS suffix_len, substr(phrase, off::INT, 1) AS bwt, occ FROM offs),
grouped AS (SELECT suffix, sum(occ)::BIGINT AS occ, CASE WHEN min(bwt) = max(bwt) THEN 1 ELSE 2 END::BIGINT AS symbols, min(bwt) AS bwt FROM suffixes GROUP BY suffix)"""


PHRASE_HASH = fold("phrase", "length(phrase)", PHRASE_PRIME)
