"""Column functions on strings of a collection."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
#: Window hash of plain segmentation.
PLAIN_PRIME = 1999999973
#: Window hash of segmentation by several remainders.
REMAINDER_PRIME = 1999999913
#: Hash of whole phrases.
PHRASE_PRIME = 27162335252586509
#: Window hashes of segmentation by several primes, for windows of 5 symbols and more.
PRIMES = (
    1999999913, 1999999927, 2000000011, 2000000089, 1999999943, 2000000087, 2000000441, 2000000099,
    2000000153, 2000000227, 2000001001, 2000000609, 2000000533, 2000000707, 2000001151, 2000001089,
    2000001103, 2000001127, 2000001511, 2000001539, 2000001583, 2000001677, 2000001821, 2000001929,
)
#: The same for shorter windows.
SHORT_PRIMES = (
    999999929, 999999937, 1000000021, 1000000033, 1000000009, 1000000007, 1000000181, 1000000223,
    1000000289, 1000000297, 1000000321, 1000000363, 1000000409, 1000000427, 1000000531, 1000000613,
    1000000829, 1000000787, 1000001011, 1000001053, 1000001099, 1000001137, 1000001161, 1000001203,
)


def primes_for(w: int) -> tuple[int, ...]:
    return PRIMES if w >= 5 else SHORT_PRIMES


def ascii_upper(col: Column) -> Column:
    """a-z in upper case, all else as it is."""
    return F.translate(col, string.ascii_lowercase, string.ascii_uppercase)


def has_reserved(col: Column) -> Column:
    """Whether a string holds one of the reserved bytes 0, 1 and 2."""
    return col.rlike(r"[\x00-\x02]")


def has_other_than_letters(col: Column) -> Column:
    return col.rlike("[^A-Z]")


def string_hash(col: Column, prime: int) -> Column:
    """The string's code points read as a number in base 256, modulo `prime`."""
    codes = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 256 + c) % prime)


def phrase_hash(col: Column) -> Column:
    return string_hash(col, PHRASE_PRIME)


def is_primitive(col: Column) -> Column:
    """Whether a string is no power of a shorter one: no proper divisor of its length is a shift that leaves it as it is. A comparison for each divisor, of which there are few, so long strings take time in proportion to their length. An empty string isn't; a null one is null."""
    n = F.length(col)
    small = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n.cast("double"))).cast("int")), lambda d: n % d == 0)
    shifts = F.filter(F.concat(small, F.transform(small, lambda d: (n / d).cast("int"))), lambda d: d < n)
    power = F.exists(shifts, lambda d: F.substring(col, d + 1, n - d) == F.substring(col, F.lit(1), n - d))
    return F.when(n == 0, F.lit(False)).when(n == 1, F.lit(True)).otherwise(~power)


def border(col: Column) -> Column:
    """Length of the longest proper prefix of a string that is also its suffix; for short strings, as each length is tried."""
    sizes = F.sequence(F.lit(0), F.length(col) - 1)
    fits = F.filter(sizes, lambda n: F.substring(col, F.lit(1), n) == F.substring(col, F.length(col) - n + 1, n))
    return F.array_max(fits)


def byte_width(n: Column) -> Column:
    """Bytes that hold numbers up to n: ceil(log2(n) / 8)."""
    return F.ceil(F.log2(n.cast("double")) / 8).cast("long")


def packed_int(col: Column) -> Column:
    """The number that little-endian bytes stand for, of up to 7 bytes: how other tools keep positions in binary files."""
    return F.aggregate(
        F.sequence(F.length(col), F.lit(1), F.lit(-1)),
        F.lit(0).cast("long"),
        lambda a, i: a * 256 + F.conv(F.hex(F.substring(col, i, F.lit(1))), 16, 10).cast("long"),
    )
