"""Digests of numbers as their bytes, in column expressions: no Python worker sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the fraction, bias of the exponent, the least exponent of a normal number.
FRACTION, BIAS, LEAST = 52, 1023, -1022


def double_bits(x: Column) -> Column:
    """The 64 bits of a double as a long: sign, exponent and fraction by exact scaling with powers of two. NaN is the quiet one."""
    size = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(size))  # may be one off next to a power of two
    e = F.when(two(guess) > size, guess - 1).when((guess < BIAS) & (two(guess + 1) <= size), guess + 1).otherwise(guess).cast("int")
    # a product of exact powers, each of which is a double
    normal = F.shiftleft((e + BIAS).cast("long"), FRACTION) + ((size * two(-(e / 2).cast("int")) * two(-(e - (e / 2).cast("int"))) - 1) * 2.0**FRACTION).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    magnitude = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(0x7FF0000000000000)).when(size < 2.0**LEAST, tiny).otherwise(normal)
    negative = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    return F.when(F.isnan(x), F.lit(0x7FF8000000000000)).otherwise(F.when(negative, magnitude.bitwiseOR(F.lit(-(1 << 63)))).otherwise(magnitude))


def little_endian(bits: Column) -> Column:
    """Sixteen hexadecimal digits of a long, its lowest byte first."""
    h = F.lpad(F.hex(bits), 16, "0")
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(8))])


def matrix_sha256(values: Column) -> Column:
    """SHA-256 of an array's numbers as little-endian doubles, end to end: what hashlib says of numpy's bytes. Null for null arrays or numbers."""
    hexes = F.transform(values, lambda v: little_endian(double_bits(v.cast("double"))))
    return F.when(~F.exists(values, lambda v: v.isNull()), F.sha2(F.unhex(F.array_join(hexes, "")), 256))
