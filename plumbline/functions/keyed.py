"""Keyed random numbers as column expressions: the same key gives the same number in any order of execution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities in units of 1/65536.
POISSON = [math.floor(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(m + 1))) for m in range(7)]


def digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def word(hexes: Column, at: int, digits: int = 8) -> Column:
    """A whole number from `digits` hex digits of a digest, from digit `at` (0-based)."""
    return F.conv(F.substring(hexes, at + 1, digits), 16, 10).cast("long")


def index(n: Column, seed: int, *keys: Column) -> Column:
    """Uniform on 0 … n - 1."""
    return F.pmod(word(digest(seed, *keys), 0), n)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box and Muller, from two words of one digest."""
    d = digest(seed, *keys)
    u = (word(d, 0) + F.lit(1.0)) / F.lit(4294967297.0)
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * word(d, 8) / F.lit(4294967296.0))


# ---- many numbers from one digest: four coefficients of a cubic polynomial modulo a prime. Its values at any four places
# are independent, and it is the same in column expressions, in numpy and in SQL.

PRIME = (1 << 31) - 1


def coefficients(seed: int, *keys: Column) -> Column:
    """Sixteen bytes: four 32-bit words, of which the upper bit is not used."""
    return F.unhex(digest(seed, *keys))


def words(digests: np.ndarray | bytes) -> np.ndarray:
    """[digest, 4] numbers of up to 31 bits from digests laid end to end."""
    return (np.frombuffer(digests, ">u4").reshape(-1, 4) & PRIME).astype(np.int64)


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, x below 2**62: the prime is a power of two less one."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def values(c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The polynomials `c` (last axis: coefficients) at `g`, by broadcasting; g is below 2**31."""
    u = folded(c[..., 0] * g + c[..., 1])
    return folded(folded(u * g + c[..., 2]) * g + c[..., 3])


def value(digest_: Column, g: Column) -> Column:
    """The same of a digest in hexadecimal digits."""
    c = [word(digest_, 8 * k).bitwiseAND(PRIME) for k in range(4)]
    u = F.pmod(c[0] * g + c[1], F.lit(PRIME))
    return F.pmod(F.pmod(u * g + c[2], F.lit(PRIME)) * g + c[3], F.lit(PRIME))


def weighted_sums(c: np.ndarray, g: np.ndarray, x: np.ndarray, rows: int = 256) -> np.ndarray:
    """[place of g, column of x]: sums of the rows of x, weighed by the Poisson counts of their polynomials; blocks of rows that stay in a core's cache."""
    out = np.zeros((len(g), x.shape[1]))
    room = np.empty((2, rows, len(g)), np.int64)
    for at in range(0, len(c), rows):
        own = c[at : at + rows]
        u, rest = room[0, : len(own)], room[1, : len(own)]
        np.multiply(own[:, :1], g, out=u)
        for k in (1, 2, 3):
            u += own[:, k : k + 1]
            for _ in range(2):  # modulo PRIME, as in `folded`
                np.right_shift(u, 31, out=rest)
                u &= PRIME
                u += rest
            if k < 3:
                u *= g
        u[u == PRIME] = 0
        u >>= 15
        out += COUNTS[u].T @ x[at : at + rows]
    return out


#: Poisson(1) counts by the upper sixteen of 31 bits.
COUNTS = np.searchsorted(np.array(POISSON), np.arange(65536), side="right").astype(float)


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a value below PRIME."""
    high = F.shiftright(u, 15)
    return sum(((high >= c).cast("int") for c in POISSON[1:]), (high >= POISSON[0]).cast("int"))
