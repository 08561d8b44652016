"""Unsigned 64-bit keys in signed columns, and ranges of them.

A key is a bigint with the same bits. Order matters only where keys are sorted or cut into ranges; there the sign bit is
flipped first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 64
#: Bits below the feature group of a key.
GROUP_SHIFT = 54


def signed(n: int) -> int:
    """The bigint that has the bits of n modulo 2**64."""
    n %= TOP
    return n - TOP if n >> 63 else n


def unsigned(n: int) -> int:
    return n % TOP


def parse_key(text: Column) -> Column:
    """Decimal text to a key; out of range saturates at 2**64-1, a leading minus wraps."""
    digits = F.regexp_replace(text, r"^[+-]?0*", "")
    beyond = (F.length(digits) > 20) | ((F.length(digits) == 20) & (digits > str(TOP - 1)))
    return F.when(beyond, F.lit(-1).cast("bigint")).otherwise(F.conv(text, 10, -10).cast("bigint"))


def format_key(key: Column) -> Column:
    """The unsigned value as decimal(20,0)."""
    wide = key.cast("decimal(20,0)")
    return F.when(key < 0, wide + F.lit(str(TOP)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def order_key(key: Column) -> Column:
    """A bigint whose signed order is the unsigned order of keys."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def group_of(key: Column) -> Column:
    """The feature group in the top ten bits."""
    return F.shiftrightunsigned(key, GROUP_SHIFT).cast("int")


def hash_kernel(key: Column, n: int) -> Column:
    """Key modulo n, unsigned: shrinks the key space to n values."""
    return F.when(key >= 0, key % n).otherwise((format_key(key) % F.lit(n).cast("decimal(20,0)")).cast("bigint"))


def in_range(key: Column, low: int, high: int, closed: bool = False) -> Column:
    """low <= key < high, unsigned; closed admits high too."""
    o, hi = order_key(key), F.lit(signed(high ^ (1 << 63)))
    return (o >= F.lit(signed(low ^ (1 << 63)))) & ((o <= hi) if closed else (o < hi))


class KeyRange:
    """A half-open range of unsigned keys."""

    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end

    def __eq__(self, other: object) -> bool:
        return isinstance(other, KeyRange) and (self.begin, self.end) == (other.begin, other.end)

    def __hash__(self) -> int:
        return hash((self.begin, self.end))

    def __repr__(self) -> str:
        return f"[{self.begin},{self.end})"

    @classmethod
    def all(cls) -> KeyRange:
        return cls(0, TOP - 1)

    @property
    def size(self) -> int:
        return max(0, self.end - self.begin)

    @property
    def empty(self) -> bool:
        return self.size == 0

    def __contains__(self, x: int) -> bool:
        return self.begin <= x < self.end

    def shift(self, by: int) -> KeyRange:
        return KeyRange(self.begin + by, self.end + by)

    def scale(self, by: int) -> KeyRange:
        return KeyRange(self.begin * by, self.end * by)

    def project(self, x: int) -> int:
        """x moved to the nearer end if it lies outside."""
        return min(max(x, self.begin), self.end)

    def intersect(self, other: KeyRange) -> KeyRange:
        return KeyRange(max(self.begin, other.begin), min(self.end, other.end))

    def hull(self, other: KeyRange) -> KeyRange:
        return KeyRange(min(self.begin, other.begin), max(self.end, other.end))

    def divide(self, n: int) -> list[KeyRange]:
        """n parts that tile the range, as even as whole numbers allow (exact, without floating point)."""
        cuts = [self.begin + self.size * i // n for i in range(n + 1)]
        return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def range_index(key: Column, ranges: list[KeyRange]) -> Column:
    """Which of the ranges holds the key; the last one holds its upper end too, so no key is left out at 2**64-1."""
    out = F.lit(None).cast("int")
    for i in range(len(ranges) - 1, -1, -1):
        r = ranges[i]
        out = F.when(in_range(key, r.begin, r.end, closed=i == len(ranges) - 1), F.lit(i)).otherwise(out)
    return out
