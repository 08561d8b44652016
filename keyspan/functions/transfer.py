"""Value transforms with a way back: quantising, noise, marks for filtered values, and chains of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FixedPoint:
    """Values of [low, high] as whole numbers of `bytes` bytes. A coin adds 0 or 1 (none if seed is None)."""

    low: float
    high: float
    bytes: int = 3
    seed: int | None = None

    @classmethod
    def of(cls, df: DataFrame, column: str, bytes: int = 3, seed: int | None = None) -> FixedPoint:
        """With the least and the greatest value of a column as limits; of a constant or empty one, a range of 1."""
        x = F.col(column).cast("double")
        low, high = df.agg(F.min(x), F.max(x)).first()
        low = 0.0 if low is None else low
        return cls(low, high if high is not None and high > low else low + 1.0, bytes, seed)

    @property
    def steps(self) -> float:
        return float((1 << (8 * self.bytes)) - 2)

    def encode(self, x: Column) -> Column:
        inside = F.least(F.greatest(x.cast("double"), F.lit(float(self.low))), F.lit(float(self.high)))
        whole = F.floor((inside - self.low) / (self.high - self.low) * self.steps).cast("bigint")
        return whole if self.seed is None else whole + (F.rand(self.seed) < 0.5).cast("bigint")

    def decode(self, code: Column) -> Column:
        return code.cast("double") / self.steps * (self.high - self.low) + self.low

    def to_bytes(self, code: Column) -> Column:
        """Little-endian, `bytes` long."""
        padded = F.lpad(F.hex(code), 2 * self.bytes, "0")
        return F.unhex(F.concat(*[F.substring(padded, 2 * i + 1, 2) for i in reversed(range(self.bytes))]))


@dataclass(frozen=True)
class Noise:
    """Normal noise on the way out, nothing on the way back."""

    mean: float = 0.0
    std: float = 1.0
    seed: int = 0

    def encode(self, x: Column) -> Column:
        return x + (F.randn(self.seed) * self.std + self.mean if self.std else F.lit(float(self.mean)))

    def decode(self, x: Column) -> Column:
        return x


def mark(x: Column, filtered: Column) -> Column:
    """Null stands for a filtered value; it is unlike every number, also NaN."""
    return F.when(~filtered, x)


def marked(x: Column) -> Column:
    return x.isNull()


@dataclass(frozen=True)
class Chain:
    """Encodes in order, decodes in reverse."""

    filters: tuple

    def encode(self, x: Column) -> Column:
        return _fold([f.encode for f in self.filters], x)

    def decode(self, x: Column) -> Column:
        return _fold([f.decode for f in reversed(self.filters)], x)


def _fold(steps: list[Callable[[Column], Column]], x: Column) -> Column:
    for step in steps:
        x = step(x)
    return x
