"""The ways in which a new value meets an old one, both as a projection of two columns and as an aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merge:
    """apply: (old, new). gather: the same over many new values, or None where the order would matter."""

    apply: Callable[[Column, Column], Column]
    gather: Callable[[Column], Column] | None = None


MERGE = {
    "assign": Merge(lambda a, b: b),
    "plus": Merge(lambda a, b: a + b, F.sum),
    "minus": Merge(lambda a, b: a - b),
    "times": Merge(lambda a, b: a * b, F.product),
    "divide": Merge(lambda a, b: F.try_divide(a, b)),
    "and": Merge(lambda a, b: a.bitwiseAND(b), F.bit_and),
    "or": Merge(lambda a, b: a.bitwiseOR(b), F.bit_or),
    "xor": Merge(lambda a, b: a.bitwiseXOR(b), F.bit_xor),
}


def last(value: str, order: Column | str) -> Column:
    """The aggregate for assign: the value of the greatest order."""
    return F.max_by(value, order)
