"""Reading numbers as C's strto* functions do: a token counts if it is used up, and an empty one is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import parse_key

_BLANKS = r"^[ \t\n\x0B\f\r]*"


def _bare(text: Column) -> Column:
    """Without blanks in front."""
    return F.ltrim(text, F.lit(" \t\n\x0b\f\r"))


def _guarded(text: Column, pattern: str, read: Column, zero: Column) -> Column:
    return F.when(text == "", zero).when(text.rlike(_BLANKS + pattern + "$"), read)


def to_float(text: Column) -> Column:
    """double, or null for a token that is not a number as a whole."""
    stripped = _bare(text)
    return _guarded(text, r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])", F.expr("0.0D") + stripped.try_cast("double"), F.lit(0.0))


def to_int(text: Column) -> Column:
    """int, or null; values beyond 32 bits are rejected rather than cut."""
    plain = text.try_cast("int")
    # Most tokens are the number as it is written; only the others need the pattern.
    return F.when(text == "", F.lit(0)).when(plain.cast("string") == text, plain).otherwise(_guarded(text, r"[+-]?\d+", _bare(text).try_cast("int"), F.lit(0)))


def to_key(text: Column) -> Column:
    """Unsigned 64-bit as a bigint, or null; beyond the range it saturates, a minus wraps."""
    plain = F.regexp_replace(_bare(text), r"^\+", "")
    return _guarded(text, r"[+-]?\d+", parse_key(plain), F.lit(0).cast("bigint"))


def to_label(value: Column) -> Column:
    """1 above zero, else -1."""
    return F.when(value > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
