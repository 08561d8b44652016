"""SQL for the hashes of text: Murmur3 (128 bits, x64) of ASCII text under 32 bytes, and CRC-32C."""

from __future__ import annotations

from ..functions.hashing import CATEGORY_SEED

_TOP = "18446744073709551616::UHUGEINT"
#: Fixed values of the public definition.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _times(x: str, by: int) -> str:
    return f"({x} * {by}::UHUGEINT) % {_TOP}"


def _plus(*parts: str) -> str:
    return f"({' + '.join(parts)}) % {_TOP}"


def _turned(x: str, by: int) -> str:
    return f"({x} * {1 << by}::UHUGEINT) % {_TOP} + {x} // {1 << (64 - by)}::UHUGEINT"


def _word(text: str, begin: int) -> str:
    """Eight bytes from a place on, the first one lowest; zeros beyond the end."""
    parts = [f"coalesce(ascii(nullif(substr({text}, {begin + i + 1}, 1), '')), 0)::UHUGEINT * {256**i}::UHUGEINT" for i in range(8)]
    return f"({' + '.join(parts)})"


def murmur_ctes(source: str, text: str) -> tuple[list[str], str]:
    """Common table expressions that add h1 and h2 to a table, one column after another, and the name of the last."""
    steps = [("h1", f"{CATEGORY_SEED}::UHUGEINT"), ("h2", f"{CATEGORY_SEED}::UHUGEINT"), ("len", f"length({text})")]

    def mixed(name: str, word: str, first: int, turn: int, second: int) -> list[tuple[str, str]]:
        return [(f"{name}a", _times(word, first)), (f"{name}b", _turned(f"{name}a", turn)), (name, _times(f"{name}b", second))]

    # A whole block of sixteen bytes, where there is one.
    steps += mixed("p1", _word(text, 0), _C1, 31, _C2) + mixed("p2", _word(text, 8), _C2, 33, _C1)
    steps += [("q1", "xor(h1, p1)"), ("q1t", _turned("q1", 27)), ("q1s", _plus("q1t", "h2")), ("q1e", _plus("q1s * 5::UHUGEINT", f"{0x52DCE729}::UHUGEINT"))]
    steps += [("q2", "xor(h2, p2)"), ("q2t", _turned("q2", 31)), ("q2s", _plus("q2t", "q1e")), ("q2e", _plus("q2s * 5::UHUGEINT", f"{0x38495AB5}::UHUGEINT"))]
    steps += [("i1", "CASE WHEN len >= 16 THEN q1e ELSE h1 END"), ("i2", "CASE WHEN len >= 16 THEN q2e ELSE h2 END")]
    # What is left over.
    steps += [("rest", f"CASE WHEN len >= 16 THEN substr({text}, 17) ELSE {text} END")]
    steps += mixed("r1", _word("rest", 0), _C1, 31, _C2) + mixed("r2", _word("rest", 8), _C2, 33, _C1)
    steps += [("j1", "xor(xor(i1, r1), len::UHUGEINT)"), ("j2", "xor(xor(i2, r2), len::UHUGEINT)"), ("k1", _plus("j1", "j2")), ("k2", _plus("j2", "k1"))]
    for name in ("k1", "k2"):
        at = name
        for i, factor in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
            steps += [(f"{name}x{i}", f"xor({at}, {at} // {1 << 33}::UHUGEINT)"), (f"{name}y{i}", _times(f"{name}x{i}", factor))]
            at = f"{name}y{i}"
        steps.append((f"{name}f", f"xor({at}, {at} // {1 << 33}::UHUGEINT)"))
    steps += [("f1", _plus("k1f", "k2f")), ("f2", _plus("k2f", "f1"))]
    ctes, last = [], source
    for i, (name, expression) in enumerate(steps):
        ctes.append(f"m{i} AS (SELECT *, {expression} AS {name} FROM {last})")
        last = f"m{i}"
    return ctes, last


#: The key of a category: both halves, as a signed number of the same bits.
KEY = "CASE WHEN xor(f1, f2) >= 9223372036854775808::UHUGEINT THEN (xor(f1, f2)::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE xor(f1, f2)::BIGINT END"


def crc32c(text: str) -> str:
    """Bit by bit: the reversed polynomial where the lowest bit is set."""
    bits = f"list_transform(range(8 * length({text})), lambda i: (ascii(substr({text}, (i // 8 + 1)::BIGINT, 1)) >> (i % 8)::INTEGER) & 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, {0x82F63B78}::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"
