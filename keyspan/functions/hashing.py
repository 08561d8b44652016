"""The hashes that stored keys and sketches depend on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF
#: Fixed values of the sketch hash and of the hash of categorical features.
SKETCH_SEED, SKETCH_MULTIPLIER, KEY_BYTES = 0xBC9F1D34, 0xC6A4A793, 8
CATEGORY_SEED = 512927377


def _times(h: Column) -> Column:
    """h * m modulo 2**32, in two halves since bigint products must not overflow."""
    low = h * F.lit(SKETCH_MULTIPLIER & 0xFFFF)
    high = (h * F.lit(SKETCH_MULTIPLIER >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK))


def _round(h: Column, word: Column) -> Column:
    mixed = _times((h + word).bitwiseAND(F.lit(MASK)))
    return mixed.bitwiseXOR(F.shiftright(mixed, 16))


def sketch_hash(key: Column) -> Column:
    """64 to 32 bits, in built-in arithmetic."""
    start = F.lit(SKETCH_SEED ^ (KEY_BYTES * SKETCH_MULTIPLIER & MASK)).cast("bigint")
    low = _round(start, key.bitwiseAND(F.lit(MASK)))
    # A field of its own: the first round is used three times by the second.
    return F.element_at(F.transform(F.array(low), lambda h: _round(h, F.shiftrightunsigned(key, 32))), 1)


def probes(key: Column, n: int, k: int) -> Column:
    """The k slots of a key among n, as an array; a slot may come twice."""
    n, k = max(n, 64), min(30, max(1, k))
    delta = lambda h: F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(MASK)))
    slots = lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (h + j * delta(h)).bitwiseAND(F.lit(MASK)) % n)
    return F.element_at(F.transform(F.array(sketch_hash(key)), slots), 1)


def bit_probes(key: Column, m: int, k: int) -> Column:
    """The k bit positions of a Bloom filter of m bits."""
    delta = lambda h: F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(MASK)))
    slots = lambda h: F.transform(F.sequence(F.lit(0), F.lit(min(64, max(1, k)) - 1)), lambda j: (h + j * delta(h)).bitwiseAND(F.lit(MASK)) % m)
    return F.element_at(F.transform(F.array(sketch_hash(key)), slots), 1)


_U = np.uint64


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _finish(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(33))


#: Bytes of a matrix of keys padded to one length; longer keys are taken in smaller groups.
MATRIX_BYTES = 16_000_000


def _by_length(keys: list[bytes]) -> list[np.ndarray]:
    """Places of keys in groups of like length, so that one long key doesn't pad the others."""
    sizes = np.array([len(k) for k in keys], np.int64)
    groups, start = [], 0
    order = np.argsort(sizes, kind="stable")
    if len(keys) * (int(sizes.max(initial=0)) + 16) <= MATRIX_BYTES:
        return [order] if len(keys) else []
    for i in range(1, len(order) + 1):
        if i == len(order) or (i - start + 1) * (sizes[order[i]] + 16) > MATRIX_BYTES:
            groups.append(order[start:i])
            start = i
    return groups


def murmur3_x64_128(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the public 128-bit Murmur3 for x64."""
    h1, h2 = np.zeros(len(keys), _U), np.zeros(len(keys), _U)
    for at in _by_length(keys):
        h1[at], h2[at] = _murmur3([keys[i] for i in at], seed)
    return h1, h2


def _murmur3(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For all keys at once: bytes are padded to a matrix of blocks and shorter keys sit out the blocks that they don't have."""
    sizes = np.array([len(k) for k in keys], np.int64)
    blocks = int(sizes.max(initial=0)) // 16 + 1
    words = np.zeros((len(keys), blocks * 2), _U)
    words.view(np.uint8)[np.arange(blocks * 16) < sizes[:, None]] = np.frombuffer(b"".join(keys), np.uint8)
    c1, c2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)
    h1 = np.full(len(keys), seed, _U)
    h2 = h1.copy()
    scramble1 = lambda w: _rotate(w * c1, 31) * c2
    scramble2 = lambda w: _rotate(w * c2, 33) * c1
    for b in range(blocks):
        whole, last = sizes // 16 > b, sizes // 16 == b
        k1, k2 = scramble1(words[:, 2 * b]), scramble2(words[:, 2 * b + 1])
        a1 = h1 ^ k1
        n1 = (_rotate(a1, 27) + h2) * _U(5) + _U(0x52DCE729)
        n2 = (_rotate(h2 ^ k2, 31) + n1) * _U(5) + _U(0x38495AB5)
        h1, h2 = np.where(whole, n1, np.where(last, a1, h1)), np.where(whole, n2, np.where(last, h2 ^ k2, h2))
    h1, h2 = h1 ^ sizes.astype(_U), h2 ^ sizes.astype(_U)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _finish(h1), _finish(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def category_keys(texts: list[bytes]) -> np.ndarray:
    h1, h2 = murmur3_x64_128(texts, CATEGORY_SEED)
    return (h1 ^ h2).view(np.int64)


@F.pandas_udf(T.LongType())
def category_key(text: pd.Series) -> pd.Series:
    """The key of a categorical value; of null, null."""
    out = pd.Series([None] * len(text), dtype="Int64")
    full = text.notna().to_numpy()
    if full.any():
        out[full] = category_keys([t.encode() for t in text[full]])
    return out


@F.pandas_udf(T.LongType())
def rehash_key(key: pd.Series) -> pd.Series:
    """The same hash over the eight little-endian bytes of a key."""
    return pd.Series(category_keys([int(k).to_bytes(8, "little", signed=True) for k in key]), dtype="int64")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32c_of(data: list[bytes]) -> np.ndarray:
    """CRC-32C of each, byte place by byte place for all that are so long."""
    out = np.zeros(len(data), np.int64)
    for at in _by_length(data):
        sizes = np.array([len(data[i]) for i in at], np.int64)
        raw = np.zeros((len(at), int(sizes.max(initial=0))), np.uint8)
        for row, i in enumerate(at):
            raw[row, : sizes[row]] = np.frombuffer(data[i], np.uint8)
        crc = np.full(len(at), MASK, np.uint32)
        for place in range(raw.shape[1]):
            first = int(np.searchsorted(sizes, place, "right"))  # sizes rise, so the rest is at least so long
            crc[first:] = _CRC[(crc[first:] ^ raw[first:, place]) & np.uint32(0xFF)] ^ (crc[first:] >> np.uint32(8))
        out[at] = crc ^ np.uint32(MASK)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli) of binary values."""
    out = pd.Series([None] * len(data), dtype="Int64")
    full = data.notna().to_numpy()
    if full.any():
        out[full] = crc32c_of([bytes(d) for d in data[full]])
    return out
