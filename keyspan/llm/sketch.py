"""Sketches of one counter a slot that tasks make in parts, put together range by range.

A task sends the slots that it saw, not counters: for each range of 65,536 slots a row with two bytes a slot. The rows of a
range meet in one task, which adds them up as they come, so its memory doesn't depend on how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Bits of a slot within its range.
INNER = 16
#: Slots that a task gathers before it sends them.
GATHERED = 1_000_000

_PARTS = "part int, slots binary"


def bits_for(items: int, least: int, most: int) -> int:
    """Bits of a slot's number, for a slot or two for each item within the bounds."""
    return min(most, max(least, INNER, int(items).bit_length()))


def tell(slots: list[np.ndarray], most: int) -> pa.RecordBatch:
    """The parts for these slots; of equal ones at most `most` are sent."""
    every = np.sort(np.concatenate(slots)) if slots else np.zeros(0, np.int64)
    if len(every) > most:
        every = every[np.r_[np.ones(most, bool), every[most:] != every[:-most]]]
    part = every >> INNER
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(every) else np.zeros(0, np.int64)
    ends = (np.append(at, len(every)) * 2).astype(np.int32)
    cells = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer((every & ((1 << INNER) - 1)).astype("<u2"))])
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), cells], names=["part", "slots"])


def told(slots_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], most: int) -> Callable:
    """For mapInArrow: the parts of a task's sketch. slots_of: the slots of a batch's rows, piece by piece."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for slots in slots_of(batch):
                kept.append(slots)
                held += len(slots)
                if held > GATHERED:
                    yield tell(kept, most)
                    kept, held = [], 0
        if kept:
            yield tell(kept, most)

    return run


def _added(above: tuple[int, ...]) -> Callable:
    """Bitmaps of the slots counted more often than each number of `above`, range by range."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots in zip(batch.column("part").to_pylist(), batch.column("slots"), strict=True):
                if part not in counts:
                    counts[part] = np.zeros(1 << INNER, np.uint32)
                own = np.frombuffer(slots.as_buffer(), "<u2").astype(np.intp)
                np.add.at(counts[part], own, 1)
        for part, n in counts.items():
            maps = [np.packbits(n > a, bitorder="little").tobytes() for a in above]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([m], pa.binary()) for m in maps]], names=["part", *[f"m{k}" for k in range(len(above))]])

    return run


def bitmaps(parts: DataFrame, bits: int, above: tuple[int, ...]) -> list[bytes]:
    """For each number of `above` the bits of all slots counted more often. parts: what told() makes (part, slots)."""
    schema = ", ".join(["part int", *[f"m{k} binary" for k in range(len(above))]])
    out, width = np.zeros((len(above), (1 << bits) // 8), np.uint8), (1 << INNER) // 8
    for r in parts.repartition("part").mapInArrow(_added(above), schema).toLocalIterator():
        for k in range(len(above)):
            out[k, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(bytes(r[f"m{k}"]), np.uint8)
    return [x.tobytes() for x in out]


def parts_of(df: DataFrame, slots_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], most: int) -> DataFrame:
    return df.mapInArrow(told(slots_of, most), _PARTS)


def has(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The bits of these slots, 0 or 1."""
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
