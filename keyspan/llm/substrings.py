"""Substring dedup with a count-min prefilter.

First pass: each window of 50 words is represented by its anchor, the least hash of the 24-word grams inside it; equal
windows have equal anchors. Every task sketches in how many documents it saw each anchor, and the sketches are added up.
Counts in such a sketch may be too high, never too low. Second pass: only windows whose anchor the sketch counts twice or
more are grouped exactly, by two 64-bit hashes of all their words. The sketch also counts whole texts: those that may be
copies of one another are first grouped as texts, and only one of each group shows its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, slim_batches, written
from .hashing import BASES, Rolling, mix, sliding_least, word_codes
from .sketch import bitmaps, bits_for, has, parts_of

WINDOW = 50
GRAM = 24
#: Rows of the sketch; a count is the least of its counters.
DEPTH = 2
#: Bits of a counter's number in a row of the sketch: about a counter for each four to eight characters of text (ten or more to an anchor), within these bounds. The bits "two or more" are broadcast: at most 2**30 of each row, 256 MB in all.
LEAST_BITS, MOST_BITS = 16, 30
#: Windows in more than this share of all occurrences of repeated windows, and more than LEAST_HOT, are told by broadcast: at most as many as the inverse of the share.
HOT_SHARE, LEAST_HOT = 1e-5, 1_000
#: Texts that a task handles at a time.
ROWS = 256


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _slots(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchors, 0x51ED27 * (row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _whole(joined: bytes) -> np.ndarray:
    """The number that stands for a whole text in the sketch."""
    return np.array([xxhash.xxh3_64_intdigest(joined, 1)], np.uint64)


def _slots_of(window: int, gram: int, bits: int) -> Callable:
    """The slots of all rows of the sketch, numbered through, for a task's texts."""

    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        roll = Rolling(BASES[0])
        for at in range(0, len(batch), ROWS):
            for text in batch.column(0).slice(at, ROWS).to_pylist():
                words = _words(text)
                if len(words) >= window:
                    anchors = np.append(np.unique(sliding_least(roll(word_codes(words), gram), window - gram + 1)), _whole(b" ".join(words)))
                    yield np.concatenate([_slots(anchors, row, bits) + (row << bits) for row in range(DEPTH)])

    return slots


_SEEN = "doc_id long, hash long, n_words long, kept_sha256 string, packed binary, copy boolean, runs array<struct<start: int, n: int>>, h1 array<long>, h2 array<long>"
_RUN = pa.struct([("start", pa.int32()), ("n", pa.int32())])
_SEEN_ARROW = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("copy", pa.bool_()), ("runs", pa.list_(_RUN)), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))])


class _Windows:
    """Which windows of a text the sketch calls repeated, and their hashes."""

    def __init__(self, window: int, gram: int, bits: int, flags: list[bytes]) -> None:
        self._window, self._gram, self._bits = window, gram, bits
        self._flags = [np.frombuffer(x, np.uint8) for x in flags]
        self._rolls = [Rolling(b) for b in BASES]

    def repeated(self, numbers: np.ndarray) -> np.ndarray:
        hit = np.ones(len(numbers), bool)
        for row, bit in enumerate(self._flags):
            hit &= has(bit, _slots(numbers, row, self._bits)) == 1
        return hit

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
        """Runs (start, n) of such windows, and for each of two hashes the values one after another."""
        if len(words) < self._window:
            return [], [np.zeros(0, np.int64)] * 2
        code = word_codes(words)
        hit = self.repeated(sliding_least(self._rolls[0](code, self._gram), self._window - self._gram + 1))
        edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        runs = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return runs, [roll(code, self._window)[hit].view(np.int64) if runs else np.zeros(0, np.int64) for roll in self._rolls]


def _candidates(window: int, gram: int, bits: int, repeated: Broadcast) -> Callable:
    """Texts with repeated windows come packed; those that may be copies show no windows yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = _Windows(window, gram, bits, repeated.value), zstandard.ZstdCompressor(1)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                ids, hashes, texts = (batch.column(i).slice(at, ROWS) for i in range(3))
                n_words, digests, packed, copies, runs, found = [], [], [], [], [], ([], [])
                for doc_id, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    words = _words(text) if doc_id is not None else []
                    joined = b" ".join(words or _words(text))
                    copy = len(words) >= window and bool(own.repeated(_whole(joined))[0])
                    shown, pair = own([] if copy else words)
                    n_words.append(len(words) if doc_id is not None else len(_words(text)))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    packed.append(pack.compress(joined) if copy or shown else None)
                    copies.append(copy)
                    runs.append([{"start": a, "n": n} for a, n in shown])
                    for kept, x in zip(found, pair, strict=True):
                        kept.append(x)
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(n_words, pa.int64()), pa.array(digests), pa.array(packed, pa.binary()), pa.array(copies), pa.array(runs, pa.list_(_RUN)), *[_lists(f, pa.int64()) for f in found]], schema=_SEEN_ARROW)

    return run


def _shown(window: int, gram: int, bits: int, repeated: Broadcast) -> Callable:
    """The windows of the texts that stand for their copies."""
    schema = pa.schema([_SEEN_ARROW.field(n) for n in ("doc_id", "hash", "runs", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack = _Windows(window, gram, bits, repeated.value), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                made = [own(unpack.decompress(x).split(b" ")) for x in part.column("packed").to_pylist()]
                runs = [[{"start": a, "n": n} for a, n in shown] for shown, _ in made]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(runs, pa.list_(_RUN)), *[_lists([pair[k] for _, pair in made], pa.int64()) for k in (0, 1)]], schema=schema)

    return run


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def _cleared(window: int) -> Callable:
    """What is left of each text once the windows at `gone` are taken out."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def left(row: dict) -> tuple[int, str, str | None]:
        if row["gone"] is None:
            return 0, row["kept_sha256"], None
        words = zstandard.ZstdDecompressor().decompress(row["packed"]).split(b" ")
        steps = np.zeros(len(words) + 1, np.int32)
        starts = np.unique(row["gone"])
        steps[starts] += 1
        steps[starts + window] -= 1
        covered = np.cumsum(steps[:-1]) > 0
        kept = b" ".join([words[i] for i in np.flatnonzero(~covered)])
        return int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                made = list(zip(*map(left, part.to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), *[pa.array(m, f.type) for m, f in zip(made, list(schema)[2:], strict=True)]], schema=schema)

    return run


def repeated_bits(docs: DataFrame, window: int, gram: int, bits: int) -> list[bytes]:
    """For each row of the merged sketch the bits "counted twice or more"."""
    every = bitmaps(parts_of(docs.select("text"), _slots_of(window, gram, bits), 2), bits + DEPTH.bit_length() - 1, (1,))[0]
    width = (1 << bits) // 8
    return [every[row * width : (row + 1) * width] for row in range(DEPTH)]


def _meeting(windows: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, hash, start and first, the least document of the window (null where only one has it). Occurrences of the commonest windows are spread over all tasks."""
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = first.where(F.col("n") > max(LEAST_HOT, int(total * HOT_SHARE))).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first").alias("_first"))
    known = windows.join(F.broadcast(hot), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    spread = F.when(F.col("_first").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "start"))
    known = known.select("doc_id", "hash", "start", spread.alias("h1"), "h2", "_first")
    return known.join(first.select("h1", "h2", "first"), ["h1", "h2"], "left").select("doc_id", "hash", "start", F.coalesce("_first", "first").alias("first"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch_bits: int | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and kept (null if nothing was removed).

    Words are runs of other than ASCII white space. A word goes if a window of `window` words that covers it also starts
    in a document with a smaller doc_id, judged on the input. kept joins what is left with single spaces.

    Null and empty texts have no words. Rows with one doc_id never remove from each other; a null doc_id neither removes
    nor loses anything. Repeated rows each get a row. An empty table gives none.
    """
    slim_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    if sketch_bits is None:
        chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        sketch_bits = bits_for(chars // 8, LEAST_BITS, MOST_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs.where("doc_id is not null"), window, gram, sketch_bits))
    seen = cut(docs.select("doc_id", "hash", "text").mapInArrow(_candidates(window, gram, sketch_bits, shared), _SEEN))

    # Of texts with equal words the least doc_id leads; all others go as a whole.
    copies = seen.where("copy").select("doc_id", "hash", "kept_sha256", "packed")
    lead = copies.groupBy("kept_sha256").agg(F.min("doc_id").alias("lead"))
    leading = copies.join(lead, "kept_sha256").where("doc_id = lead").dropDuplicates(["doc_id", "hash"])
    shown = cut(leading.select("doc_id", "hash", "packed").mapInArrow(_shown(window, gram, sketch_bits, shared), "doc_id long, hash long, runs array<struct<start: int, n: int>>, h1 array<long>, h2 array<long>"))
    starts = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))
    windows = seen.where("packed is not null and not copy").select("doc_id", "hash", "runs", "h1", "h2").unionByName(shown).select("doc_id", "hash", F.inline(F.arrays_zip(starts.alias("start"), "h1", "h2")))
    repeated = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where(F.col("first") < F.col("last"))
    first = written(repeated.select("h1", "h2", "first", "n"), "windows")
    gone = _meeting(windows, first).where(F.col("first") < F.col("doc_id")).groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).agg(F.collect_set("start").alias("gone"))
    # The verdicts meet the packed texts in one join.
    following = copies.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h"), "kept_sha256").join(lead, "kept_sha256").where("lead < _id").select("_id", "_h", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("whole")).distinct()
    marks = gone.withColumn("whole", F.lit(False)).unionByName(following)
    all_starts = F.sequence(F.lit(0), (F.col("n_words") - window).cast("int"))
    judged = seen.where("packed is not null").select("doc_id", "hash", "n_words", "kept_sha256", "packed").join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("hash") == F.col("_h")), "left")
    judged = judged.select("doc_id", "n_words", "kept_sha256", "packed", F.when(F.col("whole"), all_starts).otherwise(F.col("gone")).alias("gone"))
    plain = seen.where("packed is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return plain.unionByName(judged.mapInArrow(_cleared(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))
