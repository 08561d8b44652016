"""Token shards in training order.

Token streams are packed into sequences of equal length, and a keyed permutation (a Feistel network over the next power of
four, walked along its cycles until it lands inside) gives each sequence its slot in the global order. Range partitions of
slots are written as files of fixed stride: slot s is record s % per_shard of shard s // per_shard, so that a reader may go
on from any slot without an index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pick, slim_batches

#: Tokens in a sequence, and sequences in a shard.
LENGTH, PER_SHARD = 2_048, 8_192
#: Byte ids: UTF-8 uses neither of these two values.
BYTE_END, BYTE_PAD = 0xFF, 0xFE
ROUNDS = 6

_U = np.uint64


class Permutation:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        self._half = _U(max(1, (max(2, n) - 1).bit_length() + 1) // 2)
        self._mask = (_U(1) << self._half) - _U(1)
        self._keys = [_U(int.from_bytes(hashlib.sha256(f"{key}\x00{i}".encode()).digest()[:8], "little")) for i in range(ROUNDS)]

    def _noise(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
        return (x ^ (x >> _U(32))) & self._mask

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> self._half, x & self._mask
        for k in keys:
            left, right = right, left ^ self._noise(right, k)
        return (right << self._half) | left  # halves swapped back, so that reversed keys invert it

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        x = self._once(np.asarray(x).astype(_U), keys)
        while (out := x >= _U(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self._keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._keys[::-1])


def byte_ids(docs: DataFrame) -> DataFrame:
    """doc_id and ids: the UTF-8 bytes of the text as token ids of one byte each; null counts as empty."""
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("ids"))


def _packed(plan: Callable[[], dict[str, np.ndarray]], n: int, length: int, width: int, end: bytes, pad: bytes, key: str, with_tokens: bool) -> Callable:
    """The sequences of a task's rows; records are compressed. plan: by partition its first sequence, how many it has and a check of its rows."""
    schema = pa.schema([("slot", pa.int64()), ("sequence", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *([("record", pa.binary())] if with_tokens else [])])
    stride = length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = plan(), TaskContext.get().partitionId()
        k = int(np.searchsorted(known["partition"], own))
        here = k < len(known["partition"]) and known["partition"][k] == own
        at, promised, check = (int(known[c][k]) if here else 0 for c in ("first", "n", "check"))
        order, made, pack = Permutation(n, key), 0, zstandard.ZstdCompressor(3)
        held, held_ids = bytearray(), []

        def told(records: list[bytes], ids: list[list]) -> pa.RecordBatch:
            nonlocal made
            numbers = np.arange(at + made, at + made + len(records))
            made += len(records)
            counts = [len(r) // width for r in records]
            full = [pack.compress(r + pad * (length - c)) for r, c in zip(records, counts, strict=True)] if with_tokens else []
            return pa.RecordBatch.from_arrays([pa.array(order.slot(numbers)), pa.array(numbers), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int64())), *([pa.array(full, pa.binary())] if with_tokens else [])], schema=schema)

        records, ids, seen = [], [], 0
        for batch in batches:
            seen += sum(batch.column("check").to_pylist())
            for doc_id, own_ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held += own_ids.as_buffer() if own_ids.is_valid else b""
                held += end
                held_ids.append(doc_id)
                start = 0
                while len(held) - start >= stride:
                    records.append(bytes(held[start : start + stride]))
                    start += stride
                    ids.append(held_ids)
                    held_ids = [doc_id] if len(held) > start else []
                    if len(records) == 256:
                        yield told(records, ids)
                        records, ids = [], []
                del held[:start]
        if held:
            records.append(bytes(held))
            ids.append(held_ids)
        if records:
            yield told(records, ids)
        if (made, seen) != (promised, check):
            raise ValueError("a partition's rows or their order changed since they were counted: write or checkpoint the tokens first")

    return run


class Layout:
    """Where each sequence of `tokens` (doc_id, ids as fixed-width little-endian binary) goes.

    Each document ends with `end`. The rows of a partition follow one another without gaps; the last sequence of a partition
    is filled up with `pad`. Null ids count as empty and leave just their end. Repeated rows are repeated, and very long ones
    go over as many sequences as they need. An empty table has no sequences and no shards. Columns beside doc_id and ids are
    left out. Rows have to come alike, in number and order, in each run, as from files or a checkpoint; this is verified.
    """

    def __init__(self, tokens: DataFrame, key: str, width: int, end: int, pad: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> None:
        slim_batches(tokens.sparkSession)
        self.key, self.width, self.length, self.per_shard = key, width, length, per_shard
        # Hashes of half the bits, so that sums over a partition stay within a long.
        check = F.shiftrightunsigned(F.xxhash64("doc_id", F.octet_length("ids"), F.monotonically_increasing_id()), 32)
        self.tokens = pick(tokens, "doc_id", "ids").withColumn("check", check)
        self.end, self.pad = (x.to_bytes(width, "little") for x in (end, pad))
        size = F.sum(F.coalesce(F.octet_length("ids"), F.lit(0)) + width)
        # A row of four numbers for each input split: as many as the driver has tasks.
        splits = self.tokens.groupBy(F.spark_partition_id().alias("partition")).agg(F.ceil(size / (length * width)).cast("long").alias("n"), F.sum("check").alias("check")).orderBy("partition").collect()
        counts = np.array([tuple(r) for r in splits], np.int64).reshape(-1, 3)
        self.n = int(counts[:, 1].sum())
        plan = {"partition": counts[:, 0], "n": counts[:, 1], "check": counts[:, 2], "first": np.cumsum(counts[:, 1]) - counts[:, 1]}
        self._plan = tokens.sparkSession.sparkContext.broadcast(plan)

    @property
    def n_shards(self) -> int:
        return -(-self.n // self.per_shard)

    def _sequences(self, with_tokens: bool) -> DataFrame:
        schema = "slot long, sequence long, n_tokens long, doc_ids array<long>" + ", record binary" * with_tokens
        plan = self._plan
        return self.tokens.mapInArrow(_packed(lambda: plan.value, max(1, self.n), self.length, self.width, self.end, self.pad, self.key, with_tokens), schema)

    def index(self) -> DataFrame:
        """slot, sequence, n_tokens, doc_ids, shard and offset (in bytes) of every sequence."""
        stride = self.length * self.width + 1
        return self._sequences(False).withColumns({"shard": F.floor(F.col("slot") / self.per_shard), "offset": (F.col("slot") % self.per_shard) * stride})

    def write(self, path: str) -> None:
        """One file a shard, part-00000 and so on, records in order of slot, each ended by a newline (Spark's text writer
        puts bytes out as they are, to any file system, and a lost task writes its shard again)."""
        if self.n:
            rows = self._sequences(True).repartitionById(self.n_shards, F.floor(F.col("slot") / self.per_shard).cast("int"))
            plain = rows.sortWithinPartitions("slot").select("record").mapInArrow(_unpacked, "record binary")
            plain.select(F.col("record").cast("string").alias("value")).write.text(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, len(batch), 256):
            records = [unpack.decompress(r.as_buffer()) for r in batch.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])


def read(spark: SparkSession, path: str, length: int, width: int, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """slot and record of the sequences from slot `start` on; earlier shards are not opened."""
    stride = length * width + 1
    shard = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(shard >= start // per_shard)  # told by names alone
    own = shard * per_shard
    held = files.select(F.greatest(own, F.lit(start)).alias("first"), (own + F.floor(F.octet_length("content") / stride)).alias("end"), "content").where("first < end")
    at = lambda s: (F.pmod(s, F.lit(per_shard)) * stride + 1).cast("int")
    record = lambda c: lambda s: F.struct(s.alias("slot"), F.substr(c, at(s), F.lit(stride - 1)).alias("record"))
    # Bound before it is cut: a shard's bytes would else be copied for each record.
    return held.select(F.inline(let(F.col("content"), lambda c: F.transform(F.sequence("first", F.col("end") - 1), record(c)))))
