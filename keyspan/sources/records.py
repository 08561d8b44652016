"""Binary sources: framed example records, raw arrays and matrices of arrays."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .examples import SLOTS

#: Fixed value that begins each record.
MAGIC = 0x3ED7230A
#: Decoded records that go to Spark at a time.
DECODED = 1000

_ARROW_SLOTS = pa.list_(pa.struct([("id", pa.int32()), ("keys", pa.list_(pa.int64())), ("vals", pa.list_(pa.float64()))]))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _read_varint(raw: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return n, at


def _fields(raw: memoryview) -> Iterator[tuple[int, object]]:
    """(number, value) of a message; bytes for length-delimited fields."""
    at = 0
    while at < len(raw):
        tag, at = _read_varint(raw, at)
        kind = tag & 7
        if kind == 2:
            n, at = _read_varint(raw, at)
            yield tag >> 3, raw[at : at + n]
            at += n
        elif kind == 0:
            n, at = _read_varint(raw, at)
            yield tag >> 3, n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


def decode_example(raw: bytes) -> list[dict]:
    """The slots of one message: field 1, repeated, of (1: id, 2: keys, 3: float values), both packed or not."""
    slots = []
    for number, body in _fields(memoryview(raw)):
        if number != 1:
            continue
        one: dict = {"id": 0, "keys": [], "vals": []}
        for field, value in _fields(body):
            if field == 1:
                one["id"] = value
            elif field == 2:
                at = 0
                while not isinstance(value, int) and at < len(value):
                    key, at = _read_varint(value, at)
                    one["keys"].append(key - (1 << 64) if key >> 63 else key)
                if isinstance(value, int):
                    one["keys"].append(value - (1 << 64) if value >> 63 else value)
            elif field == 3:
                one["vals"] += struct.unpack(f"<{len(value) // 4}f", value)
        slots.append(one)
    return slots


def encode_example(slots: list) -> bytes:
    out = b""
    for s in slots:
        body = b"\x08" + _varint(s["id"])
        if len(s["keys"]):
            keys = b"".join(_varint(int(k) % (1 << 64)) for k in s["keys"])
            body += b"\x12" + _varint(len(keys)) + keys
        if len(s["vals"]):
            vals = struct.pack(f"<{len(s['vals'])}f", *s["vals"])
            body += b"\x1a" + _varint(len(vals)) + vals
        out += b"\x0a" + _varint(len(body)) + body
    return out


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(payload)) + payload


def frames(raw: bytes) -> Iterator[bytes]:
    """Payloads up to the end, a wrong mark or a short record."""
    at = 0
    while at + 8 <= len(raw):
        magic, n = struct.unpack_from("<II", raw, at)
        if magic != MAGIC or at + 8 + n > len(raw):
            return
        yield raw[at + 8 : at + 8 + n]
        at += 8 + n


def encode_records(examples: DataFrame) -> DataFrame:
    """(row_id, record): each example as a framed record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [frame(encode_example(s)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], names=["row_id", "record"])

    return examples.select(F.col("row_id").cast("long").alias("row_id"), "slots").mapInArrow(run, "row_id long, record binary")


def decode_records(files: DataFrame) -> DataFrame:
    """(file, seq, slots) from (file, content); a file is one task's work. Small files share batches, large ones are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seqs, slots = [], [], []
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for seq, payload in enumerate(frames(memoryview(content.as_buffer()).cast("B"))):
                    names.append(file)
                    seqs.append(seq)
                    slots.append(decode_example(payload))
                    if len(seqs) >= DECODED:
                        yield _decoded(names, seqs, slots)
                        names, seqs, slots = [], [], []
        if seqs:
            yield _decoded(names, seqs, slots)

    return files.select(F.col("file").cast("string").alias("file"), "content").where("content is not null").mapInArrow(run, f"file string, seq long, slots {SLOTS}")


def _decoded(names: list[str], seqs: list[int], slots: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(slots, _ARROW_SLOTS)], names=["file", "seq", "slots"])


def read_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return decode_records(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content"))


def read_array(spark: SparkSession, path: str, dtype: str = "<u8", begin: int = 0, end: int | None = None) -> DataFrame:
    """(file, idx, value) of files that are a raw little-endian vector, or elements begin to end of it."""
    kind = "double" if np.dtype(dtype).kind == "f" else "long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                values = np.frombuffer(bytes(content), dtype)[begin:end]
                values = values.view("<i8") if values.dtype == np.dtype("<u8") else values
                yield pd.DataFrame({"file": file, "idx": np.arange(begin, begin + len(values)), "value": values})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, idx long, value {kind}")


def read_matrix(spark: SparkSession, stem: str, valued: bool = True) -> DataFrame:
    """(row, col, val) of a row-major matrix kept as arrays stem.offset, stem.index and, if valued, stem.value."""
    offset = read_array(spark, f"{stem}.offset").select("idx", "value")
    row = offset.join(offset.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("end")), "idx").where("end > value")
    places = row.select(F.col("idx").alias("row"), F.explode(F.sequence("value", F.col("end") - 1)).alias("idx"))
    found = places.join(read_array(spark, f"{stem}.index", "<u4").select("idx", F.col("value").alias("col")), "idx")
    if valued:
        found = found.join(read_array(spark, f"{stem}.value", "<f8").select("idx", F.col("value").alias("val")), "idx")
    else:
        found = found.withColumn("val", F.lit(1.0))
    return found.select("row", "col", "val")
