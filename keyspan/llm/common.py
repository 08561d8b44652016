"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time.
SLICE_BYTES = 4_000_000
#: Columns that every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds.

    Columns are matched by exact name, so others that differ in case, repeat a name or clash with names that an operator
    makes inside do no harm. Of a repeated name the first counts.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests: a temporary folder of a local session; on a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_folder()
    return top.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder: like a checkpoint, in a fraction of its space for rows of numbers."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def slim_batches(spark: SparkSession) -> None:
    """Hands texts to Python at most 2,000 rows at a time, unless the session says otherwise: they may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back when its task ends: a worker outlives its task, and what it keeps
    comes on top of what the next stages need."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes in a column of texts, at least a row each."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_small(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; stops counting beyond that."""
    return df.limit(most + 1).count() <= most


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
