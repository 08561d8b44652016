"""The online solver on Structured Streaming.

Minibatches arrive in order of processing; there is no event time to respect. Each micro-batch is one superstep, and the
model is a table that the step reads and writes anew. Versions are numbered by micro-batch, so a batch that runs again after
a failure starts from the same version and writes the same next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.online import Rule, superstep
from ..sources.examples import entries, labels, parse_lines


def version(path: str, n: int) -> str:
    return f"{path}/version={n:012d}"


def learn(spark: SparkSession, source: str, fmt: str, rule: Rule, model_path: str, checkpoint: str, loss: str = "LOGIT", files_per_batch: int = 1, on_batch: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Trains on the text files of a folder as they come; started with everything there as available now.

    Version n + 1 of the model is what batch n makes of version n; version 0 is empty. Files come by the time of their last
    change; of files with the same time the order is not defined, so writers that need one have to give distinct times.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)

    def step(batch: DataFrame, n: int) -> None:
        numbered = batch.select(F.monotonically_increasing_id().alias("row_id"), "value").persist()
        examples = parse_lines(numbered, fmt).where("ok").select("row_id", "slots")
        state = spark.read.parquet(version(model_path, n)) if n else None
        flat = entries(examples).where("slot > 0").select("row_id", "key", "val")
        new = superstep(state, flat, labels(examples), rule, loss)
        new.write.mode("overwrite").parquet(version(model_path, n + 1))
        if on_batch:
            on_batch(n, new)
        numbered.unpersist()

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Sums(StatefulProcessor):
    """Adds up what is pushed to a key and tells its sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sum = handle.getValueState("sum", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        total = self._sum.get()[0] if self._sum.exists() else 0.0
        for frame in rows:
            total += float(frame["value"].sum())
        self._sum.update((total,))
        yield pd.DataFrame({"key": [key[0]], "value": [total]})

    def close(self) -> None:
        pass


def summing_store(pushes: DataFrame) -> DataFrame:
    """A stream (key, value) of each pushed key's new sum; needs the RocksDB state store provider."""
    return pushes.groupBy("key").transformWithStateInPandas(_Sums(), "key long, value double", "Update", "None")


def running_counts(stream: DataFrame, freq: int) -> DataFrame:
    """A stream (key, cnt) of keys seen more than `freq` times so far."""
    return stream.groupBy("key").agg(F.count("*").alias("cnt")).where(F.col("cnt") > freq)
