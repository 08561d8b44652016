"""Model files: key, tab, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import format_key
from ..functions.numbers import to_float, to_key


def model_lines(model: DataFrame) -> DataFrame:
    """value: a line for each weight (key, w) that is neither zero nor NaN."""
    return model.where("w <> 0 and not isnan(w)").select(F.concat_ws("\t", format_key(F.col("key")).cast("string"), F.col("w").cast("string")).alias("value"))


def write_model(model: DataFrame, path: str, iteration: int | None = None) -> None:
    """Text files under path, with _it_<n> behind it for checkpoints of a run."""
    model_lines(model).write.mode("overwrite").text(path if iteration is None else f"{path}_it_{iteration}")


def parse_model(lines: DataFrame) -> DataFrame:
    """(key, w) from lines (line, value) in order of `line`; of a repeated key the last counts, lines that don't parse don't."""
    parts = F.split(F.trim("value"), r"[ \t]+")
    read = lines.select("line", to_key(F.get(parts, F.lit(0))).alias("key"), to_float(F.get(parts, F.lit(1))).alias("w"), F.size(parts).alias("n"))
    return read.where("n = 2 and key is not null and w is not null").groupBy("key").agg(F.max_by("w", "line").alias("w"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return parse_model(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))
