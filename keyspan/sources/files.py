"""Which files make up a data set."""

from __future__ import annotations

import random
import re

from pyspark.sql import SparkSession


def search_files(spark: SparkSession, patterns: list[str], strip_extension: bool = False) -> list[str]:
    """Files whose base name matches the last part of a pattern, a regular expression, in the folder before it. Sorted,
    without repeats, from any file system that Spark knows. strip_extension names a stem once for all its files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = set()
    for pattern in patterns:
        folder, _, name = pattern.rpartition("/")
        path = jvm.org.apache.hadoop.fs.Path(folder or ".")
        for status in path.getFileSystem(conf).listStatus(path):
            base = status.getPath().getName()
            if re.fullmatch(name, base):
                found.add(f"{folder or '.'}/{_stem(base) if strip_extension else base}")
    return sorted(found)


def _stem(name: str) -> str:
    return name.removesuffix(".gz").rpartition(".")[0] or name


def divide_files(files: list[str], n: int, most: int = -1) -> list[list[str]]:
    """Dealt round robin to n parts, at most `most` each if that is not negative."""
    parts = [files[i::n] for i in range(n)]
    return parts if most < 0 else [p[:most] for p in parts]


def epochs(files: list[str], replica: int = 1, shuffle: bool = False, seed: int = 0) -> list[str]:
    """The files `replica` times over, in random order if asked."""
    every = files * replica
    if shuffle:
        random.Random(seed).shuffle(every)
    return every


def append_files(*lists: list[str]) -> list[str]:
    return [f for one in lists for f in one]
