"""Queries that write lines from the driver's tables and parse them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import category_key, crc32c
from ..functions.keys import format_key
from ..functions.numbers import to_float, to_int, to_key
from ..sources import examples, models, records
from .catalogue import QUERIES, SQL, query, r
from .hash_sql import KEY, crc32c as crc32c_sql, murmur_ctes
from .tables import ROWS_SQL, entries, entries_sql, read, rows, tasks, weight, weight_sql


def _flat(spark: SparkSession, d: str, lines: DataFrame, fmt: str, ignore_groups: bool = False) -> DataFrame:
    """(row_id, slot, key, val) of all elements, the label included."""
    parsed = examples.parse_lines(lines, fmt, ignore_groups).where("ok")
    return examples.entries(parsed).select("row_id", "slot", "key", r("val").alias("val"))


def _orders(spark: SparkSession, d: str, *slots: int) -> DataFrame:
    """row_id, y and e: the sorted entries of every order that has some."""
    e = entries(spark, d, *slots).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("slot", "key", "val"))).alias("e"))
    return rows(spark, d).join(e, "row_id")


def _joined(e: str, f) -> Column:  # noqa: ANN001
    return F.array_join(F.transform(e, f), " ")


LABELS = "SELECT row_id, 0 AS slot, 0 AS key, y AS val FROM rows WHERE row_id IN (SELECT row_id FROM entries)"
SHORT = "1 AS slot, key % 1000000000000"


@query("parse_libsvm", f"WITH {ROWS_SQL}, {entries_sql(1)} {LABELS} UNION ALL SELECT row_id, {SHORT}, round(val, 6) FROM entries")
def parse_libsvm(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda e: F.concat_ws(":", (e["key"] % 1000000000000).cast("string"), e["val"].cast("string"))
    return _flat(spark, d, _orders(spark, d, 1).select("row_id", F.concat_ws(" ", F.col("y").cast("string"), _joined("e", pair)).alias("value")), "LIBSVM")


@query("parse_adfea", f"WITH {ROWS_SQL}, {entries_sql(2, 3)} {LABELS} UNION ALL SELECT row_id, slot, key % 1000000000000, 1.0 FROM entries")
def parse_adfea(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda e: F.concat_ws(":", (e["key"] % 1000000000000).cast("string"), e["slot"].cast("string"))
    line = F.concat_ws(" ", F.col("row_id").cast("string"), F.lit("1"), F.greatest("y", F.lit(0.0)).cast("int").cast("string"), _joined("e", pair))
    return _flat(spark, d, _orders(spark, d, 2, 3).select("row_id", line.alias("value")), "ADFEA")


@query("parse_adfea_one_group", f"WITH {ROWS_SQL}, {entries_sql(2, 3)} {LABELS} UNION ALL SELECT row_id, {SHORT}, 1.0 FROM entries")
def parse_adfea_one_group(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda e: F.concat_ws(":", (e["key"] % 1000000000000).cast("string"), e["slot"].cast("string"))
    line = F.concat_ws(" ", F.col("row_id").cast("string"), F.lit("1"), F.greatest("y", F.lit(0.0)).cast("int").cast("string"), _joined("e", pair))
    return _flat(spark, d, _orders(spark, d, 2, 3).select("row_id", line.alias("value")), "ADFEA", True)


@query("parse_terafea", f"WITH {ROWS_SQL}, {entries_sql(2, 3)} {LABELS} UNION ALL SELECT row_id, slot, slot * 18014398509481984 + key % 1000000000000, 1.0 FROM entries")
def parse_terafea(spark: SparkSession, d: str) -> DataFrame:
    key = lambda e: (e["slot"] * F.lit(1 << 54) + e["key"] % 1000000000000).cast("string")
    line = F.concat_ws(" ", F.greatest("y", F.lit(0.0)).cast("int").cast("string"), F.col("row_id").cast("string"), F.lit("|"), _joined("e", key))
    return _flat(spark, d, _orders(spark, d, 2, 3).select("row_id", line.alias("value")), "TERAFEA")


def _native(form) -> Column:  # noqa: ANN001
    parts = []
    for s in (1, 2):
        own = F.filter("e", _is_slot(s))
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{s} "), F.array_join(F.transform(own, form), " "), F.lit("; "))).otherwise(F.lit("")))
    return F.concat(F.col("y").cast("int").cast("string"), F.lit("; "), *parts)


def _is_slot(s: int):  # noqa: ANN202
    return lambda e: e["slot"] == s


@query("parse_sparse", f"WITH {ROWS_SQL}, {entries_sql(1, 2)} {LABELS} UNION ALL SELECT row_id, slot, key % 1000000000000, round(val, 6) FROM entries")
def parse_sparse(spark: SparkSession, d: str) -> DataFrame:
    line = _native(lambda e: F.concat_ws(":", (e["key"] % 1000000000000).cast("string"), e["val"].cast("string")))
    return _flat(spark, d, _orders(spark, d, 1, 2).select("row_id", line.alias("value")), "SPARSE")


@query("parse_sparse_binary", f"WITH {ROWS_SQL}, {entries_sql(1, 2)} {LABELS} UNION ALL SELECT row_id, slot, key % 1000000000000, 1.0 FROM entries")
def parse_sparse_binary(spark: SparkSession, d: str) -> DataFrame:
    line = _native(lambda e: (e["key"] % 1000000000000).cast("string"))
    return _flat(spark, d, _orders(spark, d, 1, 2).select("row_id", line.alias("value")), "SPARSE_BINARY")


@query("parse_dense", "SELECT vec_id AS row_id, 0 AS slot, 0 AS key, CASE WHEN label > 4 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS val FROM embeddings UNION ALL SELECT vec_id, 1, i, round(x, 6) FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def parse_dense(spark: SparkSession, d: str) -> DataFrame:
    values = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    line = F.concat(F.when(F.col("label") > 4, "1").otherwise("-1"), F.lit("; 1 "), values)
    return _flat(spark, d, read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), line.alias("value")), "DENSE")


def _criteo(spark: SparkSession, d: str) -> DataFrame:
    """Counts from line items (empty where the line number is low), categoricals from dates and flags, some too short."""
    used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    li = read(spark, d, "lineitem").select(used).repartition(tasks(spark, d))  # a line makes 34 rows; tasks of whole files would be few and long
    counts = [F.when(F.col("l_linenumber") > i % 4, (F.col("l_partkey") % (i + 2)).cast("string")).otherwise(F.lit("")) for i in range(13)]
    words = [F.when(F.lit(i % 5 == 0), F.lit("abc")).otherwise(F.hex(F.col("l_suppkey") * (i + 1) + 65536)) for i in range(26)]
    line = F.concat_ws("\t", F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), *counts, *words)
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(n.cast("bigint").alias("row_id"), line.alias("value"))


_COUNT_SQL = " UNION ALL ".join(
    f"SELECT row_id, {i + 1} AS slot, ({((1 << 64) - 1) // 13 * i}::HUGEINT + CASE WHEN l_linenumber > {i % 4} THEN l_partkey % {i + 2} ELSE 0 END) AS k FROM l" for i in range(13)
)


@query(
    "parse_criteo_ints",
    f"WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, * FROM lineitem) SELECT row_id, 0 AS slot, '0' AS key, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS val FROM l UNION ALL SELECT row_id, slot, k::VARCHAR, 1.0 FROM ({_COUNT_SQL})",
)
def parse_criteo_ints(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, _criteo(spark, d), "CRITEO_INTEGERS").withColumn("key", format_key(F.col("key")).cast("string"))


_TEXTS, _HASHED = murmur_ctes("texts", "t")
_WORD_SQL = " UNION ALL ".join(f"SELECT row_id, {14 + i} AS slot, printf('%X', l_suppkey * {i + 1} + 65536) AS t FROM l" for i in range(26) if i % 5)  # the others are too short


@query(
    "parse_criteo_full",
    f"""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, * FROM lineitem), counts AS ({_COUNT_SQL}), words AS ({_WORD_SQL}), texts AS (SELECT DISTINCT t FROM words), {", ".join(_TEXTS)}
SELECT row_id, 0 AS slot, 0::BIGINT AS key, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS val FROM l
UNION ALL SELECT row_id, slot, CASE WHEN k >= 9223372036854775808 THEN (k - 18446744073709551616)::BIGINT ELSE k::BIGINT END, 1.0 FROM counts
UNION ALL SELECT row_id, slot, {KEY}, 1.0 FROM words JOIN {_HASHED} USING (t)""",
)
def parse_criteo_full(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, _criteo(spark, d), "CRITEO")


_NAMES, _NAMED = murmur_ctes("names", "c_name")


@query("murmur_keys", f"WITH names AS (SELECT c_custkey, c_name FROM customer), {', '.join(_NAMES)} SELECT c_custkey, {KEY} AS key, {crc32c_sql('c_name')} AS crc32c FROM {_NAMED}")
def murmur_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", category_key("c_name").alias("key"), crc32c(F.col("c_name").cast("binary")).alias("crc32c"))


@query("recordio_roundtrip", f"WITH {ROWS_SQL}, {entries_sql(1, 2)} {LABELS} UNION ALL SELECT row_id, slot, key, round(val, 4) FROM entries")
def recordio_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = lambda s, f: F.transform(F.filter("e", _is_slot(s)), f)
    slots = F.array(examples.slot(0, None, F.array("y")), examples.slot(1, own(1, lambda e: e["key"]), own(1, lambda e: e["val"])), examples.slot(2, own(2, lambda e: e["key"])))
    made = records.encode_records(_orders(spark, d, 1, 2).select("row_id", slots.alias("slots")))
    back = records.decode_records(made.select(F.col("row_id").cast("string").alias("file"), F.col("record").alias("content")))
    flat = examples.entries(back.select(F.col("file").cast("bigint").alias("row_id"), "slots"))
    return flat.select("row_id", "slot", "key", r("val", 4).alias("val"))


@query("native_text_roundtrip", f"WITH {ROWS_SQL}, {entries_sql(1)} {LABELS} UNION ALL SELECT row_id, slot, key, round(val, 6) FROM entries")
def native_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    slots = F.array(examples.slot(0, None, F.array("y")), examples.slot(1, F.transform("e", lambda e: e["key"]), F.transform("e", lambda e: e["val"])))
    made = _orders(spark, d, 1).select("row_id", slots.alias("slots"))
    return _flat(spark, d, examples.native_lines(made), "SPARSE")


@query("model_text_roundtrip", f"WITH {entries_sql(1)} SELECT key, round({weight_sql()}, 6) AS w FROM (SELECT DISTINCT key FROM entries) WHERE {weight_sql()} <> 0")
def model_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    model = entries(spark, d, 1).select("key").distinct().select("key", weight(F.col("key")).alias("w"))
    return models.parse_model(models.model_lines(model).select(F.monotonically_increasing_id().alias("line"), "value")).select("key", r("w").alias("w"))


@query(
    "read_numbers",
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END::INTEGER AS i, round(o_totalprice, 4) AS x, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders",
)
def read_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    number = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        to_int(F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("  "), number))).alias("i"),
        r(to_float(F.col("o_totalprice").cast("string")), 4).alias("x"),
        to_key(F.when(F.col("o_orderkey") % 3 == 0, F.concat(number, F.lit(" "))).otherwise(number)).alias("k"),
    )


__all__ = ["QUERIES", "SQL"]
