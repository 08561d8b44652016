"""Sparse examples from text.

Every reader returns (row_id, ok, slots): slots is an array of (id, keys, vals) with the label as slot 0. Rows that do not
parse have ok false and null slots; read_examples() drops them. All parsing is column expressions but for the categorical
hash, which is an Arrow function over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import category_keys, rehash_key
from ..functions.keys import group_of, hash_kernel
from ..functions.numbers import to_float, to_int, to_key, to_label
from ..operators.online import number_rows

SLOT = "struct<id: int, keys: array<bigint>, vals: array<double>>"
SLOTS = f"array<{SLOT}>"
#: Slots from here on reject their row.
MOST_SLOTS = 4096
#: Files over which the elements of one slot are spread at most, for each task that writes.
PARTS_A_SLOT = 32
#: Lines of this many bytes or more don't fit the buffer of readers of these formats.
LINE_BYTES = 60 * 1024


def slot(id: Column | int, keys: Column | None = None, vals: Column | None = None) -> Column:
    none = F.array()
    return F.struct((id if isinstance(id, Column) else F.lit(id)).cast("int").alias("id"), (none if keys is None else keys).cast("array<bigint>").alias("keys"), (none if vals is None else vals).cast("array<double>").alias("vals"))


def _label(value: Column) -> Column:
    return slot(0, None, F.array(value))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(x), body), 1)


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(text, pattern), "")


def _whole(xs: Column) -> Column:
    return F.forall(xs, lambda x: x.isNotNull())


def libsvm(line: Column, ignore_groups: bool = False) -> Column:
    """label k:v k:v ...; ids must not fall, the label stays as it is. Blank lines are rejected."""
    bare = lambda k: k.bitwiseXOR(F.lit(-(1 << 63)))

    def told(tokens: Column) -> Column:
        pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.split(t, ":"))
        read = F.transform(pairs, lambda p: F.when(F.size(p) == 2, F.struct(to_key(F.get(p, F.lit(0))).alias("k"), to_float(F.get(p, F.lit(1))).alias("v"))))
        return F.struct((F.size(tokens) > 0).alias("any"), to_float(F.get(tokens, F.lit(0))).alias("label"), read.alias("pairs"))

    def made(t: Column) -> Column:
        pairs = t["pairs"]
        rising = F.forall(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (bare(F.get(pairs, i)["k"]) >= bare(F.get(pairs, i - 1)["k"])))
        ok = t["any"] & t["label"].isNotNull() & F.forall(pairs, lambda p: p.isNotNull() & p["k"].isNotNull() & p["v"].isNotNull())
        ok = ok & F.when(F.size(pairs) > 0, rising).otherwise(F.lit(True))
        return F.struct(ok.alias("ok"), F.array(_label(t["label"]), slot(1, F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"]))).alias("slots"))

    out = _let(_let(_tokens(line, r"[ \t\r\n]+"), told), made)
    return out


def adfea(line: Column, ignore_groups: bool = False) -> Column:
    """line_id 1 clicked k:g k:g ...; a slot begins wherever the group differs from the one before."""
    none = F.array().cast("array<struct<k: bigint, g: int>>")

    def told(tokens: Column) -> Column:
        n = F.floor((F.size(tokens) - 3) / 2).cast("int")
        pair = lambda i: F.struct(to_key(F.get(tokens, 2 * i + 3)).alias("k"), to_int(F.get(tokens, 2 * i + 4)).alias("g"))
        pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(none)
        return F.struct(to_int(F.get(tokens, F.lit(2))).alias("label"), pairs.alias("pairs"), ((F.size(tokens) >= 3) & ((F.size(tokens) - 3) % 2 == 0)).alias("ok"))

    def made(t: Column) -> Column:
        slots = F.array(slot(1, F.transform(t["pairs"], lambda p: p["k"]))) if ignore_groups else _runs(t["pairs"])
        ok = t["ok"] & t["label"].isNotNull() & F.forall(t["pairs"], lambda p: p["k"].isNotNull() & p["g"].isNotNull() & (p["g"] > 0))
        return F.struct(ok.alias("ok"), F.concat(F.array(_label(to_label(t["label"]))), slots).alias("slots"))

    out = _let(_let(_tokens(line, "[ :]+"), told), made)
    return out


def _runs(pairs: Column) -> Column:
    """One slot for each run of pairs (k, g) with equal g."""
    first = lambda p, i: (i == 0) | (F.get(pairs, i - 1)["g"] != p["g"])
    starts = F.filter(F.transform(pairs, lambda p, i: F.when(first(p, i), i)), lambda i: i.isNotNull())
    run = lambda ss: F.transform(ss, lambda s, j: slot(F.get(pairs, s)["g"], F.transform(F.slice(pairs, s + 1, F.coalesce(F.get(ss, j + 1), F.size(pairs)) - s), lambda p: p["k"])))
    return _let(starts, run)


def terafea(line: Column, ignore_groups: bool = False, rehash: bool = False) -> Column:
    """clicked line_id | key key ...; the slot is the top ten bits of the key, which stays whole."""
    def told(tokens: Column) -> Column:
        keys = F.transform(F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0))), to_key)
        return F.struct((F.size(tokens) >= 2).alias("any"), to_int(F.get(tokens, F.lit(0))).alias("label"), keys.alias("keys"))

    def made(t: Column) -> Column:
        keys = t["keys"]
        groups = F.array_distinct(F.transform(keys, group_of))
        slots = F.array(slot(1, keys)) if ignore_groups else F.transform(groups, lambda g: slot(g, F.filter(keys, lambda k: group_of(k) == g)))
        ok = t["any"] & t["label"].isNotNull() & _whole(keys)
        if not ignore_groups:
            ok = ok & F.forall(keys, lambda k: group_of(k) > 0)  # group 0 would fall into the label
        return F.struct(ok.alias("ok"), F.concat(F.array(_label(to_label(t["label"]))), slots).alias("slots"))

    out = _let(_let(_tokens(line, "[ |]+"), told), made)
    return out


def _native(line: Column, ignore_groups: bool, kind: str) -> Column:
    rest = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    each = lambda t, odd: F.filter(rest(t), lambda _, i: (i % 2 == 1) if odd else (i % 2 == 0))
    none = F.array().cast("array<string>")
    keys, vals = {
        "dense": (lambda t: none, rest),
        "sparse": (lambda t: each(t, False), lambda t: each(t, True)),
        "binary": (rest, lambda t: none),
    }[kind]
    group = lambda t: F.struct(to_int(F.get(t, F.lit(0))).alias("id"), F.transform(keys(t), to_key).alias("keys"), F.transform(vals(t), to_float).alias("vals"))
    good = lambda s: s["id"].isNotNull() & (s["id"] > 0) & _whole(s["keys"]) & _whole(s["vals"]) & ((F.size(s["keys"]) == F.size(s["vals"])) if kind == "sparse" else F.lit(True))

    def told(sections: Column) -> Column:
        groups = F.transform(rest(sections), lambda s: _let(_tokens(s, "[ :]+"), group))
        return F.struct((F.size(sections) > 0).alias("any"), to_int(F.get(sections, F.lit(0))).alias("label"), groups.alias("groups"))

    def made(t: Column) -> Column:
        groups = t["groups"]
        if ignore_groups:
            slots = F.array(slot(1, F.flatten(F.transform(groups, lambda s: s["keys"])), F.flatten(F.transform(groups, lambda s: s["vals"]))))
        else:
            slots = F.transform(groups, lambda s: slot(s["id"], s["keys"], s["vals"]))
        ok = t["any"] & t["label"].isNotNull() & F.forall(groups, good)
        return F.struct(ok.alias("ok"), F.concat(F.array(_label(to_label(t["label"]))), slots).alias("slots"))

    out = _let(_let(F.array_remove(F.transform(F.split(line, ";"), lambda s: F.trim(s)), ""), told), made)
    return out


def dense(line: Column, ignore_groups: bool = False) -> Column:
    """label; group v v v; ..."""
    return _native(line, ignore_groups, "dense")


def sparse(line: Column, ignore_groups: bool = False) -> Column:
    """label; group k:w k:w; ... (or k w)"""
    return _native(line, ignore_groups, "sparse")


def sparse_binary(line: Column, ignore_groups: bool = False) -> Column:
    """label; group k k k; ..."""
    return _native(line, ignore_groups, "binary")


#: Integer and categorical columns of the tab-separated format.
INTEGERS, CATEGORIES = 13, 26


def criteo_integers(line: Column, ignore_groups: bool = False) -> Column:
    """The label and integer columns: column i with count c has key (2**64-1) / 13 * i + c, wrapping. Empty counts are 0."""
    # Where each column begins, as a bigint of the same bits. None lies within 2**32 of the end of the range, so that adding a
    # count of 32 bits wraps at 2**64 without overflow.
    begins = F.array(*[F.lit(_signed(((1 << 64) - 1) // INTEGERS * i)) for i in range(INTEGERS)])

    def told(fields: Column) -> Column:
        counts = F.transform(F.slice(fields, 2, INTEGERS), to_int)
        return F.struct((F.size(fields) >= INTEGERS + CATEGORIES).alias("any"), to_float(F.get(fields, F.lit(0))).alias("label"), counts.alias("counts"))

    def made(t: Column) -> Column:
        slots = F.transform(t["counts"], lambda c, i: F.when(c.isNotNull(), slot(i + 1, F.array(F.get(begins, i) + c.cast("bigint")))))
        every = F.filter(slots, lambda s: s.isNotNull())
        if ignore_groups:
            every = F.array(slot(1, F.flatten(F.transform(every, lambda s: s["keys"]))))
        return F.struct((t["any"] & t["label"].isNotNull()).alias("ok"), F.concat(F.array(_label(to_label(t["label"]))), every).alias("slots"))

    out = _let(_let(F.split(line, "\t"), told), made)
    return out


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


@F.arrow_udf(T.ArrayType(T.StructType().add("id", "integer").add("keys", T.ArrayType(T.LongType())).add("vals", T.ArrayType(T.DoubleType()))))
def _category_slots(fields: pa.Array) -> pa.Array:
    """The slots of rows of categoricals, for all rows of a batch at once; values repeat, and each is hashed once."""
    sizes, texts = pc.list_value_length(fields).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), fields.flatten().cast(pa.binary())
    long = pc.greater(pc.binary_length(texts), 4).fill_null(False)
    kept, at = texts.filter(long).dictionary_encode(), np.flatnonzero(long.to_numpy(zero_copy_only=False))
    keys = category_keys(kept.dictionary.to_pylist())[kept.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(fields)), sizes)[at]
    ids = (at - (np.cumsum(sizes) - sizes)[row] + INTEGERS + 1).astype(np.int32)
    places = np.arange(len(at) + 1, dtype=np.int32)
    slots = [pa.array(ids), pa.ListArray.from_arrays(pa.array(places), pa.array(keys)), pa.ListArray.from_arrays(pa.array(0 * places), pa.array([], pa.float64()))]
    ends = np.cumsum(np.bincount(row, minlength=len(fields)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays(slots, ["id", "keys", "vals"]))


def criteo(line: Column, ignore_groups: bool = False) -> Column:
    """Integers as above; a categorical of more than four bytes has its hash as key, shorter ones are dropped."""
    named = _category_slots(F.slice(F.split(line, "\t"), INTEGERS + 2, CATEGORIES))

    def made(t: Column) -> Column:
        integers, named = t["integers"]["slots"], t["named"]
        if ignore_groups:
            slots = F.concat(F.slice(integers, 1, 1), F.array(slot(1, F.concat(F.get(integers, F.lit(1))["keys"], F.flatten(F.transform(named, lambda s: s["keys"]))))))
        else:
            slots = F.concat(integers, named)
        return F.struct(t["integers"]["ok"].alias("ok"), slots.alias("slots"))

    return _let(F.struct(criteo_integers(line, ignore_groups).alias("integers"), named.alias("named")), made)


FORMATS = {"LIBSVM": libsvm, "ADFEA": adfea, "TERAFEA": terafea, "DENSE": dense, "SPARSE": sparse, "SPARSE_BINARY": sparse_binary, "CRITEO": criteo, "CRITEO_INTEGERS": criteo_integers}


def parse_lines(lines: DataFrame, fmt: str, ignore_groups: bool = False, rehash: bool = False) -> DataFrame:
    """row_id, ok and slots from lines (row_id, value). A trailing carriage return is dropped; rows with a slot of 4096 or
    more are rejected; a null line is rejected."""
    few = lambda p: F.coalesce(F.forall(p["slots"], lambda s: s["id"] < MOST_SLOTS), F.lit(False))
    told = lambda p: F.struct((F.coalesce(p["ok"], F.lit(False)) & few(p)).alias("ok"), p["slots"].alias("slots"))
    # Each step's result is bound before it is used, and filters stay behind inline(), so that no part parses the line again.
    parsed = _let(FORMATS[fmt](F.regexp_replace("value", r"\r$", ""), ignore_groups), told)
    out = lines.select("row_id", F.inline(F.array(parsed))).select("row_id", "ok", F.when(F.col("ok"), F.col("slots")).alias("slots"))
    if rehash:
        flat = entries(out.where("ok")).where("slot > 0").withColumn("key", rehash_key("key"))
        back = flat.groupBy("row_id", "at", "slot").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "val"))).alias("e"))
        slots = back.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("slot").alias("id"), F.transform("e", lambda e: e["key"]).alias("keys"), F.array().cast("array<double>").alias("vals")))).alias("made"))
        joined = out.join(slots, "row_id", "left")
        return joined.select("row_id", "ok", F.when(F.col("ok"), F.concat(F.slice("slots", 1, 1), F.coalesce(F.transform("made", lambda s: F.struct(s["id"].alias("id"), s["keys"].alias("keys"), s["vals"].alias("vals"))), F.array().cast(SLOTS)))).alias("slots"))
    return out


def read_examples(spark: SparkSession, paths: list[str] | str, fmt: str, ignore_groups: bool = False, kernel: int = 0, max_lines: int = 0, line_bytes: int = LINE_BYTES, one_text: bool = False) -> DataFrame:
    """Examples of text files (plain or .gz, of any file system Spark reads) as (row_id, slots). Lines that do not parse, and
    those of line_bytes or more (0: no limit), are left out. row_id is file and offset order within this read. kernel > 0
    takes keys modulo it; max_lines keeps the first lines of each file; one_text: of all files,
    in the order of their names, as parts of one text."""
    lines = spark.read.text(paths).select(F.monotonically_increasing_id().alias("row_id"), "value", F.input_file_name().alias("file"))
    if max_lines:
        lines = number_rows(lines, "row_id", ("file",)).where(F.col("n") <= max_lines)
        if one_text:
            kept = lines.groupBy("file").agg(F.count("*").alias("_c"))  # a row for each file
            before = F.sum("_c").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
            starts = kept.select("file", F.coalesce(before, F.lit(0)).alias("_start"))
            lines = lines.join(starts, "file").where(F.col("_start") + F.col("n") <= max_lines)
    if line_bytes:
        lines = lines.where(F.octet_length("value") < line_bytes)
    parsed = parse_lines(lines.select("row_id", "value"), fmt, ignore_groups).where("ok").select("row_id", "slots")
    if kernel:
        hashed = F.transform("slots", lambda s: F.struct(s["id"].alias("id"), F.transform(s["keys"], lambda k: hash_kernel(k, kernel)).alias("keys"), s["vals"].alias("vals")))
        parsed = parsed.select("row_id", hashed.alias("slots"))
    return parsed


def entries(examples: DataFrame, *also: str) -> DataFrame:
    """(row_id, at, slot, pos, key, val) and the columns `also`: one row for each key or value; at is the slot's place in its row. val is 1 where the
    slot is binary, key is the position where it is dense."""
    slots = examples.select("row_id", *also, F.posexplode("slots").alias("at", "s"))
    n = F.greatest(F.size("s.keys"), F.size("s.vals"))
    # Places are exploded and their elements taken afterwards: both are compiled, while a lambda is interpreted for each element.
    each = slots.where(n > 0).select("row_id", *also, "at", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    key, val = F.coalesce(F.get("s.keys", F.col("pos")), F.col("pos").cast("bigint")), F.when(F.size("s.vals") > 0, F.get("s.vals", F.col("pos"))).otherwise(F.lit(1.0))
    return each.select("row_id", *also, "at", F.col("s.id").alias("slot"), "pos", key.alias("key"), val.alias("val"))


def labels(examples: DataFrame) -> DataFrame:
    """(row_id, y): the value of the first slot 0."""
    first = F.get(F.filter("slots", lambda s: s["id"] == 0), F.lit(0))
    return examples.select("row_id", F.get(first["vals"], F.lit(0)).alias("y"))


def native_lines(examples: DataFrame) -> DataFrame:
    """(row_id, value): each example as a line of the native text formats (sparse where a slot has values and keys)."""
    number = lambda x: x.cast("string")
    pairs = lambda s: F.zip_with(s["keys"], s["vals"], lambda k, v: F.concat_ws(":", number(k), number(v)))
    body = lambda s: F.when(F.size(s["keys"]) == 0, F.transform(s["vals"], number)).when(F.size(s["vals"]) == 0, F.transform(s["keys"], number)).otherwise(pairs(s))
    line = lambda s: F.when(s["id"] == 0, F.get(s["vals"], F.lit(0)).cast("int").cast("string")).otherwise(F.concat_ws(" ", s["id"].cast("string"), F.array_join(body(s), " ")))
    return examples.select("row_id", F.concat(F.array_join(F.transform("slots", line), "; "), F.lit(";")).alias("value"))




def write_slots(examples: DataFrame, path: str, parts: int | None = None) -> None:
    """A columnar copy of all elements, in a folder for each slot, the label in slot 0: parsed once, and read slot by slot.

    parts: how many tasks write, for examples of any number; None leaves it to the session, and deals a slot to at most
    PARTS_A_SLOT of them.
    """
    own = entries(examples)
    part = F.pmod(F.xxhash64("row_id"), F.lit(8 * parts if parts else PARTS_A_SLOT))  # 8, so that tasks get about as much each
    dealt = own.repartition(parts, "slot", part) if parts else own.repartition("slot", part)
    dealt.write.mode("overwrite").partitionBy("slot").parquet(path)


def read_slots(spark: SparkSession, path: str, *slots: int) -> DataFrame:
    """(row_id, at, slot, pos, key, val) of the named slots, all if none is named; other slots' files are not opened."""
    held = spark.read.parquet(path).select("row_id", "at", "slot", "pos", "key", "val")
    return held.where(F.col("slot").isin(*slots)) if slots else held
