"""Benchmark decontamination by winnowing.

Documents and benchmark items are fingerprinted alike: words are hashed, every k words in a row form a gram, and of every
13 - k + 1 grams in a row the least is kept. Two texts that share 13 words in a row share all grams of that span, hence its
least one. Fingerprints meet in a join; around each hit the windows are spelled out and compared as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, let, lower_ascii, pick

#: Characters between words: ASCII without letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
#: Benchmark tables of up to this many fingerprints or windows are broadcast.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of every k words in a row. lower() joins more than A-Z, which only adds hits that the text then refutes."""
    hashes = F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    every = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)])))
    return F.coalesce(let(hashes, every), F.array().cast("array<bigint>"))


def _least(grams: Column, w: int) -> Column:
    """The least of every w grams in a row."""
    every = lambda g: F.when(F.size(g) >= w, F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[g[i + j] for j in range(w)])))
    return F.coalesce(let(grams, every), F.array().cast("array<bigint>"))


def _runs(marks: Column) -> Column:
    """Equal neighbours as one: mark, where it begins (s) and how often it stands there (n)."""

    def told(m: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (m[i] != F.get(m, i - 1)))
        return let(at, lambda a: F.transform(a, lambda i, k: F.struct(m[i].alias("mark"), i.alias("s"), (F.coalesce(F.get(a, k + 1), F.size(m)) - i).alias("n"))))

    return let(marks, lambda m: F.when(F.size(m) > 0, told(m)))


def _spelled(words: Column, start: Column, n: Column) -> Column:
    return lower_ascii(F.array_join(F.slice(words, start + 1, n), " "))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, _hash (of the text), n_words, n_hit, items (array of item_id as strings, sorted).

    A window is `window` words in a row of an item (item_id, text), or a whole item of fewer words. A document word is hit
    if it lies in an occurrence of a window; an item counts if one of its windows occurs.

    A null or wordless text has no words and no hits; a null or wordless item has no windows, and an item without an id
    adds hits but is not listed. Repeated documents each get a row; repeated items count once. Any table may be empty.
    """
    docs = pick(docs, "doc_id", "text").withColumns({"_hash": F.xxhash64("text")})
    split = docs.select("doc_id", "_hash", words_of(F.col("text")).alias("words"))
    items = pick(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    lengths = [r[0] for r in items.where(F.size("words").between(1, window - 1)).select(F.size("words")).distinct().collect()]  # fewer than `window` numbers

    wide = F.least(F.size("words"), F.lit(window))
    windows = items.where(F.size("words") > 0).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - wide), lambda s: _spelled(F.col("words"), s, wide))).alias("window")).distinct()
    distinct_windows = windows.select("window").distinct()
    if is_small(distinct_windows, broadcast_rows):
        distinct_windows = F.broadcast(distinct_windows)

    # Where the fingerprints of a document meet those of items: windows from s on, n of them. Arrays of words are never
    # repeated for each fingerprint, so that the work grows with the length of a text and not with its square.
    met = []
    for n in [window, *sorted(lengths)]:
        own = F.size("words") >= window if n == window else F.size("words") == n
        marks = _least(_grams(F.col("words"), gram), window - gram + 1) if n == window else _grams(F.col("words"), n)
        told = split.where(F.size("words") >= n).select("doc_id", "_hash", F.inline(_runs(marks)))
        wanted = items.where(own).select(F.explode(marks).alias("mark")).distinct()
        if is_small(wanted, broadcast_rows):
            wanted = F.broadcast(wanted)
        met.append(told.join(wanted, "mark", "left_semi").select("doc_id", "_hash", F.struct(F.lit(n).alias("w"), "s", "n").alias("run")))
    key = ["doc_id", "_hash"]
    found = cut(reduce(DataFrame.union, met).groupBy(*key).agg(F.collect_set("run").alias("runs")).withColumnsRenamed({"doc_id": "_id", "_hash": "_h"}))
    size = found.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]

    # There the windows are spelled out.
    hit = split.join(F.broadcast(found) if size <= broadcast_rows else found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")))
    each = lambda r: F.transform(F.sequence(r["s"], r["s"] + r["n"] - 1), lambda s: F.struct(s.alias("s"), r["w"].alias("n"), _spelled(F.col("words"), s, r["w"]).alias("window")))
    spans = hit.select(*key, F.inline(F.flatten(F.transform("runs", each))))
    # Only documents with hits have spans, and two aggregates read them: they are written once.
    spans = cut(spans.join(distinct_windows, "window", "left_semi").distinct())

    covered = spans.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1))))).cast("long").alias("n_hit"))
    listed = spans.select(*key, "window").distinct().join(windows, "window").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    docs = docs.select(*key, n_words.alias("n_words"))
    for side in (covered, listed):
        other = side.withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
        docs = docs.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_hash").eqNullSafe(F.col("_h")), "left").drop("_id", "_h")
    return docs.select(*key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word hit, and at least a twentieth of all words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of `docs`, with the named columns, that are not contaminated; edge cases as in contamination()."""
    bad = contamination(docs, items).where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).distinct()
    return pick(docs, *columns).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_h")), "left_anti")
