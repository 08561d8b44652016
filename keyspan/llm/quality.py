"""Quality rules: counts within a document, and lines that too many documents of a host share."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, is_small, lean, pick, slim_batches

#: A line is boilerplate if more than this many distinct texts of its host hold it, however many the host has ...
MAX_DOCS = 20
#: ... and more than this share of them: none, since a limit that grows with the host would spare the same line on a large one.
MAX_SHARE = 0.0
#: A document is depleted if its words outside boilerplate lines are fewer than this ...
MIN_WORDS_LEFT = 10
#: ... or than this share of all its words.
MIN_SHARE_LEFT = 0.3
#: Tasks over which the occurrences of one line are spread where they meet its verdict.
SALTS = 16
#: Up to so many boilerplate lines are broadcast; more meet their documents by shuffle.
BROADCAST_LINES = 200_000

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, digest string, source string, lines array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("source", pa.string()), ("lines", pa.list_(pa.int64()))])


def repeated_words(codes: np.ndarray) -> int:
    """Words covered by the 3-word windows that occur at least twice. codes: equal numbers below 2**21 for equal words."""
    n = len(codes) - 2
    if n < 2:
        return 0
    windows = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for d in range(3):
        covered[d : n + d] |= again
    return int(covered.sum())


def _measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D only
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) >> 21:  # beyond 21 bits a window no longer fits a number
        pairs: dict[tuple, int] = {}
        triples = [pairs.setdefault(t, len(pairs)) for t in zip(words, words[1:], words[2:], strict=False)]
        count = np.bincount(triples)
        covered = np.zeros(len(words), bool)
        hit = np.flatnonzero(count[triples] > 1)
        for d in range(3):
            covered[hit + d] = True
        repeats = int(covered.sum())
    else:
        repeats = repeated_words(codes)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    kept, twice = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in kept:
                twice += 1
            kept.add(line)
    return len(words), chars, len(_SYMBOLS.findall(raw)), twice, repeats


def _line(own: list[bytes]) -> int:
    """The hash by which lines of these words are compared."""
    return int.from_bytes(hashlib.blake2b(b" ".join(own).lower(), digest_size=8).digest(), "little", signed=True)


def _held(text: str) -> list[int]:
    """The distinct lines of a text, without blank ones."""
    return list({_line(own) for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (own := line.split())})


def without_lines(text: str, gone: Collection[int]) -> tuple[str, int]:
    """The text without the lines of these hashes, every other line as it is, and the words in those that went."""
    kept, lost = [], 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        if own and _line(own) in gone:
            lost += len(own)
        else:
            kept.append(line)
    return (b"\n".join(kept).decode("utf-8", "surrogatepass") if lost else text), lost


@lean
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            ids, digests, texts, sources = (part.column(i) for i in range(4))
            yield pa.RecordBatch.from_arrays([ids, digests, sources, pa.array([_held(t or "") for t in texts.to_pylist()], _ARROW.field("lines").type)], schema=_ARROW)


def _cleaned(common: Callable[[], dict] | None) -> Callable:
    """For mapInArrow: replaces text, and adds the counts and words_left. common: boilerplate lines by source; None: the column _gone has a row's own."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common() if common else {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                gone = [known.get(s, ()) for s in part.column("source").to_pylist()] if common else [set(g or ()) for g in part.column("_gone").to_pylist()]
                counts = [_measure(t or "") for t in texts]
                left = [without_lines(t, g) if t and g else (t, 0) for t, g in zip(texts, gone, strict=True)]
                columns = {n: part.column(n) for n in part.schema.names if n != "_gone"}
                columns["text"] = pa.array([t for t, _ in left], pa.string())
                columns |= {n: pa.array([c[k] for c in counts], pa.int64()) for k, n in enumerate(_COUNTS)}
                columns["words_left"] = pa.array([c[0] - lost for c, (_, lost) in zip(counts, left, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """source and line (its hash): the lines of `docs` (doc_id, text, source) that are above both limits."""
    hosts = _rows(docs).mapInArrow(_lines, _SCHEMA).groupBy("source", "digest").agg(F.first("lines").alias("lines"))
    lines = hosts.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    if max_share <= 0:
        return lines.select("source", "line")
    n_texts = hosts.groupBy(F.col("source").alias("_host")).agg(F.count("*").alias("n_texts"))
    # As many rows as sources: small beside the lines, and joined by shuffle unless their size is known to be small.
    return lines.join(n_texts, F.col("source").eqNullSafe(F.col("_host"))).where(F.col("n") > max_share * F.col("n_texts")).select("source", "line")


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text", "source")


def _gone(docs: DataFrame, common: DataFrame) -> DataFrame:
    """_source, _digest, _doc_id and _gone, the boilerplate lines of each document that holds any."""
    # A boilerplate line has more than max_docs occurrences, so SALTS copies of each are fewer than the occurrences.
    salted = common.select(F.col("source").alias("_host"), F.col("line").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    held = _rows(docs).mapInArrow(_lines, _SCHEMA).select("source", "digest", "doc_id", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("lines").alias("line"))
    found = held.join(salted, F.col("source").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")) & (F.col("salt") == F.col("_salt")))
    return found.groupBy(F.col("source").alias("_source"), F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc_id")).agg(F.collect_set("line").alias("_gone"))


def _ruled(docs: DataFrame, columns: tuple[str, ...], max_docs: int, max_share: float, min_words_left: int, min_share_left: float) -> DataFrame:
    """The named columns of `docs`, text without boilerplate lines, and the counts, words_left, base_failed and kept."""
    slim_batches(docs.sparkSession)
    common = cut(boilerplate(docs, max_docs, max_share))
    rows = pick(docs, *columns, *(c for c in ("text", "source", "doc_id") if c not in columns)).withColumn("_own", F.col("doc_id").cast("long")).withColumn("digest", _digest())
    if is_small(common, BROADCAST_LINES):
        known = defaultdict(set)
        for r in common.collect():
            known[r["source"]].add(r["line"])
        sent = docs.sparkSession.sparkContext.broadcast(dict(known))
        work = _cleaned(lambda: sent.value)
    else:
        match = (F.col("digest") == F.col("_digest")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("_own").eqNullSafe(F.col("_doc_id"))
        rows, work = rows.join(_gone(docs, common), match, "left").drop("_source", "_digest", "_doc_id"), _cleaned(None)
    schema = StructType([f for f in rows.schema if f.name != "_gone"])
    for c in (*_COUNTS, "words_left"):
        schema = schema.add(c, "long")
    depleted = (F.col("words_left") < min_words_left) | (F.col("words_left") < min_share_left * F.col("n_words"))
    return rows.mapInArrow(work, schema).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~depleted)


def line_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_words_left: int = MIN_WORDS_LEFT, min_share_left: float = MIN_SHARE_LEFT) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, digest, the five counts, words_left, base_failed, kept and text.

    Lines are compared without case and outer or repeated white space, by a 64-bit hash. Per source, distinct documents that
    hold a line are counted. Documents are told apart by their text: copies count once, for otherwise any text with more
    copies than the limit would lose all its lines, and no copy would reach a stage that keeps one of them. Lines above both
    limits are boilerplate: text is what remains without them, and words_left its words; digest and the counts are of the
    whole text. kept: not base_failed and not depleted.

    Null or empty texts have no words and fail the base rules; a null source is a source of its own. Repeated rows get a
    row each. An empty table gives an empty result.
    """
    found = _ruled(docs, ("doc_id", "text", "source"), max_docs, max_share, min_words_left, min_share_left)
    return found.select(F.col("_own").alias("doc_id"), "digest", *_COUNTS, "words_left", "base_failed", "kept", "text")


def base_failed() -> Column:
    """Under 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def accept(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of `docs` that line_rules() keeps, with the named columns; text is without boilerplate lines, and n_chars counts it.

    Null and empty texts have no words and go. A null doc_id or source is a value like others. Texts of any length are read
    whole. Repeated rows are kept or go alike. An empty table gives none. Columns beside those named are left out.
    """
    good = _ruled(docs, columns, MAX_DOCS, MAX_SHARE, MIN_WORDS_LEFT, MIN_SHARE_LEFT).where("kept")
    return good.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])
