"""Secret scans with multipart credential linking.

Strong patterns report on their own. Weak candidates (identifiers, short or unusual secrets, endpoints) report only where
complementary parts lie within the same scope: an interval join on (text, bucket of positions), in which each bucket is
first reduced to its least and greatest position of each part, so that no pairs of candidates are made.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, whether matches need 12 characters of value. A run of fewer characters than asked can hide no longer one, so the least length is part of the last two patterns.
STRONG = (("assign", ASSIGN, True), ("access", r"AKIA[A-Z0-9]{14,}", False), ("hex", r"[0-9a-f]{16,}", False))
WEAK = (
    ("ident", r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|\bA[KS]IA[A-Z0-9]{8,13}\b""", False),
    ("weak", r"""(?i)\b(?:pass|pwd|passphrase|credential|private_?key|client_?secret|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[^\s"',;]{4,}""", False),
    ("endpoint", r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|\b(?:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""", False),
)
KINDS = [k for k, *_ in STRONG + WEAK]
#: Code points within which parts count as belonging together.
SCOPE = 200
#: The part that each kind plays.
ROLE = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _spans(text: Column, kind: str, pattern: str, long_value: bool) -> Column:
    """Matches as (start, kind, end) in code points. `text` holds no \\x01: matches are put between two of them, and the
    lengths of the pieces between give the positions."""
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), _none().alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        good = acc["inside"] & (F.length(F.regexp_extract(piece, ASSIGN, 2)) >= 12) if long_value else acc["inside"]
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step)["found"]).otherwise(_none())


def render(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed, joined with commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, base and spans, arrays of (start, kind, end); end is exclusive.

    base holds the matches of the strong patterns. spans holds them and those weak candidates, overlapping none of them,
    with complementary parts that start within `scope` code points: a weak secret needs an identifier or endpoint, an
    identifier needs a secret, an endpoint needs both.

    Null and empty texts have no spans; repeated rows each get their own row with equal results; an empty table gives none.
    """
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit("\x02"))
    docs = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("_hash"), clean.alias("text"))
    strong = F.concat(*[_spans(F.col("text"), *x) for x in STRONG])
    weak = F.concat(*[_spans(F.col("text"), *x) for x in WEAK])
    apart = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = cut(docs.select("doc_id", "_hash", strong.alias("base"), weak.alias("weak")).select("doc_id", "_hash", "base", apart.alias("weak")))

    key = ["doc_id", "_hash"]
    parts = rows.where(F.size("weak") > 0).distinct().select(*key, F.explode(F.concat("base", "weak")).alias("span")).select(*key, "span", F.floor(F.col("span.start") / scope).cast("int").alias("bucket"))
    role = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    roles = ("secret", "ident", "endpoint")
    of = {r: F.when(F.get(role, F.col("span.kind")) == r, F.col("span.start")) for r in roles}
    ends = parts.groupBy(*key, "bucket").agg(*[f(of[r]).alias(f"{n}_{r}") for r in roles for n, f in (("least", F.min), ("most", F.max))])
    ends = ends.withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
    asked = parts.where(F.col("span.kind") >= len(STRONG)).withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
    met = asked.join(ends, (asked["bucket"] == ends["bucket"]) & asked["doc_id"].eqNullSafe(ends["_id"]) & (asked["_hash"] == ends["_h"]))
    near = lambda r: F.max(F.coalesce((F.abs(F.col(f"least_{r}") - F.col("span.start")) <= scope) | (F.abs(F.col(f"most_{r}") - F.col("span.start")) <= scope), F.lit(False)))
    seen = met.groupBy(*key, "span").agg(*[near(r).alias(r) for r in roles])
    kind = lambda k: F.col("span.kind") == KINDS.index(k)
    linked = seen.where((kind("weak") & (F.col("ident") | F.col("endpoint"))) | (kind("ident") & F.col("secret")) | (kind("endpoint") & F.col("secret") & F.col("ident")))
    linked = linked.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).agg(F.collect_list("span").alias("linked"))
    joined = rows.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("linked", _none())).alias("spans"))
