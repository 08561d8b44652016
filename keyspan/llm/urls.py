"""URL filters: rules on hosts and path prefixes, applied by hashed expressions.

Each URL is expanded into (host suffix, path prefix) expressions. They meet the rules in an equi-join on the first 32 bits
of a digest; the full digest confirms the match and the longest rule wins. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, let, lower_ascii, pick

#: A rule table of up to this many rows is broadcast (each row has a digest, a string and a verdict).
BROADCAST_RULES = 100_000
#: Copies of each rule when the rule table is shuffled, so that an expression shared by many URLs meets it in many tasks.
SALTS = 32
#: URLs that more than this share of all rows have, and more than LEAST_HOT rows, are told by broadcast: at most as many as the inverse of the share.
HOT_SHARE, LEAST_HOT = 1e-5, 1_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A separator that no host can hold keeps ("a", "b/") and ("ab", "/") apart.
    return F.sha2(F.concat_ws("/", host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of `urls` (column url) with host, path, rule and verdict.

    `rules` has host, path and verdict. A rule fits its host and all subdomains where the URL's path starts with the rule's
    path (any prefix, not only whole segments). The longest rule string wins; of equally long ones the longest host, then
    block before allow. A URL without a fitting rule gets rule null and the verdict `default`.

    Null and malformed URLs have an empty host and path and get the default. Rows may repeat: each distinct URL is judged
    once, and its rows find the verdict by the URL itself.
    Null parts of a rule count as empty; repeated rules count once. Empty tables give empty or all-default results. All
    columns of `urls` come back in front; those named host, path, rule or verdict are replaced.
    """
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in urls.columns if c.lower() not in made]
    rows = pick(urls, *kept)
    at_url = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    slim = rows.select("url").distinct().withColumns(at_url)

    r_host, r_path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    known = (
        pick(rules, "host", "path", "verdict")
        .select(_digest(r_host, r_path).alias("_digest"), F.concat(r_host, r_path).alias("_rule"), F.length(r_host).alias("_hosts"), F.length(r_path).alias("_paths"), F.size(F.split(r_host, r"\.")).alias("_labels"), "verdict")
        .distinct()
    )
    # Only lengths that some rule has can match: at most as many numbers as the longest rule has characters.
    shape = known.agg(F.array_sort(F.collect_set("_paths")).alias("paths"), F.coalesce(F.max("_labels"), F.lit(0)).alias("labels")).first()
    lengths = F.array(*[F.lit(int(n)) for n in shape["paths"]]) if shape["paths"] else F.array().cast("array<int>")

    labels = F.split(F.col("host"), r"\.")
    suffixes = let(labels, lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(max(1, shape["labels"])))), lambda n: F.array_join(F.slice(p, -n, n), ".")))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    pairs = let(prefixes, lambda ps: F.flatten(F.transform(suffixes, lambda s: F.transform(ps, lambda p: _digest(s, p)))))
    asked = slim.select("url", F.explode(pairs).alias("_asked")).withColumn("_key", _short(F.col("_asked")))

    known = known.select("_digest", "_rule", "_hosts", F.col("verdict").alias("_verdict"), _short(F.col("_digest")).alias("_key"))
    on = ["_key"]
    if is_small(known, BROADCAST_RULES):
        known = F.broadcast(known)
    else:
        asked = asked.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append("_salt")
    best = F.max(F.struct(F.length("_rule").alias("n"), F.col("_hosts").alias("h"), (F.col("_verdict") == "block").alias("b"), "_rule", "_verdict")).alias("_best")
    judged = asked.join(known, on).where(F.col("_asked") == F.col("_digest")).groupBy(F.col("url").alias("_url")).agg(best)

    # Rows of the commonest URLs get their verdict where they are, and don't meet in the shuffle.
    per_url = rows.groupBy(F.col("url").alias("_key")).agg(F.count("*").alias("n"))
    hot = cut(per_url.where(F.col("n") > max(LEAST_HOT, int(rows.count() * HOT_SHARE))).join(judged, F.col("_key").eqNullSafe(F.col("_url")), "left").select("_key", F.col("_best").alias("_hot_best"), F.lit(True).alias("_hot")))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]).cast("string")
    marked = rows.join(F.broadcast(hot), F.col("url").eqNullSafe(F.col("_key")), "left").withColumn("_at", F.when(F.col("_hot"), spread).otherwise(F.col("url")))
    found = marked.join(judged, F.col("_at").eqNullSafe(F.col("_url")), "left").withColumn("_best", F.when(F.col("_hot"), F.col("_hot_best")).otherwise(F.col("_best")))
    return found.withColumns(at_url).select(*kept, "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
