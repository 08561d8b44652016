"""The contract queries over the corpus tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html, jaccard, oracle, pii, quality, secrets, shards, substrings, urls
from .common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: <|endoftext|> of that tokenizer, and a number beyond its vocabulary of 49,408.
TOKEN_END, TOKEN_PAD = 49_407, 0xFFFF


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[secrets.count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.render(base), 256).alias("base_sha256"),
        secrets.render(F.col("spans")).alias("spans"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left", "text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.DEMO_KEY)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes their token ids as shards, and reads them back: one row for each sequence."""
    tokens = shared_path(spark, "tokens")
    bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), width=2).write.option("compression", "zstd").parquet(tokens)
    layout = shards.Layout(spark.read.parquet(tokens), "training order", 2, TOKEN_END, TOKEN_PAD)
    path = shared_path(spark, "shards")
    layout.write(path)
    if not layout.n:
        return layout.index().withColumn("record_sha256", F.lit(None).cast("string"))
    written = shards.read(spark, path, layout.length, layout.width).select("slot", F.sha2("record", 256).alias("record_sha256"))
    return layout.index().join(written, "slot")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filters, op2_decontamination, op3_secret_scans, op4_html_extraction, op5_bpe, op6_quality_rules, op7_jaccard_join, op8_pii, op9_token_shards, op10_substring_dedup)}

#: The others need regular expressions with positions, tokenizers, keyed permutations or the verdict of a method.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracle.OP1,
    "op2_decontamination": oracle.OP2,
    "op7_jaccard_join": oracle.OP7,
    "op10_substring_dedup": oracle.OP10,
}
