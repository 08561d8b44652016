"""The pipeline against a plain version of its stages, and its promises."""

from collections import Counter, defaultdict

import corpus_pipeline
from keyspan.llm import pii, quality
from keyspan.llm.queries import tokenizer_path

from . import brute

SMALL = "/root/testdata/sf0.001"


def plain_quality(rows):
    """(doc_id, text, source) kept by base rules and line frequency."""
    held, texts = defaultdict(set), defaultdict(set)
    normal = lambda line: b" ".join(line.encode().split()).lower()
    for _, text, source in rows:
        texts[source].add(text)
        for line in (text or "").split("\n"):
            if normal(line):
                held[source, normal(line)].add(text)
    common = {k for k, v in held.items() if len(v) > quality.MAX_DOCS and len(v) > quality.MAX_SHARE * len(texts[k[0]])}
    kept = []
    for row, (_, n, *_, failed) in zip(rows, brute.quality([r[:2] for r in rows]), strict=True):
        lost = sum(len(line.encode().split()) for line in (row[1] or "").split("\n") if (row[2], normal(line)) in common)
        if not failed and n - lost >= quality.MIN_WORDS_LEFT and n - lost >= quality.MIN_SHARE_LEFT * n:
            kept.append(row)
    return kept


def plain_groups(rows):
    sets = [(d, brute.shingles(t, 5)) for d, t, _ in rows]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for k in s:
            held[k].append(i)
    for i, (d, s) in enumerate(sets):
        for j, n in Counter(j for k in s for j in held[k] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((top(d), top(sets[j][0])))
                parent[b] = a
    return [r for r in rows if top(r[0]) == r[0]]


def test_equals_plain_stages(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in read("documents").collect()]
    rows = plain_groups(plain_quality(rows))
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    rows = [r for r, (*_, bad) in zip(rows, brute.contamination([r[:2] for r in rows], items), strict=True) if not bad]
    hidden = pii.pseudonymise(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), pii.DEMO_KEY).collect()
    want = sorted((d, n, ids) for d, n, ids, _ in brute.bpe([(r["doc_id"], r["text"]) for r in hidden], tokenizer_path()))
    import hashlib

    got = sorted((r["doc_id"], r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
