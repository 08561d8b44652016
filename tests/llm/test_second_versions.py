"""Second versions, in plain Python, of what SQL can't express: whole tables, and long, broken and awkward rows."""

import datetime
import gc
import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyspan.llm import bpe, decontamination, html, jaccard, pii, quality, shards, sketch, substrings, urls
from keyspan.llm.common import DOCUMENT_COLUMNS
from keyspan.llm.queries import QUERIES, TOKEN_END, TOKEN_PAD, URL_RULES, tokenizer_path

from . import brute
from .test_pipeline import plain_quality

SMALL = "/root/testdata/sf0.001"


def read(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]


# --- HTML -------------------------------------------------------------------------------------------------------------


class Article(HTMLParser):
    """Blocks inside <article>, by the standard library's parser."""

    BREAKS = frozenset("article p br li ul ol div h1 h2 h3 table tr nav footer header aside form".split())
    NOT = frozenset("nav footer aside form script style".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.out = [], [], 0, 0

    def flush(self):
        words = "".join(self.text).split()
        if words:
            self.blocks.append(" ".join(words))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.flush()
        self.inside += tag == "article"
        self.out += tag in self.NOT or dict(attrs).get("class") == "ad"

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        self.inside -= tag == "article"
        if self.out and tag in self.NOT | {"div"}:
            self.out -= 1

    def handle_data(self, data):
        if self.inside and not self.out:
            self.text.append(data)


def test_html_whole_table(spark):
    pages = read(spark, "pages")
    want = []
    for page_id, url, page in pages:
        parser = Article()
        parser.feed(page or "")
        parser.close()
        parser.flush()
        text = "\n".join(parser.blocks)
        want.append((page_id, url, text, len(text)))
    got = QUERIES["op4_html_extraction"](spark, SMALL).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("broken", ["<a ", '<a "', "<script ", "<![CDATA[", "<!", "<!--", "<div>", "</ul><div>", '<a x="<a" ', "<p class='x>"])
def test_broken_pages_take_linear_time(broken):
    import time

    began = time.process_time()
    html.blocks(broken * 60_000)
    assert time.process_time() - began < 10  # quadratic work would take minutes


def test_html_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    made = [(1, "http://a.org/", f"<p>{long}", 1, 1, 1, 1), (1, "http://a.org/", f"<p>{long}", 1, 1, 1, 1), (None, None, None, 1, 1, 1, 1), (2, "x", "<article><p>a<p class='notice'>no<p>b</article>", 1, 1, 1, 1)]
    df = spark.createDataFrame(made, "page_id long, url string, html string, HTML int, host int, page int, text int")
    found = sorted(((r["page_id"] or 0, r["text"]) for r in html.extract(df).collect()))
    assert found == [(0, ""), (1, long), (1, long), (2, "a\nb")]


# --- personal data ----------------------------------------------------------------------------------------------------


def feistel(left, right, a, b, key, kind):
    for i in range(pii.ROUNDS):
        noise = lambda x: int(hashlib.sha256(f"{key}\0{kind}\0{i}\0{a}\0{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2:
            right = (right + noise(left)) % b
        else:
            left = (left + noise(right)) % a
    return left, right


def permuted(digits, key, kind):
    h = len(digits) // 2
    left, right = feistel(int(digits[:h]), int(digits[h:]), 10**h, 10 ** (len(digits) - h), key, kind)
    return f"{left:0{h}d}{right:0{len(digits) - h}d}"


def placed(shape, digits):
    left = iter(digits)
    return re.sub("[0-9]", lambda _: next(left), shape)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def swapped(x, key):
    """The image of a found value."""
    for name in pii.KINDS:
        pattern = pii._HOW[name][0]
        if not re.fullmatch(pattern, x, re.ASCII):
            continue
        digits = re.sub("[^0-9]", "", x)
        if name == "email":
            return f"u{hashlib.sha256(f'{key}{chr(0)}email{chr(0)}{x.lower()}'.encode()).hexdigest()[:16]}@example.invalid"
        if name == "iban":
            plain = x.replace(" ", "")
            if mod97(plain) != 1:
                return x
            own = re.sub("[^0-9]", "", plain[4:])
            body = placed(plain[4:], permuted(own, key, "iban")) if len(own) > 1 else plain[4:]
            new = iter(plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body)
            return "".join(c if c == " " else next(new) for c in x)
        if name == "phone":
            code = (re.match(r"\+[0-9]{1,3}(?=[^0-9])", x) or [""])[0]
            rest = x[len(code) :]
            return code + placed(rest, permuted(re.sub("[^0-9]", "", rest), key, "phone"))
        if name == "ip":
            n = [int(p) for p in x.split(".")]
            if max(n) > 255:
                return x
            return ".".join(str(p) for s in feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip") for p in divmod(s, 256))
        if name == "date":
            form = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}[re.search("[-/.]", x)[0]]
            try:
                day = (datetime.datetime.strptime(x, form).date() - datetime.date.fromisoformat(pii.FIRST_DAY)).days
            except ValueError:
                return x
            if not 0 <= day < pii.DAYS_A * pii.DAYS_B:
                return x
            a, b = feistel(*divmod(day, pii.DAYS_B), pii.DAYS_A, pii.DAYS_B, key, "date")
            return (datetime.date.fromisoformat(pii.FIRST_DAY) + datetime.timedelta(a * pii.DAYS_B + b)).strftime(form)
        if name == "ssn":
            area, group, serial = map(int, x.split("-"))
            if not (0 < area < 900 and area != 666 and group and serial):
                return x
            a, b = feistel(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
            return f"{a + 2 if a >= 665 else a + 1:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
        if luhn(digits):
            return x
        own = permuted(digits[:-1], key, "card")
        return placed(x, own + str((10 - luhn(own + "0")) % 10))
    raise AssertionError(x)


def test_pii_whole_table(spark):
    def plain(text):
        n = 0

        def one(m):
            nonlocal n
            image = swapped(m[0], pii.DEMO_KEY)
            n += image != m[0]
            return image

        return (None, 0) if text is None else (re.sub(pii.ANY, one, text, flags=re.ASCII), n)

    rows = [r[:2] for r in read(spark, "documents")]
    want = sorted((d, *plain(t)) for d, t in rows)
    got = sorted((r["doc_id"], r["text"], r["n_found"]) for r in QUERIES["op8_pii"](spark, SMALL).collect())
    assert got == want and sum(n for _, _, n in want) > 20
    more = ["card 4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 378282246310005", "x.y@mail.example.com A_B@c.de +1 (051) 555-0588 (212) 555-1234 212.555.1234 10.0.0.1 300.1.1.1 1.2.3.4.5", "2021-02-28 02/28/2021 28.02.2021 2021-02-29 123-45-6789 000-12-1234 666-10-1000 899-99-9999", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB83WEST12345698765432", "1899-12-31 2099-12-31 1900-01-01 2100-01-01", "x" * 100 + "9" * 40]
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"], r["n_found"]) for r in pii.pseudonymise(df, pii.DEMO_KEY).collect()) == [(i, *plain(t)) for i, t in enumerate(more)]


# --- shards -----------------------------------------------------------------------------------------------------------


def test_shards_whole_table(spark):
    """Streams put together anew from the index, document by document, give the bytes of every record."""
    own = bpe.codec(tokenizer_path()).whole
    ids = {d: np.asarray(own.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() + np.uint16(TOKEN_END).tobytes() for d, t in (r[:2] for r in read(spark, "documents"))}
    found = sorted((r["sequence"], r["slot"], r["n_tokens"], r["doc_ids"], r["record_sha256"], r["shard"], r["offset"]) for r in QUERIES["op9_token_shards"](spark, SMALL).collect())
    n = len(found)
    assert [f[0] for f in found] == list(range(n)) == sorted(f[1] for f in found)
    left, seen = b"", []
    for sequence, slot, n_tokens, doc_ids, sha, shard, offset in found:
        new = doc_ids[1:] if left else doc_ids
        seen += new
        left += b"".join(ids[d] for d in new)
        record, left = left[: 2 * n_tokens], left[2 * n_tokens :]
        assert len(record) == 2 * n_tokens and (n_tokens == shards.LENGTH or not left)
        assert hashlib.sha256(record + np.uint16(TOKEN_PAD).tobytes() * (shards.LENGTH - n_tokens)).hexdigest() == sha
        assert (shard, offset) == (slot // shards.PER_SHARD, slot % shards.PER_SHARD * (2 * shards.LENGTH + 1))
    assert not left and sorted(seen) == sorted(ids)


def test_shards_refuse_rows_in_another_order(spark, tmp_path):
    rows = [(i, bytes([i]) * 2) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1).write.parquet(str(tmp_path / "a"))
    layout = shards.Layout(spark.read.parquet(str(tmp_path / "a")), "k", 2, 65_000, 65_001, length=4, per_shard=5)
    order = F.col("doc_id") * 7 % 40
    layout.tokens = spark.read.parquet(str(tmp_path / "a")).coalesce(1).sortWithinPartitions(order).select("doc_id", "ids", F.shiftrightunsigned(F.xxhash64("doc_id", F.octet_length("ids"), F.monotonically_increasing_id()), 32).alias("check"))
    with pytest.raises(Exception, match="order changed"):
        layout.index().collect()


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_verdicts_whole_table(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"] for r in QUERIES["op6_quality_rules"](spark, SMALL).where("kept").collect()}
    assert got == {d for d, _, _ in plain_quality(rows)} and 0 < len(got) < len(rows)


# --- long texts and awkward rows everywhere ---------------------------------------------------------------------------


def test_very_long_texts(spark):
    words = [f"w{i * i % 99_991}" for i in range(150_000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[70_000:])), (3, "x" * 500_000), (4, "a " * 200_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    items = [(1, " ".join(words[100_000:100_040])), (2, "a a a")]
    found = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    made = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"), decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("c"))
    assert sorted(map(tuple, made.collect())) == sorted(brute.contamination(texts, items))
    assert sorted(tuple(r)[:4] for r in substrings.drop_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(brute.substrings(texts))
    assert sorted(map(tuple, quality.line_rules(df.withColumn("source", F.lit("s"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())) == sorted(brute.quality(texts))
    assert sorted(tuple(r) for r in bpe.digests(df, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(brute.bpe(texts, tokenizer_path()))
    pages = [(1, "http://a.com/fr/" + "p" * 300_000), (2, "http://" + "sub." * 50_000 + "example.org/es/x"), (3, "z" * 300_000)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(brute.urls(pages, URL_RULES))


def test_one_id_with_two_texts_keeps_all_links(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(100)) for p in "ab")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (7, " ".join(f"c{i}" for i in range(60)))]
    found = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 7)]


def test_stages_take_awkward_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9, 0, "x"), (1, text, "en", "s", 9, 0, "x"), (None, text + " end", "en", None, None, 1, "y"), (2, None, None, None, None, 2, "z"), (3, "", "en", "s", 0, 3, "z"), (4, "y" * 200_000 + " " + text[::-1], "en", "s", 5, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT int, _gone string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == list(DOCUMENT_COLUMNS)
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 4]


def test_common_windows_are_told_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_HOT", 0)
    monkeypatch.setattr(substrings, "HOT_SHARE", 0.0)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(30))} {shared} tail {i}") for i in range(12)] + [(40, shared), (41, "short")]
    found = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r)[:4] for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(brute.substrings(rows))


def test_sketch_parts_add_up(spark):
    from collections import Counter

    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 1 << 18, 200).tolist() + [7] * (i % 5),) for i in range(60)]
    df = spark.createDataFrame(rows, "slots array<long>").repartition(5)
    want = Counter(x for (r,) in rows for x in r)
    slots_of = lambda batch: (np.asarray(x, np.int64) for x in batch.column(0).to_pylist())
    maps = sketch.bitmaps(sketch.parts_of(df, slots_of, 10), 18, (1, 3))
    for above, bits in zip((1, 3), maps, strict=True):
        assert set(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))) == {k for k, n in want.items() if n > above}


def test_a_worker_keeps_nothing_of_a_task(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "and some more"]})
    work = bpe._with_ids(tokenizer_path(), bpe.LEAF, 4)
    with monkeypatch.context() as m:
        m.setattr(pa, "default_memory_pool", lambda: pool)
        assert [len(b) for b in work(iter([batch]))] == [2]
    gc.collect()
    assert released == [1]
    assert not [x for x in gc.get_objects() if type(x) is bpe.Words]


def test_marks_behind_letters_are_split_off_and_encoded_once(monkeypatch):
    own, real = bpe.Codec(tokenizer_path()), bpe.codec(tokenizer_path()).whole
    letters = ["abc", "ÉcOLE", "straße", "don", "a"]
    marks = ["!!", "'", "''", "'s", "'S", ".)", "...", "_", "<|", "|>", "\\]", "^", "!é", "!1", "-b", ""]
    words = [a + b for a in letters for b in marks] + ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|>!", "é!", "ﬁ!", "𝒳?", "é̸", "≠"]
    told = bpe.Words(own, bpe.LEAF)(pa.array(words)).to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in told] == [real.encode(w, add_special_tokens=False).ids for w in words]

    many = pa.array([f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{m}" for i in range(2_000) for m in ("!", "?!", ");")])
    sent = []

    class Whole:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **how)

    monkeypatch.setattr(own, "whole", Whole())
    told = bpe.Words(own, bpe.LEAF)(many).to_pylist()
    assert len(sent) <= 4  # the marks; 6,000 words before
    assert [np.frombuffer(x, "<u4").tolist() for x in told] == [e.ids for e in real.encode_batch_fast(many.to_pylist(), add_special_tokens=False)]
