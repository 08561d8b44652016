"""HTML extraction with host suffix arrays.

Pages are cut into blocks of text. The suffixes of the token streams of a host's pages are grouped by their first tokens, by
a hash and over the whole table; long runs that recur on distinct texts are boilerplate. A sketch of all runs goes first: only
runs that it counts often enough are sent and grouped. A block that the page itself marks as its article keeps all its
words; one that it marks as menu, advert and so on keeps none; what it marks as neither keeps its unique runs.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, pick, slices, slim_batches
from .hashing import BASES, Rolling, mix, word_codes
from .sketch import bitmaps, bits_for, has, parts_of
from .urls import host_of

#: Tokens in a row that have to recur, and distinct texts of a host's pages in which they have to.
RUN, PAGES = 8, 3
#: Up to so many recurring runs are broadcast (8 bytes each); more meet their pages by shuffle.
BROADCAST_RUNS = 4_000_000
#: Bits of a slot's number in the sketch of runs: about a slot for each one or two characters of HTML, within these bounds. One bitmap of it is broadcast: 128 MB at most. A full sketch only lets more runs through.
LEAST_BITS, MOST_BITS = 16, 30
#: Tasks over which the occurrences of one run are spread where they meet its verdict.
SALTS = 16

ARTICLE, CHROME, OTHER = 0, 1, 2
#: Elements without text of their own page, elements that are not the article, words of class, id and role that say the same, and elements that end a block.
_RAW = "script|style|noscript|template|iframe|textarea|select|svg|math|object|canvas|title"
_DROPPED = frozenset("head nav header footer aside form button dialog menu".split())
_CONTAINERS = frozenset("article main section div ul ol dl table figure details blockquote fieldset".split()) | _DROPPED
_BLOCKS = _CONTAINERS | frozenset("p br hr li dt dd h1 h2 h3 h4 h5 h6 tr pre address figcaption caption body html summary center".split())
_VOID = frozenset("br hr img input meta link col area base embed source track wbr".split())
_CHROME_WORDS = re.compile(
    r"(?i)(?<![a-z])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|footer|sidebar|side-bar|cookies?|consent|gdpr|notices?|banner|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|toolbar|pagination|pager|skip-link|contentinfo|complementary|search|login|signup)(?![a-z])"
)
_COMMENT_WORDS = re.compile(r"(?i)(?<![a-z])(?:comments?|comment-list|respond|replies|disqus|discussion)(?![a-z])")
_MAIN_WORDS = re.compile(r"(?i)(?<![a-z])(?:main|article-body|post-content|entry-content|article-content)(?![a-z])")
#: No part of it reads on from each place of a broken page to the page's end: what may fail stops at the next "<".
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-z][^\s/<>]*)({_ATTRIBUTES})>""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _mark(tag: str, attributes: str) -> str:
    """What an element is: main, chrome, comments or nothing."""
    words = hidden = ""
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                words += f" {value}"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none", value):
                hidden = "chrome"
    if words and _COMMENT_WORDS.search(words):
        return "comments"
    if hidden or tag in _DROPPED or words and tag not in ("article", "main") and _CHROME_WORDS.search(words):
        return hidden or "chrome"
    return "main" if tag in ("article", "main") or words and _MAIN_WORDS.search(words) else ""


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order, white space joined, without empty ones."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, str]] = []
    open_tags, open_marks = Counter(), Counter()
    text: list[str] = []
    zone = OTHER

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                found.append((zone, " ".join(words)))
            text.clear()

    def close() -> str:
        tag, mark = stack.pop()
        open_tags[tag] -= 1
        open_marks[mark] -= 1
        return tag

    def around() -> int:
        return CHROME if open_marks["chrome"] or open_marks["comments"] else ARTICLE if open_marks["main"] else OTHER

    at = 0
    html = html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[4]
        if tag is None:
            if m[2]:
                text.append(m[2])
            continue
        tag = tag.lower()
        if tag not in _BLOCKS:
            if tag in ("td", "th"):
                text.append(" ")
            continue
        flush()
        if tag not in _CONTAINERS:
            if not m[3] and m[5] and zone != CHROME and _mark(tag, m[5]) in ("chrome", "comments"):
                zone = CHROME  # of this block only
            elif tag not in ("br", "hr"):
                zone = around()
            continue
        if m[3]:
            while open_tags[tag] and close() != tag:
                pass
        elif not m[5].endswith("/"):
            mark = _mark(tag, m[5])
            if tag == "header" and open_marks["main"] and not open_marks["chrome"] and not open_marks["comments"]:
                mark = ""  # the article's own heading
            if tag in ("article", "main") and mark == "main":  # an article ends what was left open before it
                while stack and stack[-1][1] == "chrome":
                    close()
            stack.append((tag, mark))
            open_tags[tag] += 1
            open_marks[mark] += 1
        zone = around()
    text.append(html[at:])
    flush()
    return found


def repeated_tokens(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream which tokens lie in a run of `run` tokens that recurs in `pages` streams (two or more), all in memory.

    The suffixes of all streams, put together with a mark of its own after each, are ranked by their first 1, 2, 4 ...
    tokens up to `run`: equal ranks are equal runs.
    """
    known: dict[str, int] = {}
    codes = [np.array([known.setdefault(t, len(known)) for t in s], np.int64) for s in streams]
    ends = len(known) + np.arange(len(streams))
    every = np.concatenate([x for c, e in zip(codes, ends, strict=True) for x in (c, [e])]) if streams else np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(streams)), [len(c) + 1 for c in codes])
    rank, width = every, 1
    while width < run:
        step = min(width, run - width)
        both = rank.copy()
        far = np.zeros(len(rank), np.int64)
        far[: len(rank) - step] = rank[step:] + 1
        both = both * (int(rank.max(initial=0)) + 2) + far
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.lexsort((page, rank))
    new_rank = np.r_[True, rank[order][1:] != rank[order][:-1]] if len(order) else np.zeros(0, bool)
    new_page = new_rank | np.r_[True, page[order][1:] != page[order][:-1]] if len(order) else new_rank
    group = np.cumsum(new_rank) - 1
    often = np.bincount(group, new_page) >= pages if len(order) else np.zeros(0, bool)
    hit = np.zeros(len(every), bool)
    hit[order] = often[group] if len(order) else False
    steps = np.zeros(len(every) + run + 1, np.int32)
    starts = np.flatnonzero(hit)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + run, -1)
    covered = np.cumsum(steps)[: len(every)] > 0
    cuts = np.cumsum([len(c) + 1 for c in codes])[:-1]
    return [x[:-1] for x in np.split(covered, cuts)] if streams else []


def main_text(found: list[tuple[int, str]], covered: np.ndarray) -> str:
    """Blocks of the article; on a page that marks none, the unique runs of what it doesn't mark as something else."""
    if any(zone == ARTICLE for zone, _ in found):
        return "\n".join(text for zone, text in found if zone == ARTICLE)
    kept, at = [], 0
    for zone, text in found:
        words = text.split(" ")
        if zone == OTHER:
            left = " ".join(w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c)
            if left:
                kept.append(left)
        at += len(words)
    return "\n".join(kept)


def _covered(hit: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens lie in a run that starts at a hit."""
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + run, -1)
    return np.cumsum(steps)[:n] > 0


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in `wanted`, which is sorted."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(wanted, keys)
    at[at == len(wanted)] = 0
    return wanted[at] == keys


class _Parser:
    """The blocks of pages, and hashes of the runs of their tokens, for many pages at once."""

    def __init__(self, run: int) -> None:
        self._run, self._roll = run, Rolling(BASES[0])

    def __call__(self, pages: list[dict]) -> list[tuple[list[tuple[int, str]], str, int, np.ndarray]]:
        """Of each page (host, html): blocks, all text, number of tokens, and a 64-bit hash of its host and the tokens of the run that begins at each place."""
        found = [blocks(r["html"]) for r in pages]
        texts = [" ".join([t for _, t in f]) for f in found]
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        starts, flat = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        code = word_codes(flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))[flat.indices.to_numpy()]
        runs, out = self._roll(code, self._run), []
        for k, (r, f) in enumerate(zip(pages, found, strict=True)):
            n = int(starts[k + 1] - starts[k]) if f else 0
            own = np.uint64(xxhash.xxh3_64_intdigest((r["host"] or "").encode("utf-8", "surrogatepass")))
            at = int(starts[k])
            out.append((f, texts[k], n, ((runs[at : at + max(0, n - self._run + 1)] ^ own) * BASES[1]).view(np.int64)))
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for part in slices(batch, "html", 500_000):
            yield part.to_pylist()


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _slots_of(run: int, bits: int) -> Callable:
    """All runs of a batch; those that one page repeats count again, which only lets more through."""

    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        parse = _Parser(run)
        for part in _groups([batch]):
            yield _slots(np.concatenate([keys for *_, keys in parse(part)]), bits)

    return slots


def _runs(run: int, often: Callable[[], bytes], bits: int) -> Callable:
    """A row for each page that has runs: page, text (a hash of its tokens) and its distinct runs, of those that the sketch counts often."""
    schema = pa.schema([("page", pa.binary()), ("text", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, parse = np.frombuffer(often(), np.uint8), _Parser(run)
        for part in _groups(batches):
            out = []
            for r, (_, text, _, keys) in zip(part, parse(part), strict=True):
                keys = np.unique(keys[has(bitmap, _slots(keys, bits)) == 1])
                if len(keys):
                    out.append((r["page"], int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True), keys))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], schema.field(k).type) for k in range(3)], schema=schema)

    return work


def _extract(run: int, wanted: Callable[[], np.ndarray] | None) -> Callable:
    """wanted: the recurring runs, sorted; None: the column _runs has a page's own."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_boilerplate", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, parse = wanted() if wanted else None, _Parser(run)
        for part in _groups(batches):
            out = []
            for r, (found, _, n, keys) in zip(part, parse(part), strict=True):
                own = every if wanted else np.sort(np.array(r["_runs"] or [], np.int64))
                covered = _covered(_among(keys, own), n, run)
                text = main_text(found, covered)
                out.append((r["page_id"], r["url"], text, len(text), int(covered.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], schema.field(k).type) for k in range(5)], schema=schema)

    return work


def _meeting(held: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of `held` (page, text, key) whose key is in `runs` (key), wherever one key has very many."""
    salted = runs.select(F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return held.join(salted, (F.col("key") == F.col("_key")) & (F.pmod(F.xxhash64("page"), F.lit(SALTS)) == F.col("_salt"))).select("page", "text", "key")


def _sent(runs: DataFrame) -> Callable[[], np.ndarray]:
    keys = np.sort(np.fromiter((r["key"] for r in runs.toLocalIterator()), np.int64))
    sent = runs.sparkSession.sparkContext.broadcast(keys)
    return lambda: sent.value


def extract(pages: DataFrame, run: int = RUN, min_pages: int = PAGES) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars and n_boilerplate, the tokens in recurring runs.

    A run recurs if at least `min_pages` distinct texts among all pages of its host hold it: copies of a page count once.
    Null and empty HTML gives empty text; a null url belongs to the empty host. Broken markup is read as far as it goes: open
    elements end with what holds them. Repeated rows each get a row. An empty table gives none. Runs and texts are compared
    by 64-bit hashes.
    """
    slim_batches(pages.sparkSession)
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    # What a page's runs depend on: its host and its HTML.
    page = F.unhex(F.md5(F.concat_ws("\x00", F.md5(F.coalesce("host", F.lit("")).cast("binary")), F.md5(F.coalesce("html", F.lit("")).cast("binary"))).cast("binary")))
    rows = rows.withColumn("page", page)
    seen = rows.select("page", "host", "html")
    chars = seen.agg(F.coalesce(F.sum(F.length("html")), F.lit(0))).first()[0]
    bits = bits_for(chars // 2, LEAST_BITS, MOST_BITS)
    # Copies of a text count here, but not below: here, runs may only be counted too often.
    often = seen.sparkSession.sparkContext.broadcast(bitmaps(parts_of(seen, _slots_of(run, bits), min_pages), bits, (min_pages - 1,))[0])
    held = seen.mapInArrow(_runs(run, lambda: often.value, bits), "page binary, text long, keys array<long>")
    told = held.select("text", F.explode("keys").alias("key")).distinct()
    common = cut(told.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("key"))
    schema = "page_id long, url string, text string, n_chars long, n_boilerplate long"
    if is_small(common, BROADCAST_RUNS):
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(run, _sent(common)), schema)
    own = _meeting(held.select("page", "text", F.explode("keys").alias("key")), common).groupBy(F.col("page").alias("_page")).agg(F.collect_set("key").alias("_runs"))
    return rows.join(own, F.col("page") == F.col("_page"), "left").select("page_id", "url", "html", "host", "_runs").mapInArrow(_extract(run, None), schema)
