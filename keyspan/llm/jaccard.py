"""N-gram Jaccard join with signature trees.

Texts are sets of word shingles. Two sets that are alike enough differ in few shingles, so if all shingles are dealt to one
part more than that, by ranges of their hashes, some part is the same in both. A sketch of the corpus tells which parts occur once;
they are dropped, since nothing can share them. The parts that remain connect texts into candidate groups. A part holds several
shingles, so texts that share a few by chance, as ever more do in a larger corpus, stay apart. Inside each group a tree is built over the sets:
a node holds the OR of its members' token bitmaps and their range of sizes. Two trees are walked at once, and a pair of
nodes is left as soon as the greatest possible overlap of any two of their members is too small. Pairs that reach the
leaves are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, pick, slim_batches, written
from .components import components
from .hashing import BASES, Rolling, mix, word_codes
from .sketch import bitmaps, bits_for, has, parts_of

#: Words in a shingle and least Jaccard similarity in percent where no contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Bits of a slot's number in the sketch: about a slot for each one or two characters of text, within these bounds. One bitmap of it is broadcast: 256 MB at most.
LEAST_BITS, MOST_BITS = 16, 31
#: Shingles of a candidate group that one task holds; larger groups are compared block by block.
BLOCK = 1_000_000
#: Children of a tree node, and sets in a leaf.
FAN = 8
#: 64-bit words of bitmaps that a tree, and a comparison of pairs, hold at a time. Narrower bitmaps prune less but as rightly.
TREE_WORDS, PAIR_WORDS = 2_000_000, 500_000
#: Texts that a task handles at a time.
ROWS = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _set(text: str | None, n: int, roll: Rolling) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words the whole sequence is one."""
    code = word_codes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    return np.unique(roll(code, min(n, len(code)))) if len(code) else np.zeros(0, np.uint64)


def _band(size: int, percent: int) -> int:
    """Sets that link lie in the same band of sizes or neighbouring ones (bands are a little wider)."""
    return int(np.log(size) / -np.log((percent - 1) / 100))


@cache
def scheme(band: int, percent: int) -> tuple[int, int]:
    """How many parts the sets of a band and the one below are dealt to, and in how many of them at least two that link agree."""
    top = int(np.exp((band + 1) * -np.log((percent - 1) / 100))) + 1  # no set of the band is larger
    differ = 2 * top * (100 - percent) // (100 + percent)
    # Sets may agree in parts that are empty in both: some more parts than needed, so that few sets have as many empty ones.
    empty = (differ + 1) * np.exp(-top * percent / 100 / (differ + 1))
    spare = int(empty + 3 * np.sqrt(empty))
    return differ + 1 + spare, 1 + spare


def parts(own: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each of the two bands where a set, sorted, meets others: hashes of its parts, and how many of them it shares at least with
    any that it links with. Empty parts are among them only where they may be all that two sets share."""
    found = []
    for band in range(low := _band(len(own), percent), low + 2):
        n, agree = scheme(band, percent)
        place = ((own >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        place, sums = place[at], np.add.reduceat(own, at)
        if n - len(at) >= agree:
            every = np.zeros(n, np.uint64)
            every[place.astype(np.int64)] = sums
            place, sums = np.arange(n, dtype=np.uint64), every
        found.append((mix(sums ^ mix(place, band << 32)), max(1, agree - (n - len(at)))))
    return found


def _slots_of(n: int, percent: int, bits: int) -> Callable:
    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        roll = Rolling(BASES[0])
        for at in range(0, len(batch), ROWS):
            for text in batch.column(0).slice(at, ROWS).to_pylist():
                own = _set(text, n, roll)
                for hashes, _ in parts(own, percent) if len(own) else ():
                    yield _slots(hashes, bits)

    return slots


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * BASES[1]) >> np.uint64(64 - bits)).astype(np.int64)


def _sets(n: int, percent: int, bits: int, twice: Broadcast) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("shown", pa.list_(pa.int64()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(BASES[0])
        seen = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                sizes, digests, shown = [], [], []
                for text in batch.column(1).slice(at, ROWS).to_pylist():
                    own, few = _set(text, n, roll), [np.zeros(0, np.uint64)]
                    for hashes, agree in parts(own, percent) if len(own) else ():
                        hashes = hashes[has(seen, _slots(hashes, bits)) > 0]
                        if len(hashes) >= agree:
                            few.append(hashes)
                    sizes.append(len(own))
                    digests.append(_digest(own))
                    shown.append(np.concatenate(few).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ROWS), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(shown)], schema=schema)

    return run


def _spelled(n: int, bits: int, nodes: Broadcast) -> Callable:
    """For mapInArrow: digest and set of the texts (doc_id, text) whose doc_id is among the nodes, and of few others."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(BASES[0])
        among = np.frombuffer(nodes.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(has(among, _slots(mix(_ids(batch)), bits)) > 0))
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                sets = [_set(text, n, roll) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets])], schema=schema)

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _slots_of_ids(bits: int) -> Callable:
    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _slots(mix(_ids(batch)), bits)

    return slots


def _digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts), pa.int64()))


class SignatureTree:
    """Sets in order of size, their bitmaps, and the levels of nodes above them."""

    def __init__(self, sets: list[np.ndarray], words: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = np.zeros((len(sets), words), np.uint64)
        own = np.repeat(np.arange(len(sets)), self.sizes)
        place = (np.concatenate(sets) >> np.uint64(20)) % np.uint64(64 * words)
        np.bitwise_or.at(bits, (own, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        slack = self.sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        #: Level by level from the sets to one node: bitmaps, least and greatest size, greatest number of tokens that share a bit.
        self.levels = [(bits, self.sizes, self.sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            bits, least, most, slack = self.levels[-1]
            starts = np.arange(0, len(least), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, starts, 0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(slack, starts)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members of nodes i and j can overlap enough."""
    (bits_a, least_a, most_a, slack_a), (bits_b, least_b, most_b, slack_b) = a, b
    good = (100 * most_a[i] >= percent * least_b[j]) & (100 * most_b[j] >= percent * least_a[i])
    at = np.flatnonzero(good)
    step = max(64, PAIR_WORDS // bits_a.shape[1])
    for lo in range(0, len(at), step):
        k = at[lo : lo + step]
        overlap = np.bitwise_count(bits_a[i[k]] & bits_b[j[k]]).sum(1, dtype=np.int64) + np.minimum(slack_a[i[k]], slack_b[j[k]])
        good[k] = (100 + percent) * overlap >= percent * (least_a[i[k]] + least_b[j[k]])
    return good


def dual_walk(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of pairs of sets that no pair of nodes above them rules out. If a is b, each pair once."""
    same = a is b

    def walk(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        good = _possible(a.levels[la], b.levels[lb], i, j, percent)
        if same:
            good &= i < j if level == 0 else i <= j
        i, j = i[good], j[good]
        if level == 0:
            if len(i):
                yield i, j
            return
        below_a, below_b = (len(t.levels[min(level - 1, len(t.levels) - 1)][1]) for t in (a, b))
        for lo in range(0, len(i), 1024):  # depth first: a slice of pairs at each level is all that is held
            x, y = i[lo : lo + 1024], j[lo : lo + 1024]
            if la == level:
                x, y = (x[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(y, FAN)
                x, y = x[x < below_a], y[x < below_a]
            if lb == level:
                x, y = np.repeat(x, FAN), (y[:, None] * FAN + np.arange(FAN)).ravel()
                x, y = x[y < below_b], y[y < below_b]
            yield from walk(level - 1, x, y)

    yield from walk(max(len(a.levels), len(b.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def links(ids: list[np.ndarray], sets: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that connect what two blocks of sets, or one, have to connect: pairs known to be connected are skipped."""
    every = [len(s) for block in sets for s in block]
    words = max(4, 1 << max(0, int(4 * max(every) - 1).bit_length() - 6))
    words = max(4, min(words, 1 << (TREE_WORDS // max(map(len, sets))).bit_length() - 1))
    order = [np.argsort([len(s) for s in block], kind="stable") for block in sets]
    ids = [x[o] for x, o in zip(ids, order, strict=True)]
    sets = [[block[k] for k in o] for block, o in zip(sets, order, strict=True)]
    trees = [SignatureTree(block, words) for block in sets]
    a, b = trees[0], trees[-1]
    shift = 0 if a is b else len(ids[0])
    names = np.concatenate(ids)
    top = np.arange(len(names))  # of each set some set that it is connected to; equal for connected sets
    found = []
    for i, j in dual_walk(a, b, percent):
        for x, y in zip(*(z[top[i] != top[j + shift]] for z in (i, j)), strict=True):
            if top[x] == top[y + shift]:
                continue
            s, t = sets[0][x], sets[-1][y]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                found.append((int(names[x]), int(names[y + shift])))
                top[top == top[y + shift]] = top[x]
    return found


def _compared(percent: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [part for _, part in frame.groupby("block")] if frame["ci"].iloc[0] != frame["cj"].iloc[0] else [frame]
        if frame["ci"].iloc[0] != frame["cj"].iloc[0] and len(blocks) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids = [part["node"].to_numpy() for part in blocks]
        sets = [[np.asarray(t, np.int64).view(np.uint64) for t in part["tokens"]] for part in blocks]
        found = links(ids, sets, percent)
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    return run


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, sketch_bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles and component_id, the least doc_id reachable over links.

    Words are runs of other than ASCII white space with A-Z in lower case. Two documents link when their shingle sets have
    a Jaccard similarity of `percent` or more. Empty sets link with nothing.

    Null and empty texts have empty sets; a null doc_id is in no component (component_id is null). Rows may repeat, also
    with one doc_id: each gets a row, and all rows of a doc_id the least component of any. An empty table gives none.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim_batches(docs.sparkSession)
    if sketch_bits is None:
        chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        sketch_bits = bits_for(chars // 2, LEAST_BITS, MOST_BITS)
    twice = docs.sparkSession.sparkContext.broadcast(bitmaps(parts_of(docs.select("text"), _slots_of(shingle, percent, sketch_bits), 2), sketch_bits, (1,))[0])
    rows = written(docs.mapInArrow(_sets(shingle, percent, sketch_bits, twice), "doc_id long, n_shingles long, digest binary, shown array<long>"), "sets")

    # Equal sets first: the least doc_id of each stands for all, and only its shingles go on.
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    leaders = written(filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n_shingles"), F.first("shown").alias("shown")), "leaders")
    equal = filled.select("doc_id", "digest").join(leaders.where("node < last").select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # Sets and parts go by 64-bit hashes: sets that these confuse are compared in vain.
    own = F.xxhash64("digest")
    shown = leaders.select(own.alias("id"), F.explode("shown").alias("at")).repartition("at")  # dealt once, for the hubs and for those who meet them
    hubs = shown.groupBy("at").agg(F.min("id").alias("hub"), F.max("id").alias("end")).where("hub <> end").select("at", "hub")
    near = components(shown.join(hubs, "at").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    member = near.select(F.col("node").alias("id"), F.col("root").alias("group")).union(near.select("root", "root").distinct())

    # Groups are cut into blocks before their texts are read again, so that only sets to be compared are ever held or sent.
    wanted = leaders.select(own.alias("id"), "digest", "node", "n_shingles").join(member, "id")
    blocks = wanted.groupBy("group").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("n"))
    dealt = written(wanted.join(blocks, "group").select(F.col("node").alias("doc_id"), "digest", "group", F.pmod(own, F.col("n")).cast("int").alias("block"), "n"), "dealt")
    bits = bits_for(8 * dealt.count(), LEAST_BITS, MOST_BITS)
    nodes = docs.sparkSession.sparkContext.broadcast(bitmaps(parts_of(dealt.select("doc_id"), _slots_of_ids(bits), 1), bits, (0,))[0])
    held = docs.mapInArrow(_spelled(shingle, bits, nodes), "doc_id long, digest binary, tokens array<long>").join(dealt, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "node")
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = paired.select("group", "node", "block", "tokens", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"))
    verified = paired.groupBy("group", "ci", "cj").applyInPandas(_compared(percent), "a long, b long")

    roots = components(verified.union(equal)).withColumnRenamed("node", "doc_id")
    return rows.select("doc_id", "n_shingles").join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, columns: tuple[str, ...], shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with the named columns, that lead their component: one document of each group stays.

    Of equal rows with the leading doc_id one stays. Rows without a doc_id, and with empty sets, all stay.
    """
    followers = near_groups(docs, shingle, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = pick(docs, *columns).join(followers, F.col("doc_id") == F.col("_id"), "left_anti")
    return rows.where("doc_id is not null").dropDuplicates(list(columns)).unionByName(rows.where("doc_id is null"))
