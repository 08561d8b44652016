"""BPE encoding and decoding with tree concatenation.

White space is a hard border of this kind of tokenizer, so short texts are encoded word by word, and of each batch every
distinct word once. Long texts are cut into pieces anywhere, the pieces are encoded as rows of their own, on any executor, and
joined pair by pair, as in a binary tree: a window around the join is encoded anew and grows until what it replaces is,
token for token, what each side has there, from one white space to the other. A run of characters that nothing splits is
cut into leaves and joined in the same way; there the window is of tokens, and grows until its first token is a token of the
left side, at the same place, and its last one of the right side. By the locality of merges the joined tokens are then those
of the whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, pick, slices, slim_batches

#: Texts of more characters are encoded in pieces of this size, on several executors.
PIECE = 50_000
#: An unsplit run (a pre-token) of more characters than this is cut into leaves of this size.
LEAF = 1_024
#: Words that a task remembers before it begins anew. A worker outlives its tasks and goes on to other work, so they go with the task.
REMEMBER = 300_000

_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: How a file of the kind `word_bpe` normalises and splits. There, a word of these letters alone becomes itself in
#: lower case, and a run of these marks behind it, up to the word's end, is split off and encoded by itself.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [{"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}]
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_ANY_LETTER = "".join(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIMPLE = f"^[{_LETTERS}]+[!-/:-@\\[-`{{-~]*$"
_LOWER = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The byte alphabet: what stands for the bytes that are no printable character of Latin-1.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: The character of each byte; the space between words stays.
_ALPHABET = np.array([b if b == 32 else _BYTES.get(b, b) for b in range(256)], "<u4")

#: A tokenizer file with these parts is its model alone.
_BARE = {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}


def _dealt(found: list[bytes], at: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
    """Puts the ids of words, one after another, to their places."""
    raw, start = ids.tobytes(), 0
    for k, end in zip(at, (4 * ends).tolist(), strict=True):
        found[k] = raw[start:end]
        start = end


class Codec:
    """Encodes single words, and joins the tokens of parts of one long word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core, and threads have memory of their own
        with open(path, encoding="utf-8") as f:
            raw = json.load(f) | {"truncation": None, "padding": None}
        self._json = json.dumps(raw)
        self.whole = Tokenizer.from_str(self._json)
        self.suffix = raw["model"].get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.whole.get_vocab().items()}
        pre = (raw["pre_tokenizer"] or {}).get("pretokenizers") or []
        known = any(re.fullmatch(f"[{_LETTERS}]*[{re.escape(_MARKS)}]*", t["content"]) for t in raw["added_tokens"])
        #: Whether words of letters may go to the model directly, and their last tokens tell where they end.
        self.plain = self.suffix != "" and not known and (raw["normalizer"] or {}).get("normalizers") == _NORMALIZER and [x["pattern"] for x in pre[:1]] == _SPLIT and [x["type"] for x in pre[1:]] == ["ByteLevel"]
        self._added = re.compile("|".join(re.escape(t["content"]) for t in raw["added_tokens"]) or "(?!)")

    @cached_property
    def _end(self) -> Tokenizer:
        """The model alone, for the last part of a word. Made only where a run is cut, as each holds the vocabulary again."""
        return Tokenizer.from_str(json.dumps(json.loads(self._json) | _BARE))

    @cached_property
    def _spaced(self) -> Tokenizer:
        """The model alone, for many words with spaces between them."""
        return Tokenizer.from_str(json.dumps(json.loads(self._json) | _BARE | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))

    @cached_property
    def _ends(self) -> np.ndarray:
        """By id, whether the token ends a word."""
        return np.array([self.token.get(i, "").endswith(self.suffix) for i in range(max(self.token) + 1)])

    @cached_property
    def _inner(self) -> Tokenizer:
        """The same for parts that don't end their word."""
        raw = json.loads(self._json)
        return Tokenizer.from_str(json.dumps(raw | _BARE | {"model": raw["model"] | {"end_of_word_suffix": None}}))

    def encode(self, words: list[str], leaf: int = LEAF) -> list[bytes]:
        """Of each word, as a text of its own; words of over `leaf` characters by their leaves. Ids as bytes."""
        found: list[bytes] = [b""] * len(words)
        letters, rest = [], []
        plain, match = self.plain, _LOWER.fullmatch
        for k, w in enumerate(words):
            if len(w) > leaf:
                found[k] = np.asarray(self.one(w, leaf), "<u4").tobytes()
            elif plain and match(w):
                letters.append(k)
            else:
                rest.append(k)
        for lo in range(0, len(letters), 1_000):  # as one text, since a call and its result cost as much as a word
            some = letters[lo : lo + 1_000]
            text = " ".join([words[k] for k in some])
            text = text if text.isascii() else _ALPHABET[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.asarray(self._spaced.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some):
                _dealt(found, some, ids, ends)
            else:  # a vocabulary without some letter
                rest += some
        for lo in range(0, len(rest), 10_000):
            some = rest[lo : lo + 10_000]
            ids = [e.ids for e in self.whole.encode_batch_fast([words[k] for k in some], add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in ids])
            _dealt(found, some, np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1])), ends)
        return found

    def one(self, text: str, leaf: int) -> list[int]:
        """Of a text that may have long runs, all in this process."""
        parts = self.long_runs(text, leaf) if len(text) > leaf else None
        if not parts:
            return self.whole.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for part, bare in parts:
            if not bare:
                ids += self.whole.encode(part, add_special_tokens=False).ids
            else:
                at = range(0, len(part), leaf)
                ids += self.tree([self.bare(part[i : i + leaf], i == at[-1]) for i in at])
        return ids

    def long_runs(self, text: str, leaf: int) -> list[tuple[str, bool]] | None:
        """Pieces of `text` that encode independently; those flagged are pre-tokens too long for one step. None: no such run."""
        if len(text) <= leaf:
            return None
        found: list[tuple[str, bool]] = []
        at = 0
        for m in [*self._added.finditer(text), None]:
            part = self.whole.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            for token, _ in self.whole.pre_tokenizer.pre_tokenize_str(part):
                found.append((token, True))
            if m:
                found.append((m.group(0), False))
                at = m.end()
        return found if any(long and len(t) > leaf for t, long in found) else None

    def bare(self, token: str, last: bool) -> list[int]:
        """A part of a pre-token, already mapped to the byte alphabet; only the last part ends the word."""
        return (self._end if last else self._inner).encode(token, add_special_tokens=False).ids

    def width(self, i: int, last: bool) -> int:
        return len(self.token[i]) - (len(self.suffix) if last else 0)

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Tokens of the concatenation, from the tokens of two parts of one pre-token; last: the right part ends it."""
        n = 4
        while left and right:
            a, b = max(0, len(left) - n), min(len(right), n)
            ends = last and b == len(right)
            text = "".join(self.token[i] for i in left[a:]) + "".join(self.token[i] for i in right[:b])
            if ends and self.suffix:
                text = text.removesuffix(self.suffix)
            window = self.bare(text, ends)
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            n *= 2
        return left or right

    def tree(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Joins the leaves of one pre-token pair by pair."""
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.join(self.tree(parts[:half], False), self.tree(parts[half:], last), last)

    def join_texts(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Text and tokens of the concatenation, from those of two parts of a text, cut anywhere."""
        (a, ids_a), (b, ids_b) = left, right
        n = 64
        while True:
            start = next((m.start() for m in _SPACE.finditer(a, max(0, len(a) - n))), None)
            start = 0 if start is None and n >= len(a) else start
            ends = [m.start() for m in _SPACE.finditer(b, 0, n)]
            end = ends[-1] if ends else len(b) if n >= len(b) else None
            if start is not None and end is not None:
                old_a, old_b = self.one(a[start:], LEAF), self.one(b[:end], LEAF)
                keep = len(ids_a) - len(old_a)
                if keep >= 0 and ids_a[keep:] == old_a and ids_b[: len(old_b)] == old_b:
                    return a + b, ids_a[:keep] + self.one(a[start:] + b[:end], LEAF) + ids_b[len(old_b) :]
                if n >= max(len(a), len(b)):
                    return a + b, self.one(a + b, LEAF)
            n *= 2

    def tree_of_texts(self, parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.join_texts(self.tree_of_texts(parts[:half]), self.tree_of_texts(parts[half:]))

    @cached_property
    def spelled(self) -> pa.BinaryArray:
        """By id, a space and the token."""
        return pa.array([f" {self.token.get(i, '')}".encode() for i in range(max(self.token) + 1)], pa.binary())

    def decode(self, ids: Iterable[int]) -> str:
        """As the file asks for: it names no decoder, so tokens are joined by spaces, special ones too."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _strings(words: pa.StringArray) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


class Words:
    """The ids of words, as bytes; those met before are remembered."""

    def __init__(self, own: Codec, leaf: int) -> None:
        self._own, self._leaf, self._known = own, leaf, {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Of distinct words."""
        if len(self._known) > REMEMBER:
            self._known = {}
        found = list(map(self._known.get, words))
        at = [k for k, ids in enumerate(found) if ids is None]
        missing = [words[k] for k in at]
        coded = self._own.encode(missing, self._leaf)
        self._known.update(zip(missing, coded, strict=True))
        for k, ids in zip(at, coded, strict=True):
            found[k] = ids
        return found

    def __call__(self, words: pa.StringArray) -> pa.BinaryArray:
        """Of distinct words. One of letters is looked up in lower case, and without the marks behind it."""
        if not self._own.plain:
            return pa.array(self._ids(_strings(words)), pa.binary())
        plain = pc.match_substring_regex(words, _SIMPLE)
        base = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(words), characters=_MARKS), words)
        marks = pc.if_else(plain, pc.utf8_ltrim(words, characters=_ANY_LETTER), "")
        return pc.binary_join_element_wise(self._taken(base), self._taken(marks), pa.scalar(b"", pa.binary()))

    def _taken(self, words: pa.StringArray) -> pa.BinaryArray:
        each = words.dictionary_encode()
        return pa.array(self._ids(_strings(each.dictionary)), pa.binary()).take(each.indices)


def _coded(texts: pa.StringArray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text begins and the last ends. No text is split but at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten().dictionary_encode()
    taken = words(flat.dictionary).take(flat.indices)
    if not len(taken):
        return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    ids = np.frombuffer(taken.buffers()[2], "<u4") if taken.buffers()[2] else np.zeros(0, "<u4")
    return ids[ends[0] // 4 : ends[-1] // 4], (ends[starts] - ends[0]) // 4


def _cells(ids: np.ndarray, at: np.ndarray, width: int) -> pa.BinaryArray:
    """The ids of each text as binary, `width` bytes each."""
    raw = ids.astype(f"<u{width}")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(raw)])


def _told(ids: np.ndarray, at: np.ndarray, own: Codec) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    spelled = own.spelled.take(pa.array(ids))
    if len(spelled):
        ends = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset :][at]
        text = memoryview(spelled.buffers()[2])
    else:
        ends, text = at, memoryview(b"")
    decoded = [hashlib.sha256(text[a + (b > a) : b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [pa.array(np.diff(at), pa.int64()), pa.array(ids_sha), pa.array(decoded)]


def _with_ids(path: str, leaf: int, width: int) -> Callable:
    """For mapInArrow: replaces the column text by ids."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(codec(path), leaf)
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], _cells(*_coded(part.column("text"), words), width)], names=[*kept, "ids"])

    return run


def _with_digests(path: str, leaf: int) -> Callable:
    """For mapInArrow over doc_id and text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        words = Words(own, leaf)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_told(*_coded(part.column("text"), words), own)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def cut_text(text: str, piece: int, leaf: int, own: Codec) -> list[tuple[int, str, str]]:
    """(run, kind, part) in order: kind text is encoded as it is; inner and last are leaves of the pre-token `run`.

    Parts of kind text with one run were cut anywhere; parts of different runs encode independently.
    """
    found: list[tuple[int, str, str]] = []
    run = at = 0

    def plain(part: str) -> None:
        nonlocal run
        found.extend((run, "text", part[i : i + piece]) for i in range(0, len(part), piece))
        run += 1

    for word in re.finditer(r"[^\x20\x09-\x0D]{%d,}" % (leaf + 1), text):
        tokens = own.long_runs(word.group(0), leaf)
        if tokens:
            plain(text[at : word.start()])
            at = word.end()
            for token, bare in tokens:
                if not bare:
                    plain(token)
                else:
                    leaves = [token[i : i + leaf] for i in range(0, len(token), leaf)]
                    found += [(run, "inner", x) for x in leaves[:-1]] + [(run, "last", leaves[-1])]
                    run += 1
    plain(text[at:])
    return found


def _cut(path: str, piece: int, leaf: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            for row in frame.itertuples(index=False):
                parts = cut_text(row.text, piece, leaf, own)
                yield pd.DataFrame({"row": row.row, "at": range(len(parts)), "run": [p[0] for p in parts], "kind": [p[1] for p in parts], "text": [p[2] for p in parts]})

    return run


def _parts(path: str, leaf: int) -> Callable:
    """Encodes parts of texts; those of kind text keep their text, which the joins look at."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        words = Words(own, leaf)
        for frame in frames:
            for lo in range(0, len(frame), 50):
                some = frame.iloc[lo : lo + 50]
                plain = some["kind"] == "text"
                coded, at = _coded(pa.array(some["text"].where(plain), pa.string()), words)
                leaves = [None if p else np.asarray(own.bare(t, k == "last"), "<u4").tobytes() for p, t, k in zip(plain, some["text"], some["kind"], strict=True)]
                yield some.assign(ids=[coded[a:b].tobytes() if x is None else x for x, a, b in zip(leaves, at[:-1].tolist(), at[1:].tolist(), strict=True)], text=some["text"].where(plain))

    return run


def _joined(path: str, width: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = codec(path)
        frame = frame.sort_values("at")
        parts = []
        for _, group in frame.groupby("run", sort=True):
            coded = [np.frombuffer(x, "<u4").tolist() for x in group["ids"]]
            parts += own.tree_of_texts(list(zip(group["text"], coded, strict=True)))[1] if group["kind"].iloc[0] == "text" else own.tree(coded)
        return pd.DataFrame({"row": frame["row"].iloc[:1], "ids": [np.asarray(parts, f"<u{width}").tobytes()]})

    return run


def _long_ids(docs: DataFrame, path: str, piece: int, leaf: int, width: int = 4) -> DataFrame:
    """doc_id and ids (binary) of texts longer than a piece. Equal rows are encoded once."""
    same = docs.groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("n")).withColumn("row", F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256))
    pieces = same.select("row", "text").mapInPandas(_cut(path, piece, leaf), "row string, at int, run int, kind string, text string").repartition("row", "at")
    coded = pieces.mapInPandas(_parts(path, leaf), "row string, at int, run int, kind string, text string, ids binary")
    joined = coded.groupBy("row").applyInPandas(_joined(path, width), "row string, ids binary")
    owners = same.select(F.col("row").alias("_row"), "doc_id", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return owners.join(joined, F.col("row") == F.col("_row")).select("doc_id", "ids")


def encode(docs: DataFrame, path: str, piece: int = PIECE, leaf: int = LEAF, width: int = 4) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id and ids, the token ids as little-endian unsigned integers of `width` bytes.

    Equal to the library's encoding of the whole text with add_special_tokens=False. Null and empty texts have no ids;
    repeated rows each get a row; an empty table gives none. Long texts and words of any length are encoded whole. Columns
    beside doc_id and text are left out.
    """
    docs = _typed(docs)
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= piece).mapInArrow(_with_ids(path, leaf, width), "doc_id long, ids binary")
    return short.unionByName(_long_ids(docs.where(F.length("text") > piece), path, piece, leaf, width))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids, special tokens included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in frame["ids"]]})

    return pick(coded, "doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, piece: int = PIECE, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; the ids themselves stay in the tasks. Edge cases as in encode()."""
    docs = _typed(docs)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= piece).mapInArrow(_with_digests(path, leaf), schema)

    @lean
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                raw = part.column("ids").to_pylist()
                at = np.cumsum([0, *[len(x) // 4 for x in raw]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_told(np.frombuffer(b"".join(raw), "<u4"), at, own)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return short.unionByName(_long_ids(docs.where(F.length("text") > piece), path, piece, leaf).mapInArrow(told, schema))


def _typed(docs: DataFrame) -> DataFrame:
    slim_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
