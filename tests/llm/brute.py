"""The contracts in plain Python, over lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

ASCII_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def urls(pages, rules):
    out = []
    for page_id, url in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(AZ)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        out.append((page_id, host, path, best[1], best[2]))
    return out


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(AZ))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        found.discard(None)
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def secrets(docs):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = []
    for doc, text in docs:
        t = text or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        names = ("assign", "access", "hex")
        out.append((doc, len(a), len(b), len(c), sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(a + b + c)))))
    return out


def quality(docs):
    out = []
    for doc, text in docs:
        t = text or ""
        w = ASCII_SPACE.findall(t)
        seen, twice = set(), 0
        for line in t.split("\n"):
            if ASCII_SPACE.search(line):
                twice += line in seen
                seen.add(line)
        n = Counter(zip(w, w[1:], w[2:]))
        rep = {i + d for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for d in range(3)}
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return out


def bpe(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    out = []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def shingles(text, n=3):
    w = ASCII_SPACE.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(docs, percent=90):
    sets = [(d, shingles(t)) for d, t in docs]
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
        common = Counter(j for k in s for j in held[k] if j > i)
        for j, n in common.items():
            e, r = sets[j]
            if 100 * n >= percent * (len(s) + len(r) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return [(d, len(s), top(d)) for d, s in sets]


def substrings(docs, n=50):
    split = [(d, ASCII_SPACE.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
