"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    words = split(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeat.update(range(i, i + 8))
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if split(line):
            dups += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    n = len(words)
    base = n < 20 or 100 * len(repeat) > 30 * n
    n_lines = sum(bool(split(x)) for x in lines)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": len(repeat),
        "base_failed": base, "kept": not (base or 10 * symbols > n or 2 * dups > n_lines),
    }


def fingerprint(text, shingle=4):
    words = split((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(ids, linked):
    """{id: smallest id of its component}"""
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def classes(rows, radius=4, shingle=4):
    """rows: (doc_id, text). Returns {doc_id: (fingerprint, component)}."""
    fps = {d: fingerprint(t, shingle) for d, t in rows}
    of = joined(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius)
    return {d: (f"{fps[d]:016x}", of[d]) for d in fps}


def similar(rows, similarity=0.8, shingle=5):
    """{doc_id: smallest id of those that chains of Jaccard similarities of word shingles connect}"""
    sets = {}
    for d, t in rows:
        w = split((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    return joined(list(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


def leaks(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(ASCII_LOWER))
        for i in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[i : i + 8])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w = word.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                k = tuple(w[i : i + m])
                if k in windows:
                    hit.update(range(i, i + m))
                    found |= windows[k]
        found -= {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, len(found) >= 2)
    return out


def tokens(docs, path):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, {}
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def repeats(docs, k=400):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    texts = {d: (t or "").encode() for d, t in docs}
    counts = Counter(b[i : i + k] for b in texts.values() for i in range(len(b) - k + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if counts[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(docs, k=51):
    """{doc_id: words in runs of k words that another row has too}"""
    rows, holders = [(d, split(t)) for d, t in docs], defaultdict(set)
    for n, (_, w) in enumerate(rows):
        for i in range(len(w) - k + 1):
            holders[tuple(w[i : i + k])].add(n)
    return {d: len({j for i in range(len(w) - k + 1) if len(holders[tuple(w[i : i + k])]) > 1 for j in range(i, i + k)}) for d, w in rows}
