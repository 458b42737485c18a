"""Brute-force counterparts of the operators, in plain Python over small lists."""

import hashlib
import re
from collections import Counter

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_numbers(text):
    words = white_words(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = [x for x in (text or "").split("\n") if white_words(x)]
    n, rep = len(words), len(covered)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        rep,
        n < 50 or 100 * rep > 50 * n,
    )


def benchmark_hits(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = {}
    for item, text in items:
        own = words(text)
        if item is None or not own:
            continue
        n = min(size, len(own))
        for i in range(len(own) - n + 1):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(own[i : i + n])]
        out.append((doc, len(own), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def kept_lines(docs, min_chars=20, min_docs=3):
    """Texts after line dedup."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        lost = lambda x: len(holders.get(key(x), ())) >= min_docs and doc != max(holders[key(x)])
        kept = lines if doc is None else [x for x in lines if not lost(x)]
        out.append("\n".join(kept))
    return out


def line_dedup(docs):
    sizes = lambda t: (t or "").count("\n") + 1
    return [
        (doc, sizes(text), lost_lines(text, new), sha(new)) for (doc, text), new in zip(docs, kept_lines(docs))
    ]


def lost_lines(old, new):
    """Lines fewer; a text whose lines all went has none left, not one empty line."""
    if not new and white_words(old):
        return (old or "").count("\n") + 1 - sum(not white_words(x) for x in (old or "").split("\n"))
    return (old or "").count("\n") - new.count("\n")


def fingerprint(text, size=4):
    words = white_words((text or "").translate(UPPER))
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42)
        for i in range(max(1, len(words) - size + 1))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, budget=4):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, (doc, _) in enumerate(docs):
        ids = [d for (d, _), g in zip(docs, group) if g == group[k] and d is not None]
        out.append((doc, f"{prints[k]:016x}", min(ids, default=None)))
    return out


def base_spans(text):
    text = text or ""
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
