"""What the operators should give, by plain Python over whole tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw(text):
    return (text or "").encode()


def passages(rows, length=50):
    """{(id, text): (n_words, n_removed, kept)} by windows of words."""
    first = {}
    for i, text in rows:
        words = raw(text).split()
        if i is not None:
            for s in range(len(words) - length + 1):
                key = tuple(words[s : s + length])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in rows:
        words = raw(text).split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if i is not None and first[tuple(words[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i, text] = (len(words), sum(gone), kept)
    return out


def repeats(rows, length=200):
    """{(id, text): (n_bytes, n_removed, n_spans, sha256)} by strings of bytes."""
    count = Counter()
    for _, text in rows:
        b = raw(text)
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = {}
    for i, text in rows:
        b = raw(text)
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, size=5):
    words = raw(text).translate(LOWER).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near(rows, percent=75):
    """{id: (n_shingles, component_id)}; ids are unique and not null."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def base_scores(rows, learned):
    """{id: (n_tokens, n_known, base_score)} and the number of learned tokens."""
    tokens = {i: [*raw(t).translate(LOWER).split(), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if learned(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return {
        i: (len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }, n


def held_items(rows, items, words):
    """Ids of documents that hold all words of an item, one after another."""
    starts = defaultdict(list)
    for item, text in items:
        own = words(text)
        starts[own[0]].append((item, own))
    found = set()
    for i, text in rows:
        own = words(text)
        for k, w in enumerate(own):
            for item, want in starts.get(w, ()):
                if own[k : k + len(want)] == want:
                    found.add((i, item))
    return found
