"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def _word_distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def line_dedup(rows, min_words=5, near_words=10):
    """doc -> (text left, lines with a word, judged, exact, near, only copies)."""
    places, lines = defaultdict(list), {}
    for doc, text in rows:
        lines[doc] = [(i, tuple(WORD.findall(x)), x) for i, x in enumerate(text.split("\n"))] if text is not None else []
        for i, words, _ in lines[doc]:
            if len(words) >= min_words:
                places[words].append((doc, i))
    first = {w: min(p) for w, p in places.items()}
    long = [w for w in first if len(w) >= near_words]
    near = {a for a in long if any(first[b] < first[a] and _word_distance_one(a, b) for b in long)}
    out = {}
    for doc, text in rows:
        judged = [(i, w) for i, w, _ in lines[doc] if len(w) >= min_words]
        exact = {i for i, w in judged if (doc, i) > first[w]}
        close = {i for i, w in judged if w in near} - exact
        left = "\n".join(x for i, _, x in lines[doc] if i not in exact | close) if exact | close else text
        out[doc] = (left, sum(1 for _, w, _ in lines[doc] if w), len(judged), len(exact), len(close), bool(judged) and len(exact | close) == len(judged))
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def jaccard_groups(rows, n=3, threshold=90):
    """doc -> (set size, smallest doc reachable)."""
    sets = {}
    for doc, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()
    up = {doc: doc for doc in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {doc: (len(sets[doc]), find(doc)) for doc in docs}


def contamination(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - window + 1)):
            if words:
                windows[tuple(words[i:i + window])].add(item)
    out = {}
    for doc, text in rows:
        words = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (key := tuple(words[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def repeated_bytes(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            piece = body[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out[doc] = (len(body), sum(gone), spans, sha(bytes(x for x, g in zip(body, gone) if not g)))
    return out


def cross_entropy(rows, target, smoothing=50.0):
    texts = [(doc, PLAIN.findall((text or "").translate(LOWER))) for doc, text in rows]
    known = {w for _, ws in texts for w in ws}
    pairs = {doc: list(zip(["<s>", *ws], ws)) for doc, ws in texts}
    every, chosen = Counter(), Counter()
    for doc, p in pairs.items():
        every.update(p)
        if doc in target:
            chosen.update(p)
    scale = max(sum(chosen.values()), 1) / max(sum(every.values()), 1)

    def model(c, s):
        single, before = Counter(), Counter()
        for (a, b), n in c.items():
            single[b] += n * s
            before[a] += n * s
        mass, width = sum(single.values()), len(known) + 2
        return lambda a, b: -math.log2((c[a, b] * s + smoothing * (single[b] + 1) / (mass + width)) / (before[a] + smoothing))

    own, general = model(chosen, 1), model(every, scale)
    return {doc: (len(p), sum(own(*x) for x in p) / len(p), sum(general(*x) for x in p) / len(p)) if p else (0, None, None) for doc, p in pairs.items()}
