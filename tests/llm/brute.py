"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def shingles(text, k=5):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(docs):
    sets = [shingles(t) for _, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    common = Counter((a, b) for own in index.values() for j, b in enumerate(own) for a in own[:j])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and docs[a][0] is not None and docs[b][0] is not None:
            x, y = top(docs[a][0]), top(docs[b][0])
            parent[max(x, y)] = min(x, y)
    return Counter((d, len(s), None if d is None else top(d), None if d is None else top(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def contamination(docs, items, window=13):
    found = defaultdict(set)
    for i, t in items:
        w = LETTERS.findall(low(t))
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if w else []:
            found[tuple(w[a : a + k])].add(i)
    sizes = {len(x) for x in found}
    out = Counter()
    for d, t in docs:
        w, hit, own = LETTERS.findall(low(t)), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in found:
                    hit.update(range(a, a + k))
                    own |= found[tuple(w[a : a + k])]
        out[(d, len(w), len(hit), len(own), sha(",".join(sorted(map(str, own)))), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


def without_repeats(docs, window=35):
    words = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def license_phrases(docs):
    phrases = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]
    out = Counter()
    for d, t in docs:
        w = LETTERS.findall(low(t))
        at = [(i, n) for n, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        out[(d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({n for _, n in at})))] += 1
    return out


def license_lines(text, lines, spread, share):
    """Largest ordered share of each label's lines: (labels, score) over all spans of bounded drift."""
    w = LETTERS.findall(low(text))
    best = {}
    for label, line in lines:
        t = line.split(" ")
        k = len(t) - 1
        hits = sorted((p, -q) for p in range(len(w) - 1) for q in range(k) if (w[p], w[p + 1]) == (t[q], t[q + 1]))
        for d in {p + q for p, q in hits}:
            near = [(p, -q) for p, q in hits if d <= p + q <= d + spread]
            longest = []
            for i, (p, q) in enumerate(near):
                longest.append(1 + max((longest[j] for j in range(i) if near[j][0] < p and near[j][1] < q), default=0))
            best[label] = max(best.get(label, 0), max(longest) / k)
    return {n: s for n, s in best.items() if s >= share}


def unigram_scores(docs):
    words = [SPACED.findall(low(t)) + ["\0end"] for _, t in docs]
    count = Counter(x for (d, _), w in zip(docs, words, strict=True) if d is not None and fold(d) != 1 for x in w)
    n, v = sum(count.values()), len(count)
    return [(d, fold(d) == 1, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for (d, _), w in zip(docs, words, strict=True)]
