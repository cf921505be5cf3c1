"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs):
    """docs: [(doc_id, text)] -> {doc_id: (n_lines, n_dropped, kept_sha256)}."""
    keys = lambda t: [lower(x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in docs:
        for k in keys(t):
            if len(k) >= 40:
                holders[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True)
                if len(k) < 40 or len(holders[k]) < 5 or i == max(holders[k])]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def base_quality(text):
    w = words(text)
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    found = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if found[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered))


def near_groups(docs):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1:]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(docs, window=20):
    """docs: [(doc_id, text)] -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone.update(range(k, k + window))
            seen.add(x)
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def targets(sizes, weights=(5, 2, 1)):
    """sizes: {source: words} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: budget * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
            budget -= out[s]


def greedy_pieces(word, pieces, end):
    """Pieces of greedy longest match, 1 if the word cannot be spelled."""
    s, n = (*word, end), 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in pieces), 0)
        if not k:
            return 1
        s, n = s[k:], n + 1
    return n


def url_grams(text):
    """(context of up to 4 bytes, byte) at each place, zeros before the first."""
    data = b"\0" * 4 + text.encode()
    return [data[i - 4:i + 1] for i in range(4, len(data))]


def url_scores(taught, texts, strength=4.0):
    """Mean log-likelihood ratio of each text from exact counts of (verdict, order, context, byte)."""
    count = Counter()
    for text, verdict in taught:
        for g in url_grams(text):
            for k in range(5):
                count[verdict, k, g[4 - k:]] += 1
                count[verdict, k, g[4 - k:4], "all"] += 1
    out = {}
    for text in texts:
        logs = {}
        for verdict in ("allow", "block"):
            logs[verdict] = 0.0
            for g in url_grams(text):
                p = 1 / 256
                for k in range(5):
                    p = (count[verdict, k, g[4 - k:]] + strength * p) / (count[verdict, k, g[4 - k:4], "all"] + strength)
                logs[verdict] += math.log(p)
        out[text] = (logs["allow"] - logs["block"]) / max(len(text.encode()), 1)
    return out
