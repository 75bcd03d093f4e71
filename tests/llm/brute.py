"""Plain-Python versions of the text operators."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return {d: (max(g), len(g), d == max(g), sha(t.encode())) for t, g in groups.items() for d in g}


def byte_repeats(docs, w=50):
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if first.setdefault(b[i : i + w], d) != d:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def word_repeats(docs, w=20):
    seen, out = set(), {}
    for d, t in sorted(docs):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            if key in seen:
                gone[i : i + w] = [True] * w
            seen.add(key)
        kept = " ".join(x for x, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), sha(kept.encode()))
    return out


def _components(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: find(k) for k in sets}


def near(docs, words=2, percent=80):
    sets = {}
    for d, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        k = min(words, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = _components(sets, percent)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def lines(docs, percent=80, q=5):
    first = {}
    for d, t in sorted(docs):
        for p, line in enumerate((t or "").split("\n")):
            n = " ".join(line.lower().split())
            if n:
                first.setdefault(n, (d, p))
    sets = {at: {n[i : i + q] for i in range(max(1, len(n) - q + 1))} for n, at in first.items()}
    keep = set(_components(sets, percent).values())
    out = {}
    for d, t in docs:
        parts = (t or "").split("\n")
        blank = [not x.split() for x in parts]
        kept = "\n".join(x for p, x in enumerate(parts) if blank[p] or (d, p) in keep)
        n = len(parts) - sum(blank)
        out[d] = (n, n - sum((d, p) in keep for p in range(len(parts))), sha(kept.encode()))
    return out


def contained(text, items, share=0.1):
    """Items within their budget of some stretch of the text, by the whole alignment."""
    normal = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    t, out = normal(text), []
    for k, item in items:
        p = f" {normal(item)} "
        row = [0] * (len(t) + 3)
        for i, x in enumerate(p, 1):
            old, row = row, [i]
            for j, y in enumerate(f" {t} ", 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        if t and min(row) <= int(len(p) * share):
            out.append(k)
    return out


def quality(rows, least=10.0):
    """(prior, score) by document from (document, host, path, evidence)."""
    import math

    logit = lambda p: math.log(p / (1 - p))
    n, good = len(rows), sum(r[3] for r in rows)
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    middle = (good + 1) / (n + 2)

    def strength(groups, centre):
        sizes = {g: len(x) for g, x in groups.items()}
        every = sum(sizes.values())
        spread = sum(len(x) * (sum(x) / len(x) - centre(g)) ** 2 for g, x in groups.items()) / every
        noise = sum(centre(g) * (1 - centre(g)) for g in groups) / every
        mean = sum(sizes[g] * centre(g) * (1 - centre(g)) for g in groups) / every
        return max(least, mean / max(spread - noise, 1e-6) - 1)

    s = strength(hosts, lambda g: middle)
    prior_of = {h: (sum(x) + s * middle) / (len(x) + s) for h, x in hosts.items()}
    z = strength(paths, lambda g: prior_of[g[0]])
    out = {}
    for d, host, path, p in rows:
        centre = (good - p + 1) / (n + 1)
        at_host = (sum(hosts[host]) - p + s * centre) / (len(hosts[host]) - 1 + s)
        prior = (sum(paths[host, path]) - p + z * at_host) / (len(paths[host, path]) - 1 + z)
        out[d] = prior, 1 / (1 + math.exp(-(logit(p) + logit(prior) - logit(centre))))
    return out


def rates(posterior, tokens, weights, ridge=1e-4, most=4.0, settled=1e-5):
    """Accelerated projected gradient over plain arrays."""
    import numpy as np

    rate = before = np.ones(len(tokens))
    totals = lambda r: (tokens * r) @ posterior
    now = totals(rate)
    total, target = now.sum(), weights / weights.sum() * now.sum()
    w = weights / weights.sum()
    half = posterior * np.sqrt(tokens)[:, None] * np.sqrt(w) / target
    step = 1 / (2 * total * np.linalg.eigvalsh(half.T @ half)[-1] + 2 * ridge)
    pace = 1.0
    for _ in range(200):
        momentum = (pace - 1) / (pace := (1 + (1 + 4 * pace * pace) ** 0.5) / 2)
        ahead = rate + momentum * (rate - before)
        slope = 2 * total * posterior @ (w / target * (totals(ahead) / target - 1)) + 2 * ridge * (ahead - 1)
        before, rate = rate, np.clip(ahead - step * slope, 0, most)
        last, now = now, totals(rate)
        if abs(now - last).max() <= settled * total:
            break
    return rate
