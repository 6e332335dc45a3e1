"""Plain single-machine versions of what the corpus operators must give."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, members):
        self.parent = {m: m for m in members}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near(rows, percent=75):
    """doc_id -> (shingles, component) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    groups, holders = Sets(sets), {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen = set()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        groups.join(a, b)
    return {d: (len(s), groups.root(d)) for d, s in sets.items()}


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def linked_secrets(text, patterns, half):
    """All spans: the base ones, and the weak ones with company at most ``half`` code points away, by comparing all pairs."""
    base = secrets(text)
    spans = base + [(m.start(), rank, m.end()) for rank, pattern in patterns.items() for m in re.finditer(pattern, text or "")]
    out = list(base)
    for s, rank, e in spans[len(base) :]:
        near = {r for start, r, end in spans if start <= e + half and end >= s - half}
        has_id, has_secret, has_endpoint = bool(near & {1, 3}), bool(near & {0, 2, 4}), 5 in near
        if {3: has_secret, 4: has_id or has_endpoint, 5: has_id and has_secret}[rank]:
            out.append((s, rank, e))
    return sorted(out)


def repeats(rows, window=20):
    """doc_id -> (words, removed, digest of what is kept)."""
    seen, made = set(), {}
    for d, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            part = tuple(words[i : i + window])
            if part in seen:
                gone[i : i + window] = [True] * window
            else:
                seen.add(part)
        left = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        made[d] = (len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return made


def near_vectors(rows, cosine=0.93):
    """vec_id -> (links, component)."""
    groups, links = Sets([i for i, _, _ in rows]), {i: 0 for i, _, _ in rows}
    units = {}
    for i, v, label in rows:
        if v is None or label is None or not len(v) or any(x is None for x in v):
            continue
        v = np.array(v, dtype=float)
        if np.isfinite(v).all() and v.any():
            units.setdefault((label, len(v)), []).append((i, v / np.linalg.norm(v)))
    for members in units.values():
        ids, matrix = [i for i, _ in members], np.stack([u for _, u in members])
        for x, y in zip(*np.nonzero(np.triu(matrix @ matrix.T >= cosine, 1)), strict=True):
            links[ids[x]] += 1
            links[ids[y]] += 1
            groups.join(ids[x], ids[y])
    return {i: (links[i], groups.root(i)) for i in links}


def auc(truth, score):
    truth, score = np.asarray(truth), np.asarray(score)
    values, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    good, bad = int((truth == 1).sum()), int((truth == 0).sum())
    return (rank[truth == 1].sum() - good * (good + 1) / 2) / (good * bad)
