"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from boxwright.llm import passages as passages_operator

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    return [w for w in SPACE.split((text or "").translate(LOWER) if lower else (text or "")) if w]


def quality_base(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def shingles(text, k=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def near_duplicates(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links), {i: len(s) for i, s in sets.items()}


def exact_substrings(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha of what is kept)"""
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in docs}):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items):
    cut = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = lambda t: [w for w in cut.split((t or "").translate(LOWER)) if w]
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def boilerplate(docs, least):
    sites = defaultdict(set)
    for _, t, s in docs:
        for line in (t or "").split("\n"):
            if words(line) and s is not None:
                sites[line].add(s)
    return {x for x, s in sites.items() if len(s) >= least}


def sure_run(least: int, percent: int, k: int) -> int:
    """Every passage has so many shared tokens in a row: an edit costs 2k - 1 tokens of the two sides at least, so g edits ask for
    g (2k - 1) percent / (100 - percent) shared tokens, and these make g + 1 rows at most."""
    shared = -(-2 * percent * least // (100 + percent))
    edits = range(least) if percent < 100 else range(1)
    return min(-(-max(shared, -(-g * (2 * k - 1) * percent // max(1, 100 - percent))) // (g + 1)) for g in edits)


def whole_runs(u: np.ndarray, v: np.ndarray, least: int, percent: int, run: int) -> list[tuple[int, int, int, int]]:
    """Passages of two whole documents: along every alignment that has `run` shared tokens in a row."""
    by = np.argsort(v, kind="stable")
    w = v[by]
    first = np.searchsorted(w, u, "left")
    n = np.searchsorted(w, u, "right") - first
    p = np.repeat(np.arange(len(u)), n)
    q = by[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    order = np.lexsort((p, q - p))
    p, shift = p[order], (q - p)[order]
    edge = np.flatnonzero(np.r_[True, (shift[1:] != shift[:-1]) | (p[1:] != p[:-1] + 1), True]) if len(p) else np.zeros(1, int)
    seen = np.unique(shift[edge[:-1]][np.diff(edge) >= run])
    groups = np.split(seen, np.flatnonzero(np.diff(seen) > 16) + 1) if len(seen) else []
    return sorted({x for s in groups for x in passages_operator.shared_runs(u, v, least, percent, (int(s[0]), int(s[-1])))})


def passage_links(docs, least=46, percent=80):
    """Pairs of documents with a passage in common, of those that share as many tokens in a row as such a pair must."""
    run = sure_run(least, percent, 5)
    tokens, by_run = {}, defaultdict(set)
    for i, t in docs:
        if i is not None and t is not None:
            for _, u, _ in passages_operator._tokens(pa.array([t]), 5):
                tokens[i] = (u >> np.uint64(32)).astype(np.uint32)
                for j in range(len(u) - run + 1):
                    by_run[tokens[i][j : j + run].tobytes()].add(i)
    pairs = {(a, b) for s in by_run.values() for a in s for b in s if a < b}
    return {p for p in pairs if whole_runs(tokens[p[0]], tokens[p[1]], least, percent, run)}
