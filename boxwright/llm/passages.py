"""Operator 9: near-duplicate passages by compact windows.

A token is the hash of five consecutive words. Under a hash function, the Cartesian tree of a document's token hashes gives
its compact windows: a triple l <= c <= r says that every run of tokens that starts in l..c and ends in c..r has its least
hash at c. Only windows of at least the passage length matter, about 2n / t of them per function.
1. Functions come in pairs (`BANDS`). Within a document, the windows of a pair's two functions are joined as intervals: where
   they overlap by the passage length, all runs there share both minima, and the two tokens together are a cell's key.
   Windows whose token is the centre of no other window of the first function are left out before (a bitmap of fixed size);
   of cells of one key, those within another are left out (a token over and over makes many).
   At similarity s a passage shares a given key with probability s^2, so one of four with .98 at .8, and always if equal.
2. Cells with equal keys form a group. Each is tied to the group's first and last cell (so links grow as the cells do). Ties
   of two documents that lie on one alignment make a stretch, whose tokens are compared: the runs in it that begin and end
   with shared tokens and have the length and the similarity asked for are near-duplicate passages, those that overlap joined.
3. First and last may be unlike the rest. Cells of a group whose documents are not in one class yet are compared pair by pair. A
   passage in common has many tokens in common, so cells without as many tokens around that are around such cells of other
   documents, too, are done with, and cells of a group's largest class without as many of those of its others (bitmaps
   again). Groups of up to `SMALL` cells give their pairs at once. In larger ones, cells are compared by those tokens, in pairs of
   blocks of about `BLOCK` cells; no token becomes a row.
So every document with a passage in common with another is reported, and linked documents are in one class. Pairs of documents
that are in one class by others' links are not all listed, so the words counted are those of the passages that are.

Defined cases: null, empty and short texts have no passages; rows that share a doc_id are one document; a null doc_id is
compared with nothing and keeps a null class; equal texts are compared once, by their smallest doc_id, and inherit its
passages besides being passages of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.bytekit import SPACES, STEP, filter_place, mix, pieces, shingle_hashes, text_bytes, whole_groups, word_hashes, words
from boxwright.llm.common import arrow_rows, bitmap_of, connected_components, cut, dedupe_columns, discard, repeated_bitmap

SHINGLE = 5
MIN_WORDS = 50
BANDS = 4
DRIFT = 64  # tokens by which an alignment may leave the shifts of its ties
FILTER_BITS = 27  # 16 MB
SMALL = 16
BLOCK = 512
COLUMNS = 2048  # tokens whose places in two blocks are held at once
ARROW_ROWS = 1000  # whole texts or their tokens
HELD = 1 << 20  # hashes that a task gathers before it tells their distinct ones
CELL = "h bigint, doc_id bigint, c int, lo int, hi int"
RUN = "x bigint, y bigint, xs bigint, xe bigint, ys bigint, ye bigint"
STRETCH = ["x", "y", "xs", "xe", "ys", "ye", "near", "far"]


def _trees(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, points: np.ndarray | None = None):
    """(l, c, r) of the Cartesian trees of the ranges lo..hi, level by level; with `points` (ascending), only of ranges that hold one."""
    while True:
        wide = hi - lo >= least
        if points is not None:
            wide &= np.searchsorted(points, lo) < np.searchsorted(points, hi)
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return
        # ranges are disjoint and ascend: minima between their edges, every second one is a range
        edges = np.stack([lo, hi], axis=1).ravel()
        low = np.minimum.reduceat(h, edges[:-1] if edges[-1] == len(h) else edges)[::2]
        size = hi - lo
        start = np.cumsum(size) - size
        at = np.repeat(lo - start, size) + np.arange(size.sum())
        hit = at[h[at] == np.repeat(low, size)]
        # the middle one of equals: a token over and over makes no deep tree
        c = hit[(np.searchsorted(hit, lo) + np.searchsorted(hit, hi) - 1) // 2]
        yield lo, c, hi - 1
        lo, hi = np.stack([lo, c + 1], axis=1).ravel(), np.stack([c, hi], axis=1).ravel()


def compact_windows(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the windows of at least `least` tokens; rows are h[first[i]:first[i + 1]]."""
    out = list(_trees(h, first[:-1], first[1:], least))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined_windows(windows, h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Interval join of some windows (l, c, r) with those of a second function h that overlap them by `least` tokens and hold
    the same runs: the window's index, the other's centre, and both ends of what they have in common."""
    l, c, r = windows
    of = np.argsort(c)
    found = []
    for a, k, b in _trees(h, first[:-1], first[1:], least, c[of]):
        at = np.searchsorted(a, c[of], side="right") - 1
        inside = (at >= 0) & (c[of] <= b[np.maximum(at, 0)])
        of, at = of[inside], at[inside]
        s, e = np.maximum(l[of], a[at]), np.minimum(r[of], b[at])
        ok = (l[of] <= k[at]) & (k[at] <= r[of]) & (e - s + 1 >= least)
        found.append((of[ok], k[at][ok], s[ok], e[ok]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def outermost(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Indices of those s..e that lie in no other of equal key (one of equals); tokens over and over make such."""
    by = np.lexsort((-e, s, key))
    group = np.cumsum(np.r_[True, key[by][1:] != key[by][:-1]]) if len(by) else by
    reach = np.maximum.accumulate(e[by] + group * (int(e.max()) + 2)) if len(by) else by
    return by[np.r_[True, (reach[1:] > reach[:-1])]] if len(by) else by


def _tokens(column: pa.Array, k: int):
    """Per piece of the batch: first row, token hashes with rows closed up, and the rows' edges in them."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        off = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = words(part, off, SPACES)
        s = shingle_hashes(word_hashes(part, starts, ends), k)
        n = np.maximum(np.diff(first) - k + 1, 0)
        edge = np.r_[0, np.cumsum(n)]
        at = np.repeat(first[:-1] - edge[:-1], n) + np.arange(edge[-1])
        yield a, s[at], edge


def _hashed(tokens: np.ndarray, f: int) -> np.ndarray:
    return mix((tokens ^ STEP[20 + f]) * STEP[40 + f])


def _distinct(arrays: Iterator[np.ndarray], several: bool = False) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of arrays, about HELD at a time, and whether they repeat there (`several`: said of all)."""
    held, n = [], 0

    def told() -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((times > 1) | several)], names=["h", "many"])

    for x in arrays:
        held.append(x)
        n += len(x)
        if n >= HELD:
            yield told()
            held, n = [], 0
    if held:
        yield told()


def _centres(k: int, least: int, bands: int):
    """Distinct centres of windows of the first functions, and whether they repeat among those told together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, tokens, edge in _tokens(batch.column(1), k):
                for f in range(bands):
                    h = _hashed(tokens, f)
                    yield mix(h[compact_windows(h, edge, least)[1]])

    return lambda batches: _distinct(of(batches))


def _cells(k: int, least: int, bands: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, tokens, edge in _tokens(batch.column(1), k):
                got: list[list] = [[], [], [], [], []]
                for f in range(bands):
                    h = _hashed(tokens, f)
                    l, c, r = compact_windows(h, edge, least)
                    at = filter_place(mix(h[c]), bits)
                    through = np.flatnonzero((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    l, c, r = l[through], c[through], r[through]
                    other = _hashed(tokens, bands + f)
                    of, c2, s, e = joined_windows((l, c, r), other, edge, least)
                    row = np.searchsorted(edge, s, side="right") - 1
                    key = mix(h[c[of]] * STEP[0] + other[c2] * STEP[1] + STEP[2 + f])
                    outer = outermost(key, s, e)
                    key, of, s, e, row = key[outer], of[outer], s[outer], e[outer], row[outer]
                    for column, value in zip(got, (key.view(np.int64), keys[a + row], c[of] - edge[row], s - edge[row], e - edge[row]), strict=True):
                        column.append(value)
                h, d, *places = (np.concatenate(x) for x in got)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), *(pa.array(x.astype(np.int32)) for x in places)], names=["h", "doc_id", "c", "lo", "hi"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a pair's ties by shift: stretches, those of nearly equal shifts (edits between) that overlap made one."""
    names = ("shift", "xs", "xe", "ys", "ye")
    for batch in batches:
        x, y, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        edges = ties.offsets.to_numpy()
        flat = ties.values.slice(edges[0], edges[-1] - edges[0])
        v = np.stack([flat.field(n).to_numpy() for n in names], axis=1).astype(np.int64)
        row = np.repeat(np.arange(len(x)), np.diff(edges))
        order = np.lexsort((v[:, 1], v[:, 0], row))
        v, row = v[order], row[order]
        if len(v):
            group = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (v[1:, 0] - v[:-1, 0] > 16)])
            order = np.lexsort((v[:, 1], group))
            v, row, group = v[order], row[order], group[order]
            base = group * (int(v[:, 2].max()) + 2)
            reach = np.maximum.accumulate(v[:, 2] + base)
            new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ((v[:, 1] + base)[1:] > reach[:-1])])
            low, high, row = np.minimum.reduceat(v, new, axis=0), np.maximum.reduceat(v, new, axis=0), row[new]
            # how far a place in y's part of the stretch lies behind the same place in x's
            part = low[:, 1] - low[:, 3]
            out = (x[row], y[row], low[:, 1], high[:, 2], low[:, 3], high[:, 4], part - high[:, 0], part - low[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=STRETCH)


def _sequences(k: int, ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(ids.value, np.uint8)
        for batch in batches:
            at = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(8 * len(seen) - 1)
            through = np.flatnonzero((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(through):
                continue
            some = batch.take(pa.array(through))
            rows = []
            for _, tokens, edge in _tokens(some.column(1), k):
                t = (tokens >> np.uint64(32)).astype(np.uint32)
                rows += [t[edge[i] : edge[i + 1]].tobytes() for i in range(len(edge) - 1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.binary())], names=["doc_id", "tokens"])

    return run


def _chain(q: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly ascending chain."""
    if len(q) < 2 or (q[1:] > q[:-1]).all():
        return np.arange(len(q))
    tails, at, before = [], [], np.full(len(q), -1)
    for i, x in enumerate(q.tolist()):
        k = bisect_left(tails, x)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [x], [i]
    out, i = [], at[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def shared_runs(u: np.ndarray, v: np.ndarray, least: int, percent: int, shifts: tuple[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """Passages of u and v: what the runs cover that are long and similar enough, runs that overlap joined.

    A run begins and ends with shared tokens. Of tokens i to j of the alignment (places p and q) it is similar enough if
    (100 + percent) (j - i + 1) >= percent (p_j - p_i + q_j - q_i + 2), so with a_i = (100 + percent) i - percent (p_i + q_i)
    the longest run from i ends at the last j with a_j >= a_i - (100 - percent). `shifts` bounds q - p, give or take DRIFT."""
    by = np.argsort(v, kind="stable")
    w = v[by]
    first, last = np.searchsorted(w, u, "left"), np.searchsorted(w, u, "right")
    p = np.flatnonzero(last > first)
    if not len(p):
        return []
    f, z = first[p], last[p] - 1
    once = f == z
    middle = sum(shifts) // 2 if shifts else int(np.median((by[f] - p)[once] if once.any() else by[f] - p))
    # of equal tokens, the one nearest the alignment
    block = np.searchsorted(w, w, "left") * (len(v) + 1)
    k = np.searchsorted(block + by, block[f] + np.clip(p + middle, 0, len(v)))
    low, high = by[np.clip(k - 1, f, z)], by[np.clip(k, f, z)]
    q = np.where(np.abs(low - p - middle) <= np.abs(high - p - middle), low, high)
    if shifts:
        inside = (q - p >= shifts[0] - DRIFT) & (q - p <= shifts[1] + DRIFT)
        p, q = p[inside], q[inside]
    straight = _chain(q)
    plain = once.all() and len(straight) == len(q)
    p, q = p[straight], q[straight]
    if not len(p):
        return []
    a = (100 + percent) * np.arange(len(p)) - percent * (p + q)
    ahead = np.maximum.accumulate(a[::-1])[::-1]
    end = np.searchsorted(-ahead, 100 - percent - a, "right") - 1
    start = np.flatnonzero((p[end] - p >= least - 1) & (q[end] - q >= least - 1))
    end = end[start]
    if not plain:
        # with repeated or moved tokens, a stretch closed over short gaps may also do by the sets of its tokens
        for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > max(6, least // 5)) + 1):
            i, j = int(part[0]), int(part[-1])
            if p[j] - p[i] >= least - 1 and q[j] - q[i] >= least - 1:
                x, y = np.unique(u[p[i] : p[j] + 1]), np.unique(v[q[i] : q[j] + 1])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    start, end = np.r_[start, i], np.r_[end, j]
        by = np.argsort(start, kind="stable")
        start, end = start[by], end[by]
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    i, j = start[new], reach[np.r_[new[1:], len(reach)] - 1]
    return list(zip(p[i].tolist(), (p[j] + 1).tolist(), q[i].tolist(), (q[j] + 1).tolist(), strict=True))

def _verify(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: list[list] = [[], [], [], [], [], []]
            for x, y, xs, _, ys, _, near, far, u, v in zip(*(c[n] for n in (*STRETCH, "left", "right")), strict=True):
                u, v = np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32)
                # one token over and over aligns in many ways: ties far apart are followed at both ends, too
                ways = {(near, far)} | ({(near, near), (far, far)} if far - near > DRIFT // 4 else set())
                for a, b, d, e in {x for w in ways for x in shared_runs(u, v, least, percent, w)}:
                    for column, value in zip(out, (x, y, xs + a, xs + b, ys + d, ys + e), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["x", "y", "xs", "xe", "ys", "ye"])

    return run


def _regions(batch: pa.RecordBatch, least: int) -> Iterator[tuple]:
    """For each row: its index, its tokens, and from where to where the surroundings of its cells go."""
    cells = batch.column("cells")
    edges = cells.offsets.to_numpy()
    c, lo, hi = (cells.values.field(n).to_numpy().astype(np.int64) for n in ("c", "lo", "hi"))
    start, end = np.maximum(lo, c - least + 1), np.minimum(hi, c + least - 1) + 1
    for i, body in enumerate(batch.column("tokens").to_pylist()):
        of = slice(edges[i], edges[i + 1])
        u = np.frombuffer(body, np.uint32).astype(np.uint64)
        yield i, u, np.minimum(start[of], len(u)), np.minimum(end[of], len(u))


def _shared_tokens(least: int):
    """Distinct tokens around cells, and whether several of the documents told together have them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, u, start, end in _regions(batch, least):
                inside = np.cumsum(np.bincount(start, minlength=len(u) + 1) - np.bincount(end, minlength=len(u) + 1))[: len(u)] > 0
                yield mix(np.unique(u[inside]))

    return lambda batches: _distinct(of(batches))


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = filter_place(mix(h), bits)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _promising(least: int, common: int, bits: int, shared):
    """(row, cell, distinct tokens, their times) of the cells around which `common` tokens are in other documents, too, around other
    cells; for a cell of its group's largest component: in the group's cells of others (`others`, a bitmap of group and token)."""

    def of(batch: pa.RecordBatch, others: np.ndarray | None) -> Iterator[tuple]:
        seen = np.frombuffer(shared.value, np.uint8)
        cells = batch.column("cells")
        edges, minor, group = cells.offsets.to_numpy(), cells.values.field("minor").to_numpy(zero_copy_only=False), cells.values.field("h").to_numpy().view(np.uint64)
        for i, u, start, end in _regions(batch, least):
            hit = _in_bitmap(seen, u, bits)
            total = np.r_[0, np.cumsum(hit)]
            for j in np.flatnonzero(total[end] - total[start] >= common).tolist():
                cell = edges[i] + j
                t = u[start[j] : end[j]][hit[start[j] : end[j]]]
                if not minor[cell]:
                    if others is None:
                        continue
                    t = t[_in_bitmap(others, t * STEP[0] + group[cell], bits)]
                    if len(t) < common:
                        continue
                yield (i, cell, *np.unique(t, return_counts=True))

    return of


def _of_minor(promising):
    """Group and token of the cells outside their group's largest component."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            group = batch.column("cells").values.field("h").to_numpy().view(np.uint64)
            for _, cell, t, _ in promising(batch, None):
                yield mix(t * STEP[0] + group[cell])

    return lambda batches: _distinct(of(batches), True)


def _promising_rows(promising, others):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = list(promising(batch, np.frombuffer(others.value, np.uint8)))
            if not kept:
                continue
            row, cell, lists, times = zip(*kept, strict=True)
            edge = np.r_[0, np.cumsum([len(t) for t in lists])].astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.concatenate(times).astype(np.int32))], ["t", "times"])
            values, of = batch.column("cells").values.take(pa.array(cell)), pa.array(row)
            columns = [values.field("h"), batch.column("doc_id").take(of), *(values.field(n) for n in ("c", "lo", "hi")), batch.column("comp").take(of)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(edge), held)], names=["h", "doc_id", "c", "lo", "hi", "comp", "tokens"])

    return run


def _places_shared(cell: np.ndarray, token: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """[i, j]: of the places of cell i, how many hold a token that cell j has, too."""
    found, t, k = np.unique(token, return_inverse=True, return_counts=True)
    # tokens of one cell alone are shared with none
    t = (np.cumsum(k > 1) - 1)[t][(several := k[t] > 1)]
    cell, times = cell[several], times[several]
    by = np.argsort(t, kind="stable")
    cell, t, times = cell[by], t[by], times[by]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(t[-1]) + 1 if len(t) else 0, COLUMNS):
        of = slice(*np.searchsorted(t, [start, start + COLUMNS]))
        places = np.zeros((n, COLUMNS), np.float32)
        places[cell[of], t[of] - start] = times[of]
        out += places @ (places > 0).astype(np.float32).T
    return out


def _alike(common: int):
    """Open pairs of cells of one pair of blocks that have `common` places with tokens in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            keys = table.column("key").to_numpy()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(s, e - s).combine_chunks()
                d, comp, block = (part.column(n).to_numpy() for n in ("doc_id", "comp", "block"))
                lists = part.column("tokens").combine_chunks()
                cell, flat = np.repeat(np.arange(e - s), np.diff(lists.offsets.to_numpy())), lists.flatten()
                shared = _places_shared(cell, flat.field("t").to_numpy(), flat.field("times").to_numpy(), e - s) >= common
                ok = shared & shared.T & (d[:, None] < d[None, :]) & (comp[:, None] != comp[None, :])
                # both of one block: only where that block meets itself
                ok &= (block[:, None] != block[None, :]) | part.column("alone").to_numpy(zero_copy_only=False)[:, None]
                i, j = np.nonzero(ok)
                for at in range(0, len(i), 100_000):
                    cells = [part.select(["doc_id", "c", "lo", "hi"]).take(pa.array(k[at : at + 100_000])) for k in (i, j)]
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() for half in cells for c in half.columns], names=["x", "xc", "xl", "xh", "y", "yc", "yl", "yh"])

    return run


def _pair(a: str, b: str) -> list:
    """Columns of a tie between the cells a and b, the smaller document first."""
    swap = F.col(f"{b}.doc_id") < F.col(f"{a}.doc_id")
    one = lambda p, q, field, n: F.when(swap, F.col(f"{q}.{field}")).otherwise(F.col(f"{p}.{field}")).alias(n)
    return [one(p, q, field, side + n) for side, p, q in (("x", a, b), ("y", b, a)) for field, n in (("doc_id", ""), ("c", "c"), ("lo", "l"), ("hi", "h"))]


def _ties_to_stretches(ties: DataFrame, name: str) -> DataFrame:
    """Stretches of ties x, xc, xl, xh, y, yc, yl, yh; ends are exclusive."""
    dealt = ties.repartition("x", "y")
    by_shift = dealt.groupBy("x", "y", (F.col("xc") - F.col("yc")).alias("shift")).agg(F.min("xl").alias("xs"), (F.max("xh") + 1).alias("xe"), F.min("yl").alias("ys"), (F.max("yh") + 1).alias("ye"))
    # bounded by the two documents
    pairs = by_shift.groupBy("x", "y").agg(F.collect_list(F.struct("shift", "xs", "xe", "ys", "ye")).alias("ties"))
    return cut(pairs.mapInArrow(_stretches, RUN + ", near bigint, far bigint"), name)


def _compared(read: DataFrame, pairs: DataFrame, k: int, least: int, percent: int, name: str) -> DataFrame:
    """The passages found in stretches of pairs."""
    shared = read.sparkSession.sparkContext.broadcast(bitmap_of(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), FILTER_BITS))
    # one row of each doc_id that the bitmap lets through; both joins use this one exchange
    one = read.mapInArrow(_sequences(k, shared), "doc_id bigint, tokens binary").dropDuplicates(["doc_id"])
    # only the stretch of each document travels on
    part = lambda side, s, e: F.expr(f"substring({side}, cast({s} * 4 + 1 as int), cast(({e} - {s}) * 4 as int))")
    first = pairs.join(one.select(F.col("doc_id").alias("x"), F.col("tokens").alias("left")), "x").withColumn("left", part("left", "xs", "xe"))
    second = first.join(one.select(F.col("doc_id").alias("y"), F.col("tokens").alias("right")), "y").withColumn("right", part("right", "ys", "ye"))
    out = cut(second.select(*pairs.columns, "left", "right").mapInArrow(_verify(least, percent), RUN).distinct(), name)
    shared.destroy()
    return out


def _merged_spans(found: DataFrame) -> DataFrame:
    """(d, spans): per document what its passages cover, ascending."""
    spans = found.select(F.explode(F.array(F.struct(F.col("x").alias("d"), F.col("xs").alias("s"), F.col("xe").alias("e")), F.struct(F.col("y").alias("d"), F.col("ys").alias("s"), F.col("ye").alias("e")))).alias("p")).select("p.*")
    # the longest of each start first: at most as many as the document has tokens
    longest = spans.groupBy("d", "s").agg(F.max("e").alias("e"))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "e"))),
        F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (x["s"] <= F.element_at(a, -1)["e"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x))),
    )
    return longest.groupBy("d").agg(joined.alias("spans"))


def _open_ties(read: DataFrame, cells: DataFrame, label: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """Ties between cells of a group whose documents are not linked yet, but for those with the group's first and last, which were compared."""
    state = cells.join(label, F.col("doc_id") == F.col("node"), "left").select("h", "doc_id", "c", "lo", "hi", "end", F.coalesce("component", "doc_id").alias("comp"))
    group = Window.partitionBy("h")
    mixed = state.withColumn("one", F.min("comp").over(group)).withColumn("other", F.max("comp").over(group)).where("one <> other and not end")
    held = cut(mixed.select("h", "doc_id", "c", "lo", "hi", "comp"), "held")
    most = held.groupBy("h", "comp").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"))
    members = cut(held.join(most, "h").withColumn("minor", F.col("comp") != F.col("most")).drop("most"), "open-cells")
    # a passage in common shows in common tokens: cells without enough of them around are done with
    common = -(-2 * percent * least // (100 + percent))
    mine = members.groupBy("doc_id").agg(F.min("comp").alias("comp"), F.collect_list(F.struct("h", "c", "lo", "hi", "minor")).alias("cells"))  # bounded by the document
    shared = read.sparkSession.sparkContext.broadcast(bitmap_of(mine.select("doc_id")))
    tokens = read.mapInArrow(_sequences(k, shared), "doc_id bigint, tokens binary")
    around = cut(tokens.join(mine, "doc_id").dropDuplicates(["doc_id"]), "around")
    bitmap = read.sparkSession.sparkContext.broadcast(repeated_bitmap(around.mapInArrow(_shared_tokens(least), "h bigint, many boolean"), FILTER_BITS))
    promising = _promising(least, common, FILTER_BITS, bitmap)
    others = read.sparkSession.sparkContext.broadcast(repeated_bitmap(around.mapInArrow(_of_minor(promising), "h bigint, many boolean"), FILTER_BITS))
    near = cut(around.mapInArrow(_promising_rows(promising, others), f"{CELL}, comp bigint, tokens array<struct<t: bigint, times: int>>"), "promising")
    sizes = cut(near.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    item = F.struct("doc_id", "c", "lo", "hi", "comp")
    needed = lambda a, b: (a["doc_id"] < b["doc_id"]) & (a["comp"] != b["comp"])
    each = lambda array: F.explode(F.flatten(F.transform(array, lambda a: F.transform(F.filter(array, lambda b: needed(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    small = near.drop("tokens").join(sizes.where(F.col("n") <= SMALL), "h").groupBy("h").agg(F.collect_list(item).alias("m"))
    ties = small.select(each(F.col("m")).alias("t")).select("t.a", "t.b").select(*_pair("a", "b"))
    # larger groups, by those tokens: a cell travels with them, once for each block that its own meets
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "c"), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = near.join(sizes.where(F.col("n") > SMALL), "h").select("h", "doc_id", "c", "lo", "hi", "comp", "tokens", own.alias("block"), F.explode(meets).alias("p"))
    dealt = dealt.select(F.xxhash64("h", "p.i", "p.j").alias("key"), "block", (F.col("p.i") == F.col("p.j")).alias("alone"), "doc_id", "c", "lo", "hi", "comp", "tokens")
    by_common = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_alike(common), "x bigint, xc int, xl int, xh int, y bigint, yc int, yl int, yh int")
    out = cut(ties.unionByName(by_common), "open-ties")
    for table in (held, members, around, near, sizes):
        discard(table)
    for bits in (shared, bitmap, others):
        bits.destroy()
    return out


def near_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(x, y, xs, xe, ys, ye): passages (token places, ends exclusive) of documents x < y, of at least min_words words, verified."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _passages_and_classes(docs, min_words, percent, k, bands, key, text)[0]


def _passages_and_classes(docs: DataFrame, min_words: int, percent: int, k: int, bands: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    least = min_words - k + 1
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    shared = spark.sparkContext.broadcast(repeated_bitmap(read.mapInArrow(_centres(k, least, bands), "h bigint, many boolean"), FILTER_BITS))
    item, group = F.struct("doc_id", "c", "lo", "hi"), Window.partitionBy("h")
    # cells go to their groups once; all that is asked of a group later is told here
    cells = read.mapInArrow(_cells(k, least, bands, FILTER_BITS, shared), CELL)
    told = cells.withColumn("first", F.min(item).over(group)).withColumn("last", F.max(item).over(group)).withColumn("n", F.count("*").over(group))
    grouped = cut(told.where("first.doc_id <> last.doc_id"), "grouped")
    shared.destroy()
    both = grouped.select(item.alias("a"), F.explode(F.array("first", "last")).alias("b")).where("a.doc_id <> b.doc_id")
    stretches = _ties_to_stretches(both.select(*_pair("a", "b")), "stretches")
    # of up to three cells, first and last show every pair
    several = cut(grouped.where("n > 3").select("h", "doc_id", "c", "lo", "hi", ((item == F.col("first")) | (item == F.col("last"))).alias("end")), "several")
    discard(grouped)
    found = _compared(read, stretches, k, least, percent, "passages")
    label = connected_components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ties = _open_ties(read, several, label, k, least, percent)
    discard(several)
    again = _ties_to_stretches(ties, "open-stretches")
    discard(ties)
    again = cut(again.join(stretches, STRETCH, "left_anti"), "again")
    more = _compared(read, again, k, least, percent, "more")
    # classes go on from those that are there
    name = lambda side: F.coalesce(f"{side}.component", side[0]).alias(side)
    one, other = (label.select(F.col("node").alias(f"{n}_node"), F.struct("component").alias(f"{n}_of")) for n in "xy")
    links = more.select("x", "y").distinct().join(one, F.col("x") == F.col("x_node"), "left").join(other, F.col("y") == F.col("y_node"), "left")
    links = links.select(name("x_of").alias("a"), name("y_of").alias("b"))
    edges = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    for table in (stretches, again):
        discard(table)
    return found.unionByName(more), connected_components(edges)


def passage_report(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_shared_words (words in the passages found), class_id (the smallest
    doc_id linked, over any number of links), has_passage."""
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    sized = cut(read.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h1"), F.crc32(F.encode("text", "UTF-8")).alias("h2"), F.when(trimmed != "", F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("bigint").alias("n_words")), "sized")
    same = cut(sized.where("doc_id is not null and h1 is not null and n_words > 0").groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "same")
    # equal texts are compared once, by the smallest doc_id
    later = cut(sized.join(same.where("top > rep"), ["h1", "h2", "n_words"]).where("doc_id <> rep").select("doc_id").distinct(), "later")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        found, label = _passages_and_classes(read.join(later, "doc_id", "left_anti"), min_words, percent, k, bands, "doc_id", "text")
    fold = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] + k - 1 - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["e"] + k - 1).alias("end")),
    )["n"]
    per = cut(_merged_spans(found).join(label, F.col("d") == F.col("node")).select("d", fold.alias("shared"), "component"), "per")
    joined = sized.join(same, ["h1", "h2", "n_words"], "left").join(per, F.col("rep") == F.col("d"), "left")
    copied = F.coalesce(F.col("top") > F.col("rep"), F.lit(False)) & (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    mine = F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).when(mine, F.coalesce("shared", F.lit(0))).otherwise(0).cast("bigint").alias("n_shared_words"),
        F.when(mine, F.coalesce("component", F.when(copied, F.col("rep")), "doc_id")).alias("class_id"),
        (copied | (mine & F.col("shared").isNotNull())).alias("has_passage"),
    )
