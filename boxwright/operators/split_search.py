"""The local search behind a validation split, scored by arrays.

A group is a column of counts: boxes by fine class, images that show it, boxes by coarse class. The chosen groups' sum is kept; a move (add,
remove or swap) is a difference of columns, and all moves of a round are scored at once. The greatest deviation of a fine class decides first, so
only moves that do not make it worse have the rest of their score computed.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

import numpy as np

from boxwright.operators.splitting import rank, required_groups

ROUNDS = 512
#: Up to so many swaps all are tried; beyond, those of so many groups a side for each class that is furthest off.
ALL_SWAPS, BEAM = 20_000, 48
SAME = 1e-12


@dataclass(frozen=True)
class Columns:
    """Groups as columns. `fine` says which rows of counts are boxes of fine classes; rows of a total of 0 are left out."""

    names: list[str]
    images: np.ndarray
    counts: np.ndarray
    fine: np.ndarray
    shows: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, vectors: Mapping[str, Mapping[str, int]], ratio: float) -> Columns:
        names = sorted(vectors)
        fine, seen, coarse = (sorted({n for v in vectors.values() for n in v if n[0] == kind}) for kind in "fpc")
        row = lambda n: [vectors[g].get(n, 0) for g in names]
        counts = np.array([row(n) for n in (*fine, *seen, *coarse)], np.int64).reshape(-1, len(names))
        kept = counts.sum(axis=1) > 0
        shows = np.array([row(n) for n in fine], np.int64).reshape(-1, len(names)) > 0
        holders = shows.sum(axis=1)
        # a class of one group cannot be on both sides and asks for nothing
        least = np.array([required_groups(int(k), ratio) if k > 1 else 0 for k in holders])
        return cls(names, np.array(row("images")), counts[kept], np.arange(len(counts))[kept] < len(fine), shows, least, np.where(holders > 1, holders - 1, holders))


Score = tuple[float, float, float, float]


def _scores(sums: np.ndarray, images: np.ndarray, groups: Columns, ratio: float) -> np.ndarray:
    """A row of four per column of sums: greatest fine deviation, squared and plain deviations summed, that of the images."""
    apart = np.abs(sums / groups.counts.sum(axis=1)[:, None] - ratio)
    # sums over the first axis add row by row, in order, so equal splits score equally
    return np.stack([apart[groups.fine].max(axis=0, initial=0.0), (apart * apart).sum(axis=0), apart.sum(axis=0), np.abs(images / groups.images.sum() - ratio)], axis=1)


def score(chosen: Collection[str], groups: Columns, ratio: float) -> Score:
    inside = np.isin(groups.names, list(chosen))
    return tuple(_scores(groups.counts[:, inside].sum(axis=1)[:, None], groups.images[inside].sum()[None], groups, ratio)[0].tolist())


def _beam(classes: np.ndarray, inside: np.ndarray, sums: np.ndarray, groups: Columns, ratio: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class furthest off, the groups to give away and to take that move it most towards its share (ties by seeded rank)."""
    out, into = set(), set()
    for c in classes:
        towards = 1 if sums[c] / groups.counts[c].sum() > ratio else -1
        by = np.lexsort((order, -towards * groups.counts[c]))
        out.update(by[inside[by]][:BEAM].tolist())
        by = np.lexsort((order, towards * groups.counts[c]))
        into.update(by[~inside[by]][:BEAM].tolist())
    return np.array(sorted(out), int), np.array(sorted(into), int)


def improve(vectors: Mapping[str, Mapping[str, int]], chosen: Collection[str], ratio: float, seed: int = 42, frozen: Collection[str] = (), least_images: int | None = None, most_images: int | None = None) -> set[str]:
    """The chosen groups after the best safe move of each round (the least seeded rank of equals), while one betters the score.

    Safe moves keep every class's groups on both sides, the frozen groups inside, and the images within the bounds.
    """
    if set(frozen) - set(chosen):
        raise ValueError("frozen groups must be chosen at first")
    if least_images is not None and most_images is not None and least_images > most_images:
        raise ValueError("least_images exceeds most_images")
    groups = Columns.of(vectors, ratio)
    order = np.argsort(np.argsort([rank(seed, g) for g in groups.names]))
    inside, held = np.isin(groups.names, list(chosen)), np.isin(groups.names, list(frozen))
    sums, images, have = groups.counts[:, inside].sum(axis=1), int(groups.images[inside].sum()), groups.shows[:, inside].sum(axis=1)
    now = _scores(sums[:, None], np.array([images]), groups, ratio)[0]
    none = len(groups.names)  # a last column of zeros: nothing taken, or nothing given
    counts = np.concatenate([groups.counts, np.zeros((len(groups.counts), 1), np.int64)], axis=1)
    sizes, shows = np.append(groups.images, 0), np.concatenate([groups.shows, np.zeros((len(groups.shows), 1), bool)], axis=1)
    for _ in range(ROUNDS):
        mine, others = np.flatnonzero(inside), np.flatnonzero(~inside)
        away, take = mine, others
        if len(mine) * len(others) > ALL_SWAPS:
            apart = np.where(groups.fine, np.abs(sums / groups.counts.sum(axis=1) - ratio), -1)
            away, take = _beam(np.flatnonzero(np.abs(apart - apart.max()) <= SAME), inside, sums, groups, ratio, order)
        away, take = away[~held[away]], take
        minus = np.concatenate([np.full(len(others), none), mine[~held[mine]], np.repeat(away, len(take))])
        plus = np.concatenate([others, np.full(len(mine[~held[mine]]), none), np.tile(take, len(away))])
        after = images - sizes[minus] + sizes[plus]
        there = have[:, None] - shows[:, minus] + shows[:, plus]
        touched = shows[:, minus] | shows[:, plus]
        safe = ~(touched & ((there < groups.least[:, None]) | (there > groups.most[:, None]))).any(axis=0)
        safe &= after >= (least_images or 0)
        if most_images is not None:
            safe &= after <= most_images
        minus, plus, after = minus[safe], plus[safe], after[safe]
        fine = np.flatnonzero(groups.fine)
        worst = np.abs((sums[fine, None] - counts[np.ix_(fine, minus)] + counts[np.ix_(fine, plus)]) / groups.counts[fine].sum(axis=1)[:, None] - ratio).max(axis=0, initial=0.0)
        hope = worst <= now[0]
        minus, plus, after = minus[hope], plus[hope], after[hope]
        if not len(minus):
            break
        scored = _scores(sums[:, None] - counts[:, minus] + counts[:, plus], after, groups, ratio)
        best = np.lexsort(scored.T[::-1])[0]
        if tuple(scored[best]) >= tuple(now):
            break
        named = lambda i: groups.names[i] if i < none else ""
        best = min(np.flatnonzero((scored == scored[best]).all(axis=1)), key=lambda i: rank(seed, f"{named(minus[i])}->{named(plus[i])}"))
        now, give, got = scored[best], minus[best], plus[best]
        sums, images, have = sums - counts[:, give] + counts[:, got], int(after[best]), have - shows[:, give] + shows[:, got]
        if give < none:
            inside[give] = False
        if got < none:
            inside[got] = True
    return {g for g, i in zip(groups.names, inside) if i}
