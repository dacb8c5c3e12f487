"""Folds and splits against versions that recompute everything from the rule."""

import itertools
import random
import time

import pytest

from boxwright.operators import splitting
from tests.test_splits import vectors


def plain_folds(v, k, seed):
    fine = lambda g: {n: c for n, c in v[g].items() if n[0] == "f"}
    counted = lambda g: {"groups": 1, **{n: c for n, c in v[g].items() if n[0] != "p"}}
    total = {n: sum(counted(g).get(n, 0) for g in v) for g in v for n in counted(g)}
    order = sorted(v, key=lambda g: (-sum(c / total[n] for n, c in sorted(fine(g).items())), -sum(fine(g).values()), -v[g]["images"], splitting.rank(seed, g)))
    heavy = {"images": 1.0, "groups": 0.25}
    placed: dict[str, int] = {}
    for g in order:
        def score(f):
            here = placed | {g: f}
            held = [{n: sum(counted(x).get(n, 0) for x in here if here[x] == i) for n in total} for i in range(k)]
            spread = sum(heavy.get(n, 3.0 if n[0] == "f" else 2.0) * sum((h[n] / t - 1 / k) ** 2 for h in held) for n, t in total.items() if t)
            return round(spread, 12), held[f]["images"], splitting.rank(seed, f"{g}:{f}")

        placed[g] = min(range(k), key=score)
    return placed


@pytest.mark.parametrize("seed", range(4))
def test_folds(seed):
    v = vectors(seed, n=14)
    assert splitting.build_folds(v, 3, seed) == plain_folds(v, 3, seed)


@pytest.mark.parametrize("seed", range(6))
def test_cover_has_what_every_class_needs(seed):
    v = vectors(seed, n=12, classes=6)
    holders = {n: [g for g in v if v[g].get(n)] for n in {n for x in v.values() for n in x if n[0] == "f"}}
    fits = lambda s: all(splitting.required_groups(len(h), 0.3) <= len(s & set(h)) < len(h) for h in holders.values() if len(h) > 1)
    possible = any(fits(set(c)) for k in range(len(v) + 1) for c in itertools.combinations(v, k))
    try:
        found = splitting.cover(v, 0.3)
    except ValueError:
        assert not possible
    else:
        assert fits(found)


def plain_combination(labels, ratio, seed, least):
    order = sorted(labels, key=lambda g: splitting.rank(seed, g))
    ones, zeros = {g: labels[g].count(1) for g in order}, {g: labels[g].count(0) for g in order}
    need = min(least, sum(ones.values()) - 1)
    fits = lambda s: need <= sum(ones[g] for g in s) < sum(ones.values()) and 0 < sum(zeros[g] for g in s) < sum(zeros.values())
    held = None
    for size in range(1, len(order) + 1):
        for c in itertools.combinations([g for g in order if ones[g]], size):
            if sum(ones[g] for g in c) >= need and held is None:
                held = next((set(s) for s in [set(c), *({*c, g} for g in order if g not in c)] if fits(s)), None)
    if held is None:
        raise ValueError
    for g in order:
        if len(held) < max(1, min(len(order) - 1, round(len(order) * ratio))) and fits(held | {g}):
            held.add(g)
    return held


@pytest.mark.parametrize("seed", range(8))
def test_combination_split(seed):
    r = random.Random(seed)
    labels = {f"g{k}": [int(r.random() < 0.3) for _ in range(r.randint(1, 4))] for k in range(8)}
    try:
        want = plain_combination(labels, 0.3, seed, 3)
    except ValueError:
        with pytest.raises(ValueError):
            splitting.combination_split(labels, 0.3, seed, 3)
    else:
        assert splitting.combination_split(labels, 0.3, seed, 3) == want


@pytest.mark.parametrize("seed", range(8))
def test_expert_split(seed):
    r = random.Random(seed)
    vehicles = {f"g{k}": r.choice([0, 0, 1, 2, 5]) for k in range(9)}
    vehicles["g0"], vehicles["g1"] = 2, 3
    held = splitting.expert_split(vehicles, 0.25, seed)
    total, mine = sum(vehicles.values()), sum(vehicles[g] for g in held)
    assert min(3, total - 1) <= mine < total
    order = sorted(vehicles, key=lambda g: splitting.rank(seed, g))
    n = max(1, min(len(order) - 1, round(len(order) * 0.25)))
    first = set(order[:n])
    assert len(first - held) <= 1 and all(vehicles[g] for g in held - first)  # one may go back, and only groups with vehicles come in


def test_many_groups_are_split_in_linear_time():
    counts = {f"g{i:06}": (i % 3, 2) for i in range(60_000)}
    began = time.process_time()
    held = splitting.combination_of_counts(counts, 0.2)
    assert len(held) == 12_000 and time.process_time() - began < 5
