"""Group-safe splits and folds.

The searches are sequential by nature and run on the driver over one vector of counts per source group (thousands of
rows, whatever the number of boxes); the vectors and the checks of the result are distributed.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Collection, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the squared deviations.
WEIGHTS = {"images": 1.0, "groups": 0.25, "fine": 3.0, "coarse": 2.0}


def rank(seed: int, value: str) -> str:
    return hashlib.sha256(f"{seed}:{value}".encode()).hexdigest()


def group_vectors(images: DataFrame, annotations: DataFrame, coarse) -> dict[str, dict[str, int]]:
    """Per group: images, boxes by fine ('f<id>') and coarse class ('c<name>'), and images that show a fine class ('p<id>')."""
    n = images.groupBy("group_id").agg(F.count("*").alias("n"))
    boxes = annotations.where(~F.col("difficult")).join(images.select("image_id", "group_id"), "image_id")
    fine = F.col("class_id").cast("string")
    per = boxes.groupBy("group_id", F.concat(F.lit("f"), fine).alias("k")).agg(F.count("*").alias("n"))
    per = per.unionByName(boxes.groupBy("group_id", F.concat(F.lit("c"), coarse).alias("k")).agg(F.count("*").alias("n")))
    per = per.unionByName(boxes.groupBy("group_id", F.concat(F.lit("p"), fine).alias("k")).agg(F.countDistinct("image_id").alias("n")))
    out = {r["group_id"]: {"images": r["n"]} for r in n.orderBy("group_id").collect()}
    for r in per.orderBy("group_id", "k").collect():
        out[r["group_id"]][r["k"]] = r["n"]
    return out


def weight(name: str) -> float:
    return WEIGHTS[name] if name in ("images", "groups") else WEIGHTS["fine" if name[0] == "f" else "coarse"]


def partition_score(folds: Sequence[Mapping[str, int]], total: Mapping[str, int]) -> float:
    """Weighted squared deviations of the folds' shares from equal ones."""
    equal = 1 / len(folds)
    return sum(weight(n) * sum((f.get(n, 0) / whole - equal) ** 2 for f in folds) for n, whole in total.items() if whole > 0)


def build_folds(vectors: Mapping[str, Mapping[str, int]], k: int, seed: int = 42) -> dict[str, int]:
    """Groups to folds: those that hold the largest shares of the fine classes first (then more boxes, more images, seeded
    rank), each to the fold that leaves the best score (ties: fewest images, then seeded rank of group and fold)."""
    if len(vectors) < k:
        raise ValueError("fewer groups than folds")
    vectors = {g: {"groups": 1, **{n: c for n, c in v.items() if n[0] != "p"}} for g, v in vectors.items()}
    total: dict[str, int] = {}
    for g in sorted(vectors):
        for name, n in vectors[g].items():
            total[name] = total.get(name, 0) + n
    fine = lambda g: [(n, c) for n, c in vectors[g].items() if n[0] == "f"]
    order = sorted(vectors, key=lambda g: (-sum(c / total[n] for n, c in fine(g)), -sum(c for _, c in fine(g)), -vectors[g]["images"], rank(seed, g)))
    folds: list[dict[str, int]] = [{} for _ in range(k)]
    out = {}
    for g in order:
        tried = [{n: f.get(n, 0) + vectors[g].get(n, 0) for n in {*f, *vectors[g]}} for f in folds]
        scores = [(partition_score([*folds[:f], tried[f], *folds[f + 1 :]], total), tried[f]["images"], rank(seed, f"{g}:{f}"), f) for f in range(k)]
        out[g] = min(scores)[-1]
        folds[out[g]] = tried[out[g]]
    return out


def required_groups(n: int, ratio: float) -> int:
    """Validation groups of a class that n groups have: a half-even share, at least one, and one must remain."""
    return max(1, min(n - 1, round(n * ratio)))


def cover(vectors: Mapping[str, Mapping[str, int]], ratio: float, seed: int = 42, start: Collection[str] = ()) -> set[str]:
    """Groups that together hold every class in at least its required number of groups, found with backtracking from the groups of `start`;
    states that failed are remembered. A class in one group alone cannot be split and asks for nothing."""
    holders = {n: [] for n in sorted({n for v in vectors.values() for n in v if n[0] == "f"})}
    for g in sorted(vectors, key=lambda g: (vectors[g]["images"], rank(seed, g))):
        for n in vectors[g]:
            if n[0] == "f" and vectors[g][n]:
                holders[n].append(g)
    need = {n: required_groups(len(h), ratio) for n, h in holders.items() if len(h) > 1}
    shown = {g: [n for n in v if n in need and v[n]] for g, v in vectors.items()}
    chosen, have = set(start), dict.fromkeys(need, 0)
    for g in chosen:
        for n in shown[g]:
            have[n] += 1
    spoils = lambda g: any(have[n] + 1 >= len(holders[n]) for n in shown[g])
    failed: set[frozenset] = set()
    path: list[tuple[str, Iterator[str]]] = []
    while short := [n for n, k in need.items() if have[n] < k]:
        rarest = min(short, key=lambda n: (len(holders[n]), n))
        tried = iter([] if failed and frozenset(chosen) in failed else [g for g in holders[rarest] if g not in chosen])
        while (g := next((g for g in tried if not spoils(g)), None)) is None:
            failed.add(frozenset(chosen))
            if not path:
                raise ValueError("no set of groups covers every class")
            last, tried = path.pop()
            chosen.remove(last)
            for n in shown[last]:
                have[n] -= 1
        path.append((g, tried))
        chosen.add(g)
        for n in shown[g]:
            have[n] += 1
    return chosen


def select_validation(vectors: Mapping[str, Mapping[str, int]], ratio: float, seed: int = 42, frozen: Collection[str] = ()) -> set[str]:
    """Cover (from the frozen groups on), fill by seeded rank up to the share of images, then local search with the share as its least number
    of images and, as its greatest, what one group can bring it over."""
    from boxwright.operators.split_search import improve

    chosen = cover(vectors, ratio, seed, frozen)
    target = math.ceil(sum(v["images"] for v in vectors.values()) * ratio)
    whole: dict[str, int] = {}
    for v in vectors.values():
        for n in v:
            if n[0] == "f" and v[n]:
                whole[n] = whole.get(n, 0) + 1
    have = {n: sum(1 for g in chosen if vectors[g].get(n)) for n in whole}
    images = sum(vectors[g]["images"] for g in chosen)
    for g in sorted(set(vectors) - chosen, key=lambda g: rank(seed, g)):
        if images >= target:
            break
        shown = [n for n in vectors[g] if n[0] == "f" and vectors[g][n]]
        if all(have[n] + 1 < whole[n] for n in shown if whole[n] > 1):
            chosen.add(g)
            images += vectors[g]["images"]
            for n in shown:
                have[n] += 1
    if images < target:
        raise ValueError(f"too few images while every class keeps a group for training: target={target}, actual={images}")
    most = max(images, target + max(v["images"] for v in vectors.values()) - 1)
    return improve(vectors, chosen, ratio, seed, frozen, target, most)


def expert_split(vehicles: Mapping[str, int], ratio: float, seed: int = 42, least: int = 3) -> set[str]:
    """Holdout groups (vehicles by group): a half-even share of the groups by seeded rank. If they hold all vehicles, the last
    one with any goes back; if too few, the next groups with vehicles come in while some remain outside."""
    order = sorted(vehicles, key=lambda g: rank(seed, g))
    n = max(1, min(len(order) - 1, round(len(order) * ratio)))
    total, held = sum(vehicles.values()), set(order[:n])
    have = lambda: sum(vehicles[g] for g in held)
    need = min(least, total - 1)
    if have() == total:
        held.remove(next(g for g in reversed(order[:n]) if vehicles[g]))
    for g in order[n:]:
        if have() >= need:
            break
        if vehicles[g] and total - have() - vehicles[g] > 0:
            held.add(g)
    if have() < need or have() >= total:
        raise ValueError("no split has vehicles on both sides")
    return held


def combination_split(labels: Mapping[str, Sequence[int]], ratio: float, seed: int = 42, least: int = 3) -> set[str]:
    """Holdout groups: the first smallest combination of groups with positives, by seeded rank, that (with one more group, if need
    be) holds `least` positives and leaves positives and negatives on both sides; then groups by rank up to a half-even share."""
    return combination_of_counts({g: (sum(v), len(v) - sum(v)) for g, v in labels.items()}, ratio, seed, least)


def combination_of_counts(counts: Mapping[str, tuple[int, int]], ratio: float, seed: int = 42, least: int = 3) -> set[str]:
    """As combination_split, of each group's numbers of positives and negatives."""
    order = sorted(counts, key=lambda g: rank(seed, g))
    if len(order) < 2:
        raise ValueError("fewer than two groups")
    pos, neg = ({g: counts[g][i] for g in order} for i in (0, 1))
    all_pos, all_neg = sum(pos.values()), sum(neg.values())
    if all_pos < 2 or all_neg < 2:
        raise ValueError("fewer than two positives or negatives")
    need = min(least, all_pos - 1)
    fits = lambda p, n: need <= p < all_pos and 0 < n < all_neg
    valid = lambda s: fits(sum(pos[g] for g in s), sum(neg[g] for g in s))
    having = [g for g in order if pos[g]]
    chosen = (set(c) for size in range(1, len(having) + 1) for c in itertools.combinations(having, size))
    tried = (t for c in chosen if sum(pos[g] for g in c) >= need for t in itertools.chain((c,), (c | {g} for g in order if g not in c)))
    held = next(filter(valid, tried), None)
    if held is None:
        raise ValueError("no combination has positives and negatives on both sides")
    n = max(1, min(len(order) - 1, round(len(order) * ratio)))
    held_pos, held_neg = sum(pos[g] for g in held), sum(neg[g] for g in held)
    for g in order:
        if len(held) >= n:
            break
        if g not in held and fits(held_pos + pos[g], held_neg + neg[g]):
            held.add(g)
            held_pos, held_neg = held_pos + pos[g], held_neg + neg[g]
    return held


def disjoint(assigned: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that lie in more than one split: must be empty."""
    return assigned.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
