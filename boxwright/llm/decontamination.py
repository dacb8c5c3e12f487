"""Operator 6: benchmark decontamination as a prefix-filtered set join.

A window (ten consecutive words of an item; a shorter item is one window) is contained in a document only if all its
shingles are. Shingles are ordered by their frequency over all documents, so the necessary prefix of a window is its
rarest shingle. Documents are probed with those prefix shingles; the place of the shingle in the window and the
document's length bound where the window can lie; the words themselves are then compared.

Items are dealt into blocks of at most `block_windows` windows (a longer item is a block of its own); one block at a
time is broadcast and every document is read against it, so memory does not grow with the benchmark. Nothing is shuffled but
the shingle counts.

Defined cases: null and empty texts have no words and no hits; null or empty items have no windows; long texts are read
whole; repeated rows are judged alike; equal items are all reported; an empty benchmark leaves all clean; a document
column named like `out` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.bytekit import NOT_ALNUM, STEP, mix, pieces, shingle_hashes, text_bytes, word_hashes, words
from boxwright.llm.common import cut, dedupe_columns, fresh

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 50_000  # about 0.1 GB of the driver
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOUND = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<bigint>>"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window: array<string>), one row per item and distinct window."""
    lower = F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    tokens = F.filter(F.split(lower, SEPARATORS), lambda w: w != "")
    split = dedupe_columns(benchmark, ["item_id", "text"]).where("text is not null").select("item_id", tokens.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return split.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("window")).distinct()


class Block:
    """The windows of some items, with what a document is probed with."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        items: dict[bytes, set[int]] = defaultdict(set)
        for item, tokens in rows:
            items[" ".join(tokens).encode()].add(item)
        self.texts = sorted(items)
        self.items = [sorted(items[t]) for t in self.texts]
        data, offsets = text_bytes(pa.array(self.texts, pa.binary()))
        starts, ends, first = words(data, offsets, NOT_ALNUM)
        h = word_hashes(data, starts, ends)
        self.length = np.diff(first)
        self.whole = np.array([int(mix((h[first[i] : first[i + 1]] * STEP[: self.length[i]]).sum(keepdims=True))[0]) for i in range(len(self.texts))], np.uint64)
        self.shingles = [{} for _ in self.texts]  # hash: place in the window, the first
        for i in range(len(self.texts)):
            k = min(SHINGLE, int(self.length[i]))
            for place, x in enumerate(shingle_hashes(h[first[i] : first[i + 1]], k)):
                self.shingles[i].setdefault((k, int(x)), place)
        self.kinds = sorted({k for s in self.shingles for k, _ in s})

    def vocabulary(self) -> dict[int, np.ndarray]:
        return {k: np.unique(np.array([x for s in self.shingles for kk, x in s if kk == k], np.uint64)) for k in self.kinds}

    def anchor(self, frequency: dict[tuple[int, int], int]) -> dict[int, tuple]:
        """By shingle length: the prefix shingles, sorted, and for each its (window, place) pairs."""
        prefix: dict[int, dict[int, list]] = {k: defaultdict(list) for k in self.kinds}
        for i, s in enumerate(self.shingles):
            (k, x), place = min(s.items(), key=lambda e: (frequency.get(e[0], 0), e[0]))
            prefix[k][x].append((i, place))
        out = {}
        for k, found in prefix.items():
            keys = np.array(sorted(found), np.uint64)
            flat = [p for x in keys for p in found[int(x)]]
            out[k] = (keys, np.cumsum([0, *(len(found[int(x)]) for x in keys)]), np.array(flat, np.int64).reshape(-1, 2))
        return out


class Probe:
    """Is a hash among the keys? A bitmap of the low bits first, then a search."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys, self.seen = keys, np.zeros(1 << self.BITS, bool)
        self.seen[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into h that are keys, and which key."""
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << self.BITS) - 1)).view(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


def _tokenised(column: pa.Array) -> Iterator[tuple]:
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, off, NOT_ALNUM)
        yield a, b, part, starts, ends, first, word_hashes(part, starts, ends)


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {k: Probe(keys) for k, keys in vocabulary.value.items()}
        total = {k: np.zeros(len(p.keys), np.int64) for k, p in probes.items()}
        for batch in batches:
            for *_, first, h in _tokenised(batch.column(0)):
                last = np.repeat(first[1:], np.diff(first))
                for k, probe in probes.items():
                    at, which = probe.find(shingle_hashes(h, k))
                    inside = at + k <= last[at]
                    total[k] += np.bincount(which[inside], minlength=len(probe.keys))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(probes[k].keys[some].view(np.int64)), pa.array(n[some])], names=["k", "h", "n"])

    return run


def _matcher(shared, text_at: int, out: str):
    def hits(state, part, starts, ends, first, h):
        """Verified (word place, window) pairs of one piece."""
        texts, length, whole, anchors, probes = state
        last, begin = np.repeat(first[1:], np.diff(first)), np.repeat(first[:-1], np.diff(first))
        for k, probe in probes.items():
            at, which = probe.find(shingle_hashes(h, k))
            if not len(at):
                continue
            _, bounds, pairs = anchors[k]
            each = bounds[which + 1] - bounds[which]
            row = np.repeat(bounds[which], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            at = np.repeat(at, each)
            window, start = pairs[row, 0], at - pairs[row, 1]
            size = length[window]
            # the window must lie between the document's first and last word
            inside = (start >= begin[at]) & (start + size <= last[at])
            start, window, size = start[inside], window[inside], size[inside]
            for n in np.unique(size):
                of = np.flatnonzero(size == n)
                total = np.zeros(len(of), np.uint64)
                for j in range(int(n)):
                    total += h[start[of] + j] * STEP[j]
                for i in of[mix(total) == whole[window[of]]]:
                    a = int(start[i])
                    said = b" ".join(part[starts[j] : ends[j]].tobytes().lower() for j in range(a, a + int(n)))
                    if said == texts[window[i]]:
                        yield a, int(n), int(window[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, items, length, whole, anchors = shared.value
        state = (texts, length, whole, anchors, {k: Probe(a[0]) for k, a in anchors.items()})
        kind = pa.struct([("n_words", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("starts", "ends", "items"))])
        for batch in batches:
            found = []
            for a, b, part, starts, ends, first, h in _tokenised(batch.column(text_at)):
                by: dict[int, list] = defaultdict(list)
                for start, n, window in hits(state, part, starts, ends, first, h):
                    by[int(np.searchsorted(first, start, side="right")) - 1].append((start, n, window))
                for row in range(b - a):
                    spans, names = [], set()
                    for start, n, window in sorted(by.get(row, ())):
                        names.update(items[window])
                        start -= int(first[row])
                        if spans and start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], start + n)
                        else:
                            spans.append([start, start + n])
                    found.append({"n_words": int(first[row + 1] - first[row]), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(names)})
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found, kind)], names=[*(batch.schema.names[i] for i in keep), out])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, text: str = "text", out: str = "contamination") -> DataFrame:
    """Every row of docs with a struct `out`: n_words, starts and ends of the hit word spans (merged), items."""
    spark = docs.sparkSession
    windows = cut(item_windows(benchmark, window), "windows")
    n_windows = windows.count()
    n_blocks = max(1, -(-n_windows // block_windows))
    base = [c for c in docs.columns if c != out]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != out)
    result = docs.select(*[F.col(f"`{c}`") for c in base])
    part_names = [out] if n_blocks == 1 else list(fresh(docs, *[f"{out}_{b}" for b in range(n_blocks)]))
    parts: list[str] = []
    for b in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b).collect() if n_windows else []
        block = Block([(r[0], r[1]) for r in rows])
        vocabulary = spark.sparkContext.broadcast(block.vocabulary())
        counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_counter(vocabulary), "k int, h bigint, n bigint") if rows else None
        frequency = {(k, h & (2**64 - 1)): n for k, h, n in counts.groupBy("k", "h").agg(F.sum("n")).collect()} if rows else {}
        shared = spark.sparkContext.broadcast((block.texts, block.items, block.length, block.whole, block.anchor(frequency)))
        name = part_names[b]
        earlier = ", ".join(f"`{p}` {FOUND}" for p in parts)
        result = result.mapInArrow(_matcher(shared, base.index(text), name), ", ".join(x for x in (names, earlier, f"`{name}` {FOUND}") if x))
        parts.append(name)
    if n_blocks == 1:
        return result
    # spans of different blocks may overlap; merged by an ordered fold
    every = lambda f: F.flatten(F.array(*[F.col(f"`{p}`")[f] for p in parts]))
    (spans_at,) = fresh(result, "spans")
    spans = F.array_sort(F.arrays_zip(every("starts").alias("s"), every("ends").alias("e")))
    fold = F.aggregate(
        spans,
        F.expr("array(cast(null as struct<s:bigint,e:bigint>))"),
        lambda acc, x: F.when(
            F.element_at(acc, -1)["e"] >= x["s"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    merged = F.filter(fold, lambda x: x.isNotNull())
    joined = result.withColumn(spans_at, merged).withColumn(
        out, F.struct(F.col(f"`{parts[0]}`")["n_words"].alias("n_words"), F.col(f"{spans_at}.s").alias("starts"), F.col(f"{spans_at}.e").alias("ends"), F.array_sort(F.array_distinct(every("items"))).alias("items"))
    )
    return joined.select(*[F.col(f"`{c}`") for c in base], out)


def hit_words(found) -> F.Column:
    """Words covered by the merged spans of the struct."""
    return F.aggregate(F.zip_with(found["starts"], found["ends"], lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; the columns of docs, whatever their names."""
    (out,) = fresh(docs, "contamination")
    return find_contamination(docs, benchmark, out=out, **options).where(F.size(F.col(out)["starts"]) == 0).drop(out)
