"""Operator 8: near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Documents with equal sets form a class, and only one of each class goes on.
Under each permutation both the least and the greatest value are kept, so a signature of 2 x permutations values costs
half the hash evaluations; minima and maxima go to different bands. Classes that share a band's key are candidates.
Within a bucket, the agreement of longer signatures (two bits a value; with four bytes of each band's key, by which a
pair is asked about once) rules out pairs under the threshold by four standard deviations; what is left is
confirmed on the full sets of shingle hashes, and confirmed links are contracted to components.

Two rounds keep dense groups linear: the first confirms each member's most similar partners only; the second takes
every pair of a bucket whose members are still in different components. Large buckets are split: in the first round into
blocks that all hold the bucket's smallest member, in the second into pairs of blocks, so no task holds a whole bucket.

Candidates: at similarity s, a pair misses all b bands of r values with probability (1 - s^r)^b. r is the greatest that keeps
this under MISS at the threshold: 32 bands of 8 at .85 (4e-5; 1e-8 at .9), 42 of 6 at .8 (3e-6).

Defined cases: a text with fewer words than a shingle is one shingle, the whole sequence; without words (or null) the
set is empty and linked with nothing; rows that share a doc_id count as one document; a null doc_id is linked with nothing, kept, and has a null component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.bytekit import SPACES, STEP, mix, pieces, shingle_hashes, text_bytes, whole_groups, word_hashes, words
from boxwright.llm.common import bitmap_of, connected_components, cut, dedupe_columns

SHINGLE = 5
PERMUTATIONS = 128  # whose minima and maxima are banded
ESTIMATES = 512  # whose minima and maxima estimate similarity
BLOCK = 512
MISS = 1e-4  # the most that a pair at the threshold may be missed with

_rng = np.random.Generator(np.random.PCG64(77))
MULTIPLIER = _rng.integers(0, 2**32, ESTIMATES, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 2**32, ESTIMATES, dtype=np.uint32)
SIGNED = "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary"


def banding(percent: int) -> tuple[int, int]:
    """Bands, and values in each."""
    s = percent / 100
    rows = max(r for r in range(1, 33) if r == 1 or (1 - s**r) ** (2 * PERMUTATIONS // r) <= MISS)
    return 2 * PERMUTATIONS // rows, rows


def least_agreement(percent: int) -> float:
    """Four standard deviations of the estimate under the threshold: two bits of unequal values agree in a quarter of cases."""
    s = percent / 100
    p = s + (1 - s) / 4
    return s - 4 * (p * (1 - p) / (2 * ESTIMATES)) ** 0.5 / 0.75


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, off, SPACES)
        h = word_hashes(part, starts, ends)
        s = shingle_hashes(h, k)
        for row in range(b - a):
            lo, hi = int(first[row]), int(first[row + 1])
            if hi - lo >= k:
                yield a + row, np.unique(s[lo : hi - k + 1])
            elif hi > lo:
                yield a + row, mix((h[lo:hi] * STEP[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
            else:
                yield a + row, s[:0]


def signature(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of each permutation over the set; 32 bits each."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(ESTIMATES, 2**32 - 1, np.uint32), np.zeros(ESTIMATES, np.uint32)
    for s in range(0, len(x), 512):
        v = (x[s : s + 512][None, :] ^ FLIP[:, None]) * MULTIPLIER[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def two_bits(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values in a word."""
    bits = ((values >> np.uint32(11)) & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _signer(k: int, bands_n: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = STEP[:per][None, :]
        for batch in batches:
            n_rows = batch.num_rows
            n, f1, f2 = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
            bands, sigs = [None] * n_rows, [None] * n_rows
            for row, u in shingle_sets(batch.column(1), k):
                n[row] = len(u)
                if len(u):
                    f1[row], f2[row] = mix(u).sum(), mix(u ^ np.uint64(0x5BD1E9955BD1E995)).sum()
                    low, high = signature(u)
                    sig = np.concatenate([low[:PERMUTATIONS], high[:PERMUTATIONS]])
                    keys = mix((sig[: bands_n * per].reshape(bands_n, per).astype(np.uint64) * weight).sum(axis=1) + np.arange(bands_n, dtype=np.uint64) * STEP[40])
                    bands[row], sigs[row] = keys.view(np.int64), two_bits(np.concatenate([low, high])).tobytes() + keys.astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "bands", "sig"],
            )

    return run


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of a with every row of b; rows are words of two-bit values."""
    apart = np.empty((len(a), len(b)), np.float32)
    for i in range(len(a)):
        x = b ^ a[i]
        apart[i] = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    return 1 - apart / (32 * a.shape[1]) * np.float32(4 / 3)


def _pairs(least: float, threshold: float, top: int | None):
    """Candidate pairs of each bucket (rows sorted by bucket): of different components, sizes and signatures near enough."""

    def of(ids, n, sig, comp, band):
        k = len(ids)
        if k < 2 or (comp == comp[0]).all():
            return None
        both = np.frombuffer(b"".join(sig), np.uint8).reshape(k, -1)
        size = 2 * ESTIMATES // 4
        s, bands = (np.ascontiguousarray(x).view(t) for x, t in ((both[:, :size], np.uint64), (both[:, size:], np.uint32)))
        # all pairs have a member outside the largest component
        names, counts = np.unique(comp, return_counts=True)
        rest = np.arange(k) if top else np.flatnonzero(comp != names[np.argmax(counts)])
        found = []
        for at in range(0, len(rest), 256):
            rows = rest[at : at + 256]
            j = _agreement(s[rows], s)
            ok = (j >= least) & (comp[rows][:, None] != comp[None, :])
            ok &= np.minimum(n[rows][:, None], n[None, :]) >= (threshold - 1e-9) * np.maximum(n[rows][:, None], n[None, :])
            if top and k > top + 1:
                # the most similar ones, the smallest id of equals first, which whole groups have in common
                j[~ok] = -1
                best = np.lexsort((np.broadcast_to(ids, j.shape), -j), axis=1)[:, :top]
                r, c = np.repeat(np.arange(len(rows)), top), best.ravel()
                keep = ok[r, c]
                r, c = r[keep], c[keep]
            else:
                r, c = np.nonzero(ok)
                # a pair that shares several bands is asked about in the first of them
                first = np.concatenate([(bands[rows[r[i : i + 65536]]] == bands[c[i : i + 65536]]).argmax(axis=1) for i in range(0, len(r), 65536)]) if len(r) else r
                r, c = r[first == band], c[first == band]
            a, b = ids[rows[r]], ids[c]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            keys = table.column("key").to_numpy()
            ids, n, comp, band = (table.column(c).to_numpy() for c in ("id", "n", "comp", "band"))
            sig = table.column("sig").to_pylist()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            found = [p for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1 and (p := of(ids[s:e], n[s:e], sig[s:e], comp[s:e], band[s])) is not None]
            if found:
                p = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    return run


def _setter(k: int, ids):
    """The sets of the documents that a bitmap of ids lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(ids.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            through = np.flatnonzero(seen[(mix(keys.astype(np.int64).view(np.uint64)) & np.uint64(len(seen) - 1)).view(np.int64)])
            if not len(through):
                continue
            some = batch.take(pa.array(through))
            rows = [u.tobytes() for _, u in shingle_sets(some.column(1), k)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.binary())], names=["doc_id", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for x, y in zip(left, right, strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True)) if u is not v else len(u)
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked, over any number of links), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(read.mapInArrow(_signer(k, *banding(percent)), SIGNED), "signed")
    known = signed.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    nodes = known.join(classes.select("f1", "f2", F.col("id").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "bands", "sig")
    keyed = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("low")).where("k > 1"), "buckets")
    members = cut(keyed.join(buckets, "key"), "members")
    held = cut(nodes.select("id", "n", "sig").join(members.select("id").distinct(), "id", "left_semi"), "held")
    least = least_agreement(percent)
    label = None
    for top in (1, None):
        if label is None:
            state = held.withColumn("comp", F.col("id"))
            rows = members
        else:
            state = cut(held.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "state")
            # only buckets that still hold two components
            open_keys = members.join(state.select("id", "comp"), "id").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
            rows = members.join(open_keys, "key", "left_semi")
        parts = F.ceil(F.col("k") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("id"), parts).cast("int")
        if top:
            blocks = F.when(F.col("id") == F.col("low"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
        else:
            blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * 1000003 + F.greatest(own, j))
        dealt = rows.select("id", "key", "band", F.explode(blocks).alias("block")).select("id", "band", F.xxhash64("key", "block").alias("key"))
        sent = dealt.join(state, "id").select("key", "band", "id", "n", "comp", "sig").repartition("key").sortWithinPartitions("key")
        pairs = sent.mapInArrow(_pairs(least, percent / 100, top), "a bigint, b bigint").distinct()
        pairs = cut(pairs, "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        bitmap = spark.sparkContext.broadcast(bitmap_of(asked))
        sets = cut(read.mapInArrow(_setter(k, bitmap), "doc_id bigint, members binary").join(asked.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right"))
        found = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
        # the second round goes on from the components of the first
        label = connected_components(found if label is None else label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    joined = signed.select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "id"), ["f1", "f2"], "left").join(label, F.col("id") == F.col("node"), "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component; the columns of docs."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(cut(gone, "gone"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
