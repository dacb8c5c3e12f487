"""Operator 2: packing by cutting-stock column generation.

Each document is tokenised once; it is cut into whole sequences and one rest. The rests' lengths, rounded up to a grid,
form a histogram of at most length / grid entries, whose counts are the demands of a cutting-stock problem: a linear
program over patterns, started from first-fit patterns, priced by a knapsack dynamic programme, rounded down and
finished by first-fit decreasing on what is left. Documents are ranked within their length class (salted, so that a
common length is no single task), and the rank decides pattern, sequence and place.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence has several pieces, each
id in exactly one; repeated rows are packed each for itself; a null doc_id stays null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.common import cut, dedupe_columns, gapless_rank

LENGTH = 2048
GRID = 8
END_ID = 1
N_SALTS = 64
LONG_RUN = 50_000
#: Fixed value: how byte-level BPE cuts a text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of the types by value within the capacity (unbounded knapsack)."""
    worth = np.full(capacity + 1, -np.inf)  # by size
    worth[size] = value
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = worth[1 : c + 1] + best[c - 1 :: -1] if c > 1 else worth[1:2] + best[:1]
        k = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], took[c] = gain[k], k + 1
    pattern, c = np.zeros(len(size), np.int64), capacity
    which = np.zeros(capacity + 1, np.int64)
    which[size] = np.arange(len(size))
    while c > 0:
        if took[c]:
            pattern[which[took[c]]] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_fit(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by type, times used) that meet the demand exactly: greedy, largest first, repeated while it fits."""
    left, made = demand.copy(), []
    while left.any():
        pattern, room = np.zeros(len(size), np.int64), capacity
        for k in range(len(size) - 1, -1, -1):
            take = min(int(left[k]), room // int(size[k]))
            pattern[k], room = take, room - take * int(size[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        made.append((pattern, times))
    return made


def cutting_stock(size: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = 2000, gap: float = 0.001) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, meeting every demand exactly.

    Revised simplex over patterns: the basis starts with one pattern per type, the dual prices a knapsack, and the
    improving pattern enters until the bound sum / worth shows the programme within `gap` of its optimum (or max_columns;
    both bound the time, not the result's correctness).
    """
    size, demand = np.asarray(size, np.int64), np.asarray(demand, np.int64)
    m = len(size)
    if not m:
        return []
    columns = [np.eye(m, dtype=np.int64)[k] * (capacity // size[k]) for k in range(m)]
    inverse = np.diag([1.0 / c[k] for k, c in enumerate(columns)])
    amount = (inverse * demand).sum(axis=1)  # small products without BLAS threads
    for _ in range(max_columns):
        dual = inverse.sum(axis=0)
        worth, pattern = knapsack(np.maximum(dual, 0), size, capacity)
        if worth <= 1 + max(gap, 1e-7):
            break
        way = (inverse * pattern).sum(axis=1)
        grow = way > 1e-9
        ratio = np.where(grow, amount / np.where(grow, way, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = amount - ratio[out] * way
        amount[out] = ratio[out]
        columns[out] = pattern
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
    left, plan = demand.copy(), []
    for k in np.argsort(-amount, kind="stable"):
        used = columns[k] > 0
        times = min(int(np.floor(amount[k] + 1e-9)), int((left[used] // columns[k][used]).min()))
        if times > 0:
            plan.append((columns[k], times))
            left -= columns[k] * times
    return plan + first_fit(size, left, capacity)


def byte_bpe(tokenizer_path: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding, which gives the same ids in a sixth of the time.

    In such a vocabulary a token's id is the rank of its merge; its bytes are written as printable characters.
    The file's added tokens are cut out of the text first, so `encode` must allow them.
    """
    import json

    import tiktoken

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(tokenizer_path) as f:
        spec = json.load(f)
    added = spec.get("added_tokens", ())
    if any(t.get(how) for t in added for how in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token takes more than its own text")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def token_ids(tokenizer_path: str):
    """The function that gives a text's ids. Texts with very long runs of white space, on which the faster encoder's pattern
    engine gives up, are read by the slower one."""
    coder, slow = byte_bpe(tokenizer_path), []

    def ids(text: str) -> list[int]:
        if len(text) <= LONG_RUN or max(map(len, re.findall(r"\s+", text)), default=0) <= LONG_RUN:
            return coder.encode(text, allowed_special="all")
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(tokenizer_path))
        return slow[0].encode(text, add_special_tokens=False).ids

    return ids


def _cutter(tokenizer_path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[list[int]] = [[], [], [], [], []]
            for i, key in enumerate(keys):
                ids = np.array([*encode(texts[i].as_py() or ""), end_id], "<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    for column, value in zip(rows, (key, s, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, grid: int = GRID, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cuts = cut(read.mapInArrow(_cutter(tokenizer_path, length, end_id), PIECE_SCHEMA).withColumn("class", F.ceil(F.col("length") / grid).cast("int")), "pieces")
    # at most length / grid rows
    demand = dict(cuts.groupBy("class").count().orderBy("class").collect())
    sizes = np.array(list(demand), np.int64)
    plan = cutting_stock(sizes, np.array(list(demand.values())), length // grid)
    # for each class, which ranks go to which run of sequences; at most classes x patterns rows
    rows, first_sequence, first_rank = [], 0, [0] * len(sizes)
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            each = int(pattern[k])
            rows.append((int(sizes[k]), first_rank[k], first_rank[k] + each * times, each, first_sequence))
            first_rank[k] += each * times
        first_sequence += times
    schema = "class int, from_rank bigint, to_rank bigint, each bigint, first_sequence bigint"
    table = spark.createDataFrame(rows, schema).groupBy(F.col("class").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "each", "first_sequence"))).alias("_runs"))
    ranked = gapless_rank(cuts, "class", F.xxhash64("doc_id", "start"), N_SALTS, ["doc_id", "start", "ids_crc32"])
    run = F.filter("_runs", lambda r: (F.col("rank") >= r["from_rank"]) & (F.col("rank") < r["to_rank"]))[0]
    placed = ranked.join(F.broadcast(table), F.col("class") == F.col("_c")).withColumn("_run", run)
    placed = placed.withColumn("sequence_id", F.expr("_run.first_sequence + (rank - _run.from_rank) div _run.each"))
    # a sequence holds at most `length` pieces
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
