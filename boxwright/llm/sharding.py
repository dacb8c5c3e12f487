"""Operator 4: sharding through fixed virtual slots and a versioned slot-to-shard map.

Records hash into `n_slots` virtual slots; bytes are summed per slot; a map slot -> shard is stored as a new version
each time it is edited: a path that holds a map already gets its newest version edited and stored as the next one.
Version 0 deals the slots round robin. `rebalance` edits a map: it takes slots from shards above
the mean and gives them to shards below until no move helps, so that sizes are near equal (law `bytes`).
The map has n_slots rows (a parameter), so planning it on the driver and broadcasting it stay bounded.

Defined cases: a null text has 0 bytes, so size 1 and a null-safe checksum of 0 bytes; repeated rows are all kept, each
with its own place and spread over slots as others are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.llm.common import cut, dedupe_columns, scratch_path

N_SLOTS = 4096


def slot_of(key, n_slots: int):
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(owner: list[int], weight: list[int], n_shards: int) -> list[int]:
    """An edited copy of the map: moves of a slot, then swaps of two, while they bring two shards closer."""
    owner = list(owner)
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        held[shard].append(slot)
    for _ in range(8 * len(owner)):
        high = max(range(n_shards), key=lambda s: (load[s], s))
        low = min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [s for s in held[high] if 0 < weight[s] < gap]
        if fits:
            slot = min(fits, key=lambda s: (abs(2 * weight[s] - gap), s))
            swap = None
        else:
            # the move that is too large alone may do with one in return: of each, the partner that halves the gap best
            slot, swap, best = None, None, gap
            theirs = sorted((weight[s], s) for s in held[low])
            for a in held[high]:
                at = bisect_left(theirs, (weight[a] - gap / 2, -1))
                for w, b in theirs[max(0, at - 1) : at + 1]:
                    if weight[a] > w and abs(gap - 2 * (weight[a] - w)) < best:
                        slot, swap, best = a, b, abs(gap - 2 * (weight[a] - w))
        if slot is None:
            break
        for s, src, dst in ((slot, high, low), *([(swap, low, high)] if swap is not None else [])):
            held[src].remove(s)
            held[dst].append(s)
            owner[s] = dst
            load[src] -= weight[s]
            load[dst] += weight[s]
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    rows = [(s, shard) for s, shard in enumerate(owner)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest version of the map stored in `path`; -1 if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=-1)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def shard_by_bytes(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (place within the shard, gapless from 0), map_version."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    sized = dedupe_columns(docs, [key, text]).select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    sized = cut(sized.withColumn("_row", F.xxhash64(key, "text_crc32", "size")).withColumn("_nth", F.monotonically_increasing_id()), "sized")
    # repeated rows are told apart by their place, or all would go to one slot
    again = sized.groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_row", F.lit(True).alias("_again"))
    told = sized.join(again, "_row", "left").select(key, "size", "text_crc32", F.when(F.col("_again"), F.col("_nth")).otherwise(0).alias("_nth"))
    sized = cut(told.withColumn("virtual_slot", slot_of(F.struct(key, "text_crc32", "_nth"), n_slots)), "slotted")
    # at most n_slots rows
    per_slot = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    weight, count = [0] * n_slots, [0] * n_slots
    for r in per_slot:
        weight[r[0]], count[r[0]] = r[1], r[2]
    map_path = map_path or scratch_path(spark, "slot-map")
    version = latest_version(spark, map_path)
    if version < 0:
        version, owner = 0, initial_map(n_slots, n_shards)
        write_map(spark, map_path, 0, owner)
    else:
        owner = [r[0] for r in read_map(spark, map_path, version).orderBy("virtual_slot").select("shard").collect()]
        if len(owner) != n_slots or max(owner) >= n_shards:
            raise ValueError("the stored map has other slots or more shards")
    owner, version = rebalance(owner, weight, n_shards), version + 1
    write_map(spark, map_path, version, owner)
    nth, rows = [0] * n_shards, []
    for s, shard in enumerate(owner):
        rows.append((s, shard, nth[shard]))
        nth[shard] += count[s]
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, first bigint")
    within = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size", "_nth")
    return (
        sized.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(places), "virtual_slot")
        .select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("_rn") - 1).alias("slot"), F.lit(version).alias("map_version"))
    )
