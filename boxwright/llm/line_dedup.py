"""Operator 7: cross-site boilerplate lines by distinct-site spread.

Each line is hashed; a HyperLogLog sketch of the sites per line hash merges by aggregation. Lines whose estimate is
clearly at or over the threshold are boilerplate, lines clearly under it are not, and lines near it get an exact
distinct count. Boilerplate lines are then taken out of every document: up to SMALL of them (counted first) go to all
executors as one hash table and no text is shuffled; more are joined with the documents' lines.

Defined cases: a line with no word is never boilerplate; a null site counts as none; a null text has no lines and stays
null; repeated rows are cleaned alike; documents left without lines become empty; other columns are kept as they are, whatever their names (one named `found` is replaced);
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import cut, fresh

MIN_SITES = 10
LG_K = 12
BAND = 0.10  # six standard errors of a sketch with 2**12 registers
SMALL = 200_000  # hashes, 1.6 MB
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(line_hash) of the lines that occur on at least min_sites sites."""
    lines = docs.select(F.col(f"`{site}`").alias("site"), F.explode(F.array_distinct(F.split(F.col(f"`{text}`"), "\n"))).alias("line"))
    hashed = lines.where(F.col("line").rlike(HAS_WORD) & F.col("site").isNotNull()).select(_hash(F.col("line")).alias("line_hash"), F.col("site").cast("string").alias("site"))
    # a line with fewer occurrences than sites asked for needs no sketch; counts combine before the shuffle
    spread = hashed.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = cut(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("line_hash")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("line_hash")
    pairs = hashed.join(near, "line_hash", "left_semi").distinct()
    exact = pairs.groupBy("line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line_hash")
    return cut(sure.unionByName(exact), "boilerplate")


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", found: str | None = None, small: int = SMALL) -> DataFrame:
    """docs with boilerplate lines taken out of the text. With `found`, a column of that name counts the lines removed."""
    spark = docs.sparkSession
    gone = boilerplate_lines(docs, min_sites, text, site)
    lines = F.split(F.col(f"`{text}`"), "\n")
    n = gone.count()
    slots_at, kept_at, key_at, gone_at = fresh(docs, "_slots", "_kept", "_k", "_gone")
    if n <= small:
        size = 1 << max(0, n.bit_length() - 1)
        slots: list[list[int]] = [[] for _ in range(size)]
        for (h,) in gone.collect():
            slots[h % size].append(h)
        found_lines = spark.createDataFrame([(slots,)], "slots array<array<bigint>>")
        joined = docs.withColumn(slots_at, found_lines.scalar())
        kept = F.filter(lines, lambda x: ~F.array_contains(F.get(F.col(slots_at), F.pmod(_hash(x), F.lit(size)).cast("int")), _hash(x)))
    else:
        mine = docs.select(F.col(f"`{key}`").alias(key_at), F.explode(F.array_distinct(lines)).alias("_line")).select(key_at, _hash(F.col("_line")).alias("line_hash"))
        hits = cut(mine.join(gone, "line_hash").groupBy(key_at).agg(F.collect_set("line_hash").alias(gone_at)), "hits")  # bounded by the document
        joined = docs.join(hits, F.col(f"`{key}`").eqNullSafe(F.col(key_at)), "left")
        kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone_at), _hash(x)), F.lit(False)))
    joined = joined.withColumn(kept_at, kept)
    same = F.size(kept_at) == F.size(lines)
    cleaned = F.when(same | F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept_at, "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != found]
    if found:
        columns.append(F.coalesce(F.size(lines) - F.size(kept_at), F.lit(0)).cast("bigint").alias(found))
    return joined.select(*columns)
