"""What the corpus operators share: scratch tables, let-bindings, salted ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.llm.bytekit import filter_place, mix


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or (local mode only) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='boxwright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by cut, once everything made from it has been written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Of what runs inside, Arrow batches have at most so many rows: a batch is held several times over by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> Iterator[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns of df."""
    there = {c.lower() for c in df.columns}
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        yield name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row although body's lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def dedupe_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns alone, so that extra columns of the caller cannot clash with working columns."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def gapless_rank(df: DataFrame, group: str, salt: Column, n_salts: int, order: list[str], out: str = "rank") -> DataFrame:
    """Number the rows of each group 0, 1, ... without putting a group into one task.

    Rows are ranked within (group, salt); the offsets of the salts come from counts, a table of at most
    groups x n_salts rows (groups must be bounded by a parameter), which is broadcast. `df` is read twice: cut it first.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)))
    joined = ranked.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_g", "_s", "_off", "_rn", "_salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternates large-star and small-star contraction; each round ends in a written table. Only minima are
    aggregated, so a node with very many edges costs no more memory than any other.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        # large star: each neighbour above a node is tied to that node's minimum
        large = cut(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low2 = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low2")
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        done = cut(small, "small")
        # a forest of stars: every node has one parent and no parent has a parent
        parents = done.groupBy("a").agg(F.count("*").alias("n"))
        many = parents.where("n > 1").limit(1).count()
        chained = 0 if many else done.select(F.col("b").alias("a")).distinct().join(parents, "a", "left_semi").limit(1).count()
        e = done
        if not many and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _words_of(at: np.ndarray) -> pa.RecordBatch:
    """The words of a bitmap that ascending distinct places set."""
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["w", "m"])
    word, start = np.unique(at >> 6, return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start).view(np.int64))], names=["w", "m"])


def _collected(words: DataFrame, bits: int) -> bytes:
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out.tobytes()


def repeated_bitmap(rows: DataFrame, bits: int) -> bytes:
    """Of rows (h, many), a bitmap of 2**bits places with those h set that come more than once or are many in one row. Its size
    is fixed; with very many such h it only lets more through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            # many in one row: as if it came twice
            held += [h, h[b.column(1).to_numpy(zero_copy_only=False)]]
        if held:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            yield _words_of(np.unique(filter_place(h[1:][h[1:] == h[:-1]], bits)))

    return _collected(rows.repartition("h").mapInArrow(run, "w bigint, m bigint"), bits)


def bitmap_of(ids: DataFrame, bits: int = 24) -> bytes:
    """A bitmap of 2**bits places with those of the ids (the frame's one column) set: its size is fixed; with many more ids it
    only lets more through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _words_of(np.unique(mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64))

    return _collected(ids.mapInArrow(run, "w bigint, m bigint"), bits)
