"""The ordered walks that greedy operators share.

Suppression gathers the rows of a group as an array of structs that sorts by its leading fields, and an aggregate walks it
with the accepted ones as state. It costs the square of a group's size in the worst case; groups are boxes of one image and
class. One-to-one matching has many more rows a group (pairs of boxes), but what it asks of its state is only whether a box
is taken: `one_to_one` walks sorted partitions in Arrow batches with two sets a group, which is linear at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def ordered(df: DataFrame, keys: list[str], fields: list[Column], out: str = "items") -> DataFrame:
    """One row per group: its rows as structs, sorted by the fields in order.

    The fold costs far more time a byte than other stages, so the shuffle has a fixed number of partitions: sized by bytes,
    as adaptive execution does, a few tasks would do all the work. groupBy uses the same partitioning again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def fold(items: Column, state: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, state, step)


def none_of(items: Column) -> Column:
    """An empty array of the items' type."""
    return F.slice(items, 1, 0)


def accept_if_free(items: Column, clashes: Callable[[Column, Column], Column]) -> Column:
    """The items, in order, that clash with none accepted before."""
    step = lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    return fold(items, none_of(items), step)


def _plain(column: pa.Array) -> list[pa.Array]:
    """A column of keys as columns without fields."""
    return [c for f in column.flatten() for c in _plain(f)] + [column.is_null()] if pa.types.is_struct(column.type) else [column]


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """For each row but the first, whether a key differs from the row's before; nulls are equal."""
    found = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        apart = pc.fill_null(pc.not_equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False)
        void = k.is_null().to_numpy(zero_copy_only=False)
        found |= apart | (void[1:] != void[:-1])
    return found


def one_to_one(edges: DataFrame, group: list[str], order: list[Column], left: str, right: str) -> DataFrame:
    """The edges that a walk in order within each group takes: those whose two ends are both free. `order` must end in
    something unique. A task holds the taken ends of one group."""
    *keys_at, left_at, right_at = (edges.columns.index(c) for c in (*group, left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, lefts, rights = None, set(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c for i in keys_at for c in _plain(batch.column(i))]
            if tuple(k[0].as_py() for k in keys) != before:
                lefts, rights = set(), set()
            before, keep = tuple(k[-1].as_py() for k in keys), []
            starts = [0, *(np.flatnonzero(_changes(keys)) + 1).tolist(), batch.num_rows]
            p, t = batch.column(left_at).to_pylist(), batch.column(right_at).to_pylist()
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if start:
                    lefts, rights = set(), set()
                for i in range(start, end):
                    if p[i] not in lefts and t[i] not in rights:
                        lefts.add(p[i])
                        rights.add(t[i])
                        keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    # a fixed number of partitions: rows are small beside the time a walk takes
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(n, *group).sortWithinPartitions(*group, *order).mapInArrow(run, edges.schema)
