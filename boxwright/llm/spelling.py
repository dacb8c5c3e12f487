"""Operator 11: spelling variants by pairless wildcard groups.

Two words are near if one insertion, deletion or replacement of a code point makes them equal. Each word goes into one group per
position under its text with that position blanked: words of such a group are near by replacement. Each word also goes,
with each code point taken out, to the group of what is left, where a word of the vocabulary that is just that joins it: those are near
by insertion and deletion. A group keeps its size and its two words of largest count, so each member learns from the group alone how many
near words it has there and which is the best; no pair of words is made. Two words meet in one group only, so sums over a word's
groups are exact.

A group of words that differ at one place has at most as many members as the alphabet has letters, and a group of longer words
at most that many times the places, so no key is hot, however often its words occur. Occurrences are counted by map-side
aggregation.

Words of over LONG letters would take the square of their length in keys. Their keys are rolling hashes of 127 bits, and in the groups they stand
as their first letters and their place in order, which sorts as the words do.

Defined cases: a null text has no words; a null key is written as nothing before the colon; very long texts are split inside the JVM; repeated rows
count again; an empty table gives no words; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.common import cut

LETTERS = "a-z\\u00C0-\\u00FF"  # after A-Z are lowered
MIN_CHARS = 7
MIN_COUNT = 2
DELETE_EVERY = 31
RATIO = 10
BLANK = "*"  # no letter
LONG = 64
#: Of the rolling hash: a prime, and a number below it.
PRIME, TURN = 2**127 - 1, 0x5DEECE66D_1F83D9ABFB41BD6B
ROWS = "word string, n bigint, k string, itself boolean"


def words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the vocabulary after the deletions, words of at least min_chars that occur min_count times or more."""
    lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a deletion makes a run no longer, so shorter runs are never words
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, _without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    return each.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars))


def _without(word: Column, at: Column, instead: str = "") -> Column:
    """word with its code point `at` (from 0) taken out, or replaced."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(instead), F.substring(word, at + 2, F.char_length(word)))


def long_keys(word: str) -> tuple[str, list[str], set[str]]:
    """The keys of a long word: of itself, with each letter blanked, and with each letter taken out."""
    head, tail, power = [0], [0], [1]  # hashes of the first and the last k letters
    for c in word:
        head.append((head[-1] * TURN + ord(c)) % PRIME)
        power.append(power[-1] * TURN % PRIME)
    for k, c in enumerate(reversed(word)):
        tail.append((ord(c) * power[k] + tail[-1]) % PRIME)
    size = len(word)
    name = lambda mark, n, h: f"{mark}#{n}:{h:x}"
    blanked = [name(BLANK, size, (head[i] * power[size - i] + ord(BLANK) * power[size - i - 1] + tail[size - i - 1]) % PRIME) for i in range(size)]
    if size - 1 <= LONG:
        return name("", size, head[-1]), blanked, {word[:i] + word[i + 1 :] for i in range(size)}
    return name("", size, head[-1]), blanked, {name("", size - 1, (head[i] * power[size - i - 1] + tail[size - i - 1]) % PRIME) for i in range(size)}


def _long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word, short, n in zip(*(c.to_pylist() for c in batch.columns)):
            own, blanked, less = long_keys(word)
            keys = [own, *blanked, *sorted(less)]
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([short] * len(part)), pa.array([n] * len(part), pa.int64()), pa.array(part), pa.array([k == own for k in part])], names=["word", "n", "k", "itself"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f"{part:08}:{k:012}" for k in range(place, place + batch.num_rows)], pa.string())], names=["word", "n", "place"])
        place += batch.num_rows


def near_words(vocabulary: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, best, best_n): the number of near words, and the one of largest n (the first in code-point order at ties)."""
    size = F.char_length("word")
    ranged = vocabulary.where(size > LONG).select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_in_order, "word string, n bigint, place string")
    long = cut(ranged.select("word", F.concat(F.substring("word", 1, LONG), F.lit(":"), F.col("place")).alias("short"), "n"), "long")
    at = F.sequence(F.lit(0), size - 1)
    blanked = F.transform(at, lambda i: _without(F.col("word"), i, BLANK))
    shorter = F.when(size > min_chars, F.array_distinct(F.transform(at, lambda i: _without(F.col("word"), i)))).otherwise(F.array())
    # a group's key with a blank says place, prefix and suffix; a key without is a word or what a deletion leaves
    keys = F.concat(F.array("word"), blanked, shorter)
    rows = vocabulary.where(size <= LONG).select("word", "n", F.explode(keys).alias("k")).withColumn("itself", F.col("k") == F.col("word"))
    near = _best(rows.unionByName(long.mapInArrow(_long_rows, ROWS)))
    named = lambda df, c: df.join(long.select(F.col("short").alias(c), F.col("word").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
    return named(named(near, "word"), "best").select("word", "n", "n_near", "best", "best_n")


def _best(rows: DataFrame) -> DataFrame:
    """What each word learns from its groups: rows (word, n, k, itself), a row per word and key."""
    top = Window.partitionBy("k").orderBy(F.desc("itself"), F.desc("n"), "word")
    whole = top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("word", "n", "itself")
    seen = rows.select(
        "word", "n", "k", "itself",
        F.count("*").over(Window.partitionBy("k")).alias("size"),
        F.row_number().over(top).alias("place"),
        F.first(entry).over(whole).alias("first"),
        F.nth_value(entry, 2).over(whole).alias("second"),
    )
    blank = F.contains("k", F.lit(BLANK))
    mates = F.when(blank | F.col("itself"), F.col("size") - 1).when(F.col("first.itself"), 1).otherwise(0)
    best = F.when(blank, F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first"))).when(F.col("itself"), F.col("second")).otherwise(F.col("first"))
    told = seen.select("word", "n", "itself", mates.alias("mates"), best.alias("best")).where("itself or mates > 0")
    order = F.when(F.col("mates") > 0, F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word")))
    return told.groupBy("word", "n").agg(F.sum("mates").alias("n_near"), F.min(order).alias("b")).select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the forms followed to the last. Each round doubles the way gone; a form's count is at
    least RATIO times its word's, so the longest way has a step per decimal place of the counts."""
    way = links.select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = cut(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not way.where("moved").limit(1).count():
            return way.select("word", "root")
        way = way.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    near = near_words(cut(words(docs, min_chars, min_count, key, text), "words"), min_chars)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = cut(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
