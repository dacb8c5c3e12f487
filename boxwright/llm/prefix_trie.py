"""Operator 12: the prefix trie of conversations by partition refinement.

All conversations start in one class, the root's. A turn at a time, each class is split by its members' next turns: a part is a
node. A part of one member is retired at once; its remaining turns are a chain of single children, written without being looked at. Parts of
two or more go on. At last the classes are folded back, the deepest first, into children, leaves and saved tokens.

Classes of more than `small` members are split by jobs over all executors (aggregation by class and turn, then a join that
gives the members their new class); each such round takes one turn. Smaller ones are dealt to tasks by class and refined there for up to `stride`
turns at once, in one pass over their rows in order of place, so a class is never more than small x stride rows of 60
bytes; what is still shared behind that goes through another pass. Both ways give the same nodes (tested). A node is named by its depth and its
smallest member, as the classes of one depth have no member in common.

Texts do not travel: a turn is the SHA-256 of its role and text, and its text's size. Turns are numbered by ranges of
(conversation, turn) and the counts before each range, so that a conversation that holds much of the table is no single task. The hash of the
members that end at a node is made from runs of ids in order, written by range, so that only runs of ids meet in the node's task.

Defined cases: turns of one conversation with the same number go by role, then by digest; null roles and texts are empty, null numbers come first;
rows of a null conv_id are in no conversation; repeated rows are turns of their own; the conversation before a negative one, c - c % 5, takes
the remainder as not negative; an empty table has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.common import cut

HEAD = 8
FAMILY = 5
SMALL, STRIDE = 256, 64
RUN = 2048
NODE = "depth bigint, id bigint, parent bigint, n bigint, bytes bigint"
FOLDED = "depth bigint, id bigint, parent bigint, n bigint, n_children bigint, n_leaves bigint, saved bigint"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, dig, bytes): the turns of each conversation, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("dig"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["conv", "turn", "role", "dig"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "dig", "bytes")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for conv in batch.column(0).to_pylist():
                last, place = conv, place + 1 if conv == last else 1
                at.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int64())], names=["conv", "dig", "bytes", "place", "part"])

    placed = cut(ranged.mapInArrow(places, "conv bigint, dig binary, bytes bigint, place bigint, part bigint"), "turns")
    # a conversation in several ranges crosses their border, and a border is crossed by one conversation: at most two rows a range
    whole = Window.partitionBy("conv")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("conv", "part").agg(F.max("place").alias("n")).withColumn("before", before).where("before > 0").select("conv", "part", "before")
    return placed.join(F.broadcast(counts), ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "dig", "bytes")


def rebuilt(own: DataFrame, head: int = HEAD, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, dig, bytes) and lengths (conv, len) of the rebuilt conversations: the first h turns of conversation
    c - c % family, then c's own behind its first h, where h = crc32(c) % (head + 1)."""
    opening = F.collect_list(F.when(F.col("pos") <= head, F.struct("pos", "dig", "bytes")))  # of at most `head` turns
    convs = cut(own.groupBy("conv").agg(F.max("pos").alias("own_len"), F.sort_array(opening).alias("head")), "heads")
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (head + 1)).cast("int")
    first = convs.select(F.col("conv").alias("host"), F.col("head").alias("host_head"))
    mine = convs.select("conv", "own_len", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("host"))
    plan = mine.join(first, "host", "left").withColumn("taken", F.when(F.col("h") > 0, F.slice(F.coalesce("host_head", F.array()), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array()))
    plan = cut(plan.select("conv", "h", "taken", F.size("taken").alias("k"), (F.size("taken") + F.greatest(F.col("own_len") - F.col("h"), F.lit(0))).alias("len")), "plan")
    theirs = plan.select("conv", F.posexplode("taken").alias("i", "t")).select("conv", (F.col("i") + 1).cast("bigint").alias("pos"), "t.dig", "t.bytes")
    rest = own.join(plan.select("conv", "h", "k"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "dig", "bytes")
    # rounds ask for one place each: files in its order are passed over
    turns = cut(theirs.unionByName(rest).repartitionByRange("pos", "conv").sortWithinPartitions("pos"), "rebuilt")
    return turns, plan.select("conv", F.col("len").cast("bigint").alias("len"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _refine(rows: Iterator[tuple], stride: int) -> Iterator[tuple]:
    """rows (cls, depth, pos, conv, len, dig, bytes) in order of (cls, pos, conv) -> (kind, cls, depth, id, parent, n, bytes, conv, len).
    Kinds: node; tail, a node of one member that is retired; end, a member that ends at a node; go, a member still shared at the stride's end."""
    for cls, mine in groupby(rows, lambda r: r[0]):
        of: dict[int, int] | None = None
        for pos, here in groupby(mine, lambda r: r[2]):
            parts: dict[tuple[int, bytes], list[tuple]] = defaultdict(list)
            for row in here:
                at = cls if of is None else of.get(row[3])
                if at is not None:
                    parts[at, row[5]].append(row)
            of = {}
            for (parent, _), members in parts.items():
                i, n = members[0][3], len(members)
                yield ("node" if n > 1 else "tail", cls, pos, i, parent, n, members[0][6], i, members[0][4])
                if n > 1:
                    for _, depth, _, conv, length, _, _ in members:
                        if length == pos:
                            yield ("end", cls, pos, i, None, None, None, conv, length)
                        elif pos == depth + stride:
                            yield ("go", cls, pos, i, None, None, None, conv, length)
                        else:
                            of[conv] = i


REFINED = "kind string, cls bigint, depth bigint, id bigint, parent bigint, n bigint, bytes bigint, conv bigint, len bigint"


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows (cls, depth, id, parent, n, bytes, c, l, s), the deepest of a class first, where c, l, s are children, leaves and saved tokens below
    a node that a later pass went on with -> folded nodes of two or more members, and for the class itself one with no n."""
    for cls, mine in groupby(rows, lambda r: r[0]):
        below: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        top = None
        for _, depth, i, parent, n, size, c, leaves, saved in mine:
            if top is None or depth < top:
                below = defaultdict(lambda: [0, 0, 0], {k: v for k, v in below.items() if k[0] == depth})
                top = depth
            c, leaves, saved = (c, leaves, saved) if c is not None else below.get((depth, i), (0, 1, 0))
            saved += (n - 1) * size
            if n > 1:
                yield (depth, i, parent, n, c, leaves, saved)
            up = below[depth - 1, parent]
            up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
        c, leaves, saved = below[top - 1, cls]
        yield (top - 1, cls, None, None, c, leaves, saved)


def _ends_sha(ends: DataFrame) -> DataFrame:
    """(depth, id, ends): SHA-256 of the ids (conv) that end at a node, in numerical order and joined by commas."""
    order, runs, made = ["depth", "id", "conv"], "depth bigint, id bigint, conv bigint, text string", "depth bigint, id bigint, ends string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (depth, i), mine in groupby(_rows(batches), lambda r: r[:2]):
                held: list[int] = []
                for _, _, conv in mine:
                    held.append(conv)
                    if len(held) == RUN:
                        yield (depth, i, held[0], ",".join(map(str, held)))
                        held = []
                if held:
                    yield (depth, i, held[0], ",".join(map(str, held)))

        return _batches(each(), _arrow(runs), 1000)

    def sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (depth, i), mine in groupby(_rows(batches), lambda r: r[:2]):
                digest = hashlib.sha256()
                for k, (_, _, _, text) in enumerate(mine):
                    digest.update(("," if k else "").encode() + text.encode())
                yield (depth, i, digest.hexdigest())

        return _batches(each(), _arrow(made))

    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, runs)
    return pieces.repartition("depth", "id").sortWithinPartitions("depth", "id", "conv").mapInArrow(sha, made)


def _folded(kids: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes (depth, id, parent, n, bytes) with what lies below those of them that were split on."""
    own = kids.join(below.withColumnRenamed("n_leaves", "l").withColumnRenamed("saved", "s"), ["depth", "id"], "left")
    return own.select("depth", "id", "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("s", F.lit(0))).alias("saved"))


def _below(folded: DataFrame) -> DataFrame:
    """What lies below each parent of the nodes."""
    return folded.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def trie(turns: DataFrame, lengths: DataFrame, small: int = SMALL, stride: int = STRIDE) -> DataFrame:
    """The nodes of the trie of conversations: turns (conv, pos from 1, dig, bytes), lengths (conv, len), both read several times."""
    spark = turns.sparkSession
    n, top = lengths.agg(F.count("*"), F.min("conv")).first()
    root = spark.createDataFrame([(0, top, None, n, 0)] if n else [], NODE)
    active = lengths.select("conv", F.lit(top).cast("bigint").alias("cls"), F.lit(0).cast("bigint").alias("depth"), "len")
    ends, tails, rounds, waiting = [], [], [], []
    # classes of many members: one turn a round, over all executors
    depth, large = 0, n > small
    waiting += [] if large else [active]
    while large:
        ends.append(active.where("len = depth").select("depth", F.col("cls").alias("id"), "conv"))
        here = cut(active.where("len > depth").join(turns.where(F.col("pos") == depth + 1).drop("pos"), "conv"), "round")
        kids = cut(here.groupBy(F.col("cls").alias("parent"), "dig").agg(F.min("conv").alias("id"), F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.min("len").alias("len")), "kids")
        depth += 1
        rounds.append(kids.select(F.lit(depth).cast("bigint").alias("depth"), "id", "parent", "n", "bytes"))
        tails.append(kids.where("n = 1").select(F.col("id").alias("conv"), F.lit(depth).cast("bigint").alias("depth"), "parent", "len"))
        moved = here.join(kids.where("n > 1").select(F.col("parent").alias("cls"), "dig", "id", "n"), ["cls", "dig"])
        moved = cut(moved.select("conv", F.col("id").alias("cls"), F.lit(depth).cast("bigint").alias("depth"), "len", "n"), "moved")
        active = moved.where(F.col("n") > small).drop("n")
        waiting.append(moved.where(F.col("n") <= small).drop("n"))
        large = bool(kids.where(F.col("n") > small).limit(1).count())
    # the others: by class in tasks, up to stride turns a pass
    passes, start = [], _union(waiting)
    ends.append(start.where("len = depth").select("depth", F.col("cls").alias("id"), "conv"))
    while start.limit(1).count():
        rows = start.where("len > depth").join(turns, "conv").where(f"pos > depth and pos <= depth + {stride}").select("cls", "depth", "pos", "conv", "len", "dig", "bytes")
        run = lambda batches: _batches(_refine(_rows(batches), stride), _arrow(REFINED))
        done = cut(rows.repartition("cls").sortWithinPartitions("cls", "pos", "conv").mapInArrow(run, REFINED), "pass")
        passes.append(done)
        ends.append(done.where("kind = 'end'").select("depth", "id", "conv"))
        tails.append(done.where("kind = 'tail'").select("conv", "depth", "parent", "len"))
        start = done.where("kind = 'go'").select("conv", F.col("id").alias("cls"), "depth", "len")
    # back: the passes, the last first, then the rounds
    nodes, below = [], None
    none = spark.createDataFrame([], "depth bigint, id bigint, n_children bigint, n_leaves bigint, saved bigint")
    for done in reversed(passes):
        kids = done.where("kind in ('node', 'tail')").select("cls", "depth", "id", "parent", "n", "bytes")
        kids = kids.join(none if below is None else below, ["depth", "id"], "left").select("cls", "depth", "id", "parent", "n", "bytes", "n_children", "n_leaves", "saved")
        up = lambda batches: _batches(_fold(_rows(batches)), _arrow(FOLDED))
        folded = cut(kids.repartition("cls").sortWithinPartitions("cls", F.desc("depth")).mapInArrow(up, FOLDED), "folded")
        nodes.append(folded.where("n is not null"))
        below = folded.where("n is null").select(none.columns)
    small_below, below = none if below is None else below, none
    for kids in reversed(rounds):
        folded = cut(_folded(kids, below.unionByName(small_below)), "folded")
        nodes.append(folded.where("n > 1"))
        below = _below(folded)
    nodes.append(_folded(root, below.unionByName(small_below)))
    shared = _union(nodes).join(_ends_sha(_union(ends)), ["depth", "id"], "left").select(
        F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )
    if not tails:
        return shared
    chain = _union(tails).select("conv", F.col("depth").alias("from"), "parent", "len", F.explode(F.sequence("depth", "len")).alias("depth"))
    last: Column = F.col("depth") == F.col("len")
    alone = chain.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    return shared.unionByName(alone)


def conversation_trie(conversations: DataFrame, small: int = SMALL, stride: int = STRIDE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations' trie."""
    return trie(*rebuilt(cut(numbered(conversations), "own")), small, stride)
