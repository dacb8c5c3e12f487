"""Operator 5: exact substring removal with a sparse, range-partitioned suffix array.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or same document).

Suffixes are taken at anchors only. Every string of `length` bytes has one: the place, among its grams of GRAM bytes, with
the least hash (leftmost of equals). Equal strings have equal anchors, so it is enough to compare suffixes there.
1. A string holds its anchor's gram and either the bytes behind it or those before it, by half of what the gram leaves
   (38 of 76). Gram and half, the anchor's right or left key, are counted for all anchors (a map task sends each key once,
   so a common one costs a row a task). Keys that repeat go into a bitmap of fixed size, which is broadcast; when it fills
   up it only lets more through.
2. Documents are read again. Anchors with a key that the bitmap lets through have their contexts cut out: the bytes of the
   strings that chose them and hold such a key, at most 2 x length - GRAM. Of equal contexts in a batch only the earliest
   goes on; the others lose all strings at that anchor at once, and no text is shuffled for them.
3. The suffixes at the other anchors are range-partitioned by their leading bytes, by splitters from a sample of documents
   (which only balances the buckets). A bucket is sorted by multikey quicksort, a word of eight bytes at a time on the
   rows still tied; likewise the reversed bytes before the anchors. Neighbours' common prefixes give, for every number of
   bytes before the anchor, the classes of equal strings. Splitters are whole grams, and so are the chunks in
   which a bucket is worked off, so equal strings never lie on two sides of a boundary.
4. All but the earliest of a class lose those bytes; spans are merged per document. Only documents that a bitmap of those
   with spans lets through are shuffled to be joined with them.

Defined cases: a null text is empty; documents under `length` bytes lose nothing; rows that share a doc_id and text are
one document (they do not count as earlier than each other); a null doc_id is before and after none, so it loses nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.bytekit import BYTE, _powers, filter_place, mix, pieces, text_bytes
from boxwright.llm.common import arrow_rows, bitmap_of, cut, dedupe_columns, discard, repeated_bitmap

LENGTH = 100
GRAM = 24
FILTER_BITS = 27  # 16 MB; about 16 places a repeated gram for 8 million of them
SAMPLE = 1000
PIECE = 1 << 18  # bytes whose hashes are held at once
HELD = 1 << 20  # keys of which a task tells the distinct ones
ARROW_ROWS = 1000  # whole texts
GATHERED = 16 << 20  # bytes of the texts of which equal contexts are told
EMITTED = 4000  # contexts cut out at once
CHUNK = 20_000  # suffixes sorted at once, or all of one gram
ROWS = 4096
REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w], for every i that has w values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def _totals(data: np.ndarray) -> np.ndarray:
    """Sums that a hash of any stretch of the bytes is made from."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _powers(len(data))[0][: len(data)], out=total[1:])
    return total


def _stretch(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (total[end] - total[start]) * _powers(len(total))[1][start]


def anchors(data: np.ndarray, offsets: np.ndarray, total: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor of the rows: its place, and the least and greatest distance to the starts that choose it."""
    n, w = len(data), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z
    h = mix((total[gram:] - total[:-gram]) * _powers(n)[1][: n - gram + 1])
    # the hash's high half and the place in the low half: the least is leftmost among equals
    order = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    chosen = (_sliding(order, w, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # starts whose string lies in one row
    ok = np.zeros(len(chosen), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    starts = np.flatnonzero(ok)
    if not len(starts):
        return z, z, z
    at = chosen[starts]
    # starts that choose one anchor are consecutive
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])])
    end = np.r_[new[1:], len(at)] - 1
    place = at[new]
    return place, place - starts[end], place - starts[new]


def anchor_keys(total: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Rows with a right key and the keys, rows with a left key and the keys.

    Strings that start at most half before the anchor all hold its right key, the others its left key.
    """
    half = (length - gram) // 2
    right, left = np.flatnonzero(least <= half), np.flatnonzero(most > half)
    p, q = place[right], place[left]
    return right, mix(_stretch(total, p, p + length - half)), left, mix(_stretch(total, q - half - 1, q + gram) + np.uint64(1))


def _key_rows(length: int, gram: int):
    """Distinct anchor keys, of about HELD at a time, and whether they repeat there."""

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in pieces(offsets, PIECE):
                part = data[offsets[a] : offsets[b]]
                total = _totals(part)
                keys = anchor_keys(total, *anchors(part, offsets[a : b + 1] - offsets[a], total, length, gram), length, gram)[1::2]
                found += keys
                n += sum(map(len, keys))
                if n >= HELD:
                    yield told(found)
                    found, n = [], 0
        if found:
            yield told(found)

    return run


def splitters(read: DataFrame, length: int, gram: int, buckets: int, sample: int = SAMPLE) -> list[bytes]:
    """Leading grams that part the suffixes of at most `sample` documents into as many equal shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in pieces(offsets, PIECE):
                part = data[offsets[a] : offsets[b]]
                place = anchors(part, offsets[a : b + 1] - offsets[a], _totals(part), length, gram)[0][::4]
                yield pa.RecordBatch.from_arrays([pa.array([part[p : p + gram].tobytes() for p in place], pa.binary())], names=["lead"])

    leads = read.select("text").limit(sample).mapInArrow(run, "lead binary").toArrow()
    found = sorted(set(leads.column("lead").to_pylist()))
    return [found[i * len(found) // buckets] for i in range(1, buckets)] if len(found) > buckets else found


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those of one document that touch made one."""
    if not len(doc):
        return doc, s, e
    by = np.lexsort((s, doc))
    doc, s, e = doc[by], s[by], e[by]
    first = np.r_[True, doc[1:] != doc[:-1]]
    shift = (np.cumsum(first) - 1) * (int(e.max()) + 2)  # keeps documents apart on one line
    reach = np.maximum.accumulate(e + shift)
    new = np.flatnonzero(np.r_[True, (s + shift)[1:] > reach[:-1]])
    return doc[new], s[new], (reach - shift)[np.r_[new[1:], len(doc)] - 1]


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `most` bytes, a larger one alone."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _contexts(length: int, gram: int, bits: int, shared, cuts):
    schema = ["bucket", "doc_id", "pos", "least", "most", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, edges = np.frombuffer(shared.value, np.uint8), np.array(cuts.value, f"S{gram}")
        half = (length - gram) // 2

        def again(keys: np.ndarray) -> np.ndarray:
            at = filter_place(keys, bits)
            return ((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

        for batch in _gathered(batches, GATHERED):
            keys = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            got: list[list] = [[], [], [], [], []]
            for a, b in pieces(offsets, PIECE):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                total = _totals(part)
                place, least, most = anchors(part, off, total, length, gram)
                right, right_keys, left, left_keys = anchor_keys(total, place, least, most, length, gram)
                on_right, on_left = np.zeros((2, len(place)), bool)
                on_right[right], on_left[left] = again(right_keys), again(left_keys)
                # starts whose key comes once have no equal
                most = np.where(on_left, most, np.minimum(most, half))
                least = np.where(on_right, least, np.maximum(least, half + 1))
                through = np.flatnonzero(on_right | on_left)
                place, least, most = place[through], least[through], most[through]
                same = mix(_stretch(total, place - most, place + length - least)) + (most * length + least).astype(np.uint64)
                for column, value in zip(got, (place + offsets[a], a + np.searchsorted(off, place, side="right") - 1, least, most, same), strict=True):
                    column.append(value)
            if not got[0] or not sum(map(len, got[0])):
                continue
            place, row, least, most, same = (np.concatenate(x) for x in got)
            doc, pos = keys[row], place - offsets[row]
            # of equal contexts the earliest stands for all of the batch
            by = np.lexsort((pos, doc, same))
            first = np.r_[True, same[by][1:] != same[by][:-1]]
            lead = by[first][np.cumsum(first) - 1]
            later = by[(doc[lead] != doc[by]) | (pos[lead] != pos[by])]
            d, s, e = _merged(doc[later], (pos - most)[later], (pos - least + length)[later])
            yield pa.RecordBatch.from_arrays([pa.array((d * 7919 % (len(edges) + 1)).astype(np.int32)), pa.array(d), pa.array(s.astype(np.int64)), pa.array(np.full(len(d), -1, np.int32)), pa.array((e - s).astype(np.int32)), pa.nulls(len(d), pa.binary())], names=schema)
            keep = by[first]
            for k in range(0, len(keep), EMITTED):
                of = keep[k : k + EMITTED]
                size = most[of] + length - least[of]
                edge = np.r_[0, np.cumsum(size)]
                index = np.repeat(place[of] - most[of] - edge[:-1], size) + np.arange(edge[-1])
                grams = data[place[of][:, None] + np.arange(gram)]
                bucket = np.searchsorted(edges, np.ascontiguousarray(grams).view(f"S{gram}").ravel(), side="right")
                body = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(doc[of]), pa.array(pos[of].astype(np.int64)), pa.array(least[of].astype(np.int32)), pa.array(most[of].astype(np.int32)), body], names=schema)

    return run


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (uint8, width a multiple of 8) and the common prefix of each with the row before it.

    Sorts by eight bytes at a time; only rows that are still tied with a neighbour take part in the next pass.
    """
    n, width = rows.shape
    word = rows.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)
    for k in range(width // 8):
        if not len(live):
            break
        ids, key = order[live], word[order[live], k]
        again = np.lexsort((key, group[live]))
        order[live] = ids[again]
        key, g = key[again], group[live]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        tied = ~new | np.r_[~new[1:], False]
        live = live[tied]
    common = np.zeros(n, np.int64)
    for k in range(1, n, ROWS):
        at = order[k - 1 : k + ROWS]
        same = rows[at[1:]] == rows[at[:-1]]
        common[k : k + ROWS] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, common


def _sides(table: pa.Table, most: np.ndarray, wide: int, narrow: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from the anchor on, and those before it backwards, as rows padded with zeros."""
    data, offsets = text_bytes(table.column("context"))
    anchor, j, k = offsets[:-1] + most, np.arange(wide)[None, :], np.arange(narrow)[None, :]
    n, top = len(anchor), len(data) - 1
    right, left = np.zeros((n, wide), np.uint8), np.zeros((n, narrow), np.uint8)
    for at in range(0, n, ROWS):
        some = slice(at, at + ROWS)
        start, end, mid = offsets[:-1][some, None], offsets[1:][some, None], anchor[some, None]
        after, before = mid + j, mid - 1 - k
        right[some] = np.where(after < end, data[np.minimum(after, top)], 0)
        left[some] = np.where(before >= start, data[np.maximum(before, 0)], 0)
    return right, left


def _later(length: int, gram: int):
    """Spans, of one range of suffixes, whose string also starts earlier."""
    wide, narrow = -(-length // 8) * 8, -(-(length - gram) // 8) * 8

    def chunk(table: pa.Table):
        keys, pos, least, most = (table.column(c).to_numpy() for c in ("doc_id", "pos", "least", "most"))
        by = np.lexsort((pos, keys))
        table, keys, pos, least, most = table.take(pa.array(by)), keys[by], pos[by], least[by], most[by]
        n = len(keys)
        place = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]) | (pos[1:] != pos[:-1])]) - 1  # the same place twice is one
        after, before = _sides(table, most, wide, narrow)
        right, common_r = multikey_sort(after)
        left, common_l = multikey_sort(before)
        first, last = np.full(n, -1), np.full(n, -1)
        docs, starts, ends = [], [], []
        rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
        for o in range(length - gram, -1, -1):
            rows = np.flatnonzero((least <= o) & (o <= most))
            if len(rows) < 2:
                gone = np.zeros(0, np.int64)
            else:
                rank_r[right] = np.cumsum(common_r < length - o)
                rank_l[left] = np.cumsum(common_l < o) if o else 0
                _, lead, back = np.unique(rank_r[rows] * (n + 1) + rank_l[rows], return_index=True, return_inverse=True)
                gone = rows[place[rows] > place[rows[lead[back]]]]
            # runs of consecutive starts become one span
            fresh = gone[last[gone] != o + 1]
            closing = fresh[first[fresh] >= 0]
            docs.append(keys[closing])
            starts.append(pos[closing] - first[closing])
            ends.append(pos[closing] - last[closing] + length)
            first[fresh] = o
            last[gone] = o
        open_ = np.flatnonzero(first >= 0)
        docs.append(keys[open_])
        starts.append(pos[open_] - first[open_])
        ends.append(pos[open_] - last[open_] + length)
        spans = _merged(*(np.concatenate(x).astype(np.int64) for x in (docs, starts, ends)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["doc_id", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of the leading gram: whole grams are worked off as soon as enough rows are there
        held, size, most = [], 0, CHUNK
        for batch in batches:
            table = pa.Table.from_batches([batch])
            done = table.filter(pc.equal(table.column("least"), -1))
            if len(done):
                s = done.column("pos").to_numpy()
                yield pa.RecordBatch.from_arrays([done.column("doc_id").combine_chunks(), pa.array(s), pa.array(s + done.column("most").to_numpy())], names=["doc_id", "s", "e"])
            table = table.filter(pc.not_equal(table.column("least"), -1))
            held.append(table)
            size += len(table)
            if size > most:
                table = pa.concat_tables(held).combine_chunks()
                lead = table.column("lead")
                tail = lead[len(lead) - 1].as_py()
                k = len(lead) - 1
                while k > 0 and lead[k - 1].as_py() == tail:
                    k -= 1
                if k:
                    yield chunk(table.slice(0, k))
                held, size = [table.slice(k)], len(table) - k
                most = max(CHUNK, 2 * size)  # of a common gram, not looked through anew with every batch
        if size:
            yield chunk(pa.concat_tables(held).combine_chunks())

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        data, offsets = text_bytes(batch.column(1))
        keys = batch.column(0).to_pylist()
        spans = batch.column(2)
        for i in range(batch.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            removed = spans_n = 0
            gone = spans[i].as_py()
            if gone:
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in gone):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                removed, spans_n = sum(e - s for s, e in merged), len(merged)
                edge = [0, *(x for span in merged for x in span), len(body)]
                body = b"".join(body[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True))
            kept = hashlib.sha256(body).hexdigest()
            for column, value in zip(rows, (keys[i], int(offsets[i + 1] - offsets[i]), removed, spans_n, kept), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _of(ids, wanted: bool):
    """Rows of documents that the bitmap of ids lets through, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(ids.value, np.uint8)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = mix(batch.column(0).fill_null(0).to_numpy().view(np.uint64)) & np.uint64(8 * len(seen) - 1)
            there = known & (((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) == 1)
            yield batch.filter(pa.array(there == wanted))

    return run


def _uncut(ids):
    """The report of the documents that the bitmap of ids does not let through; they lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (b.append_column("spans", pa.nulls(b.num_rows)) for b in _of(ids, False)(batches))
        return _cut_out(rest)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_bits: int = FILTER_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans: array of s, e): the byte spans to remove, unmerged, of the documents that have any."""
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    read = read.where("doc_id is not null")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated_bitmap(read.select("text").mapInArrow(_key_rows(length, gram), "h bigint, many boolean"), filter_bits))
    buckets = min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = spark.sparkContext.broadcast(splitters(read, length, gram, buckets))
    schema = "bucket int, doc_id bigint, pos bigint, least int, most int, context binary"
    found = read.mapInArrow(_contexts(length, gram, filter_bits, shared, cuts), schema).repartition("bucket")
    lead = F.when(F.col("least") >= 0, F.expr(f"substring(context, most + 1, {gram})"))
    spans = found.withColumn("lead", lead).sortWithinPartitions("lead").mapInArrow(_later(length, gram), "doc_id bigint, s bigint, e bigint")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    read = dedupe_columns(docs, [key, text]).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # batches of whole texts are held several times over by the JVM and by Python
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        spans = cut(repeated_spans(docs, length, gram, key=key, text=text), "spans")
        touched = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans.select("doc_id"), FILTER_BITS))
        # one plan at every size: spans grow with the corpus, so they are never broadcast
        joined = read.mapInArrow(_of(touched, True), read.schema).join(spans.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans")
        out = cut(joined.mapInArrow(_cut_out, REPORT).unionByName(read.mapInArrow(_uncut(touched), REPORT)), "cut-out")
    touched.destroy()
    discard(spans)
    return out
