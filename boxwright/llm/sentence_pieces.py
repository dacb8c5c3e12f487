"""Operator 13: encoding and decoding with a SentencePiece vocabulary of the merge (BPE) type.

The symbols of a text are its characters. An agenda holds the adjacent pairs that join to a piece of the vocabulary; the
pair of highest score, the leftmost at ties, is joined and brings its new neighbours onto the agenda, until none is left.
Symbols that are no piece become their UTF-8 bytes' pieces. The model file is read on the driver (its size is the
vocabulary's) and travels with the tasks; the texts go through Arrow batches, each row for itself, without a shuffle.

A pair is joined only inside a piece, so a text falls into units that no piece crosses: a run of spaces with the word behind it,
and characters that are in no longer piece. Units repeat, so a worker remembers the ids of short ones, up to a bound.
Short units of a batch that are new are merged together, their agendas the rows of one array; a longer one has a heap.

Taken are models that leave characters as they are (identity normalisation, spaces escaped, no user-defined symbols); others are refused.

Defined cases: a null text is empty; an empty text is the end id alone; null ids stay null and so do their texts; a very long text is
cut into units as any other and a very long unit has one agenda; repeated rows are encoded each for itself; extra columns are kept.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Types of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: Units of at most this many characters are remembered, and so many of them in each of two generations.
SHORT, REMEMBERED = 32, 500_000
#: Short units encoded together, and rows a batch.
TOGETHER, ROWS = 4096, 128
NONE = np.iinfo(np.int32).max
#: Places of the table of pairs, as a power of two.
SLOTS = 19


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError(f"unknown wire type {tag & 7}")


def _one_per_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("boxwright-per-byte", _one_per_byte)


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, model: bytes) -> None:
        pieces, trainer, norm = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        kind = [p.get(3, NORMAL) for p in pieces]
        self.text = [p[1].decode("utf-8") for p in pieces]
        if trainer.get(3, 1) != MERGES:
            raise ValueError("not a vocabulary of merges")
        if norm.get(2) or not norm.get(5, 1) or norm.get(4, 1) or trainer.get(24, 0):
            raise ValueError("the model rewrites its texts, which is not supported")
        if USER in kind or UNUSED in kind:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.get(3, 1) else ""
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kind)) if k == NORMAL}
        self.score = {t: pieces[i].get(2, 0.0) for t, i in self.id.items()}
        self.unknown, self.end = kind.index(UNKNOWN), self.text.index(trainer.get(47, b"</s>").decode())
        self.byte_id = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, kind)) if k == BYTE} if trainer.get(35) else {}
        surface = trainer.get(44, " ⁇ ".encode())
        own = {NORMAL: lambda i: self.text[i].replace(SPACE, " ").encode(), BYTE: lambda i: bytes([int(self.text[i][1:-1], 16)]), UNKNOWN: lambda i: surface, CONTROL: lambda i: b""}
        self.bytes = [own[k](i) for i, k in enumerate(kind)]
        self.opens_with_space = [k == NORMAL and t.startswith(SPACE) for t, k in zip(self.text, kind)]
        self.silent = np.array([k == CONTROL for k in kind])
        self.units = self._unit_pattern()
        self._pair_table(pieces)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair_table(self, pieces: list[dict]) -> None:
        """Numbers for all symbols (pieces by id, then single characters of pieces that are none themselves), and for each pair of
        symbols that joins to a piece its place in the order of scores."""
        number = dict(self.id)
        for c in sorted(set("".join(self.id)) - set(number)):
            number[c] = len(self.text) + len(number) - len(self.id)
        self.number, self.base = number, len(self.text) + len(number)
        order = {v: k for k, v in enumerate(sorted({-v for v in self.score.values()}))}
        rows = sorted((number[t[:i]] * self.base + number[t[i:]], order[-self.score[t]], number[t]) for t in self.id for i in range(1, len(t)) if t[:i] in number and t[i:] in number)
        pair, rank, made = (np.array(c, k) for c, k in zip(zip(*rows, (2**62, NONE, 0)), (np.int64, np.int32, np.int32)))
        self._deal(pair, rank, made)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k

    def _deal(self, pair: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Pairs by two hashes: the first of a place in the first table, the others in the second by value, so a look-up is two reads for nearly all."""
        place = self._place(pair)
        _, first = np.unique(place, return_index=True)
        self.table = np.full(1 << SLOTS, -1, np.int64)
        self.table_rank, self.table_made = np.full(1 << SLOTS, NONE, np.int32), np.zeros(1 << SLOTS, np.int32)
        self.table[place[first]], self.table_rank[place[first]], self.table_made[place[first]] = pair[first], rank[first], made[first]
        rest = np.setdiff1d(np.arange(len(pair)), first)
        self.crowded = np.zeros(1 << SLOTS, bool)
        self.crowded[place[rest]] = True
        self.pair, self.rank, self.made = np.append(pair[rest], 2**62), np.append(rank[rest], NONE), np.append(made[rest], 0)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols, the place in the order of scores (NONE, if they join to no piece) and what they join to."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -2)
        place = self._place(key)
        there = self.table[place] == key
        rank, made = np.where(there, self.table_rank[place], np.int32(NONE)), self.table_made[place]
        again = np.flatnonzero(self.crowded[place] & ~there)
        if len(again):
            at = np.searchsorted(self.pair, key[again])
            found = self.pair[at] == key[again]
            rank[again[found]], made[again[found]] = self.rank[at[found]], self.made[at[found]]
        return rank, made

    def _unit_pattern(self) -> re.Pattern:
        """Matches one unit after the other. Where pieces hold spaces behind other characters, the whole text is one."""
        longer = [t for t in self.id if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in longer):
            return re.compile(r"(?s).+")
        joined = "".join(re.escape(c) for c in sorted(set("".join(longer)) - {SPACE}))
        return re.compile(f"(?s){SPACE}*[{joined}]+|{SPACE}+|." if joined else f"(?s){SPACE}+|.")

    def _merge(self, unit: str) -> list[str]:
        """The symbols left when no adjacent pair joins to a piece."""
        symbol, score, last = list(unit), self.score, len(unit) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda = [(-score[joined], k, k + 1, joined) for k, joined in enumerate(map(add, symbol, symbol[1:])) if joined in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if not symbol[left] or not symbol[right] or len(symbol[left]) + len(symbol[right]) != len(joined):
                continue  # one of the two has since been joined with another
            symbol[left], symbol[right] = joined, ""
            after[left] = behind = after[right]
            if behind <= last:
                before[behind] = left
                wider = joined + symbol[behind]
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], left, behind, wider))
            ahead = before[left]
            if ahead >= 0:
                wider = symbol[ahead] + joined
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], ahead, left, wider))
        return [s for s in symbol if s]

    def _merge_all(self, units: list[str]) -> list[bytes]:
        """The ids of many short units at once: a row of places in the order of scores is a unit's agenda, and each round takes the best pair (the
        first of equals) from every row."""
        size = np.array(list(map(len, units)))
        width, place = int(size.max()), np.arange(int(size.max()))
        symbol = np.full((len(units), width), -1, np.int32)
        symbol[place < size[:, None]] = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        rank = np.full((len(units), width), NONE, np.int32)
        rank[:, :-1] = self._ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())[0].reshape(len(units), width - 1)
        left, done, none = np.arange(len(units)), [b""] * len(units), np.int32(NONE)
        while True:
            k = rank.argmin(axis=1)
            more = rank[np.arange(len(left)), k] < NONE
            if not more.all():
                over = symbol[~more]
                raw, ends = over.astype("<i4").tobytes(), 4 * (over >= 0).sum(axis=1)
                other = (over >= len(self.text)).any(axis=1)  # a character that is no piece
                for j, (i, n, odd) in enumerate(zip(left[~more].tolist(), ends.tolist(), other.tolist())):
                    done[i] = self._packed(self._merge(units[i])) if odd else raw[4 * width * j : 4 * width * j + n]
                left, symbol, rank, k = left[more], symbol[more], rank[more], k[more]
            if not len(left):
                return done
            row = np.arange(len(left))
            joined = self._ranks(symbol[row, k], symbol[row, k + 1])[1]
            at_row, at_place = np.nonzero(place[:-1] > k[:, None])  # what lies behind moves up
            symbol[at_row, at_place] = symbol[at_row, at_place + 1]
            rank[at_row, at_place] = rank[at_row, at_place + 1]
            symbol[:, -1], rank[:, -1] = -1, none
            symbol[row, k] = joined
            rank[row, k] = self._ranks(joined, np.where(k + 1 < width, symbol[row, np.minimum(k + 1, width - 1)], -1))[0]
            before = np.maximum(k - 1, 0)
            rank[row, before] = np.where(k > 0, self._ranks(symbol[row, before], joined)[0], rank[row, before])

    def _packed(self, symbols: Iterable[str]) -> bytes:
        ids: list[int] = []
        for s in symbols:
            if s in self.id:
                ids.append(self.id[s])
            elif self.byte_id:
                ids += [self.byte_id[b] for b in s.encode("utf-8")]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<i4").tobytes()

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units that are not known; short ones are remembered."""
        fresh = {u: self.older[u] for u in units if u in self.older}
        rest = sorted(units.difference(fresh), key=len)
        wide = {u: self._packed(self._merge(u)) for u in rest if len(u) > SHORT}
        one = [u for u in rest if len(u) == 1]
        fresh.update((u, self._packed(u)) for u in one)
        short = rest[len(one) : len(rest) - len(wide)]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            fresh.update(zip(part, self._merge_all(part)))
        self.known.update(fresh)
        return wide

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers, without an end id."""
        split = [self.units.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:  # what is not asked for in this generation goes with the next
            self.known, self.older = {}, self.known
        wide = self._learn(set().union(*split).difference(self.known))
        get = {**wide, **self.known}.__getitem__ if wide else self.known.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def encode(self, text: str | None) -> list[int]:
        """The text's ids, without an end id."""
        return np.frombuffer(self.encode_all([text])[0], "<i4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: the added first space is taken away, and a byte that is part of no character becomes U+FFFD. Bytes make
        no character across a control id."""
        ids = np.asarray(ids, np.int64)
        controls = np.flatnonzero(self.silent[ids])
        runs, at = [], 0
        for k in (*controls.tolist(), len(ids)):
            if k > at:
                runs.append(ids[at:k].tolist())
            at = k + 1
        said = "".join(b"".join(map(self.bytes.__getitem__, run)).decode("utf-8", "boxwright-per-byte") for run in runs)
        return said[1:] if self.prefix and runs and self.opens_with_space[runs[0][0]] else said


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`: the ids of `text` with the end id behind them."""
    held = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held)
        end = np.array([pieces.end], "<i4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [i + end for i in pieces.encode_all(part.column(text).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return docs.mapInArrow(run, _with(docs, out, "array<int>"))


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with `out`: the text of `ids`; null where they are."""
    held = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column(ids)
                flat, ends, there = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_pylist()
                texts = pa.array([pieces.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return rows.mapInArrow(run, _with(rows, out, "string"))


def _with(df: DataFrame, name: str, kind: str):
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already; name another")
    return df.limit(0).withColumn(name, F.lit(None).cast(kind)).schema


def differences(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Rows of docs whose ids or decoded text are not the sentencepiece library's, compared in Arrow batches: (text, ids, decoded)
    of this operator for each such row. Empty if all agree."""
    held = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces, library = Pieces(held), sentencepiece.SentencePieceProcessor(model_proto=held)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts = batch.column(0).slice(at, ROWS).to_pylist()
                wanted = library.encode([t or "" for t in texts], add_eos=True, num_threads=1)
                rows = [(t, pieces.encode(t) + [pieces.end]) for t in texts]
                rows = [(t, ids, pieces.decode(ids), w, library.decode(w)) for (t, ids), w in zip(rows, wanted)]
                odd = [(t, ids, d) for t, ids, d, w, x in rows if ids != w or d != x]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in odd], pa.string()), pa.array([o[1] for o in odd], pa.list_(pa.int32())), pa.array([o[2] for o in odd], pa.string())], names=["text", "ids", "decoded"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "text string, ids array<int>, decoded string")
