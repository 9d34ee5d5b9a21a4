"""Best-fit packing by sums of squares: documents as token ids, cut in pieces of at most `capacity`, packed into sequences.

1. Pieces: a text's ids and an end id. Only a document longer than a sequence is cut, so that all its pieces but the first
   fill a sequence each. The library encodes every distinct unit that a worker does not hold any more; units end where letters do and
   begin at a space before a character, and no pre-token reaches over such a border.
2. Packing: pieces that fill a sequence stay alone. All others are dealt at random into groups of about `group` pieces and
   come longest first. With N(g) open sequences of gap g, a piece of length s goes into the open sequence that makes the sum
   of all N(g)^2 smallest: it takes one from N(g) and adds one to N(g - s). A sequence is opened only where none has room,
   so a group wastes little more than its last sequence. A task holds the counts by gap and its open sequences.

Defined results: null and empty texts are the end id alone; repeated rows and null keys are documents of their own; of equal
sums the smallest gap is taken, of its sequences the one that got there last. The key may not bear the name of a result column.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import named_apart, tidy, written

CAPACITY, END_ID = 1024, 2
#: Pieces of a group; bytes of text taken at a time; ids that a worker holds for units it has seen.
GROUP, BLOCK_BYTES, HELD_IDS = 1 << 15, 4 << 20, 1 << 22

_RESULT = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
#: Bytes that surely begin no white space: ASCII but for control characters and space, and leads of other blocks than Unicode's spaces have.
_SOLID = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4 for b in range(256)])

#: Bytes of ASCII letters; second bytes of U+00C0 to U+00FF without the two signs among them; ASCII but for letters.
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_NO_LETTER = np.array([b < 0x80 for b in range(256)]) & ~_LETTER


class Encoder:
    """The ids of whole texts by a tokenizers file (byte-level BPE), each distinct unit encoded once as long as it is held."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.begin, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 12, np.uint32), 0

    def borders(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where units begin: at texts, at a space before what is no white space, behind a run of letters, around special strings."""
        n = len(data)
        starts = np.zeros(n + 1, bool)
        starts[: n - 1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        starts[1:n] |= letter[:-1] & _NO_LETTER[data[1:]]
        edges = offsets[(offsets > 0) & (offsets < n)]
        at_edge = edges - 1
        starts[at_edge] &= ~((data[at_edge] == 0x20) & ~np.append(False, letter)[at_edge])  # the next character is another text's
        raw = data.tobytes()
        for word in self.special:
            at = raw.find(word)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right"))
                if at + len(word) <= offsets[text]:  # not half in the next text
                    starts[at + 1 : at + len(word)] = False
                    starts[[at, at + len(word)]] = True
                    if at and offsets[text - 1] < at:
                        starts[at - 1] &= raw[at - 1] != 0x20  # a space there is the end of what stands before
                at = raw.find(word, at + 1)
        starts[edges] = True
        if n:
            starts[0] = True
        return np.flatnonzero(starts[:n])

    def slots_of(self, units: list[str]) -> np.ndarray:
        if self.used > HELD_IDS:
            self._forget()
        get = self.slots.get
        slots = np.array([get(u, -1) for u in units], np.int64)
        missing = np.flatnonzero(slots < 0)
        new, lengths = [], []
        for i in range(0, len(missing), 4000):
            some = [units[j] for j in missing[i : i + 4000].tolist()]
            for e in self.library.encode_batch_fast(some, add_special_tokens=False):
                ids = e.ids
                new += ids
                lengths.append(len(ids))
            self.slots.update(zip(some, range(len(self.begin) - 1 + i, len(self.begin) - 1 + i + len(some)), strict=True))
        slots[missing] = len(self.begin) - 1 + np.arange(len(missing))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(new), self.used), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(np.array(lengths, np.int64))])
        self.used += len(new)
        return slots

    def encode(self, column: pa.Array):
        """Runs of (first row, first id of each text, ids)."""
        for row, offsets, data in bytescan.blocks(column, BLOCK_BYTES):
            begin = self.borders(offsets, data)
            bounds = np.append(begin, len(data))
            units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
            coded = units.dictionary_encode()
            slot = self.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(begin) else np.zeros(0, np.int64)
            size = self.begin[slot + 1] - self.begin[slot]
            after = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.arange(after[-1]) + np.repeat(self.begin[slot] - after[:-1], size)]
            yield row, after[np.searchsorted(begin, offsets)], ids


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): the pieces of every row. `tokenizer`: a file that every executor can open."""
    named_apart(key, _RESULT)

    def cut(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for row, first, ids in encoder.encode(batch.column(1)):
                n = len(first) - 1
                # every text's ids and the end id behind them
                whole = np.full(len(ids) + n, end_id, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
                begin = first + np.arange(n + 1)
                length = np.diff(begin)
                head = (length - 1) % capacity + 1
                count = 1 + (length - head) // capacity
                doc = np.repeat(np.arange(n), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
                size = np.where(number == 0, head[doc], capacity)
                at = begin[doc] + start
                raw = memoryview(whole).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                out = [batch.column(0).slice(row, n).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums, pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begin[doc] + start, len(whole)).astype(np.int32)), pa.array(whole.view(np.int32))))
                yield pa.record_batch(out, [key, *_RESULT[: len(out) - 1]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(cut), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class Sequences:
    """The open sequences of a group: a number and how many there are for each gap."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The sequence of the next piece, and the piece's place in it."""
        own = self.count[size : self.capacity]
        room = np.flatnonzero(own)
        if len(room):
            # the sum of squares changes by 2 (N(g - s) - N(g) + 1), but a gap of 0 is closed and counts no more
            change = 2 * (self.count[room] - own[room] + 1)
            if room[0] == 0:
                change[0] = 1 - 2 * own[0]
            left = int(room[change.argmin()])
            gap = left + size
            self.count[gap] -= 1
            sequence = self.by_gap[gap].pop()
        else:
            gap, left = self.capacity, self.capacity - size
            sequence, self.opened = self.opened, self.opened + 1
        if left:
            self.count[left] += 1
            self.by_gap[left].append(sequence)
        return sequence, self.capacity - gap


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of pieces() with sequence_id and offset: no sequence holds more than `capacity`, and each is filled from 0 without gaps."""
    rows = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = rows.where(F.col("length") < capacity)
    groups = max(1, math.ceil(part.count() / group))
    dealt = part.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).repartition("_group").sortWithinPartitions("_group", F.desc("length"), "_row")

    def place(batches):
        now, open_ones = None, None
        for batch in batches:
            names = batch.schema.names
            own, size = batch.column(names.index("_group")).to_numpy(), batch.column(names.index("length")).to_pylist()
            sequence, offset = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for i, (g, s) in enumerate(zip(own.tolist(), size, strict=True)):
                if g != now:
                    now, open_ones = g, Sequences(capacity)
                n, offset[i] = open_ones.place(s)
                sequence[i] = (g << 32) + n
            keep = [i for i, c in enumerate(names) if c not in ("_group", "_row")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(names[i] for i in keep), "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    full = rows.where(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): what pack() has made of pieces that carry their ids; a group is one sequence, so bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
