"""Benchmark decontamination with an FM-index over each shard of training text.

Texts are read as words (A-Z in lower case; runs of digits, letters and anything beyond ASCII). The phrases to find are
the benchmark items' windows of `window` consecutive words; an item of fewer words is one window. A word that occurs in
no window is a separator, and runs between separators shorter than the shortest window cannot hold one, so what is
indexed are the remaining runs: the search stays exact. For each shard of them the suffixes are sorted, the
Burrows-Wheeler transform is stored as a wavelet matrix with rank blocks, all windows are searched backwards at once,
occurrences are located from sampled suffix positions, and the hit words are merged to removal spans.

The benchmark is read in blocks of bounded size; what each task holds of it does not grow with it.

Defined results: a null or empty text has no words and is clean; an item without words has no window; items of equal
text are each counted, those of one name once; an item without a name is called null; rows that are repeated are each
returned; columns of any names go through cut() as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import fresh_name, named_apart, stored, tidy

WINDOW = 10
#: Symbols of one shard's index, and rows that wait for it, at most (a text of more symbols is a shard alone).
SHARD_SYMBOLS, SHARD_ROWS = 1 << 20, 1 << 17
#: Bytes of benchmark text that are searched in one pass.
BLOCK_BYTES = 16 << 20
SAMPLE_EVERY = 16


class BitRank:
    """A bit vector with the number of set bits before any position."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """How often a symbol occurs before a position, over a sequence of symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            a, b = self.bits[k].rank(low), self.bits[k].rank(high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of `symbols` in order; 0 ends a run, and of two zeros the earlier is the smaller."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = first[group]
        size = np.diff(np.append(first, n))
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            return order
        at = order[tied]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, rank[at]))
        order[tied] = at[again]
        # ranks: the place of the first of the group, then split by the second key
        a, b = rank[at[again]], second[again]
        fresh = np.ones(len(again), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at[again]] = lead
        step *= 2


class FMIndex:
    """Backward search and location over one shard's symbols (0: end of a run)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = symbols[order - 1]  # before the first symbol stands the last, a 0
        self.tree = WaveletMatrix(self.bwt, max(1, int(n_symbols).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        kept = order % SAMPLE_EVERY == 0
        # a run's first symbol is sampled as well: no walk ever steps over a 0, whose order is by place
        kept |= self.bwt == 0
        self.kept, self.samples = BitRank(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of `patterns`."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c, live = patterns[:, k], low < high
            low[live], high[live] = (self.less[c[live]] + self.tree.rank(c[live], x[live]) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        out, steps, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.astype(np.int64)
        going = np.arange(len(rows))
        while len(going):
            known = self.kept.get(row[going])
            done = going[known]
            out[done] = self.samples[self.kept.rank(row[done])] + steps[done]
            going = going[~known]
            c = self.bwt[row[going]]
            row[going] = self.less[c] + self.tree.rank(c, row[going])
            steps[going] += 1
        return out


@dataclass
class Phrases:
    """The windows of a block of benchmark items."""

    vocabulary: np.ndarray  # sorted hashes; the symbol is the place plus 1
    likely: np.ndarray  # by the hash's upper bits
    windows: dict[int, np.ndarray]  # by length: rows of symbols
    items: dict[int, list[list[int]]]  # by length: of each window, the items
    names: list[str]
    shortest: int

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.likely[hashes >> np.uint64(44)])
        h = hashes[maybe]
        at = np.searchsorted(self.vocabulary, h)
        hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h
        out[maybe[hit]] = at[hit] + 1
        return out


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases | None:
    """The windows of (name, text) items; None where no item has a word."""
    text = pa.array([t for _, t in items], pa.large_string())
    per_item: list[np.ndarray] = []
    for _, offsets, data in bytescan.blocks(text):
        w = bytescan.words(offsets, data, bytescan.ALNUM)
        per_item += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    every = np.concatenate(per_item) if per_item else np.zeros(0, np.uint64)
    if not len(every):
        return None
    vocabulary = np.unique(every)
    likely = np.zeros(1 << 20, bool)
    likely[vocabulary >> np.uint64(44)] = True
    found: dict[int, dict[tuple, list[int]]] = {}
    for i, h in enumerate(per_item):
        if len(h):
            s, k = np.searchsorted(vocabulary, h) + 1, min(window, len(h))
            rows = found.setdefault(k, {})
            for row in np.lib.stride_tricks.sliding_window_view(s, k).tolist():
                of = rows.setdefault(tuple(row), [])
                if not of or of[-1] != i:
                    of.append(i)
    return Phrases(vocabulary, likely, {k: np.array(list(v), np.int64) for k, v in found.items()}, {k: list(v.values()) for k, v in found.items()}, [n for n, _ in items], min(found))


class Shard:
    """Rows that wait to be indexed together."""

    def __init__(self, wanted: Phrases):
        self.wanted, self.ids, self.counts, self.parts, self.kept = wanted, [], [], [], 0

    def add(self, ids: list, found: bytescan.Words, offsets: np.ndarray) -> None:
        symbols, base = self.wanted.symbols(found.hashes), len(self.ids)
        text = np.repeat(np.arange(len(ids)), found.counts())
        self.ids += ids
        self.counts.append(found.counts())
        here = symbols > 0
        new = here.copy()
        new[1:] &= ~(here[:-1] & (text[1:] == text[:-1]))
        place = np.flatnonzero(here)
        run = np.cumsum(new)[place] - 1
        size = np.bincount(run)
        keep = place[size[run] >= self.wanted.shortest]
        if len(keep):
            starts = new[keep]
            self.parts.append((symbols[keep], starts, text[keep] + base, keep - found.first[text[keep]], found.begin[keep] - offsets[text[keep]], found.end[keep] - offsets[text[keep]]))
            self.kept += len(keep)

    def hits(self) -> dict[int, tuple[list[tuple[int, int, int, int]], list[str]]]:
        """For each row that is hit: merged spans (first word, end word, first byte, end byte) and the items' names."""
        if not self.parts:
            return {}
        symbol, starts, text, word, begin, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        run = np.cumsum(starts) - 1
        sequence = np.zeros(len(symbol) + int(run[-1]) + 1, np.int64)
        where = np.arange(len(symbol)) + run  # a 0 after each run
        sequence[where] = symbol
        back = np.zeros(len(sequence), np.int64)
        back[where] = np.arange(len(symbol))
        index = FMIndex(sequence, len(self.wanted.vocabulary))
        firsts, lasts, of = [], [], []
        for k, patterns in self.wanted.windows.items():
            low, high = index.search(patterns)
            n = high - low
            rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = back[index.locate(rows)]
            firsts.append(at), lasts.append(at + k - 1)
            of += [(k, i) for i in np.repeat(np.arange(len(patterns)), n).tolist()]
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        order = np.lexsort((last, first))
        out: dict[int, tuple[list, set]] = {}
        for o in order.tolist():
            a, b = int(first[o]), int(last[o])
            spans, items = out.setdefault(int(text[a]), ([], set()))
            k, i = of[o]
            items.update(self.wanted.items[k][i])
            one = (int(word[a]), int(word[b]) + 1, int(begin[a]), int(end[b]))
            if spans and one[0] <= spans[-1][1]:
                if one[1] > spans[-1][1]:
                    spans[-1] = (spans[-1][0], one[1], spans[-1][2], one[3])
            else:
                spans.append(one)
        return {t: (spans, list(dict.fromkeys(self.wanted.names[i] for i in sorted(items)))) for t, (spans, items) in out.items()}


SPANS = "array<struct<first_word:int,end_word:int,first_byte:int,end_byte:int>>"


def _one_pass(docs: DataFrame, wanted: Phrases, key: str, text: str) -> DataFrame:
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, text_key long, n_words long, spans {SPANS}, items array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    arrow = pa.list_(pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "first_byte", "end_byte")]))

    def out(shard: Shard, kind: pa.DataType) -> pa.RecordBatch:
        hits = shard.hits()
        ids = [x for x, _ in shard.ids]
        spans = [[dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s, strict=True)) for s in hits[i][0]] if i in hits else [] for i in range(len(ids))]
        items = [hits[i][1] if i in hits else [] for i in range(len(ids))]
        return pa.record_batch([pa.array(ids, kind), pa.array([y for _, y in shard.ids], pa.int64()), pa.array(np.concatenate(shard.counts), pa.int64()), pa.array(spans, arrow), pa.array(items, pa.list_(pa.string()))], [key, "text_key", "n_words", "spans", "items"])

    def find(batches):
        shard, kind = Shard(shared.value), None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for row, offsets, data in bytescan.blocks(batch.column(2)):
                shard.add(ids[row : row + len(offsets) - 1], bytescan.words(offsets, data, bytescan.ALNUM), offsets)
                if shard.kept >= SHARD_SYMBOLS or len(shard.ids) >= SHARD_ROWS:
                    yield out(shard, kind)
                    shard = Shard(shared.value)
        if shard.ids:
            yield out(shard, kind)

    return docs.select(F.col(key), F.xxhash64(text).alias("text_key"), F.col(text)).mapInArrow(tidy(find), schema)


def _blocks(benchmark: DataFrame, window: int, item: str, item_text: str, block_bytes: int) -> list[Phrases]:
    """The benchmark's windows in blocks of bounded size."""
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = max(1, math.ceil(size / block_bytes))
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("t"))
    found = []
    for b in range(passes):
        part = named.where(F.pmod(F.xxhash64("name", "t"), F.lit(passes)) == b) if passes > 1 else named
        # a bounded block of the benchmark, never of the corpus
        wanted = phrases([(r["name"], r["t"]) for r in part.toLocalIterator()], window)
        if wanted is not None:
            found.append(wanted)
    return found


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: key, text_key, n_words, spans of hit words and bytes (merged, in order), and the names of the items."""
    named_apart(key, ["text_key", "n_words", "spans", "items"])
    blocks = _blocks(benchmark, window, item, item_text, block_bytes) or [Phrases(np.zeros(1, np.uint64), np.zeros(1 << 20, bool), {}, {}, [], 1)]
    own = docs.select(F.col(key).alias("own_key"), F.col(text).alias("own_text"))
    if len(blocks) == 1:
        return _one_pass(own, blocks[0], "own_key", "own_text").withColumnRenamed("own_key", key)
    # each row has a number of its own, so what meets is a row for each block of the benchmark, whatever keys and texts repeat
    rows = stored(own.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("own_key").alias("key")).alias("own_key"), "own_text"), "numbered")
    found = [_one_pass(rows, wanted, "own_key", "own_text") for wanted in blocks]
    every = reduce(DataFrame.unionAll, found).groupBy("own_key").agg(F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<first_word:int,end_word:int,first_byte:int,end_byte:int>>), (a, s) ->
        CASE WHEN size(a) = 0 OR s.first_word > element_at(a, -1).end_word THEN concat(a, array(s))
             WHEN s.end_word <= element_at(a, -1).end_word THEN a
             ELSE concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).first_word, s.end_word, element_at(a, -1).first_byte, s.end_byte))) END)""")
    return every.withColumn("spans", merged).select(F.col("own_key.key").alias(key), "text_key", "n_words", "spans", "items")


def _without(raw: bytes, spans: list[tuple[int, int, int, int]]) -> str:
    pieces, at = [], 0
    for _, _, a, b in spans:
        pieces.append(raw[at:a])
        at = b
    return b" ".join([*pieces, raw[at:]]).decode()


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` with the hit spans cut out of their text; rows of which no word is left go, rows without hits stay as they are.

    A benchmark of one block is cut in passing, each Arrow batch a shard, and nothing is shuffled. Of a larger one the
    spans of all blocks are merged first and joined to the rows.
    """
    found = _blocks(benchmark, window, item, item_text, block_bytes)
    if not found:
        return docs
    at = docs.columns.index(text)
    if len(found) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(found[0])

        def clean(batches):
            for batch in batches:
                column, shard, counts = batch.column(at), Shard(shared.value), []
                for row, offsets, data in bytescan.blocks(column):
                    words = bytescan.words(offsets, data, bytescan.ALNUM)
                    shard.add(list(range(row, row + len(offsets) - 1)), words, offsets)
                    counts.append(words.counts())
                hits = shard.hits()
                if not hits:
                    yield batch
                    continue
                texts, keep, n = column.to_pylist(), np.ones(batch.num_rows, bool), np.concatenate(counts)
                for i, (spans, _) in hits.items():
                    texts[i] = _without(texts[i].encode(), spans)
                    keep[i] = n[i] > sum(b - a for a, b, _, _ in spans)
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type)).filter(pa.array(keep))

        return docs.mapInArrow(tidy(clean), docs.schema)
    row, own, s, rest = (fresh_name(docs.columns, n) for n in ("_row", "_own", "_spans", "_left"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hit = find(rows.select(F.col(row).alias("row"), text), benchmark, window, "row", text, item, item_text, block_bytes).where(F.size("spans") > 0)
    hit = hit.select(F.col("row").alias(own), F.col("spans").alias(s), (F.col("n_words") - F.expr("aggregate(spans, 0L, (a, s) -> a + s.end_word - s.first_word)")).alias(rest))
    joined = rows.join(hit, F.col(row) == F.col(own), "left").where(F.col(rest).isNull() | (F.col(rest) > 0))
    columns = [*docs.columns, s]

    def apply(batches):
        for batch in batches:
            column, spans = batch.column(at), batch.column(len(columns) - 1).to_pylist()
            texts = [t if not s else _without(t.encode(), [tuple(x.values()) for x in s]) for t, s in zip(column.to_pylist(), spans, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type)).select(docs_columns)

    docs_columns = docs.columns
    return joined.select(*columns).mapInArrow(tidy(apply), docs.schema)
