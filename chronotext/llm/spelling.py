"""Spelling variants: words at edit distance 1, found by Aho-Corasick automata over halves of words, and grouped by frequency.

1. Words: maximal runs of letters of every whole text, A-Z lower-cased, with their number of occurrences over all texts.
2. Halves: of two words one edit apart, one holds one of the other's two halves unchanged, the first half at its beginning or
   the second at its end. Each automaton holds the halves of the words of one shard; every word is scanned by the automata of
   the two shards that can hold a half of a near word. A match counts if it stands at the right offset and the lengths are at
   most one apart, then the distance is verified. A pair that both halves find counts at the first.
3. Shards: a first half is dealt by its first letters, a second half by its last ones, so words meet few others. Letters that
   more than `shard` words share are hot: their halves are dealt into parts and the words into blocks, and every part meets
   every block, so no automaton and no block is larger than about `shard` whatever the words.
4. Forms: a word's form is its near word of largest count (ties: the smallest), if that is `ratio` times its own at least. The
   root follows forms to the last, by pointer doubling; counts grow by `ratio` with each step, so there are few rounds.

Defined results: null and empty texts have no words; repeated rows count again; words longer than any limit are taken whole.
A root of a word without a form is the word itself.
"""

from __future__ import annotations

import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import stored, tidy, written

#: Words of at least so many letters, which occur at least so often; a form has so many times its word's occurrences.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Halves of an automaton and words of a block; pairs verified at a time, by letters.
SHARD, PAIR_LETTERS = 1 << 13, 1 << 24
PARTIAL_WORDS, BLOCK_BYTES = 200_000, 4 << 20

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ASCII = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def letter_runs(offsets: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, pa.Array]:
    """(text of each run, runs): maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least `least` letters, A-Z lower-cased."""
    n = len(data)
    lead = data == 0xC3  # in UTF-8 the lead byte of U+00C0 to U+00FF, and of nothing else
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    wide = np.concatenate([[0], np.cumsum(lead)])
    long = end - begin - (wide[end] - wide[begin]) >= least
    begin, end = begin[long], end[long]
    size = end - begin
    bounds = np.concatenate([[0], np.cumsum(size)])
    letters = _LOWER[data[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], size)]]
    runs = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(letters))
    return np.searchsorted(offsets, begin, side="right") - 1, runs


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, dropped: int | None = None) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    `dropped`: where that number divides the crc32 h of `<key>:<run>`, the run loses its letter h % length first, as typing
    does; a null key never does so.
    """

    def count(batches):
        held, size = [], 0
        for batch in batches:
            keys = [None if k is None else zlib.crc32(f"{k}:".encode()) for k in batch.column(0).to_pylist()] if dropped else []
            for row, offsets, data in bytescan.blocks(batch.column(1), BLOCK_BYTES):
                text_of, runs = letter_runs(offsets, data, least)
                coded = runs.dictionary_encode()
                codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                n = np.bincount(codes, minlength=len(distinct)).astype(np.int64)
                lost: dict[str, int] = {}
                if dropped and len(distinct):
                    pairs, often = np.unique(text_of * len(distinct) + codes, return_counts=True)
                    code = pairs % len(distinct)
                    raw = distinct.cast(pa.large_binary()).to_pylist()
                    crc, before = zlib.crc32, [keys[row + t] for t in (pairs // len(distinct)).tolist()]
                    sums = np.fromiter((1 if b is None else crc(raw[c], b) for c, b in zip(code.tolist(), before, strict=True)), np.int64, len(pairs))
                    hit = np.flatnonzero((sums % dropped == 0) & np.array([b is not None for b in before], bool))
                    np.subtract.at(n, code[hit], often[hit])
                    for c, h, k in zip(code[hit].tolist(), sums[hit].tolist(), often[hit].tolist(), strict=True):
                        run = raw[c].decode()
                        at = h % len(run)
                        left = run[:at] + run[at + 1 :]
                        if len(left) >= least:
                            lost[left] = lost.get(left, 0) + k
                there = np.flatnonzero(n)
                held.append(pa.table({"word": distinct.take(pa.array(there)), "n": pa.array(n[there])}))
                held.append(pa.table({"word": pa.array(list(lost), pa.large_string()), "n": pa.array(list(lost.values()), pa.int64())}))
                size += len(there) + len(lost)
                if size > PARTIAL_WORDS:
                    yield from _merged(held)
                    held, size = [], 0
        if held:
            yield from _merged(held)

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _merged(held: list[pa.Table]) -> list[pa.RecordBatch]:
    both = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": both["word"].cast(pa.string()), "n": both["n_sum"].cast(pa.int64())}).combine_chunks().to_batches(max_chunksize=50_000)


def _one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of letters a and b, b as long as a or one shorter: whether exactly one edit makes one of the other."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    from_left, from_right = a[:, :-1] != b, a[:, 1:] != b
    m = b.shape[1]
    first = np.where(from_left.any(1), from_left.argmax(1), m)
    last = np.where(from_right.any(1), m - 1 - from_right[:, ::-1].argmax(1), -1)
    return last < first


class Letters:
    """Words by length, as rows of numbers."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.at, self.rows = np.zeros(len(words), np.int64), {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            self.at[own] = np.arange(len(own))
            self.rows[n] = np.frombuffer("".join(words[i] for i in own.tolist()).encode("utf-32-le"), "<u4").reshape(-1, n)

    def of(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.rows[length][self.at[which]]


def _near(kind: int, owners: list[str], scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(scanned word, owner): pairs one edit apart that the first halves (kind 0) or second halves (1) of the owners find.

    A pair that its first half finds too is left out for the second.
    """
    none = np.zeros(0, np.int64)
    if not owners or not scanned:  # a part or a block that no word fell to
        return none, none
    by_half: dict[str, dict[int, list[int]]] = {}
    for i, w in enumerate(owners):
        half = w[: len(w) // 2] if kind == 0 else w[len(w) // 2 :]
        by_half.setdefault(half, {}).setdefault(len(w), []).append(i)
    automaton = ahocorasick.Automaton()
    for half, by_length in by_half.items():
        automaton.add_word(half, (len(half), {n: np.array(own, np.int64) for n, own in by_length.items()}))
    automaton.make_automaton()
    asked: dict[tuple[int, int], tuple[list[int], list[np.ndarray], list[int]]] = {}
    theirs, ours, out, found = Letters(owners), Letters(scanned), [], []

    def verify(lengths: tuple[int, int]) -> None:
        who, whose, _ = asked.pop(lengths)
        u, w = np.repeat(np.array(who, np.int64), [len(x) for x in whose]), np.concatenate(whose)
        step = max(1, PAIR_LETTERS // max(lengths))
        for i in range(0, len(u), step):
            a, b = ours.of(u[i : i + step], lengths[0]), theirs.of(w[i : i + step], lengths[1])
            good = _one_apart(a, b) if lengths[0] >= lengths[1] else _one_apart(b, a)
            if kind:
                h = lengths[1] // 2
                good &= (a[:, :h] != b[:, :h]).any(1)
            out.append(u[i : i + step][good]), found.append(w[i : i + step][good])

    for i, word in enumerate(scanned):
        n = len(word)
        for end, (size, by_length) in automaton.iter(word):
            if end + 1 == (n if kind else size):  # the offset: at the end, or the beginning
                for m in (n - 1, n, n + 1):
                    own = by_length.get(m)
                    if own is not None:
                        who = asked.setdefault((n, m), ([], [], [0]))
                        who[0].append(i), who[1].append(own)
                        who[2][0] += len(own)
                        if who[2][0] * max(n, m) > PAIR_LETTERS:
                            verify((n, m))
    for lengths in list(asked):
        verify(lengths)
    return (np.concatenate(out), np.concatenate(found)) if out else (none, none)


_BEST = "word string, n_near long, other_n long, other string"


def near_words(known: DataFrame, least: int = LEAST_LETTERS, shard: int = SHARD) -> DataFrame:
    """(word, n_near, other_n, other): of each word with near words their number and the most frequent, in parts of a sum by word.

    `known`: a table of (word, n), each word once.
    """
    edge = least // 2  # no half is shorter
    total = known.count()
    cold_shards = max(1, math.ceil(total / shard))
    keyed = known.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("letters", F.when(F.col("kind") == 0, F.substring("word", 1, edge)).otherwise(F.expr(f"right(word, {edge})")))
    # each hot row stands for more than `shard` words, so there are at most 2 * words / shard of them, and of three of 90 letters 1.5 million at most
    hot = keyed.groupBy("kind", "letters").agg(F.count("*").alias("words")).where(F.col("words") > shard).withColumn("parts", F.ceil(F.col("words") / shard))
    dealt = keyed.join(F.broadcast(hot), ["kind", "letters"], "left")
    salt = F.pmod(F.xxhash64("word", F.lit("part")), F.coalesce("parts", F.lit(1)))
    group = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("letters"), F.lit(cold_shards)).cast("string")).otherwise(F.concat(F.lit("="), "letters"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    cells = ["kind", "group", "part", "block"]
    dealt = dealt.select("kind", group.alias("group"), salt.alias("salt"), F.coalesce("parts", F.lit(1)).alias("parts"), "word", "n")
    owners = dealt.withColumn("block", every).withColumnRenamed("salt", "part").select(*cells, "word", "n")
    scanned = dealt.withColumn("part", every).withColumnRenamed("salt", "block").select(*(F.col(c).alias(f"own_{c}") for c in [*cells, "word"]))

    def scan(cell: tuple, own: pa.Table, words: pa.Table) -> pa.Table:
        kind, ours, theirs = cell[0].as_py(), words["own_word"].to_pylist(), own["word"].to_pylist()
        u, w = _near(kind, theirs, ours)
        n = own["n"].to_numpy()
        # by word, then the most frequent, then the smallest in code-point order
        rank = np.zeros(len(theirs), np.int64)
        rank[np.array(sorted(range(len(theirs)), key=theirs.__getitem__), np.int64)] = np.arange(len(theirs))
        order = np.lexsort((rank[w], -n[w], u))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.diff(u, prepend=-1))
        count = np.diff(np.append(first, len(u)))
        return pa.table({"word": pa.array([ours[i] for i in u[first].tolist()], pa.string()), "n_near": pa.array(count.astype(np.int64)), "other_n": pa.array(n[w[first]].astype(np.int64)), "other": pa.array([theirs[i] for i in w[first].tolist()], pa.string())})

    return owners.groupBy(*cells).cogroup(scanned.groupBy(*(f"own_{c}" for c in cells))).applyInArrow(scan, _BEST)


def variants(known: DataFrame, ratio: int = RATIO, least: int = LEAST_LETTERS, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `known`: (word, n), each word once, none shorter than `least`."""
    known = stored(known.select("word", "n"), "words")
    own = known.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("other_n"), F.lit(None).cast("string").alias("other"))
    parts = near_words(known, least, shard).select("word", F.lit(None).cast("long").alias("n"), "n_near", "other_n", "other")
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("word"))))
    seen = own.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.least") >= F.col("n") * ratio
    seen = seen.select("word", "n", "n_near", F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.least")).alias("form_n"))
    seen = stored(seen, "forms")
    most = seen.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(max(most, 1), max(ratio, 2))) + 1  # forms that can follow each other
    links = seen.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return seen.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
