"""Ordered-sequence operators over tables keyed by medium: islands, interval merges, repairs, allocations, nearest edges.

Each takes the columns that name a medium and the column(s) that order its rows; every window is partitioned by the
medium, so rows of different media never meet, and everything is built from window functions and joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packing, quality

#: Segments whose words are dealt at a time.
SOME = 512


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0: a row for which `starts` holds begins one, and so does the first row."""
    w = _over(by, order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(starts, 1).otherwise(0)
    return rows.withColumn("_starts", flag).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_starts")


def group_words(words: DataFrame, by: list[str], order: list[str], gap_ms: float = 700, text: str = "text", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Segments of words: a new one after a gap above `gap_ms` or a word that ends in strong punctuation."""
    w = _over(by, order)
    told = words.where(F.trim(text) != "").withColumn("_gap", F.col(start) - F.lag(end).over(w)).withColumn("_last", F.lag(text).over(w))
    numbered = islands(told, by, order, (F.col("_gap") > gap_ms) | F.col("_last").rlike("[.!?…。！？]$"), "segment")
    entry = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.trim(text).alias("text"), F.col(start).alias("s"), F.col(end).alias("e"))
    held = numbered.groupBy(*by, "segment").agg(F.sort_array(F.collect_list(entry)).alias("_w"))
    words_only = F.transform("_w", lambda x: F.struct(x["text"].alias("text"), x["s"].alias("start_ms"), x["e"].alias("end_ms")))
    return held.select(*by, "segment", F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("text"), F.element_at("_w", 1)["s"].alias("start_ms"), F.element_at("_w", -1)["e"].alias("end_ms"), words_only.alias("words"))


def merge_intervals(rows: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms", max_gap: float = 0) -> DataFrame:
    """Intervals merged where the gap to all before is at most `max_gap`."""
    order = [start, end]
    before = F.max(end).over(_over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("_before", before)
    numbered = islands(told, by, order, F.col(start) - F.col("_before") > max_gap, "_n")
    return numbered.groupBy(*by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_n")


def clamped_intervals(rows: DataFrame, by: list[str], length: Column, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Intervals cut to 0..length, without the empty ones, merged where they touch."""
    cut = lambda c: F.greatest(F.lit(0), F.least(length, F.col(c)))
    return merge_intervals(rows.withColumns({start: cut(start), end: cut(end)}).where(F.col(end) > F.col(start)), by, start, end)


def silence_gaps(regions: DataFrame, by: list[str], least_ms: float = 300, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Gaps of at least `least_ms` between consecutive regions."""
    before = F.lag(end).over(_over(by, [start, end]))
    return regions.withColumn("_before", before).where(F.col(start) - F.col("_before") >= least_ms).select(*by, F.col("_before").alias(start), F.col(start).alias(end))


def median_filter(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, half: int = 2) -> DataFrame:
    """The median of 2 * half + 1 values around a row; at the ends the first or last value stands for those beyond."""
    w = _over(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    near = [F.coalesce(F.lag(value, k).over(w), first) for k in range(half, 0, -1)] + [F.col(value)] + [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, half + 1)]
    return rows.withColumn(name, F.element_at(F.sort_array(F.array(*near)), half + 1))


def smooth_timings(words: DataFrame, by: list[str], order: list[str], window: int = 5, max_delta: float = 120, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Starts and ends drawn to their running medians by at most `max_delta`; starts never go back, no end precedes its start."""
    half = (max(1, round(window)) | 1) // 2
    both = median_filter(median_filter(words, by, order, start, "_s", half), by, order, end, "_e", half)
    near = lambda c, m: F.greatest(F.col(c) - max_delta, F.least(F.col(c) + max_delta, F.col(m)))
    moved = both.withColumns({start: near(start, "_s"), end: near(end, "_e")}).drop("_s", "_e")
    return monotonic(moved, by, order, start, end)


def monotonic(rows: DataFrame, by: list[str], order: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Starts raised to the largest so far, ends to their starts."""
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(start, F.max(start).over(w)).withColumn(end, F.greatest(end, start))


def drop_micro_words(words: DataFrame, least_ms: float = 50, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return words.where(F.col(end) - F.col(start) >= least_ms)


def distribute_words(segments: DataFrame, by: list[str], text: str = "text", lang: str | Column = "lang", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """A segment's time dealt to its words by visible length (1 at least). `by` names one segment; word `pos` counts from 0."""
    types = dict(segments.dtypes)

    def rows(keys: list[pa.Array], at: np.ndarray, words: list[str], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        whose = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = pa.array(whose, pa.int64())
        return pa.RecordBatch.from_arrays([*(k.take(place) for k in keys), pa.array(np.arange(len(words)) - at[whose], pa.int32()), pa.array(words, pa.string()), *_times(starts, ends)], [*by, "pos", "text", "start_ms", "end_ms"])

    return _dealt(segments, by, text, lang, start, end, rows, ", ".join(f"`{k}` {types[k]}" for k in by) + ", pos int, text string, start_ms double, end_ms double")


def with_words(segments: DataFrame, text: str = "text", lang: str | Column = "lang", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """`segments` with the words of distribute_words as an array `words` (text, start_ms, end_ms); a segment without words has none."""
    names, types = segments.columns, dict(segments.dtypes)

    def rows(keys: list[pa.Array], at: np.ndarray, words: list[str], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        timed = pa.StructArray.from_arrays([pa.array(words, pa.string()), *_times(starts, ends)], ["text", "start_ms", "end_ms"])
        return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(at, pa.int32()), timed)], [*names, "words"])

    return _dealt(segments, names, text, lang, start, end, rows, ", ".join(f"`{k}` {types[k]}" for k in names) + ", words array<struct<text:string,start_ms:double,end_ms:double>>")


def _times(*times: np.ndarray) -> list[pa.Array]:
    return [pa.array(t, pa.float64(), from_pandas=True) for t in times]


def _dealt(segments: DataFrame, keep: list[str], text: str, lang: str | Column, start: str, end: str, rows, schema: str) -> DataFrame:
    """`rows` of `keep` and the words of each segment, some segments at a time; rows stay where they are."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    k = len(keep)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SOME):
                part = batch.slice(i, SOME)
                texts, langs = part.column(k).to_pylist(), part.column(k + 1).to_pylist()
                times = [part.column(j).to_numpy(zero_copy_only=False) for j in (k + 2, k + 3)]
                yield rows([part.column(j) for j in range(k)], *packing.deal(texts, langs, *times))

    told = segments.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"), lang.alias("_lang"), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"))
    return told.mapInArrow(run, schema)


def fix_overlaps(cues: DataFrame, by: list[str], order: list[str], min_gap: float = 80, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Ends cut to leave `min_gap` before the next start, then empty cues dropped (they have cut their predecessors)."""
    following = F.lead(start).over(_over(by, order))
    return cues.withColumn(end, F.least(F.col(end), F.coalesce(following - min_gap, F.col(end)))).where(F.col(end) > F.col(start))


def reindex(cues: DataFrame, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    return cues.withColumn(name, F.row_number().over(_over(by, order)))


def nearest_edge(points: DataFrame, edges: DataFrame, by: list[str], value: str, edge: str, tolerance: float, name: str = "nearest") -> DataFrame:
    """Of each point the nearest edge of its medium within `tolerance` (null: none); of two equally near, the smaller.

    Both sides are dealt to buckets of the tolerance's width, so the join is an equi-join on medium and bucket, and
    points meet only edges of three buckets.
    """
    width = float(tolerance) or 1.0
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    # the nearest edge hangs on medium and value alone, so rows need no number of their own
    values = points.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    spread = values.select(*by, "_v", F.explode(F.array(bucket("_v") - 1, bucket("_v"), bucket("_v") + 1)).alias("_b"))
    marks = edges.select(*by, F.col(edge).alias("_edge")).where(F.col("_edge").isNotNull()).distinct().withColumn("_b", bucket("_edge"))
    near = spread.join(marks, [*by, "_b"]).where(F.abs(F.col("_edge") - F.col("_v")) <= tolerance)
    best = near.groupBy(*by, "_v").agg(F.min_by("_edge", F.struct(F.abs(F.col("_edge") - F.col("_v")), F.col("_edge"))).alias(name))
    return points.join(best.withColumnRenamed("_v", value), [*by, value], "left").select(*points.columns, name)


def snap(values: Column, preferred: Column, every: Column, gaps: Column, tolerance: float = 250) -> Column:
    """A value moved to the nearest preferred edge, else the nearest of all, within tolerance and not inside a gap. Edges and gaps are arrays."""

    def nearest(edges: Column) -> Column:
        close = F.filter(edges, lambda e: F.abs(e - values) <= tolerance)
        return F.array_min(F.transform(close, lambda e: F.struct(F.abs(e - values).alias("d"), e.alias("e"))))["e"]

    chosen = F.coalesce(nearest(preferred), nearest(every))
    barred = F.exists(gaps, lambda g: (chosen > g["start_ms"]) & (chosen < g["end_ms"]))
    return F.when(chosen.isNull() | barred, values).otherwise(chosen)


def snap_to_regions(segments: DataFrame, regions: DataFrame, by: list[str], order: list[str], tolerance: float = 250) -> DataFrame:
    """Segment edges moved to edges of speech, but not into silences of 300 ms or more; starts never go back.

    The first word follows the segment's start and the last its end. `segments` has start_ms, end_ms and words (may be null).
    """
    sides = regions.groupBy(*by).agg(F.sort_array(F.collect_list("start_ms")).alias("_starts"), F.sort_array(F.collect_list("end_ms")).alias("_ends"))
    gaps = silence_gaps(regions, by).groupBy(*by).agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("_gaps"))
    wide = segments.join(sides, by, "left").join(gaps, by, "left")
    none = F.array().cast("array<double>")
    starts, ends = F.coalesce("_starts", none), F.coalesce("_ends", none)
    hollow = F.coalesce("_gaps", F.array().cast("array<struct<start_ms:double,end_ms:double>>"))
    every = F.concat(starts, ends)
    moved = wide.withColumns({"_s": snap(F.col("start_ms"), starts, every, hollow, tolerance), "_e": snap(F.col("end_ms"), ends, every, hollow, tolerance)})
    moved = moved.withColumn("start_ms", F.col("_s")).withColumn("end_ms", F.greatest("_e", "_s")).withColumn("_any", F.size(every) > 0)
    last = F.size("words") - 1

    def edged(w, i):
        first_to = F.when(F.col("_any"), F.col("start_ms")).otherwise(w["start_ms"])
        last_to = F.when(F.col("_any"), F.col("end_ms")).otherwise(w["end_ms"])
        return w.withField("start_ms", F.when(i == 0, first_to).otherwise(w["start_ms"])).withField("end_ms", F.when(i == last, last_to).otherwise(w["end_ms"]))

    patched = moved.withColumn("words", F.transform("words", edged)).drop("_s", "_e", "_starts", "_ends", "_gaps", "_any")
    repaired = monotonic(patched, by, order)
    raised = lambda w, i: w.withField("start_ms", F.when(i == 0, F.greatest(w["start_ms"], F.col("start_ms"))).otherwise(w["start_ms"])).withField("end_ms", F.when(i == F.size("words") - 1, F.greatest(w["end_ms"], F.col("end_ms"))).otherwise(w["end_ms"]))
    return repaired.withColumn("words", F.transform("words", raised))


def _smoothed(at: np.ndarray, start: np.ndarray, end: np.ndarray, half: int = 2, max_delta: float = 120) -> tuple[np.ndarray, np.ndarray]:
    """smooth_timings() of words that stand in order, segment by segment; `at` is where each begins, and the end of all."""
    whose = np.repeat(np.arange(len(at) - 1), np.diff(at))
    near = np.arange(len(start)) + np.arange(-half, half + 1)[:, None]
    near = np.clip(near, at[:-1][whose], at[1:][whose] - 1)
    start, end = (np.maximum(x - max_delta, np.minimum(x + max_delta, np.sort(x[near], axis=0)[half])) for x in (start, end))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        np.maximum.accumulate(start[a:b], out=start[a:b])
    return start, np.maximum(end, start)


def _own_words(segments: DataFrame, key: list[str], least_ms: float, whole: bool) -> DataFrame:
    """(key, text, start_ms, end_ms, n_words, words, said): each segment's words (known times) without the short ones, smoothed,
    as one text; null where none is left. Rows stay where they are. Unless `whole`, only the first and the last word stay."""
    types, names = dict(segments.dtypes), [*key, "text", "start_ms", "end_ms"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SOME):
                part = batch.slice(i, SOME)
                lists = part.column(len(names))
                counts = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = lists.flatten()
                start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("start_ms", "end_ms"))
                long = end - start >= least_ms
                counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[long], minlength=len(counts))
                at, texts = np.concatenate([[0], np.cumsum(counts)]), flat.field("text").filter(pa.array(long))
                start, end = _smoothed(at, start[long], end[long])
                none, said = counts == 0, texts.to_pylist()
                said = [" ".join(said[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if not whole:
                    edge = np.unique(np.concatenate([at[:-1][~none], at[1:][~none] - 1]))
                    texts, start, end = texts.take(pa.array(edge, pa.int64())), start[edge], end[edge]
                    at = np.concatenate([[0], np.cumsum(np.minimum(counts, 2))])
                timed = pa.StructArray.from_arrays([texts, pa.array(start), pa.array(end)], ["text", "start_ms", "end_ms"])
                words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), timed, mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(names))), pa.array(counts, pa.int32()), words, pa.array(said, pa.string())], [*names, "n_words", "words", "said"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", text string, start_ms double, end_ms double, n_words int, words array<struct<text:string,start_ms:double,end_ms:double>>, said string"
    timed = F.col("words").cast("array<struct<text:string,start_ms:double,end_ms:double>>")
    return segments.select(*key, "text", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), timed.alias("words")).mapInArrow(run, schema)


def normalize_segments(segments: DataFrame, words: DataFrame | None, regions: DataFrame, by: list[str], segment: str, place: str, least_ms: float = 50, tolerance: float = 250, deloop: bool = True, whole: bool = True) -> DataFrame:
    """Recognised segments cleaned: (by, segment, text, start_ms, end_ms, words).

    Words (by, segment, place, text, start_ms, end_ms) that are too short go, times are smoothed and drawn to the edges of
    speech, boilerplate goes, and a segment with words takes text and times from them. One without keeps its text, its loops
    (with `deloop`) said once, and its words are null. With `words` None each segment has its own as an array `words`, which are
    not shuffled to it; there is `n_words` then, and without `whole` only the first and the last word go on.
    """
    key = [*by, segment]
    plain = quality.deloop("text") if deloop else F.col("text")
    if words is None:
        own = _own_words(segments, key, least_ms, whole)
        said = own.withColumn("text", F.when(F.col("words").isNotNull(), F.col("said")).otherwise(plain)).drop("said")
    else:
        kept = smooth_timings(drop_micro_words(words, least_ms).select(*key, place, "text", "start_ms", "end_ms"), key, [place])
        entry = F.struct(F.col(place).alias("o"), F.col("text").alias("t"), F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"))
        held = kept.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_w")).select(*key, F.transform("_w", lambda w: F.struct(w["t"].alias("text"), w["s"].alias("start_ms"), w["e"].alias("end_ms"))).alias("words"))
        ready = segments.select(*key, "text", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms")).join(held, key, "left")
        said = ready.withColumn("text", F.when(F.col("words").isNotNull(), F.array_join(F.transform("words", lambda w: w["text"]), " ")).otherwise(plain))
    snapped = snap_to_regions(said, regions, by, [segment], tolerance).where(~quality.hallucinated("text"))
    ends = {"start_ms": F.element_at("words", 1)["start_ms"], "end_ms": F.element_at("words", -1)["end_ms"]}
    return snapped.withColumns({c: F.when(F.col("words").isNotNull(), v).otherwise(F.col(c)) for c, v in ends.items()})


def zip_by_place(left: DataFrame, right: DataFrame, by: list[str], place: str, **fallback: Column) -> DataFrame:
    """Rows of equal place together; where the right has none, its columns take the fallback."""
    joined = left.join(right, [*by, place], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in fallback.items()})


def percentile_floor(rows: DataFrame, by: list[str], value: str, fraction: float, name: str = "percentile") -> DataFrame:
    """The value at the place floor(fraction * (n - 1)) of the sorted values of a group, found by rank."""
    told = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(_over(by, [value]))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return told.where(F.col("_r") == F.floor(F.lit(fraction) * (F.col("_n") - 1)) + 1).select(*by, F.col(value).alias(name))


def lexicon(words: DataFrame, entries: DataFrame, word: str = "word", reading: str = "reading", small: int = 1 << 20) -> DataFrame:
    """Each word's reading, or itself where the dictionary has none; a dictionary of at most `small` rows is broadcast."""
    one = entries.groupBy(word).agg(F.min(reading).alias(reading))
    side = F.broadcast(one) if entries.count() <= small else one
    return words.join(side, word, "left").withColumn(reading, F.coalesce(reading, word))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
