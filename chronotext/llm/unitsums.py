"""Sums over the units (pre-tokens) of every text, where what a unit counts for is found once per distinct unit.

1. Vocabulary: the distinct units of the corpus with their frequencies, each given its measures once, as a table.
2. Frequencies: per document and unit. Those of the most frequent units (at most `hot` of them, so what is broadcast has
   a fixed bound whatever the corpus) are weighted and added up in place; all others are rows (document, unit, count).
3. Those rows meet the vocabulary in an equi-join on the unit, and are added up by document. No unit that is frequent
   enough to make a partition hot takes part in the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hottest, named_apart, stored, tidy

#: Most units that are broadcast.
HOT_UNITS = 1 << 18
#: Units and counts that a task holds before it hands partial counts on.
PARTIAL_UNITS = 200_000

#: From a column of whole texts to runs of (first row, first unit of each row, units).
Splitter = Callable[[pa.Array], Iterator[tuple[int, np.ndarray, pa.Array]]]


def together(runs: Iterator[tuple[int, np.ndarray, pa.Array]], most: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Consecutive runs as one, up to `most` bytes of units: a lookup in the broadcast units has a cost of its own."""
    held, size = [], 0

    def one() -> tuple[int, np.ndarray, pa.Array]:
        firsts, base = [np.zeros(1, np.int64)], 0
        for _, first, units in held:
            firsts.append(first[1:] + base)
            base += len(units)
        return held[0][0], np.concatenate(firsts), pa.concat_arrays([u for _, _, u in held])

    for run in runs:
        held.append(run)
        size += run[2].nbytes
        if size >= most:
            yield one()
            held, size = [], 0
    if held:
        yield one()


def vocabulary(docs: DataFrame, text: str, split: Splitter) -> DataFrame:
    """(unit, n): the distinct units of all texts and how often they occur."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, units in split(batch.column(0)):
                coded = pc.value_counts(units)
                held.append(pa.table({"unit": coded.field("values"), "n": coded.field("counts")}))
                size += len(coded)
                if size > PARTIAL_UNITS:
                    yield from _merged(held)
                    held, size = [], 0
        if held:
            yield from _merged(held)

    return docs.select(text).mapInArrow(tidy(count), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _merged(held: list[pa.Table]) -> list[pa.RecordBatch]:
    both = pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"unit": both["unit"].cast(pa.string()), "n": both["n_sum"].cast(pa.int64())}).combine_chunks().to_batches(max_chunksize=50_000)


def weighted_sums(docs: DataFrame, known: DataFrame, measures: list[str], split: Splitter, key: str = "doc_id", text: str = "text", hot: int = HOT_UNITS) -> DataFrame:
    """One row per row of `docs`: its key, n_bytes, and the sum over its units of each measure (long) of `known` (unit, n, measures).

    `known` must have every unit that occurs. Null and empty texts have sums of 0.
    """
    named_apart(key, ["n_bytes", *measures])
    given, key = key, "own_key"
    docs = docs.select(F.col(given).alias(key), F.col(text).alias("own_text"))
    text = "own_text"
    least = hottest(known, hot)
    table = known.where(F.col("n") >= least).select("unit", *measures).toArrow()
    words = table["unit"].combine_chunks().cast(pa.string())
    weights = np.array([table[m].to_numpy() for m in measures], np.int64).reshape(len(measures), -1)
    hot_units = docs.sparkSession.sparkContext.broadcast((words, weights))
    kind = docs.schema[key].dataType.simpleString()
    outs = ", ".join(f"{m} long" for m in measures)

    def spread(batches):
        words, weights = hot_units.value
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = batch.column(0), pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
            for row, first, units in together(split(batch.column(1))):
                n_rows = len(first) - 1
                coded = units.dictionary_encode()
                codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                at = pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                text_of = np.repeat(np.arange(n_rows), np.diff(first))
                rid = (task << 40) + number + np.arange(n_rows)
                own = at[codes] if len(codes) else np.zeros(0, np.int64)
                warm = own >= 0
                sums = []
                for w in weights:
                    total = np.zeros(n_rows + 1, np.int64)
                    values = np.where(warm, w[own], 0) if len(w) else np.zeros(len(own), np.int64)
                    with np.errstate(over="ignore"):
                        run = np.concatenate([[0], np.cumsum(values)])
                        total = run[first[1:]] - run[first[:-1]]
                    sums.append(total)
                yield pa.record_batch([
                    pa.array(rid), pa.array([f" {x}" for x in rid.tolist()], pa.string()), ids.slice(row, n_rows), pa.array(sizes[row : row + n_rows].astype(np.int64)), pa.array(np.ones(n_rows, np.int64)), *(pa.array(s) for s in sums)
                ], ["rid", "unit", key, "n_bytes", "freq", *(f"own_{m}" for m in measures)])
                cold = np.flatnonzero(~warm)
                if len(cold):
                    pairs, freq = np.unique(text_of[cold] * len(distinct) + codes[cold], return_counts=True)
                    none = lambda t, m=len(pairs): pa.nulls(m, t)
                    yield pa.record_batch([
                        pa.array(rid[pairs // len(distinct)]), distinct.take(pa.array(pairs % len(distinct))).cast(pa.string()), none(ids.type), none(pa.int64()), pa.array(freq.astype(np.int64)), *(none(pa.int64()) for _ in measures)
                    ], ["rid", "unit", key, "n_bytes", "freq", *(f"own_{m}" for m in measures)])
                number += n_rows

    # a row of a document itself stands under a unit that no text has, so that these rows spread as well
    rows = docs.select(key, text).mapInArrow(tidy(spread), f"rid long, unit string, {key} {kind}, n_bytes long, freq long, " + ", ".join(f"own_{m} long" for m in measures))
    joined = rows.join(known.where(F.col("n") < least).select("unit", *measures), "unit", "left")
    # sums of hashes wrap around, as a checksum may
    each = [F.coalesce(F.col(f"own_{m}"), F.call_function("try_multiply", F.col("freq"), F.col(m)), F.lit(0).cast("long")).alias(f"v_{m}") for m in measures]
    itself = F.col("n_bytes").isNotNull()
    summed = joined.select("rid", key, "n_bytes", itself.alias("itself"), *each).groupBy("rid").agg(F.first(F.when(F.col("itself"), F.col(key)), ignorenulls=True).alias(key), F.max("n_bytes").alias("n_bytes"), *(F.sum(f"v_{m}").alias(m) for m in measures)).select(key, "n_bytes", *measures)
    return stored(summed.withColumnRenamed(key, given), "sums")
