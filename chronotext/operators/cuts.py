"""Greedy cuts of media of any length, in many tasks: links to the next cut, composed by pointer doubling.

Where a run of rows ends hangs on where it begins, so a walk is one task for a medium. Here each row gets a link to the row
at which the next run would begin if one began with it. The rows of a medium are numbered and dealt to chunks of `chunk`
rows; of a chunk only the links that lead out of it matter, and only for the rows a run from the chunk before can end at.
Those few links are composed by doubling, which tells with which row each chunk is entered, and each chunk is then walked on
its own. A medium of n rows costs a range sort, two passes, and log2(n / chunk) joins of about n / chunk rows.

No run may be longer than `most_rows`, and `chunk` is more than that: a chunk sees so many rows of the next one as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .media_runs import begins

CHUNK = 1 << 16

#: From the rows of a chunk and those that follow to the place where the run that begins with each row ends (at most all of them).
Reach = Callable[[pa.Table], np.ndarray]


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "no", flag: str | None = None) -> DataFrame:
    """`rows` with a number from 0 without gaps in each medium, in `order` (rows that tie come in any order).

    With a boolean column `flag`, `flagged` counts the rows so far for which it holds, the row itself included. One range
    sort; what is broadcast is a row for each partition that goes on with a medium of the one before, at most.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*by, *order, "_tie"]
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_medium": F.xxhash64(*by), "_flag": F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)})

    def count(batches):
        last, seen, flags = None, 0, 0
        for batch in batches:
            names = batch.schema.names
            medium, held = batch.column(names.index("_medium")).to_numpy(), batch.column(names.index("_flag")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = begins(pa.chunked_array([batch.column(names.index("_medium"))]))
            place, so_far = np.arange(batch.num_rows) - np.repeat(at[:-1], np.diff(at)), np.cumsum(held)
            so_far = so_far - np.repeat(so_far[at[:-1]] - held[at[:-1]], np.diff(at)) if batch.num_rows else so_far
            if batch.num_rows:
                if medium[0] == last:
                    place[: at[1]] += seen
                    so_far[: at[1]] += flags
                last, seen, flags = medium[-1], int(place[-1]) + 1, int(so_far[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64)), pa.array(so_far.astype(np.int64))], [*names, "_place", "_flags"])

    schema = ", ".join(f"`{c}` {t}" for c, t in [*dealt.dtypes, ("_place", "bigint"), ("_flags", "bigint")])
    placed = stored(dealt.mapInArrow(count, schema).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.max("_flags").alias("_f"))
    earlier = Window.partitionBy(*by).orderBy("_part")
    before = sizes.withColumns({"_before": F.sum("_n").over(earlier) - F.col("_n"), "_held": F.sum("_f").over(earlier) - F.col("_f")}).where("_before > 0")
    goes_on = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), "_before", "_held")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    told = placed.join(F.broadcast(goes_on), [F.col("_part") == F.col("_p"), *same], "left")
    more = [(F.col("_flags") + F.coalesce("_held", F.lit(0))).cast("long").alias("flagged")] if flag else []
    return told.select(*rows.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias(name), *more)


def _chunks(table: DataFrame, by: list[str], chunk: int, most_rows: int) -> DataFrame:
    """Rows under their chunk, the first of each chunk under the one before as well."""
    own = F.floor(F.col("no") / chunk)
    also = F.when((own > 0) & (F.col("no") % chunk < most_rows), F.array(own, own - 1)).otherwise(F.array(own))
    return table.withColumn("_chunk", F.explode(also)).repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "no").withColumn("_cell", F.xxhash64(*by, "_chunk"))


def _each_chunk(cells: DataFrame, make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = begins(pa.chunked_array([batch.column(batch.schema.names.index("_cell"))]))
            if held and batch.num_rows and held[-1].column("_cell")[-1].as_py() != batch.column("_cell")[0].as_py():
                yield make(pa.Table.from_batches(held).combine_chunks())
                held = []
            for a, b in zip(at[:-2].tolist(), at[1:-1].tolist(), strict=True):
                held.append(batch.slice(a, b - a))
                yield make(pa.Table.from_batches(held).combine_chunks())
                held = []
            if batch.num_rows:
                held.append(batch.slice(int(at[-2])))
        if held:
            yield make(pa.Table.from_batches(held).combine_chunks())

    return cells.mapInArrow(run, schema)


def greedy(rows: DataFrame, by: list[str], order: list[str], reach: Reach, columns: list[str], most_rows: int, name: str = "block", chunk: int = CHUNK) -> DataFrame:
    """`rows` with the number of their run, from 0 in each medium. `reach` sees `columns` of consecutive rows."""
    if chunk <= most_rows:
        raise ValueError("a chunk must be longer than a run")
    table = stored(numbered(rows, by, order), "rows")
    types = dict(table.dtypes)
    keys = ", ".join(f"`{k}` {types[k]}" for k in by)

    def next_cut(cell: pa.Table) -> tuple[np.ndarray, int, int]:
        """Links as numbers of rows, for the rows of the chunk itself, and its first number and end."""
        no = cell["no"].to_numpy()
        first = int(cell["_chunk"][0].as_py()) * chunk
        own = int(np.searchsorted(no, first + chunk))
        return reach(cell)[:own] + no[0], first, first + own

    def leave(cell: pa.Table) -> pa.RecordBatch:
        link, first, end = next_cut(cell)
        out = link.copy()
        while (inside := out < end).any():
            out[inside] = out[out[inside] - first]
        few = min(most_rows, len(out))
        return pa.RecordBatch.from_arrays([*(cell[k].slice(0, few).combine_chunks() for k in by), pa.array(np.arange(first, first + few)), pa.array(out[:few].astype(np.int64))], [*by, "at", "to"])

    most = table.agg(F.max("no").alias("no")).first()["no"]
    long = (most or 0) >= chunk
    cells = _chunks(table.select(*by, "no", *columns), by, chunk, most_rows)
    entries = None
    if long:
        # of media of more than one chunk, what enters each
        links = stored(_each_chunk(cells, leave, f"{keys}, at bigint, to bigint"), "links")
        entries = stored(links.where("at = 0").select(*by, "at"), "entries")
        for _ in range(math.ceil(math.log2(most // chunk + 1))):
            there = entries.join(links, [*by, "at"]).select(*by, F.col("to").alias("at"))
            entries = stored(entries.unionByName(there).distinct(), "entries")
            onward = links.select(*by, F.col("at").alias("to"), F.col("to").alias("then"))
            links = stored(links.join(onward, [*by, "to"], "left").select(*by, "at", F.coalesce("then", "to").alias("to")), "links")
    entered = table.select(*by, "no", *columns)
    if entries is not None:
        told = entries.select(*by, F.floor(F.col("at") / chunk).alias("_chunk"), F.col("at").alias("_entry")).groupBy(*by, "_chunk").agg(F.min("_entry").alias("_entry"))
        cells = _chunks(entered, by, chunk, most_rows).drop("_cell").join(told, [*by, "_chunk"], "left").repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "no").withColumn("_cell", F.xxhash64(*by, "_chunk"))
    else:
        cells = cells.withColumn("_entry", F.lit(0).cast("long"))

    def walk(cell: pa.Table) -> pa.RecordBatch:
        link, first, end = next_cut(cell)
        starts = np.zeros(end - first, np.int64)
        at, links = cell["_entry"][0].as_py(), link.tolist()
        while at is not None and at < end:
            starts[at - first] = 1
            at = links[at - first]
        n = end - first
        return pa.RecordBatch.from_arrays([*(cell[k].slice(0, n).combine_chunks() for k in by), pa.array(np.full(n, first // chunk)), pa.array(np.arange(first, end)), pa.array(np.cumsum(starts))], [*by, "_chunk", "no", "_run"])

    walked = stored(_each_chunk(cells, walk, f"{keys}, _chunk bigint, no bigint, _run bigint"), "walked")
    if long:
        each = walked.groupBy(*by, "_chunk").agg(F.max("_run").alias("_runs"))
        before = each.select(*by, "_chunk", (F.sum("_runs").over(Window.partitionBy(*by).orderBy("_chunk")) - F.col("_runs")).alias("_earlier")).where("_earlier > 0")
        walked = walked.join(before, [*by, "_chunk"], "left").withColumn("_run", F.col("_run") + F.coalesce("_earlier", F.lit(0)))
    return table.join(walked.select(*by, "no", (F.col("_run") - 1).cast("int").alias(name)), [*by, "no"]).select(*rows.columns, name)


def by_size(size: str, most: int, most_size: int) -> Reach:
    """Runs of at most `most` rows and `most_size` in all; a larger row is a run of its own."""

    def reach(cell: pa.Table) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(cell[size].to_numpy())])
        n = len(sums) - 1
        i = np.arange(n)
        fits = np.searchsorted(sums, sums[:-1] + most_size, side="right") - 1
        return np.maximum(i + 1, np.minimum(np.minimum(i + most, fits), n))

    return reach


def by_capacity(length: str, closes: str, capacity: int) -> Reach:
    """Runs of words that, with a space between them, fit in `capacity`; one ends after a word that `closes`, from a quarter full on."""

    def reach(cell: pa.Table) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(cell[length].to_numpy() + 1)])
        n = len(sums) - 1
        i = np.arange(n)
        over = np.maximum(i + 1, np.searchsorted(sums, sums[:-1] + 1 + capacity, side="right") - 1)
        if capacity <= 0:
            return np.minimum(over, n)
        # the first word that closes, from the one on that makes the run a quarter full
        closing = np.where(cell[closes].to_numpy(zero_copy_only=False).astype(bool), i, n)
        following = np.append(np.minimum.accumulate(closing[::-1])[::-1], n)
        quarter = np.maximum(i, np.searchsorted(sums, sums[:-1] + 1 + capacity / 4, side="left") - 1)
        return np.minimum(np.minimum(over, following[np.minimum(quarter, n)] + 1), n)

    return reach


def cue_blocks(cues: DataFrame, by: list[str], order: list[str], size: str, most: int = 6, most_chars: int = 400, chunk: int = CHUNK) -> DataFrame:
    """Blocks of cues as packing.cue_blocks() makes them, for media of any length; `size` is the column of each cue's characters."""
    return greedy(cues, by, order, by_size(size, most, most_chars), [size], most, chunk=chunk)


def word_runs(words: DataFrame, by: list[str], order: list[str], length: str, closes: str, capacity: int, chunk: int = CHUNK) -> DataFrame:
    """Runs of words as packing.pack() makes them of words with spaces, for media of any length."""
    return greedy(words, by, order, by_capacity(length, closes, capacity), [length, closes], capacity + 2, name="run", chunk=chunk)
