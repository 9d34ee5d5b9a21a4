"""Steps that depend on the step before, over the rows of each medium in order: Arrow in, Arrow out, whole media at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes the rows of whole media in order and where each medium begins (its last entry is the number of rows).
Make = Callable[[pa.Table, np.ndarray], pa.RecordBatch]


def begins(column: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end of the last."""
    x = column.to_numpy()
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).astype(np.int64) if len(x) else np.zeros(1, np.int64)


def by_medium(rows: DataFrame, by: list[str], order: list[str], make: Make, schema: str) -> DataFrame:
    """`make` over the media of `rows`, which are dealt by medium and sorted; a task holds one medium and one batch at a time."""
    dealt = rows.withColumn("_medium", F.xxhash64(*by)).repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the medium that the batches so far end in
        for batch in batches:
            if not batch.num_rows:
                continue
            medium = batch.column(batch.schema.names.index("_medium"))
            at = begins(pa.chunked_array([medium]))
            goes_on = bool(held) and held[-1].column("_medium")[-1].as_py() == medium[0].as_py()
            if len(at) == 2 and (goes_on or not held):
                held.append(batch)
                continue
            last = int(at[-2])
            whole = pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])])
            held = [batch.slice(last)]
            yield make(whole.combine_chunks(), begins(whole["_medium"]))
        if held:
            whole = pa.Table.from_batches(held)
            yield make(whole.combine_chunks(), begins(whole["_medium"]))

    return dealt.mapInArrow(run, schema)


def in_order(rows: DataFrame, by: list[str], order: list[str], begin: Callable[[], object], take: Callable[[object, dict], Iterator[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """What `take` gives for each row of each medium in order, with what `begin` has made for the medium; a task holds that and one batch.

    `take` need not name the medium: its keys are added.
    """
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches):
        now, state, first = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in by)
                if first or key != now:
                    now, state, first = key, begin(), False
                out += [dict(zip(by, key, strict=True)) | e for e in take(state, row)]
            yield pa.RecordBatch.from_pylist(out, types)

    return dealt.mapInArrow(run, schema)
