"""Hypotheses of whole texts, a text at a time: what neighbouring ones share, and what one repeats of the one before.

functions.streams compares two texts of a row. Here a text is split once, its hypotheses are parts of one list of words, and
no window is written out before it is compared; rows stay where they are, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..streaming.live import token_key
from .packing import spaced

#: Rows of a batch that goes back to Spark.
ROWS = 1 << 14


def shared(before: list[str], after: list[str]) -> int:
    """How many first words two hypotheses share."""
    n = 0
    for a, b in zip(before, after):  # noqa: B905
        if a != b and token_key(a) != token_key(b):
            break
        n += 1
    return n


def repeated(before: list[str], after: list[str]) -> int:
    """With how many of its first words, as many as possible, a hypothesis says again what the one before ends with; by keys (token_key)."""
    m = len(before)
    for k in range(min(m, len(after)), 0, -1):
        if before[m - k] == after[0] and before[m - k :] == after[:k]:
            return k
    return 0


def by_text(texts: DataFrame, by: list[str], each: Callable[[list[str]], Iterator[tuple]], results: dict[str, str], text: str = "text") -> DataFrame:
    """(by, results): the rows that `each` gives for the words of a text; none for a text without words. `results` are names and types (int, string)."""
    types, arrow = dict(texts.dtypes), {"int": pa.int32(), "string": pa.string()}
    kinds = [arrow[t] for t in results.values()]

    def run(batches):
        for batch in batches:
            said = batch.column(len(by))
            rows, whose = [], []

            def out(rows=rows, whose=whose, batch=batch):
                keys = [batch.column(i).take(pa.array(whose, pa.int64())) for i in range(len(by))]
                made = pa.RecordBatch.from_arrays([*keys, *map(pa.array, zip(*rows, strict=True), kinds)], [*by, *results])
                rows.clear(), whose.clear()
                return made

            for i in range(batch.num_rows):
                for row in each(spaced(said[i].as_py() or "")):
                    rows.append(row)
                    whose.append(i)
                    if len(rows) == ROWS:
                        yield out()
            if rows:
                yield out()

    return texts.select(*by, text).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*((k, types[k]) for k in by), *results.items()]))
