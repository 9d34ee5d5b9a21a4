"""Event time with a reorder buffer: rows wait in keyed state until the watermark has passed them, then take effect in order.

The rows of a key that come in one micro-batch wait together, as blocks of arrays in a map state; a timer fires when the watermark
passes the earliest of them. All rows whose time it has passed are then applied in the order of (time, number), and the others
wait on as blocks. So what a key costs hangs on its micro-batches, not on its rows. A row that would stand before one that has been
applied is late: it changes nothing and comes out as a row of its own with a running count. The time column that goes to
the operator is a plain number, so Spark itself drops no row by its watermark.

State of a key: the rows of the watermark's delay and one row of scalars. A key that is idle for `idle_ms` of event time
leaves the state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_BEGINNING = -(1 << 62)
#: Rows that wait as one value of the map state.
BLOCK = 256


def stated(value):
    """A value of a data frame as state takes it: numpy's scalars as Python's, missing ones as None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if value is None or (isinstance(value, float) and value != value) else value


@contextmanager
def by_value() -> Iterator[None]:
    """For making a stateful operator: the worker beside the driver that sets its state up sees no package that was sent to the executors."""
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


class InOrder(StatefulProcessor):
    """Rows with `at_ms` (event time) and `no` applied in order; `columns` are what is kept of a row that waits.

    No name may begin with an underscore: Spark gives such columns other names on their way to a processor.
    """

    def __init__(self, columns: dict[str, str], results: list[str], idle_ms: int | None):
        self.columns, self.results, self.idle_ms = columns, results, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", ", ".join(["at_ms array<long>", "no array<long>", *(f"`{c}` array<{t}>" for c, t in self.columns.items())]))
        self.reached = handle.getValueState("reached", "ts long, seq long, late long, applied long, done long, blocks long")

    def apply(self, key: tuple, rows: list[dict], n: int) -> Iterator[dict]:
        """Results of rows whose turn it is; `n` rows of the key came before them."""
        raise NotImplementedError

    def late(self, key: tuple, row: dict, count: int) -> dict:
        """What becomes of the count-th row that comes too late."""
        raise NotImplementedError

    def forget(self) -> None:
        """Lets go of further state of a key that has been idle."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, seq, late, applied, done, blocks = self.reached.get() or (_BEGINNING, _BEGINNING, 0, 0, _BEGINNING, 0)
        out, held = [], {}
        for batch in rows:
            for at_ms, no, *values in zip(*(batch[c].tolist() for c in ("at_ms", "no", *self.columns)), strict=True):
                if (at_ms, no) <= (ts, seq):
                    late += 1
                    out.append(self.late(key, dict(zip(self.columns, values, strict=True)) | {"at_ms": at_ms, "no": no}, late))
                else:
                    held[at_ms, no] = [stated(v) for v in values]
        blocks = self._wait(held, blocks)
        self.reached.update((ts, seq, late, applied, done, blocks))
        if out:
            yield self._framed(out)

    def _wait(self, held: dict[tuple[int, int], list], blocks: int) -> int:
        """Rows by (time, number) as new blocks, and a timer for the earliest; the number of the next block."""
        at = sorted(held)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            columns = zip(*(held[a] for a in part), strict=True) if self.columns else ()
            self.waiting.updateValue((blocks,), ([a for a, _ in part], [n for _, n in part], *map(list, columns)))
            blocks += 1
        if at:
            self.handle.registerTimer(at[0][0])
        return blocks

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, reached = expiredTimerInfo.getExpiryTimeInMs(), self.reached.get()
        if reached is None:
            return
        ts, seq, late, applied, done, blocks = reached
        idle = self.idle_ms is not None and ts + self.idle_ms <= due
        if due <= done and not idle:
            return  # the first timer of a micro-batch has done all that is due
        done = max(due, timerValues.getCurrentWatermarkInMs() - 1)
        stood, held = sorted((tuple(k)[0], tuple(v)) for k, v in self.waiting.iterator()), {}
        for _, (at_ms, no, *columns) in stood:  # of rows with one time and number that in the later block counts
            held |= dict(zip(zip(at_ms, no, strict=True), map(list, zip(*columns, strict=True)) if columns else [[]] * len(no), strict=True))
        ready = sorted(at for at in held if at[0] <= done)
        if ready:
            rows = [dict(zip(self.columns, held.pop(at), strict=True)) | {"at_ms": at[0], "no": at[1]} for at in ready]
            for block, _ in stood:
                self.waiting.removeKey((block,))
            blocks = self._wait(held, blocks)
            ts, seq = ready[-1]
            if self.idle_ms is not None:
                self.handle.registerTimer(ts + self.idle_ms)
        if not ready and idle and not held:
            self.reached.clear()
            self.forget()
            return
        self.reached.update((ts, seq, late, applied + len(ready), done, blocks))
        if ready and (out := list(self.apply(key, rows, applied))):
            yield self._framed(out)

    def _framed(self, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[c] for r in out], dtype=object) for c in self.results}, columns=self.results)

    def close(self) -> None:
        pass


def watermarked(stream: DataFrame, key: list[str], ts: str, seq: str, columns: dict[str, str], delay: str) -> DataFrame:
    """key, at_ms, no and `columns` (new names to those of the stream), with a watermark on `ts`; rows without a key, time or number are left out."""
    told = stream.withWatermark(ts, delay)
    # a copy of the time: the column itself would make Spark drop late rows before the operator can count them
    copy = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp"))).cast(dict(stream.dtypes)[ts])
    plain = told.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.col(seq).cast("long").alias("no"), *((copy if c == ts else F.col(c)).alias(n) for n, c in columns.items()))
    return plain.dropna(subset=[*(f"k{i}" for i in range(len(key))), "at_ms", "no"])


class _Numbered(InOrder):
    def __init__(self, keys: int, columns: dict[str, str], idle_ms: int | None):
        super().__init__(columns, [*(f"k{i}" for i in range(keys)), *columns, "place", "n_late"], idle_ms)

    def _row(self, key, row, place, n_late):
        return {f"k{i}": k for i, k in enumerate(key)} | {c: stated(row[c]) for c in self.columns} | {"place": place, "n_late": n_late}

    def apply(self, key, rows, n):
        return (self._row(key, row, i, None) for i, row in enumerate(rows, n + 1))

    def late(self, key, row, count):
        return self._row(key, row, None, count)


def in_order(stream: DataFrame, key: list[str], ts: str, seq: str, delay: str, idle_ms: int | None = None) -> DataFrame:
    """The rows of a stream by key in the order of (ts, seq), numbered from 1 (`place`); late ones have a running count (`n_late`) instead.

    Of rows with one key, time and number the last to come before its turn counts.
    """
    types = dict(stream.dtypes)
    names = {f"c{i}": c for i, c in enumerate(c for c in stream.columns if c not in key)}
    rows = watermarked(stream, key, ts, seq, names, delay)
    schema = ", ".join([*(f"k{i} {types[k]}" for i, k in enumerate(key)), *(f"{n} {types[c]}" for n, c in names.items())]) + ", place long, n_late long"
    with by_value():
        out = rows.groupBy(*(f"k{i}" for i in range(len(key)))).transformWithStateInPandas(_Numbered(len(key), {n: types[c] for n, c in names.items()}, idle_ms), schema, "Append", "EventTime")
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(key)), *(F.col(n).alias(c) for n, c in names.items()), "place", "n_late")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream of the operators above over what is there now, into Parquet at `path`, and gives what came out.

    State of several variables needs the RocksDB store; the session's own settings come back afterwards.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)
