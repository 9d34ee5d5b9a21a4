"""Linear recurrences and trailing order statistics over media of any length, in many tasks.

A recurrence s' = M s + v x is an affine map of the state, and maps compose: a chunk of rows is reduced to one map, the maps
of a medium are composed by doubling (log2 of its chunks joins), and each chunk then runs from the state that enters it.
Within a chunk blocks of samples are reduced and composed in the same way, by matrix products.

A trailing percentile looks back over a bounded number of rows, so chunks carry so many rows of the one before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .cuts import CHUNK, _each_chunk, numbered

BLOCK = 64


def powers(m: np.ndarray, n: int) -> np.ndarray:
    """m^0 to m^n."""
    out = [np.eye(len(m))]
    for _ in range(n):
        out.append(out[-1] @ m)
    return np.stack(out)


def affine_states(m: np.ndarray, v: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The states before each of the inputs x (rows) and after the last: s' = m s + v x, from `start`."""
    m, v, x, start = (np.asarray(a, np.float64) for a in (m, v, x, start))
    n, d, k = len(x), len(m), x.shape[1]
    if n == 0:
        return start[None, :]
    size = min(BLOCK, n)
    blocks = -(-n // size)
    p = powers(m, size)
    fed = np.zeros((blocks * size, k))
    fed[:n] = x
    fed = fed.reshape(blocks, size * k)
    # what input i adds to the state before input j > i of its block, and to the one behind the block
    step = np.zeros((size, k, size + 1, d))
    for i in range(size):
        step[i, :, i + 1 :, :] = np.einsum("jde,ek->kjd", p[: size - i], v)
    own = (fed @ step.reshape(size * k, -1)).reshape(blocks, size + 1, d)
    entry = start[None, :] if blocks == 1 else affine_states(p[size], np.eye(d), own[:-1, size], start)
    states = own + np.einsum("jde,be->bjd", p, entry)
    last = n - (blocks - 1) * size
    return np.concatenate([states[:, :size].reshape(-1, d)[:n], states[-1:, last]])


def decayed(keep: float, x: np.ndarray) -> np.ndarray:
    """y' = keep y + x down the rows of x, for each column, from 0: blocks of rows by one matrix, joined by what each leaves."""
    n = len(x)
    if n == 0:
        return x
    size = min(BLOCK, n)
    fed = np.zeros((-(-n // size) * size, x.shape[1]))
    fed[:n] = x
    away = np.subtract.outer(np.arange(size), np.arange(size))
    own = np.einsum("ij,bjc->bic", np.where(away >= 0, keep ** np.maximum(away, 0), 0.0), fed.reshape(-1, size, x.shape[1]))
    left = np.zeros((len(own), x.shape[1]))
    if len(own) > 1:
        left[1:] = decayed(keep**size, own[:-1, -1])
    return (own + keep ** np.arange(1, size + 1)[None, :, None] * left[:, None, :]).reshape(-1, x.shape[1])[:n]


def affine_scan(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], m: np.ndarray, v: np.ndarray, names: list[str], chunk: int = CHUNK) -> DataFrame:
    """`rows` with the state after each row, one column for each of `names`; a null input counts as 0, and all states begin at 0."""
    m, v = np.asarray(m, np.float64), np.asarray(v, np.float64)
    d = len(m)
    table = stored(numbered(rows, by, order), "rows")
    types = dict(table.dtypes)
    keys = ", ".join(f"`{k}` {types[k]}" for k in by)
    told = table.select(*by, "no", F.floor(F.col("no") / chunk).alias("_chunk"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs)).alias("_x"))
    dealt = lambda t: t.repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "no").withColumn("_cell", F.xxhash64(*by, "_chunk"))
    most = table.agg(F.max("no").alias("no")).first()["no"] or 0

    def x_of(cell: pa.Table) -> np.ndarray:
        return cell["_x"].combine_chunks().flatten().to_numpy().reshape(-1, len(inputs)) if isinstance(cell["_x"], pa.ChunkedArray) else cell["_x"].flatten().to_numpy().reshape(-1, len(inputs))

    entered = told.withColumn("_start", F.array(*[F.lit(0.0)] * d))
    if most >= chunk:

        def reduce(cell: pa.Table) -> pa.RecordBatch:
            x = x_of(cell)
            one = np.linalg.matrix_power(m, len(x))
            return pa.RecordBatch.from_arrays([*(cell[k].slice(0, 1).combine_chunks() for k in by), cell["_chunk"].slice(0, 1).combine_chunks(), pa.array([one.ravel().tolist()]), pa.array([affine_states(m, v, x, np.zeros(d))[-1].tolist()])], [*by, "_chunk", "_map", "_add"])

        maps = stored(_each_chunk(dealt(told), reduce, f"{keys}, _chunk bigint, _map array<double>, _add array<double>"), "maps")
        dot = lambda a, row, b: sum((F.col(a)[row * d + k] * F.col(b)[k] for k in range(d)), F.lit(0.0))
        for i in range(math.ceil(math.log2(most // chunk + 1))):
            # the map of each chunk behind that of the one 2^i before: together they reach twice as far back
            back = maps.select(*by, (F.col("_chunk") + (1 << i)).alias("_chunk"), F.col("_map").alias("_map0"), F.col("_add").alias("_add0"))
            both = maps.join(back, [*by, "_chunk"], "left")
            product = F.array(*(sum((F.col("_map")[r * d + k] * F.col("_map0")[k * d + c] for k in range(d)), F.lit(0.0)) for r in range(d) for c in range(d)))
            added = F.array(*(dot("_map", r, "_add0") + F.col("_add")[r] for r in range(d)))
            there = F.col("_map0").isNotNull()
            maps = stored(both.select(*by, "_chunk", F.when(there, product).otherwise(F.col("_map")).alias("_map"), F.when(there, added).otherwise(F.col("_add")).alias("_add")), "maps")
        starts = maps.select(*by, (F.col("_chunk") + 1).alias("_chunk"), F.col("_add").alias("_start0"))
        entered = entered.join(starts, [*by, "_chunk"], "left").withColumn("_start", F.coalesce("_start0", "_start")).drop("_start0")

    def run(cell: pa.Table) -> pa.RecordBatch:
        states = affine_states(m, v, x_of(cell), np.array(cell["_start"][0].as_py()))[1:]
        return pa.RecordBatch.from_arrays([*(cell[k].combine_chunks() for k in by), cell["no"].combine_chunks(), *(pa.array(states[:, i]) for i in range(d))], [*by, "no", *names])

    out = _each_chunk(dealt(entered), run, f"{keys}, no bigint, " + ", ".join(f"`{n}` double" for n in names))
    return table.join(out, [*by, "no"]).select(*rows.columns, *names)


def biquad_highpass(rate: float, hz: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(m, v, b0) of a second-order Butterworth high-pass: y = b0 x + s[0] with the state before x."""
    w = 2 * np.pi * hz / rate
    alpha, c = np.sin(w) / np.sqrt(2), np.cos(w)
    b0, b1, b2 = (1 + c) / 2 / (1 + alpha), -(1 + c) / (1 + alpha), (1 + c) / 2 / (1 + alpha)
    a1, a2 = -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)
    return np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([[b1 - a1 * b0], [b2 - a2 * b0]]), float(b0)


def high_pass(rows: DataFrame, by: list[str], order: list[str], value: str, rate: float, hz: float, name: str = "high", chunk: int = CHUNK) -> DataFrame:
    """`rows` with their samples above `hz`, a row for each sample, whatever the length of a medium."""
    m, v, b0 = biquad_highpass(rate, hz)
    # with the input in the state as well, the output is a column of it: y = b0 x + s[0]
    wide = np.array([[m[0, 0], m[0, 1], 0.0], [m[1, 0], m[1, 1], 0.0], [1.0, 0.0, 0.0]])
    told = affine_scan(rows, by, order, [value], wide, np.array([v[0], v[1], [b0]]), ["_s1", "_s2", name], chunk)
    return told.drop("_s1", "_s2")


class TrailingPercentile:
    """The value at place floor(fraction * (n - 1)) among the last `most` rows, of each column of them.

    Each row that is held knows how many stand below it, equal and older ones included; a row that comes or goes changes those
    counts by one, so no row is sorted again.
    """

    def __init__(self, fraction: float, most: int, width: int):
        self.fraction, self.most, self.n, self.next = fraction, most, 0, 0
        self.rows, self.below = np.zeros((most, width)), np.zeros((most, width), np.int64)

    def push(self, row: np.ndarray) -> np.ndarray:
        if self.n == self.most:
            # the oldest goes: it stood below all that are greater, or equal and younger
            old = self.rows[self.next].copy()
            self.below -= old <= self.rows
        n = self.n
        held = np.ones(n, bool)
        if n == self.most:
            held[self.next] = False
        rows = self.rows[:n]
        under = (rows <= row) & held[:, None]
        self.below[:n] += (row < rows) & held[:, None]
        self.rows[self.next], self.below[self.next] = row, under.sum(0)
        self.next = (self.next + 1) % self.most
        self.n = min(self.most, n + 1)
        return self.at()

    def at(self) -> np.ndarray:
        wanted = int(np.floor(self.fraction * (self.n - 1)))
        return np.take_along_axis(self.rows[: self.n], (self.below[: self.n] == wanted).argmax(0)[None, :], 0)[0]


def trailing_percentile(rows: DataFrame, by: list[str], order: list[str], value: str, fraction: float, most: int, name: str, counts: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """`rows` with the percentile of the last `most` rows of their medium for which the column `counts` holds (null: all), the row
    itself included; null before the first. Values are numbers; a null value does not count."""
    sound = F.col(value).isNotNull()
    flagged = rows.withColumn("_counts", sound & F.col(counts) if counts else sound)
    table = stored(numbered(flagged, by, order, flag="_counts"), "rows")
    types = dict(table.dtypes)
    keys = ", ".join(f"`{k}` {types[k]}" for k in by)
    own = F.floor((F.col("flagged") - 1) / chunk)
    reach = -(-most // chunk)
    also = F.filter(F.sequence(own, own + reach), lambda c: (c == own) | ((F.col("flagged") - 1) >= c * chunk - (most - 1)))
    cells = table.where("_counts").select(*by, F.col("flagged").alias("no"), F.col(value).cast("double").alias("_v"), F.explode(also).alias("_chunk")).repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "no").withColumn("_cell", F.xxhash64(*by, "_chunk"))

    def run(cell: pa.Table) -> pa.RecordBatch:
        no, first = cell["no"].to_numpy(), int(cell["_chunk"][0].as_py()) * chunk + 1
        window = TrailingPercentile(fraction, most, 1)
        found = np.array([window.push(np.array([v]))[0] for v in cell["_v"].to_pylist()])
        keep = np.flatnonzero(no >= first)
        return pa.RecordBatch.from_arrays([*(cell[k].combine_chunks().take(pa.array(keep)) for k in by), pa.array(no[keep]), pa.array(found[keep])], [*by, "flagged", name])

    out = _each_chunk(cells, run, f"{keys}, flagged bigint, `{name}` double")
    return table.join(out, [*by, "flagged"], "left").select(*rows.columns, name)
