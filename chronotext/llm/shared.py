"""What several operators need: the shared folder, deterministic samples, and bounded membership filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and everything runs on one machine a temporary one is set."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chronotext-"))
    return context.getCheckpointDir().rstrip("/")


#: Tables that written() has made and nobody has dropped, and the application of each; those of the scopes that are open.
_tables: dict[str, str] = {}
_scopes: list[set[str]] = []


@contextmanager
def scope() -> Iterator[set[str]]:
    """The names of the tables that written() makes inside: what sweep() may delete once their result is stored elsewhere."""
    own: set[str] = set()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes[:] = [x for x in _scopes if x is not own]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[path] = df.sparkSession.sparkContext.applicationId
    for own in _scopes:
        own.add(path)
    out._written_to = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """written() in small Arrow batches, after which what the table's making has shuffled is gone from the disks."""
    with smaller_batches(df.sparkSession), shuffles_dropped(df.sparkSession):
        return written(df, name)


def drop(*frames: DataFrame) -> None:
    """Deletes tables that written() has made, once all that reads them is written itself."""
    for df in frames:
        _delete(df.sparkSession, [df._written_to])


def sweep(spark: SparkSession, own: set[str] | None = None) -> None:
    """Deletes the tables of a scope; without one, every table that written() has made in this application."""
    _delete(spark, [p for p, a in _tables.items() if a == spark.sparkContext.applicationId and (own is None or p in own)])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _tables.pop(path, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*columns) -> F.Column:
    """A hash of the columns, spread evenly over [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by`, or all where there are fewer; the choice hangs on the key alone."""
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    rows = {r[by]: r["_n"] for r in counts.where(F.col(by).isNotNull()).collect()}
    keep = F.lit(False)
    for value, n in rows.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (unit_hash(F.col(key), F.lit("sample")) < F.lit(min(1.0, most / n) if n > most else 2.0)))
    return df.where(keep)


def held_out(key: str = "doc_id") -> F.Column:
    """True where crc32 of the key as text is divisible by 5: rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def filter_bits(rows: int) -> int:
    """The bits of a filter over so many rows: 8 for each, from half a megabyte to 8 megabytes."""
    return min(max(1 << (8 * rows).bit_length(), 1 << 22), 1 << 26)


def member_bits(df: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A bit for each residue of the 64-bit values of a column: a filter of fixed size whatever the number of rows.

    A value that is there always finds its bit set; others find it set now and then, so an exact join must follow.
    """
    at = F.pmod(F.col(column), F.lit(bits))
    word = df.select((at / 32).cast("long").alias("w"), F.pmod(at, F.lit(32)).cast("int").alias("b"))
    packed = word.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    found = packed.toArrow()  # as many rows as the filter has words, at most
    out[found["w"].to_numpy()] = (found["v"].to_numpy() & 0xFFFFFFFF).astype(np.uint32)
    return out


def hottest(counted: DataFrame, most: int) -> int:
    """The frequency n from which on there are at most `most` rows."""
    sizes = counted.groupBy("n").agg(F.count("*").alias("rows")).where(F.col("n") > 1)
    # frequencies from 2 on, each at most once: as many rows as distinct frequencies
    total, least = 0, 1 << 62
    for n, rows in sorted(((r["n"], r["rows"]) for r in sizes.toLocalIterator()), reverse=True):
        total += rows
        if total > most:
            break
        least = n
    return least


#: A key of so many rows is hot, and of all keys of a table at most so many are.
HOT_ROWS, HOT_KEYS = 1 << 11, 1 << 14


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows (a table) joined to lookup (one small row for each key), inner or left, without one task for a hot key.

    The lookup rows of hot keys are broadcast: a key is hot with HOT_ROWS rows or the HOT_KEYS-th part of all, whichever
    is more, so there are at most HOT_KEYS of them whatever the table holds. All other keys meet in a shuffle. The result
    is that of rows.join(lookup, key, how), whichever keys are hot: a left join keeps the rows of a hot key without a lookup row.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") >= max(HOT_ROWS, rows.count() // HOT_KEYS)).select(key).toArrow()
    if not len(hot):
        return rows.join(lookup, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame(hot))
    cold = rows.join(keys, key, "left_anti").join(lookup, key, how)
    return cold.unionByName(rows.join(keys, key, "left_semi").join(F.broadcast(lookup.join(keys, key, "left_semi")), key, how))


def fresh_name(columns: list[str], name: str) -> str:
    """A column name like `name` that is not among `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named_apart(key: str, results: list[str]) -> None:
    """A key column comes back under its own name, so it can't be that of a result."""
    if key.lower() in {r.lower() for r in results}:
        raise ValueError(f"the key column {key!r} bears the name of a result; rename it first")


def has_bit(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which int64 values may be in the column that member_bits() read."""
    at = np.mod(values, np.int64(len(found) * 32))
    return (found[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that hands its freed memory back at the end: Spark keeps the worker for later tasks,
    and beside it the executor needs the memory for stages without Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # large buffers go back as soon as they are free
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows from now on, for applications over whole texts; a lower setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows while a table is made: of long texts, whole default batches are tens of MB on
    both sides of each task. The session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a table's making has shuffled goes when the table is there, not at some later garbage collection of the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
