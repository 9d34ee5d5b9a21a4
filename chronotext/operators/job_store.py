"""A store of job records that micro-batches are merged into: bucketed snapshots, a change log, and versions that appear whole.

Records are dealt to a fixed number of buckets by their key. A micro-batch of changes is one version: its changes are kept in
the log, the buckets that it touches are written anew with the changes folded in, and all others stay where they are. A version
is the table of where each bucket lies; it appears with the success mark of its own small write, so a merge that is cut short
leaves the version before. A micro-batch whose number has been merged changes nothing when it comes again.

Jobs that are removed leave a tombstone, so that changes that come late do not bring them back; compact() drops tombstones,
old versions and the data that nothing points to.

A change sets the fields that are not null in it; of each field the last change by `order` counts. A key that is not known
begins a record. A null key takes no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class JobStore:
    """Records of `schema` (a DDL string of key, order and fields) below `path`, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = StructType.fromDDL(schema)
        self.fields = [f.name for f in self.schema if f.name != key and f.name not in order]
        # of each field its value and the place of the change that set it: so changes may come in any order
        place = ", ".join(f"{c}: {self.schema[c].dataType.simpleString()}" for c in order)
        self.stored = f"{key} {self.schema[key].dataType.simpleString()}, removed boolean, latest struct<{place}>, " + ", ".join(f"{f} struct<place: struct<{place}>, value: {self.schema[f].dataType.simpleString()}>" for f in self.fields)

    # versions: tables of (bucket, folder) with the number of the micro-batch

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        fs, place = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that are whole."""
        numbers = [int(n.removeprefix("v=")) for n in self._names("versions") if n.startswith("v=")]
        return sorted(n for n in numbers if "_SUCCESS" in self._names(f"versions/v={n}"))

    def _version(self, number: int | None) -> tuple[dict[int, str], int]:
        """Folders by bucket, and the last micro-batch merged; there is a row for each bucket at most, and one for the version."""
        if number is None:
            return {}, -1
        rows = self.spark.read.schema("bucket int, folder string, micro_batch long").json(f"{self.path}/versions/v={number}").collect()
        return {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}, max(r["micro_batch"] for r in rows)

    def _publish(self, folders: dict[int, str], micro_batch: int) -> None:
        number = max(self.versions(), default=-1) + 1
        rows = [(None, None, micro_batch), *((b, f, micro_batch) for b, f in sorted(folders.items()))]
        self.spark.createDataFrame(rows, "bucket int, folder string, micro_batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/v={number}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _held(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/data/{f}" for f in sorted(folders.values())])

    def _as_stored(self, changes: DataFrame, removed: Column) -> DataFrame:
        place = F.struct(*self.order)
        values = [F.when(F.col(f).isNotNull(), F.struct(place.alias("place"), F.col(f).alias("value"))).alias(f) for f in self.fields]
        return changes.where(F.col(self.key).isNotNull()).select(self.key, removed.alias("removed"), place.alias("latest"), *values)

    def _merge(self, changed: DataFrame, micro_batch: int, kind: str) -> None:
        """changed: rows as they are stored, as a table in the log."""
        last = max(self.versions(), default=None)
        folders, _ = self._version(last)
        # the name of the version to come: a merge that was cut short leaves nothing that its repetition does not write over
        log = f"{self.path}/log/{kind}-{micro_batch}-{-1 if last is None else last}"
        changed.write.mode("overwrite").parquet(log)
        changed = self.spark.read.schema(self.stored).parquet(log)
        # as many as there are buckets, at most
        touched = sorted(r["b"] for r in changed.select(self._bucket().alias("b")).distinct().collect())
        if touched:
            before = self._held({b: folders[b] for b in touched if b in folders})
            newest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(f"{f}.place"))).alias(f) for f in self.fields]
            merged = before.unionByName(changed).groupBy(self.key).agg(F.max("removed").alias("removed"), F.max("latest").alias("latest"), *newest)
            name = f"{micro_batch}-{uuid.uuid4().hex}"
            merged.withColumn("bucket", self._bucket()).repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            folders = folders | {b: f"{name}/bucket={b}" for b in touched}
        self._publish(folders, max(micro_batch, self._version(last)[1]))

    def merge(self, changes: DataFrame, micro_batch: int) -> bool:
        """Folds a micro-batch of changes in; False if it has been merged before."""
        if micro_batch <= self._version(max(self.versions(), default=None))[1]:
            return False
        self._merge(self._as_stored(changes, F.lit(False)), micro_batch, "merge")
        return True

    def prune(self, old: Column) -> None:
        """Removes the records for which `old` holds, a condition on their columns; their tombstones stay till compact()."""
        gone = self.read().where(old).select(self.key)
        number = self._version(max(self.versions(), default=None))[1]
        nothing = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in [*self.order, *self.fields]]
        self._merge(self._as_stored(gone.select(self.key, *nothing), F.lit(True)), number, "prune")

    def read(self, version: int | None = None) -> DataFrame:
        """The records (key, the order of the last change, fields) of a version, the last unless said otherwise."""
        folders, _ = self._version(max(self.versions(), default=None) if version is None else version)
        held = self._held(folders).where(~F.coalesce("removed", F.lit(False)))
        return held.select(self.key, *(F.col(f"latest.{c}").alias(c) for c in self.order), *(F.col(f"{f}.value").alias(f) for f in self.fields))

    def changes(self) -> DataFrame:
        """The log: every change that has been merged (or is being merged), with the number of its micro-batch and removals marked."""
        names = self._names("log")
        if not names:
            return self.spark.createDataFrame([], f"{self.stored}, kind string, micro_batch long")
        told = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/log/{n}" for n in names])
        parts = F.split(F.element_at(F.split(F.input_file_name(), "/"), -2), "-")
        return told.select("*", parts[0].alias("kind"), parts[1].cast("long").alias("micro_batch"))

    def compact(self) -> None:
        """Writes every bucket anew without tombstones, then deletes the other versions and the data that only they name."""
        last = max(self.versions(), default=None)
        if last is None:
            return
        folders, number = self._version(last)
        name = f"{number}-{uuid.uuid4().hex}"
        whole = self._held(folders).where(~F.coalesce("removed", F.lit(False))).withColumn("bucket", self._bucket())
        whole.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        there = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{name}") if n.startswith("bucket=")}
        self._publish({b: f"{name}/bucket={b}" for b in there}, number)
        for folder, keep in (("versions", {f"v={max(self.versions())}"}), ("data", {name})):
            for old in self._names(folder):
                if old not in keep:
                    fs, place = self._fs(f"{self.path}/{folder}/{old}")
                    fs.delete(place, True)

    def follow(self, changes: DataFrame, checkpoint: str, **trigger):
        """Merges a stream's micro-batches as they come."""
        return changes.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()
