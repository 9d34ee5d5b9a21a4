"""A sink that writes each document as a file of its own, all of a job's files or none.

Tasks write below `.staged/<task>` with the names that files will have, and a list of them. The driver's commit first puts a
record of the job, naming its tasks, in place with one rename: from then on the job counts. Then it moves the files to their
places, each with one rename, so no reader ever sees half a file. If the driver stops in between, the next job or recover()
finishes what a record promises; what has no record is deleted. A stream's record bears the number of its micro-batch, so one
that is repeated writes nothing. Rows of one file must be in one partition (documents() deals them so); they are written in
order, each as it stands.

Files go to a folder that the driver and all executors mount. The driver does one rename for each file, in several threads.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

STAGED, RECORDS, THREADS = ".staged", ".committed", 16


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and how many files are in it."""

    task: str
    files: int


def safe(name: str) -> str:
    """A file's name below the folder; one that would leave it, or hide in it, is refused."""
    path = PurePosixPath(name)
    if not path.parts or path.is_absolute() or ".." in path.parts or any(p.startswith(".") for p in path.parts):
        raise ValueError(f"not a name for a document: {name!r}")
    return str(path)


class _Files:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("documents need a path")

    def stage(self, rows: Iterator[Row]) -> Staged:
        task = uuid.uuid4().hex
        folder, names, open_name, out = Path(self.path, STAGED, task), {}, None, None
        folder.mkdir(parents=True)
        try:
            for row in rows:
                name = safe(row["file"])
                if name != open_name:
                    if out is not None:
                        out.close()
                    place = folder / name
                    place.parent.mkdir(parents=True, exist_ok=True)
                    out, open_name = open(place, "ab" if name in names else "wb"), name
                    names[name] = None
                out.write((row["value"] or "").encode())
            if out is not None:
                out.close()
                out = None
            Path(folder, ".names").write_text(json.dumps(list(names)))
        except BaseException:
            if out is not None:
                out.close()
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Staged(task, len(names))

    def commit(self, job: str, messages: list[Staged | None]) -> None:
        record = Path(self.path, RECORDS, f"{job}.json")
        if record.exists():  # a micro-batch that has been committed before
            self.drop(messages)
        else:
            record.parent.mkdir(parents=True, exist_ok=True)
            half = record.with_suffix(f".{uuid.uuid4().hex}.tmp")
            half.write_text(json.dumps({"tasks": [m.task for m in messages if m is not None], "files": sum(m.files for m in messages if m is not None)}))
            os.replace(half, record)
        self.finish(record)

    def finish(self, record: Path) -> None:
        """Moves what a record's tasks have staged and is still there."""

        def move(task: str, name: str) -> None:
            source, target = Path(self.path, STAGED, task, name), Path(self.path, name)
            target.parent.mkdir(parents=True, exist_ok=True)
            try:
                os.replace(source, target)
            except FileNotFoundError:
                if not target.exists():
                    raise

        with ThreadPoolExecutor(THREADS) as pool:
            for task in json.loads(record.read_text())["tasks"]:
                names = Path(self.path, STAGED, task, ".names")
                if names.exists():
                    list(pool.map(lambda name, task=task: move(task, name), json.loads(names.read_text())))
                    shutil.rmtree(names.parent, ignore_errors=True)

    def drop(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None:
                shutil.rmtree(Path(self.path, STAGED, m.task), ignore_errors=True)


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.files, self.job = _Files(options), options.get("job") or f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.files.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.files.commit(self.job, messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self.files.drop(messages)


class FilesStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.files, self.query = _Files(options), options.get("query") or "stream"

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.files.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.files.commit(f"{self.query}-{batchId}", messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.files.drop(messages)


class DocumentFiles(DataSource):
    """format("document_files") for rows (file string, value string); a stream's `query` option tells it from others in the folder,
    and a job that bears a name (`job`) is committed once."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> FilesStreamWriter:
        return FilesStreamWriter(self.options)


def recover(path: str) -> None:
    """Finishes jobs whose record is there, and deletes what tasks without one have left. For a time without running jobs."""
    files = _Files({"path": path})
    for record in sorted(Path(path, RECORDS).glob("*.json")):
        files.finish(record)
    shutil.rmtree(Path(path, STAGED), ignore_errors=True)


def documents(rows: DataFrame, path: str, file: str = "file", value: str = "value", order: list[str] | None = None) -> None:
    """Writes rows (file, value) as files below `path`; several rows of one file follow each other by `order`."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    told = rows.select(rows[file].alias("file"), rows[value].alias("value"), *(rows[c].alias(f"o{i}") for i, c in enumerate(order or [])))
    dealt = told.repartition("file").sortWithinPartitions("file", *(f"o{i}" for i in range(len(order or [])))).select("file", "value")
    dealt.write.format("document_files").mode("append").save(path)


def event_files(events: DataFrame, path: str, checkpoint: str, query: str, **trigger):
    """A stream of live events as JSON lines, a file for each session and micro-batch: `<session>/<micro-batch>.jsonl`, each once."""
    spark = events.sparkSession
    spark.dataSource.register(DocumentFiles)

    def write(batch: DataFrame, number: int) -> None:
        name = F.concat(F.regexp_replace("session_id", r"[^A-Za-z0-9_-]", "_"), F.lit(f"/{number:012d}.jsonl"))
        lines = batch.select(name.alias("file"), "seq", F.concat(F.to_json(F.struct(*batch.columns)), F.lit("\n")).alias("value"))
        dealt = lines.repartition("file").sortWithinPartitions("file", "seq").select("file", "value")
        dealt.write.format("document_files").option("job", f"{query}-{number}").mode("append").save(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
