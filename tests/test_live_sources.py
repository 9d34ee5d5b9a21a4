"""The source of growing session files, and the sink of document files."""

import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronotext.sources import document_files, live_frames
from chronotext.streaming import live


def pcm(*values):
    return struct.pack(f"<{len(values)}f", *values)


def run(stream, out, state):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_a_restart_reads_exactly_what_follows(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    sent = {"a": [live_frames.frame("start", 1, b'{"type":"start"}')] + [live_frames.frame("audio", 100 * i, pcm(i, -i)) for i in range(1, 6)], "b": [live_frames.frame("audio", 7, b"")]}
    live_frames.append(str(folder), "a", sent["a"][:3])
    live_frames.append(str(folder), "a", [sent["a"][3][:9]])  # half a frame
    read = lambda: sorted((r["session_id"], r["seq"], r["kind"], None if r["samples"] is None else list(r["samples"])) for r in spark.read.parquet(out).collect())
    run(live_frames.frames(spark, str(folder)), out, state)
    assert len(read()) == 3
    live_frames.append(str(folder), "a", [sent["a"][3][9:], *sent["a"][4:], live_frames.frame("stop", 900)])
    live_frames.append(str(folder), "b", sent["b"])
    run(live_frames.frames(spark, str(folder), maxBytesPerFile="40", splitBytes="10"), out, state)
    run(live_frames.frames(spark, str(folder)), out, state)
    want, at = [("b", 0, "audio", [])], 0
    for i, part in enumerate([*sent["a"], live_frames.frame("stop", 900)]):
        want.append(("a", at, "start" if i == 0 else "stop" if i == 6 else "audio", [float(i), -float(i)] if 0 < i < 6 else None))
        at += len(part)
    assert read() == sorted(want)
    table = live_frames.frames(spark, str(folder), stream=False)
    assert table.count() == 8 and table.where("kind = 'start'").first()["message"] == '{"type":"start"}'


def test_what_is_no_frame_is_told(tmp_path):
    live_frames.append(str(tmp_path), "x", [b"\x01\x00\x00\x00\x09" + bytes(20)])
    with pytest.raises(ValueError, match="byte 0"):
        live_frames.whole_frames(str(tmp_path / "x.frames"), 0, 100)


def files(path):
    return {str(p.relative_to(path)): p.read_text() for p in Path(path).rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(path).parts)}


def test_one_file_for_each_document(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}/talk.{i}.srt", f"text {i} é\n", i) for i in range(30)] + [("two.txt", "second", 2), ("two.txt", "first ", 1), ("none.txt", None, 0)], "file string, value string, n int").repartition(4)
    document_files.documents(rows, str(tmp_path), order=["n"])
    assert files(tmp_path) == {f"d{i}/talk.{i}.srt": f"text {i} é\n" for i in range(30)} | {"two.txt": "first second", "none.txt": ""}
    document_files.documents(rows.where("n < 2").withColumn("value", F.lit("new")), str(tmp_path))
    assert files(tmp_path)["two.txt"] == "new" and len(files(tmp_path)) == 32
    assert not list((tmp_path / document_files.STAGED).iterdir())


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken"):
        document_files.documents(rows, str(tmp_path))
    assert files(tmp_path) == {}
    for name in ("../out", "/out", "a/../../b", ".hidden", ""):
        with pytest.raises(ValueError, match="not a name"):
            document_files.safe(name)


def test_a_commit_that_was_cut_short_is_finished_and_a_repeated_one_writes_nothing(tmp_path):
    from pyspark.sql import Row

    writer = document_files.FilesStreamWriter({"path": str(tmp_path), "query": "q"})
    told = [writer.write(iter([Row(file="a", value="1"), Row(file="b", value="2")])), None]
    record = tmp_path / document_files.RECORDS / "q-0.json"
    record.parent.mkdir()
    record.write_text(json.dumps({"tasks": [told[0].task], "files": 2}))  # and then the driver stopped
    left = writer.write(iter([Row(file="c", value="3")]))
    assert files(tmp_path) == {}
    document_files.recover(str(tmp_path))
    assert files(tmp_path) == {"a": "1", "b": "2"} and left.files == 1
    again = [writer.write(iter([Row(file="a", value="other")]))]
    writer.commit(again, 0)
    assert files(tmp_path) == {"a": "1", "b": "2"}
    writer.commit([writer.write(iter([Row(file="a", value="other")]))], 1)
    assert files(tmp_path)["a"] == "other"
    writer.abort([writer.write(iter([Row(file="z", value="")]))], 2)
    assert "z" not in files(tmp_path) and not list((tmp_path / document_files.STAGED).iterdir())


def test_events_of_a_stream_as_files(spark, tmp_path):
    rows = [("s 1", 1, "final", 1, "hello", 0.0, 900.0), ("s 1", 0, "partial", None, "he", None, None), ("t", 5, "final", 1, "good", 0.0, 1.0)]
    spark.createDataFrame(rows, live.EVENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.EVENTS).parquet(str(tmp_path / "in"))
    document_files.event_files(stream, str(tmp_path / "out"), str(tmp_path / "state"), "q", availableNow=True).awaitTermination()
    got = files(tmp_path / "out")
    assert sorted(got) == ["s_1/000000000000.jsonl", "t/000000000000.jsonl"]
    assert [json.loads(x)["text"] for x in got["s_1/000000000000.jsonl"].splitlines()] == ["he", "hello"]
    query = live.write_events(stream, str(tmp_path / "lines"), str(tmp_path / "state2"), availableNow=True)
    query.awaitTermination()
    assert sorted(json.loads(r["value"])["text"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["good", "he", "hello"]
