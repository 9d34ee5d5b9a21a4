"""Live sessions: the state machine, its batch twin and the stream; translation in blocks."""

import json

import pytest
from pyspark.sql import functions as F

from chronotext.operators import translate
from chronotext.streaming import live

ROWS = [
    ("s", 1, "audio", 1000.0, 100.0, 1000.0, "the quick brown fox"),
    ("s", 2, "audio", 2000.0, 100.0, 2000.0, "the quick red fox"),
    ("s", 3, "audio", 2700.0, 100.0, 2050.0, "hello world"),
    ("s", 4, "audio", 4000.0, 3000.0, 4000.0, "world today"),
    ("s", 5, "flush", 4100.0, 3000.0, 4050.0, "world today"),
    ("s", 6, "stop", 4200.0, None, None, None),
    ("s", 7, "audio", 9000.0, 8000.0, 8100.0, "after the stop"),
    ("t", 1, "audio", 7000.0, 0.0, 7000.0, "a long cue"),
    ("u", 1, "audio", 900.0, None, None, ""),
]
WANT = [("s", 2, "partial", "the quick"), ("s", 3, "final", "hello world"), ("s", 5, "final", "today"), ("t", 1, "final", "a long cue")]


def said(rows):
    return sorted((r["session_id"], r["seq"], r["type"], r["text"]) for r in rows)


def test_batch_twin(spark):
    got = live.batch(spark.createDataFrame(ROWS, live.UPDATES).repartition(3)).collect()
    assert said(got) == WANT
    finals = {(r["session_id"], r["cue_id"]): (r["start_ms"], r["end_ms"]) for r in got if r["type"] == "final"}
    assert finals == {("s", 1): (100, 2050), ("s", 2): (3000, 4050), ("t", 1): (0, 7000)}


def test_stream_gives_the_same_events(spark, tmp_path):
    for i, part in enumerate((ROWS[:3], ROWS[3:])):
        spark.createDataFrame(part, live.UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(live.UPDATES).parquet(str(tmp_path / "in"))
        query = live.events(stream, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert query.exception() is None and i < 2
    assert said(spark.read.parquet(str(tmp_path / "out")).collect()) == WANT


def test_control_messages(spark):
    rows = spark.createDataFrame([(json.dumps({"type": "start", "language": "en"}),), ("{bad",), (json.dumps({"type": "other"}),)], "v string")
    got = [r["m"] for r in rows.select(live.control_message(F.col("v")).alias("m")).collect()]
    assert got[0]["language"] == "en" and got[1] is None and got[2] is None


def test_sessions_by_gap(spark):
    rows = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate([(0, 100), (150, 300), (1200, 1300), (1310, 2500), (2510, 3000)])], "m string, i int, start_ms double, end_ms double")
    got = sorted((r["start_ms"], r["end_ms"], r["n_rows"]) for r in live.sessions_by_gap(rows, ["m"], ["i"], 600, 1500).collect())
    assert got == [(0, 300, 2), (1200, 2500, 2), (2510, 3000, 1)]


def test_translation(spark):
    cues = spark.createDataFrame([("m", i, t) for i, t in enumerate(["hello there", "you", "", "bad one"])], "m string, i int, text string")

    def picky(texts, source, target):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    got = {r["i"]: (r["translation"], r["error"]) for r in translate.translate_cues(cues, ["m"], "i", "text", "en", "es", picky).collect()}
    assert got == {0: ("HELLO THERE", None), 1: ("YOU", None), 2: ("", None), 3: ("bad one", "no")}
    same = {r["i"]: r["translation"] for r in translate.translate_cues(cues.where("i < 2"), ["m"], "i", "text", "en", "es").collect()}
    assert same == {0: "hello there", 1: "you"}


@pytest.mark.parametrize(("a", "b", "way"), [("es", "zh", ["es", "en", "zh"]), ("en", "es", ["en", "es"]), ("zh-TW", "en", ["zh", "en"]), ("es", "es", []), ("fr", "en", None)])
def test_routes(spark, a, b, way):
    assert translate.routes(spark.createDataFrame([(a, b)], "source string, target string")).first()["route"] == way


def test_finals_are_translated(spark):
    stream = live.batch(spark.createDataFrame(ROWS, live.UPDATES))
    got = live.finals_translated(stream, lambda texts: [t[::-1] for t in texts]).collect()
    assert {r["translation"] for r in got} == {"dlrow olleh", "yadot", "euc gnol a"} and all(r["error"] is None for r in got)
