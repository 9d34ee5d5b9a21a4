"""Stream state: rows in order, late rows counted, audio held within bounds, and the batch twin."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import signal
from chronotext.streaming import audio, ordered

BASE = datetime(2024, 1, 1)


def at(ms):
    return BASE + timedelta(milliseconds=ms)


def land(spark, path, parts, schema):
    """Each part as a file of its own, in this order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_rows_come_in_order_and_late_ones_are_counted(spark, tmp_path):
    random.seed(4)
    rows = [(k, i, at(i * 100 + j), float(i)) for j, k in enumerate("abc") for i in range(60)]
    parts = [[r for r in rows if lo <= r[1] < lo + 20] for lo in (0, 20, 40)]
    for p in parts:
        random.shuffle(p)
    late = [("a", 3, at(300), -1.0), ("b", 5, at(501), -1.0), ("a", 4, at(405), -1.0)]
    end = [("end", 1, at(10**7), 0.0)]
    schema = "k string, seq long, ts timestamp, value double"
    land(spark, str(tmp_path / "in"), [parts[0], parts[1], [], late + parts[2], end], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ordered.run_available(ordered.in_order(stream, ["k"], "ts", "seq", "500 milliseconds"), str(tmp_path / "out"), str(tmp_path / "state"), 2).collect()
    for k in "abc":
        assert [(r["place"], r["value"]) for r in sorted((r for r in got if r["k"] == k and r["place"]), key=lambda r: r["place"])] == [(i + 1, float(i)) for i in range(60)]
    assert sorted((r["k"], r["seq"], r["n_late"]) for r in got if r["n_late"]) in ([("a", 3, 1), ("a", 4, 2), ("b", 5, 1)], [("a", 3, 2), ("a", 4, 1), ("b", 5, 1)])


def speech(rate, ms, loud, seed=0):
    n = int(rate * ms / 1000)
    t = np.arange(n) / rate
    return (np.sin(2 * np.pi * 220 * t) * (0.4 if loud else 0.0) + np.random.default_rng(seed).normal(0, 0.0005, n)).astype(np.float32)


@pytest.mark.parametrize("seed", range(4))
def test_regions_of_one_signal(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([speech(8000, float(rng.integers(50, 900)), bool(rng.integers(0, 2)), i) for i in range(8)])
    media = spark.createDataFrame([("m", [float(v) for v in x], 8000)], "m string, samples array<float>, rate int")
    want = sorted((r["start_ms"], r["end_ms"]) for r in signal.speech_regions(media, ["m"]).collect())
    assert np.allclose(np.array(signal.regions(x, 8000)).reshape(-1), np.array(want).reshape(-1))
    assert signal.regions(x[:10], 8000) == []


def _settings():
    def hear(samples, rate):  # a function of a function: workers need not import this module
        return f"heard {len(samples)} samples up to {float(np.abs(samples).max()):.3f}"

    return audio.Settings(hear, rate=8000)


SETTINGS = _settings()


def frames(session, plan, ms=100, rate=8000):
    """Frames of 100 ms for a plan of (ms, loud)."""
    x = np.concatenate([speech(rate, m, loud, i) for i, (m, loud) in enumerate(plan)])
    size = rate * ms // 1000
    rows = [(session, i, at(i * ms), "audio", [float(v) for v in x[i * size : (i + 1) * size]]) for i in range(len(x) // size)]
    return [*rows, (session, len(rows), at(len(rows) * ms), "stop", None)]


PLANS = {"short": [(500, False), (1500, True), (1200, False), (900, True)], "long": [(16_000, True), (2000, False)], "quiet": [(9000, False)]}


def said(rows):
    return sorted((r["session_id"], r["seq"], r["type"], r["cue_id"], r["text"], r["start_ms"], r["end_ms"]) for r in rows if r["type"] != "late")


def test_stream_of_audio_equals_its_batch_twin(spark, tmp_path):
    random.seed(1)
    rows = [r for name, plan in PLANS.items() for r in frames(name, plan)]
    parts = [[r for r in rows if lo <= r[1] < lo + 40] for lo in range(0, 200, 40)]
    for p in parts:
        random.shuffle(p)
    late = [("short", 1, at(100), "audio", [1.0] * 800)]
    land(spark, str(tmp_path / "in"), [*parts[:2], parts[2] + late, *parts[3:], [("end", 0, at(10**6), "flush", None)]], audio.FRAMES)
    stream = spark.readStream.schema(audio.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ordered.run_available(audio.events(stream, SETTINGS, "1 second", None), str(tmp_path / "out"), str(tmp_path / "state"), 2).collect()
    want = audio.batch(spark.createDataFrame(rows, audio.FRAMES).repartition(3), SETTINGS).collect()
    assert said(got) == said(want)
    assert [(r["session_id"], r["seq"], r["cue_id"]) for r in got if r["type"] == "late"] == [("short", 1, 1)]
    finals = [(r["session_id"], r["start_ms"]) for r in want if r["type"] == "final"]
    assert [s for s, _ in sorted(finals)] == ["long", "long", "short", "short"]  # two cuts of "long" sound alike: one says nothing new
    state = spark.read.format("statestore").option("stateVarName", "frames").load(str(tmp_path / "state"))
    assert state.count() == 0  # a stop lets go of all samples


def test_a_session_holds_no_more_than_its_bound():
    held = {}
    segment = audio.Segment(SETTINGS, audio.Scalars(), held)
    x = np.concatenate([speech(8000, 60_000, True), speech(8000, 20_000, False), speech(8000, 30_000, True)])
    most = 0
    for i in range(0, len(x), 800):
        list(segment.take({"no": i, "kind": "audio", "samples": x[i : i + 800]}))
        most = max(most, sum(map(len, held.values())))
        assert segment.now.held == sum(map(len, held.values()))
    assert most <= 8000 * (SETTINGS.most_ms + 100) / 1000 and len(held) == segment.now.last - segment.now.first
    assert list(segment.take({"no": -1, "kind": "stop", "samples": None}))[0]["type"] == "final" and not held
    assert list(segment.take({"no": -2, "kind": "audio", "samples": x})) == []


def test_stream_state_is_bounded(spark, tmp_path):
    """No stop comes: what the state store holds is the tail."""
    rows = [r for r in frames("s", [(3000, True), (6000, False)]) if r[3] != "stop"]
    land(spark, str(tmp_path / "in"), [rows[:50], rows[50:], [("end", 0, at(10**6), "flush", None)]], audio.FRAMES)
    stream = spark.readStream.schema(audio.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered.run_available(audio.events(stream, SETTINGS, "1 second", None), str(tmp_path / "out"), str(tmp_path / "state"), 1).count()
    held = spark.read.format("statestore").option("stateVarName", "frames").load(str(tmp_path / "state")).select(F.size("user_map_value.samples").alias("n")).collect()
    assert 0 < sum(r["n"] for r in held) <= 8000 * (600 + 100) / 1000
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert waiting.count() <= 1


def test_partials_come_on_time_however_long_a_session_is():
    """A partial is due after 1000 ms: after ten frames of 100 ms at 640 Hz, wherever in the session they stand."""
    found = lambda samples, rate: [(0.0, len(samples) * 1000 / rate)]
    for before in range(0, 3000, 7):
        segment = audio.Segment(audio.Settings(lambda samples, rate: f"{len(samples)}", found, 640, most_ms=1e9), audio.Scalars(gone=64 * before, updated=64 * before), {})
        heard = []
        segment._partial = lambda no, samples, heard=heard: iter(heard.append(no) or ())
        for i in range(1, 31):
            list(segment.take({"no": i, "kind": "audio", "samples": [0.5] * 64}))
        assert heard == [10, 20, 30], before


def test_whole_milliseconds_come_out_whole():
    segment = audio.Segment(audio.Settings(lambda samples, rate: "", rate=640), audio.Scalars(), {})
    assert all(segment._ms(64 * n) == 100 * n for n in range(20_000))


def test_rows_of_a_micro_batch_wait_as_one_block(spark, tmp_path):
    rows = [("a", i, at(i), None if i % 3 else float(i)) for i in range(60)] + [("a", 7, at(7), -7.0)]
    schema = "k string, seq long, ts timestamp, value double"
    land(spark, str(tmp_path / "in"), [rows[:60], rows[60:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered.run_available(ordered.in_order(stream, ["k"], "ts", "seq", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"), 1).count()
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state")).count() == 2
    land(spark, str(tmp_path / "in"), [[("end", 0, at(10**8), 0.0)]], schema)
    got = ordered.run_available(ordered.in_order(stream, ["k"], "ts", "seq", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"), 1).where("k = 'a'").collect()
    assert sorted((r["place"], r["seq"], r["value"]) for r in got) == [(i + 1, i, -7.0 if i == 7 else None if i % 3 else float(i)) for i in range(60)]
