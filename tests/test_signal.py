"""Signals against plain arithmetic and thresholds in decibels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import signal as S

RATE = 16000


def tone(seconds, hz=440.0, level=0.3):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * RATE)) / RATE)).astype(np.float32)


def silence(seconds):
    return np.zeros(int(seconds * RATE), np.float32)


def db(a, b):
    return 20 * np.log10(np.sqrt(np.mean(np.square(a))) / np.sqrt(np.mean(np.square(b))))


def test_filters():
    assert db(S.high_pass(tone(1, 1000), RATE, 100), tone(1, 1000)) > -1.5
    assert db(S.high_pass(tone(1, 50), RATE, 100)[RATE // 2 :], tone(1, 50)[RATE // 2 :]) < -6
    assert S.high_pass(tone(0.1), RATE, 0).tolist() == tone(0.1).tolist()


def test_resampling():
    out = S.resample_sinc(tone(0.5), RATE, 8000)
    want = 0.3 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)
    assert len(out) == 4000 and np.abs(out - want)[100:-100].max() < 0.01
    assert np.allclose(S.resample_sinc(np.full(1000, 0.5), 44100, RATE), 0.5, atol=1e-6)


def test_denoise_and_centre():
    random = np.random.default_rng(0)
    clean = np.concatenate([np.concatenate([tone(0.4, 300), silence(0.4)]) for _ in range(4)])
    noisy = clean + random.normal(0, 0.2, len(clean))
    before, after = db(clean, noisy - clean), db(clean, S.denoise(noisy, RATE) - clean)
    assert after - before > 3
    assert np.abs(S.denoise(tone(1), RATE) - tone(1)).max() < 1e-3
    voice, side = tone(1, 300), tone(1, 2000)
    out = S.centre_channel(voice + side, voice - side, RATE)
    assert abs(db(out, voice)) < 1 and S.centre_channel(voice, voice, RATE) == pytest.approx(voice, abs=1e-3)


def test_snr_without_energy():
    assert S.snr_db(silence(1), RATE) is None
    assert S.snr_db(np.concatenate([tone(1), silence(1)]) + 1e-3, RATE, [(0, 1000)]) > 20


def test_speech_regions(spark):
    sounds = np.concatenate([silence(1), tone(1), silence(0.1), tone(0.5), silence(1.5), tone(0.1), silence(1)])
    media = spark.createDataFrame([("m", RATE, sounds.tolist()), ("quiet", RATE, silence(1).tolist()), ("none", RATE, [])], "m string, rate int, samples array<float>")
    found = S.speech_regions(media, ["m"]).collect()
    assert len(found) == 1 and found[0]["m"] == "m"
    assert found[0]["start_ms"] == pytest.approx(900, abs=30) and found[0]["end_ms"] == pytest.approx(2700, abs=30)
    cut = {r["m"]: (len(r["samples"]), r["lead_ms"]) for r in S.trim_to_speech(media, ["m"]).collect()}
    assert cut["quiet"] == (RATE, 0.0) and cut["m"][0] == pytest.approx(2.0 * RATE, abs=RATE * 0.06)
    level = {r["m"]: r["active_rms"] for r in S.active_rms(media, spark.createDataFrame([("m", 1000.0, 2000.0)], "m string, start_ms double, end_ms double"), ["m"]).collect()}
    assert level["m"] == pytest.approx(0.3 / np.sqrt(2), rel=1e-3) and level["none"] == 0


def test_loudness(spark):
    rows = spark.createDataFrame([(1, tone(0.1, level=0.01).tolist()), (2, silence(0.01).tolist()), (3, [1.0] + [0.0] * 999)], "id int, samples array<float>")
    out = {r["id"]: np.array(r["x"]) for r in rows.select("id", S.normalize_loudness("samples").alias("x")).collect()}
    assert np.sqrt(np.mean(out[1] ** 2)) == pytest.approx(0.1, rel=1e-3)
    assert not out[2].any() and out[3].max() == pytest.approx(10 ** (-1 / 20), rel=1e-5)
    linear = rows.where("id = 3").select(S.resample_linear("samples", 1000, 500).alias("x")).first()["x"]
    assert len(linear) == 500
    assert rows.select(S.apply("samples", lambda x: x * 2).alias("x")).where("x IS NOT NULL").count() == 3
    assert rows.where("id = 1").select(F.sum(S.crossings("samples"))).first()[0] == pytest.approx(88, abs=2)


def test_chunks_of_a_medium_in_order(spark):
    """Media of several chunks, dealt and mixed, in Arrow batches that end anywhere."""
    sounds = {m: np.concatenate([silence(0.4), tone(0.2 * m), silence(0.9), tone(0.5), silence(0.3)]) for m in range(1, 5)}
    rows = [(m, i, sounds[m][i * 160 : (i + 1) * 160].tolist()) for m in sounds for i in range(len(sounds[m]) // 160)]
    chunks = spark.createDataFrame(rows, "m int, i int, x array<float>").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = S.over_chunks(chunks, ["m"], ["i"], lambda x: [(len(x), a, b) for a, b in S.regions(x, RATE)], {"n": "int", "a": "double", "b": "double"}, "x").collect()
        ends = S.over_chunks(chunks, ["m"], ["i"], lambda x: [(S.trimmed(x, RATE)[0], len(S.trimmed(x, RATE)[1]))], {"lead_ms": "double", "n": "int"}, "x").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {m: x[: len(x) // 160 * 160] for m, x in sounds.items()}
    assert sorted(map(tuple, got)) == sorted((m, len(x), a, b) for m, x in whole.items() for a, b in S.regions(x, RATE))
    media = spark.createDataFrame([(m, RATE, x.tolist()) for m, x in whole.items()], "m int, rate int, samples array<float>")
    assert sorted(map(tuple, ends)) == sorted((r["m"], r["lead_ms"], len(r["samples"])) for r in S.trim_to_speech(media, ["m"]).collect())


@pytest.mark.parametrize("name", ["signal_to_noise", "speech_spans", "trimmed_signals"])
def test_no_row_holds_a_recording(spark, tmp_path, name):
    """Arrow sends rows to Python by thousands, so recordings stay rows of chunks up to the task that hears them."""
    from chronotext.plans.registry import QUERIES

    spark.createDataFrame([(i, i % 2, [0.1] * 64) for i in range(200)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan
