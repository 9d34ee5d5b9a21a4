"""WAV files, listings, recognisers and the engine from audio to documents."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.plans.engine import Engine
from chronotext.sources import media


def wav(x, rate=16000, bits=16, kind=1, junk=False):
    x = np.atleast_2d(x).T
    if kind == 3:
        data = x.astype("<f4").tobytes()
    elif bits == 8:
        data = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(int(v * (2**23 - 1)).to_bytes(3, "little", signed=True) for v in x.ravel())
    else:
        data = (x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    channels = x.shape[1]
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0" if junk else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


TONE = 0.5 * np.sin(2 * np.pi * 300 * np.arange(1600) / 16000)


@pytest.mark.parametrize(("bits", "kind"), [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
def test_wav_formats(bits, kind):
    rate, x = media.parse_wav(wav(np.stack([TONE, -TONE]), bits=bits, kind=kind, junk=True))
    assert rate == 16000 and x.shape == (2, 1600)
    assert np.abs(x[0] - TONE).max() < (0.02 if bits == 8 else 1e-3) and np.abs(x.mean(axis=0)).max() < 0.01


def test_decode_keeps_bad_files_as_rows(spark, tmp_path):
    for name, data in (("a.wav", wav(TONE)), ("b.WAV", b"nonsense"), (".hidden.wav", wav(TONE)), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in media.load_audio(spark, str(tmp_path), 8000).collect()}
    assert len(rows["a.wav"]["samples"]) == 800 and rows["a.wav"]["duration_ms"] == 100 and rows["b.WAV"]["error"] == "not a WAV file"
    assert [r["path"].rsplit("/", 1)[-1] for r in media.listing(spark, str(tmp_path)).collect()] == ["a.wav", "b.WAV"]
    frame = spark.createDataFrame([(bytearray(np.float32([0.5, -1]).tobytes() + b"\1"),)], "b binary")
    assert frame.select(media.pcm_floats("b").alias("x")).first()["x"] == [0.5, -1.0]


def test_engine_from_audio_to_documents(spark):
    quiet, loud = np.zeros(16000), 0.3 * np.sin(2 * np.pi * 300 * np.arange(32000) / 16000)
    audio = spark.createDataFrame([("m", 16000, np.concatenate([quiet, loud, quiet]).tolist())], "m string, rate int, samples array<float>")

    def hears(samples, rate, language):
        return [("Hello there, this is a test.", 200.0, 1500.0), ("thanks for watching", 1500.0, 1900.0)]

    engine = Engine(spark, hears, lambda texts, a, b: [t.upper() for t in texts])
    found = engine.transcribe(audio, ["m"]).withColumn("lang", F.lit("en"))
    first = found.where("seg_no = 0").first()
    assert 900 < first["start_ms"] < 1100
    cues = engine.cues(found, ["m"])
    assert [r["lines"] for r in cues.collect()] == [["Hello there, this is a test."]]
    assert "HELLO THERE" in engine.documents(engine.translate(cues, ["m"], "en", "es"), ["m"]).first()["srt"]
    assert engine.statistics(cues, ["m"]).first()["word_count"] == 6
    edited = engine.edit(cues, spark.createDataFrame([("m", 1, " new   text ")], "m string, index int, text string"), ["m"], "en")
    assert edited.first()["lines"] == ["new text"]

    def fails(samples, rate, language):
        raise ValueError("deaf")

    assert Engine(spark, fails).transcribe(audio, ["m"]).first()["error"] == "deaf"
